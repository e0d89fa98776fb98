"""Constants of the engine, in one place. Results depend on them."""

RETRIEVE_TOP_K, RERANK_TOP_K, RERANK_FLOOR = 20, 5, -10.0
FAITHFULNESS_THRESHOLD, CLAIM_ENTAILMENT_THRESHOLD = 0.70, 0.5
OOS_CALIBRATED_THRESHOLD, OOS_DECISION_THRESHOLD = 0.65, 0.5
CHUNK_CHILD_CHARS, RRF_K = 400, 60
NEAR_WINDOW = 600
SHINGLE_WORDS, MINHASH_PERMUTATIONS, NEAR_DUPLICATE_THRESHOLD = 5, 128, 0.9
SPLIT_RATIOS, SPLIT_SEED = (0.8, 0.1, 0.1), 42
PREMISE_WORDS, PREMISE_OVERLAP, PAIR_ACCEPT = 300, 50, 0.8
SEEDS, BOOTSTRAP_ROUNDS, CONFIDENCE, ALPHA, ECE_BINS = (42, 1337, 2024, 31337, 8191), 10_000, 0.95, 0.05, 10
K_VALUES, NDCG_K, NGRAM = (5, 10, 20), 10, 4
POOL_DEPTH, COLD_FRACTION = 10, 0.10
REGRESSION_TOLERANCE = 0.10
CLAIM_WINDOW, CLAIM_WORDS, CLAIM_OVERLAP = 3, (8, 60), 0.35
CLAUSE_WINDOW, CLAUSE_OVERLAP, CLAUSE_ANSWER_THRESHOLD = 4000, 500, 0.15
SUMMARY_SEGMENT_CHARS = 3000
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
Z_95 = 1.959963984540054
USD_PER_TOKEN, CHARS_PER_TOKEN = 2e-7, 4
