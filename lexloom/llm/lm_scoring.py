"""Language-model scores: the marginal likelihood of a text over all segmentations into subwords.

The vocabulary file at hand is a byte-pair one: its scores are ranks, not log-probabilities. So they enter
as a prior that falls with the rank, with a small share, mixed with the pieces' frequencies in the training
words. A word's probability sums over all paths through the lattice of its pieces (bytes stand for
characters that the vocabulary lacks), by a forward recursion in log space; a whole word that
training has seen is one more arc, weighted by its count, with Good-Turing mass left to the rest. So known words
score mostly by their own counts and the lattice speaks for the others.
A text is its words and one end token, each drawn independently, so the probabilities of all texts
add up to at most one.

Word counts cover every training text. The head_words most frequent at most, a fixed bound, are
shared with all workers as a sorted hash array; the other words of a text meet their counts in a
shuffle join, so nothing that grows with the vocabulary is broadcast or collected.

Edge cases: a null text is an empty one and has the end token only. Without training rows all counts
are zero and the end has probability one half. Repeated rows and equal ids are scored one by one. An
empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, documents, held_out, share

PRIME = 0x100000001B3
MASK = 0xFFFFFFFFFFFFFFFF
LN10 = math.log(10)
MARK = "▁"  # stands for the start of a word in the vocabulary
CACHE_WORDS = 300_000
FLUSH_WORDS = 250_000
#: Words of as many texts as are looked up together.
CHUNK_WORDS = 200_000
#: Characters whose arcs are held at once; longer words are read in blocks of so many.
BLOCK_CHARS = 1 << 17
#: The vocabulary's path where neither a parameter nor the setting spark.lexloom.vocabulary names one.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (UTF-8) and c; tasks add up their own words before the exchange, in bounded batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                held.update(words_of(t.as_py()))
                if len(held) > FLUSH_WORDS:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(counts: DataFrame, vocabulary: bytes) -> dict[int, int]:
    """How often each piece occurs when the vocabulary's own tokenizer cuts the training words, each distinct word once.

    The lattice speaks for words that training has not seen, and those resemble the distinct words more than the
    running text. One row per piece is collected; the vocabulary bounds it.
    """
    tokenizer = share(counts.sparkSession, {"model": vocabulary})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tokenizer()
        if "processor" not in held:
            import sentencepiece

            held["processor"] = sentencepiece.SentencePieceProcessor(model_proto=held["model"])
        total = np.zeros(held["processor"].get_piece_size(), np.int64)
        for batch in batches:
            words = [w.as_py().decode("utf-8", "replace") for w in batch.column(0)]
            ids = held["processor"].encode(words)
            total += np.bincount(np.fromiter((i for x in ids for i in x), np.int64), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["piece", "c"])

    rows = counts.select("word").mapInArrow(run, "piece long, c long").groupBy("piece").agg(F.sum("c").alias("c")).collect()
    return {r["piece"]: r["c"] for r in rows}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Lattice:
    """Natural log-probability of words under all their segmentations."""

    def __init__(self, pieces: dict[str, float], byte_pieces: list[float], block: int = BLOCK_CHARS):
        self.byte_pieces, self.block = byte_pieces, block
        by_length: dict[int, list[tuple[int, float]]] = {}
        for piece, p in pieces.items():
            h = 0
            for ch in piece:
                h = (h * PRIME + ord(ch)) & MASK
            by_length.setdefault(len(piece), []).append((h, p))
        self.longest = max(by_length, default=1)
        self.tables = {}
        for n, rows in by_length.items():
            rows.sort()
            self.tables[n] = (np.array([h for h, _ in rows], np.uint64), np.array([p for _, p in rows]))

    def arcs(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """arcs[k - 1, i]: log-probability of the piece of k characters that ends at i; at: place in the word."""
        out = np.full((self.longest, len(codes)), -np.inf)
        h, power = np.zeros(len(codes), np.uint64), 1
        for k in range(1, self.longest + 1):
            if k > len(codes):
                break
            moved = np.zeros(len(codes), np.uint64)
            moved[k - 1 :] = codes[: len(codes) - k + 1]
            h = h + moved * np.uint64(power)
            power = power * PRIME & MASK
            if k in self.tables:
                keys, p = self.tables[k]
                fit = np.flatnonzero(at >= k - 1)
                pos = np.minimum(np.searchsorted(keys, h[fit]), len(keys) - 1)
                hit = keys[pos] == h[fit]
                out[k - 1, fit[hit]] = p[pos[hit]]
        lost = np.flatnonzero(np.isneginf(out[0]))
        if len(lost):
            kinds, which = np.unique(codes[lost], return_inverse=True)
            out[0, lost] = np.array([sum(self.byte_pieces[b] for b in chr(int(c)).encode("utf-8", "surrogatepass")) for c in kinds])[which]
        return out

    def log_probability(self, words: list[str]) -> np.ndarray:
        result = np.zeros(len(words))
        if not words:
            return result
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        a = 0
        while a < len(order):
            if len(words[order[a]]) >= self.block:
                result[order[a]] = self.long_word(MARK + words[order[a]])
                a += 1
                continue
            part, total = [], 0
            while a < len(order) and len(part) < 4096 and total + len(words[order[a]]) < self.block:
                part.append(order[a])
                total += len(words[order[a]]) + 1
                a += 1
            texts = [MARK + words[i] for i in part]
            codes = _codes("".join(texts))
            length = np.array([len(x) for x in texts])
            first = np.cumsum(length) - length
            arcs = self.arcs(codes, np.arange(len(codes)) - np.repeat(first, length))
            # words fall in length, so those still open at step j are a prefix
            alpha = np.full((len(part), self.longest + 1), -np.inf)  # a ring of the last places
            alpha[:, 0] = 0.0
            for j in range(1, int(length[0]) + 1):
                live = int(np.searchsorted(-length, -j, side="right"))
                here = first[:live] + j - 1
                ways = np.stack([alpha[:live, (j - k) % (self.longest + 1)] + arcs[k - 1, here] for k in range(1, min(self.longest, j) + 1)])
                top = ways.max(axis=0)
                alpha[:live, j % (self.longest + 1)] = top + np.log(np.exp(ways - top).sum(axis=0))
                done = length[:live] == j
                if done.any():
                    result[np.array(part)[:live][done]] = alpha[:live, j % (self.longest + 1)][done]
        return result

    def long_word(self, text: str) -> float:
        """The same for one word of any length, whose arcs are made block by block."""
        recent = [0.0]  # of the last places, the latest at the end
        for at in range(0, len(text), self.block):
            start = max(0, at - self.longest + 1)
            codes = _codes(text[start : at + self.block])
            arcs = self.arcs(codes, np.arange(start, start + len(codes)))
            for i in range(at - start, len(codes)):
                ways = np.array(recent[::-1]) + arcs[: len(recent), i]
                top = ways.max()
                recent.append(float(top + np.log(np.exp(ways - top).sum())))
                if len(recent) > self.longest:
                    del recent[0]
        return recent[-1]


def load_lattice(path: str, seen: dict[int, int], prior_share: float = 0.01) -> Lattice:
    """Weights for all pieces of the vocabulary file: frequency mixed with a prior of 1 / (rank + 10)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    usable = [i for i in range(n) if not model.is_control(i) and not model.is_unknown(i)]
    score = {i: 0.0 if model.is_byte(i) else -model.get_score(i) for i in usable}
    worst = max(score.values(), default=0.0)
    prior = {i: 1.0 / ((worst if model.is_byte(i) else score[i]) + 10.0) for i in usable}
    all_prior, all_seen = sum(prior.values()), sum(seen.get(i, 0) for i in usable)
    mix = prior_share if all_seen else 1.0
    weight = {i: math.log(mix * prior[i] / all_prior + (1 - mix) * (seen.get(i, 0) / all_seen if all_seen else 0.0)) for i in usable}
    byte_pieces = [weight[model.piece_to_id(f"<0x{b:02X}>")] for b in range(256)]
    return Lattice({model.id_to_piece(i): weight[i] for i in usable if not model.is_byte(i)}, byte_pieces)


class Scorer:
    """Scores of words whose counts are in the head; for all others the lattice's part only."""

    def __init__(self, lattice: Lattice, head: np.ndarray, head_counts: np.ndarray, head_subs: np.ndarray, facts: dict[str, float]):
        at = np.argsort(head)
        self.lattice, self.facts = lattice, facts
        self.head, self.head_counts, self.head_subs = head[at], head_counts[at], head_subs[at]
        self.cache: dict[bytes, int] = {}
        self.names: list[bytes] = []  # the cache's words in order
        self.values = np.zeros((0, 3))

    def learn(self, new: list[bytes]) -> None:
        h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in new), np.uint64, len(new))
        c, sub, hit = np.zeros(len(new)), np.zeros(len(new)), np.zeros(len(new), bool)
        if len(self.head):
            pos = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
            hit = self.head[pos] == h
            c[hit], sub[hit] = self.head_counts[pos[hit]], self.head_subs[pos[hit]]
        sub[~hit] = self.lattice.log_probability([w.decode("utf-8", "surrogatepass") for w, known in zip(new, hit) if not known]) / LN10
        rows = np.stack([c, base_of(c, self.facts), np.where(c > 0, model_of(c, sub, self.facts), sub)], axis=1)
        used = len(self.cache)
        if len(self.values) < used + len(new):
            grown = np.zeros((max(2 * len(self.values), used + len(new), 4096), 3))
            grown[:used] = self.values[:used]
            self.values = grown
        self.values[used : used + len(new)] = rows
        self.cache.update(zip(new, range(used, used + len(new))))
        self.names += new

    def score(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, list[dict[str, Any]]]]:
        """For each text: words, known head words, their base and model scores, and the other words with count and lattice score.

        New words are looked up for many texts at once; a text is never cut.
        """
        at = 0
        while at < len(texts):
            lists: list[list[bytes]] = []
            total = 0
            while at < len(texts) and total < CHUNK_WORDS:
                lists.append(words_of(texts[at]))
                total, at = total + len(lists[-1]), at + 1
            if len(self.cache) > CACHE_WORDS:
                self.cache, self.names, self.values = {}, [], np.zeros((0, 3))
            new = list({w for words in lists for w in words}.difference(self.cache))
            if new:
                self.learn(new)
            for words in lists:
                ids = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
                got = self.values[ids]
                in_head = got[:, 0] > 0
                sums = got[in_head].sum(axis=0)
                tail = Counter(ids[~in_head].tolist())
                yield len(words), int(in_head.sum()), float(sums[1]), float(sums[2]), [{"word": self.names[i], "n": n, "sub": float(self.values[i, 2])} for i, n in tail.items()]


def base_of(c: np.ndarray, facts: dict[str, float]) -> np.ndarray:
    return np.log10((c + 1) / (facts["n"] + 1 * (facts["v"] + 1)))


def model_of(c: np.ndarray, sub: np.ndarray, facts: dict[str, float]) -> np.ndarray:
    """log10 of (1 - p_end) * (known * c / words + (1 - known) * 10 ** sub), where c > 0."""
    whole = math.log10(facts["known"]) + np.log10(np.maximum(c, 1)) - math.log10(facts["words"]) if facts["known"] > 0 else np.full(len(c), -np.inf)
    rest = math.log10(1 - facts["known"]) + sub
    top = np.maximum(whole, rest)
    return math.log10(1 - facts["end"]) + top + np.log10(10 ** (whole - top) + 10 ** (rest - top))


def score_texts(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, head_words: int = 1 << 19, word_arcs: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    training: which rows are learned from. vocabulary: path of a SentencePiece model on the driver, else what
    spark.lexloom.vocabulary says, else VOCABULARY. word_arcs: whether whole words that training has seen are arcs too;
    without them the pieces alone speak.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or spark.conf.get("spark.lexloom.vocabulary", VOCABULARY)
    if not os.path.isfile(vocabulary):
        raise FileNotFoundError(f"no vocabulary at {vocabulary}: name a SentencePiece model by the parameter or by spark.lexloom.vocabulary")
    scratch = Scratch(spark, "lm")
    learned = docs.where(training)
    counts = scratch.save(count_words(learned, text), "counts")
    ends = learned.count()
    facts_row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("words"), F.count("*").alias("kinds"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    words, once = facts_row["words"], facts_row["once"]
    n = words + ends
    known = min(1 - 1e-6, max(0.0, 1 - (once + 1) / (words + 1))) if words and word_arcs else 0.0
    facts = {"words": float(words), "n": float(n), "v": float(facts_row["kinds"] + (1 if ends else 0)), "end": (ends + 0.5) / (n + 1), "known": known}

    # the head: whole classes of counts, eight to an octave, as many as stay under the bound
    octave = F.floor(F.log2("c") * 8).cast("int")
    classes = {r["o"]: r["count"] for r in counts.groupBy(octave.alias("o")).count().collect()}  # under 520 rows
    least, total = max(classes, default=0) + 1, 0
    for o in sorted(classes, reverse=True):
        if total + classes[o] > head_words:
            break
        least, total = o, total + classes[o]
    counts = counts.withColumn("in_head", octave >= least)
    with open(vocabulary, "rb") as f:
        seen = piece_counts(counts, f.read())
    lattice = load_lattice(vocabulary, seen)
    shared_lattice = share(spark, lattice)

    def subwords(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sub = shared_lattice().log_probability([w.as_py().decode("utf-8", "surrogatepass") for w in batch.column(0)]) / LN10
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(sub)], ["h", "c", "sub"])

    # at most head_words rows; F.xxhash64 of a binary is XXH64 with seed 42
    head = counts.where("in_head").select("word", F.xxhash64("word").alias("h"), "c").mapInArrow(subwords, "h long, c long, sub double").toArrow()
    scorer = share(spark, Scorer(lattice, *[head.column(x).to_numpy() if x != "h" else head.column(x).to_numpy().view(np.uint64) for x in ("h", "c", "sub")], facts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32()), ("sub", pa.float64())]))
        for batch in batches:
            rows = list(scorer().score(batch.column(1).to_pylist()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), tail))]], ["doc_id", "n_words", "known", "base", "model", "tail"])

    schema = "doc_id long, n_words long, known long, base double, model double, tail array<struct<word: binary, n: int, sub: double>>"
    found = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    found = scratch.save(found.withColumn("row", F.monotonically_increasing_id()), "found")

    def lit(x: float) -> Column:
        return F.lit(float(x))

    rare = found.select("row", F.inline("tail")).join(counts.where("NOT in_head").select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0)).cast("double")
    whole = F.when(c > 0, lit(math.log10(known)) + F.log10(c) - lit(math.log10(max(words, 1)))) if known > 0 else F.lit(None).cast("double")
    rest = lit(math.log10(1 - known)) + F.col("sub")
    top = F.greatest(whole, rest)  # skips null
    one = top + F.log10(F.coalesce(F.pow(lit(10), whole - top), lit(0)) + F.pow(lit(10), rest - top)) + lit(math.log10(1 - facts["end"]))
    base = F.log10((c + 1) / lit(n + facts["v"] + 1))
    sums = rare.groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"), F.sum(F.col("n") * base).alias("tail_base"), F.sum(F.col("n") * one).alias("tail_model"))
    joined = found.drop("tail").join(sums, "row", "left")
    zero = F.lit(0)
    return joined.select(
        "doc_id",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("tail_known", zero) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", lit(0)) + lit(math.log10((ends + 1) / (n + facts["v"] + 1)))).alias("base_score"),
        (F.col("model") + F.coalesce("tail_model", lit(0)) + lit(math.log10(facts["end"]))).alias("score"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_texts(docs, ~held_out(F.col("doc_id"), 7, 2))
    return scored.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
