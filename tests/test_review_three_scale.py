"""What the third review found about growth, each on a few rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexloom.operators import chunking, corpus, retrieval, search_index
from lexloom.plans import catalog
from lexloom.sources.scratch import Scratch


def test_only_sets_of_candidates_are_written(spark, monkeypatch):
    """Shingle sets of documents that cannot have a near copy are neither written nor moved, and the tables go at the end."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(60)) for _ in range(50)]
    texts += [texts[7] + " tail", texts[9]]
    saved = {}
    save = Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        saved[name] = (out.count(), set(out.columns), self.base)
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for pairs in (corpus.near_duplicate_pairs, corpus.minhash_pairs):
        saved.clear()
        assert {(r["a"], r["b"], r["jaccard"]) for r in pairs(docs, "doc_id", "text").collect()} == {(7, 50, round(56 / 57, 6)), (9, 51, 1.0)}
        assert saved["nodes"][0] == 51 and saved["sets"][0] == 2 and [n for n, x in saved.items() if "s" in x[1]] == ["sets"]
        jvm = spark._jvm
        assert not jvm.java.io.File(saved["sets"][2].removeprefix("file:")).exists()


def test_keys_of_one_node_are_left_behind(spark):
    """Rows whose key no other row has are gone before the nodes of a key are dealt and meet."""
    rows = spark.range(1000).select(F.col("id").alias("node"), F.when(F.col("id") < 3, 0).otherwise(F.col("id")).alias("h"))
    met = corpus.blocked_pairs(rows, "h", "node")
    assert sorted(tuple(r) for r in met.collect()) == [(0, 1), (0, 2), (1, 2)]
    assert "LeftOuter" not in met._jdf.queryExecution().optimizedPlan().toString()


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clauses_are_found_once(spark):
    """Clauses and slices of a text come from one pass over its boundaries, and no filter repeats it."""
    text = "Preamble \U0001f600\nSection 1. " + "ab \U0001f600 " * 200 + "\n(2) WHEREAS short\n\f\nClause 4A. end"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n ")], "doc_id long, text string").repartition(2)
    chunks = chunking.clause_chunks(docs, "doc_id", "text")
    assert _plan(chunks).count("regexp_replace(__t") == 1 and "Union" not in _plan(chunks)
    rows = chunks.collect()
    assert {r["doc_id"] for r in rows} == {1}
    for r in rows:
        assert text[r["char_start"] : r["char_end"]] == r["chunk_text"]
    slices = [r for r in rows if r["parent_chunk_id"]]
    assert [r["chunk_id"] for r in slices] == [f"ch-1-2-{i}" for i in range(len(slices))] and all(r["bm25_indexed"] and r["parent_chunk_id"] == "ch-1-2" for r in slices)
    whole = {r["chunk_id"]: r for r in rows if not r["parent_chunk_id"]}
    assert sorted(whole) == ["ch-1-1", "ch-1-2", "ch-1-3", "ch-1-4"] and [whole[f"ch-1-{i}"]["bm25_indexed"] for i in range(1, 5)] == [True, False, True, True]
    assert "".join(r["chunk_text"] for r in slices) == whole["ch-1-2"]["chunk_text"] and [whole[f"ch-1-{i}"]["page_no"] for i in range(1, 5)] == [1, 1, 1, 2]


def test_blocks_of_postings_span_batches(spark, monkeypatch):
    """A block ends with its documents or words, not with a batch to Python, so a term's list is not cut into many short rows."""
    docs = spark.range(100).repartition(1).selectExpr("id AS doc_id", "'same words' AS text")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        got = search_index.inverted(docs, "doc_id", "text", block=60).where("term = 'same'").select("n").collect()
        assert sorted(r[0] for r in got) == [40, 60]
        monkeypatch.setattr(search_index, "BLOCK_WORDS", 30)
        assert [r[0] for r in search_index.inverted(docs, "doc_id", "text", block=60).where("term = 'same'").select("n").collect()] == [20] * 5
    finally:
        spark.conf.set(key, old)


def test_postings_do_not_move_to_be_written(spark, tmp_path, monkeypatch):
    """An index is written by the tasks that invert its documents."""
    from pyspark.sql import DataFrame

    dealt = []
    real = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, *a: dealt.append(a) or real(self, *a))
    docs = spark.createDataFrame([(i, f"w{i % 7} all") for i in range(50)], "doc_id long, text string")
    index = search_index.SearchIndex(spark, str(tmp_path / "i"), buckets=4).add(docs, "doc_id", "text")
    assert not dealt
    asked = spark.createDataFrame([("q", "w3 all all")], "q string, t string")
    assert [(r["doc_id"], r["rank"]) for r in index.search(asked, "q", "t", 3).orderBy("rank").collect()] == [(3, 1), (10, 2), (17, 3)]
    assert isinstance(docs, DataFrame)


def test_claims_of_one_file_are_dealt(spark, tmp_path):
    spark.range(64).selectExpr("id AS p_partkey", "int(id % 50) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert "RoundRobinPartitioning(16)" in catalog.QUERIES["perturb_claims"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_stems_are_made_once(spark, tmp_path):
    """ROUGE reads stems that were written; its plan has the one Python step of the common subsequence."""
    rows = [(1, t, "user", x) for t, x in enumerate(["the running dogs", "a dog runs", "dogs ran"])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.QUERIES["rouge_stemmed"](spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1 and got.count() == 2


def test_scores_held_are_bounded():
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(100, 8)), rng.normal(size=(1 << 16, 8))
    parts = list(retrieval._products(q, v))
    assert max(s.size for _, s in parts) <= retrieval.SCORES_HELD and [a for a, _ in parts] == list(range(0, 100, 32))
    assert np.allclose(np.concatenate([s for _, s in parts]), np.round(q @ v.T, 6), atol=1.1e-6)
