"""Search and vector indexes on disk against the searches without one."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexloom.operators import registry as R, retrieval, search_index
from lexloom.operators.search_index import SearchIndex
from lexloom.operators.vector_index import VectorIndex, k_means


def rows(n=300):
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(1.1)) % 60}" for _ in range(4000)]
    out = [(f"o{i % 3}" if i % 10 else None, i, " ".join(rng.sample(words, rng.randint(1, 30)))) for i in range(n)]
    return out + [("o1", n, ""), ("o1", n + 1, None), ("o2", n + 2, "only here " * 50)]


SCHEMA = "owner string, doc_id long, text string"


def test_posting_lists(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    postings = search_index.inverted(docs.repartition(2), "doc_id", "text", "owner", block=40)
    got = {}
    for r in postings.where("term IS NOT NULL").collect():
        assert r["n"] == len(r["doc_ids"]) <= 40 and r["max_tf"] == max(r["tfs"]) and r["min_dl"] == min(r["dls"]) and r["words"] == sum(r["tfs"])
        for d, tf, dl in zip(r["doc_ids"], r["tfs"], r["dls"], strict=True):
            assert (r["term"], d) not in got
            got[r["term"], d] = (r["owner"], tf, dl)
    want = {(w, d): (o, t.split().count(w), len(t.split())) for o, d, t in rows() if t for w in set(t.split())}
    assert got == want
    sizes = {r["owner"]: (r["n_docs"], r["sum_dl"]) for r in search_index.sides(postings)[1].collect()}
    assert sizes == {o: (sum(1 for x in rows() if x[0] == o), sum(len((x[2] or "").split()) for x in rows() if x[0] == o)) for o in ("o0", "o1", "o2", None)}


def test_search_index_grows(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    asked = spark.createDataFrame([("a", "o1", "w1 w2 w2 w5"), ("b", "o2", "only w1"), ("c", "o1", "nothing"), ("d", "o9", "w1"), ("e", "o0", "")], "query_id string, owner string, q string")
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=4)
    assert index.segments() == 0
    index.add(docs.where("doc_id < 200"), "doc_id", "text", "owner").add(docs.where("doc_id >= 200"), "doc_id", "text", "owner")
    assert index.segments() == 2
    want = sorted(tuple(r) for r in retrieval.bm25(docs, asked, "doc_id", "text", "query_id", "q", 20, "owner").collect())
    got = index.search(asked, "query_id", "q", 20, "owner")
    assert sorted(tuple(r) for r in got.collect()) == want and {r[0] for r in want} == {"a", "b"}
    many = SearchIndex(spark, str(tmp_path / "index"), buckets=4, pushed_terms=1).search(asked, "query_id", "q", 20, "owner")
    assert sorted(tuple(r) for r in many.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "PartitionFilters" in plan and "In(term" in plan.replace("IN(term", "In(term")


def vectors(n=2000, size=16):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, size))
    v = centres[rng.integers(0, 25, n)] + 0.4 * rng.normal(size=(n, size))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_vector_index(spark, tmp_path):
    v = vectors()
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, v array<double>")
    asked = table.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    index = VectorIndex(spark, str(tmp_path / "v")).build(table.unionByName(spark.createDataFrame([(9999, None)], table.schema)), cells=24, sample=500)
    want = {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in retrieval.dense(table, asked, 20).collect()}
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in index.search(asked, 20, probes=2, exact=True).collect()} == want
    near = {(r["query_id"], r["doc_id"]) for r in index.search(asked, 20, probes=8).collect()}
    assert len(near & {x[:2] for x in want}) / len(want) >= 0.9
    assert index.search(asked.where("query_id < 0"), 20).count() == 0


def test_vectors_of_owners(spark, tmp_path):
    v = vectors(300)
    table = spark.createDataFrame([(f"o{i % 2}", i, x.tolist()) for i, x in enumerate(v)], "owner string, doc_id long, v array<double>")
    asked = spark.createDataFrame([("o0", 1, v[0].tolist()), ("o1", 2, v[0].tolist()), ("o7", 3, v[0].tolist())], "owner string, query_id long, q array<double>")
    got = VectorIndex(spark, str(tmp_path / "v")).build(table, cells=6).search(asked, 5, probes=1, exact=True).orderBy("query_id", "rank").collect()
    best = lambda k: sorted(range(k, 300, 2), key=lambda i: (-round(float(v[0] @ v[i]), 6), i))[:5]
    assert [r["doc_id"] for r in got] == best(0) + best(1)
    flat = retrieval.dense_within(table, asked, 5, vector_block=20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in flat] == [(r["query_id"], r["doc_id"]) for r in got]


def test_k_means_does_not_follow_the_order():
    v = vectors(400)
    assert np.allclose(k_means(v, 8), k_means(v[::-1], 8))
    assert len(k_means(v[:3], 8)) == 3


def test_notes_take_names_from_the_registry(spark):
    acts = spark.createDataFrame([("old-1900", "Old", 1900, None, None, "new-2000", "OLDACT"), ("new-2000", "New", 2000, None, None, None, "NEWACT")], R.STATUTE_SCHEMA)
    acts = acts.withColumn("in_force_from", F.lit("1900-01-01").cast("date")).withColumn("repealed_on", F.when(F.col("statute_id") == "old-1900", F.lit("2000-01-01").cast("date")))
    sections = spark.createDataFrame([("old-1900-s5", "old-1900", "s", "5", None, None, None, "in_force"), ("new-2000-s7", "new-2000", "s", "7", None, None, None, "in_force")], R.SECTION_SCHEMA)
    after = spark.createDataFrame([("old-1900-s5", "new-2000-s7", "old-1900", "new-2000", None, "maps_to"), ("old-1900-s5", "gone-3-s9", "old-1900", "gone-3", None, "maps_to")], R.SUPERSESSION_SCHEMA)
    asked = spark.createDataFrame([("section", "old-1900-s5"), ("statute", "old-1900"), ("section", "none")], "target_type string, target_id string").withColumn("day", F.lit("2020-01-01").cast("date"))
    got = {r["target_id"]: (r["status"], r["note"]) for r in R.check(asked, "day", sections, acts, after).collect()}
    assert got == {"old-1900-s5": ("superseded", "repealed 2000-01-01; see gone-3 9 / NEWACT 7"), "old-1900": ("superseded", "repealed 2000-01-01; see NEWACT"), "none": ("not_found", "none not in registry")}


def test_pool_statistics(spark):
    rows = [("q1", 1, ["a", "b"]), ("q1", 2, ["a"]), ("q2", 1, ["b"])]
    schema = "query_id string, doc_id long, found_by array<string>"
    got = retrieval.pool_statistics(spark.createDataFrame(rows, schema)).first()
    assert tuple(got)[:6] == (2, 3, 1, 2, 1.5, 2) and [tuple(c) for c in got["contribution"]] == [("a", 2), ("b", 2)]
    none = retrieval.pool_statistics(spark.createDataFrame([], schema)).first()
    assert tuple(none) == (0, 0, None, None, None, 0, [])
