"""Ranking: BM25, dense vectors, rank fusion and pooling, always within a scope."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import config
from lexloom.functions import text as T
from lexloom.operators import search_index
from lexloom.sources.scratch import Scratch


def scoped(df: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys (document and owner) are in scope, before anything ranks them.

    Spark broadcasts the scope if it is small and shuffles both sides if it is not.
    """
    return df.join(scope.select(*keys).distinct(), keys, "left_semi")


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query: str, k: int = config.RETRIEVE_TOP_K, owner: str | None = None) -> DataFrame:
    """Okapi BM25: query_id, doc_id, score (6 decimals), rank; ties by doc_id.

    With an owner column on both sides a query sees its owner's documents only, statistics included. The texts are read
    once into posting lists in the checkpoint folder, of which statistics and scores read their own columns; `search_index.SearchIndex` keeps
    such lists for further batches of queries.
    """
    postings = Scratch(docs.sparkSession, "bm25").save(search_index.inverted(docs, doc_id, text, owner), "postings")
    return search_index.score(postings, *search_index.sides(postings), queries, query_id, query, k, owner)


def top_k(scored: DataFrame, query: str, k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Scores that a task holds at once.
SCORES_HELD = 1 << 21


def _products(q: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The place of some queries and their scores (6 decimals) with all vectors of a block, a few queries at once."""
    n = max(1, SCORES_HELD // max(1, len(v)))
    for at in range(0, len(q), n):
        scores = q[at : at + n] @ v.T
        yield at, np.round(scores, 6, out=scores)


def dense(vectors: DataFrame, queries: DataFrame, k: int = config.RETRIEVE_TOP_K, query_block: int = 4096, vector_block: int = 65536) -> DataFrame:
    """Flat inner-product search of a stated query set: query_id, doc_id, score (6 decimals), rank; ties by doc_id.

    vectors: (doc_id, v); queries: (query_id, q). Both are dealt into blocks of bounded size; each pair of blocks is one
    task's matrix product, of which only the best k for each query go on.
    """
    n_vectors, n_queries = vectors.count(), queries.count()
    across, down = max(1, -(-n_queries // query_block)), max(1, -(-n_vectors // vector_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = vectors.select("doc_id", "v", F.pmod(F.xxhash64("doc_id"), F.lit(down)).cast("int").alias("row")).withColumn("col", every(across))
    b = queries.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(across)).cast("int").alias("col")).withColumn("row", every(down))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            matrix = lambda t, c: np.array(t[c].combine_chunks().values, np.float64).reshape(t.num_rows, -1)
            ids, q_ids, q = left["doc_id"].to_numpy(), right["query_id"].to_numpy(), matrix(right, "q")
            v = matrix(left, "v")
            for at, scores in _products(q, v):
                for i, row in enumerate(scores):
                    cut = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                    best = cut[np.lexsort((ids[cut], -row[cut]))[:k]]
                    out.append((np.full(len(best), q_ids[at + i]), ids[best], row[best]))
        cols = [np.concatenate(x) if x else np.array([]) for x in (zip(*out) if out else ((), (), ()))]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "doc_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = a.groupBy("row", "col").cogroup(b.groupBy("row", "col")).applyInArrow(run, "query_id long, doc_id long, score double")
    return top_k(found, "query_id", k)


def _nullable(kind: pa.DataType) -> pa.DataType:
    return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind]) if pa.types.is_struct(kind) else kind


def dense_within(vectors: DataFrame, queries: DataFrame, k: int = config.RETRIEVE_TOP_K, vector_block: int = 65536) -> DataFrame:
    """Flat inner-product search within owners: query_id, doc_id, score (6 decimals), rank; ties by doc_id.

    vectors: (owner, doc_id, v) with doc_id of any type that sorts; queries: (owner, query_id, q). An owner's vectors are dealt into
    blocks of bounded size, each with the owner's queries one task's matrix product; only the best k of a block go on.
    """
    sizes = vectors.groupBy("owner").agg(F.ceil(F.count("*") / vector_block).cast("int").alias("blocks"))
    a = vectors.join(sizes, "owner").select("owner", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), "doc_id", "v")
    b = queries.join(sizes, "owner").select("owner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", "q")
    kinds = {c: vectors.schema["doc_id"].dataType.simpleString() if c == "doc_id" else queries.schema["query_id"].dataType.simpleString() for c in ("query_id", "doc_id")}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", _nullable(right.schema.field("query_id").type)), ("doc_id", _nullable(left.schema.field("doc_id").type)), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        matrix = lambda t, c: np.array(t[c].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
        v, q, rows, of, scores = matrix(left, "v"), matrix(right, "q"), [], [], []
        for at, scores_at in _products(q, v):
            for i, row in enumerate(scores_at):
                # all that tie with the k-th: the final rank settles them by id
                best = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                rows.append(best)
                of.append(np.full(len(best), at + i))
                scores.append(row[best])
        take = lambda t, c, x: t[c].combine_chunks().take(pa.array(np.concatenate(x)))
        ids = [x.cast(f.type) for x, f in zip((take(right, "query_id", of), take(left, "doc_id", rows)), schema, strict=False)]
        return pa.table([*ids, pa.array(np.concatenate(scores))], schema=schema)

    found = a.groupBy("owner", "block").cogroup(b.groupBy("owner", "block")).applyInArrow(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")
    return top_k(found, "query_id", k)


def fuse(runs: DataFrame, k: int = config.RETRIEVE_TOP_K, c: int = config.RRF_K) -> DataFrame:
    """Reciprocal rank fusion with ranks from 0: runs (query_id, method, doc_id, rank from 1)."""
    scored = runs.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (c + F.col("rank") - 1)), 9).alias("score"))
    return top_k(scored, "query_id", k)


def pool(runs: DataFrame, depth: int = config.POOL_DEPTH, c: int = config.RRF_K, most: int | None = None) -> DataFrame:
    """Judgment pool with ranks from 1: score, best_rank, the methods that found each document, and its place; at most `most` of each query."""
    near = runs.where(F.col("rank") <= depth)
    scored = near.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best_rank"), F.array_sort(F.collect_set("method")).alias("found_by")
    )
    placed = scored.withColumn("pooled_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return placed.where(F.col("pooled_rank") <= most) if most else placed


def pool_statistics(pooled: DataFrame) -> DataFrame:
    """One row about the pools of pool(): n_queries, n_judgments, min_pool, max_pool, mean_pool (2 decimals, null without a query), n_documents, and
    contribution, how many judgments each method found, by name."""
    sizes = pooled.groupBy("query_id").agg(F.count("*").alias("n"))
    about = sizes.agg(F.count("*").alias("n_queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_judgments"), F.min("n").alias("min_pool"), F.max("n").alias("max_pool"), F.round(F.avg("n"), 2).alias("mean_pool"))
    methods = pooled.select(F.explode("found_by").alias("method")).groupBy("method").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("method", "n"))).alias("contribution"))
    return about.crossJoin(pooled.agg(F.count_distinct("doc_id").alias("n_documents"))).crossJoin(methods)  # one row each


def rerank(candidates: DataFrame, scores: Column, k: int = config.RERANK_TOP_K, floor: float | None = None) -> DataFrame:
    """The best k of each query's candidates by a reranker's score; equal scores keep the order of the candidates' rank."""
    scored = candidates.withColumn("rerank_score", scores)
    if floor is not None:
        scored = scored.where(F.col("rerank_score") >= floor)
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= k)


def letter_vector(text: Column, letters: str = "aeinrst") -> Column:
    """A stand-in for an encoder: how often each letter occurs, at unit length; a text with none of them has a zero vector."""
    low = F.lower(text)
    counts = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in letters])
    return T.let(counts, lambda v: T.let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def hybrid(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query: str, owner: str, encoder=letter_vector, k: int = config.RETRIEVE_TOP_K) -> DataFrame:
    """BM25 and dense search of each query within its owner's documents, fused by reciprocal rank: query_id, doc_id, score, rank.

    Vectors meet by the owner, so nothing outside the scope is ever scored; encoder: text column to unit vector column.
    """
    sparse = bm25(docs, queries, doc_id, text, query_id, query, k, owner).select("query_id", F.lit("sparse").alias("method"), "doc_id", "rank")
    v = docs.select(F.col(owner).alias("owner"), F.col(doc_id).alias("doc_id"), encoder(F.col(text)).alias("v"))
    q = queries.select(F.col(owner).alias("owner"), F.col(query_id).alias("query_id"), encoder(F.col(query)).alias("q"))
    near = dense_within(v, q, k).select("query_id", F.lit("dense").alias("method"), "doc_id", "rank")
    return fuse(sparse.unionByName(near), k)
