"""An inverted file of vectors as Parquet tables: k-means cells as partitions, probes as partition filters, exact scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom import config
from lexloom.operators.retrieval import dense_within, dot, top_k


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector, the first of equals."""
    out = np.zeros(len(v), np.int32)
    for i in range(0, len(v), 4096):
        out[i : i + 4096] = np.argmin((centres * centres).sum(1) - 2 * v[i : i + 4096] @ centres.T, axis=1)
    return out


def k_means(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """At most `cells` centres; the same for the same vectors in any order. An empty cell keeps its centre."""
    sample = sample[np.lexsort(sample.T[::-1])]
    centres = sample[np.sort(np.random.default_rng(seed).choice(len(sample), min(cells, len(sample)), replace=False))]
    for _ in range(rounds):
        own = nearest(sample, centres)
        centres = np.stack([sample[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return centres


class VectorIndex:
    """Vectors by cell in a folder, for searches by inner product.

    The centres are fitted on at most `sample` vectors, taken by a hash of the id; every vector stands in the cell of its
    nearest centre. cells/ holds each cell's centre, its number of vectors and their largest distance from the centre, the
    radius, which bounds inner products: q . v <= q . c + |q| * radius. search() reads the best cells of each query only;
    with exact it then reads those too whose bound reaches the k-th best score found, so that nothing is missed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, cells: int = 64, sample: int = 20_000) -> VectorIndex:
        """Write the index of (doc_id, v) or, to search within owners, (owner, doc_id, v). Null vectors are left out."""
        rows = vectors.select(*[c for c in ("owner", "doc_id") if c in vectors.columns], F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL")
        share = min(1.0, sample / max(rows.count(), 1))
        taken = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(sample).select("v").toArrow()["v"].combine_chunks()
        centres = k_means(np.asarray(taken.flatten(), np.float64).reshape(len(taken), -1), cells) if len(taken) else np.zeros((1, 1))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = np.asarray(b.column(b.num_columns - 1).flatten(), np.float64).reshape(b.num_rows, -1)
                own = nearest(v, centres) if b.num_rows else np.zeros(0, np.int32)
                far = np.sqrt(((v - centres[own]) ** 2).sum(1)) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(far)], [*b.schema.names, "cell", "far"])

        placed = rows.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell int, far double")
        # a cell with very many vectors is written by several tasks
        placed.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(4))).write.partitionBy("cell").parquet(f"{self.path}/vectors")
        centre = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        sizes = self._vectors().groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
        sizes.join(centre, "cell").write.parquet(f"{self.path}/cells")
        return self

    def _vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int = config.RETRIEVE_TOP_K, probes: int = 8, exact: bool = False) -> DataFrame:
        """query_id, doc_id, score (6 decimals), rank of a stated set of queries (query_id, q), or (owner, query_id, q) within owners; ties by doc_id."""
        own = ["owner"] if "owner" in queries.columns else []
        q = queries.select(*own, "query_id", F.col("q").cast("array<double>").alias("q"))
        size = F.sqrt(dot(F.col("q"), F.col("q")))
        # queries by cells: as many cells as build() was asked for
        met = q.crossJoin(self.spark.read.parquet(f"{self.path}/cells")).select("query_id", "cell", dot(F.col("q"), F.col("centre")).alias("mid"), (size * F.col("radius")).alias("slack"))
        placed = met.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("mid"), "cell"))).checkpoint()
        found = self._read(q, placed, F.col("place") <= probes, own, k)
        if exact:
            found = found.checkpoint()
            worst = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
            left = placed.join(worst, "query_id", "left")
            reaches = F.col("worst").isNull() | (F.col("mid") + F.col("slack") >= F.col("worst") - 1e-5)
            found = found.drop("rank").unionByName(self._read(q, left, (F.col("place") > probes) & reaches, own, k).drop("rank"))
            found = top_k(found, "query_id", k)
        return found

    def _read(self, queries: DataFrame, placed: DataFrame, which: Column, own: list[str], k: int) -> DataFrame:
        """The best k of each query in the cells of its rows of placed; a cell, or an owner's part of it, is what dense_within calls an owner."""
        probes = placed.where(which).select("query_id", "cell")
        cells = [r[0] for r in probes.select("cell").distinct().collect()]  # no more than there are cells
        room = F.struct("cell", *own).alias("owner")
        vectors = self._vectors().where(F.col("cell").isin(cells)).select(room, "doc_id", "v")
        return dense_within(vectors, queries.join(probes, "query_id").select(room, "query_id", "q"), k)
