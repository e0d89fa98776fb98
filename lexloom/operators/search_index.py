"""An inverted index for BM25 as Parquet tables: posting lists in blocks of documents, and what their scores need beside them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom import config
from lexloom.functions import text as T
from lexloom.sources.scratch import Scratch

#: Documents of one block of a posting list.
BLOCK_DOCS = 4096
#: Words at which a block ends before that, which bounds what a task holds.
BLOCK_WORDS = 1 << 21


def inverted(docs: DataFrame, doc_id: str, text: str, owner: str | None = None, block: int = BLOCK_DOCS) -> DataFrame:
    """owner, term, n, words, max_tf, min_dl, doc_ids, tfs, dls, block: the postings of each term in each block of documents.

    A task inverts its own documents, `block` at once over the bounds of batches (fewer if their words are very many), so no
    word is shuffled and a term of every document has as many lists as there are blocks. max_tf and min_dl bound what a block can score. One row with the null term
    for each owner of a block has the number of its documents in n and of their words in words.
    """
    own = F.col(owner) if owner else F.lit(0)
    rows = docs.select(own.alias("owner"), F.col(doc_id).alias("doc_id"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))

    def one(owners: pa.Array, ids: pa.Array, lists: pa.Array) -> pa.RecordBatch:
        dl = pc.list_value_length(lists).to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        own = owners.dictionary_encode(null_encoding="encode")
        own_at, size = own.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
        # one number for (owner, term, document); equal ones are counted
        row = np.repeat(np.arange(len(dl)), dl)
        key, tf = np.unique((own_at[row] * size + words.indices.to_numpy()) * block + row, return_counts=True)
        row, key = key % block, key // block
        first = np.flatnonzero(np.diff(key, prepend=-1))
        end = np.append(first[1:], len(key))[: len(first)]
        lengths, tf = dl[row].astype(np.int32), tf.astype(np.int32)
        over = lambda f, x: f.reduceat(x, first) if len(first) else x  # noqa: B023, E731
        n_owners = len(own.dictionary)
        columns = [
            pa.concat_arrays([own.dictionary.take(pa.array(key[first] // size)), own.dictionary]),
            pa.concat_arrays([words.dictionary.take(pa.array(key[first] % size)).cast(pa.string()), pa.nulls(n_owners, pa.string())]),
            pa.array(np.concatenate([end - first, np.bincount(own_at, minlength=n_owners)]).astype(np.int64)),
            pa.array(np.concatenate([over(np.add, tf.astype(np.int64)), np.bincount(own_at, dl, n_owners)]).astype(np.int64)),
            pa.concat_arrays([pa.array(over(np.maximum, tf)), pa.nulls(n_owners, pa.int32())]),
            pa.concat_arrays([pa.array(over(np.minimum, lengths)), pa.nulls(n_owners, pa.int32())]),
            *[pa.ListArray.from_arrays(pa.array(np.concatenate([first, np.full(n_owners + 1, len(key))]).astype(np.int32)), x) for x in (ids.take(pa.array(row)), pa.array(tf), pa.array(lengths))],
        ]
        columns.append(pa.repeat(pa.scalar(zlib.crc32(str(ids[0].as_py()).encode()), pa.int64()), len(columns[0])))  # brings a block's lists together again
        return pa.RecordBatch.from_arrays(columns, ["owner", "term", "n", "words", "max_tf", "min_dl", "doc_ids", "tfs", "dls", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_words = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - n_docs)
                at += part.num_rows
                held.append(part)
                n_docs, n_words = n_docs + part.num_rows, n_words + (pc.sum(pc.list_value_length(part.column(2))).as_py() or 0)
                if n_docs == block or n_words >= BLOCK_WORDS:
                    yield one(*[pa.concat_arrays(c) for c in zip(*[p.columns for p in held], strict=True)])
                    held, n_docs, n_words = [], 0, 0
        if held:
            yield one(*[pa.concat_arrays(c) for c in zip(*[p.columns for p in held], strict=True)])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(run, f"owner {kind('owner')}, term string, n long, words long, max_tf int, min_dl int, doc_ids array<{kind('doc_id')}>, tfs array<int>, dls array<int>, block long")


def sides(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The side tables of inverted(): df of each (owner, term), and documents and words of each owner."""
    terms = postings.where("term IS NOT NULL").groupBy("owner", "term").agg(F.sum("n").alias("df"))
    return terms, postings.where("term IS NULL").groupBy("owner").agg(F.sum("n").alias("n_docs"), F.sum("words").alias("sum_dl"))


def score(postings: DataFrame, terms: DataFrame, sizes: DataFrame, queries: DataFrame, query_id: str, query: str, k: int, owner: str | None = None, apart: bool = False) -> DataFrame:
    """Okapi BM25 of a batch of queries over inverted(): query_id, doc_id, score (6 decimals), rank; ties by doc_id.

    terms: (owner, term, df); sizes: (owner, n_docs, sum_dl); both may have several rows of a key, one for each segment.
    A term in more than half of the documents gets epsilon times the mean idf; query terms count as often as they occur.
    apart: the lists of a block lie in several files. Those that are asked for meet by block first, so that what leaves a task is
    one number for a query and a document, not one for each of their terms.
    """
    own = F.col(owner).alias("owner") if owner else F.lit(0).alias("owner")
    asked = queries.select(own, F.col(query_id).alias("query_id"), F.explode(T.tokens(F.col(query))).alias("term")).groupBy("owner", "query_id", "term").agg(F.count("*").alias("qtf"))
    stats = sizes.groupBy("owner").agg(F.sum("n_docs").alias("n_docs"), (F.sum("sum_dl") / F.sum("n_docs")).alias("avgdl"))
    # small tables are written first: by their measured sizes Spark broadcasts them, and neither terms nor postings have to move
    scratch = Scratch(queries.sparkSession, "scores")
    stats = scratch.save(stats, "stats")
    raw = terms.groupBy("owner", "term").agg(F.sum("df").alias("df")).join(stats, "owner").withColumn("raw", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    raw = scratch.save(raw, "raw")
    mean = raw.groupBy("owner").agg(F.avg("raw").alias("mean_idf"))
    weighed = asked.join(raw, ["owner", "term"]).join(mean, "owner")
    idf = F.when(F.col("raw") < 0, config.BM25_EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    weighed = scratch.save(weighed.select("owner", "query_id", "term", "avgdl", (F.col("qtf") * idf).alias("weight")), "weighed")
    if apart:
        postings = postings.join(weighed.select("owner", "term").distinct(), ["owner", "term"], "left_semi").repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
    hit = weighed.join(postings.select("owner", "term", "doc_ids", "tfs", "dls"), ["owner", "term"])
    hit = hit.select("query_id", "weight", "avgdl", F.explode(F.arrays_zip("doc_ids", "tfs", "dls")).alias("p"))
    part = F.col("weight") * F.col("p.tfs") * (config.BM25_K1 + 1) / (F.col("p.tfs") + config.BM25_K1 * (1 - config.BM25_B + config.BM25_B * F.col("p.dls") / F.col("avgdl")))
    scored = hit.groupBy("query_id", F.col("p.doc_ids").alias("doc_id")).agg(F.round(F.sum(part), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class SearchIndex:
    """A BM25 index in a folder. Each add() writes one segment more; nothing that stands there is read or written again.

    postings/ is partitioned by segment and by a hash bucket of the term and sorted by owner and term, so that a batch of
    questions reads the buckets of its own terms, and of these the row groups with them. terms/ and sizes/ are the side
    tables. A document belongs to one segment; adding it twice counts it twice.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, pushed_terms: int = 1000):
        self.spark, self.path, self.buckets, self.pushed_terms = spark, path.rstrip("/"), buckets, pushed_terms

    def _bucket(self):
        return F.coalesce(F.pmod(F.xxhash64("term"), F.lit(self.buckets)), F.lit(0)).cast("int")

    def segments(self) -> int:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/sizes")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return len(fs.listStatus(path)) if fs.exists(path) else 0

    def add(self, docs: DataFrame, doc_id: str, text: str, owner: str | None = None) -> SearchIndex:
        at = self.segments()
        # each task writes the lists of its own documents into all buckets, so none is shuffled and a frequent term is no one task's
        made = inverted(docs, doc_id, text, owner).withColumn("bucket", self._bucket()).sortWithinPartitions("bucket", "owner", "term")
        made.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings/segment={at}")
        terms, sizes = sides(self.spark.read.parquet(f"{self.path}/postings/segment={at}"))
        terms.write.parquet(f"{self.path}/terms/segment={at}")
        sizes.write.parquet(f"{self.path}/sizes/segment={at}")
        return self

    def search(self, queries: DataFrame, query_id: str, query: str, k: int = config.RETRIEVE_TOP_K, owner: str | None = None) -> DataFrame:
        """query_id, doc_id, score, rank, as retrieval.bm25 gives them over all documents that were added."""
        read = lambda name: self.spark.read.parquet(f"{self.path}/{name}")
        asked = queries.select(F.explode(T.tokens(F.col(query))).alias("term")).distinct().withColumn("bucket", self._bucket())
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most self.buckets
        postings = read("postings").where(F.col("bucket").isin(buckets))
        few = [r[0] for r in asked.select("term").limit(self.pushed_terms + 1).collect()]
        if len(few) <= self.pushed_terms:  # a short list reaches the row groups; a long one is left to the join
            postings = postings.where(F.col("term").isin(few))
        return score(postings, read("terms"), read("sizes"), queries, query_id, query, k, owner, apart=True)
