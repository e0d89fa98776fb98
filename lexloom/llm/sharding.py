"""Contiguous shards of nearly equal bytes, by prefix sums over per-partition totals.

Rows are range-partitioned and sorted by document id (only ids, sizes and checksums move, never
texts). Each partition writes its running byte sum and row number; the totals of the partitions,
one row each, are turned into offsets; a row's global prefix is its offset plus its local sum.
The byte line from 0 to the total is cut at equal targets and a row belongs to the shard in which
its midpoint lies, so that no shard is further from its target than one row's size.

Edge cases: a null text has size 1 and checksum 0, like an empty one. Rows with equal ids follow
each other in the order of size and checksum; repeated rows each get a slot. Null ids come first.
An empty table gives no rows. Extra columns are not read. A row larger than a shard's target
leaves the next shards smaller or empty; no row is cut or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, documents, shuffle_partitions


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, total, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n, size = batch.num_rows, batch.column("size")
        if not n:
            continue
        upto = pc.add(pc.cumulative_sum(size), total)
        local = pc.subtract(upto, size)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), size, batch.column("text_crc32"), pa.array([part] * n, pa.int32()), local, pa.array(range(rows, rows + n), pa.int64())],
            ["doc_id", "size", "text_crc32", "part", "local_bytes", "local_row"],
        )
        total, rows = upto[-1].as_py(), rows + n


def shard_by_bytes(docs: DataFrame, num_shards: int = 8, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, prefix_bytes (the bytes before it)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    scratch, order = Scratch(spark, "shards"), ["doc_id", "size", "text_crc32", "tie"]
    # written once: range partitioning reads its input twice, and texts are to be read once only
    narrow = scratch.save(narrow, "narrow")
    ranged = narrow.repartitionByRange(partitions or shuffle_partitions(spark), *order).sortWithinPartitions(*order).drop("tie")
    schema = "doc_id long, size long, text_crc32 long, part int, local_bytes long, local_row long"
    sums = scratch.save(ranged.mapInArrow(_running, schema), "sums")
    scratch.drop("narrow")

    # one row per partition, so the window and the broadcast are bounded by the partition count
    totals = sums.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    prefix = F.col("bytes_before") + F.col("local_bytes")
    placed = sums.join(F.broadcast(offsets), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        prefix.alias("prefix_bytes"),
        (F.col("rows_before") + F.col("local_row")).alias("row"),
        F.least(F.lit(num_shards - 1), F.expr(f"((2 * (bytes_before + local_bytes) + size) * {num_shards}) div (2 * all_bytes)")).cast("int").alias("shard"),
    )
    starts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # num_shards rows
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"), "prefix_bytes")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "prefix_bytes"
    )
