"""Exact duplicates by an extendible-hash index on shared files, with DataFrame functions only.

Texts are equal when identical after lower-casing A-Z only. The index maps the leading bits of a
64-bit hash to buckets. Its directory starts with one bucket; a bucket with more keys than its
capacity splits, and the directory doubles whenever the split bucket already uses all its bits, up
to a depth that follows from the number of buckets wanted (deeper overfull buckets stay long, which
costs time but loses nothing). Owners take contiguous runs of buckets, that is key ranges, of nearly
equal numbers of keys. A row goes to the task of its bucket's owner, which holds whole buckets,
compares the bytes of all texts under one hash and chains those that differ, and writes the pages to
the shared folder. A split moves buckets between owners and never changes what they find.

A hash with over 1 / HOT_SHARE of all rows, of which there are fewer than HOT_SHARE, is combined
on the map side first, so a group of copies with a third of all rows sends its owner one row per task.

Edge cases: a null text is an empty one. The row with the largest id stays; null ids are smaller
than any other, and a group with null ids only keeps a null id. Rows that repeat both id and
text all carry the same flag; `deduplicate` then leaves one of them. An empty table gives no rows.
Only id and text are read; other columns, whatever their names, pass through `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, documents, fresh, lower_ascii, shuffle_partitions

#: Bits of the hash that the directory may use at most.
MAX_DEPTH = 20
#: Buckets for each owner task, and bits of the histogram beyond what their number needs.
BUCKETS_PER_OWNER, SPARE_BITS = 4, 3
#: Smallest number of rows, and the share of all rows, above which a hash counts as hot.
HOT_ROWS, HOT_SHARE = 64, 1024


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def prefix(key: Column, bits: int) -> Column:
    """The leading bits of a 64-bit key as a non-negative int."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def split_buckets(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[tuple[int, int]]]:
    """Global depth, and for each directory slot in order (bucket, local depth).

    counts: keys for each value of the max_depth leading bits. A bucket is (its leading bits, their number).
    """
    sums = [[0] * (1 << d) for d in range(max_depth + 1)]
    for value, n in counts.items():
        for d in range(max_depth + 1):
            sums[d][value >> (max_depth - d)] += n
    depth, directory, overfull = 0, [(0, 0)], [(0, 0)]
    while overfull:
        bits, local = overfull.pop()
        if sums[local][bits] <= capacity or local == max_depth:
            continue
        if local == depth:  # the directory doubles: each slot is followed by its twin
            directory, depth = [b for b in directory for _ in (0, 1)], depth + 1
        halves = [(bits << 1, local + 1), (bits << 1 | 1, local + 1)]
        span = 1 << (depth - local - 1)
        first = (bits << 1) * span
        directory[first : first + 2 * span] = [halves[0]] * span + [halves[1]] * span
        overfull += halves
    numbers = {b: i for i, b in enumerate(dict.fromkeys(directory))}
    return depth, [(numbers[b], b[1]) for b in directory]


def owners_of(buckets: list[int], counts: list[int], owners: int) -> dict[int, int]:
    """An owner for each bucket: contiguous runs of nearly equal numbers of keys."""
    total, before, out = max(1, sum(counts)), 0, {}
    for bucket, n in zip(buckets, counts):
        out[bucket] = min(owners - 1, (2 * before + n) * owners // (2 * total))
        before += n
    return out


def owner_keys(spark: SparkSession, owners: int) -> list[int]:
    """For each owner a number that hash partitioning sends to the partition of that owner alone."""
    places = spark.range(64 * owners).groupBy(F.pmod(F.hash("id"), F.lit(owners)).alias("p")).agg(F.min("id").alias("k")).collect()  # one row per owner
    found = {r["p"]: r["k"] for r in places}
    return [found.get(p, p) for p in range(owners)]


def build_directory(keys: DataFrame, owners: int, capacity: int | None, scratch: Scratch) -> tuple[int, DataFrame]:
    """Global depth and the directory (slot, bucket, owner), a table of 2 ** depth rows, from the distinct hashes (column h)."""
    spark, n_keys = keys.sparkSession, keys.count()
    capacity = capacity or max(1, -(-n_keys // (BUCKETS_PER_OWNER * owners)))
    bits = min(MAX_DEPTH, (n_keys // capacity).bit_length() + SPARE_BITS)
    counts = {r["p"]: r["count"] for r in keys.groupBy(prefix(F.col("h"), bits).alias("p")).count().collect()}  # at most 2 ** bits rows: some for each bucket
    depth, slots = split_buckets(counts, capacity, bits)
    sizes = [0] * (slots[-1][0] + 1)
    for value, n in counts.items():
        sizes[slots[value >> (bits - depth)][0]] += n
    owner, key = owners_of(list(range(len(sizes))), sizes, owners), owner_keys(spark, owners)
    return depth, scratch.save(spark.createDataFrame([(i, b, key[owner[b]]) for i, (b, _) in enumerate(slots)], "slot int, bucket int, owner long"), "directory")


def find_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int | None = None, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain (place in the chain of texts under one hash).

    capacity: keys in a bucket before it splits. hash_of: the 64-bit hash of a normalised text.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    parts = shuffle_partitions(docs.sparkSession)
    body = docs.select(F.col(key).cast("long").alias("doc_id"), normalised(F.col(text)).alias("norm"))
    entries = scratch.save(body.select("doc_id", hash_of("norm").alias("h"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")), "entries")
    keys = scratch.save(entries.groupBy("h").agg(F.count("*").alias("n")), "keys")
    depth, directory = build_directory(keys, parts, capacity, scratch)
    rows = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = scratch.save(keys.where(F.col("n") > max(HOT_ROWS, rows // HOT_SHARE)).select("h"), "hot")  # under HOT_SHARE rows

    def located(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(directory), prefix(F.col("h"), depth) == F.col("slot")).drop("slot")

    hashed = body.withColumn("h", hash_of("norm"))
    each = hashed.select("h", "norm", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    if not hot.isEmpty():
        combined = hashed.join(F.broadcast(hot), "h", "left_semi").groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        each = each.join(F.broadcast(hot), "h", "left_anti").unionByName(combined)
    # an owner task holds whole buckets, so neither the comparison of bytes nor the chain needs another exchange
    owned = located(each).repartition(parts, "owner")
    texts = owned.groupBy("owner", "bucket", "h", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chain = (F.row_number().over(Window.partitionBy("owner", "bucket", "h").orderBy("sha")) - 1).cast("int")
    pages = scratch.save(texts.select("owner", "bucket", "h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "keep_id", "group_size").withColumn("chain", chain).drop("owner"), "pages")

    for done in ("keys", "directory"):  # the result reads entries, pages and hot
        scratch.drop(done)

    def answered(some: DataFrame, page: DataFrame) -> DataFrame:
        return some.join(page, ["h", "sha"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain")

    # rows under a hot hash meet its pages apart from the others, so no exchange gathers them
    cold = answered(entries.join(F.broadcast(hot), "h", "left_anti"), pages)
    return cold.unionByName(answered(entries.join(F.broadcast(hot), "h", "left_semi"), pages.join(F.broadcast(hot), "h", "left_semi")))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int | None = None) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept.

    Rows that repeat id and text are told apart by a hash of the whole row; only those rows move for it.
    """
    scratch = Scratch(docs.sparkSession, "exact-stage")
    flags = find_groups(docs, key, text, capacity).groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    flags = scratch.save(flags, "flags")
    id_, sha, own, row = fresh(docs, "__id", "__sha", "__own", "__row")
    out = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.withColumn(own, F.sha2(normalised(F.col(text)).cast("binary"), 256))

    def same(some: DataFrame, how: str) -> DataFrame:
        wanted = some.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha))
        return hashed.join(wanted, F.col(key).cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha)), how)

    again = flags.where("kept AND n > 1")
    if again.isEmpty():
        return same(flags.where("NOT kept"), "left_anti").select(*out)
    once = same(flags.where("NOT kept OR n > 1"), "left_anti").select(*out)
    packed = F.struct(*out)
    one = same(again, "left_semi").groupBy(F.col(key).cast("long").alias(id_), own).agg(F.min_by(packed, F.sha2(F.to_json(packed).cast("binary"), 256)).alias(row))
    return once.unionByName(one.select(*[F.col(f"{row}.`{c}`") for c in docs.columns]))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g ON n.norm = g.norm
"""
