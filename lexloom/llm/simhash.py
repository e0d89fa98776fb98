"""Near duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has bit b set if more than half of the text's shingle hashes have it (every shingle
counts as often as it occurs). Two fingerprints link if they differ in at most `radius` bits.

Candidates come from 2 ** (radius + 1) - 1 tables. Bit position i carries a non-zero vector m(i) of
radius + 1 bits, and table v keeps the positions whose m(i) has an odd overlap with v. The at most
`radius` positions in which a linked pair differs span less than the whole space, so some v is
orthogonal to all of them: that table's mask leaves them out and the pair meets there. No link is
missed, whatever the data. Each mask keeps about half of the bits.

Within a bucket a breadth-first search emits a spanning set of links, at most one for each
fingerprint, never all pairs. A bucket above split_size is dealt again by a second covering family
over the bits that its mask leaves open, so that it spreads over many tasks and still loses no
link; both masks together leave about 16 bits open, so no bucket then holds more than some 2 ** 16 fingerprints,
however many documents there are. Components are labelled by alternating star contraction, one written table for each round.

Edge cases: null and empty texts and texts of white space have fingerprint zero, which links like
any other; texts shorter than a shingle are one shingle. Rows with equal ids are separate rows; the
smallest id labels a component, null ids only if there is no other. An empty table gives no rows.
Only id and text are read; `deduplicate` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, documents, fresh, shuffle_partitions

BITS = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    count, total = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for at in range(0, total, 1 << 16):
        upto = min(at + (1 << 16), total)
        h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts[at:upto].tolist(), ends[at + shingle - 1 : upto + shingle - 1].tolist())], np.uint64, upto - at)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """Masks over the positions such that any radius of them lie outside at least one mask."""
    size = 1 << (radius + 1)
    vector = {p: 1 + i % (size - 1) for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what pairs within the radius connect; members are distinct uint64."""
    links, rest = [], members
    while rest.size:
        stack, rest = [rest[0]], rest[1:]
        while stack and rest.size:
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                links += [(int(x), int(y)) for y in found]
                stack += list(found)
                rest = rest[~near]
    return links


def _links_of(buckets: DataFrame, radius: int, parts: int) -> DataFrame:
    """Spanning links of each bucket, from rows (t, k, fp); a bucket is one (t, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the bucket that may go on in the next batch
        last = None

        def emit(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, k = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            bounds = np.concatenate(([0], cuts, [len(fp)]))
            out: list[tuple[int, int]] = []
            if last is not None:
                if last == (t[0], k[0]):
                    held.append(fp[: bounds[1]])
                    if len(bounds) == 2:
                        continue
                    bounds = bounds[1:]
                out += spanning_links(np.unique(np.concatenate(held)), radius) if len(held) > 1 or len(held[0]) > 1 else []
            size = np.diff(bounds)[:-1]
            first = bounds[:-2][size == 2]
            near = first[np.bitwise_count(fp[first] ^ fp[first + 1]) <= radius]
            out += list(zip(fp[near].tolist(), fp[near + 1].tolist()))
            for i in np.flatnonzero(size > 2):
                out += spanning_links(fp[bounds[i] : bounds[i + 1]], radius)
            held, last = [fp[bounds[-2] :].copy()], (t[-1], k[-1])
            if out:
                yield emit(out)
        if last is not None and (out := spanning_links(np.concatenate(held), radius)):
            yield emit(out)

    return buckets.repartition(parts, "t", "k").sortWithinPartitions("t", "k", "fp").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, radius: int = 4, split_size: int = 20_000) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp), whose components are those of all pairs within the radius."""
    spark = nodes.sparkSession
    parts = shuffle_partitions(spark)
    masks = covering_masks(radius, list(range(BITS)))
    scratch = Scratch(spark, "simhash-tables")
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    dealt = nodes.select(F.posexplode(keys).alias("t", "k"), "fp")
    # sizes come from the same rows, pre-aggregated; only the few large buckets' keys are kept
    large = scratch.save(dealt.groupBy("t", "k").count().where(F.col("count") > split_size).select("t", "k"), "large")
    if large.isEmpty():
        return _links_of(dealt, radius, parts)
    sub = [(v, 1 + len(masks) * (v + 1) + s, _signed(m | more)) for v, m in enumerate(masks) for s, more in enumerate(covering_masks(radius, [p for p in range(BITS) if not m >> p & 1]))]
    again = spark.createDataFrame(sub, "t int, t2 int, mask long")
    small = dealt.join(large, ["t", "k"], "left_anti")
    split = dealt.join(large, ["t", "k"], "left_semi").join(F.broadcast(again), "t").select(F.col("t2").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp")
    return _links_of(small.select("t", "k", "fp").unionByName(split), radius, parts)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root (the smallest node of its component), for nodes with an edge (a, b)."""

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "round0")
    mark, step = state(now), 0
    while mark[0]:
        step += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the smallest neighbour of each node itself must stay reachable
        wide = wide.unionByName(smallest(both).where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = smallest(wide)
        tight = wide.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = scratch.save(tight.where("u <> v").distinct(), f"round{step}")
        before, mark = mark, state(new)
        scratch.drop(f"round{step - 1}")
        now = new
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _marked_and_labels(docs: DataFrame, key: str, text: str, shingle: int, radius: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every document, and for each fp the component's root, its component_id and first_id, the smallest id with this fp."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(fingerprints(docs, key, text, shingle, seed), "fingerprints")
    nodes = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    edges = scratch.save(links(nodes.select("fp"), radius).distinct(), "links")
    roots = scratch.save(components(edges, scratch), "roots")
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = scratch.save(rooted.join(smallest, "root").select("fp", "component_id", "root", "first_id"), "labels")
    for done in ("nodes", "links", "roots"):
        scratch.drop(done)
    return marked, labels


def find_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable through links)."""
    marked, labels = _marked_and_labels(docs, key, text, shingle, radius, seed)
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """docs with one row of each component, all columns kept: a row with its smallest id, without id only if no row has one.

    An id that no other row has names its row. Rows that share an id, or have none, are told apart by id and
    fingerprint, which are computed again for those rows only; equal ones go by hash of the text, then of the row.
    """
    scratch = Scratch(docs.sparkSession, "simhash-stage")
    marked, labels = _marked_and_labels(docs, key, text, shingle, radius, seed)
    # one fp of each component stays, the least of those with its smallest id
    chosen = labels.where(F.col("first_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("fp").alias("keep_fp"))
    chosen = labels.join(chosen, "root").select("fp", "component_id", "keep_fp")
    stay = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("keep_fp"))
    rows = scratch.save(marked.join(chosen, "fp").select("doc_id", "fp", stay.alias("stay")), "rows")
    id_, fp_, keep, row = fresh(docs, "__id", "__fp", "__keep", "__row")
    repeated = scratch.save(rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(id_)), "repeated")
    own = F.col(key).cast("long")
    out = [F.col(f"`{c}`") for c in docs.columns]

    dropped = rows.where("NOT stay").select(F.col("doc_id").alias(id_))
    if repeated.isEmpty():
        return docs.join(dropped, own == F.col(id_), "left_anti").select(*out)
    once = docs.join(dropped.unionByName(repeated).distinct(), own.eqNullSafe(F.col(id_)), "left_anti").select(*out)

    @F.arrow_udf("long")
    def marks(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), np.uint64, len(texts)).view(np.int64))

    shared = docs.join(repeated, own.eqNullSafe(F.col(id_)), "left_semi").withColumn(fp_, marks(F.col(text)))
    survivors = rows.where("stay").select(F.col("doc_id").alias(id_), F.col("fp").alias(keep)).distinct()
    shared = shared.join(survivors, own.eqNullSafe(F.col(id_)) & (F.col(fp_) == F.col(keep)), "left_semi")
    order = F.struct(F.sha2(F.col(text).cast("binary"), 256), F.sha2(F.to_json(F.struct(*out)).cast("binary"), 256))
    shared = shared.groupBy(own.alias(id_), fp_).agg(F.min_by(F.struct(*out), order).alias(row))
    return once.unionByName(shared.select(*[F.col(f"{row}.`{c}`") for c in docs.columns]))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return find_groups(documents(spark, sf_dir)).select("doc_id", fp.alias("fingerprint"), "component_id")
