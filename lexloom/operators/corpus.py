"""Corpus preparation: near duplicates by shingle sets, components, splits, leakage, mutations of tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import config
from lexloom.functions import text as T
from lexloom.operators.ordering import ranked
from lexloom.sources.scratch import Scratch


def normal_texts(docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """doc_id and t (the normalised text, empty for one without a word), written once: all passes over shingles read it."""
    return scratch.save(docs.select(F.col(key).alias("doc_id"), T.dedup_normal(T.split_lines(F.col(text))).alias("t")), "texts")


def _hashed(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, all in one array, and where each text's begin and end.

    The words of all texts are hashed once each and combined in one array.
    """
    lists = pc.split_pattern(texts, " ")
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    words = lists.flatten().dictionary_encode()
    h = pd.util.hash_array(np.array(words.dictionary.to_pylist(), dtype=object), categorize=False)[words.indices.to_numpy()]
    first = np.cumsum(n) - n
    made = np.maximum(n - k + 1, 1)  # a shorter text is one shingle
    doc = np.repeat(np.arange(len(n)), made)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made) + first[doc]
    width = np.minimum(n, k)[doc]
    s = width.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(k):
        more = j < width
        s[more] = ((s[more] ^ (s[more] >> np.uint64(29))) + h[start[more] + j]) * np.uint64(0xBF58476D1CE4E5B9)
    s = (s ^ (s >> np.uint64(32))).view(np.int64)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.append(0, np.cumsum(np.bincount(doc[new], minlength=len(n)))).astype(np.int32)


def _by_text(texts: DataFrame, k: int, schema: str, columns: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """doc_id and what columns gives for the shingles of some texts and their bounds; texts without a word are left out."""
    names = ["doc_id", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.not_equal(batch.column(1), ""))
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns(*_hashed(part.column(1), k))], names)

    return texts.select("doc_id", "t").mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {schema}")


def shingle_sets(texts: DataFrame, k: int = config.SHINGLE_WORDS) -> DataFrame:
    """doc_id and s, its distinct shingles as sorted 64-bit hashes; texts without a word are left out."""
    return _by_text(texts, k, "s array<bigint>", lambda s, at: [pa.ListArray.from_arrays(pa.array(at), pa.array(s))])


def _fixed(rows: np.ndarray) -> pa.Array:
    """A matrix as one list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]).astype(np.int32)), pa.array(rows.ravel()))


def _about(s: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """For each set a 128-bit hash of the whole, its size, and which of 1024 bins hold an odd number of its shingles."""
    sets = [hashlib.blake2b(s[i:j].tobytes(), digest_size=16).digest() for i, j in zip(at, at[1:], strict=False)]
    doc = np.repeat(np.arange(len(sets)), np.diff(at))
    odd = np.bincount(doc * 1024 + (s.view(np.uint64) >> np.uint64(54)).astype(np.int64), minlength=len(sets) * 1024).reshape(-1, 1024) & 1
    return [pa.array(sets, pa.binary()), pa.array(np.diff(at).astype(np.int32)), _fixed(np.packbits(odd.astype(np.uint8), axis=1).view(np.int64))]


_ABOUT = "set binary, n int, odd array<bigint>"


def frequent_shingles(texts: DataFrame, k: int, most: int, least: int = 32, held: int = 1 << 22) -> list[int]:
    """The hashes of up to `most` shingles that many documents share, for ordering alone.

    A task counts in its own documents, about `held` shingles at once and equal texts once, and only what it has met twice goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, seen = [], set()

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(kept) if kept else np.array([], np.int64), return_counts=True)
            kept.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1]), pa.array(n[n > 1].astype(np.int64))], ["h", "n"])

        for batch in batches:
            texts = []
            for t in batch.column(0).to_pylist():
                own = hash(t)
                if t and own not in seen:
                    seen.add(own)
                    texts.append(t)
            for at in range(0, len(texts), 1024):
                kept.append(_hashed(pa.array(texts[at : at + 1024], pa.string()), k)[0])
                if sum(map(len, kept)) > held:
                    yield counted()
        yield counted()

    counts = texts.select("t").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    return [r[0] for r in counts.orderBy(F.desc("n"), "h").limit(most).collect()]


def blocked_pairs(rows: DataFrame, key: str, node: str, block: int = 2000) -> DataFrame:
    """Distinct pairs (a, b) of nodes, a < b, that share a key, with the other columns of both as a_x and b_x.

    The nodes of a key are dealt into blocks, and each pair of blocks is a key of its own, so that a key with
    very many nodes spreads over many tasks; no pair is left out.
    """
    rest = [c for c in rows.columns if c not in (key, node)]
    # most keys have one node, hence no pair: only the others go on
    sizes = rows.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key, F.ceil(F.col("__n") / block).cast("int").alias("__blocks"))
    dealt = rows.join(sizes, key)
    own = F.pmod(F.xxhash64(node), F.col("__blocks")).cast("int")
    dealt = dealt.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    dealt = dealt.withColumn("__low", F.least("__own", "__other")).withColumn("__high", F.greatest("__own", "__other"))

    def side(x: str) -> DataFrame:
        return dealt.select(key, "__low", "__high", F.col(node).alias(x), F.col("__own").alias(f"__{x}"), *[F.col(c).alias(f"{x}_{c}") for c in rest])

    met = side("a").join(side("b"), [key, "__low", "__high"]).where("a < b AND least(__a, __b) = __low AND greatest(__a, __b) = __high")
    return met.select("a", "b", *[f"{x}_{c}" for x in "ab" for c in rest])


def shingle_classes(about: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """nodes: the smallest id of each distinct shingle set, with the set's other columns; members (doc_id, rep): every document with shingles and its node.

    about: doc_id, set and columns that follow from the set. The sets themselves do not move.
    """
    rows = scratch.save(about, "about")
    rest = [c for c in rows.columns if c not in ("doc_id", "set")]
    # copies merge before the exchange
    nodes = scratch.save(rows.groupBy("set").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in rest]), "nodes")
    return nodes, rows.select("doc_id", "set").join(nodes.select("set", F.col("doc_id").alias("rep")), "set").select("doc_id", "rep")


def near_duplicate_pairs(docs: DataFrame, key: str, text: str, threshold: float = config.NEAR_DUPLICATE_THRESHOLD, k: int = config.SHINGLE_WORDS, most_frequent: int = 4096) -> DataFrame:
    """Exact Jaccard pairs (a, b, jaccard) at or above the threshold, written to the checkpoint folder.

    Documents with equal shingle sets are one class: its smallest id stands for it in pairs with other classes, and
    each other member has one pair with that id, at 1. So every document that is near another one is in a pair.

    In any one order of all shingles, a pair at the threshold shares one of the first n - ceil(t * n) + 1 of both.
    The order is that of the hashes, with the most_frequent shingles that many documents share last, so that
    these seldom become keys; only the prefixes move.
    """
    scratch = Scratch(docs.sparkSession, "near")
    texts = normal_texts(docs, key, text, scratch)
    late = np.array(frequent_shingles(texts, k, most_frequent), np.int64)  # bounded

    def columns(s: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        s_late = s[np.lexsort((s, np.isin(s, late), doc))]
        head = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
        prefix = s_late[np.arange(len(s)) - at[:-1][doc] < head[doc]]
        return [*_about(s, at), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(head)).astype(np.int32)), pa.array(prefix))]

    nodes, members = shingle_classes(_by_text(texts, k, f"{_ABOUT}, prefix array<bigint>", columns), scratch)
    met = blocked_pairs(nodes.select("doc_id", "n", F.explode("prefix").alias("h")), "h", "doc_id")
    return _paired(met, nodes, members, texts, threshold, k, scratch)


def _paired(met: DataFrame, nodes: DataFrame, members: DataFrame, texts: DataFrame, threshold: float, k: int, scratch: Scratch) -> DataFrame:
    """Of the pairs (a, b, a_n, b_n) of nodes those at the threshold, and the membership pairs; the scratch tables are deleted.

    Sets whose odd bins differ in d places differ in d shingles at least; what that rules out is not compared. Of the others the
    sets are made again from their texts.
    """
    met = met.where(f"least(a_n, b_n) >= greatest(a_n, b_n) * {threshold} - 1e-9D").select("a", "b").distinct()
    side = lambda x: nodes.select(F.col("doc_id").alias(x), F.col("n").alias(f"{x}_n"), F.col("odd").alias(f"{x}_odd"))
    apart = F.aggregate(F.zip_with("a_odd", "b_odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = (F.col("a_n") + F.col("b_n")) * ((1 - threshold + 1e-9) / (1 + threshold - 1e-9)) + 1e-6
    left = scratch.save(met.join(side("a"), "a").join(side("b"), "b").where(apart <= most).select("a", "b"), "candidates")
    ids = left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = scratch.save(shingle_sets(texts.join(ids, "doc_id", "left_semi"), k), "sets")
    pairs = verified(left, sets, threshold).unionByName(_copies(members)).checkpoint()
    scratch.drop()
    return pairs


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _signatures(s: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row for each set: of each of the hash functions x -> (a * x + b) mod 2 ** 64, upper half, the least value over its shingles."""
    flat, doc = s.view(np.uint64), np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = np.full((len(at) - 1, len(a)), np.uint64(0xFFFFFFFFFFFFFFFF))
    for start in range(0, len(flat), 4096):  # all functions of some shingles at once, then the least of each document
        x, own = flat[start : start + 4096], doc[start : start + 4096]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        least = np.minimum.reduceat(x[:, None] * a + b, first, axis=0)
        out[own[first]] = np.minimum(out[own[first]], least)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def minhash_pairs(docs: DataFrame, key: str, text: str, threshold: float = config.NEAR_DUPLICATE_THRESHOLD, bands: int = 16, k: int = config.SHINGLE_WORDS, permutations: int = config.MINHASH_PERMUTATIONS, seed: int = 42) -> DataFrame:
    """Pairs (a, b, jaccard) at or above the threshold whose signatures agree in a band; the candidates are verified by their sets.

    The faster relation of `near_duplicate_pairs`, with the same classes and membership pairs: a pair that it gives is exact,
    and it misses one of similarity s with probability (1 - s ** 8) ** 16, that is 0.0001 at 0.9, for 16 bands of 8.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = normal_texts(docs, key, text, scratch)
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)), rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
    signed = _by_text(texts, k, f"{_ABOUT}, signature array<int>", lambda s, at: [*_about(s, at), _fixed(_signatures(s, at, a, b))])
    width = permutations // bands
    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("signature", i * width + 1, width)) for i in range(bands)])
    nodes, members = shingle_classes(signed.select("doc_id", "set", "n", "odd", keys.alias("bands")), scratch)
    met = blocked_pairs(nodes.select("doc_id", "n", F.explode("bands").alias("band")), "band", "doc_id")
    return _paired(met, nodes, members, texts, threshold, k, scratch)


def verified(candidates: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets (doc_id, s) have at least the threshold, with jaccard."""
    sa, sb = nodes.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), nodes.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    scored = candidates.join(sa, "a").join(sb, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("j")).where(F.col("j") >= threshold - 1e-9)
    return scored.select("a", "b", F.round("j", 6).alias("jaccard"))


def _copies(members: DataFrame) -> DataFrame:
    return members.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over edges (a, b). Each round is checkpointed to the shared folder; rounds end when nothing changes."""
    edges = edges.select("a", "b").checkpoint()
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("r"))
        low = labels.join(near, "a").select("a", "root", F.least("root", "r").alias("new"))
        # the label of one's label: doubles the distance that a label travels in a round
        jump = low.join(labels.select(F.col("a").alias("new"), F.col("root").alias("far")), "new", "left").select("a", "root", F.least("new", F.coalesce("far", "new")).alias("new")).checkpoint()
        labels = jump.select("a", F.col("new").alias("root"))
        if jump.where("new <> root").isEmpty():
            return labels.select(F.col("a").alias("node"), "root")


def survivors(docs: DataFrame, group: str, length: str, key: str) -> DataFrame:
    """The longest text of each group, the lowest id on a tie."""
    return docs.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(length), F.asc(key)))).where("__n = 1").drop("__n")


def hash_split(docs: DataFrame, key: str, seed: int = config.SPLIT_SEED, ratios=config.SPLIT_RATIOS) -> DataFrame:
    """docs with split: train, val or test by a hash of (seed, id), so a document keeps its split when others come or go."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return docs.withColumn("split", F.when(u < ratios[0], "train").when(u < ratios[0] + ratios[1], "val").otherwise("test"))


def containing(docs: DataFrame, items: DataFrame, key: str, item: str, text: str, k: int = 5) -> DataFrame:
    """Pairs (doc, item) where a document's text holds an item's whole text.

    An item is looked up by a run of up to k of its inner words, which stand in any such document as they are (the
    first and the last may be parts of words there), and then compared as a whole. Items of fewer
    than three words have no inner word: they are looked up by the one of their runs of four characters (or their
    whole, if shorter) that the fewest documents hold.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0)
    needles = items.select(F.col(item), F.col(text).alias("needle"), words(F.col(text)).alias("w")).where(F.length("needle") > 0)
    long = needles.where(F.size("w") > 2).withColumn("size", F.least(F.size("w") - 2, F.lit(k))).withColumn("gram", F.array_join(F.slice("w", F.lit(2), F.col("size")), " "))
    sizes = [r[0] for r in long.select("size").distinct().collect()]  # at most k
    hay = docs.select(F.col(key), F.col(text).alias("hay"), words(F.col(text)).alias("w"))
    met = _holding_short(hay, needles.where(F.size("w") <= 2).select(item, "needle"), key, item)
    if sizes:
        grams = F.explode(F.array_distinct(F.concat(*[T.ngrams(F.col("w"), n) for n in sizes]))).alias("gram")
        found = hay.select(key, grams).join(long.select(item, "gram"), "gram").select(key, item).distinct()
        sure = found.join(hay.select(key, "hay"), key).join(long.select(item, "needle"), item).where(F.contains("hay", "needle")).select(key, item)
        met = met.unionByName(sure)
    return met


def _holding_short(hay: DataFrame, needles: DataFrame, key: str, item: str, run: int = 4) -> DataFrame:
    """Pairs (doc, item) for short items, by the run of characters of each that stands in the fewest documents."""
    gone = needles.withColumn("size", F.least(F.length("needle"), F.lit(run)))
    sizes = [r[0] for r in gone.select("size").distinct().collect()]  # at most run
    if not sizes:
        return needles.join(hay.select(key), F.lit(False)).select(key, item)
    runs = lambda c, n: F.array_distinct(T.ngrams(F.split(c, ""), n))  # noqa: E731 (characters joined by blanks)
    own = None
    for n in sizes:
        some = gone.where(F.col("size") == n).select(item, "needle", F.explode(runs(F.col("needle"), n)).alias("gram"))
        own = some if own is None else own.unionByName(some)
    grams = hay.where(F.length("hay") > 0).select(key, F.explode(F.concat(*[runs(F.col("hay"), n) for n in sizes])).alias("gram"))
    seen = grams.join(own.select("gram").distinct(), "gram", "left_semi").checkpoint()  # made once, read twice
    counts = own.join(seen.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").groupBy(item, "needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = seen.join(counts.select(item, "needle", "gram"), "gram").select(key, item, "needle")
    return found.join(hay.select(key, "hay"), key).where(F.contains("hay", "needle")).select(key, item).distinct()


def with_split(pairs: DataFrame, splits: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """pairs with their document's split, those of dropped documents left out; a document without a split is an error."""
    j = pairs.join(dropped.select(key), key, "left_anti").join(splits.select(key, "split"), key, "left")
    named = F.coalesce(F.col("split"), F.raise_error(F.concat(F.lit("no split for "), F.col(key).cast("string"))))
    return j.withColumn("split", named)


def insert_if_absent(target: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """target with the first row of each new key of the batch appended."""
    new = batch.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
    return target.unionByName(new.join(target.select(key), key, "left_anti").select(*target.columns))


def upsert(target: DataFrame, batch: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key, batch rows after target rows."""
    rows = target.withColumn("__o", F.lit(-1).cast("bigint")).unionByName(batch.select(*target.columns, order.cast("bigint").alias("__o")))
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__o")))).where("__n = 1").select(*target.columns)


def update_from(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """target with columns replaced by source's where it has them."""
    new = source.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = target.join(new, key, "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def weighted_shards(df: DataFrame, order: str, weights: tuple[float, ...]) -> DataFrame:
    """df with shard: contiguous by order, row counts as the weights say, the remainder in the last.

    Ranks come from per-range counts, not from one global window.
    """
    n = df.count()
    rank, shard, upto, acc = F.col("__rank"), F.lit(len(weights) - 1), [], 0
    for x in weights[:-1]:
        acc += math.floor(n * x / sum(weights))
        upto.append(acc)
    for i in range(len(weights) - 2, -1, -1):
        shard = F.when(rank < upto[i], F.lit(i)).otherwise(shard)
    return ranked(df, F.col(order), name="__rank").withColumn("shard", shard).drop("__rank")
