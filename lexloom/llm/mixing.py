"""Mixing sources to target weights, with DataFrame functions only.

Words are counted once per document; sources, ranked by code point with null last, get the weights
in turn. Their targets share a budget by weight, but stop at max_repeat times the source's size;
what is cut off is shared again by weight among the others until no target is above its stop.
Every document of a source has the rate target / size: it is taken floor(rate) times, and once more
if a number drawn from a hash of its id and text is below the fraction.

Edge cases: a null or empty text has size 0 and is taken 0 words. A source without words has target
0 and its documents are taken once per whole repeat of rate 0, i.e. never. Null ids hash like the
empty string; rows with equal ids and texts are counted, and each draws a number of its own. If all sources reach their stop, targets stay there. An empty
table gives no rows. Only id, source and text columns are read; other columns pass through `emit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, documents, fresh, word_count


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def draw(doc_id: Column, tie: Column, rank: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the first 48 bits of md5(seed:id:tie:rank); tie is the hash of the text, rank the place among equal rows."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), tie, rank.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def with_rank(rows: DataFrame, key: str, text: str, source: str, tie: str, rank: str) -> DataFrame:
    """rows with tie, the hash of the text, and rank, the place from 0 among the rows of one id, text and source.

    Only rows that stand there more than once are moved and ranked, in the order of a hash of all their columns.
    """
    k, t, o, many = fresh(rows, "__k", "__t", "__o", "__many")
    marked = rows.withColumn(tie, text_key(F.col(f"`{text}`"))) if text in rows.columns else rows
    own = [F.col(f"`{key}`").cast("string"), F.col(f"`{tie}`"), F.col(f"`{source}`").cast("string")]
    repeated = marked.groupBy(*[c.alias(n) for c, n in zip(own, (k, t, o), strict=True)]).agg(F.count("*").alias(many)).where(F.col(many) > 1)
    same = own[0].eqNullSafe(F.col(k)) & (own[1] == F.col(t)) & own[2].eqNullSafe(F.col(o))
    marked = marked.join(repeated, same, "left").drop(k, t, o)
    single = marked.where(F.col(many).isNull()).withColumn(rank, F.lit(0).cast("long"))
    order = Window.partitionBy(*own).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    double = marked.where(F.col(many).isNotNull()).withColumn(rank, F.row_number().over(order).cast("long") - 1)
    return single.unionByName(double).drop(many)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), max_repeat: int = 2) -> DataFrame:
    """source, source_size, weight, target, from a table of (source, size); share is a fraction of all sizes.

    Works on one row per source. Each round is one aggregate of fixed size; rounds end when no further
    source reaches its stop.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "mix")
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # rank by code point: contiguous ranges, then a position from the partition's own counter
    ranged = by_source.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    at = F.monotonically_increasing_id()
    placed = scratch.save(ranged.select("source", "source_size", "n_docs", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("local")), "sources")
    before = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("before") + F.col("local")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = scratch.save(placed.join(F.broadcast(before), "part").select("source", "source_size", "n_docs", weight.cast("long").alias("weight")), "ranked")
    scratch.drop("sources")

    up, down = share
    budget, full = None, (0, 0, 0)
    while True:  # a source at its stop stays there: the level only rises
        # stopped if stop <= weight * level, with level = (budget - stops) / open weights, all in integers
        words, (stopped_words, open_weight) = budget, full[:2]
        if words is None:
            stopped = F.lit(False)
        elif open_weight == 0:
            break
        else:
            level_num = up * words - down * max_repeat * stopped_words
            stopped = F.col("source_size").cast("decimal(38,0)") * (max_repeat * down * open_weight) <= F.col("weight").cast("decimal(38,0)") * F.lit(level_num).cast("decimal(38,0)")
        row = ranked.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(stopped, F.col("source_size")).otherwise(0)).alias("stopped_words"),
            F.sum(F.when(stopped, 0).otherwise(F.col("weight"))).alias("open_weight"),
            F.sum(F.when(stopped, 1).otherwise(0)).alias("n"),
        ).first()
        budget, before_full = row["words"] or 0, full
        full = (row["stopped_words"] or 0, row["open_weight"] or 0, row["n"] or 0)
        if full == before_full:
            break
    stop = (F.col("source_size") * max_repeat).cast("double")
    if full[1]:
        level = (up * (budget or 0) / down - max_repeat * full[0]) / full[1]
        target = F.least(stop, F.col("weight") * F.lit(float(level)))
    else:
        target = stop
    return ranked.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, rate, copies, taken."""
    scratch = Scratch(docs.sparkSession, "mix-sizes")
    sizes = scratch.save(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), text_key(F.col(text)).alias("tie")), "sizes")
    targets = source_targets(sizes, **options)
    sizes = with_rank(sizes, "doc_id", "", "source", "tie", "rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sizes.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    copies = F.floor("rate") + F.when(draw(F.col("doc_id"), F.col("tie"), F.col("rank")) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.select("doc_id", "size", "source", "source_size", "target", "rate", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def emit(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents themselves: every row of docs as many times as it is taken, all columns kept.

    The per-source rates (one row per source) and the ids that stand there more than once meet the documents again,
    so no text is shuffled unless these outgrow a broadcast; Spark decides that by size.
    """
    scratch = Scratch(docs.sparkSession, "mix-emit")
    sizes = scratch.save(docs.select(F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    of, rate, copy, tie, rank = fresh(docs, "__of", "__rate", "__copy", "__tie", "__rank")
    targets = source_targets(sizes, **options).select(F.col("source").alias(of), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate))
    copies = F.floor(rate) + F.when(draw(F.col(f"`{key}`"), F.col(tie), F.col(rank)) < F.col(rate) - F.floor(rate), 1).otherwise(0)
    mixed = with_rank(docs, key, text, source, tie, rank).join(targets, F.col(source).cast("string").eqNullSafe(F.col(of))).withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS tie,
    row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS rank FROM documents
), by_source AS (
  SELECT source, sum(size)::HUGEINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM by_source
), cut AS (
  SELECT *, sum(source_size) OVER () AS words,
    coalesce(sum(2 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM ranked
), level AS (
  SELECT max(lvl) AS level FROM (SELECT (3 * words::DOUBLE / 2 - stopped::DOUBLE) / open_weight::DOUBLE AS lvl, source_size, weight FROM cut) WHERE lvl * weight < 2 * source_size
), targets AS (
  SELECT source, source_size, least(2 * source_size::DOUBLE, coalesce(weight * level, 2 * source_size::DOUBLE)) AS target FROM ranked, level
), rated AS (
  SELECT s.doc_id, s.size, s.tie, s.rank, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || tie || ':' || rank), 1, 12))::BIGINT::DOUBLE / 281474976710656 < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM rated
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies, rate FROM copied
"""
