r"""Quality rules with cross-document line frequency, with DataFrame functions only.

Words are runs of anything but ASCII white space. Base rules fail a document with few words or with
many words inside repeated three-word windows. Then each line is normalised (lower case, white
space collapsed, digits to 0) and hashed; for each host the distinct documents with the line are
counted, where exact copies are one document. A line above the host's limits is taken out, and a
document that loses more than max_removed of its characters is rejected. `apply_rules` gives the
measures and the verdict, `clean` the texts of the kept documents without those lines.

Edge cases: a null text has no words, lines or symbols and fails the base rules. A null host is a
host of its own. Rows with equal ids are judged one by one. An empty table gives no rows. Only id,
text and host are read; extra columns with any name do no harm. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import WORD, Scratch, documents, fresh

SPACE = r"[\x20\x09-\x0D]+"


def line_key(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, SPACE, " "), "[0-9]", "0")))


def base_measures(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """Row number, id, host, the base measures, and the lines with a word as (hash, characters)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        t.alias("t"),
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("w"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
    )
    n = F.size("w")
    grams = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.greatest(n - 2, F.lit(1)))
    )
    measured = words.select(
        "doc_id",
        "host",
        F.xxhash64("t").alias("content"),
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(line_key(x)).alias("line"), F.length(x).alias("chars"))).alias("lines"),
        grams.alias("g"),
    )
    measured = measured.withColumn("again", F.size("g") > F.size(F.array_distinct("g")))
    # only texts with a repeated window: sort the windows, take those equal to a neighbour, measure the union of their places
    measured = measured.withColumn("s", F.when(F.col("again"), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))))
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    before = lambda i: F.when(i > 0, F.get("s", i - 1))
    measured = measured.withColumn("p", F.sort_array(F.filter(F.transform("s", lambda x, i: F.when(same(x, F.get("s", i + 1)) | same(x, before(i)), x["i"])), lambda x: x.isNotNull())))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return measured.select(F.monotonically_increasing_id().alias("row"), *measured.columns[:7], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "lines")


def _judged(docs: DataFrame, key: str, text: str, host: str, min_words: int, max_repeat_percent: int, min_line_docs: int, max_line_share: float, max_removed: float) -> DataFrame:
    """One row per document: host, content, the columns of apply_rules, and gone, the hashes of its lines above the limits."""
    base = Scratch(docs.sparkSession, "rules").save(base_measures(docs, key, text, host), "base")
    # exact copies are merged by the distinct count, each text's lines by array_distinct; both before the exchange
    seen = base.select("host", "content", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    frequent = seen.groupBy("host", "line").agg(F.countDistinct("content").alias("n_docs")).where(F.col("n_docs") >= min_line_docs)
    hosts = base.groupBy("host").agg(F.countDistinct("content").alias("host_docs")).withColumnRenamed("host", "of")
    above = frequent.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n_docs") > F.col("host_docs") * max_line_share)
    above = above.select(F.col("host").alias("above_host"), F.col("line").alias("above_line"))
    lines = base.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.line", "l.chars")
    removed = (
        lines.join(above, (F.col("line") == F.col("above_line")) & F.col("host").eqNullSafe(F.col("above_host")))
        .groupBy("row")
        .agg(F.count("*").alias("removed_lines"), F.sum("chars").alias("removed_chars"), F.collect_set("line").alias("gone"))
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    line_chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    lost = F.coalesce("removed_chars", F.lit(0))
    return base.join(removed, "row", "left").select(
        *["host", "content", "gone", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        failed.alias("base_failed"),
        (~failed & (lost <= max_removed * line_chars)).alias("kept"),
        F.coalesce("removed_lines", F.lit(0)).alias("removed_lines"),
        lost.alias("removed_chars"),
        line_chars.alias("line_chars"),
    )


def apply_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, min_line_docs: int = 20, max_line_share: float = 0.02, max_removed: float = 0.5
) -> DataFrame:
    """One row per document: the base measures, base_failed, removed_lines, removed_chars, line_chars, kept.

    A line is above the limits in a host if at least min_line_docs distinct documents and more than
    max_line_share of the host's distinct documents have it.
    """
    return _judged(docs, key, text, host, min_words, max_repeat_percent, min_line_docs, max_line_share, max_removed).drop("host", "content", "gone")


def clean(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, min_line_docs: int = 20, max_line_share: float = 0.02, max_removed: float = 0.5
) -> DataFrame:
    """The rows of docs that apply_rules keeps, all columns, their text without the lines above the limits.

    The other lines stay as they are, in order. Equal texts of one host have one verdict, so it is found by
    (host, hash of the text) and rows with equal or null ids are told apart; a text moves once, to its verdict.
    """
    judged = _judged(docs, key, text, host, min_words, max_repeat_percent, min_line_docs, max_line_share, max_removed)
    of, content, gone = fresh(docs, "__host", "__content", "__gone")
    verdicts = judged.where("kept").groupBy(F.col("host").alias(of), F.col("content").alias(content)).agg(F.first("gone").alias(gone))
    same = F.col(host).cast("string").eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(content))
    left = F.filter(F.split(F.col(text), "\n", -1), lambda x: ~(x.rlike(WORD) & F.array_contains(gone, F.xxhash64(line_key(x)))))
    rebuilt = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(text)
    return docs.join(verdicts, same).select(*[rebuilt if c == text else F.col(f"`{c}`") for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir))


OP10_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, range(0, 3) x(k) GROUP BY r
), lines AS (
  SELECT r, host, t, length(l) AS chars, lower(trim(regexp_replace(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'))) AS line FROM (SELECT r, host, t, unnest(lines) AS l FROM w)
), hosts AS (
  SELECT host, count(DISTINCT t) AS host_docs FROM t GROUP BY host
), above AS (
  SELECT l.host, l.line FROM lines l JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host GROUP BY l.host, l.line, h.host_docs
  HAVING count(DISTINCT l.t) >= 20 AND count(DISTINCT l.t) > 0.02::DOUBLE * h.host_docs
), removed AS (
  SELECT l.r, count(*) AS n, sum(chars) AS chars FROM lines l JOIN above a ON l.line = a.line AND l.host IS NOT DISTINCT FROM a.host GROUP BY l.r
), all_chars AS (
  SELECT r, sum(chars) AS chars FROM lines GROUP BY r
), measured AS (
  SELECT w.r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(x.n, 0)::BIGINT AS removed_lines, coalesce(x.chars, 0)::BIGINT AS removed_chars, coalesce(a.chars, 0)::BIGINT AS line_chars
  FROM w LEFT JOIN covered c ON w.r = c.r LEFT JOIN removed x ON w.r = x.r LEFT JOIN all_chars a ON w.r = a.r
)
SELECT * EXCLUDE (r), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_chars <= 0.5::DOUBLE * line_chars AS kept FROM measured
"""
