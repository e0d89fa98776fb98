"""Chunks of documents: slices, sliding windows and clauses with exact offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import config
from lexloom.functions import text as T

#: Fixed value: where a clause begins.
BOUNDARY = r"(?im)^\s*(Section\s+\d+[A-Za-z]?|Clause\s+\d+[A-Za-z]?|\d+\.|\(\d+\)|WHEREAS|NOW THEREFORE|IN WITNESS)"


def slices(df: DataFrame, text: str, size: int = config.CHUNK_CHILD_CHARS) -> DataFrame:
    """One row per slice: the columns of df without text, then chunk_index, char_start, char_end, chunk_text."""
    keys = [c for c in df.columns if c != text]
    cut = df.select(*keys, text, F.posexplode(T.slice_starts(F.length(text), size)).alias("chunk_index", "char_start"))
    body = F.substring(text, F.col("char_start") + 1, F.lit(size))
    return cut.select(*keys, "chunk_index", "char_start", (F.col("char_start") + F.length(body)).alias("char_end"), body.alias("chunk_text"))


def windows(df: DataFrame, text: str, size: int = config.CLAUSE_WINDOW, overlap: int = config.CLAUSE_OVERLAP) -> DataFrame:
    """Overlapping windows of characters; blank ones are skipped."""
    keys = [c for c in df.columns if c != text]
    cut = df.select(*keys, text, F.explode(T.window_starts(F.length(text), size, overlap)).alias("win_start"))
    body = F.substring(text, F.col("win_start") + 1, F.lit(size))
    return cut.select(*keys, "win_start", body.alias("win_text")).where(F.col("win_text").rlike(r"\S"))


def word_windows(df: DataFrame, text: str, size: int = config.PREMISE_WORDS, overlap: int = config.PREMISE_OVERLAP) -> DataFrame:
    """Overlapping windows of words joined by blanks; a text of one window stays as it is."""
    keys = [c for c in df.columns if c != text]
    w = df.select(*keys, text, T.words(F.col(text)).alias("__w"))
    cut = w.select(*keys, text, "__w", F.posexplode(T.window_starts(F.size("__w"), size, overlap)).alias("window_no", "__at"))
    body = F.when(F.size("__w") <= size, F.col(text)).otherwise(F.array_join(F.slice("__w", F.col("__at") + 1, F.lit(size)), " "))
    return cut.select(*keys, "window_no", body.alias("window_text"))


def matches(df: DataFrame, key: str, text: Column, pattern: str, group: int = 1) -> DataFrame:
    """key, match_no, match_start, match_end and found (the group), one row per match.

    Offsets are code points: a match starts after all gaps up to it and all matches before it.
    """
    both = df.select(key, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("__m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("__g"), F.split(text, pattern, -1).alias("__gap"))
    flat = both.select(key, "__gap", F.posexplode(F.arrays_zip("__m", "__g")).alias("match_no", "__x")).select(key, "match_no", F.length(F.get("__gap", "match_no")).alias("gap"), F.length("__x.__m").alias("n"), F.col("__x.__g").alias("found"))
    upto = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy(key).orderBy("match_no"))
    return flat.select(key, "match_no", (upto - F.col("n")).alias("match_start"), upto.alias("match_end"), "found")


def clauses(df: DataFrame, key: str | list[str], text: str, child: int = config.CHUNK_CHILD_CHARS) -> DataFrame:
    """Clauses: key columns, para_no, section_label, char_start, char_end, chunk_text, page_no, n_children, bm25_indexed.

    A document without a boundary is one clause; text before the first boundary is a preamble
    without a label. Blank spans are left out. Form feeds count once each, up to and in the span.
    Spans are found and cut inside the row, so no text moves.
    """
    keys = [key] if isinstance(key, str) else list(key)
    left = lambda c: F.regexp_replace(c, r"^\s+", "")
    whole = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    found = whole.withColumn("__m", F.transform(T.match_spans(F.col("__t"), BOUNDARY), lambda m: F.struct(m["start"].alias("at"), left(m["value"]).alias("label"))))
    head = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("label")))
    cut = found.withColumn("__b", F.when(F.coalesce(F.get("__m", F.lit(0))["at"], F.lit(1)) > 0, F.concat(head, "__m")).otherwise(F.col("__m")))
    end = lambda i: F.coalesce(F.get("__b", i + 1)["at"], F.length("__t"))
    piece = lambda x, i: F.struct(x["at"].alias("at"), x["label"].alias("label"), F.substring(F.col("__t"), x["at"] + 1, end(i) - x["at"]).alias("piece"))
    parts = cut.select(*keys, F.filter(F.transform("__b", piece), lambda x: x["piece"].rlike(r"\S")).alias("__p"))
    breaks = parts.withColumn("__f", F.transform("__p", lambda x: F.regexp_count(x["piece"], F.lit("\f"))))
    # outer, as the filter that Spark infers for an inner one finds all spans again, below every step
    rows = breaks.select(*keys, "__f", F.posexplode_outer("__p").alias("__i", "__x")).where("__x IS NOT NULL")
    bare = left(F.col("__x.piece"))
    page = F.aggregate(F.slice("__f", F.lit(1), F.col("__i") + 1), F.lit(1), lambda n, x: n + x)
    rows = rows.select(*keys, (F.col("__i") + 1).alias("para_no"), F.col("__x.label").alias("section_label"), (F.col("__x.at") + F.length("__x.piece") - F.length(bare)).alias("char_start"), F.regexp_replace(bare, r"\s+$", "").alias("chunk_text"), page.alias("page_no"))
    n = F.length("chunk_text")
    return rows.select(
        *[*keys, "para_no", "section_label", "char_start", (F.col("char_start") + n).alias("char_end"), "chunk_text", "page_no"],
        F.when(n > child, F.ceil(n / child)).otherwise(0).cast("int").alias("n_children"),
        (n <= child).alias("bm25_indexed"),
    )


def clause_chunks(df: DataFrame, key: str | list[str], text: str, child: int = config.CHUNK_CHILD_CHARS) -> DataFrame:
    """Parents and children: key columns, chunk_id, parent_chunk_id, para_no, section_label, page_no, char_start, char_end, chunk_text, bm25_indexed.

    A clause longer than `child` is not searched itself; its slices are, and name it as their parent.
    """
    keys = [key] if isinstance(key, str) else list(key)
    own = F.concat_ws("-", F.lit("ch"), *[F.col(c).cast("string") for c in keys], F.col("para_no").cast("string"))
    whole = clauses(df, keys, text, child)
    # a clause and its slices leave the row together, so that clauses are found once
    cut = F.when(F.col("n_children") > 0, F.regexp_extract_all("chunk_text", F.lit(f"(?s).{{1,{child}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = whole.select(*keys, own.alias("__own"), "para_no", "section_label", "page_no", "char_start", "bm25_indexed", F.posexplode_outer(F.concat(F.array("chunk_text"), cut)).alias("__i", "chunk_text"))
    part = F.col("__i") > 0
    start = F.when(part, F.col("char_start") + (F.col("__i") - 1) * child).otherwise(F.col("char_start"))
    return rows.select(
        *[*keys, F.when(part, F.concat("__own", F.lit("-"), (F.col("__i") - 1).cast("string"))).otherwise(F.col("__own")).alias("chunk_id"), F.when(part, F.col("__own")).alias("parent_chunk_id")],
        *["para_no", "section_label", "page_no", start.alias("char_start"), (start + F.length("chunk_text")).alias("char_end"), "chunk_text", (part | F.col("bm25_indexed")).alias("bm25_indexed")],
    )


def small_to_big(ranked: DataFrame, query: str = "query_id", parent: str = "parent_id", rank: str = "rank", keep: int = config.RERANK_TOP_K) -> DataFrame:
    """The best-ranked child of each parent, in rank order, at most `keep` parents for each query."""
    best = ranked.withColumn("__n", F.row_number().over(Window.partitionBy(query, parent).orderBy(rank))).where("__n = 1")
    return best.withColumn("parent_rank", F.row_number().over(Window.partitionBy(query).orderBy(rank))).where(F.col("parent_rank") <= keep).drop("__n")


def with_parents(hits: DataFrame, near: DataFrame, store: DataFrame, parent: str, text: str) -> DataFrame:
    """hits with their parent's text and where it came from: near (the chunks at hand) or fetched (the store, asked for the rest only)."""
    j = hits.join(near.select(parent, text), parent, "left")
    found = j.where(F.col(text).isNotNull()).withColumn("source", F.lit("near"))
    rest = j.where(F.col(text).isNull()).drop(text).join(store.select(parent, text), parent, "left").withColumn("source", F.when(F.col(text).isNotNull(), "fetched").otherwise("missing"))
    return found.unionByName(rest)
