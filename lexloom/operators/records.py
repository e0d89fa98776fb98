"""Operators on single records: correspondence tables, dates in headers, transcripts, perturbed claims, segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import config
from lexloom.functions.text import match_spans

#: A section number that introduces a heading, a sub-section that does, and what makes the number after it a cross-reference.
SECTION_NUMBER = r"(?<![\w(])(\d+[A-Z]{0,2})\s*(?:\((\d+[A-Za-z]?)\))?(?=\s*[.\-–—]|\s+[A-Z“‘\"'])"
SUBSECTION = r"^\s*(\d+[A-Z]{0,2})\s*\((\d+[A-Za-z]?)\)"
CROSS_REFERENCE = r"(?i)(?:sections?|act|schedule|chapter|clause)\s+(?:no\.?\s*)?$"
#: Cells that say that there is no counterpart, and rows that only divide a table.
NEW_MARK = r"(?i)\bnew\s+(section|sub-?section|provision|clause)\b"
REPEALED_MARK = r"(?i)\brepealed\b|\bomitted\b|\bdeleted\b"
CHAPTER_ROW = r"(?i)^\s*(part|chapter|schedule)\b"
#: Cells that stand where a heading would.
NO_HEADING = ("repealed", "deleted", "omitted", "new section", "new sub-section")


def operative_sections(cell: Column) -> Column:
    """Section numbers that head a cell of a correspondence table, in order, once each.

    A leading sub-section stands for its section. Years and cross-references (by the 14 characters before
    the number) are left out.
    """
    lead = F.regexp_extract(cell, SUBSECTION, 1)
    found = F.regexp_extract_all(cell, F.lit(SECTION_NUMBER), F.lit(1))
    gaps = F.split(cell, SECTION_NUMBER, -1)
    number = F.transform(F.arrays_zip(found.alias("n"), F.slice(gaps, F.lit(1), F.size(found)).alias("g")), lambda z: F.when(F.right(z["g"], F.lit(14)).rlike(CROSS_REFERENCE), None).otherwise(F.upper(z["n"])))
    year = lambda n: n.rlike(r"^\d{4}$") & n.between("1800", "2100")
    return F.when(lead != "", F.array(lead)).otherwise(F.array_distinct(F.filter(number, lambda n: n.isNotNull() & ~year(n))))


def correspondence_class(left: Column, right: Column) -> Column:
    """Class of a two-cell row: header, chapter, new_provision, repealed_no_successor, maps_to or unparsed, tested in this order."""
    new, old = F.size(operative_sections(left)), F.size(operative_sections(right))
    header = F.lower(left).rlike("sanhita|adhiniyam") & F.lower(right).rlike("penal code|criminal procedure|evidence act")
    return (
        F.when(header, "header")
        .when(left.rlike(CHAPTER_ROW) | right.rlike(CHAPTER_ROW), "chapter")
        .when(right.rlike(NEW_MARK) & (old == 0), F.when(new > 0, "new_provision").otherwise("unparsed"))
        .when((old > 0) & (new == 0) & ((left == "") | left.rlike(REPEALED_MARK) | right.rlike(REPEALED_MARK)), "repealed_no_successor")
        .when((new > 0) & (old > 0), "maps_to")
        .otherwise("unparsed")
    )


def header_date(text: Column) -> Column:
    """First of January of the year in the phrase that dates a judgment, within its first 1000 characters; else null."""
    phrase = F.regexp_extract(F.left(text, F.lit(1000)), r"(?i)(?:delivered\s+on|pronounced\s+on|decided\s+on|dated)\s*[:\-]?\s*([^\n.]{0,40})", 1)
    year = F.regexp_extract(phrase, r"\b((?:18|19|20)\d{2})\b", 1)
    return F.when(year != "", F.make_date(year.cast("int"), F.lit(1), F.lit(1)))


def model_cutoff(model: str, cutoffs: dict[str, str]) -> Column:
    """The training cutoff of a model as a date; a model without one is an error, not a guess."""
    if model not in cutoffs:
        raise KeyError(f"no training cutoff recorded for model {model!r}")
    return F.lit(cutoffs[model]).cast("date")


def first_value(metadata: Column, key: str) -> Column:
    """The value of the first entry under a key of a map to lists of structs; null where there is none."""
    return F.get(F.try_element_at(metadata, F.lit(key)), F.lit(0))["value"]


def split_ids(document: Column) -> Column:
    """Ids of a split file's JSON: a list, an object with a list under doc_ids, docs or ids, or the keys of any other object."""
    listed = F.from_json(document, "array<string>")
    lists = F.from_json(document, "doc_ids array<string>, docs array<string>, ids array<string>")
    return F.when(F.trim(document).startswith("["), listed).otherwise(F.coalesce(lists["doc_ids"], lists["docs"], lists["ids"], F.json_object_keys(document)))


def cutoff_side(day: Column, cutoff: Column) -> Column:
    return F.when(day.isNull(), "undated_skipped").when(day < cutoff, "pre_cutoff").otherwise("post_cutoff")


def cut_loop(text: Column, anchor: int = 40) -> Column:
    """A transcript cut where its own first characters start again."""
    at = F.position(F.left(text, F.lit(anchor)), text, F.lit(anchor + 1))
    return F.when((F.length(text) > anchor) & (at > 0), F.rtrim(F.substring(text, F.lit(1), at - 1))).otherwise(text)


def segments(text: Column, limit: int = config.SUMMARY_SEGMENT_CHARS) -> Column:
    """Paragraphs packed in order up to the limit; a paragraph that would overflow opens the next segment. Whole texts, no cut."""
    paragraphs = F.split(text, "\n\n")
    empty = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))
    step = lambda a, p: F.when(F.length(a["buf"]) + F.length(p) > limit, F.struct(p.alias("buf"), F.concat(a["out"], F.array(a["buf"])).alias("out"))).otherwise(F.struct(F.concat(a["buf"], F.lit("\n\n"), p).alias("buf"), a["out"].alias("out")))
    packed = F.aggregate(paragraphs, empty, step, lambda a: F.concat(a["out"], F.array(a["buf"])))
    return F.filter(packed, lambda s: s.rlike(r"\S"))


def footnote_repair(number: Column, known: Column, largest: int = 395) -> Column:
    """A number without its footnote prefix: the first of up to three suffixes that is known, else the first not above the largest."""
    digits, letters = F.regexp_extract(number, r"^(\d+)([A-Z]{0,3})$", 1), F.regexp_extract(number, r"^(\d+)([A-Z]{0,3})$", 2)
    candidates = F.filter(F.array(*[F.when(F.length(digits) > i, F.concat(F.substring(digits, F.lit(i + 1), F.lit(99)), letters)) for i in range(3)]), lambda c: c.isNotNull())
    return F.coalesce(F.get(F.filter(candidates, lambda c: F.array_contains(known, c)), F.lit(0)), F.get(F.filter(candidates, lambda c: F.regexp_extract(c, r"^(\d+)", 1).try_cast("int") <= largest), F.lit(0)))


def verdict(cell: Column) -> Column:
    """correct, wrong or unclear by how a reviewer's cell begins; null if it says none of them."""
    v = F.trim(F.lower(cell))
    return F.when(v.startswith("correct"), "correct").when(v.startswith("wrong"), "wrong").when(v.startswith("unclear"), "unclear")


def number_spans(cell: Column) -> Column:
    """struct(number, start, end) of the operative section numbers of a cell, in order."""
    found = match_spans(cell, SECTION_NUMBER)
    number = lambda x: F.regexp_extract(x["value"], r"^(\d+[A-Z]{0,2})", 1)
    before = lambda x: F.substring(cell, F.greatest(x["start"] - 13, F.lit(1)), F.least(x["start"], F.lit(14)))
    year = lambda x: number(x).rlike(r"^\d{4}$") & number(x).between("1800", "2100")
    kept = F.filter(found, lambda x: ~before(x).rlike(CROSS_REFERENCE) & ~year(x))
    return F.transform(kept, lambda x: F.struct(number(x).alias("number"), x["start"].alias("start"), x["end"].alias("end")))


def section_headings(cell: Column) -> Column:
    """struct(number, heading): the text from the end of each operative number to the start of the next; markers and shorter ones than three characters are left out."""
    spans = number_spans(cell)
    stops = F.concat(F.transform(F.slice(spans, F.lit(2), F.greatest(F.size(spans), F.lit(1))), lambda x: x["start"]), F.array(F.length(cell)))
    raw = F.transform(F.arrays_zip(spans.alias("s"), stops.alias("stop")), lambda z: F.struct(z["s"]["number"].alias("number"), F.substring(cell, z["s"]["end"] + 1, z["stop"] - z["s"]["end"]).alias("t")))
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^[\s.\-–—:;,―]+", ""), r"[\s.\-–—:;,]+$", ""), r"\s+", " "))
    out = F.transform(raw, lambda z: F.struct(z["number"].alias("number"), clean(z["t"]).alias("heading")))
    marker = lambda h: h.rlike("^(?:" + NEW_MARK + ")$") | F.lower(h).isin(*NO_HEADING)
    return F.filter(out, lambda z: z["number"].isNotNull() & (F.length(z["heading"]) >= 3) & ~marker(z["heading"]))


def long_repeat(text: Column, least: int = 150) -> Column:
    """The first block of `least` characters, not at the text's start, that stood there before; null without one.

    Only told, never cut: documents repeat themselves too. Blocks are compared by hash in one pass over the text.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _first_repeat(t, least))

    return run(text)


def _first_repeat(text: str, least: int) -> str | None:
    n = len(text)
    if n < 2 * least:
        return None
    # polynomial hashes of all blocks in 64-bit arithmetic: sums of code points times powers, shifted to one power
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    powers = np.cumprod(np.full(n, 0xD1342543DE82EF95, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers)])
    blocks = (sums[least:] - sums[:-least]) * powers[::-1][: n - least + 1]
    order = np.argsort(blocks, kind="stable")
    same = blocks[order][1:] == blocks[order][:-1]
    again = np.sort(order[1:][same])  # blocks whose hash stood there before
    for start in again[(again >= least) & (again < n - least)].tolist():
        at = text.find(text[start : start + least])
        if at < start:
            return text[at : start + least]
    return None


def cut_leak(text: Column, prompt: str) -> Column:
    """A transcript cut where the prompt itself begins."""
    at = F.position(F.lit(prompt), text)
    return F.when(at > 0, F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"\s+$", "")).otherwise(text)


def english_page(text: Column, least: float = 0.9, letters: int = 40) -> Column:
    """Whether a page has enough letters and at least this share of them is ASCII."""
    n = F.length(F.regexp_replace(text, r"\P{L}", ""))
    return F.coalesce((n >= letters) & (F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / n >= least), F.lit(False))


def best_window(pairs: DataFrame, claim: str, passage: str, order: str, hits: str, least: float = config.CLAIM_OVERLAP) -> DataFrame:
    """Each claim's passage with the most shared words, the first on a tie, if the overlap reaches the least."""
    return pairs.withColumn("__n", F.row_number().over(Window.partitionBy(claim).orderBy(F.desc(hits), F.asc(order)))).where((F.col("__n") == 1) & (F.col("overlap") >= least)).drop("__n")
