"""Entities in texts: personal data, legal references and other spans with exact offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

#: Names of acts as texts write them.
ACT_NAMES = (
    "Indian Penal Code|IPC|Bharatiya Nyaya Sanhita|BNS"
    "|Code of Criminal Procedure|CrPC|Cr\\.P\\.C\\.|Bharatiya Nagarik Suraksha Sanhita|BNSS"
    "|Code of Civil Procedure|CPC|C\\.P\\.C\\."
    "|Indian Contract Act|Indian Evidence Act|Bharatiya Sakshya Adhiniyam"
    "|Constitution of India|Indian Stamp Act"
    "|Arbitration and Conciliation Act|Negotiable Instruments Act"
    "|Companies Act|Information Technology Act|IT Act"
    "|Consumer Protection Act|RERA"
    "|Transfer of Property Act|Specific Relief Act"
    "|Limitation Act|Registration Act"
    "|Motor Vehicles Act|NDPS Act"
    "|Prevention of Corruption Act|PMLA"
    "|CGST Act|SGST Act|IGST Act"
    "|Right to Information Act|RTI Act"
)
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: Patterns of legal entities in order of precedence, without regard to case.
ENTITIES = (
    ("STATUTE", rf"(?i)(?:(?:Section|Sec\.|S\.)\s*\d+[A-Za-z]?(?:\s*(?:to|-)\s*\d+[A-Za-z]?)?(?:\s*\([a-zA-Z0-9]+\))*\s*(?:of\s+(?:the\s+)?)?)(?:{ACT_NAMES})(?:[,\s]+\d{{4}})?"),
    ("STATUTE", rf"(?i)\b(?:{ACT_NAMES})(?:[,\s]+\d{{4}})?"),
    ("PROVISION", r"(?i)\b(?:Section|Sec\.|S\.|Article|Art\.|Rule|Order|Clause)\s+\d+[A-Za-z]?(?:\s*(?:to|-)\s*\d+[A-Za-z]?)?(?:\s*\([a-zA-Z0-9]+\))*"),
    ("CASE_CITATION", r"(?i)\b(?:AIR\s+\d{4}\s+(?:SC|[A-Z]{2,4})\s+\d+)|(?:\(\d{4}\)\s+\d+\s+SCC\s+\d+)|(?:\d{4}\s+SCC\s+OnLine\s+SC\s+\d+)|(?:\[\d{4}\]\s+\d+\s+SCR\s+\d+)|(?:\d{4}\s+(?:INSC|INDL)\s+\d+)|(?:\b[A-Z][A-Za-z\s\.]+v\.?\s+[A-Z][A-Za-z\s\.]+)"),
    ("MONEY", r"(?i)(?:₹|Rs\.?|INR)\s*[\d,]+(?:\.\d{1,2})?(?:\s*(?:crore|lakh|lac|thousand|million|billion)s?)?"),
    ("DATE", rf"(?i)\b\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}\b|\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTHS})[,\s]+\d{{4}}\b|\b(?:{_MONTHS})\s+\d{{1,2}}[,\s]+\d{{4}}\b"),
    ("CASE_NUMBER", r"(?i)\b(?:W\.?P\.?|SLP|C\.?A\.?|Crl\.?\s*A\.?|M\.?A\.?|O\.?A\.?|T\.?P\.?|R\.?P\.?)\s*\(?(?:C|Crl|Civil|Criminal)?\)?\s*(?:No\.?\s*)?\d+(?:\s*/\s*\d{2,4})?"),
    (
        "COURT",
        r"(?i)\b(?:Supreme Court of India|Supreme Court|Hon'?ble Supreme Court|High Court of [\w\s]+|(?:Bombay|Delhi|Madras|Calcutta|Allahabad|Karnataka|Kerala|Gujarat|Andhra Pradesh|Telangana|Rajasthan|Punjab and Haryana|Gauhati|Patna|Orissa|Jharkhand|Chhattisgarh|Uttarakhand|Meghalaya|Tripura|Sikkim|Manipur|Himachal Pradesh|Jammu and Kashmir|Madhya Pradesh) High Court|NCLAT|NCLT|NCDRC|SCDRC|DCDRC|National Green Tribunal|NGT|Central Administrative Tribunal|CAT|District (?:and Sessions )?Court|Sessions Court|Metropolitan Magistrate|Chief Metropolitan Magistrate|(?:Additional )?(?:Chief )?Judicial Magistrate|Family Court|Labour Court|Consumer Forum|Debts Recovery Tribunal|DRT|Income Tax Appellate Tribunal|ITAT|Customs Excise and Service Tax Appellate Tribunal|CESTAT)\b",
    ),
    ("JUDGE", r"(?i)\b(?:(?:Hon'?ble\s+)?(?:(?:Chief\s+)?Justice|J\.)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})|(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3},?\s+(?:JJ?\.?|C\.?J\.?))"),
)
#: The list that each label belongs to.
BUCKETS = {
    "STATUTE": "statutes", "PROVISION": "legal_provisions", "CASE_CITATION": "case_citations", "CASE_NUMBER": "case_citations", "MONEY": "monetary_values",
    "DATE": "dates", "COURT": "courts", "JUDGE": "judges", "PERSON": "parties", "ORG": "organizations", "GPE": "locations", "LOC": "locations",
}


def pii_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, entity_type, span_start, span_end, value; a span inside one of an earlier kind is left out. Texts do not move."""
    flat = df.select(key, F.explode(T.personal_data(F.col(text))).alias("s"))
    return flat.select(key, F.col("s.kind").alias("entity_type"), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.value").alias("value"))


def legal_entities(df: DataFrame, key: str, text: str, patterns=ENTITIES) -> DataFrame:
    """key, label, entity_text, span_start, span_end: the first of each (lower-cased text, label) by pattern and place, over two characters.

    All patterns are read in one pass over the rows; what repeats is left out inside the row, so texts and spans do not move.
    """

    def spans(order: int, label: str, pattern: str) -> Column:
        found = F.transform(T.match_spans(F.col(text), pattern), lambda s: F.struct(F.trim(s["value"]).alias("value"), s["start"].alias("start"), s["end"].alias("end")))
        named = lambda s: F.struct(F.lit(label).alias("label"), F.lower(s["value"]).alias("low"), F.lit(order).alias("p"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
        return F.transform(F.filter(found, lambda s: F.length(s["value"]) > 2), named)

    ordered = F.array_sort(F.flatten(F.array(*[spans(i, label, pattern) for i, (label, pattern) in enumerate(patterns)])))
    rows = df.select(key, ordered.alias("__e"))
    new = lambda x, i: (i == 0) | (F.get("__e", i - 1)["label"] != x["label"]) | (F.get("__e", i - 1)["low"] != x["low"])
    flat = rows.select(key, F.explode(F.filter("__e", new)).alias("s"))
    return flat.select(key, F.col("s.label").alias("label"), F.col("s.value").alias("entity_text"), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


def buckets(entities: DataFrame, key: str) -> DataFrame:
    """key, bucket, n and the bucket's texts in order of place."""
    mapping = F.create_map(*[F.lit(x) for pair in BUCKETS.items() for x in pair])
    grouped = entities.select(key, F.element_at(mapping, F.col("label")).alias("bucket"), F.struct("span_start", "entity_text").alias("e")).groupBy(key, "bucket")
    return grouped.agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entity_text"]).alias("texts"))


def merged(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """first, and of second the entities that touch no span of first and repeat no (lower-cased text, label) of it.

    Both: key, label, entity_text, span_start, span_end. Spans meet within a document only.
    """
    f = first.select(F.col(key).alias("__k"), F.col("span_start").alias("__s"), F.col("span_end").alias("__e"), F.lower("entity_text").alias("__t"), F.col("label").alias("__l"))
    touches = (F.col("span_start") < F.col("__e")) & (F.col("__s") < F.col("span_end"))
    repeats = (F.lower("entity_text") == F.col("__t")) & (F.col("label") == F.col("__l"))
    return first.unionByName(second.join(f, (F.col(key) == F.col("__k")) & (touches | repeats), "left_anti"))


def paragraph_of(positions: DataFrame, texts: DataFrame, key: str, text: str, at: str) -> DataFrame:
    """positions with para, the number of paragraph starts (after blank lines) at or before each place, from 1."""
    starts = F.transform(T.match_spans(F.col(text), r"\n\s*\n"), lambda s: s["end"])
    j = positions.join(texts.select(key, starts.alias("__p")), key)
    return j.withColumn("para", F.size(F.filter("__p", lambda p: p <= F.col(at))) + 1).drop("__p")
