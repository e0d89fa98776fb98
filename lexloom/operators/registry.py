"""Statute registry: names of acts, section references, resolution, and validity on a date.

All registry tables are small dimensions next to the mentions; Spark broadcasts them by their size.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_D = datetime.date.fromisoformat
#: Id, title, year, in force from, repealed on, repealed by, short form.
STATUTES = [
    ("ipc-1860", "Indian Penal Code", 1860, _D("1862-01-01"), _D("2024-07-01"), "bns-2023", "IPC"),
    ("crpc-1973", "Code of Criminal Procedure", 1973, _D("1974-04-01"), _D("2024-07-01"), "bnss-2023", "CrPC"),
    ("iea-1872", "Indian Evidence Act", 1872, _D("1872-09-01"), _D("2024-07-01"), "bsa-2023", "IEA"),
    ("bns-2023", "Bharatiya Nyaya Sanhita", 2023, _D("2024-07-01"), None, None, "BNS"),
    ("bnss-2023", "Bharatiya Nagarik Suraksha Sanhita", 2023, _D("2024-07-01"), None, None, "BNSS"),
    ("bsa-2023", "Bharatiya Sakshya Adhiniyam", 2023, _D("2024-07-01"), None, None, "BSA"),
    ("contract-1872", "Indian Contract Act", 1872, _D("1872-09-01"), None, None, "Contract Act"),
    ("arbitration-1996", "Arbitration and Conciliation Act", 1996, _D("1996-08-22"), None, None, "Arbitration Act"),
    ("consumer-2019", "Consumer Protection Act", 2019, _D("2020-07-20"), None, None, "Consumer Protection Act"),
    ("cpc-1908", "Code of Civil Procedure", 1908, _D("1909-01-01"), None, None, "CPC"),
    ("ni-1881", "Negotiable Instruments Act", 1881, _D("1882-03-01"), None, None, "NI Act"),
    ("it-2000", "Information Technology Act", 2000, _D("2000-10-17"), None, None, "IT Act"),
    ("stamp-1899", "Indian Stamp Act", 1899, _D("1899-07-01"), None, None, "Stamp Act"),
    ("constitution-1950", "Constitution of India", 1950, _D("1950-01-26"), None, None, "Constitution"),
]
#: How each act is written in texts.
ALIASES = [
    ("indian penal code", "ipc-1860"), ("i.p.c.", "ipc-1860"), ("ipc", "ipc-1860"), ("penal code", "ipc-1860"),
    ("code of criminal procedure", "crpc-1973"), ("criminal procedure code", "crpc-1973"), ("cr.p.c.", "crpc-1973"), ("crpc", "crpc-1973"), ("cr p c", "crpc-1973"),
    ("indian evidence act", "iea-1872"), ("evidence act", "iea-1872"), ("i.e.a.", "iea-1872"),
    ("bharatiya nyaya sanhita", "bns-2023"), ("bns", "bns-2023"),
    ("bharatiya nagarik suraksha sanhita", "bnss-2023"), ("bnss", "bnss-2023"),
    ("bharatiya sakshya adhiniyam", "bsa-2023"), ("bsa", "bsa-2023"),
    ("indian contract act", "contract-1872"), ("contract act", "contract-1872"),
    ("arbitration and conciliation act", "arbitration-1996"), ("arbitration act", "arbitration-1996"),
    ("consumer protection act", "consumer-2019"),
    ("code of civil procedure", "cpc-1908"), ("civil procedure code", "cpc-1908"), ("c.p.c.", "cpc-1908"), ("cpc", "cpc-1908"),
    ("negotiable instruments act", "ni-1881"), ("ni act", "ni-1881"),
    ("information technology act", "it-2000"), ("it act", "it-2000"),
    ("indian stamp act", "stamp-1899"), ("stamp act", "stamp-1899"),
    ("constitution of india", "constitution-1950"), ("constitution", "constitution-1950"),
]
#: Old section, new section.
MAPPED = [
    ("ipc-1860", "420", "bns-2023", "318"), ("ipc-1860", "302", "bns-2023", "103"), ("ipc-1860", "376", "bns-2023", "64"), ("ipc-1860", "124", "bns-2023", "151"),
    ("ipc-1860", "120", "bns-2023", "60"), ("ipc-1860", "120B", "bns-2023", "61"), ("ipc-1860", "499", "bns-2023", "356"), ("ipc-1860", "304A", "bns-2023", "106"),
    ("ipc-1860", "498A", "bns-2023", "85"), ("crpc-1973", "154", "bnss-2023", "173"), ("crpc-1973", "161", "bnss-2023", "180"), ("iea-1872", "65B", "bsa-2023", "63"), ("iea-1872", "32", "bsa-2023", "26"),
]
#: Old sections that share one successor.
MANY_TO_ONE = [("ipc-1860", n, "bns-2023", "179") for n in ("237", "238", "239", "240", "241", "250", "251", "254", "258", "260", "489B")]

#: The word before a provision's number, and the forms of the number.
PROVISION_WORD = r"(?i)^\s*(section|sec|s|article|art|rule|order|clause)\b\.?\s*"
NUMBER = r"(\d+[A-Za-z]?)(?:\s*(?:to|-|–)\s*(\d+[A-Za-z]?))?((?:\s*\([a-zA-Z0-9]+\))*)"
BARE_NUMBER = r"^\d+[A-Za-z]?(?:\s*(?:to|-|–)\s*\d+[A-Za-z]?)?(?:\s*\([a-zA-Z0-9]+\))*\s*$"


def section_rows() -> list[tuple]:
    """id, statute_id, kind, number, in_force_from, in_force_to, status; new-code sections take their dates from the statute."""
    ends = {s[0]: s[4] for s in STATUTES}
    rows: dict[str, tuple] = {}
    for old, n, new, m in MAPPED + MANY_TO_ONE:
        rows[f"{old}-s{n}"] = (f"{old}-s{n}", old, "s", n, None, ends[old], "in_force")
        rows.setdefault(f"{new}-s{m}", (f"{new}-s{m}", new, "s", m, None, None, "in_force"))
    for act, n in (("ipc-1860", "124A"), ("ipc-1860", "337")):
        rows[f"{act}-s{n}"] = (f"{act}-s{n}", act, "s", n, None, ends[act], "in_force")
    for act, n in (("ni-1881", "138"), ("contract-1872", "27"), ("contract-1872", "74")):
        rows[f"{act}-s{n}"] = (f"{act}-s{n}", act, "s", n, None, None, "in_force")
    for n, to, status in (("21", None, "in_force"), ("31", _D("1979-06-20"), "in_force"), ("238", None, "omitted")):
        rows[f"constitution-1950-art{n}"] = (f"constitution-1950-art{n}", "constitution-1950", "art", n, None, to, status)
    return list(rows.values())


def supersession_rows() -> list[tuple]:
    """from_section_id, to_section_id, from_statute_id, to_statute_id, effective_on, relation."""
    day = _D("2024-07-01")
    return [(f"{a}-s{n}", f"{b}-s{m}", a, b, day, "maps_to") for a, n, b, m in MAPPED + MANY_TO_ONE] + [("ipc-1860-s124A", None, "ipc-1860", None, day, "repealed_no_successor")]


def statutes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATUTES, "statute_id string, title string, year int, in_force_from date, repealed_on date, repealed_by string, short_form string")


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(section_rows(), "section_id string, statute_id string, kind string, number string, in_force_from date, in_force_to date, status string")


def supersession(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(supersession_rows(), "from_section_id string, to_section_id string, from_statute_id string, to_statute_id string, effective_on date, relation string")


#: Columns of the three tables, as they are written and read.
STATUTE_SCHEMA = "statute_id string, title string, year int, in_force_from date, repealed_on date, repealed_by string, short_form string"
SECTION_SCHEMA = "section_id string, statute_id string, kind string, number string, heading string, in_force_from date, in_force_to date, status string"
SUPERSESSION_SCHEMA = "from_section_id string, to_section_id string, from_statute_id string, to_statute_id string, effective_on date, relation string"


def read_registry(spark: SparkSession, folder: str, form: str = "parquet") -> tuple[DataFrame, DataFrame, DataFrame]:
    """statutes, sections, supersession from a folder of parquet or csv tables; read lazily, never written to."""
    reader = spark.read.option("header", True).format(form)
    return tuple(reader.schema(schema).load(f"{folder}/{name}") for name, schema in (("statutes", STATUTE_SCHEMA), ("sections", SECTION_SCHEMA), ("supersession", SUPERSESSION_SCHEMA)))


def registry_problems(known_statutes: DataFrame, known_sections: DataFrame, successions: DataFrame) -> DataFrame:
    """problem, id: sections of no known statute, repeated ids, and successions from or to unknown sections."""
    orphan = known_sections.join(known_statutes.select("statute_id").distinct(), "statute_id", "left_anti").select(F.lit("section_without_statute").alias("problem"), F.col("section_id").alias("id"))
    twice = known_sections.groupBy("section_id").count().where("count > 1").select(F.lit("repeated_section").alias("problem"), F.col("section_id").alias("id"))
    known = known_sections.select("section_id").distinct()
    ends = [successions.where(F.col(c).isNotNull()).select(F.col(c).alias("section_id")).distinct().join(known, "section_id", "left_anti").select(F.lit(p).alias("problem"), F.col("section_id").alias("id")) for c, p in (("from_section_id", "unknown_predecessor"), ("to_section_id", "unknown_successor"))]
    return orphan.unionByName(twice).unionByName(ends[0]).unionByName(ends[1])


def enriched_successions(successions: DataFrame, known_sections: DataFrame, citations: DataFrame) -> DataFrame:
    """Each succession with both headings, how often its old section is cited, and how many successors that has. citations: (target_id, occurrences)."""
    heading = known_sections.select("section_id", "heading")
    a = heading.select(F.col("section_id").alias("from_section_id"), F.col("heading").alias("from_heading"))
    b = heading.select(F.col("section_id").alias("to_section_id"), F.col("heading").alias("to_heading"))
    cites = citations.groupBy(F.col("target_id").alias("from_section_id")).agg(F.sum("occurrences").alias("cites"))
    fan = successions.groupBy("from_section_id").agg(F.count("*").alias("fanout"))
    j = successions.join(a, "from_section_id", "left").join(b, "to_section_id", "left").join(cites, "from_section_id", "left").join(fan, "from_section_id")
    return j.select("from_section_id", F.coalesce("from_heading", F.lit("")).alias("from_heading"), "relation", F.coalesce("to_section_id", F.lit("")).alias("to_section_id"), F.coalesce("to_heading", F.lit("")).alias("to_heading"), F.coalesce("cites", F.lit(0)).alias("cites"), "fanout")


def title_key(title: Column) -> Column:
    """A title for comparison: lower case, commas as blanks, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.replace(title, F.lit(","), F.lit(" "))), r"\s+", " "))


def first_omissions(rows: DataFrame, article: str, order: str, day: str) -> DataFrame:
    """The first date told for each article, in reading order; dates that do not exist are passed over."""
    return rows.where(F.col(day).isNotNull()).groupBy(article).agg(F.min_by(day, order).alias(day))


def act_id(text: Column) -> Column:
    """The act that a mention names: the longest alias between letter boundaries, after a leading provision word; else null."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), F.lit(" "))
    low = F.regexp_replace(low, PROVISION_WORD, " ")
    out = F.lit(None).cast("string")
    for alias, act in sorted(ALIASES, key=lambda a: len(a[0])):  # the longest is tested first
        pattern = "(?<![a-z])" + "".join("\\" + c if c == "." else c for c in alias) + "(?![a-z])"
        out = F.when(low.rlike(pattern), F.lit(act)).otherwise(out)
    return out


def section_ref(text: Column) -> Column:
    """struct(kind, number, number_to, subclauses); null without a provision word or a bare number."""
    t = F.regexp_replace(F.trim(text), r"\s+", " ")
    word = F.lower(F.regexp_extract(t, PROVISION_WORD, 1))
    rest = F.when(word != "", F.regexp_replace(t, PROVISION_WORD, "")).when(t.rlike(BARE_NUMBER), t)
    kind = F.when(word.isin("article", "art"), "art").when(word == "rule", "r").when(word == "order", "o").when(word == "clause", "cl").otherwise("s")
    number = F.upper(F.regexp_extract(rest, NUMBER, 1))
    to = F.nullif(F.upper(F.regexp_extract(rest, NUMBER, 2)), F.lit(""))
    subs = F.regexp_extract_all(F.regexp_extract(rest, NUMBER, 3), F.lit(r"\(([a-zA-Z0-9]+)\)"), F.lit(1))
    return F.when(F.coalesce(number, F.lit("")) != "", F.struct(kind.alias("kind"), number.alias("number"), to.alias("number_to"), subs.alias("subclauses")))


def compatible(act: Column, kind: Column) -> Column:
    """Whether an act can hold such a provision: articles only the Constitution, orders and rules only civil procedure."""
    constitution = act == "constitution-1950"
    return F.when(kind == "art", constitution).when(kind.isin("s", "cl"), ~constitution).when(kind.isin("o", "r"), act == "cpc-1908").otherwise(F.lit(True))


def parse(mentions: DataFrame, raw: str) -> DataFrame:
    """mentions with act_id, kind, number, number_to and the canonical section_id."""
    ref = section_ref(F.col(raw))
    df = mentions.withColumn("act_id", act_id(F.col(raw))).withColumn("__r", ref)
    df = df.withColumn("kind", F.col("__r.kind")).withColumn("number", F.col("__r.number")).withColumn("number_to", F.col("__r.number_to")).drop("__r")
    return df.withColumn("section_id", F.concat("act_id", F.lit("-"), "kind", "number"))


def resolve(mentions: DataFrame, raw: str, known_sections: DataFrame, known_statutes: DataFrame) -> DataFrame:
    """mentions with target_type, target_id, confidence: a known section 1.0, a bare known act 0.9, else nulls."""
    df = parse(mentions, raw)
    sec = known_sections.select(F.col("section_id").alias("__sec")).distinct()
    act = known_statutes.select(F.col("statute_id").alias("__act")).distinct()
    df = df.join(sec, F.col("section_id") == F.col("__sec"), "left").join(act, F.col("act_id") == F.col("__act"), "left")
    as_section = F.col("__sec").isNotNull() & compatible(F.col("act_id"), F.col("kind"))
    as_statute = F.col("kind").isNull() & F.col("__act").isNotNull()
    return (
        df.withColumn("target_type", F.when(as_section, "section").when(as_statute, "statute"))
        .withColumn("target_id", F.when(as_section, F.col("__sec")).when(as_statute, F.col("__act")))
        .withColumn("confidence", F.when(as_section, 1.0).when(as_statute, 0.9))
        .drop("__sec", "__act")
    )


def named(ids: DataFrame, section: str, known_statutes: DataFrame) -> DataFrame:
    """ids with the name of each section as a reader knows it: 'bns-2023-s318' as 'BNS 318', with the statute's short form; ids of other kinds stay."""
    shape = r"^(.*)-s([^-]*)$"
    forms = known_statutes.select(F.col("statute_id").alias("__form_of"), F.col("short_form").alias("__form"))
    act = F.regexp_extract(section, shape, 1)
    name = F.when(act != "", F.concat(F.coalesce("__form", act), F.lit(" "), F.regexp_extract(section, shape, 2))).otherwise(F.col(section))
    return ids.join(forms, act == F.col("__form_of"), "left").withColumn("name", name).drop("__form_of", "__form")


def check(resolved: DataFrame, as_of: str, known_sections: DataFrame, known_statutes: DataFrame, successions: DataFrame) -> DataFrame:
    """resolved (target_type, target_id, a date as_of) with status and note.

    Undated omissions first; then each side of the interval falls back to the statute's date; then not
    yet, ended, or in force. An ended section with successors is superseded, with its list; without,
    it is repealed, and the note tells a recorded absence from a missing record. Acts go by the short forms of known_statutes.
    """
    to = F.when(F.col("to_section_id").isNotNull(), F.struct("to_section_id", "name"))
    succ = named(successions, "to_section_id", known_statutes).groupBy(F.col("from_section_id").alias("__from")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(to)), lambda s: s["name"]), " / ").alias("__see"),
        F.count("to_section_id").alias("__n"),
        F.max(F.col("relation") == "repealed_no_successor").alias("__none"),
    )
    acts = known_statutes.select(F.col("statute_id").alias("__sid"), F.col("in_force_from").alias("__afrom"), F.col("repealed_on").alias("__ato"), F.col("repealed_by").alias("__by"))
    acts = acts.join(known_statutes.select(F.col("statute_id").alias("__heir"), F.col("short_form").alias("__heir_form")), F.col("__by") == F.col("__heir"), "left").drop("__heir")
    secs = known_sections.select(F.col("section_id").alias("__sec"), F.col("statute_id").alias("__act"), F.col("in_force_from").alias("__sfrom"), F.col("in_force_to").alias("__sto"), F.col("status").alias("__status"))
    is_section = F.col("target_type") == "section"
    df = resolved.join(secs, is_section & (F.col("target_id") == F.col("__sec")), "left")
    df = df.join(acts, F.coalesce("__act", F.when(~is_section, F.col("target_id"))) == F.col("__sid"), "left").join(succ, F.col("__sec") == F.col("__from"), "left")
    day = F.col(as_of)
    start, end = F.coalesce("__sfrom", "__afrom"), F.coalesce("__sto", "__ato")
    has = F.coalesce("__n", F.lit(0)) > 0
    undated = is_section & (F.col("__status") == "omitted") & F.col("__sto").isNull()
    omitted = F.concat(F.lit("omitted from the "), F.when(F.col("__act") == "constitution-1950", "Constitution").otherwise("statute"), F.lit("; effective date not recorded in registry"))
    gone = F.concat(F.lit("repealed "), end.cast("string"))
    cases = [
        (F.col("target_id").isNull(), "not_found", F.lit("no target id")),
        (F.when(is_section, F.col("__sec")).otherwise(F.col("__sid")).isNull(), "not_found", F.concat("target_id", F.lit(" not in registry"))),
        (undated & has, "superseded", F.concat(omitted, F.lit("; see "), "__see")),
        (undated, "repealed", omitted),
        (day < start, "not_found", F.concat(F.lit("not in force until "), start.cast("string"))),
        (is_section & (day >= end) & has, "superseded", F.concat(gone, F.lit("; see "), "__see")),
        (is_section & (day >= end) & F.col("__none"), "repealed", F.concat(gone, F.lit("; no corresponding provision"))),
        (is_section & (day >= end), "repealed", F.concat(gone, F.lit("; successor not recorded in registry"))),
        ((day >= end) & F.col("__by").isNotNull(), "superseded", F.concat(gone, F.lit("; see "), F.coalesce("__heir_form", "__by"))),
        (day >= end, "repealed", gone),
    ]
    status, note = F.lit("in_force"), F.lit(None).cast("string")
    for test, s, n in reversed(cases):
        hit = F.coalesce(test, F.lit(False))
        status, note = F.when(hit, F.lit(s)).otherwise(status), F.when(hit, n).otherwise(note)
    return df.withColumn("status", status).withColumn("note", note).drop("__sec", "__act", "__sfrom", "__sto", "__status", "__sid", "__afrom", "__ato", "__by", "__heir_form", "__from", "__see", "__n", "__none")


def unambiguous_successors(successions: DataFrame) -> DataFrame:
    """from_section_id and its successor, where there is exactly one."""
    mapped = successions.where(F.col("to_section_id").isNotNull())
    return mapped.groupBy("from_section_id").agg(F.countDistinct("to_section_id").alias("n"), F.min("to_section_id").alias("successor")).where("n = 1").select("from_section_id", "successor")
