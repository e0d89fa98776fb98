"""Queries over the statute registry and citations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom import config
from lexloom.operators import entities, registry as R
from lexloom.operators.chunking import matches
from lexloom.plans.text_queries import F4_SQL, legal_texts, spans_sql
from lexloom.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


MENTIONS = [
    "Section 420 IPC", "Section 302 of the Indian Penal Code", "S. 302A(1)(b) IPC", "Section 376 IPC", "Section 124 IPC", "Section 124A IPC", "Section 120B IPC", "Section 498A IPC",
    "Section 337 IPC", "Section 154 CrPC", "Section 161 Cr.P.C.", "Section 65B of the Indian Evidence Act", "Section 318 BNS", "Section 173 BNSS", "Section 138 of the Negotiable Instruments Act",
    "Section 27 of the Indian Contract Act, 1872", "Article 21 of the Constitution of India", "Article 31 of the Constitution of India", "Article 238 of the Constitution", "Article 21 IPC",
    "Section 9999 IPC", "Section 5 of the Made Up Act 2019", "Indian Penal Code, 1860", "Section 420",
]


def mentions(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(m) for m in MENTIONS]), (F.col("p_partkey") % len(MENTIONS) + 1).cast("int"))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("mention_id"), raw.alias("raw"), F.expr("date_add(date'1975-01-01', cast(p_size * 400 as int))").alias("as_of"))


def _values(rows: list[tuple]) -> str:
    def lit(x):
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else f"DATE '{x}'" if hasattr(x, "isoformat") else "'" + x.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows) + ")"


_PARSE = r"""m AS (SELECT p_partkey AS mention_id, [{list}][p_partkey % {n} + 1] AS raw, (DATE '1975-01-01' + (p_size * 400)::INT)::DATE AS as_of FROM part),
alias(alias, act) AS (FROM {aliases}),
st(statute_id, title, year, in_force_from, repealed_on, repealed_by, short_form) AS (FROM {statutes}),
se(section_id, statute_id, kind, number, in_force_from, in_force_to, status) AS (FROM {sections}),
su(from_section_id, to_section_id, from_statute_id, to_statute_id, effective_on, relation) AS (FROM {supersession}),
n AS (SELECT *, regexp_replace(' ' || lower(regexp_replace(trim(raw), '\s+', ' ', 'g')) || ' ', '(?i)^\s*(section|sec|s|article|art|rule|order|clause)\b\.?\s*', ' ') AS low,
  regexp_replace(trim(raw), '\s+', ' ', 'g') AS t FROM m),
a AS (SELECT mention_id, arg_max(act, length(alias)) AS act_id FROM n JOIN alias ON regexp_matches(low, '(^|[^a-z])' || replace(alias, '.', '\.') || '([^a-z]|$)') GROUP BY mention_id),
w AS (SELECT *, lower(regexp_extract(t, '(?i)^\s*(section|sec|s|article|art|rule|order|clause)\b\.?\s*', 1)) AS word FROM n),
r AS (SELECT *, CASE WHEN word <> '' THEN regexp_replace(t, '(?i)^\s*(section|sec|s|article|art|rule|order|clause)\b\.?\s*', '')
  WHEN regexp_matches(t, '^\d+[A-Za-z]?(?:\s*(?:to|-|–)\s*\d+[A-Za-z]?)?(?:\s*\([a-zA-Z0-9]+\))*\s*$') THEN t END AS rest FROM w),
k AS (SELECT *, nullif(upper(regexp_extract(rest, '(\d+[A-Za-z]?)', 1)), '') AS num FROM r),
p AS (SELECT k.mention_id, k.raw, k.as_of, a.act_id, k.num AS number, CASE WHEN num IS NULL THEN NULL WHEN word IN ('article', 'art') THEN 'art' WHEN word = 'rule' THEN 'r' WHEN word = 'order' THEN 'o' WHEN word = 'clause' THEN 'cl' ELSE 's' END AS kind
  FROM k LEFT JOIN a USING (mention_id)),
q AS (SELECT *, act_id || '-' || kind || number AS section_id FROM p),
x AS (SELECT q.*, CASE WHEN se.section_id IS NOT NULL AND (CASE q.kind WHEN 'art' THEN act_id = 'constitution-1950' WHEN 'o' THEN act_id = 'cpc-1908' WHEN 'r' THEN act_id = 'cpc-1908' ELSE act_id <> 'constitution-1950' END) THEN 'section'
  WHEN q.kind IS NULL AND st.statute_id IS NOT NULL THEN 'statute' END AS target_type FROM q LEFT JOIN se ON q.section_id = se.section_id LEFT JOIN st ON q.act_id = st.statute_id),
res AS (SELECT *, CASE target_type WHEN 'section' THEN section_id WHEN 'statute' THEN act_id END AS target_id, CASE target_type WHEN 'section' THEN 1.0::DOUBLE WHEN 'statute' THEN 0.9::DOUBLE END AS confidence FROM x)"""
PARSE = (
    _PARSE.replace("{list}", ", ".join("'" + m + "'" for m in MENTIONS)).replace("{n}", str(len(MENTIONS))).replace("{aliases}", _values(R.ALIASES))
    .replace("{statutes}", _values(R.STATUTES)).replace("{sections}", _values(R.section_rows())).replace("{supersession}", _values(R.supersession_rows()))
)

CHECK = r""", sc AS (SELECT from_section_id, string_agg(DISTINCT CASE WHEN regexp_matches(to_section_id, '-s[^-]*$') THEN coalesce((SELECT short_form FROM st WHERE st.statute_id = regexp_extract(to_section_id, '^(.*)-s([^-]*)$', 1)), '') || ' ' || regexp_extract(to_section_id, '^(.*)-s([^-]*)$', 2) ELSE to_section_id END, ' / ') AS see,
  count(to_section_id) AS n, bool_or(relation = 'repealed_no_successor') AS none FROM su GROUP BY from_section_id),
j AS (SELECT res.*, se.section_id AS sec, se.status AS sstatus, se.in_force_to AS sto, coalesce(se.in_force_from, st.in_force_from) AS f, coalesce(se.in_force_to, st.repealed_on) AS e, st.statute_id AS sid, st.repealed_by AS rby, see, coalesce(sc.n, 0) > 0 AS has, coalesce(none, false) AS none
  FROM res LEFT JOIN se ON res.target_type = 'section' AND res.target_id = se.section_id LEFT JOIN st ON coalesce(se.statute_id, CASE WHEN res.target_type = 'statute' THEN res.target_id END) = st.statute_id LEFT JOIN sc ON se.section_id = sc.from_section_id),
chk AS (SELECT *, CASE WHEN target_id IS NULL THEN 'not_found|no target id' WHEN target_type = 'section' AND sstatus = 'omitted' AND sto IS NULL THEN 'repealed|omitted from the Constitution; effective date not recorded in registry'
  WHEN as_of < f THEN 'not_found|not in force until ' || f
  WHEN target_type = 'section' AND as_of >= e AND has THEN 'superseded|repealed ' || e || '; see ' || see WHEN target_type = 'section' AND as_of >= e AND none THEN 'repealed|repealed ' || e || '; no corresponding provision'
  WHEN target_type = 'section' AND as_of >= e THEN 'repealed|repealed ' || e || '; successor not recorded in registry'
  WHEN as_of >= e AND rby IS NOT NULL THEN 'superseded|repealed ' || e || '; see ' || (SELECT short_form FROM st WHERE statute_id = rby) WHEN as_of >= e THEN 'repealed|repealed ' || e ELSE 'in_force|' END AS s FROM j),
checked AS (SELECT *, split_part(s, '|', 1) AS status, nullif(split_part(s, '|', 2), '') AS note FROM chk)"""


def _dims(spark):
    return R.sections(spark), R.statutes(spark)


@query(f"WITH {PARSE} SELECT mention_id, act_id FROM q")
def act_normalise(spark, sf_dir):
    return R.parse(mentions(spark, sf_dir), "raw").select("mention_id", "act_id")


@query(f"WITH {PARSE} SELECT mention_id, kind, number, section_id FROM q")
def section_parse(spark, sf_dir):
    return R.parse(mentions(spark, sf_dir), "raw").select("mention_id", "kind", "number", "section_id")


@query(f"WITH {PARSE} SELECT mention_id, raw, target_type, target_id, confidence FROM res")
def resolve_citation(spark, sf_dir):
    return R.resolve(mentions(spark, sf_dir), "raw", *_dims(spark)).select("mention_id", "raw", "target_type", "target_id", "confidence")


def _checked(spark, sf_dir):
    secs, acts = _dims(spark)
    return R.check(R.resolve(mentions(spark, sf_dir), "raw", secs, acts), "as_of", secs, acts, R.supersession(spark))


@query(f"WITH {PARSE}{CHECK} SELECT mention_id, target_id, strftime(as_of, '%Y-%m-%d') AS as_of, status, note FROM checked")
def check_citation_asof(spark, sf_dir):
    return _checked(spark, sf_dir).select("mention_id", "target_id", F.col("as_of").cast("string").alias("as_of"), "status", "note")


@query(f"WITH {PARSE} SELECT coalesce(section_id, '-') AS section_id, count(*) AS n FROM q GROUP BY ALL")
def citation_frequency(spark, sf_dir):
    return R.parse(mentions(spark, sf_dir), "raw").groupBy(F.coalesce("section_id", F.lit("-")).alias("section_id")).agg(F.count("*").alias("n"))


@query(f"""WITH {PARSE}, c AS (SELECT section_id, count(*) AS n FROM q WHERE section_id IS NOT NULL GROUP BY section_id),
u AS (SELECT row_number() OVER (ORDER BY n DESC, section_id) AS rank, sum(n) OVER (ORDER BY n DESC, section_id ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER () AS share FROM c)
SELECT mark, min(rank) AS sections_needed FROM u, (VALUES (50), (80), (90), (95), (99), (100)) v(mark) WHERE share * 100 >= mark - 1e-9::DOUBLE GROUP BY mark""")
def coverage_curve(spark, sf_dir):
    c = R.parse(mentions(spark, sf_dir), "raw").where(F.col("section_id").isNotNull()).groupBy("section_id").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("n"), "section_id")  # one row per section of the registry, not per citation
    u = c.select(F.row_number().over(order).alias("rank"), (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))
    marks = F.explode(F.filter(F.array(*[F.lit(m) for m in (50, 80, 90, 95, 99, 100)]), lambda m: F.col("share") * 100 >= m - 1e-9))
    return u.select("rank", marks.alias("mark")).groupBy("mark").agg(F.min("rank").cast("bigint").alias("sections_needed"))


@query(f"""WITH {PARSE} SELECT coalesce(act_id, '-') AS act_id, count(*) AS n, count(target_id) AS resolved, round(count(target_id)::DOUBLE / count(*), 4) AS rate FROM res GROUP BY ALL""")
def resolution_rate(spark, sf_dir):
    r = R.resolve(mentions(spark, sf_dir), "raw", *_dims(spark))
    return r.groupBy(F.coalesce("act_id", F.lit("-")).alias("act_id")).agg(F.count("*").alias("n"), F.count("target_id").alias("resolved"), F.round(F.count("target_id") / F.count("*"), 4).alias("rate"))


@query(f"""WITH {PARSE}{CHECK}, h AS (SELECT status, count(*) AS n FROM checked WHERE target_id IS NOT NULL GROUP BY status)
SELECT status, n, round(n::DOUBLE / sum(n) OVER (), 4) AS share FROM h""")
def status_histogram(spark, sf_dir):
    h = _checked(spark, sf_dir).where(F.col("target_id").isNotNull()).groupBy("status").agg(F.count("*").alias("n"))
    return h.select("status", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4).alias("share"))


_ATTR = "CASE WHEN act_id IS NOT NULL AND kind IS NOT NULL THEN 'statute_span' WHEN act_id IS NOT NULL THEN 'act_only' WHEN kind = 'art' THEN 'article_default' ELSE 'orphan' END"


def _attributed(spark, sf_dir):
    return R.parse(mentions(spark, sf_dir), "raw").withColumn("attribution", F.expr(_ATTR))


@query(f"WITH {PARSE}, t AS (SELECT {_ATTR} AS attribution FROM q) SELECT attribution, count(*) AS n, round(100 * count(*)::DOUBLE / (SELECT count(*) FROM t), 2) AS percent FROM t GROUP BY attribution")
def attribution_breakdown(spark, sf_dir):
    a = _attributed(spark, sf_dir).groupBy("attribution").agg(F.count("*").alias("n"))
    return a.select("attribution", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2).alias("percent"))


@query(f"""WITH {PARSE}, t AS (SELECT *, {_ATTR} AS attribution FROM res),
g AS (SELECT raw, section_id, act_id, target_type, target_id, count(*) AS occurrences, max(CASE attribution WHEN 'statute_span' THEN 1.0::DOUBLE WHEN 'act_only' THEN 0.9::DOUBLE WHEN 'article_default' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END) AS confidence FROM t GROUP BY ALL)
SELECT 'cs-' || substr(sha1(raw || '|' || coalesce(target_id, '')), 1, 16) AS id, raw, target_type, target_id, coalesce(target_id, section_id, act_id) AS normalised, confidence, occurrences FROM g""")
def citation_strings(spark, sf_dir):
    conf = F.when(F.col("attribution") == "statute_span", 1.0).when(F.col("attribution") == "act_only", 0.9).when(F.col("attribution") == "article_default", 0.8).otherwise(0.5)
    r = R.resolve(mentions(spark, sf_dir), "raw", *_dims(spark)).withColumn("attribution", F.expr(_ATTR))
    g = r.groupBy("raw", "section_id", "act_id", "target_type", "target_id").agg(F.count("*").alias("occurrences"), F.max(conf).alias("confidence"))
    stable = F.concat(F.lit("cs-"), F.left(F.sha1(F.concat("raw", F.lit("|"), F.coalesce("target_id", F.lit("")))), F.lit(16)))
    return g.select(stable.alias("id"), "raw", "target_type", "target_id", F.coalesce("target_id", "section_id", "act_id").alias("normalised"), "confidence", "occurrences")


# a document that names acts and, further on, bare provisions; every part stands at a place that its id gives
_DOC = "'The Indian Penal Code was cited. ' || repeat('x', (p_partkey % 7 * 150)::INT) || ' See Section ' || (p_partkey % 50 + 1) || '. The Constitution of India too. Section ' || (p_partkey % 9 + 1) || ' and Article ' || (p_partkey % 30 + 1) || '; Section 420 IPC.'"
_STAT = r"(?i)(?:(?:Section|Sec\.|S\.)\s*\d+[A-Za-z]?\s*(?:of\s+(?:the\s+)?)?)?(?:Indian Penal Code|IPC|Constitution of India)"
_PROV = r"(?i)\b(?:Section|Article)\s+\d+[A-Za-z]?"


def _cited(spark, sf_dir):
    doc = F.expr(_DOC.replace("::INT", "").replace("repeat('x', (p_partkey % 7 * 150))", "repeat('x', cast(p_partkey % 7 * 150 as int))"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), doc.alias("text"))
    stat = matches(docs, "doc_id", F.col("text"), _STAT, 0).select("doc_id", "match_start", "match_end", R.act_id(F.col("found")).alias("act"))
    ref = R.section_ref(F.col("found"))
    prov = matches(docs, "doc_id", F.col("text"), _PROV, 0).select("doc_id", "match_start", "match_end", "found", ref["kind"].alias("kind"), ref["number"].alias("number"))
    return stat, prov


def attribute(stat, prov):
    """Bare provisions with the nearest preceding compatible act: one ordered pass per document, no pairs.

    A provision inside the statute span nearest before it is left out.
    """
    acts = stat.select("doc_id", "match_start", F.lit(0).alias("o"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("number"), F.struct("act", F.col("match_end").alias("end")).alias("s"), F.lit(None).cast("bigint").alias("match_end"))
    refs = prov.select("doc_id", "match_start", F.lit(1).alias("o"), "kind", "number", F.lit(None).cast(acts.schema["s"].dataType).alias("s"), F.col("match_end").cast("bigint").alias("match_end"))
    past = Window.partitionBy("doc_id").orderBy("match_start", "o").rowsBetween(Window.unboundedPreceding, 0)
    strictly = Window.partitionBy("doc_id").orderBy("match_start").rangeBetween(Window.unboundedPreceding, -1)
    art = F.when(F.col("s.act") == "constitution-1950", F.col("s"))
    sec = F.when(F.col("s.act") != "constitution-1950", F.col("s"))
    both = acts.unionByName(refs)
    both = both.withColumn("near", F.last("s", ignorenulls=True).over(past)).withColumn("a", F.last(art, ignorenulls=True).over(strictly)).withColumn("c", F.last(sec, ignorenulls=True).over(strictly))
    free = both.where((F.col("o") == 1) & ~F.coalesce(F.col("match_end") <= F.col("near.end"), F.lit(False)))
    pick = F.when(F.col("kind") == "art", F.col("a")).otherwise(F.col("c"))
    return free.select("doc_id", "match_start", "kind", "number", pick["act"].alias("act_id"), (F.col("match_start") - pick["end"]).alias("distance"))


_CITED_SQL = rf"""d AS (SELECT p_partkey AS doc_id, {_DOC} AS t FROM part),
s0 AS (SELECT doc_id, regexp_extract_all(t, '{_STAT}') AS m, string_split_regex(t, '{_STAT}') AS g FROM d),
s1 AS (SELECT doc_id, i, m[i] AS f, length(m[i]) AS n, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM s0)),
stat AS (SELECT doc_id, e - n AS b, e, CASE WHEN regexp_matches(lower(f), 'constitution') THEN 'constitution-1950' ELSE 'ipc-1860' END AS act FROM s1),
p0 AS (SELECT doc_id, regexp_extract_all(t, '{_PROV}') AS m, string_split_regex(t, '{_PROV}') AS g FROM d),
p1 AS (SELECT doc_id, i, m[i] AS f, length(m[i]) AS n, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM p0)),
prov AS (SELECT doc_id, e - n AS b, e, CASE WHEN lower(f) LIKE 'article%' THEN 'art' ELSE 's' END AS kind, regexp_extract(f, '(\d+[A-Za-z]?)', 1) AS number FROM p1),
near AS (SELECT p.*, (SELECT arg_max(s.e, s.b) FROM stat s WHERE s.doc_id = p.doc_id AND s.b <= p.b) AS near_end FROM prov p)"""


@query(f"""WITH {_CITED_SQL}, c AS (SELECT n.doc_id, n.b, n.kind, n.number, s.act, s.e, row_number() OVER (PARTITION BY n.doc_id, n.b ORDER BY s.b DESC NULLS LAST) AS k
  FROM near n LEFT JOIN stat s ON s.doc_id = n.doc_id AND s.b < n.b AND ((n.kind = 'art') = (s.act = 'constitution-1950')) WHERE NOT coalesce(n.e <= near_end, false))
SELECT doc_id, b::BIGINT AS match_start, kind, number, act AS act_id, (b - e)::BIGINT AS distance FROM c WHERE k = 1""")
def nearest_preceding_act(spark, sf_dir):
    return attribute(*_cited(spark, sf_dir)).select("doc_id", F.col("match_start").cast("bigint"), "kind", "number", "act_id", F.col("distance").cast("bigint"))


@query(f"WITH {_CITED_SQL} SELECT doc_id, count(*) FILTER (e <= near_end) AS inside, count(*) AS provisions FROM near GROUP BY doc_id")
def provision_inside_statute(spark, sf_dir):
    stat, prov = _cited(spark, sf_dir)
    free = attribute(stat, prov).groupBy("doc_id").agg(F.count("*").alias("free"))
    return prov.groupBy("doc_id").agg(F.count("*").alias("provisions")).join(free, "doc_id", "left").select("doc_id", (F.col("provisions") - F.coalesce("free", F.lit(0))).alias("inside"), "provisions")


@query(f"""WITH {_CITED_SQL}, c AS (SELECT n.doc_id, n.b, n.kind, s.act, n.b - s.e AS distance, row_number() OVER (PARTITION BY n.doc_id, n.b ORDER BY s.b DESC NULLS LAST) AS k
  FROM near n LEFT JOIN stat s ON s.doc_id = n.doc_id AND s.b < n.b AND ((n.kind = 'art') = (s.act = 'constitution-1950')) WHERE NOT coalesce(n.e <= near_end, false))
SELECT act AS act_id, count(*) AS n, count(*) FILTER (distance <= 600) AS strict FROM c WHERE k = 1 GROUP BY act""")
def strict_citations(spark, sf_dir):
    a = attribute(*_cited(spark, sf_dir))
    return a.groupBy("act_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("distance") <= config.NEAR_WINDOW, 1)).alias("strict"))


_NER = [(label, p) for label, p in entities.ENTITIES if label in ("PROVISION", "DATE", "MONEY")]


def _entities_sql(text: str, table_name: str, key: str, patterns) -> str:
    """The first of each lower-cased text and label by pattern and place, over two characters."""
    found = " UNION ALL ".join(f"SELECT doc_id, {i} AS p, '{label}' AS label, s, e, trim(value) AS v FROM ({spans_sql('t', p.replace(chr(39), chr(39) * 2))})" for i, (label, p) in enumerate(patterns))
    return f"t AS (SELECT {key} AS doc_id, {text} AS t FROM {table_name}), f AS ({found}), en AS (SELECT * FROM f WHERE length(v) > 2 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(v), label ORDER BY p, s) = 1)"


_DUE = F4_SQL + " || ' On 15th January, 2023 Rs. ' || (doc_id % 500) || ',000 was due; Rs. 5 lakh on 01/02/2020.'"


def _due(spark, sf_dir):
    text = F.concat("text", F.lit(" On 15th January, 2023 Rs. "), (F.col("doc_id") % 500).cast("string"), F.lit(",000 was due; Rs. 5 lakh on 01/02/2020."))
    return entities.legal_entities(legal_texts(spark, sf_dir).select("doc_id", text.alias("text")), "doc_id", "text", _NER)


@query(f"WITH {_entities_sql(_DUE, 'documents', 'doc_id', _NER)} SELECT doc_id, label, v AS entity, s AS span_start, e AS span_end FROM en")
def ner_entities(spark, sf_dir):
    return _due(spark, sf_dir).select("doc_id", "label", F.col("entity_text").alias("entity"), F.col("span_start").cast("bigint"), F.col("span_end").cast("bigint"))


#: A report from the columns of part that holds each kind of entity.
_REPORT = """'Before the ' || CASE p_partkey % 3 WHEN 0 THEN 'Supreme Court of India' WHEN 1 THEN 'Delhi High Court' ELSE 'NCLT' END || ', Justice Asha Rao Patel. Section ' || (p_partkey % 400) || 'A of the Indian Penal Code, 1860 and Art. ' || p_size || '(1)(b); the Companies Act 2013, the RTI Act. AIR ' || (1950 + p_size) || ' SC ' || p_partkey || '; (' || (1990 + p_size % 30) || ') ' || (p_size % 9 + 1) || ' SCC ' || p_partkey || '; [1973] 4 SCR ' || p_size || '. W.P.(C) No. ' || p_partkey || '/2019, SLP 12/2020. Paid Rs. ' || p_size || ' lakh, INR 4,000.50 on ' || (p_size % 28 + 1) || '/02/2020, 3rd March 2021; May 5, 1999.'"""


def _reports(spark, sf_dir):
    texts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("doc_id"), F.expr(_REPORT).alias("text"))
    return entities.legal_entities(texts, "doc_id", "text")


@query(f"WITH {_entities_sql(_REPORT, 'part', 'p_partkey', entities.ENTITIES)} SELECT doc_id, label, v AS entity, s AS span_start, e AS span_end FROM en")
def ner_all_labels(spark, sf_dir):
    """All nine patterns with offsets."""
    got = _reports(spark, sf_dir)
    return got.select("doc_id", "label", F.col("entity_text").alias("entity"), F.col("span_start").cast("bigint"), F.col("span_end").cast("bigint"))


@query(f"WITH {_entities_sql(_REPORT, 'part', 'p_partkey', entities.ENTITIES)} SELECT doc_id, bucket, count(*) AS n, string_agg(v, '|' ORDER BY s, v) AS texts FROM en JOIN {_values(list(entities.BUCKETS.items()))} b(label, bucket) USING (label) GROUP BY ALL")
def ner_buckets(spark, sf_dir):
    """The entities of all labels in their lists."""
    return entities.buckets(_reports(spark, sf_dir), "doc_id").select("doc_id", "bucket", "n", F.array_join("texts", "|").alias("texts"))


@query(f"WITH {PARSE}{CHECK} SELECT mention_id, CASE WHEN target_id IS NULL THEN 'not_found' ELSE status END AS status, target_id IS NOT NULL AS known FROM checked")
def existence_status(spark, sf_dir):
    """The existence baseline in the registry's words: what it does not know is not_found, the rest has its status."""
    return _checked(spark, sf_dir).select("mention_id", F.when(F.col("target_id").isNull(), "not_found").otherwise(F.col("status")).alias("status"), F.col("target_id").isNotNull().alias("known"))
