"""Queries over a registry that comes from tables, citations in texts, generation shapes and scopes, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import chunking, claims as C, corpus, entities, records, registry as R, retrieval, scope as S
from lexloom.operators.chunking import matches
from lexloom.plans import evaluation_queries
from lexloom.plans.text_queries import F4_SQL, legal_texts, spans_sql
from lexloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# a registry built from tables: an act for each supplier, a section for each part, successions between old and new acts
_REG_SQL = """st AS (SELECT 'act-' || s_suppkey AS statute_id, s_name AS title, (1900 + s_suppkey % 100)::INT AS year, CASE WHEN s_suppkey % 7 > 0 THEN DATE '1990-01-01' + (s_suppkey * 30)::INT END AS in_force_from, CASE WHEN s_suppkey % 5 = 0 THEN DATE '2024-07-01' END AS repealed_on, CASE WHEN s_suppkey % 10 = 0 THEN 'act-' || (s_suppkey + 1) END AS repealed_by, 'ACT' || s_suppkey AS short_form FROM supplier WHERE s_suppkey % 13 <> 5),
se AS (SELECT 'act-' || (p_partkey % 90) || '-s' || p_partkey AS section_id, 'act-' || (p_partkey % 90) AS statute_id, p_partkey::VARCHAR AS number, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS heading, CASE WHEN p_partkey % 4 = 0 THEN DATE '2000-01-01' + (p_size * 100)::INT END AS in_force_from, CASE WHEN p_partkey % 6 = 0 THEN DATE '2015-01-01' + (p_size * 50)::INT END AS in_force_to, CASE WHEN p_partkey % 31 = 0 THEN 'omitted' ELSE 'in_force' END AS status FROM part),
su AS (SELECT 'act-' || (p_partkey % 90) || '-s' || p_partkey AS f, CASE WHEN p_size % 4 > 0 THEN 'act-' || ((p_partkey + k) % 90) || '-s' || (p_partkey + k) END AS t, CASE WHEN p_size % 4 > 0 THEN 'maps_to' ELSE 'repealed_no_successor' END AS relation, k FROM part, (VALUES (1), (2)) v(k) WHERE p_partkey % 6 = 0 AND (k = 1 OR p_size % 4 = 1))"""


def registry_tables(spark, sf_dir):
    k, day = F.col("s_suppkey"), lambda s: F.lit(s).cast("date")
    no = lambda t: F.lit(None).cast(t)
    act = lambda c: F.concat(F.lit("act-"), c.cast("string"))
    st = table(spark, sf_dir, "supplier").where(k % 13 != 5).select(  # some sections stand in no known act
        act(k).alias("statute_id"), F.col("s_name").alias("title"), (k % 100 + 1900).cast("int").alias("year"), F.when(k % 7 > 0, F.date_add(day("1990-01-01"), (k * 30).cast("int"))).alias("in_force_from"),
        F.when(k % 5 == 0, day("2024-07-01")).alias("repealed_on"), F.when(k % 10 == 0, act(k + 1)).alias("repealed_by"), F.concat(F.lit("ACT"), k.cast("string")).alias("short_form"),
    )
    p, n = F.col("p_partkey"), F.col("p_size")
    sid = lambda c: F.concat(act(c % 90), F.lit("-s"), c.cast("string"))
    part = table(spark, sf_dir, "part")
    se = part.select(
        sid(p).alias("section_id"), act(p % 90).alias("statute_id"), F.lit("s").alias("kind"), p.cast("string").alias("number"), F.when(p % 3 > 0, F.col("p_name")).alias("heading"),
        F.when(p % 4 == 0, F.date_add(day("2000-01-01"), n * 100)).alias("in_force_from"), F.when(p % 6 == 0, F.date_add(day("2015-01-01"), n * 50)).alias("in_force_to"), F.when(p % 31 == 0, "omitted").otherwise("in_force").alias("status"),
    )
    su = part.where("p_partkey % 6 = 0").select(p, n, F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).where("k = 1 OR p_size % 4 = 1")
    su = su.select(
        sid(p).alias("from_section_id"), F.when(n % 4 > 0, sid(p + F.col("k"))).alias("to_section_id"), act(p % 90).alias("from_statute_id"), F.when(n % 4 > 0, act((p + F.col("k")) % 90)).alias("to_statute_id"),
        day("2024-07-01").alias("effective_on"), F.when(n % 4 > 0, "maps_to").otherwise("repealed_no_successor").alias("relation"),
    )
    return st, se, su


_CHECKED_SQL = """g AS (SELECT f, count(t) AS n, bool_or(relation = 'repealed_no_successor') AS none, string_agg(name, ' / ' ORDER BY t) AS see FROM
  (SELECT DISTINCT f, t, relation, coalesce(short_form, regexp_extract(t, '^(.*)-s', 1)) || ' ' || regexp_extract(t, '-s([^-]*)$', 1) AS name FROM su LEFT JOIN st ON st.statute_id = regexp_extract(t, '^(.*)-s', 1)) GROUP BY f),
j AS (SELECT m.*, se.section_id, se.status, se.in_force_to AS sto, coalesce(se.in_force_from, st.in_force_from) AS a, coalesce(se.in_force_to, st.repealed_on) AS e, coalesce(g.n, 0) > 0 AS has, coalesce(none, false) AS none, see, st.statute_id AS act, st.repealed_by AS heir, h.short_form AS heir_form
  FROM m LEFT JOIN se ON se.section_id = m.target LEFT JOIN st ON st.statute_id = coalesce(se.statute_id, CASE WHEN m.target NOT LIKE '%-s%' THEN m.target END) LEFT JOIN st h ON h.statute_id = st.repealed_by LEFT JOIN g ON g.f = se.section_id),
checked AS (SELECT *, CASE WHEN coalesce(section_id, CASE WHEN target NOT LIKE '%-s%' THEN act END) IS NULL THEN 'not_found|' || target || ' not in registry'
  WHEN status = 'omitted' AND sto IS NULL THEN CASE WHEN has THEN 'superseded' ELSE 'repealed' END || '|omitted from the statute; effective date not recorded in registry' || CASE WHEN has THEN '; see ' || see ELSE '' END
  WHEN as_of < a THEN 'not_found|not in force until ' || a WHEN as_of >= e AND section_id IS NOT NULL AND has THEN 'superseded|repealed ' || e || '; see ' || see
  WHEN as_of >= e AND section_id IS NOT NULL AND none THEN 'repealed|repealed ' || e || '; no corresponding provision' WHEN as_of >= e AND section_id IS NOT NULL THEN 'repealed|repealed ' || e || '; successor not recorded in registry'
  WHEN as_of >= e AND heir IS NOT NULL THEN 'superseded|repealed ' || e || '; see ' || coalesce(heir_form, heir) WHEN as_of >= e THEN 'repealed|repealed ' || e ELSE 'in_force|' END AS s FROM j)"""


@query(f"""WITH {_REG_SQL}, m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN 'act-' || (o_custkey % 120) ELSE 'act-' || (o_custkey % 90) || '-s' || (o_custkey + (o_orderkey % 3) * 90) END AS target, o_orderdate::DATE + 8000 AS as_of FROM orders), {_CHECKED_SQL}
SELECT id, target, split_part(s, '|', 1) AS status, nullif(split_part(s, '|', 2), '') AS note FROM checked""")
def registry_from_tables(spark, sf_dir):
    """Validity on a date against a registry read from tables: an act for each supplier, a section for each part; every fifth citation names an act."""
    st, se, su = registry_tables(spark, sf_dir)
    act = F.col("o_orderkey") % 5 == 4
    section = F.concat(F.lit("act-"), (F.col("o_custkey") % 90).cast("string"), F.lit("-s"), (F.col("o_custkey") + F.col("o_orderkey") % 3 * 90).cast("string"))
    target = F.when(act, F.concat(F.lit("act-"), (F.col("o_custkey") % 120).cast("string"))).otherwise(section)
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), target.alias("target_id"), F.when(act, "statute").otherwise("section").alias("target_type"), F.date_add(F.col("o_orderdate").cast("date"), 8000).alias("as_of"))
    return R.check(m, "as_of", se, st, su).select("id", F.col("target_id").alias("target"), "status", "note")


@query(f"WITH {_REG_SQL} SELECT t AS to_section_id, count(DISTINCT f) AS n_from, min(f) AS first_from FROM su WHERE t IS NOT NULL GROUP BY t")
def supersession_fanout(spark, sf_dir):
    """How many old sections a new one stands for."""
    s = registry_tables(spark, sf_dir)[2].where(F.col("to_section_id").isNotNull())
    return s.groupBy("to_section_id").agg(F.countDistinct("from_section_id").alias("n_from"), F.min("from_section_id").alias("first_from"))


@query(f"WITH {_REG_SQL} SELECT f AS from_section_id, min(t) AS successor FROM su WHERE t IS NOT NULL GROUP BY f HAVING count(DISTINCT t) = 1")
def unambiguous_successor(spark, sf_dir):
    return R.unambiguous_successors(registry_tables(spark, sf_dir)[2])


@query(f"""WITH {_REG_SQL} SELECT 'section_without_statute' AS problem, section_id AS id FROM se WHERE statute_id NOT IN (SELECT statute_id FROM st) UNION ALL SELECT 'repeated_section', section_id FROM se GROUP BY section_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'unknown_predecessor', f FROM su WHERE f NOT IN (SELECT section_id FROM se) UNION ALL SELECT DISTINCT 'unknown_successor', t FROM su WHERE t NOT IN (SELECT section_id FROM se)""")
def registry_problems(spark, sf_dir):
    st, se, su = registry_tables(spark, sf_dir)
    return R.registry_problems(st, se, su)


@query(f"""WITH {_REG_SQL}, c AS (SELECT 'act-' || (l_partkey % 90) || '-s' || l_partkey AS target, count(*) AS occurrences FROM lineitem GROUP BY 1)
SELECT su.f AS from_section_id, coalesce(a.heading, '') AS from_heading, relation, coalesce(su.t, '') AS to_section_id, coalesce(b.heading, '') AS to_heading, coalesce((SELECT sum(occurrences) FROM c WHERE c.target = su.f), 0)::BIGINT AS cites, (SELECT count(*) FROM su x WHERE x.f = su.f) AS fanout
FROM su LEFT JOIN se a ON a.section_id = su.f LEFT JOIN se b ON b.section_id = su.t""")
def supersession_enriched(spark, sf_dir):
    """Successions with both headings, citations and fan-out."""
    _, se, su = registry_tables(spark, sf_dir)
    k = F.col("l_partkey")
    cites = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("act-"), (k % 90).cast("string"), F.lit("-s"), k.cast("string")).alias("target_id")).agg(F.count("*").alias("occurrences"))
    return R.enriched_successions(su, se, cites)


@query(f"WITH {_REG_SQL} SELECT section_id, strftime(in_force_to, '%Y-%m-%d') AS in_force_to, t AS to_section_id, relation FROM se LEFT JOIN su ON su.f = se.section_id")
def section_successions(spark, sf_dir):
    _, se, su = registry_tables(spark, sf_dir)
    return se.join(su, F.col("from_section_id") == F.col("section_id"), "left").select("section_id", F.col("in_force_to").cast("string").alias("in_force_to"), "to_section_id", "relation")


@query(f"WITH {_REG_SQL} SELECT statute_id, count(*) AS n, count(heading) AS with_heading, round(100 * count(heading) / count(*)::DOUBLE, 2) AS percent FROM se GROUP BY statute_id")
def heading_coverage(spark, sf_dir):
    return registry_tables(spark, sf_dir)[1].groupBy("statute_id").agg(F.count("*").alias("n"), F.count("heading").alias("with_heading"), F.round(100 * F.count("heading") / F.count("*"), 2).alias("percent"))


@query("SELECT 'act-' || (l_partkey % 90) AS act_id, count(*) AS citations, count(DISTINCT l_partkey) AS distinct_sections FROM lineitem GROUP BY 1")
def sections_per_act(spark, sf_dir):
    """Citations and distinct sections of each act."""
    return table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("act-"), (F.col("l_partkey") % 90).cast("string")).alias("act_id")).agg(F.count("*").alias("citations"), F.countDistinct("l_partkey").alias("distinct_sections"))


@query(f"""WITH {_REG_SQL}, o AS (SELECT statute_id AS act, number FROM se WHERE number::BIGINT % 11 > 0 UNION ALL SELECT 'act-' || s_suppkey, 'x' || s_suppkey FROM supplier WHERE s_suppkey % 9 = 0), s AS (SELECT statute_id AS act, number FROM se)
SELECT 'spurious' AS kind, act, number FROM (SELECT * FROM s EXCEPT SELECT * FROM o) UNION ALL SELECT 'missing', act, number FROM (SELECT * FROM o EXCEPT SELECT * FROM s)""")
def section_validation(spark, sf_dir):
    """Sections that only the registry has, and those that only the official list has."""
    ours = registry_tables(spark, sf_dir)[1].select(F.col("statute_id").alias("act"), "number")
    k = F.col("s_suppkey").cast("string")
    official = ours.where("cast(number AS bigint) % 11 > 0").unionByName(table(spark, sf_dir, "supplier").where("s_suppkey % 9 = 0").select(F.concat(F.lit("act-"), k).alias("act"), F.concat(F.lit("x"), k).alias("number")))
    return ours.subtract(official).select(F.lit("spurious").alias("kind"), "act", "number").unionByName(official.subtract(ours).select(F.lit("missing").alias("kind"), "act", "number"))


@query("""WITH c AS (SELECT l_partkey AS raw, l_partkey % 5 > 0 AS resolved, count(*) AS n FROM lineitem GROUP BY ALL) SELECT resolved, raw, n FROM (SELECT *, row_number() OVER (PARTITION BY resolved ORDER BY n DESC, raw) AS r FROM c) WHERE r <= 8""")
def top_citations(spark, sf_dir):
    """The eight most frequent resolved and unresolved citations."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("raw")).agg(F.count("*").alias("n")).withColumn("resolved", F.col("raw") % 5 > 0)
    return c.withColumn("r", F.row_number().over(Window.partitionBy("resolved").orderBy(F.desc("n"), "raw"))).where("r <= 8").select("resolved", "raw", "n")


@query("""WITH o AS (SELECT l_partkey AS article, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber % 5 > 0 THEN TRY_CAST('19' || (50 + l_orderkey % 50) || '-' || lpad((l_orderkey % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((l_linenumber * 6)::VARCHAR, 2, '0') AS DATE) END AS d FROM lineitem)
SELECT article, strftime(arg_min(d, seq), '%Y-%m-%d') AS omitted_on FROM o WHERE d IS NOT NULL GROUP BY article""")
def first_omission(spark, sf_dir):
    """Dates like the 42nd of a month are passed over; the first real one stays."""
    o, l = F.col("l_orderkey"), F.col("l_linenumber")
    d = F.try_to_date(F.format_string("%d-%02d-%02d", o % 50 + 1950, o % 12 + 1, l * 6), "yyyy-MM-dd")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("article"), (o * 10 + l).alias("seq"), F.when(l % 5 > 0, d).alias("d"))
    return R.first_omissions(rows, "article", "seq", "d").select("article", F.col("d").cast("string").alias("omitted_on"))


@query("""WITH w AS (SELECT s_suppkey, lower(trim(regexp_replace(replace(s_name, '#', ', '), '[,\\s]+', ' ', 'g'))) AS k FROM supplier), c AS (SELECT c_custkey, lower(trim(regexp_replace(replace(replace(c_name, 'Customer', 'SUPPLIER'), '#', ' '), '\\s+', ' ', 'g'))) AS k, c_custkey % 3 > 0 AS central FROM customer)
SELECT s_suppkey AS registry_id, min(c_custkey) AS act FROM w JOIN c USING (k) WHERE central GROUP BY s_suppkey""")
def act_title_lookup(spark, sf_dir):
    """Central acts whose title is the wanted one but for case, commas and spaces; the first hit."""
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("registry_id"), R.title_key(F.replace("s_name", F.lit("#"), F.lit(", "))).alias("k"))
    found = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("act"), R.title_key(F.replace(F.replace("c_name", F.lit("Customer"), F.lit("SUPPLIER")), F.lit("#"), F.lit(" "))).alias("k"))
    return wanted.join(found, "k").groupBy("registry_id").agg(F.min("act").alias("act"))


@query(r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name END AS name FROM part""")
def metadata_values(spark, sf_dir):
    entry = F.array(F.struct(F.col("p_name").alias("value")), F.struct(F.lit("second").alias("value")))
    none = F.array().cast("array<struct<value:string>>")
    md = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("title"), entry)).when(F.col("p_partkey") % 3 == 1, F.create_map(F.lit("title"), none)).otherwise(F.create_map(F.lit("other"), entry))
    return table(spark, sf_dir, "part").select("p_partkey", records.first_value(md, "title").alias("name"))


@query("""SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN [p_partkey::VARCHAR, 'a'] WHEN 1 THEN ['d' || p_partkey] ELSE ['k' || p_size, 'z'] END) AS id FROM part""")
def split_file_ids(spark, sf_dir):
    """Ids of split files that are a list, an object with a list, or an object by id."""
    k = F.col("p_partkey")
    doc = F.when(k % 3 == 0, F.format_string('[%s, "a"]', k)).when(k % 3 == 1, F.format_string('{"seed": 1, "docs": ["d%s"]}', k)).otherwise(F.format_string('{"k%s": 1, "z": []}', F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(records.split_ids(doc)).alias("id"))


# ---- texts
_PARA_SQL = r"""t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) || chr(10) || ' ' || chr(10) || 'See Section ' || (doc_id % 90) || ' there.' AS t FROM documents)"""
_SECTION = r"(?i)\bsection\s+\d+"


@query(rf"""WITH {_PARA_SQL}, m AS ({spans_sql('t', _SECTION)}), b AS ({spans_sql('t', chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')})
SELECT m.doc_id, m.s AS place, 1 + (SELECT count(*) FROM b WHERE b.doc_id = m.doc_id AND b.e <= m.s) AS para FROM m""")
def paragraph_assignment(spark, sf_dir):
    """The paragraph in which each cited section stands."""
    body = F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n \nSee Section "), (F.col("doc_id") % 90).cast("string"), F.lit(" there."))
    texts = table(spark, sf_dir, "documents").select("doc_id", body.alias("text"))
    at = matches(texts, "doc_id", F.col("text"), _SECTION, 0).select("doc_id", F.col("match_start").cast("bigint").alias("place"))
    return entities.paragraph_of(at, texts, "doc_id", "text", "place").select("doc_id", "place", F.col("para").cast("bigint").alias("para"))


_NAMES = r"[A-Z][a-z]+ [A-Z][a-z]+"


@query(rf"""WITH t AS (SELECT doc_id, {F4_SQL} || ' Section 12 of Delhi Court. Section 12 Anna Bell' AS t FROM documents), a AS (SELECT doc_id, s, e, trim(value) AS v FROM ({spans_sql('t', entities.ENTITIES[2][1])}) WHERE length(trim(value)) > 2 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(trim(value)) ORDER BY s) = 1),
b AS (SELECT doc_id, s, e, value AS v FROM ({spans_sql('t', _NAMES)}))
SELECT doc_id, 'PROVISION' AS label, s AS span_start, e AS span_end, v AS entity FROM a UNION ALL SELECT doc_id, 'PERSON', s, e, v FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND b.s < a.e AND a.s < b.e)""")
def entity_merge(spark, sf_dir):
    """Provisions by pattern, and names where no provision stands."""
    texts = legal_texts(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" Section 12 of Delhi Court. Section 12 Anna Bell")).alias("text"))
    first = entities.legal_entities(texts, "doc_id", "text", [entities.ENTITIES[2]])
    second = matches(texts, "doc_id", F.col("text"), _NAMES, 0).select("doc_id", F.lit("PERSON").alias("label"), F.col("found").alias("entity_text"), F.col("match_start").alias("span_start"), F.col("match_end").alias("span_end"))
    got = entities.merged(first.select(*second.columns), second, "doc_id")
    return got.select("doc_id", "label", F.col("span_start").cast("bigint"), F.col("span_end").cast("bigint"), F.col("entity_text").alias("entity"))


@query(r"""WITH t AS (SELECT doc_id, source, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN chr(10) || ' Transcribe the page. and more' WHEN 1 THEN ' ' || chr(10) ELSE '' END AS t FROM documents)
SELECT doc_id, md5(t || chr(10) || chr(10) || source) AS joined_md5, 'Transcribe the page.' AS prompt, md5(CASE WHEN strpos(t, 'Transcribe the page.') > 0 THEN regexp_replace(substr(t, 1, strpos(t, 'Transcribe the page.') - 1), '\s+$', '') ELSE t END) AS cut_md5 FROM t""")
def leaked_prompt_cut(spark, sf_dir):
    """A prompt that a transcript repeats is cut off with all after it, any other text stays as it is; paragraphs of a list are joined by blank lines."""
    prompt = "Transcribe the page."
    tail = F.when(F.col("doc_id") % 3 == 0, f"\n {prompt} and more").when(F.col("doc_id") % 3 == 1, " \n").otherwise("")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.coalesce("text", F.lit("")), tail).alias("t"))
    return d.select("doc_id", F.md5(F.array_join(F.array("t", "source"), "\n\n")).alias("joined_md5"), F.lit(prompt).alias("prompt"), F.md5(records.cut_leak(F.col("t"), prompt)).alias("cut_md5"))


@query("""WITH c AS (SELECT doc_id, length(text) AS n, unnest(range(1, length(text) + 1)) AS i, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) >= 300),
v AS (SELECT doc_id, n, i, hash(string_agg(c, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)) AS g FROM c),
w AS (SELECT doc_id, n, i, md5(concat_ws(',', g, lead(g, 15) OVER o, lead(g, 30) OVER o, lead(g, 45) OVER o, lead(g, 60) OVER o, lead(g, 75) OVER o, lead(g, 90) OVER o, lead(g, 105) OVER o, lead(g, 120) OVER o, lead(g, 135) OVER o)) AS h FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, n, i, min(i) OVER (PARTITION BY doc_id, h) AS a FROM w WHERE i <= n - 149),
b AS (SELECT doc_id, min(i) AS i, arg_min(a, i) AS a FROM f WHERE a < i AND i > 150 AND i <= n - 150 GROUP BY doc_id)
SELECT doc_id, (i + 150 - a)::BIGINT AS n_chars, md5(substr(text, a, i + 150 - a)) AS block_md5 FROM b JOIN documents USING (doc_id)""")
def long_repeats(spark, sf_dir):
    """Documents in which a block of 150 characters stands again."""
    r = table(spark, sf_dir, "documents").select("doc_id", records.long_repeat(F.col("text")).alias("block"))
    return r.where("block IS NOT NULL").select("doc_id", F.length("block").cast("bigint").alias("n_chars"), F.md5("block").alias("block_md5"))


@query(r"""SELECT doc_id, coalesce(length(regexp_replace(text, '\P{L}', '', 'g')) >= 40 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '\P{L}', '', 'g')), 0)::DOUBLE >= 0.9::DOUBLE, false) AS english FROM documents""")
def english_pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", records.english_page(F.col("text")).alias("english"))


@query("SELECT doc_id, sha256(text) AS sha256, md5(left(text, 500)) AS audit_md5, md5(left(text, 1000)) AS risk_md5, md5(left(text, 3000)) AS judge_md5 FROM documents")
def checksums_and_limits(spark, sf_dir):
    """Checksums of whole texts, and the lengths at which an audit log, a risk model and a judge are shown less: there the limit is the feature."""
    cut = lambda n: F.md5(F.left("text", F.lit(n)))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), cut(500).alias("audit_md5"), cut(1000).alias("risk_md5"), cut(3000).alias("judge_md5"))


@query("""SELECT doc_id, CASE WHEN length(trim(text)) >= 100 THEN 'DIGITAL' WHEN trim(text) = '' THEN 'OCR_FAIL' ELSE 'OCR_NEEDED' END AS status, CASE WHEN trim(text) <> '' THEN ceil(length(text) / 400::DOUBLE)::BIGINT ELSE 0 END AS n_chunks FROM documents""")
def ingest_status(spark, sf_dir):
    """Texts of a hundred characters are digital, shorter ones need OCR; a failure stays a row and has no chunks."""
    t = F.trim("text")
    status = F.when(F.length(t) >= 100, "DIGITAL").when(t == "", "OCR_FAIL").otherwise("OCR_NEEDED")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", status.alias("status"))
    n = chunking.slices(d.where("status <> 'OCR_FAIL'").select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return d.select("doc_id", "status").join(n, "doc_id", "left").select("doc_id", "status", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


# ---- scope
@query("""WITH c AS (SELECT doc_id, source, n_chars, n_chars % 5 = 0 AND source <> 'src3' AS ix FROM documents) SELECT doc_id, source FROM c WHERE ix OR NOT (SELECT bool_or(x.ix) FROM c x WHERE x.source = c.source)""")
def searchable_chunks(spark, sf_dir):
    """Indexed rows of each owner, or all rows of an owner that has none."""
    c = table(spark, sf_dir, "documents").select("doc_id", "source", ((F.col("n_chars") % 5 == 0) & (F.col("source") != "src3")).alias("bm25_indexed"))
    return S.searchable(c, "source").select("doc_id", "source")


@query("""WITH w AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN len(list_filter([o_custkey * 3, o_custkey * 7], lambda x: list_contains(ids, x))) > 0 THEN array_to_string(list_sort(list_filter([o_custkey * 3, o_custkey * 7], lambda x: list_contains(ids, x))), ',') ELSE array_to_string(ids, ',') END AS scope FROM w WHERE o_custkey > 0""")
def scope_intersection(spark, sf_dir):
    """The requested ids that a corpus has, else the whole corpus."""
    w = table(spark, sf_dir, "orders").where("o_custkey > 0").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    asked = F.array(F.col("o_custkey") * 3, F.col("o_custkey") * 7)
    return w.select("o_custkey", F.array_join(F.array_sort(S.requested(asked, F.col("ids"))), ",").alias("scope"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, md5(text) AS text_md5 FROM conversations")
def ordered_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("text_md5"))
    return S.in_order(c, ["conv_id", "turn"]).withColumn("place", F.col("place").cast("bigint"))


@query("""SELECT event_id, k, split FROM (SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, CASE WHEN event_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM events) WHERE split = 'test'""")
def split_annotations(spark, sf_dir):
    """Rows of one split with their JSON decoded."""
    e = table(spark, sf_dir, "events").withColumn("split", F.when(F.col("event_id") % 10 == 0, "test").otherwise("train")).where("split = 'test'")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), "split")


@query("""WITH a AS (SELECT doc_id, lower(source) AS s FROM documents UNION ALL SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL) SELECT doc_id % 50 AS scope, string_agg(DISTINCT s, ',' ORDER BY s) AS vocabulary FROM a GROUP BY 1""")
def scope_vocabulary(spark, sf_dir):
    """All that the documents of a scope cite, of two kinds, once each."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("scope"), F.array_compact(F.array(F.lower("source"), F.col("lang"))).alias("v"))
    return d.groupBy("scope").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("v")))), ",").alias("vocabulary"))


# ---- generation


@query("""WITH r AS (SELECT p_partkey, ['c0', 'c1', 'c2', 'c3'][1 : 1 + p_partkey % 4] AS c, p_size FROM part), m AS (SELECT p_partkey, list_transform([1, 2, 3, 2, 1], lambda i: c[i]) || [CASE WHEN list_contains(c, 'c' || (p_size % 4)) THEN 'c' || (p_size % 4) END] AS m FROM r),
u AS (SELECT p_partkey, list_filter(m, lambda x: x IS NOT NULL) AS m FROM m) SELECT p_partkey, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') AS passages FROM u""")
def passage_ids(spark, sf_dir):
    """What a model's many ways to name a passage mean, in order of first mention."""
    chunks = F.slice(F.array(*[F.lit(f"c{i}") for i in range(4)]), F.lit(1), (F.col("p_partkey") % 4 + 1).cast("int"))
    raw = F.array(F.lit("p1"), F.lit(" [P2]"), F.lit("3"), F.lit("passage_p2"), F.lit("Passage_1"), F.concat(F.lit("c"), (F.col("p_size") % 4).cast("string")), F.lit("p9"), F.lit("[1"), F.lit("x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.resolve_passages(raw, chunks), ",").alias("passages"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(['Section ' || p_size, 'IPC', 'Section ' || (p_partkey % 9)])), '|') AS citations FROM part""")
def citation_union(spark, sf_dir):
    k, n = (F.col("p_partkey") % 9).cast("string"), F.col("p_size").cast("string")
    given, found = F.array(F.concat(F.lit(" Section "), n), F.lit("IPC "), F.lit("  ")), F.array(F.concat(F.lit("Section "), k), F.lit("IPC"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.all_citations(given, found), "|").alias("citations"))


@query("""WITH p AS (SELECT conv_id, turn, md5(text) AS m FROM conversations), c AS (SELECT conv_id, turn AS claim, unnest([2, 0, 1]) AS passage, unnest([1, 2, 3]) AS pos FROM conversations)
SELECT c.conv_id, c.claim, string_agg(p.m, ' ' ORDER BY pos) AS premise FROM c JOIN p ON p.conv_id = c.conv_id AND p.turn = c.passage GROUP BY ALL""")
def cited_premises(spark, sf_dir):
    """The texts of a claim's passages in the order in which it cites them."""
    t = table(spark, sf_dir, "conversations")
    passages = t.select("conv_id", F.col("turn").alias("passage_id"), F.md5("text").alias("text"))
    cl = t.select("conv_id", F.col("turn").alias("claim"), F.array(F.lit(2), F.lit(0), F.lit(1)).cast("array<bigint>").alias("passage_ids"))
    return C.premises(cl, passages, "conv_id", "claim")


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: length(x) > 0) AS w FROM documents), c AS (SELECT doc_id, unnest(range(0, CASE WHEN len(w) <= 300 THEN 1 ELSE ceil((len(w) - 300) / 250.0)::BIGINT * 250 + 1 END, 250)) // 250 AS window_no FROM w),
k AS (SELECT doc_id, x AS claim_no FROM documents, (VALUES (0), (1), (2)) v(x) WHERE x <= doc_id % 3)
SELECT doc_id, claim_no, count(*) AS n_windows, max((doc_id * 31 + claim_no * 7 + window_no * 13) % 100) AS best FROM k JOIN c USING (doc_id) GROUP BY ALL""")
def claim_premise_scores(spark, sf_dir):
    """Every claim of a pair against every window of its premise, and the best score."""
    d = table(spark, sf_dir, "documents")
    windows = chunking.word_windows(d.select("doc_id", "text"), "text").select("doc_id", F.col("window_no").cast("bigint"))
    cl = d.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("claim_no"))
    s = (F.col("doc_id") * 31 + F.col("claim_no") * 7 + F.col("window_no") * 13) % 100
    return C.premise_pairs(cl, windows, "doc_id").groupBy("doc_id", "claim_no").agg(F.count("*").alias("n_windows"), F.max(s).alias("best"))


_CATALOGUE = "cc(code, question, statute, tier) AS (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in C.CLAUSES) + ")"


@query(f"""WITH {_CATALOGUE}, w AS (SELECT doc_id, unnest(range(0, CASE WHEN length(text) <= 4000 THEN 1 ELSE ceil((length(text) - 4000) / 3500.0)::BIGINT * 3500 + 1 END, 3500)) AS ws FROM documents),
h AS (SELECT doc_id, ws, code, tier, (doc_id * 7 + ws * 3 + length(code) * 11) % 100 / 100::DOUBLE AS score, CASE WHEN (doc_id + length(code)) % 5 = 0 THEN ' ' ELSE 'answer ' || code END AS answer FROM w, cc),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY score DESC, ws) AS r FROM h WHERE score >= 0.15::DOUBLE AND trim(answer) <> '')
SELECT doc_id, code AS clause_type, ws + 3 AS span_start, ws + 3 + length(answer) AS span_end, score, tier FROM b WHERE r = 1""")
def best_clause_hits(spark, sf_dir):
    """The best answer for each clause type over all windows of a document."""
    catalogue = spark.createDataFrame([(c, t) for c, _, _, t in C.CLAUSES], "clause_type string, tier string")
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.window_starts(F.length("text"), 4000, 500)).alias("w")).select("doc_id", F.col("w").cast("bigint").alias("window_start"))
    h = d.crossJoin(F.broadcast(catalogue))  # twelve rows
    score = (F.col("doc_id") * 7 + F.col("window_start") * 3 + F.length("clause_type") * 11) % 100 / F.lit(100.0)
    answer = F.when((F.col("doc_id") + F.length("clause_type")) % 5 == 0, " ").otherwise(F.concat(F.lit("answer "), "clause_type"))
    h = h.select("doc_id", "clause_type", "window_start", answer.alias("answer"), F.lit(3).alias("answer_start"), (F.length(answer) + 3).alias("answer_end"), score.cast("double").alias("score"))
    return C.best_clauses(h, "doc_id").join(F.broadcast(catalogue), "clause_type").select("doc_id", "clause_type", "span_start", "span_end", "score", "tier")


@query(f"""WITH {_CATALOGUE}, q AS (SELECT DISTINCT code, unnest(regexp_extract_all(lower(question), '[a-z]{{3,}}')) AS w FROM cc), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(t), '[a-z]{{3,}}'))) AS w FROM (SELECT doc_id, {F4_SQL} AS t FROM documents)),
h AS (SELECT code, doc_id, count(*) AS n FROM q JOIN d USING (w) WHERE w NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)}) GROUP BY ALL)
SELECT code, question, statute, tier, count(h.doc_id) AS n_documents, coalesce(max(n), 0) AS most_words FROM cc LEFT JOIN h USING (code) GROUP BY ALL""")
def clause_catalogue(spark, sf_dir):
    """Each clause type with the documents that share a content word with its question."""
    catalogue = spark.createDataFrame(C.CLAUSES, "code string, question string, statute string, tier string")
    asked = catalogue.select("code", F.explode(F.array_distinct(T.content_words(F.col("question")))).alias("w"))
    words = legal_texts(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(T.content_words(F.col("text")))).alias("w"))
    hits = words.join(F.broadcast(asked), "w").groupBy("code", "doc_id").agg(F.count("*").alias("n")).groupBy("code").agg(F.count("*").alias("n_documents"), F.max("n").alias("most_words"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return catalogue.join(hits, "code", "left").select("code", "question", "statute", "tier", zero("n_documents"), zero("most_words"))


@query("SELECT item_id, condition, generator, retrieval, length(text)::BIGINT AS question_chars FROM benchmark, (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in C.CONDITIONS) + ") v(condition, generator, retrieval)")
def baseline_conditions(spark, sf_dir):
    """The work list of a comparison: every benchmark item under every condition."""
    row = lambda c: F.struct(*[F.lit(x).alias(n) for x, n in zip(c, ("condition", "generator", "retrieval"), strict=True)])
    items = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").cast("bigint").alias("question_chars"), F.explode(F.array(*[row(c) for c in C.CONDITIONS])).alias("c"))
    return items.select("item_id", "c.condition", "c.generator", "c.retrieval", "question_chars")


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 0 ELSE 1 END AS n_claims, CASE WHEN turn % 4 = 3 THEN 'empty_generation' ELSE '' END AS unanswerable, CASE WHEN turn % 4 = 3 THEN '' ELSE 'a,b' END AS citations FROM conversations""")
def generation_shapes(spark, sf_dir):
    """A blank answer has no claim and says why; any other is one claim with the statutes it names."""
    answer = F.when(F.col("turn") % 4 == 3, "  ").otherwise(F.col("text"))
    g = C.shaped_generation(answer, F.array(F.lit("c1")), F.array(F.lit("b"), F.lit("a"), F.lit("b")))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", g.alias("g"))
    return t.select("conv_id", "turn", F.size("g.claims").alias("n_claims"), F.array_join("g.unanswerable", ",").alias("unanswerable"), F.coalesce(F.array_join(F.get("g.claims", F.lit(0))["citations"], ","), F.lit("")).alias("citations"))


@query(f"""SELECT conv_id, string_agg('[p' || (turn + 1) || '] ' || md5(text), chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || '---' || chr(10) || '*{C.DISCLAIMER}*' AS prompt FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(text)) - 1 AS turn, text FROM conversations) GROUP BY conv_id""")
def context_and_disclaimer(spark, sf_dir):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("m")))), lambda t: t["m"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(texts.alias("t")).select("conv_id", C.with_disclaimer(C.context(F.col("t"))).alias("prompt"))


_PREAMBLE_SQL = "'" + C.PREAMBLE.replace("\n", "' || chr(10) || '") + "'"


@query(f"""WITH c AS (SELECT conv_id, turn, md5(text) AS m FROM conversations WHERE conv_id % 5 > 0), g AS (SELECT conv_id, string_agg('<document_chunk id="c' || turn || '">' || chr(10) || m || chr(10) || '</document_chunk>', chr(10) ORDER BY turn, m) AS b FROM c GROUP BY conv_id)
SELECT x.conv_id, CASE WHEN b IS NULL THEN '<untrusted_document_content>' || chr(10) || '</untrusted_document_content>' ELSE {_PREAMBLE_SQL} || chr(10) || '<untrusted_document_content>' || chr(10) || b || chr(10) || '</untrusted_document_content>' END AS fenced FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN g USING (conv_id)""")
def fence_with_preamble(spark, sf_dir):
    """Chunks between tags after the notice; every fifth conversation has none."""
    chunk = F.struct("turn", F.md5("text").alias("m"))
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("conv_id") % 5 > 0, chunk))).alias("c"))
    return t.select("conv_id", C.fence(F.transform("c", lambda x: F.struct(F.concat(F.lit("c"), x["turn"].cast("string")).alias("id"), x["m"].alias("text")))).alias("fenced"))


@query("""WITH t AS (SELECT conv_id, turn, upper(substr(md5(text), 1, 8)) AS s FROM conversations) SELECT conv_id, 'SECTION' AS kind, turn AS segment_no, s AS summary FROM t UNION ALL SELECT conv_id, 'FINAL', -1, md5(string_agg(s, chr(10) || chr(10) ORDER BY turn, s)) FROM t GROUP BY conv_id""")
def map_reduce_summary(spark, sf_dir):
    """A stub model for each segment and for the whole: digests in place of summaries."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("segment_no"), "text")
    return C.summarise(t, "conv_id", lambda c: F.upper(F.left(F.md5(c), F.lit(8))), F.md5)


# ---- sides of a cutoff, sheets, counts
@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN make_date((1990 + doc_id % 40)::INT, 1, 1) END AS day, doc_id % 2 = 0 AS first FROM documents)
SELECT CASE WHEN first THEN 'model-a' ELSE 'model-b' END AS model, count(*) FILTER (day < CASE WHEN first THEN DATE '2021-09-01' ELSE DATE '2005-01-01' END) AS pre_cutoff, count(*) FILTER (day >= CASE WHEN first THEN DATE '2021-09-01' ELSE DATE '2005-01-01' END) AS post_cutoff, count(*) FILTER (day IS NULL) AS undated_skipped FROM d GROUP BY 1""")
def contamination_split(spark, sf_dir):
    """Documents before and after each model's training cutoff; undated ones are counted apart."""
    cutoffs = {"model-a": "2021-09-01", "model-b": "2005-01-01"}
    k = F.col("doc_id")
    text = F.when(k % 4 > 0, F.concat(F.lit("Judgment delivered on 15th January, "), (k % 40 + 1990).cast("string"), F.lit("."))).otherwise("undated")
    d = table(spark, sf_dir, "documents").select(F.when(k % 2 == 0, "model-a").otherwise("model-b").alias("model"), records.header_date(text).alias("day"))
    out = None
    for m in cutoffs:
        side = records.cutoff_side(F.col("day"), records.model_cutoff(m, cutoffs))
        one = d.where(F.col("model") == m).groupBy("model").agg(*[F.count_if(side == s).alias(s) for s in ("pre_cutoff", "post_cutoff", "undated_skipped")])
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'H' || lpad(row_number() OVER (PARTITION BY quality ORDER BY sha256('9:' || doc_id), doc_id)::VARCHAR, 6, '0') || '-' || quality AS item_id, 'text ' || doc_id AS shown FROM labels WHERE quality IS NOT NULL QUALIFY row_number() OVER (PARTITION BY quality ORDER BY sha256('9:' || doc_id), doc_id) <= 100""")
def blind_sheet(spark, sf_dir):
    """A hundred accepted and a hundred rejected rows for a rater, without the verdict's source; the key stays apart."""
    order = F.sha2(F.concat(F.lit("9:"), F.col("doc_id").cast("string")), 256)
    n = F.row_number().over(Window.partitionBy("quality").orderBy(order, "doc_id"))
    l = table(spark, sf_dir, "labels").where("quality IS NOT NULL").withColumn("n", n).where("n <= 100")
    return l.select(F.concat(F.lit("H"), F.lpad(F.col("n").cast("string"), 6, "0"), F.lit("-"), F.col("quality").cast("string")).alias("item_id"), F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("shown"))


@query("""SELECT query_id, doc_id, rank AS rerank_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r) AS rank FROM (SELECT o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, (o_orderkey % 7) * 10.0::DOUBLE - 20 AS s FROM orders) WHERE s >= -10) WHERE rank <= 5""")
def rerank_topk(spark, sf_dir):
    """The best five by a reranker's score above the floor; equal scores keep the order of retrieval."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))
    c = o.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return retrieval.rerank(c, F.col("doc_id") % 7 * 10.0 - 20, floor=-10.0).select("query_id", "doc_id", F.col("rerank_rank").cast("bigint"))


@query("SELECT o_custkey AS doc_id, max((o_orderkey * 31) % 97 / 10::DOUBLE - 5) AS top_logit FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def top_rerank_logit(spark, sf_dir):
    """The best score of a document's indexed chunks."""
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.max(F.col("o_orderkey") * 31 % 97 / F.lit(10.0).cast("double") - 5).alias("top_logit"))


@query(evaluation_queries.SQL["duplicate_components"])
def minhash_lsh(spark, sf_dir):
    """One row per document with shingles that is near another: its class by verified MinHash pairs; tests measure recall against the exact pairs."""
    pairs = corpus.minhash_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return corpus.components(pairs).select(F.col("node").alias("doc_id"), "root")


@query(f"WITH {evaluation_queries._SH} SELECT a, b, jaccard FROM near WHERE jaccard >= 0.95")
def minhash_pairs(spark, sf_dir):
    """Verified MinHash pairs at 0.95 and above, where a band is missed once in thirty million pairs."""
    return corpus.minhash_pairs(table(spark, sf_dir, "documents"), "doc_id", "text").where("jaccard >= 0.95")
