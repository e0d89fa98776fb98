"""Queries over single records, nested values, set algebra and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions import measures as M
from lexloom.functions import text as T
from lexloom.operators import claims as C
from lexloom.operators import evaluation as E
from lexloom.operators import records as R
from lexloom.operators.ordering import ranked, ranked_within
from lexloom.sources.files import html_rows
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


@query(r"""WITH h AS (SELECT p_partkey, '<table><tr><th>New</th><th>Old</th></tr><tr><td> ' || p_size || '.  Title </td><td>' || p_partkey || 'A. <b>Old</b></td></tr><tr><td> </td><td></td></tr></table>' AS h FROM part),
r AS (SELECT p_partkey, unnest(list_filter(list_transform(regexp_extract_all(h, '(?is)<tr\b.*?</tr>'), lambda r: list_transform(regexp_extract_all(r, '(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(regexp_replace(c, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')))), lambda x: array_to_string(x, '') <> '')) AS c FROM h)
SELECT p_partkey, len(c) AS n_cells, array_to_string(c, '|') AS cells FROM r""")
def html_table_rows(spark, sf_dir):
    h = F.concat(F.lit("<table><tr><th>New</th><th>Old</th></tr><tr><td> "), F.col("p_size").cast("string"), F.lit(".  Title </td><td>"), F.col("p_partkey").cast("string"), F.lit("A. <b>Old</b></td></tr><tr><td> </td><td></td></tr></table>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(html_rows(h)).alias("c"))
    return rows.select("p_partkey", F.size("c").cast("bigint").alias("n_cells"), F.array_join("c", "|").alias("cells"))


# cells built from columns; for each kind of row: left cell, right cell, class, new section numbers, and the headings of the right cell
_ROWS = (
    ("'Bharatiya Nyaya Sanhita'", "'Indian Penal Code'", "header", "''", "''"),
    ("'CHAPTER ' || p_size", "'Of offences'", "chapter", "''", "''"),
    ("'General'", "'Part ' || p_size", "chapter", "''", "''"),
    ("'Schedule'", "'420. Cheating'", "chapter", "''", "'420=Cheating'"),
    ("n || '. Cheating'", "o || 'A. Cheating by  person'", "maps_to", "n || ''", "o || 'A=Cheating by person'"),
    ("n || '- Theft 7 days ' || (n + 1) || '. Robbery'", "o || '. Theft'", "maps_to", "n || ',' || (n + 1)", "o || '=Theft'"),
    ("'Deleted'", "o || 'B. Sedition ' || (o + 1) || '- Conspiracy, see section 9. there'", "repealed_no_successor", "''", "o || 'B=Sedition,' || (o + 1) || '=Conspiracy, see section 9. there'"),
    ("''", "o || '. Old offence. Repealed'", "repealed_no_successor", "''", "o || '=Old offence. Repealed'"),
    ("n || '. Organised crime'", "'New Section'", "new_provision", "n || ''", "''"),
    ("n || '. Snatching'", "'New provision'", "new_provision", "n || ''", "''"),
    ("'no number'", "'New sub-section'", "unparsed", "''", "''"),
    ("n || '(2) child'", "o || '. Man'", "maps_to", "n || ''", "o || '=Man'"),
    ("n || '. Rape, see section 84. of the Sanhita, 2023.'", "o || '. Omitted'", "maps_to", "n || ''", "''"),
    ("'nothing here'", "'nothing there'", "unparsed", "''", "''"),
)
_BASE = "SELECT p_partkey, p_size, p_partkey % 14 AS kind, 100 + p_partkey % 300 AS n, 100 + p_size AS o FROM part"
_CASE = lambda i: "CASE kind " + " ".join(f"WHEN {k} THEN {r[i] if i != 2 else repr(r[i])}" for k, r in enumerate(_ROWS)) + " END"


def _cells(spark, sf_dir):
    base = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 14).alias("kind"), (F.col("p_partkey") % 300 + 100).alias("n"), (F.col("p_size") + 100).alias("o"))
    return base.select("p_partkey", F.expr(_CASE(0)).alias("l"), F.expr(_CASE(1)).alias("r"))


@query(f"SELECT p_partkey, {_CASE(2)} AS row_class, {_CASE(3)} AS new_sections FROM ({_BASE})")
def correspondence_rows(spark, sf_dir):
    return _cells(spark, sf_dir).select("p_partkey", R.correspondence_class(F.col("l"), F.col("r")).alias("row_class"), F.array_join(R.operative_sections(F.col("l")), ",").alias("new_sections"))


@query(f"SELECT {_CASE(2)} AS row_class, count(*) AS n FROM ({_BASE}) GROUP BY 1")
def parse_stats(spark, sf_dir):
    return _cells(spark, sf_dir).groupBy(R.correspondence_class(F.col("l"), F.col("r")).alias("row_class")).agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, {_CASE(4)} AS headings FROM ({_BASE})")
def section_headings(spark, sf_dir):
    """The heading of each operative number: from its end to the start of the next."""
    h = F.transform(R.section_headings(F.col("r")), lambda x: F.concat(x["number"], F.lit("="), x["heading"]))
    return _cells(spark, sf_dir).select("p_partkey", F.array_join(h, ",").alias("headings"))


_DATED = "CASE doc_id % 3 WHEN 0 THEN 'Judgment delivered on 15th January, ' || (1950 + doc_id % 90) || '. ' ELSE '' END || text"


@query(f"""WITH y AS (SELECT doc_id, nullif(regexp_extract(regexp_extract(left({_DATED}, 1000), '(?i)(?:delivered\\s+on|pronounced\\s+on|decided\\s+on|dated)\\s*[:\\-]?\\s*([^\\n.]{{0,40}})', 1), '\\b((?:18|19|20)\\d{{2}})\\b', 1), '') AS y FROM documents)
SELECT doc_id, y || '-01-01' AS decision_date, CASE WHEN y IS NULL THEN 'undated_skipped' WHEN make_date(y::INT, 1, 1) < DATE '2021-09-01' THEN 'pre_cutoff' ELSE 'post_cutoff' END AS side FROM y""")
def header_date_split(spark, sf_dir):
    day = R.header_date(F.expr(_DATED))
    return table(spark, sf_dir, "documents").select("doc_id", day.alias("d")).select("doc_id", F.col("d").cast("string").alias("decision_date"), R.cutoff_side(F.col("d"), F.lit("2021-09-01").cast("date")).alias("side"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '2024-7-' || (1 + p_size % 28) || ' x' WHEN 1 THEN (1 + p_size % 28) || '-07-2024' WHEN 2 THEN (1 + p_size % 28) || '/7/2024' ELSE 'no date' END AS v, 1 + p_size % 28 AS d FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN '2024-07-' || lpad(d::VARCHAR, 2, '0') END AS parsed FROM t""")
def date_parse(spark, sf_dir):
    d = (F.col("p_size") % 28 + 1).cast("string")
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, F.concat(F.lit("2024-7-"), d)).when(k == 1, F.concat(d, F.lit("-07-2024"))).when(k == 2, F.concat(d, F.lit("/7/2024"))).otherwise("no date")
    return table(spark, sf_dir, "part").select("p_partkey", M.parse_date(v).cast("string").alias("parsed"))


@query(r"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || text ELSE '' END AS t FROM documents),
c AS (SELECT doc_id, t, CASE WHEN length(t) > 40 THEN strpos(substr(t, 41), left(t, 40)) ELSE 0 END AS pos FROM t)
SELECT doc_id, md5(CASE WHEN pos > 0 THEN rtrim(left(t, pos + 39), ' ') ELSE t END) AS cut_md5 FROM c""")
def loop_cut(spark, sf_dir):
    """Whole texts, half of them followed by themselves."""
    t = F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n"), "text")).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.md5(R.cut_loop(F.col("t"))).alias("cut_md5"))


@query("""WITH RECURSIVE t AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM documents),
s AS (SELECT doc_id, p, 0 AS i, '' AS buf, []::VARCHAR[] AS out FROM t UNION ALL SELECT doc_id, p, i + 1, CASE WHEN length(buf) + length(p[i + 1]) > 3000 THEN p[i + 1] ELSE buf || chr(10) || chr(10) || p[i + 1] END, CASE WHEN length(buf) + length(p[i + 1]) > 3000 THEN list_append(out, buf) ELSE out END FROM s WHERE i < len(p))
SELECT doc_id, len(list_filter(list_append(out, buf), lambda x: regexp_matches(x, '\\S'))) AS n_segments, md5(array_to_string(list_filter(list_append(out, buf), lambda x: regexp_matches(x, '\\S')), '|')) AS segments_md5 FROM s WHERE i = len(p)""".replace("\\\\S", "\\S"))
def paragraph_segments(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", R.segments(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n_segments"), F.md5(F.array_join("s", "|")).alias("segments_md5"))


@query("SELECT p_partkey, ['329A', '32A', '21', NULL][p_partkey % 4 + 1] AS repaired FROM part")
def footnote_numbers(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("3329A", "132A", "21", "x9")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    known = F.array(*[F.lit(x) for x in ("32A", "21", "329A")])
    return table(spark, sf_dir, "part").select("p_partkey", R.footnote_repair(raw, known).alias("repaired"))


@query(r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"a": ' || p_size || '}' WHEN 1 THEN '{"b": {"c": 1}}' ELSE 'plain' END AS body FROM part""")
def outer_json(spark, sf_dir):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit('text ```json\n{"a": '), F.col("p_size").cast("string"), F.lit("}\n``` more"))).when(k == 1, F.lit('Sure {"b": {"c": 1}} ok')).otherwise("  plain ")
    return table(spark, sf_dir, "part").select("p_partkey", T.outer_json(raw).alias("body"))


@query("SELECT p_partkey, ['correct', 'wrong', 'unclear', NULL][p_partkey % 4 + 1] AS verdict FROM part")
def verdict_normalise(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(x) for x in (" Correct!", "WRONG - see 12", "unclear?", "n/a")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", R.verdict(raw).alias("verdict"))


@query("""SELECT conv_id, '<untrusted_document_content>' || chr(10) || string_agg('[p' || turn || '] ' || md5(text), chr(10) ORDER BY turn, md5(text)) || chr(10) || '</untrusted_document_content>' AS fenced FROM conversations GROUP BY conv_id""")
def fence_untrusted(spark, sf_dir):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("m")))), lambda c: F.concat(F.lit("[p"), c["turn"].cast("string"), F.lit("] "), c["m"]))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(lines.alias("l"))
    return g.select("conv_id", F.concat(F.lit("<untrusted_document_content>\n"), F.array_join("l", "\n"), F.lit("\n</untrusted_document_content>")).alias("fenced"))


@query("""WITH a AS (SELECT DISTINCT lang AS k FROM documents WHERE doc_id % 2 = 0 UNION SELECT source FROM documents WHERE doc_id % 3 = 0), b AS (SELECT source AS k FROM documents WHERE doc_id % 4 = 0)
SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_common, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b))::DOUBLE / (SELECT count(*) FROM a) >= 0.7::DOUBLE AS covered""")
def corpus_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.where("doc_id % 2 = 0").select(F.col("lang").alias("k")).unionByName(d.where("doc_id % 3 = 0").select(F.col("source").alias("k"))).distinct()
    n = a.agg(F.count("*").alias("n_left"))
    m = a.intersect(d.where("doc_id % 4 = 0").select(F.col("source").alias("k"))).agg(F.count("*").alias("n_common"))
    return n.crossJoin(m).withColumn("covered", F.col("n_common") / F.col("n_left") >= 0.7)  # one row each


@query("""SELECT 'spurious' AS side, k FROM (SELECT p_brand AS k FROM part WHERE p_size < 30 EXCEPT SELECT p_brand FROM part WHERE p_size > 20) UNION ALL SELECT 'missing', k FROM (SELECT p_brand AS k FROM part WHERE p_size > 20 EXCEPT SELECT p_brand FROM part WHERE p_size < 30)""")
def set_difference(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a, b = p.where("p_size < 30").select(F.col("p_brand").alias("k")), p.where("p_size > 20").select(F.col("p_brand").alias("k"))
    return a.subtract(b).select(F.lit("spurious").alias("side"), "k").unionByName(b.subtract(a).select(F.lit("missing").alias("side"), "k"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM documents)
SELECT count(*) AS n_shared FROM (SELECT doc_id FROM s GROUP BY doc_id HAVING count(DISTINCT split) > 1)""")
def split_disjoint(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test").alias("split"))
    return s.groupBy("doc_id").agg(F.countDistinct("split").alias("n")).where("n > 1").agg(F.count("*").alias("n_shared"))


@query("""SELECT conv_id, turn, (length(text) + 40) // 4 AS tokens, round((length(text) + 40) // 4 * 2e-7::DOUBLE, 9) AS usd FROM conversations""")
def pipeline_cost(spark, sf_dir):
    n = F.floor((F.length("text") + 40) / 4)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n.cast("bigint").alias("tokens"), F.round(n * 2e-7, 9).alias("usd"))


@query("""WITH t AS (SELECT source, sum(n_chars) AS c FROM documents GROUP BY source), p(tier, price) AS (VALUES ('small', 0.1::DOUBLE), ('large', 2.5::DOUBLE)) SELECT source, tier, round(c // 4 * price / 1000000, 6) AS usd FROM t, p""")
def cost_tiers(spark, sf_dir):
    t = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("c"))
    prices = F.array(F.struct(F.lit("small").alias("tier"), F.lit(0.1).alias("price")), F.struct(F.lit("large").alias("tier"), F.lit(2.5).alias("price")))
    return t.select("source", "c", F.inline(prices)).select("source", "tier", F.round(F.floor(F.col("c") / 4) * F.col("price") / 1000000, 6).alias("usd"))


@query("""WITH u AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label)
SELECT m.label, i AS dim, round(x / n.n, 6) AS value FROM m JOIN n USING (label)""")
def mean_pool_normalise(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = u.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    n = m.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return m.join(n, "label").select("label", (F.col("i") + 1).cast("bigint").alias("dim"), F.round(F.col("x") / F.col("n"), 6).alias("value"))


@query("""SELECT doc_id, rater, row_number() OVER (PARTITION BY rater ORDER BY sha256('42:' || rater || ':' || doc_id), doc_id) AS place FROM labels, (VALUES ('r1'), ('r2')) v(rater)""")
def rater_queue_order(spark, sf_dir):
    order = F.sha2(F.concat(F.lit("42:"), "rater", F.lit(":"), F.col("doc_id").cast("string")), 256)
    q = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.lit("r1"), F.lit("r2"))).alias("rater")).withColumn("o", order)
    return ranked_within(q, "rater", F.col("o"), F.col("doc_id")).select("doc_id", "rater", (F.col("rank") + 1).alias("place"))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY regexp_extract(p_size || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE '' END, '^(\\d+)', 1)::INT, p_size || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE '' END, p_partkey) AS place FROM part""")
def numeric_prefix_order(spark, sf_dir):
    n = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "A").otherwise(""))
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 10).alias("g"), F.regexp_extract(n, r"^(\d+)", 1).cast("int").alias("i"), n.alias("n"))
    return ranked_within(p, "g", F.col("i"), F.col("n"), F.col("p_partkey")).select("p_partkey", (F.col("rank") + 1).alias("place"))


_MAP = "'{\"facts\": \"f' || doc_id || '\", \"statute\": \"\", \"analysis\": \"a\"}'"


@query(f"""SELECT doc_id, k AS section, v AS generated FROM (SELECT doc_id, unnest(['facts', 'analysis']) AS k, unnest(['f' || doc_id, 'a']) AS v FROM documents)""")
def section_rows(spark, sf_dir):
    """Sections of a JSON map, also when wrapped in a one-element list; empty ones are left out."""
    obj = F.expr(_MAP)
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), obj, F.lit("]"))).otherwise(obj)
    parsed = F.coalesce(F.from_json(F.when(~raw.startswith("["), raw), "map<string,string>"), F.get(F.from_json(F.when(raw.startswith("["), raw), "array<map<string,string>>"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(parsed).alias("section", "generated")).where(F.length("generated") > 0)


@query("""SELECT p_partkey, (p_size % 3 >= 1)::INT + 1 AS n_relevant, (p_size % 3)::INT + 2 AS gain_sum FROM part""")
def judgment_maps(spark, sf_dir):
    m = F.create_map(F.lit("c1"), (F.col("p_size") % 3).cast("int"), F.lit("c2"), F.lit(2), F.lit("c3"), F.lit(0))
    rel = F.map_filter(m, lambda k, v: v >= 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(rel).alias("n_relevant"), F.aggregate(F.map_values(rel), F.lit(0), lambda a, x: a + x).alias("gain_sum"))


@query("""SELECT p_partkey, '{"a":' || p_size || ',"b":1}' AS label_key FROM part""")
def label_key(spark, sf_dir):
    m = F.create_map(F.lit("b"), F.lit(1).cast("bigint"), F.lit("a"), F.col("p_size").cast("bigint"))
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))).alias("label_key"))


@query("""SELECT DISTINCT o.x AS from_section, n.y AS to_section FROM part, (VALUES (0), (1)) o0(i), (VALUES (0), (1)) n0(j), LATERAL (SELECT 'old-' || (p_size + i) AS x) o, LATERAL (SELECT 'new-' || (p_size % 7 + j) AS y) n""")
def mapping_product(spark, sf_dir):
    olds = F.array(F.concat(F.lit("old-"), F.col("p_size").cast("string")), F.concat(F.lit("old-"), (F.col("p_size") + 1).cast("string")))
    news = F.array(F.concat(F.lit("new-"), (F.col("p_size") % 7).cast("string")), F.concat(F.lit("new-"), (F.col("p_size") % 7 + 1).cast("string")))
    return table(spark, sf_dir, "part").select(F.explode(olds).alias("from_section"), news.alias("n")).select("from_section", F.explode("n").alias("to_section")).distinct()


@query("""WITH p AS (SELECT doc_id, lower(source) AS t, lang AS label FROM documents WHERE doc_id % 3 > 0), g AS (SELECT doc_id, source AS t, lang AS label FROM documents WHERE doc_id % 2 = 0),
x AS (SELECT coalesce(p.label, g.label) AS label, count(*) FILTER (p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.t = g.t AND p.label = g.label GROUP BY 1)
SELECT label, tp, fp, fn, round(tp::DOUBLE / (tp + fp), 4) AS precision, round(tp::DOUBLE / (tp + fn), 4) AS recall, round(2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)), 4) AS f1 FROM x""")
def ner_f1(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = d.where("doc_id % 3 > 0").select("doc_id", F.lower("source").alias("t"), F.col("lang").alias("label"), F.lit(1).alias("p"))
    g = d.where("doc_id % 2 = 0").select("doc_id", F.col("source").alias("t"), F.col("lang").alias("label"), F.lit(1).alias("g"))
    c = p.join(g, ["doc_id", "t", "label"], "full").groupBy("label").agg(F.count(F.col("p") + F.col("g")).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    a, b, f = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("label", "tp", "fp", "fn", a.alias("precision"), b.alias("recall"), f.alias("f1"))


@query("""WITH s AS (SELECT p_partkey AS k, list_filter(['a', 'b', CASE WHEN p_size % 2 = 0 THEN 'c' ELSE 'a' END], lambda x: p_partkey % 5 > 0) AS p, list_filter(['b', 'c', 'd'], lambda x: p_partkey % 3 > 0) AS g FROM part),
r AS (SELECT len(list_intersect(p, g)) AS i, len(list_distinct(p)) AS np, len(g) AS ng FROM s)
SELECT round(avg(CASE WHEN ng > 0 THEN i::DOUBLE / ng WHEN np = 0 THEN 1 ELSE 0 END), 4) AS citation_recall, round(avg(CASE WHEN np > 0 THEN i::DOUBLE / np WHEN ng = 0 THEN 1 ELSE 0 END), 4) AS citation_precision FROM r""")
def citation_recall_precision(spark, sf_dir):
    empty = F.array().cast("array<string>")
    p = F.when(F.col("p_partkey") % 5 > 0, F.array(F.lit("a"), F.lit("b"), F.when(F.col("p_size") % 2 == 0, "c").otherwise("a"))).otherwise(empty)
    g = F.when(F.col("p_partkey") % 3 > 0, F.array(F.lit("b"), F.lit("c"), F.lit("d"))).otherwise(empty)
    r = table(spark, sf_dir, "part").select(F.size(F.array_intersect(p, g)).alias("i"), F.size(F.array_distinct(p)).alias("np"), F.size(g).alias("ng"))
    rec = F.when(F.col("ng") > 0, F.col("i") / F.col("ng")).otherwise((F.col("np") == 0).cast("double"))
    pre = F.when(F.col("np") > 0, F.col("i") / F.col("np")).otherwise((F.col("ng") == 0).cast("double"))
    return r.agg(F.round(F.avg(rec), 4).alias("citation_recall"), F.round(F.avg(pre), 4).alias("citation_precision"))


@query("""WITH b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'h' || s_suppkey END AS heading FROM supplier) SELECT s_suppkey, coalesce(heading, 'backfilled') || CASE WHEN heading IS NULL THEN '; source: table' ELSE '' END AS heading FROM b""")
def conditional_backfill(spark, sf_dir):
    h = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("h"), F.col("s_suppkey").cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(h, F.lit("backfilled; source: table")).alias("heading"))


@query("""WITH h AS (SELECT l_partkey AS section, l_linenumber AS seq, repeat('h', (l_quantity % 7)::INT + 1) || l_linenumber AS heading, l_orderkey FROM lineitem)
SELECT section, heading FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY length(heading) DESC, l_orderkey, seq) AS n FROM h) WHERE n = 1""")
def longest_heading(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("section"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("seq"), F.concat(F.repeat(F.lit("h"), (F.col("l_quantity") % 7).cast("int") + 1), F.col("l_linenumber").cast("string")).alias("heading"))
    return h.groupBy("section").agg(F.max_by("heading", F.struct(F.length("heading"), -F.col("o"), -F.col("seq"))).alias("heading"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, (o_orderkey * 31) % 101 AS score FROM orders) SELECT o_custkey, o_orderkey, score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS n FROM c) WHERE n <= 3""")
def per_document_cap(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") * 31 % 101).alias("score"))
    return c.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("score"), "o_orderkey"))).where("n <= 3").drop("n")


@query("""WITH s AS (SELECT p_partkey, (CASE WHEN p_partkey % 2 = 0 THEN 'single-source' ELSE 'cross-validated' END) || ' | ' || (CASE WHEN p_size >= 45 THEN 'high-cited' ELSE 'low-cited' END) AS stratum FROM part)
SELECT p_partkey, stratum, CASE WHEN stratum LIKE '%single-source%' AND stratum LIKE '%high-cited%' THEN '1-critical' WHEN stratum LIKE '%single-source%' THEN '2-high' WHEN stratum LIKE '%high-cited%' THEN '3-medium' ELSE '4-routine' END AS priority FROM s""")
def audit_priority(spark, sf_dir):
    single, high = F.col("p_partkey") % 2 == 0, F.col("p_size") >= 45
    stratum = F.concat_ws(" | ", F.when(single, "single-source").otherwise("cross-validated"), F.when(high, "high-cited").otherwise("low-cited"))
    return table(spark, sf_dir, "part").select("p_partkey", stratum.alias("stratum"), F.when(single & high, "1-critical").when(single, "2-high").when(high, "3-medium").otherwise("4-routine").alias("priority"))


@query("""SELECT 'W' || lpad(row_number() OVER (ORDER BY p_size DESC, p_partkey)::VARCHAR, 8, '0') AS row_id, p_partkey FROM part""")
def worksheet_rows(spark, sf_dir):
    """A sheet for human raters: its rows are numbered in one order."""
    p = ranked(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.desc("p_size"), F.col("p_partkey"))
    return p.select(F.concat(F.lit("W"), F.lpad((F.col("rank") + 1).cast("string"), 8, "0")).alias("row_id"), "p_partkey")


@query("""WITH s AS (SELECT c.conv_id, a.turn AS claim, b.turn AS passage, len(list_intersect(regexp_extract_all(lower(a.text), '[a-z]{3,}'), regexp_extract_all(lower(b.text), '[a-z]{3,}'))) AS hits, len(list_distinct(regexp_extract_all(lower(a.text), '[a-z]{3,}'))) AS n
 FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN conversations a USING (conv_id) JOIN conversations b USING (conv_id) WHERE a.turn <> b.turn),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, claim ORDER BY hits DESC, passage) AS r FROM s)
SELECT conv_id, claim, passage, hits FROM k WHERE r = 1 AND n > 0 AND hits::DOUBLE / n >= 0.35::DOUBLE""")
def claim_passage_match(spark, sf_dir):
    """The turn of the same conversation that shares most words; pairs stay within a conversation."""
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", w.alias("w"))
    pairs = c.select("conv_id", F.col("turn").alias("claim"), F.col("w").alias("cw")).join(c.select("conv_id", F.col("turn").alias("passage"), "w"), "conv_id").where("claim <> passage")
    pairs = pairs.withColumn("hits", F.size(F.array_intersect("cw", "w"))).withColumn("overlap", F.coalesce(F.try_divide(F.col("hits"), F.size("cw")), F.lit(0.0))).withColumn("key", F.struct("conv_id", "claim"))
    return R.best_window(pairs, "key", "passage", "passage", "hits").select("conv_id", "claim", "passage", F.col("hits").cast("bigint").alias("hits"))


@query("""WITH a AS (SELECT event_id, user_id % 40 AS item, event_type AS rater, CASE WHEN value > 50 THEN 'yes' ELSE 'no' END AS label, ts FROM events),
l AS (SELECT item, rater, label FROM (SELECT *, row_number() OVER (PARTITION BY item, rater ORDER BY ts DESC, event_id DESC) AS n FROM a) WHERE n = 1),
c AS (SELECT item, label, count(*) AS c FROM l GROUP BY ALL), m AS (SELECT *, max(c) OVER (PARTITION BY item) AS best, sum(c) OVER (PARTITION BY item) AS total FROM c)
SELECT item, min(label) AS label, max(total)::BIGINT AS n_annotations, count(*) > 1 AS tie FROM m WHERE c = best GROUP BY item HAVING max(total) >= 2""")
def annotation_export(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("item"), F.col("event_type").alias("rater"), F.when(F.col("value") > 50, "yes").otherwise("no").alias("label"), "ts")
    l = E.latest(a, ["item", "rater"], [F.col("ts"), F.col("event_id")])
    n = l.groupBy("item").agg(F.count("*").alias("n_annotations")).where("n_annotations >= 2")
    return E.majority(l, "item", "label").join(n, "item").select("item", "label", "n_annotations", "tie")


@query("""SELECT label, count(*) AS n, round(avg((label = pred)::INT::DOUBLE), 4) AS accuracy FROM (SELECT quality AS label, toxic AS pred FROM labels WHERE doc_id % 13 > 0) GROUP BY label""")
def masked_accuracy(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 13 == 0, -100).otherwise(F.col("quality")).alias("label"), F.col("toxic").alias("pred")).where("label <> -100")
    return d.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 4).alias("accuracy"))


@query("""SELECT d.doc_id, coalesce(x.n, 0) > 0 AS known FROM documents d LEFT JOIN (SELECT lower(trim(source)) AS k, count(*) AS n FROM documents WHERE doc_id % 7 = 0 GROUP BY 1) x ON lower(trim(' ' || d.source || ' ')) = x.k""")
def citation_existence(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    index = d.where("doc_id % 7 = 0").select(T.citation_key(F.col("source")).alias("k")).distinct().withColumn("hit", F.lit(True))
    asked = d.select("doc_id", T.citation_key(F.concat(F.lit(" "), F.upper("source"), F.lit("  "))).alias("k"))
    return asked.join(index, "k", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("known"))


@query("""WITH p AS (SELECT doc_id, doc_id % 97 AS s, doc_id % 97 + n_chars % 7 AS e, lang AS label FROM documents WHERE doc_id % 3 > 0), g AS (SELECT doc_id, doc_id % 97 AS s, doc_id % 97 + n_chars % 5 AS e, lang AS label FROM documents WHERE doc_id % 2 = 0),
x AS (SELECT coalesce(p.label, g.label) AS label, count(*) FILTER (p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM p FULL JOIN g USING (doc_id, s, e, label) GROUP BY 1)
SELECT label, tp, fp, fn, round(tp::DOUBLE / (tp + fp), 4) AS precision, round(tp::DOUBLE / (tp + fn), 4) AS recall FROM x""".replace("FULL JOIN g USING (doc_id, s, e, label)", "FULL JOIN g ON p.doc_id = g.doc_id AND p.s = g.s AND p.e = g.e AND p.label = g.label"))
def ner_f1_by_span(spark, sf_dir):
    """Entities are right if place and label are."""
    d, at = table(spark, sf_dir, "documents"), F.col("doc_id") % 97
    p = d.where("doc_id % 3 > 0").select("doc_id", at.alias("s"), (at + F.col("n_chars") % 7).alias("e"), F.col("lang").alias("label"), F.lit(1).alias("p"))
    g = d.where("doc_id % 2 = 0").select("doc_id", at.alias("s"), (at + F.col("n_chars") % 5).alias("e"), F.col("lang").alias("label"), F.lit(1).alias("g"))
    c = p.join(g, ["doc_id", "s", "e", "label"], "full").groupBy("label").agg(F.count(F.col("p") + F.col("g")).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    a, b, _ = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("label", "tp", "fp", "fn", a.alias("precision"), b.alias("recall"))


@query("""SELECT l_orderkey, l_linenumber, 's' || l_linenumber AS section FROM lineitem WHERE l_linenumber % 4 > 0 AND l_partkey % 11 > 0""")
def parsed_only(spark, sf_dir):
    """Generations that are neither errors nor unparsable: the parse tells, not a flag."""
    k = F.col("l_linenumber")
    raw = F.when(F.col("l_partkey") % 11 == 0, '{"error": "quota"}').when(k % 4 == 0, "{not json").otherwise(F.concat(F.lit('{"section": "s'), k.cast("string"), F.lit('"}')))
    parsed = F.from_json(raw, "error string, section string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", parsed.alias("r"))
    return r.where("r._bad IS NULL AND r.error IS NULL AND r.section IS NOT NULL").select("l_orderkey", "l_linenumber", "r.section")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE (props::JSON ->> 'k')::BIGINT END AS k, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS note, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS n_tags FROM events""")
def row_records(spark, sf_dir):
    """Rows to records: JSON columns decoded, defaults where a column is null."""
    e = table(spark, sf_dir, "events")
    null = F.col("event_id") % 3 == 0
    rows = e.select("event_id", F.when(~null, F.col("props")).alias("props"), F.when(~null, F.col("event_type")).alias("note"), F.when(~null, F.lit('["a","b"]')).alias("tags"))
    none = F.array().cast("array<string>")
    decoded = rows.select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0)).alias("k"), F.coalesce("note", F.lit("")).alias("note"), F.coalesce(F.from_json("tags", "array<string>"), none).alias("tags"))
    return decoded.select("event_id", "k", "note", F.size("tags").alias("n_tags"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS claim_id, CASE WHEN l_linenumber % 5 = 0 OR l_partkey % 13 = 0 THEN 'unavailable' ELSE 'ok' END AS status, CASE WHEN l_linenumber % 5 = 0 THEN 'scorer_failed' WHEN l_partkey % 13 = 0 THEN 'score_not_finite' ELSE '' END AS reason, 'unavailable' AS second_status FROM lineitem""")
def scorer_failures(spark, sf_dir):
    """A scorer that fails, or answers with no number, is unavailable with a reason; the second scorer's place is kept and never filled by guess."""
    raw = F.when(F.col("l_linenumber") % 5 == 0, None).when(F.col("l_partkey") % 13 == 0, F.lit(float("nan"))).otherwise(F.lit(0.5))
    s = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), C.scored(raw).alias("a"), C.scored(F.lit(None).cast("double")).alias("b"))
    return s.select("claim_id", "a.status", "a.reason", F.col("b.status").alias("second_status"))


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'yes' END, CASE WHEN doc_id % 3 = 1 THEN 'maybe' END, 'unlabelled') AS proposal FROM labels WHERE doc_id % 7 > 0""")
def rating_queue(spark, sf_dir):
    """Items that a rater has not rated yet, with the label on the row as proposal, or a placeholder."""
    l = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "yes").alias("label"), F.when(F.col("doc_id") % 3 == 1, "maybe").alias("in_force_label"))
    rated = l.where("doc_id % 7 = 0").select("doc_id")
    return l.join(rated, "doc_id", "left_anti").select("doc_id", F.coalesce("label", "in_force_label", F.lit("unlabelled")).alias("proposal"))


@query("""WITH c AS (SELECT doc_id, i // 400 AS child, (doc_id * 7919 + i * 31) % 1000 AS score FROM (SELECT doc_id, unnest(range(0, length(text), 400)) AS i FROM documents)) SELECT doc_id, child, CASE WHEN doc_id % 4 > 0 THEN 'near' ELSE 'fetched' END AS source, md5(CASE WHEN doc_id % 4 > 0 THEN 'p' || doc_id ELSE 'db' || doc_id END) AS parent_md5 FROM c WHERE score > 900""")
def parent_lookup(spark, sf_dir):
    """A hit's parent from the chunks at hand, else from the store."""
    from lexloom.operators import chunking

    c = chunking.slices(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", F.col("chunk_index").cast("bigint").alias("child"), ((F.col("doc_id") * 7919 + F.col("char_start") * 31) % 1000).alias("score")).where("score > 900")
    ids = table(spark, sf_dir, "documents").select("doc_id")
    near = ids.where("doc_id % 4 > 0").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("text"))
    store = ids.select("doc_id", F.concat(F.lit("db"), F.col("doc_id").cast("string")).alias("text"))
    return chunking.with_parents(c, near, store, "doc_id", "text").select("doc_id", "child", "source", F.md5("text").alias("parent_md5"))
