"""Queries over claims, metrics, agreement, calibration and corpus preparation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom import config
from lexloom.functions import measures as M
from lexloom.functions import text as T
from lexloom.operators import claims as C
from lexloom.operators import corpus, evaluation as E
from lexloom.operators.ordering import percentiles
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


# claims and scores from lineitem, raters from documents: the same expressions in both engines
_CLAIMS_SQL = """claims AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey AS answer_id, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE ((l_partkey * 7919) % 1000) / 1000::DOUBLE END AS score,
 l_suppkey % 5 AS n_passages, CASE l_partkey % 7 WHEN 0 THEN 'statute_not_in_force_superseded' WHEN 1 THEN 'unresolved_statutory_citation' END AS bad_citation FROM lineitem)"""


def claims(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"),
        F.col("l_orderkey").alias("answer_id"),
        F.when(F.col("l_partkey") % 13 != 0, (F.col("l_partkey") * 7919 % 1000) / F.lit(1000.0).cast("double")).alias("score"),
        (F.col("l_suppkey") % 5).alias("n_passages"),
        F.when(F.col("l_partkey") % 7 == 0, "statute_not_in_force_superseded").when(F.col("l_partkey") % 7 == 1, "unresolved_statutory_citation").alias("bad_citation"),
    )


_RATERS_SQL = """raters AS (SELECT doc_id AS item_id, r AS rater_id, CASE WHEN (doc_id * 31 + r * 17 * (CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END)) % 3 = 0 THEN 'entailed' WHEN (doc_id * 31) % 3 = 1 THEN 'not_entailed' ELSE 'unclear' END AS label
 FROM documents, (VALUES (1), (2), (3)) v(r) WHERE r < 3 OR doc_id % 2 = 0)"""


def raters(spark, sf_dir):
    d = F.col("doc_id")
    r = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.when(d % 2 == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("rater_id"))
    label = F.when((d * 31 + F.col("rater_id") * 17 * F.when(d % 4 == 0, 1).otherwise(0)) % 3 == 0, "entailed").when(d * 31 % 3 == 1, "not_entailed").otherwise("unclear")
    return r.select(d.alias("item_id"), "rater_id", label.alias("label"))


_REPLY = """CASE l_linenumber % 4 WHEN 0 THEN 'no json at all' WHEN 1 THEN 'Sure: {"claims": [{"text": "claim ' || l_orderkey || '", "passage_ids": ["p1"], "citations": []}, {"text": " ", "passage_ids": []}]} done'
 ELSE '```json {"claims": [{"text": "a", "passage_ids": ["p' || l_linenumber || '", "p2"], "citations": ["Section 420 IPC"]}, {"text": "b", "passage_ids": [], "citations": []}]} ```' END"""


@query(f"""WITH r AS (SELECT l_orderkey AS o, l_linenumber AS l, l_linenumber % 4 AS kind FROM lineitem)
SELECT o AS answer_id, l AS line, 0 AS claim_no, CASE kind WHEN 1 THEN 'claim ' || o ELSE 'a' END AS text, CASE kind WHEN 1 THEN 'p1' ELSE 'p' || l || ',p2' END AS passage_ids, CASE kind WHEN 1 THEN 0 ELSE 1 END AS n_citations FROM r WHERE kind > 0
UNION ALL SELECT o, l, 1, 'b', '', 0 FROM r WHERE kind > 1""")
def claims_json_parse(spark, sf_dir):
    reply = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("line"), F.expr(_REPLY).alias("reply"))
    flat = reply.select("answer_id", "line", F.posexplode(C.parse_claims(F.col("reply"))).alias("claim_no", "c"))
    return flat.select("answer_id", "line", F.col("claim_no").cast("int"), F.col("c.text").alias("text"), F.array_join("c.passage_ids", ",").alias("passage_ids"), F.size("c.citations").cast("int").alias("n_citations"))


@query(f"""WITH {_CLAIMS_SQL} SELECT claim_id, n_passages BETWEEN 1 AND 3 AS is_valid, CASE WHEN n_passages = 0 THEN 'missing_passage_id' WHEN n_passages = 4 THEN 'invalid_passage_ids: p4' ELSE 'valid_provenance' END AS reason FROM claims""")
def structural_verify(spark, sf_dir):
    ids = F.when(F.col("n_passages") > 0, F.transform(F.sequence(F.lit(1), F.col("n_passages").cast("int")), lambda i: F.concat(F.lit("p"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    v = C.structural(ids, F.array(F.lit("p1"), F.lit("p2"), F.lit("p3")))
    return claims(spark, sf_dir).select("claim_id", v.alias("v")).select("claim_id", "v.is_valid", "v.reason")


@query(f"""WITH {_CLAIMS_SQL} SELECT claim_id, CASE WHEN n_passages = 0 OR score IS NULL THEN 'unavailable' ELSE 'ok' END AS status, coalesce(n_passages > 0 AND score >= 0.5::DOUBLE, false) AS is_entailed,
 CASE WHEN n_passages = 0 THEN 'no_passage_ids_provided' WHEN score IS NULL THEN 'scorer_unavailable' WHEN score >= 0.5::DOUBLE THEN 'entailed' ELSE 'not_entailed' END AS reason FROM claims""")
def entailment_verdict(spark, sf_dir):
    ids = F.when(F.col("n_passages") > 0, F.array_repeat(F.lit("p1"), F.col("n_passages").cast("int")))
    v = C.entailment(F.col("score"), ids, F.lit("passage"))
    return claims(spark, sf_dir).select("claim_id", v.alias("v")).select("claim_id", "v.status", "v.is_entailed", "v.reason")


def _struck(spark, sf_dir):
    return C.strike(claims(spark, sf_dir).withColumn("is_valid", F.col("n_passages") > 0).withColumn("text", F.concat(F.lit("Claim "), "claim_id")))


_GATE_SQL = _CLAIMS_SQL + """, st AS (SELECT *, CASE WHEN n_passages = 0 THEN 'structural' WHEN score < 0.5::DOUBLE THEN 'entailment' WHEN score IS NOT NULL AND bad_citation IS NOT NULL OR score IS NULL AND bad_citation IS NOT NULL THEN 'registry' END AS component,
 CASE WHEN n_passages = 0 THEN 'failed_structural_grounding' WHEN score < 0.5::DOUBLE THEN 'not_entailed_by_passage' ELSE bad_citation END AS struck_reason FROM claims),
g AS (SELECT answer_id, count(*) AS n_claims, count(component) AS n, bool_or(score IS NULL) AS down FROM st GROUP BY answer_id),
dec AS (SELECT answer_id, CASE WHEN down OR n = n_claims THEN 'REFUSE' WHEN n > 0 THEN 'PARTIAL_ALLOW' ELSE 'ALLOW' END AS outcome,
 CASE WHEN down THEN 'safety_component_unavailable: entailment' WHEN n = n_claims THEN 'all_claims_struck_by_verification' WHEN n > 0 THEN 'partial_claims_verified' ELSE 'all_claims_verified' END AS reason, n_claims, CASE WHEN down THEN 0 ELSE n END AS n_struck FROM g)"""


@query(f"WITH {_GATE_SQL} SELECT answer_id, outcome, reason, n_claims, n_struck FROM dec")
def gate_decision(spark, sf_dir):
    return C.gate(_struck(spark, sf_dir), "answer_id")


@query(f"""WITH {_GATE_SQL}, b AS (SELECT answer_id, outcome, string_agg('Claim ' || claim_id, ' ' ORDER BY claim_id) FILTER (component IS NULL) AS t, string_agg(DISTINCT struck_reason, '; ' ORDER BY struck_reason) AS w FROM st JOIN dec USING (answer_id) GROUP BY ALL)
SELECT answer_id, CASE outcome WHEN 'REFUSE' THEN 'I cannot verify an answer from the available document(s).' WHEN 'PARTIAL_ALLOW' THEN t || ' ' || chr(10) || '[Notice: Certain assertions were omitted because: ' || w || ']' ELSE t END AS answer_text FROM b""")
def answer_render(spark, sf_dir):
    s = _struck(spark, sf_dir)
    return C.render(s, C.gate(s, "answer_id"), "answer_id", "claim_id")


@query(f"""WITH {_CLAIMS_SQL}, chunked AS (SELECT answer_id, claim_id, CASE k WHEN 0 THEN score ELSE score * 0.5::DOUBLE END AS s FROM claims, (VALUES (0), (1)) v(k)),
best AS (SELECT answer_id, claim_id, max(s) AS best FROM chunked GROUP BY ALL)
SELECT answer_id, round(avg(best), 6) AS mean_score, round(avg((best >= 0.5::DOUBLE)::INT::DOUBLE), 6) AS pass_rate, count(best) AS n_claims, coalesce(round(avg((best >= 0.5::DOUBLE)::INT::DOUBLE), 6) >= 0.8::DOUBLE, false) AS accepted FROM best GROUP BY answer_id""")
def pair_acceptance(spark, sf_dir):
    return C.acceptance(_chunked(spark, sf_dir), "answer_id", "claim_id", "s")


def _chunked(spark, sf_dir):
    return claims(spark, sf_dir).select("answer_id", "claim_id", F.explode(F.array("score", F.col("score") * 0.5)).alias("s"))


@query(f"""WITH {_CLAIMS_SQL}, b AS (SELECT answer_id, claim_id, max(score) AS best FROM claims GROUP BY ALL), p AS (SELECT answer_id, round(avg((best >= 0.5::DOUBLE)::INT::DOUBLE), 6) AS r FROM b GROUP BY answer_id)
SELECT count(*) AS n_pairs, count(*) FILTER (r >= 0.8::DOUBLE) AS n_accepted, round(count(*) FILTER (r >= 0.8::DOUBLE)::DOUBLE / count(*), 4) AS acceptance,
 (SELECT round(avg((score < 0.5::DOUBLE)::INT::DOUBLE), 4) FROM claims WHERE score IS NOT NULL) AS hallucination FROM p""")
def acceptance_summary(spark, sf_dir):
    pairs = C.acceptance(_chunked(spark, sf_dir), "answer_id", "claim_id", "s")
    a = pairs.agg(F.count("*").alias("n_pairs"), F.count_if("accepted").alias("n_accepted")).withColumn("acceptance", M.ratio(F.col("n_accepted"), F.col("n_pairs")))
    h = claims(spark, sf_dir).where(F.col("score").isNotNull()).agg(F.round(F.avg((F.col("score") < 0.5).cast("double")), 4).alias("hallucination"))
    return a.crossJoin(h)  # one row each


_RANK_SQL = """q AS (SELECT DISTINCT o_custkey AS query_id FROM orders),
ranked AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey * 7919) % 1009, o_orderkey) AS rank FROM orders),
judged AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, (o_orderkey % 3)::DOUBLE AS gain FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey % 5 > 0),
ideal AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS i FROM judged),
best AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN i <= 10 THEN gain / log2(i + 1) END) AS idcg FROM ideal GROUP BY query_id),
hit AS (SELECT r.query_id, count(*) FILTER (rank <= 5 AND gain IS NOT NULL) AS h5, count(*) FILTER (rank <= 5) AS s5, count(*) FILTER (rank <= 10 AND gain IS NOT NULL) AS h10, count(*) FILTER (rank <= 10) AS s10, count(*) FILTER (rank <= 20 AND gain IS NOT NULL) AS h20, count(*) FILTER (rank <= 20) AS s20,
 min(CASE WHEN gain IS NOT NULL THEN rank END) AS first, sum(CASE WHEN rank <= 10 THEN coalesce(gain, 0) / log2(rank + 1) END) AS dcg FROM ranked r LEFT JOIN judged j USING (query_id, doc_id) GROUP BY r.query_id),
per AS (SELECT q.query_id, coalesce(h5::DOUBLE / relevant, 0) AS recall5, coalesce(h10::DOUBLE / relevant, 0) AS recall10, coalesce(h20::DOUBLE / relevant, 0) AS recall20, coalesce(h5::DOUBLE / s5, 0) AS precision5, coalesce(h10::DOUBLE / s10, 0) AS precision10, coalesce(h20::DOUBLE / s20, 0) AS precision20,
 coalesce(1::DOUBLE / first, 0) AS rr, CASE WHEN idcg IS NOT NULL THEN coalesce(dcg, 0) / idcg END AS ndcg FROM q LEFT JOIN hit USING (query_id) LEFT JOIN best USING (query_id))"""


def _per_query(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))
    ranked = o.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("doc_id") * 7919 % 1009, "doc_id")))
    judged = o.where("doc_id % 3 > 0 AND query_id % 5 > 0").withColumn("gain", (F.col("doc_id") % 3).cast("double"))
    return E.retrieval_per_query(ranked, judged, o.select("query_id").distinct())


@query(f"WITH {_RANK_SQL} SELECT query_id, round(recall5, 6) AS recall5, round(recall10, 6) AS recall10, round(recall20, 6) AS recall20, round(precision5, 6) AS precision5, round(precision10, 6) AS precision10, round(precision20, 6) AS precision20, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM per")
def retrieval_metrics(spark, sf_dir):
    per = _per_query(spark, sf_dir)
    return per.select("query_id", *[F.round(c, 6).alias(c) for c in per.columns[1:]])


@query(f"WITH {_RANK_SQL} SELECT round(avg(ndcg), 4) AS ndcg10, count(ndcg) AS n, round(avg(rr), 4) AS mrr FROM per")
def ndcg(spark, sf_dir):
    return _per_query(spark, sf_dir).agg(F.round(F.avg("ndcg"), 4).alias("ndcg10"), F.count("ndcg").alias("n"), F.round(F.avg("rr"), 4).alias("mrr"))


@query("""WITH i AS (SELECT CASE WHEN toxic = 1 THEN 'out_of_scope' WHEN quality = 0 THEN 'advice_seeking' ELSE 'in_scope' END AS gold, CASE WHEN (doc_id * 7919) % 10 < 3 OR toxic = 1 AND doc_id % 3 > 0 THEN 'REFUSE' ELSE 'ANSWER' END AS decision FROM labels),
c AS (SELECT count(*) FILTER (gold <> 'in_scope' AND decision = 'REFUSE') AS tp, count(*) FILTER (gold = 'in_scope' AND decision = 'REFUSE') AS fp, count(*) FILTER (gold <> 'in_scope' AND decision <> 'REFUSE') AS fn, count(*) FILTER ((gold <> 'in_scope') = (decision = 'REFUSE')) AS r, count(*) FILTER (gold = 'in_scope') AS s, count(*) AS n FROM i)
SELECT tp, fp, fn, n, round(tp::DOUBLE / (tp + fp), 4) AS precision, round(tp::DOUBLE / (tp + fn), 4) AS recall, round(2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)), 4) AS f1, round(fp::DOUBLE / s, 4) AS over_refusal, round(r::DOUBLE / n, 4) AS accuracy FROM c""")
def refusal_metrics(spark, sf_dir):
    gold = F.when(F.col("toxic") == 1, "out_of_scope").when(F.col("quality") == 0, "advice_seeking").otherwise("in_scope")
    decision = F.when((F.col("doc_id") * 7919 % 10 < 3) | ((F.col("toxic") == 1) & (F.col("doc_id") % 3 > 0)), "REFUSE").otherwise("ANSWER")
    return E.refusal(table(spark, sf_dir, "labels").select(gold.alias("gold"), decision.alias("decision")))


@query(f"""WITH {_CLAIMS_SQL}, g AS (SELECT round(count(*) FILTER (score >= 0.5::DOUBLE)::DOUBLE / count(score), 4) AS groundedness, count(score) AS n, count(*) - count(score) AS n_unavailable FROM claims) SELECT groundedness, round(1 - groundedness, 4) AS hallucination, n, n_unavailable FROM g""")
def groundedness(spark, sf_dir):
    return E.groundedness(claims(spark, sf_dir).select((F.col("score") >= 0.5).alias("label")), "label")


@query(f"""WITH {_CLAIMS_SQL}, s AS (SELECT CASE claim_id % 5 WHEN 0 THEN 'not_found' WHEN 1 THEN 'repealed' WHEN 2 THEN 'superseded' ELSE 'in_force' END AS status FROM claims)
SELECT count(*) AS n, round(count(*) FILTER (status <> 'not_found')::DOUBLE / count(*), 4) AS validity, round(count(*) FILTER (status IN ('repealed', 'superseded'))::DOUBLE / nullif(count(*) FILTER (status <> 'not_found'), 0), 4) AS repealed_rate FROM s""")
def registry_metrics(spark, sf_dir):
    status = F.when(F.col("claim_id") % 5 == 0, "not_found").when(F.col("claim_id") % 5 == 1, "repealed").when(F.col("claim_id") % 5 == 2, "superseded").otherwise("in_force")
    c = claims(spark, sf_dir).select(status.alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("s") != "not_found").alias("known"), F.count_if(F.col("s").isin("repealed", "superseded")).alias("old"))
    return c.select("n", M.ratio(F.col("known"), F.col("n")).alias("validity"), M.ratio(F.col("old"), F.col("known")).alias("repealed_rate"))


@query(f"""WITH {_CLAIMS_SQL} SELECT 'type' || n_passages AS perturbation, round(avg((score < 0.5::DOUBLE)::INT::DOUBLE), 4) AS rate, count(score) AS n, count(*) - count(score) AS n_unjudged FROM claims GROUP BY n_passages""")
def detection_rate(spark, sf_dir):
    g = claims(spark, sf_dir).groupBy(F.concat(F.lit("type"), "n_passages").alias("perturbation"))
    return g.agg(F.round(F.avg((F.col("score") < 0.5).cast("double")), 4).alias("rate"), F.count("score").alias("n"), (F.count("*") - F.count("score")).alias("n_unjudged"))


@query(f"""WITH {_RATERS_SQL}, p AS (SELECT a.label AS a, b.label AS b FROM raters a JOIN raters b USING (item_id) WHERE a.rater_id = 1 AND b.rater_id = 2),
n AS (SELECT count(*) AS n, count(*) FILTER (a = b)::DOUBLE / count(*) AS po FROM p),
e AS (SELECT sum(na::DOUBLE * nb) AS agreed FROM (SELECT a AS l, count(*) AS na FROM p GROUP BY a) x JOIN (SELECT b AS l, count(*) AS nb FROM p GROUP BY b) y USING (l))
SELECT n, round((po - agreed / (n::DOUBLE * n)) / (1 - agreed / (n::DOUBLE * n)), 4) AS kappa FROM n, e""")
def cohen_kappa(spark, sf_dir):
    r = raters(spark, sf_dir)
    pairs = r.where("rater_id = 1").select("item_id", F.col("label").alias("a")).join(r.where("rater_id = 2").select("item_id", F.col("label").alias("b")), "item_id")
    return E.cohen_kappa(pairs)


@query(f"""WITH {_RATERS_SQL}, u AS (SELECT item_id, count(*) AS m FROM raters GROUP BY item_id HAVING count(*) > 1),
co AS (SELECT a.label AS x, b.label AS y, sum(1::DOUBLE / (m - 1)) AS w FROM raters a JOIN raters b USING (item_id) JOIN u USING (item_id) WHERE a.rater_id <> b.rater_id GROUP BY ALL),
mg AS (SELECT x, sum(w) AS w FROM co GROUP BY x), t AS (SELECT sum(w) AS n FROM co)
SELECT (SELECT count(*) FROM u) AS n_items, round(1 - (SELECT sum(w) FROM co WHERE x <> y) / ((n * n - (SELECT sum(w * w) FROM mg)) / (n - 1)), 4) AS alpha FROM t""")
def krippendorff_alpha(spark, sf_dir):
    return E.krippendorff_alpha(raters(spark, sf_dir))


@query(f"""WITH {_RATERS_SQL} SELECT count(*) AS n_pairs, round(count(*) FILTER (a.label = b.label)::DOUBLE / count(*), 4) AS agreement FROM raters a JOIN raters b ON a.item_id = b.item_id AND a.rater_id < b.rater_id""")
def percent_agreement(spark, sf_dir):
    return E.percent_agreement(raters(spark, sf_dir))


@query(f"""WITH {_RATERS_SQL}, c AS (SELECT item_id, label, count(*) AS c FROM raters GROUP BY ALL), m AS (SELECT *, max(c) OVER (PARTITION BY item_id) AS best FROM c)
SELECT item_id, min(label) AS label, max(c) AS votes, count(*) > 1 AS tie FROM m WHERE c = best GROUP BY item_id""")
def majority_vote(spark, sf_dir):
    return E.majority(raters(spark, sf_dir))


_EV_SQL = """ev AS (SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 10 = 0 THEN 'cold' ELSE 'correction' END AS mode, (value > 50) AS proposed, (event_id % 3 > 0) AS accepted, epoch(ts) AS t FROM events)"""


@query(f"""WITH {_EV_SQL} SELECT round(avg(CASE WHEN mode = 'correction' THEN accepted::INT::DOUBLE END), 4) AS assisted, round(avg(CASE WHEN mode = 'cold' THEN accepted::INT::DOUBLE END), 4) AS cold,
 round(avg(CASE WHEN mode = 'correction' THEN accepted::INT::DOUBLE END) - avg(CASE WHEN mode = 'cold' THEN accepted::INT::DOUBLE END), 4) AS gap FROM ev""")
def anchoring(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 10 == 0).alias("cold"), (F.col("event_id") % 3 > 0).cast("double").alias("a"))
    warm, cold = F.avg(F.when(~F.col("cold"), F.col("a"))), F.avg(F.when(F.col("cold"), F.col("a")))
    return e.agg(F.round(warm, 4).alias("assisted"), F.round(cold, 4).alias("cold"), F.round(warm - cold, 4).alias("gap"))


@query("""SELECT event_type AS mode, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median_seconds, round(avg(value), 6) AS mean_seconds, round(3600 / avg(value), 6) AS items_per_hour FROM events WHERE value > 0 GROUP BY event_type""")
def throughput(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 0").select(F.col("event_type").alias("mode"), "value")
    mean = e.groupBy("mode").agg(F.round(F.avg("value"), 6).alias("mean_seconds"), F.round(3600 / F.avg("value"), 6).alias("items_per_hour"))
    return percentiles(e, "mode", "value", {"m": 0.5}).join(mean, "mode").select("mode", "n", F.round("m", 6).alias("median_seconds"), "mean_seconds", "items_per_hour")


_CONF_SQL = """p AS (SELECT least(1, greatest(0, ((event_id * 7919) % 1100) / 1000::DOUBLE - 0.05::DOUBLE)) AS c, (event_id * 31) % 1000 < 600 AS ok FROM events WHERE event_id % 11 > 0),
b AS (SELECT least(floor(c * 10)::INT, 9) AS bin, count(*) AS n, round(avg(c), 4) AS confidence, round(avg(ok::INT::DOUBLE), 4) AS accuracy FROM p GROUP BY 1)"""


def _bins(spark, sf_dir):
    c = F.when(F.col("event_id") % 11 > 0, F.col("event_id") * 7919 % 1100 / F.lit(1000.0).cast("double") - 0.05)
    return E.reliability(table(spark, sf_dir, "events").select(c.alias("c"), (F.col("event_id") * 31 % 1000 < 600).alias("ok")), "c", "ok")


@query(f"WITH {_CONF_SQL} SELECT bin, n, confidence, accuracy FROM b")
def reliability_bins(spark, sf_dir):
    return _bins(spark, sf_dir)


@query(f"WITH {_CONF_SQL} SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 4) AS ece, sum(n)::BIGINT AS n FROM b")
def ece(spark, sf_dir):
    return E.ece(_bins(spark, sf_dir))


@query("""WITH s AS (SELECT event_type, count(*)::DOUBLE AS n, count(*) FILTER (value > 50)::DOUBLE AS k FROM events GROUP BY event_type), p AS (SELECT *, k / n AS p, 1.959963984540054::DOUBLE AS z FROM s)
SELECT event_type, n::BIGINT AS n, round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM p""")
def wilson_ci(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return g.select("event_type", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT user_id % 50 AS grp, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1")
def mean_std(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))


@query("SELECT p_partkey AS test_id, p_size / 1000::DOUBLE AS p, p_size / 1000::DOUBLE <= 0.05::DOUBLE / count(*) OVER (PARTITION BY p_partkey % 9) AS reject FROM part")
def bonferroni(spark, sf_dir):
    p = F.col("p_size") / F.lit(1000.0).cast("double")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("test_id"), p.alias("p"), (p <= config.ALPHA / F.count("*").over(Window.partitionBy(F.col("p_partkey") % 9))).alias("reject"))


@query("SELECT event_type AS stage, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50_ms, round(quantile_cont(value, 0.95), 4) AS p95_ms FROM events GROUP BY event_type")
def stage_latency_percentiles(spark, sf_dir):
    p = percentiles(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), "value"), "stage", "value", {"p50": 0.5, "p95": 0.95})
    return p.select("stage", "n", F.round("p50", 4).alias("p50_ms"), F.round("p95", 4).alias("p95_ms"))


@query("SELECT event_id, round(1 / (1 + exp(-(0.05::DOUBLE * value - 2))), 6) AS p_answer, 1 / (1 + exp(-(0.05::DOUBLE * value - 2))) < 0.5 AS is_oos FROM events")
def platt_proba(spark, sf_dir):
    p = M.sigmoid(0.05 * F.col("value") - 2)
    return table(spark, sf_dir, "events").select("event_id", F.round(p, 6).alias("p_answer"), (p < config.OOS_DECISION_THRESHOLD).alias("is_oos"))


@query("""WITH RECURSIVE p AS (SELECT (doc_id % 100)::DOUBLE / 50 - 1 AS x, quality::DOUBLE AS y, count(*)::DOUBLE AS c FROM labels WHERE quality IS NOT NULL GROUP BY ALL),
r(i, a, b) AS (SELECT 0, 1::DOUBLE, 0::DOUBLE UNION ALL SELECT i + 1, a - 0.1::DOUBLE * (sum(c * (1 / (1 + exp(-(a * x + b))) - y) * x) / sum(c)), b - 0.1::DOUBLE * (sum(c * (1 / (1 + exp(-(a * x + b))) - y)) / sum(c)) FROM r, p WHERE i < 100 GROUP BY i, a, b)
SELECT round(a, 6) AS slope, round(b, 6) AS "offset" FROM r WHERE i = 100""")
def platt_fit(spark, sf_dir):
    """Slope and offset after 100 rounds."""
    pairs = table(spark, sf_dir, "labels").select((F.col("doc_id") % 100 / 50.0 - 1).alias("x"), F.col("quality").cast("double").alias("y"))
    a, b = E.platt_fit(pairs, "x", "y")
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "slope double, offset double")


_POISSON = E.POISSON


@query("WITH d AS (SELECT doc_id AS i, quality * 0.9::DOUBLE - (doc_id % 7)::DOUBLE / 7 AS d FROM labels WHERE quality IS NOT NULL), "
  + "h0 AS (SELECT r, d, xor(('0x' || substr(md5('42:' || i), 1, 8))::BIGINT, (r * 2654435769) % 4294967296)::BIGINT AS h FROM d, range(1, " + str(config.BOOTSTRAP_ROUNDS + 1) + ") x(r)), "
  + "h1 AS (SELECT r, d, ((xor(h, h >> 16)::HUGEINT * 2146121005) % 4294967296)::BIGINT AS h FROM h0), h2 AS (SELECT r, d, ((xor(h, h >> 15)::HUGEINT * 2221713035) % 4294967296)::BIGINT AS h FROM h1), "
  + "u AS (SELECT r, d, xor(h, h >> 16) / 4294967296::DOUBLE AS u FROM h2), "
  + "w AS (SELECT r, d, CASE " + " ".join(f"WHEN u < {upto!r}::DOUBLE THEN {k}" for upto, k in _POISSON) + " ELSE 8 END AS w FROM u), "
  + """m AS (SELECT r, sum(w * d) / nullif(sum(w), 0) AS m FROM w GROUP BY r), c AS (SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m)
SELECT (SELECT count(*) FROM d) AS n, round((SELECT avg(d) FROM d), 6) AS mean_difference, round((SELECT avg(d) / stddev_samp(d) FROM d), 6) AS cohens_d, round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS significant FROM c""")
def paired_bootstrap(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", (F.col("quality") * 0.9).alias("a"), (F.col("doc_id") % 7 / 7.0).alias("b"))
    got = E.paired_bootstrap(pairs, "doc_id", "a", "b", rounds=config.BOOTSTRAP_ROUNDS)
    return got.select("n", *[F.round(c, 6).alias(c) for c in ("mean_difference", "cohens_d", "low", "high")], "significant")


@query("""SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN 'official' ELSE 'parsed' END) || '/' || (CASE p_partkey % 3 WHEN 0 THEN 's' WHEN 1 THEN 'art' ELSE 'r' END) || '/' || (CASE WHEN p_size >= 50 THEN 'high' WHEN p_size >= 5 THEN 'mid' WHEN p_size >= 1 THEN 'low' ELSE 'none' END) AS stratum FROM part""")
def audit_stratum(spark, sf_dir):
    n = F.col("p_size")
    band = F.when(n >= 50, "high").when(n >= 5, "mid").when(n >= 1, "low").otherwise("none")
    kind = F.when(F.col("p_partkey") % 3 == 0, "s").when(F.col("p_partkey") % 3 == 1, "art").otherwise("r")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", F.when(n % 2 == 0, "official").otherwise("parsed"), kind, band).alias("stratum"))


@query("SELECT doc_id, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT / 4294967295::DOUBLE < 0.1::DOUBLE AS cold FROM documents")
def cold_assignment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.cold(42, F.col("doc_id")).alias("cold"))


@query("SELECT DISTINCT 'cs-' || substr(sha1(source || '|' || coalesce(lang, '')), 1, 16) AS id, source, lang FROM documents")
def stable_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    return d.select(F.concat(F.lit("cs-"), F.left(F.sha1(F.concat("source", F.lit("|"), F.coalesce("lang", F.lit("")))), F.lit(16))).alias("id"), "source", "lang")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_annotation(spark, sf_dir):
    return E.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY sha256('7:' || doc_id), doc_id) AS n FROM labels) WHERE n <= 20")
def balanced_sample(spark, sf_dir):
    order = F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256)
    return table(spark, sf_dir, "labels").withColumn("n", F.row_number().over(Window.partitionBy("quality").orderBy(order, "doc_id"))).where("n <= 20").select("doc_id", "quality")


_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH n AS (SELECT doc_id, md5({_NORM}) AS m FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY m) AS rep, count(*) OVER (PARTITION BY m) AS copies FROM n")
def exact_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(T.dedup_normal(T.split_lines(F.col("text")))).alias("m"))
    return d.join(d.groupBy("m").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "m").select("doc_id", "rep", "copies")


_SH = rf"""n AS (SELECT doc_id, list_filter(string_split({_NORM}, ' '), lambda x: length(x) > 0) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS s FROM n WHERE len(w) > 0),
node AS (SELECT s, min(doc_id) AS doc_id, len(s) AS n FROM s GROUP BY s),
flat AS (SELECT doc_id, n, unnest(s) AS g FROM node),
it AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.9 * greatest(a.n, b.n) - 1e-9 GROUP BY ALL),
near AS (SELECT a, b, round(i::DOUBLE / (na + nb - i), 6) AS jaccard FROM it WHERE i::DOUBLE / (na + nb - i) >= 0.9::DOUBLE - 1e-9
  UNION ALL SELECT node.doc_id, s.doc_id, 1::DOUBLE FROM s JOIN node ON s.s = node.s WHERE s.doc_id <> node.doc_id)"""


def _near(spark, sf_dir):
    return corpus.near_duplicate_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {_SH} SELECT a, b, jaccard FROM near")
def near_duplicate_pairs(spark, sf_dir):
    return _near(spark, sf_dir)


@query(f"""WITH RECURSIVE {_SH}, e AS (SELECT a, b FROM near UNION SELECT b, a FROM near), r(node, x) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.x = e.a)
SELECT node AS doc_id, min(x) AS root FROM r GROUP BY node""")
def duplicate_components(spark, sf_dir):
    return corpus.components(_near(spark, sf_dir)).select(F.col("node").alias("doc_id"), "root")


@query(f"""WITH RECURSIVE {_SH}, e AS (SELECT a, b FROM near UNION SELECT b, a FROM near), r(node, x) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.x = e.a),
c AS (SELECT node AS doc_id, min(x) AS root FROM r GROUP BY node)
SELECT root, doc_id AS survivor FROM (SELECT root, c.doc_id, row_number() OVER (PARTITION BY root ORDER BY d.n_chars DESC, c.doc_id) AS k FROM c JOIN documents d ON d.doc_id = c.doc_id) WHERE k = 1""")
def component_survivor(spark, sf_dir):
    c = corpus.components(_near(spark, sf_dir)).select(F.col("node").alias("doc_id"), "root")
    return corpus.survivors(c.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"), "root", "n_chars", "doc_id").select("root", F.col("doc_id").alias("survivor"))


_SPLIT = "CASE WHEN u < 0.8::DOUBLE THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split FROM (SELECT *, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM documents)"


@query(f"SELECT doc_id, {_SPLIT}")
def hash_split(spark, sf_dir):
    return corpus.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(f"""WITH s AS (SELECT doc_id, {_SPLIT}), dropped AS (SELECT doc_id FROM documents WHERE doc_id % 11 = 0)
SELECT l.doc_id, l.quality, s.split FROM labels l JOIN s USING (doc_id) WHERE l.doc_id NOT IN (FROM dropped)""")
def split_join(spark, sf_dir):
    s = hash_split(spark, sf_dir)
    dropped = table(spark, sf_dir, "documents").where("doc_id % 11 = 0").select("doc_id")
    return corpus.with_split(table(spark, sf_dir, "labels"), s, dropped, "doc_id").select("doc_id", "quality", "split")


@query(f"""WITH s AS (SELECT doc_id, text, {_SPLIT}) SELECT b.item_id, count(*) AS n_train FROM benchmark b JOIN s ON contains(s.text, b.text) WHERE s.split = 'train' GROUP BY b.item_id""")
def leakage_check(spark, sf_dir):
    """Benchmark items inside training documents."""
    s = corpus.hash_split(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").where("split = 'train'")
    return corpus.containing(s, table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text").groupBy("item_id").agg(F.count("*").alias("n_train"))


@query(f"""WITH s AS (SELECT doc_id, {_SPLIT}), n AS (SELECT doc_id, md5({_NORM}) AS m FROM documents), p AS (SELECT n.doc_id, min(n.doc_id) OVER (PARTITION BY m) AS rep FROM n)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS n FROM p JOIN s a ON a.doc_id = p.rep JOIN s b ON b.doc_id = p.doc_id WHERE p.rep <> p.doc_id GROUP BY ALL""")
def split_overlap(spark, sf_dir):
    s = hash_split(spark, sf_dir)
    p = exact_duplicates(spark, sf_dir).where("rep <> doc_id")
    return p.join(s.withColumnRenamed("split", "split_b"), "doc_id").join(s.select(F.col("doc_id").alias("rep"), F.col("split").alias("split_a")), "rep").groupBy("split_a", "split_b").agg(F.count("*").alias("n"))


_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_PAIR_SQL = f"pr AS (SELECT a.conv_id, a.turn, {_TOK.format('b.text')} AS p, {_TOK.format('a.text')} AS s, a.text AS st, b.text AS pt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def turn_pairs(spark, sf_dir):
    """Each turn (source) with the next (prediction)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pt"))
    return c.withColumnRenamed("text", "st").join(nxt, ["conv_id", "turn"]).withColumn("p", T.tokens(F.col("pt"))).withColumn("s", T.tokens(F.col("st")))


@query(f"""WITH {_PAIR_SQL}, g AS (SELECT conv_id, turn, list_transform(range(1, len(p) - 2), lambda i: array_to_string(p[i : i + 3], ' ')) AS pg, list_transform(range(1, len(s) - 2), lambda i: array_to_string(s[i : i + 3], ' ')) AS sg FROM pr)
SELECT conv_id, turn, CASE WHEN len(pg) = 0 THEN NULL ELSE round(len(list_filter(pg, lambda x: list_contains(sg, x)))::DOUBLE / len(pg), 4) END AS extractiveness FROM g""")
def extractiveness(spark, sf_dir):
    g = turn_pairs(spark, sf_dir).select("conv_id", "turn", T.ngrams(F.col("p"), config.NGRAM).alias("pg"), T.ngrams(F.col("s"), config.NGRAM).alias("sg"))
    hits = F.size(F.filter("pg", lambda x: F.array_contains("sg", x)))
    return g.select("conv_id", "turn", M.ratio(hits, F.nullif(F.size("pg"), F.lit(0))).alias("extractiveness"))


@query(f"WITH {_PAIR_SQL} SELECT conv_id, turn, CASE WHEN len(p) = 0 THEN NULL ELSE round(len(list_filter(p, lambda x: list_contains(s, x)))::DOUBLE / len(p), 4) END AS coverage FROM pr")
def token_coverage(spark, sf_dir):
    hits = F.size(F.filter("p", lambda x: F.array_contains("s", x)))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", M.ratio(hits, F.nullif(F.size("p"), F.lit(0))).alias("coverage"))


@query(f"""WITH {_PAIR_SQL}, a AS (SELECT conv_id, turn, unnest(p) AS t, unnest(range(1, len(p) + 1)) AS i FROM pr), b AS (SELECT conv_id, turn, unnest(s) AS t, unnest(range(1, len(s) + 1)) AS j FROM pr),
m AS (SELECT a.conv_id, a.turn, i - j AS d, i, i - row_number() OVER (PARTITION BY a.conv_id, a.turn, i - j ORDER BY i) AS run FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.t = b.t),
r AS (SELECT conv_id, turn, count(*) AS n FROM m GROUP BY conv_id, turn, d, run)
SELECT pr.conv_id, pr.turn, coalesce(max(n), 0) AS longest FROM pr LEFT JOIN r USING (conv_id, turn) GROUP BY ALL""")
def longest_copied_span(spark, sf_dir):
    """Equal tokens on one diagonal in unbroken runs; the join is within a pair of turns."""
    pr = turn_pairs(spark, sf_dir)
    a = pr.select("conv_id", "turn", F.posexplode("p").alias("i", "t"))
    b = pr.select("conv_id", "turn", F.posexplode("s").alias("j", "t"))
    m = a.join(b, ["conv_id", "turn", "t"]).withColumn("d", F.col("i") - F.col("j"))
    m = m.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy("conv_id", "turn", "d").orderBy("i")))
    r = m.groupBy("conv_id", "turn", "d", "run").agg(F.count("*").alias("n")).groupBy("conv_id", "turn").agg(F.max("n").alias("longest"))
    return pr.select("conv_id", "turn").join(r, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("longest", F.lit(0)).alias("longest"))


@query(rf"""WITH {_PAIR_SQL}, p1 AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(pt), '\s+'), lambda x: x <> '')) AS w FROM pr) GROUP BY ALL),
s1 AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(st), '\s+'), lambda x: x <> '')) AS w FROM pr) GROUP BY ALL),
x AS (SELECT conv_id, turn, sum(least(p1.c, s1.c)) AS common FROM p1 JOIN s1 USING (conv_id, turn, w) GROUP BY ALL),
np AS (SELECT conv_id, turn, sum(c) AS n FROM p1 GROUP BY ALL), ns AS (SELECT conv_id, turn, sum(c) AS n FROM s1 GROUP BY ALL)
SELECT pr.conv_id, pr.turn, coalesce(round(2 * (common / np.n::DOUBLE) * (common / ns.n::DOUBLE) / (common / np.n::DOUBLE + common / ns.n::DOUBLE), 4), 0) AS f1 FROM pr LEFT JOIN x USING (conv_id, turn) LEFT JOIN np USING (conv_id, turn) LEFT JOIN ns USING (conv_id, turn)""")
def token_f1(spark, sf_dir):
    pr = turn_pairs(spark, sf_dir)
    key = ["conv_id", "turn"]

    def counts(side: str, name: str):
        return pr.select(*key, F.explode(T.words(F.lower(side))).alias("w")).groupBy(*key, "w").agg(F.count("*").alias(name))

    both = counts("pt", "pc").join(counts("st", "sc"), [*key, "w"], "full")
    zero = F.lit(0)
    c = both.groupBy(*key).agg(F.sum(F.least(F.coalesce("pc", zero), F.coalesce("sc", zero))).alias("common"), F.sum("pc").alias("np"), F.sum("sc").alias("ns"))
    p, r = F.col("common") / F.col("np"), F.col("common") / F.col("ns")
    f = F.when(F.coalesce("common", zero) > 0, F.round(2 * p * r / (p + r), 4)).otherwise(0.0)
    return pr.select(*key).join(c, key, "left").select(*key, f.alias("f1"))


@query(f"""WITH b AS (SELECT item_id, {_TOK.format('text')} AS w FROM benchmark), g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' '))) AS g FROM b),
d AS (SELECT doc_id, {_TOK.format('text')} AS w FROM documents), h AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' '))) AS g FROM d)
SELECT item_id, doc_id, count(*) AS shared FROM g JOIN h USING (g) GROUP BY ALL""")
def contamination_ngrams(spark, sf_dir):
    """Eight-token runs that a document shares with a benchmark item."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.ngrams(T.tokens(F.col("text")), 8))).alias("g"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.ngrams(T.tokens(F.col("text")), 8))).alias("g"))
    return d.join(b, "g").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region")
def upsert_latest(spark, sf_dir):
    t = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    b = t.where("n_nationkey % 3 = 0").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name"), F.lit(2).alias("o"))
    b = b.unionByName(t.where("n_nationkey % 3 = 0").select("n_nationkey", F.lit("stale").alias("n_name"), F.lit(1).alias("o")))
    new = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit(1).alias("o"))
    return corpus.upsert(t, b.unionByName(new), "n_nationkey", F.col("o"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name || '+' FROM customer WHERE c_custkey % 2 = 1")
def insert_if_absent(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    batch = c.select("c_custkey", F.concat("c_name", F.lit("+")).alias("c_name"), F.lit(1).alias("o")).unionByName(c.select("c_custkey", F.concat("c_name", F.lit("-")).alias("c_name"), F.lit(2).alias("o")))
    return corpus.insert_if_absent(c.where("c_custkey % 2 = 0"), batch, "c_custkey", "o")


@query("SELECT s.s_suppkey, coalesce(CASE WHEN count(l.l_suppkey) > 0 THEN 'active' END, 'idle') AS state FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey AND l.l_quantity > 48 GROUP BY s.s_suppkey")
def scd_update_from(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("idle").alias("state"))
    source = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("state", F.lit("active"))
    return corpus.update_from(t, source, "s_suppkey", ["state"])


@query("""WITH b AS (SELECT CASE WHEN event_type = 'view' THEN 'latency_' ELSE '' END || event_type AS metric, round(avg(value), 4) AS before FROM events GROUP BY event_type),
c AS (SELECT CASE WHEN event_type = 'view' THEN 'latency_' ELSE '' END || event_type AS metric, round(avg(value), 4) AS after FROM events WHERE event_id % 2 = 0 AND event_type <> 'click' GROUP BY event_type)
SELECT metric, before, after, CASE WHEN after IS NULL THEN 'disappeared' WHEN before - after > 0.1::DOUBLE THEN 'regressed' ELSE 'ok' END AS state FROM b LEFT JOIN c USING (metric) WHERE metric NOT LIKE 'latency_%'""")
def baseline_regression(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.concat(F.when(F.col("event_type") == "view", "latency_").otherwise(""), F.col("event_type"))
    b = e.groupBy(name.alias("metric")).agg(F.round(F.avg("value"), 4).alias("value"))
    c = e.where("event_id % 2 = 0 AND event_type <> 'click'").groupBy(name.alias("metric")).agg(F.round(F.avg("value"), 4).alias("value"))
    return E.compare_runs(b, c)


@query("""WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rank < floor(n * 1 / 6.5::DOUBLE) THEN 0 WHEN rank < 2 * floor(n * 1 / 6.5::DOUBLE) THEN 1 WHEN rank < 3 * floor(n * 1 / 6.5::DOUBLE) THEN 2 WHEN rank < 4 * floor(n * 1 / 6.5::DOUBLE) THEN 3 ELSE 4 END AS shard FROM r""")
def weighted_shards(spark, sf_dir):
    return corpus.weighted_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", (1, 1, 1, 1, 2.5))
