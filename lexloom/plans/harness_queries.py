"""Queries of the evaluation harness, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom import config
from lexloom.functions import measures as M
from lexloom.functions import stem as P
from lexloom.functions import text as T
from lexloom.operators import evaluation as E
from lexloom.operators import harness as H
from lexloom.operators.ordering import ranked
from lexloom.plans.evaluation_queries import _CLAIMS_SQL, _PAIR_SQL, _RANK_SQL, _per_query, claims, turn_pairs
from lexloom.sources.scratch import Scratch
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


@query(f"""WITH {_CLAIMS_SQL} SELECT count(score) AS n, round(avg(score), 6) AS mean, min(score) AS min, max(score) AS max, count(*) FILTER (score < 0.5::DOUBLE) AS n_below, round(100 * count(*) FILTER (score < 0.5::DOUBLE) / count(score)::DOUBLE, 4) AS percent_below FROM claims""")
def claim_score_stats(spark, sf_dir):
    below = F.count_if(F.col("score") < 0.5)
    return claims(spark, sf_dir).agg(
        F.count("score").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"), below.alias("n_below"), F.round(100 * below / F.count("score"), 4).alias("percent_below")
    )


@query(f"WITH {_CLAIMS_SQL} SELECT claim_id, score FROM claims WHERE score IS NOT NULL ORDER BY score, claim_id LIMIT 5")
def worst_claims(spark, sf_dir):
    """The five lowest scores, for a look by eye."""
    return claims(spark, sf_dir).where("score IS NOT NULL").orderBy("score", "claim_id").limit(5).select("claim_id", "score")


@query(f"""WITH {_CLAIMS_SQL}, s AS (SELECT claim_id % 10 AS shard, round(avg(score), 6) AS mean, count(score) AS n FROM claims GROUP BY 1) SELECT count(*) AS n_shards, sum(n)::BIGINT AS n, round(sum(mean * n) / sum(n), 6) AS mean FROM s""")
def shard_summary_merge(spark, sf_dir):
    """Summaries of shards put together by weight."""
    s = claims(spark, sf_dir).groupBy((F.col("claim_id") % 10).alias("shard")).agg(F.round(F.avg("score"), 6).alias("mean"), F.count("score").alias("n"))
    return s.agg(F.count("*").alias("n_shards"), F.sum("n").alias("n"), F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 6).alias("mean"))


_RUNS_SQL = f"""{_CLAIMS_SQL}, c AS (SELECT claim_id % 10 AS run, n_passages > 1 AS has_citation, CASE WHEN n_passages <= 1 OR claim_id % 10 = 5 THEN NULL WHEN claim_id % 10 = 6 THEN 'not_found' WHEN claim_id % 10 = 7 AND claim_id % 3 = 0 THEN 'gone' WHEN claim_id % 4 = 0 THEN 'repealed' WHEN claim_id % 4 = 1 THEN 'superseded' WHEN claim_id % 4 = 2 THEN 'not_found' ELSE 'in_force' END AS status,
 CASE WHEN claim_id % 10 <> 4 THEN score >= 0.5::DOUBLE END AS supported FROM claims)"""


def _runs(spark, sf_dir):
    k = F.col("claim_id")
    c = claims(spark, sf_dir).withColumn("run", k % 10)
    status = F.when((F.col("n_passages") <= 1) | (F.col("run") == 5), None).when(F.col("run") == 6, "not_found").when((F.col("run") == 7) & (k % 3 == 0), "gone").when(k % 4 == 0, "repealed").when(k % 4 == 1, "superseded").when(k % 4 == 2, "not_found").otherwise("in_force")
    return c.select("run", (F.col("n_passages") > 1).alias("has_citation"), status.alias("status"), F.when(F.col("run") != 4, F.col("score") >= 0.5).alias("supported"))


@query(f"""WITH {_RUNS_SQL}, g AS (SELECT run, count(*) AS claims, count(*) FILTER (has_citation) AS cited, count(status) AS resolved, count(*) FILTER (status IN ('in_force', 'repealed', 'superseded')) AS known, count(*) FILTER (status IN ('repealed', 'superseded')) AS old,
 count(*) FILTER (status = 'gone') AS bad, count(supported) AS judged, count(*) FILTER (supported) AS ok FROM c GROUP BY run),
r AS (SELECT run, 'citation_coverage' AS name, cited / claims::DOUBLE AS value, claims AS n, '' AS reason FROM g
UNION ALL SELECT run, 'registry_coverage_rate', known / nullif(resolved, 0)::DOUBLE, resolved, 'no_resolved_citations_supplied' FROM g
UNION ALL SELECT run, 'citation_validity_rate', CASE WHEN bad = 0 THEN known / nullif(resolved, 0)::DOUBLE END, resolved, CASE WHEN bad > 0 THEN 'malformed_registry_status:gone' ELSE 'no_resolved_citations_supplied' END FROM g
UNION ALL SELECT run, 'repealed_citation_rate', old / nullif(known, 0)::DOUBLE, CASE WHEN known > 0 THEN known ELSE resolved END, CASE WHEN resolved > 0 THEN 'registry_resolved_nothing' ELSE 'no_resolved_citations_supplied' END FROM g
UNION ALL SELECT run, 'citation_support_rate', ok / nullif(judged, 0)::DOUBLE, CASE WHEN judged > 0 THEN judged ELSE claims END, 'no_judged_citations' FROM g)
SELECT run, name, round(value, 4) AS value, CASE WHEN value IS NULL THEN 'unavailable' ELSE 'ok' END AS status, n, CASE WHEN value IS NULL THEN reason ELSE '' END AS reason FROM r""")
def citation_measures(spark, sf_dir):
    """Coverage, validity, repealed share and support for each run; one run is malformed, one resolves nothing, one has no citation, one no judgment."""
    return H.citation_measures(_runs(spark, sf_dir), ["run"])


_BUNDLE = [(f"recall@{k}", f"recall{k}") for k in config.K_VALUES] + [(f"precision@{k}", f"precision{k}") for k in config.K_VALUES] + [("mrr", "rr"), (f"ndcg@{config.NDCG_K}", "ndcg")]


@query(f"WITH {_RANK_SQL}, s AS (SELECT query_id % 5 = 0 AS none, * FROM per) " + " UNION ALL ".join(
    f"SELECT CASE WHEN none THEN 'unjudged' ELSE 'judged' END AS system, '{name}' AS name, CASE WHEN NOT none THEN round(avg({c}), 4) END AS value, CASE WHEN none THEN 'unavailable' ELSE 'ok' END AS status, count(*) AS n, CASE WHEN none THEN 'no_relevance_judgments' ELSE '' END AS reason FROM s GROUP BY none" for name, c in _BUNDLE
))
def retrieval_bundle(spark, sf_dir):
    """All retrieval measures as rows; where no query is judged they are unavailable, not 0."""
    per = _per_query(spark, sf_dir).withColumn("system", F.when(F.col("query_id") % 5 == 0, "unjudged").otherwise("judged")).withColumn("judged", F.col("query_id") % 5 != 0)
    return H.retrieval_measures(per, ["system"])


@query("SELECT count(*) AS n, NULL::DOUBLE AS kappa, 1::DOUBLE AS kappa_of_one_label FROM labels")
def kappa_single_label(spark, sf_dir):
    """Two raters who only ever say one thing: undefined, or 1 in the variant that says so."""
    pairs = table(spark, sf_dir, "labels").select(F.lit("x").alias("a"), F.lit("x").alias("b"))
    return E.cohen_kappa(pairs).join(E.cohen_kappa(pairs, total_is_one=True).withColumnRenamed("kappa", "kappa_of_one_label"), "n")


_TASK_SQL = """ra AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 2 THEN 'three' WHEN 3 THEN 'apart' ELSE 'same' END AS task, doc_id AS item_id, r AS rater_id, CASE WHEN doc_id % 5 = 4 THEN 'a' WHEN (doc_id * 31 + r * 17 * (doc_id % 2)) % 3 = 0 THEN 'a' WHEN doc_id * 31 % 3 = 1 THEN 'b' ELSE 'c' END AS label
 FROM documents, (VALUES (1), (2), (3)) v(r) WHERE CASE doc_id % 5 WHEN 0 THEN r = 1 WHEN 1 THEN r < 3 WHEN 2 THEN r < 3 OR doc_id % 2 = 0 WHEN 3 THEN r = 1 + doc_id % 2 ELSE r < 3 END)"""


def _tasks(spark, sf_dir):
    d, r = F.col("item_id"), F.col("rater_id")
    x = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rater_id"))
    k = d % 5
    x = x.where(F.when(k == 0, r == 1).when(k == 1, r < 3).when(k == 2, (r < 3) | (d % 2 == 0)).when(k == 3, r == 1 + d % 2).otherwise(r < 3))
    label = F.when(k == 4, "a").when((d * 31 + r * 17 * (d % 2)) % 3 == 0, "a").when(d * 31 % 3 == 1, "b").otherwise("c")
    return x.select(F.when(k == 0, "one").when(k == 1, "two").when(k == 2, "three").when(k == 3, "apart").otherwise("same").alias("task"), "item_id", "rater_id", label.alias("label"))


@query(f"""WITH {_TASK_SQL}, t AS (SELECT task, count(DISTINCT rater_id) AS nr, count(DISTINCT item_id) AS ni FROM ra GROUP BY task),
p AS (SELECT x.task, x.label AS a, y.label AS b FROM ra x JOIN ra y ON x.item_id = y.item_id AND x.rater_id < y.rater_id WHERE x.task IN ('two', 'apart', 'same')),
po AS (SELECT task, count(*) AS n, avg((a = b)::INT::DOUBLE) AS po FROM p GROUP BY task),
pe AS (SELECT task, sum(na::DOUBLE * nb) AS pe FROM (SELECT task, a AS l, count(*) AS na FROM p GROUP BY ALL) JOIN (SELECT task, b AS l, count(*) AS nb FROM p GROUP BY ALL) USING (task, l) GROUP BY task),
u AS (SELECT item_id, count(*) AS m FROM ra WHERE task = 'three' GROUP BY item_id HAVING count(*) > 1),
co AS (SELECT a.label AS x, b.label AS y, sum(1::DOUBLE / (m - 1)) AS w FROM ra a JOIN ra b USING (item_id) JOIN u USING (item_id) WHERE a.rater_id <> b.rater_id GROUP BY ALL),
al AS (SELECT 1 - (SELECT coalesce(sum(w), 0) FROM co WHERE x <> y) / ((n * n - (SELECT sum(w * w) FROM (SELECT sum(w) AS w FROM co GROUP BY x))) / (n - 1)) AS alpha FROM (SELECT sum(w) AS n FROM co))
SELECT t.task, CASE WHEN nr < 3 THEN 'cohen_kappa' ELSE 'krippendorff_alpha' END AS statistic, CASE WHEN nr = 2 THEN round(CASE WHEN pe < n::DOUBLE * n THEN (po - pe / (n::DOUBLE * n)) / (1 - pe / (n::DOUBLE * n)) END, 4) WHEN nr > 2 THEN round((SELECT alpha FROM al), 4) END AS value,
 CASE WHEN nr = 2 THEN coalesce(n, ni) WHEN nr > 2 THEN (SELECT count(*) FROM u) ELSE ni END AS n_items, nr AS n_raters, CASE t.task WHEN 'one' THEN 'fewer_than_two_raters' WHEN 'apart' THEN 'no_commonly_rated_items' WHEN 'same' THEN 'one_label_only' ELSE '' END AS reason
FROM t LEFT JOIN po USING (task) LEFT JOIN pe USING (task)""")
def agreement_dispatch(spark, sf_dir):
    """One task for each case: one rater, two, three, two who share no item, two who say one thing."""
    return H.agreement_by(_tasks(spark, sf_dir), "task")


_SETS_SQL = "it AS (SELECT doc_id, 'set' || (doc_id % 4) AS name, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN quality = 1 THEN 'yes' ELSE 'no' END AS label, doc_id % 3 AS n_annotations, CASE WHEN doc_id % 4 > 0 AND doc_id % 3 = 2 THEN (doc_id % 10) / 10::DOUBLE END AS agreement, doc_id % 3 AS grade FROM labels)"


def _sets(spark, sf_dir):
    d = F.col("doc_id")
    label = F.when(d % 4 == 3, None).when(F.col("quality") == 1, "yes").otherwise("no")
    return table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("set"), (d % 4).cast("string")).alias("name"), label.alias("label"), (d % 3).alias("n_annotations"), F.when((d % 4 > 0) & (d % 3 == 2), d % 10 / 10.0).alias("agreement"), (d % 3).alias("grade"))


@query(f"""WITH {_SETS_SQL}, c AS (SELECT name, coalesce(label, 'grade_' || grade) AS k, count(*) AS c FROM it GROUP BY ALL), l AS (SELECT name, string_agg(k || '=' || c, ',' ORDER BY k) AS label_counts FROM c GROUP BY name)
SELECT name, count(*) AS n, any_value(label_counts) AS label_counts, count(*) FILTER (n_annotations >= 2) AS n_duplicated, round(count(*) FILTER (n_annotations >= 2) / count(*)::DOUBLE, 4) AS duplication_rate, round(avg(agreement), 4) AS mean_agreement, count(agreement) AS n_with_agreement,
 round(1.959963984540054::DOUBLE * sqrt(0.25::DOUBLE / count(*)), 6) AS half_width,
 name || ': n=' || count(*) || ' (' || CASE WHEN count(*) >= 100 THEN 'meets target' ELSE 'BELOW target' END || ', target 100) gives a 95% CI half-width of +/-' || format('{{:.1f}}', 100 * 1.959963984540054::DOUBLE * sqrt(0.25::DOUBLE / count(*))) || '% on a proportion at p=0.5.' AS note FROM it JOIN l USING (name) GROUP BY name""")
def gold_description(spark, sf_dir):
    """Size, labels or grades, duplication, agreement and the interval that the size allows, for each gold set."""
    s = _sets(spark, sf_dir)
    k = s.groupBy("name", F.coalesce("label", F.concat(F.lit("grade_"), F.col("grade").cast("string"))).alias("k")).agg(F.count("*").alias("c"))
    counts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: F.concat(x["k"], F.lit("="), x["c"].cast("string"))), ",")
    dup = F.count_if(F.col("n_annotations") >= 2)
    g = s.groupBy("name").agg(F.count("*").alias("n"), dup.alias("n_duplicated"), F.round(dup / F.count("*"), 4).alias("duplication_rate"), F.round(F.avg("agreement"), 4).alias("mean_agreement"), F.count("agreement").alias("n_with_agreement"))
    g = g.join(k.groupBy("name").agg(counts.alias("label_counts")), "name")
    return g.withColumn("half_width", F.round(H.half_width(F.col("n")), 6)).withColumn("note", H.sizing_note(F.col("name"), F.col("n"), F.lit(100)))


@query(f"""WITH {_SETS_SQL} SELECT 'agreement[' || name || ']' AS name, round(avg(agreement), 4) AS value, CASE WHEN count(agreement) > 0 THEN 'ok' WHEN name = 'set0' THEN 'not_applicable' ELSE 'unavailable' END AS status, CASE WHEN count(agreement) > 0 THEN count(agreement) WHEN name = 'set0' THEN 0 ELSE count(*) END AS n FROM it GROUP BY it.name""")
def human_measures(spark, sf_dir):
    """Mean agreement of each set; a set that has no duplicates by design is not applicable, one that lacks them is unavailable."""
    g = _sets(spark, sf_dir).groupBy("name").agg(F.round(F.avg("agreement"), 4).alias("value"), F.count("agreement").alias("a"), F.count("*").alias("c"))
    by_design = F.col("name") == "set0"
    return g.select(F.concat(F.lit("agreement["), "name", F.lit("]")).alias("name"), "value", F.when(F.col("a") > 0, "ok").when(by_design, "not_applicable").otherwise("unavailable").alias("status"), F.when(F.col("a") > 0, F.col("a")).when(by_design, 0).otherwise(F.col("c")).alias("n"))


@query("""SELECT count(*) FILTER (toxic = 0 AND quality = 1) AS accept_accept, count(*) FILTER (toxic = 0 AND quality = 0) AS accept_reject, count(*) FILTER (toxic = 1 AND quality = 1) AS reject_accept, count(*) FILTER (toxic = 1 AND quality = 0) AS reject_reject,
 round(100 * count(*) FILTER ((toxic = 0) = (quality = 1)) / count(*)::DOUBLE, 2) AS agreement_percent FROM labels""")
def accept_confusion(spark, sf_dir):
    """The scorer's verdict against a human's."""
    m, h = F.col("toxic") == 0, F.col("quality") == 1
    return table(spark, sf_dir, "labels").agg(
        F.count_if(m & h).alias("accept_accept"), F.count_if(m & ~h).alias("accept_reject"), F.count_if(~m & h).alias("reject_accept"), F.count_if(~m & ~h).alias("reject_reject"), F.round(100 * F.count_if(m == h) / F.count("*"), 2).alias("agreement_percent")
    )


_SHEET_SQL = "sh AS (SELECT p_partkey AS k, 1 + p_size % 4 AS priority, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'wrong' WHEN 2 THEN 'unclear' ELSE 'correct' END AS v FROM part)"


def _sheet(spark, sf_dir):
    from lexloom.operators.records import verdict

    raw = F.element_at(F.array(F.lit(""), F.lit(" Wrong (see note)"), F.lit("unclear"), F.lit("CORRECT"), F.lit("correct."), F.lit("Correct"), F.lit("correct ")), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 4 + 1).cast("bigint").alias("priority"), verdict(raw).alias("v"))


@query(f"WITH {_SHEET_SQL} SELECT priority, count(*) AS n, count(v) AS reviewed, count(*) FILTER (v = 'unclear') AS unclear, round(count(*) FILTER (v = 'correct') / nullif(count(*) FILTER (v IN ('correct', 'wrong')), 0)::DOUBLE, 4) AS accuracy FROM sh GROUP BY priority")
def verification_accuracy(spark, sf_dir):
    """Accuracy per priority without unclear and unreviewed rows, which are counted apart."""
    v = F.col("v")
    return _sheet(spark, sf_dir).groupBy("priority").agg(F.count("*").alias("n"), F.count("v").alias("reviewed"), F.count_if(v == "unclear").alias("unclear"), M.ratio(F.count_if(v == "correct"), F.count_if(v.isin("correct", "wrong"))).alias("accuracy"))


@query(f"""WITH {_SHEET_SQL}, x AS (SELECT k, v AS a, CASE WHEN k % 10 = 3 THEN 'unclear' ELSE v END AS b FROM sh WHERE k % 3 > 0), j AS (SELECT * FROM x WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b) AS same FROM j),
e AS (SELECT sum(na::DOUBLE * nb) AS pe FROM (SELECT a AS l, count(*) AS na FROM j GROUP BY a) JOIN (SELECT b AS l, count(*) AS nb FROM j GROUP BY b) USING (l)), k AS (SELECT n, same, (same / n - pe / (n * n)) / (1 - pe / (n * n)) AS k FROM n, e)
SELECT (SELECT count(*) FROM x) AS n_shared, n::BIGINT AS n, round(k, 4) AS kappa, CASE WHEN k < 0 THEN 'poor' WHEN round(k, 4) <= 0.2 THEN 'slight' WHEN round(k, 4) <= 0.4 THEN 'fair' WHEN round(k, 4) <= 0.6 THEN 'moderate' WHEN round(k, 4) <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM k""")
def shared_item_agreement(spark, sf_dir):
    """Two sheets joined by their common key, kappa over rows that both judged, and the band it falls in."""
    s = _sheet(spark, sf_dir)
    other = s.where("k % 3 > 0").select("k", F.when(F.col("k") % 10 == 3, "unclear").otherwise(F.col("v")).alias("b"))
    other = other.join(s.where("v IS NULL").select("k"), "k", "left_anti").unionByName(s.where("v IS NULL AND k % 3 > 0").select("k", F.when(F.col("k") % 10 == 3, "unclear").alias("b")))
    shared = s.select("k", F.col("v").alias("a")).join(other, "k")
    judged = E.cohen_kappa(shared.where("a IS NOT NULL AND b IS NOT NULL"))
    return judged.crossJoin(shared.agg(F.count("*").alias("n_shared"))).select("n_shared", "n", "kappa", M.kappa_band(F.col("kappa")).alias("band"))  # one row each


_LOG_SQL = """ev AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN value > 50 THEN 'ANSWER' ELSE 'REFUSE' END AS decision, CASE WHEN event_id % 3 = 0 THEN 'ok:entailed' WHEN event_id % 3 = 1 THEN 'ok:not_entailed' ELSE 'unavailable:' || event_type END AS reason, CASE WHEN event_type = 'error' THEN 'Timeout' WHEN event_id % 50 = 0 THEN 'stage rerank' END AS error FROM events)"""


@query(f"WITH {_LOG_SQL} SELECT 'decisions' AS kind, decision AS key, count(*) AS n FROM ev WHERE decision IS NOT NULL GROUP BY decision UNION ALL SELECT 'verification_reasons', reason, count(*) FROM ev GROUP BY reason UNION ALL SELECT 'errors', error, count(*) FROM ev WHERE error IS NOT NULL GROUP BY error")
def error_analysis(spark, sf_dir):
    """Outcomes counted by the reasons that the pipeline itself gave; of an error the part before its first colon."""
    e = _log(spark, sf_dir)
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    pairs = F.array(pair("decisions", F.col("decision")), pair("verification_reasons", F.concat_ws(":", "status", "why")), pair("errors", F.split_part("error", F.lit(":"), F.lit(1))))
    return e.select(F.inline(pairs)).where("key IS NOT NULL").groupBy("kind", "key").agg(F.count("*").alias("n"))


def _log(spark, sf_dir):
    k, bad = F.col("event_id"), F.col("event_type") == "error"
    e = table(spark, sf_dir, "events")
    error = F.when(bad, F.concat(F.lit("Timeout: after "), F.col("value").cast("string"))).when(k % 50 == 0, "stage rerank: no model")
    return e.select(
        "event_id", "value", "event_type", F.when(bad, None).when(F.col("value") > 50, "ANSWER").otherwise("REFUSE").alias("decision"),
        F.when(k % 3 == 2, "unavailable").otherwise("ok").alias("status"), F.when(k % 3 == 0, "entailed").when(k % 3 == 1, "not_entailed").otherwise(F.col("event_type")).alias("why"), error.alias("error"),
    )


@query(f"WITH {_LOG_SQL} SELECT count(*) AS n_items_run, count(error) AS n_failures, count(*) - count(error) AS n_ok FROM ev")
def run_summary(spark, sf_dir):
    return _log(spark, sf_dir).agg(F.count("*").alias("n_items_run"), F.count("error").alias("n_failures"), (F.count("*") - F.count("error")).alias("n_ok"))


@query("SELECT count(DISTINCT conv_id) AS n_conversations, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END)::BIGINT AS chars_in, sum(CASE WHEN role = 'user' THEN 0 ELSE length(text) END)::BIGINT AS chars_out, round(sum(CASE WHEN role = 'user' THEN 0 ELSE length(text) END)::DOUBLE / nullif(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END), 0), 4) AS ratio FROM conversations")
def token_ratio(spark, sf_dir):
    """What goes out for what comes in: a ratio of sums, not a mean of ratios."""
    user, n = F.col("role") == "user", F.length("text")
    a, b = F.sum(F.when(user, n).otherwise(0)), F.sum(F.when(user, 0).otherwise(n))
    return table(spark, sf_dir, "conversations").agg(F.countDistinct("conv_id").alias("n_conversations"), a.alias("chars_in"), b.alias("chars_out"), M.ratio(b, a).alias("ratio"))


@query(f"""WITH {_PAIR_SQL}, g AS (SELECT conv_id, turn, p, s, list_transform(range(1, len(p) - 2), lambda i: array_to_string(p[i : i + 3], ' ')) AS pg, list_transform(range(1, len(s) - 2), lambda i: array_to_string(s[i : i + 3], ' ')) AS sg FROM pr),
x AS (SELECT CASE WHEN len(pg) = 0 THEN NULL ELSE round(len(list_filter(pg, lambda x: list_contains(sg, x)))::DOUBLE / len(pg), 4) END AS e, CASE WHEN len(p) = 0 THEN NULL ELSE round(len(list_filter(p, lambda x: list_contains(s, x)))::DOUBLE / len(p), 4) END AS c FROM g)
SELECT count(*) AS n, count(e) AS n_scored, round(avg(e), 4) AS mean_extractiveness, round(avg(c), 4) AS mean_coverage FROM x""")
def extractiveness_report(spark, sf_dir):
    """Means over pairs that have a value; the others are counted, not read as 0."""
    hits = lambda a, b: F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    g = turn_pairs(spark, sf_dir).select("p", "s", T.ngrams(F.col("p"), config.NGRAM).alias("pg"), T.ngrams(F.col("s"), config.NGRAM).alias("sg"))
    x = g.select(M.ratio(hits("pg", "sg"), F.nullif(F.size("pg"), F.lit(0))).alias("e"), M.ratio(hits("p", "s"), F.nullif(F.size("p"), F.lit(0))).alias("c"))
    return x.agg(F.count("*").alias("n"), F.count("e").alias("n_scored"), F.round(F.avg("e"), 4).alias("mean_extractiveness"), F.round(F.avg("c"), 4).alias("mean_coverage"))


def _rouge_sql(n: int) -> str:
    grams = lambda c: f"unnest(list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i : i + {n - 1}], ' ')))"
    return f"""a{n} AS (SELECT conv_id, turn, g, count(*) AS x FROM (SELECT conv_id, turn, {grams('p')} AS g FROM pr) GROUP BY ALL), b{n} AS (SELECT conv_id, turn, g, count(*) AS y FROM (SELECT conv_id, turn, {grams('s')} AS g FROM pr) GROUP BY ALL),
f{n} AS (SELECT conv_id, turn, round(2 * sum(least(coalesce(x, 0), coalesce(y, 0))) / (sum(coalesce(x, 0)) + sum(coalesce(y, 0)))::DOUBLE, 4) AS f FROM a{n} FULL JOIN b{n} USING (conv_id, turn, g) GROUP BY conv_id, turn)"""


def _rouge(spark, sf_dir, n: int):
    pr = turn_pairs(spark, sf_dir).select("conv_id", "turn", "p", "s")
    grams = lambda c: pr.select("conv_id", "turn", F.explode(T.ngrams(F.col(c), n)).alias("g"))
    return H.overlap_f(grams("p"), grams("s"), ["conv_id", "turn"], "g")


@query(f"WITH {_PAIR_SQL}, {_rouge_sql(1)}, {_rouge_sql(2)} SELECT pr.conv_id, pr.turn, f1.f AS rouge_1, f2.f AS rouge_2 FROM pr LEFT JOIN f1 USING (conv_id, turn) LEFT JOIN f2 USING (conv_id, turn)")
def rouge_like(spark, sf_dir):
    """F of common words and of common pairs of words, without a stemmer."""
    key = ["conv_id", "turn"]
    one, two = (_rouge(spark, sf_dir, n).withColumnRenamed("f", f"rouge_{n}") for n in (1, 2))
    return turn_pairs(spark, sf_dir).select(*key).join(one, key, "left").join(two, key, "left")


@query(f"WITH {_PAIR_SQL}, {_rouge_sql(1)}, {_rouge_sql(2)} SELECT 'rouge_1' AS variant, count(*) AS n, round(avg(f), 4) AS mean FROM f1 UNION ALL SELECT 'rouge_2', count(*), round(avg(f), 4) FROM f2")
def rouge_corpus_mean(spark, sf_dir):
    each = [_rouge(spark, sf_dir, n).agg(F.lit(f"rouge_{n}").alias("variant"), F.count("*").alias("n"), F.round(F.avg("f"), 4).alias("mean")) for n in (1, 2)]
    return each[0].unionByName(each[1])


#: A row of the table of common subsequences for each word of p.
_LCS_SQL = """ls AS (SELECT conv_id, turn, coalesce(p, []) AS p, coalesce(s, []) AS s, 0 AS i, list_transform(range(0, coalesce(len(s), 0) + 1), lambda j: 0) AS row FROM pr
  UNION ALL SELECT conv_id, turn, p, s, i + 1, list_transform(range(1, len(s) + 2), lambda j: list_max(best[1:j])) FROM (
    SELECT *, list_transform(range(1, len(s) + 2), lambda j: CASE WHEN j > 1 AND s[j - 1] = p[i + 1] THEN row[j - 1] + 1 ELSE row[j] END) AS best FROM ls WHERE i < len(p))),
fl AS (SELECT conv_id, turn, CASE WHEN len(p) + len(s) > 0 THEN round(2 * row[len(s) + 1] / (len(p) + len(s))::DOUBLE, 4) END AS f FROM ls WHERE i = len(p))"""


@query(f"WITH RECURSIVE {_PAIR_SQL}, {_LCS_SQL} SELECT conv_id, turn, f AS rouge_l FROM fl")
def rouge_l(spark, sf_dir):
    """F of the longest common subsequence of words; a test compares with the plain table too."""
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", H.lcs_f(F.col("p"), F.col("s")).alias("rouge_l"))


def _stem_sql() -> str:
    """The stemmer step by step over the distinct words; y stands as Y where it is a consonant."""
    v, c = "[aeiouy]", "[^aeiouy]"
    shape = lambda e: f"regexp_replace(regexp_replace({e}, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g')"
    is_like = lambda e, pattern: f"regexp_matches({shape(e)}, '{pattern}')"
    some, more = (lambda e: is_like(e, f"^{c}*{v}+{c}")), (lambda e: is_like(e, f"^{c}*{v}+{c}+{v}+{c}"))
    one, short = (lambda e: f"({some(e)} AND NOT {more(e)})"), (lambda e: is_like(e, f"{c}{v}[^aeiouywxY]$|^{v}{c}$"))
    cut = lambda n: f"substr(w, 1, length(w) - {n})"
    ends = lambda x: f"ends_with(w, '{x}')"
    case = lambda whens: "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in whens) + " ELSE w END"
    swap = lambda rules: case([(ends(a), f"CASE WHEN {some(cut(3) if a == 'logi' else cut(len(a)))} THEN {cut(len(a))} || '{b}' ELSE w END") for a, b in rules])
    drop = lambda a: f"CASE WHEN {more(cut(len(a)))}" + (f" AND right({cut(3)}, 1) IN ('s', 't')" if a == "ion" else "") + f" THEN {cut(len(a))} ELSE w END"
    ied = lambda x: (ends(x), f"CASE WHEN length(w) = 4 THEN {cut(1)} ELSE {cut(2)} END")
    bare = [(f"{ends(x)} AND {is_like(cut(len(x)), v)}", cut(len(x))) for x in ("ed", "ing")]
    mend = f"CASE WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN length(b) > 1 AND right(b, 1) = substr(b, length(b) - 1, 1) AND {is_like('b', c + '$')} THEN CASE WHEN right(b, 1) IN ('l', 's', 'z') THEN b ELSE substr(b, 1, length(b) - 1) END WHEN {one('b')} AND {short('b')} THEN b || 'e' ELSE b END"
    steps = [case([ied("ies"), (ends("sses"), cut(2)), (f"{ends('s')} AND NOT {ends('ss')}", cut(1))])]
    steps += [case([ied("ied"), (ends("eed"), f"CASE WHEN {some(cut(3))} THEN {cut(1)} ELSE w END"), (" OR ".join(f"({a})" for a, _ in bare), "'+' || " + case(bare))])]  # a plus: to be mended
    fixed = f"CASE WHEN starts_with(w, '+') THEN (SELECT {mend} FROM (SELECT substr(w, 2) AS b)) ELSE w END"
    steps += [fixed, case([(f"{ends('y')} AND length(w) > 2 AND {is_like(cut(1), c + '$')}", cut(1) + " || 'i'")]), swap(P.STEP_2), swap(P.STEP_3), case([(ends(a), drop(a)) for a in P.STEP_4])]
    steps += [case([(f"{ends('e')} AND ({more(cut(1))} OR {one(cut(1))} AND NOT {short(cut(1))})", cut(1))]), case([(f"{ends('ll')} AND {more(cut(1))}", cut(1))])]
    kept = "CASE o " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in P.IRREGULAR.items()) + " ELSE w END"
    out = [f"w0 AS (SELECT DISTINCT w AS o, w FROM (SELECT unnest(pw) AS w FROM rt UNION ALL SELECT unnest(sw) FROM rt) WHERE length(w) > {P.SHORT})"]
    out += [f"w{i + 1} AS (SELECT o, {step} AS w FROM w{i})" for i, step in enumerate(steps)]
    return ", ".join(out) + f", st AS MATERIALIZED (SELECT o, {kept} AS w FROM w{len(steps)})"


def _stemmed_sql(side: str) -> str:
    return f"{side}x AS (SELECT conv_id, turn, list(coalesce(st.w, x.w) ORDER BY i) AS {side} FROM (SELECT conv_id, turn, unnest({side}w) AS w, unnest(range(len({side}w))) AS i FROM rt) x LEFT JOIN st ON st.o = x.w GROUP BY conv_id, turn)"


_ROUGE_SQL = f"""rt AS (SELECT a.conv_id, a.turn, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS pw, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS sw FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
{_stem_sql()}, {_stemmed_sql('p')}, {_stemmed_sql('s')}, pr AS (SELECT conv_id, turn, coalesce(p, []) AS p, coalesce(s, []) AS s FROM rt LEFT JOIN px USING (conv_id, turn) LEFT JOIN sx USING (conv_id, turn)), {_rouge_sql(1)}, {_rouge_sql(2)}, {_LCS_SQL}"""


def _stem_pairs(spark, sf_dir):
    words = lambda c: P.stems(F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>")))
    made = turn_pairs(spark, sf_dir).select("conv_id", "turn", words(F.col("pt")).alias("p"), words(F.col("st")).alias("s"))
    return Scratch(spark, "stems").save(made, "pairs")  # read five times; no task holds a stemmer beside another Python step


def _rouge_rows(spark, sf_dir):
    key, pr = ["conv_id", "turn"], _stem_pairs(spark, sf_dir)
    grams = lambda c, n: pr.select(*key, F.explode(T.ngrams(F.col(c), n)).alias("g"))
    one, two = (H.overlap_f(grams("p", n), grams("s", n), key, "g").withColumnRenamed("f", f"rouge_{n}") for n in (1, 2))
    return pr.select(*key, H.lcs_f(F.col("p"), F.col("s")).alias("rouge_l")).join(one, key, "left").join(two, key, "left")


@query(f"WITH RECURSIVE {_ROUGE_SQL} SELECT pr.conv_id, pr.turn, f1.f AS rouge_1, f2.f AS rouge_2, fl.f AS rouge_l FROM pr LEFT JOIN f1 USING (conv_id, turn) LEFT JOIN f2 USING (conv_id, turn) LEFT JOIN fl USING (conv_id, turn)")
def rouge_stemmed(spark, sf_dir):
    """F of common stems, common pairs of stems and their longest common subsequence."""
    return _rouge_rows(spark, sf_dir)


@query(f"WITH RECURSIVE {_ROUGE_SQL} SELECT 'rouge_1' AS variant, count(f) AS n, round(avg(f), 4) AS mean FROM f1 UNION ALL SELECT 'rouge_2', count(f), round(avg(f), 4) FROM f2 UNION ALL SELECT 'rouge_l', count(f), round(avg(f), 4) FROM fl")
def rouge_stemmed_mean(spark, sf_dir):
    rows = _rouge_rows(spark, sf_dir).select(F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("f")) for v in ("rouge_1", "rouge_2", "rouge_l")])))
    return rows.groupBy("variant").agg(F.count("f").alias("n"), F.round(F.avg("f"), 4).alias("mean"))


#: Every eleventh page could not be read. A row of costs for each word of the reference; a substitution costs one more than 2^24.
_WER_SQL = r"""pg AS (SELECT a.conv_id, a.turn, list_filter(string_split_regex(a.text, '\s+'), lambda w: w <> '') AS r, CASE WHEN (a.conv_id * 7 + a.turn) % 11 > 0 THEN list_filter(string_split_regex(b.text, '\s+'), lambda w: w <> '') END AS h
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
al AS (SELECT conv_id, turn, r, h, 0 AS i, list_transform(range(0, len(h) + 1), lambda j: j::BIGINT * 16777216) AS row FROM pg WHERE h IS NOT NULL
  UNION ALL SELECT conv_id, turn, r, h, i + 1, list_transform(range(1, len(h) + 2), lambda j: list_min(best[1:j]) + (j - 1) * 16777216::BIGINT) FROM (
    SELECT *, list_transform(range(1, len(h) + 2), lambda j: CASE WHEN j = 1 THEN (i + 1)::BIGINT * 16777216 ELSE least(row[j] + 16777216, row[j - 1] + CASE WHEN h[j - 1] = r[i + 1] THEN 0 ELSE 16777217 END) END - (j - 1) * 16777216::BIGINT) AS best FROM al WHERE i < len(r))),
er AS (SELECT conv_id, turn, len(r) AS n, len(h) AS m, row[len(h) + 1] // 16777216 AS e, row[len(h) + 1] % 16777216 AS s FROM al WHERE i = len(r)),
wr AS (SELECT pg.conv_id, pg.turn, CASE WHEN n = 0 THEN (m > 0)::INT::DOUBLE ELSE e / n::DOUBLE END AS wer, n, s AS substitutions, (e - s + n - m) // 2 AS deletions, (e - s - n + m) // 2 AS insertions FROM pg LEFT JOIN er USING (conv_id, turn))"""


def _pages(spark, sf_dir):
    """Each turn read as a transcript of the one before it, with every eleventh reading failed."""
    read = F.when((F.col("conv_id") * 7 + F.col("turn")) % 11 > 0, F.col("pt"))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", H.word_errors(F.col("st"), read).alias("e")).select("conv_id", "turn", "e.*")


@query(f"WITH RECURSIVE {_WER_SQL} SELECT conv_id, turn, round(wer, 6) AS wer, (n - substitutions - deletions)::BIGINT AS hits, substitutions::BIGINT AS substitutions, deletions::BIGINT AS deletions, insertions::BIGINT AS insertions FROM wr")
def word_error_rate(spark, sf_dir):
    return _pages(spark, sf_dir).withColumn("wer", F.round("wer", 6))


@query(f"""WITH RECURSIVE {_WER_SQL}, g AS (SELECT conv_id % 5 AS engine, wer FROM wr), o AS (SELECT engine, wer, row_number() OVER (PARTITION BY engine ORDER BY wer) - 1 AS place, count(*) OVER (PARTITION BY engine) AS n FROM g WHERE wer IS NOT NULL),
u AS (SELECT engine, max(wer) AS upper_median FROM o WHERE place = n // 2 GROUP BY engine), t AS (SELECT engine, count(wer) AS n, count(*) FILTER (wer IS NULL) AS n_failed, avg(wer) AS mean FROM g GROUP BY engine)
SELECT engine, n, n_failed, round(mean, 6) AS mean, round(upper_median, 6) AS upper_median FROM t LEFT JOIN u USING (engine)""")
def wer_stats(spark, sf_dir):
    """Mean and upper median of word error rates over the pages that could be read."""
    got = H.error_rates(_pages(spark, sf_dir).withColumn("engine", F.col("conv_id") % 5), "engine", "wer")
    return got.select("engine", "n", "n_failed", F.round("mean", 6).alias("mean"), F.round("upper_median", 6).alias("upper_median"))


_TRACE = """'{"trace_id": "t' || event_id || '", "stages": [{"name": "retrieve", "duration_ms": ' || user_id || '}, {"name": "rerank", "duration_ms": ' || (event_id % 9) || '}], "top": ["c' || (event_id % 5) || '", "c9"], "cost": {"usd": ' || (event_id % 3) || '}}'"""


@query("SELECT event_id, 't' || event_id AS trace_id, stage, ms, 'c' || (event_id % 5) || ',c9' AS top FROM (SELECT event_id, 'retrieve' AS stage, user_id AS ms FROM events UNION ALL SELECT event_id, 'rerank', event_id % 9 FROM events)")
def trace_flatten(spark, sf_dir):
    """Stage durations and top ids of JSON traces as rows."""
    schema = "trace_id string, stages array<struct<name:string, duration_ms:bigint>>, top array<string>, cost map<string,double>"
    t = table(spark, sf_dir, "events").select("event_id", F.from_json(F.expr(_TRACE), schema).alias("t"))
    stages = F.map_from_entries("t.stages")
    return t.select("event_id", "t.trace_id", F.explode(stages).alias("stage", "ms"), F.array_join("t.top", ",").alias("top"))


@query("""SELECT e.user_id % 7 AS run, 'groundedness.' || event_type AS name, round(avg(value), 4) AS value FROM events e WHERE event_type <> 'error' GROUP BY ALL""")
def metric_names_flat(spark, sf_dir):
    """Metric rows of a report section to one flat map: only measured ones, their names with the task before them."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 7).alias("run"), F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 4).alias("v"))
    section = F.collect_list(F.struct("name", F.when(F.col("name") != "error", F.col("v")).alias("value"), F.when(F.col("name") == "error", "unavailable").otherwise("ok").alias("status")))
    flat = F.filter(section, lambda m: (m["status"] == "ok") & m["value"].isNotNull())
    return e.groupBy("run").agg(F.map_from_entries(F.transform(flat, lambda m: F.struct(F.concat(F.lit("groundedness."), m["name"]), m["value"]))).alias("m")).select("run", F.explode("m").alias("name", "value"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'judgments' WHEN 1 THEN 'in_force_label' ELSE 'label' END AS field, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'repealed' ELSE 'entailed' END AS gold FROM labels")
def label_fields(spark, sf_dir):
    """The field that holds a task's label, and its value from whichever field has one."""
    k = F.col("doc_id") % 3
    task = F.when(k == 0, "retrieval").when(k == 1, "repealed").otherwise("entailment")
    rows = table(spark, sf_dir, "labels").select("doc_id", task.alias("task"), F.when(k == 2, "entailed").alias("label"), F.when(k == 1, "repealed").alias("in_force_label"))
    field = F.when(F.col("task") == "retrieval", "judgments").when(F.col("task") == "repealed", "in_force_label").otherwise("label")
    return rows.select("doc_id", field.alias("field"), F.coalesce("label", "in_force_label").alias("gold"))


@query("""SELECT p_partkey, '{"question":"q' || p_partkey || '","detail":{"note":"n"}}' AS shown FROM part""")
def blind_items(spark, sf_dir):
    """Items as a rater sees them: no field, at any depth, that names the system."""
    p = table(spark, sf_dir, "part")
    detail = F.struct(F.lit("n").alias("note"), F.lit("m1").alias("model_id"), F.lit("a").alias("arm"))
    items = p.select("p_partkey", F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("question"), F.lit("ours").alias("system"), detail.alias("detail"), F.lit(True).alias("is_ours"))
    return H.blind(items).select("p_partkey", F.to_json(F.struct("question", "detail")).alias("shown"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'no_gold' WHEN event_type = 'error' THEN 'unavailable' ELSE 'pair' END AS state FROM events WHERE event_id % 4 > 0 AND event_type <> 'error'""")
def prediction_gold_pairs(spark, sf_dir):
    """Predictions with their gold, where neither is null."""
    e = table(spark, sf_dir, "events")
    pred = e.select("event_id", F.when(F.col("event_type") != "error", F.col("value") > 50).alias("predicted"))
    gold = e.select("event_id", F.when(F.col("event_id") % 4 > 0, F.lit(True)).alias("gold"))
    return pred.join(gold, "event_id").where("predicted IS NOT NULL AND gold IS NOT NULL").select("event_id", F.lit("pair").alias("state"))


_ANN_SQL = "an AS (SELECT event_id, user_id AS item, event_type AS rater, CASE WHEN event_id % 10 = 0 THEN 'cold' ELSE 'correction' END AS mode, CASE WHEN event_id % 10 > 0 AND user_id % 6 > 0 THEN CASE WHEN event_id % 4 < 2 THEN 'yes' ELSE 'no' END END AS proposed, CASE WHEN value > 50 THEN 'yes' ELSE 'no' END AS label FROM events)"


def _annotations(spark, sf_dir):
    k, i = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id", i.alias("item"), F.col("event_type").alias("rater"), F.when(k % 10 == 0, "cold").otherwise("correction").alias("mode"), F.when((k % 10 > 0) & (i % 6 > 0), F.when(k % 4 < 2, "yes").otherwise("no")).alias("proposed"), F.when(F.col("value") > 50, "yes").otherwise("no").alias("label")
    )


@query(f"""WITH {_ANN_SQL}, f AS (SELECT item, arg_min(proposed, event_id) AS model_label FROM an WHERE proposed IS NOT NULL GROUP BY item)
SELECT mode, count(*) AS n, round(avg((label = model_label)::INT::DOUBLE), 4) AS agreement FROM an JOIN f USING (item) GROUP BY mode""")
def proposal_lookup(spark, sf_dir):
    """Agreement with an item's first proposal, by mode; items nobody proposed for are left out."""
    a = _annotations(spark, sf_dir)
    first = a.where("proposed IS NOT NULL").groupBy("item").agg(F.min_by("proposed", "event_id").alias("model_label"))
    return a.join(first, "item").groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("model_label")).cast("double")), 4).alias("agreement"))


@query(f"WITH {_ANN_SQL} SELECT event_id, item, rater, mode, CASE WHEN mode = 'cold' OR proposed IS NULL THEN NULL ELSE label = proposed END AS accepted_proposal FROM an")
def annotation_records(spark, sf_dir):
    """Records as they are appended: nothing is accepted in cold mode, where nothing was proposed."""
    a = _annotations(spark, sf_dir)
    return a.select("event_id", "item", "rater", "mode", F.when((F.col("mode") != "cold") & F.col("proposed").isNotNull(), F.col("label") == F.col("proposed")).alias("accepted_proposal"))


@query(f"WITH {_ANN_SQL} SELECT item, count(*) AS n, string_agg(DISTINCT rater, ',' ORDER BY rater) AS raters FROM an GROUP BY item")
def log_by_item(spark, sf_dir):
    return _annotations(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("rater")), ",").alias("raters"))


@query(f"""WITH {_CLAIMS_SQL}, b AS (SELECT answer_id, count(*) AS n, bool_or(score IS NULL) AS down, count(*) FILTER (n_passages > 0 AND score >= 0.7::DOUBLE) AS ok FROM claims GROUP BY answer_id)
SELECT answer_id, CASE WHEN down OR ok = 0 THEN 'REFUSE' WHEN ok < n THEN 'PARTIAL_ALLOW' ELSE 'ANSWER' END AS decision, CASE WHEN down THEN 'verifier_unavailable' WHEN ok = 0 THEN 'all_claims_struck_by_verification' WHEN ok < n THEN 'partial_claims_verified' ELSE 'all_claims_verified' END AS reason FROM b
UNION ALL SELECT -1, 'REFUSE', 'no_claims'""")
def decision_bridge(spark, sf_dir):
    """Decisions where only a generic verifier's score is at hand; one answer has no claim."""
    c = claims(spark, sf_dir).select("answer_id", "claim_id", "n_passages", "score", F.when(F.col("score").isNull(), "unavailable").otherwise("ok").alias("status"))
    none = spark.createDataFrame([(-1,)], "answer_id long").select("answer_id", F.lit(None).cast("long").alias("claim_id"), F.lit(0).cast("long").alias("n_passages"), F.lit(None).cast("double").alias("score"), F.lit("ok").alias("status"))
    return H.bridge(c.unionByName(none), "answer_id")


@query(f"WITH {_CLAIMS_SQL} SELECT claim_id, round(0.6::DOUBLE * score + 0.4::DOUBLE * (n_passages / 4::DOUBLE), 4) AS blended, round(0.6::DOUBLE * score + 0.4::DOUBLE * (n_passages / 4::DOUBLE), 4) >= 0.7::DOUBLE AS passed FROM claims")
def faithfulness_blend(spark, sf_dir):
    b = H.blend(F.col("score"), F.col("n_passages") / F.lit(4.0))
    return claims(spark, sf_dir).select("claim_id", b.alias("b")).select("claim_id", F.col("b.score").alias("blended"), "b.passed")


@query(f"WITH {_CLAIMS_SQL} SELECT claim_id, CASE WHEN score IS NOT NULL THEN score >= 0.7::DOUBLE END AS predicted FROM claims")
def verifier_predictions(spark, sf_dir):
    """A prediction where the verifier answered, null where it did not."""
    c = claims(spark, sf_dir).withColumn("status", F.when(F.col("score").isNull(), "unavailable").otherwise("ok"))
    return c.select("claim_id", F.when(F.col("status") == "ok", F.col("score") >= config.FAITHFULNESS_THRESHOLD).alias("predicted"))


@query(f"""WITH {_CLAIMS_SQL}, u AS (SELECT CASE WHEN score IS NULL THEN 'unavailable' WHEN answer_id % 6 = 0 THEN 'unlabelled' ELSE 'used' END AS usage, score, answer_id % 2 = 0 AS ok FROM claims),
b AS (SELECT least(floor(score * 10)::INT, 9) AS bin, count(*) AS n, round(avg(score), 4) AS c, round(avg(ok::INT::DOUBLE), 4) AS a FROM u WHERE usage = 'used' GROUP BY 1)
SELECT round(sum(n * abs(c - a)) / sum(n), 4) AS ece, sum(n)::BIGINT AS n, (SELECT count(*) FROM u WHERE usage = 'unavailable') AS n_unavailable, (SELECT count(*) FROM u WHERE usage = 'unlabelled') AS n_unlabelled FROM b""")
def calibration(spark, sf_dir):
    """Verifier scores against gold correctness; scores that are missing and items without gold are counted, not used."""
    c = claims(spark, sf_dir).select(F.col("answer_id").alias("item"), "score", F.when(F.col("score").isNull(), "unavailable").otherwise("ok").alias("status"))
    gold = c.select("item").distinct().where("item % 6 > 0").withColumn("correct", F.col("item") % 2 == 0)
    p = H.calibration_pairs(c, gold, "item")
    counts = p.agg(F.count_if(F.col("usage") == "unavailable").alias("n_unavailable"), F.count_if(F.col("usage") == "unlabelled").alias("n_unlabelled"))
    return E.ece(E.reliability(p.where("usage = 'used'"), "score", "correct")).crossJoin(counts)  # one row each


_OOS_SQL = "o AS (SELECT l.doc_id, quality, CASE WHEN l.doc_id % 9 = 0 THEN 'no_doc' WHEN d.n_chars < 200 THEN 'no_chunks' ELSE 'scored' END AS state, d.n_chars FROM labels l JOIN documents d USING (doc_id) WHERE quality IS NOT NULL)"


@query(f"WITH {_OOS_SQL} SELECT count(*) AS n_items, count(*) FILTER (state = 'scored') AS n_scored, count(*) FILTER (state = 'no_doc') AS skipped_no_doc_id, count(*) FILTER (state = 'no_chunks') AS skipped_no_chunks, CASE WHEN count(*) FILTER (state = 'scored') < 10 THEN 'unavailable' ELSE 'fitted' END AS status FROM o")
def oos_calibration_counts(spark, sf_dir):
    """Which items a scaler can be fitted on; under ten it is not fitted."""
    d = F.when(F.col("doc_id") % 9 == 0, "no_doc").when(F.col("n_chars") < 200, "no_chunks").otherwise("scored")
    o = table(spark, sf_dir, "labels").where("quality IS NOT NULL").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(d.alias("s"))
    n = lambda s: F.count_if(F.col("s") == s)
    return o.agg(F.count("*").alias("n_items"), n("scored").alias("n_scored"), n("no_doc").alias("skipped_no_doc_id"), n("no_chunks").alias("skipped_no_chunks"), F.when(n("scored") < 10, "unavailable").otherwise("fitted").alias("status"))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_size >= 45 AND p_partkey % 2 = 0 THEN '1-critical' WHEN p_partkey % 2 = 0 THEN '2-high' WHEN p_size >= 45 THEN '3-medium' ELSE '4-routine' END AS band, p_type || p_partkey % 2 AS stratum, sha256('42:' || p_partkey) AS h FROM part),
r AS (SELECT *, (row_number() OVER (PARTITION BY band, stratum ORDER BY h, p_partkey) > 1)::INT AS later FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY later, h, p_partkey) AS r FROM r),
z AS (SELECT count(*) FILTER (band = '1-critical') AS a, count(*) FILTER (band = '2-high') AS b, count(*) FILTER (band = '3-medium') AS c, count(*) FILTER (band = '4-routine') AS d FROM s),
t1 AS (SELECT *, least(a, 50) AS ta, least(b, 90) AS tb, least(c, 40) AS tc, least(d, 20) AS td FROM z), t2 AS (SELECT *, 200 - ta - tb - tc - td AS l0 FROM t1),
t3 AS (SELECT *, least(a - ta, l0) AS xa FROM t2), t4 AS (SELECT *, least(b - tb, l0 - xa) AS xb FROM t3), t5 AS (SELECT *, least(c - tc, l0 - xa - xb) AS xc FROM t4), t6 AS (SELECT *, least(d - td, l0 - xa - xb - xc) AS xd FROM t5)
SELECT p_partkey, band, stratum FROM q, t6 WHERE r <= CASE band WHEN '1-critical' THEN ta + xa WHEN '2-high' THEN tb + xb WHEN '3-medium' THEN tc + xc ELSE td + xd END""")
def stratified_audit_draw(spark, sf_dir):
    """200 rows for an audit by priority, one of each stratum first, shortfalls passed on in order."""
    k, high = F.col("p_partkey") % 2 == 0, F.col("p_size") >= 45
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k & high, "1-critical").when(k, "2-high").when(high, "3-medium").otherwise("4-routine").alias("band"), F.concat("p_type", (F.col("p_partkey") % 2).cast("string")).alias("stratum"))
    return H.stratified_draw(rows, "p_partkey", "stratum", "band", 200, {"1-critical": 0.25, "2-high": 0.45, "3-medium": 0.20, "4-routine": 0.10})


#: The candidates of an item are the lines of its document; a line's logit follows from its length. 200 steps of gradient descent.
_OOS_SQL = """oi AS (SELECT row_number() OVER (ORDER BY doc_id) AS item, CASE WHEN doc_id % 9 > 0 THEN doc_id END AS d, quality AS y FROM labels WHERE quality IS NOT NULL),
oc AS (SELECT doc_id AS d, max(length(l) % 97 / 24.0 - 2)::DOUBLE AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(l) >= 40 GROUP BY doc_id),
os AS (SELECT d IS NOT NULL AS known, y::DOUBLE AS y, x FROM oi LEFT JOIN oc USING (d)), op AS MATERIALIZED (SELECT x, y, count(*) AS c FROM os WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY x, y),
gd AS (SELECT 0 AS i, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL SELECT i + 1, a - 0.1 * sum(e * x * c) / sum(c), b - 0.1 * sum(e * c) / sum(c) FROM (SELECT i, a, b, x, c, 1 / (1 + exp(-greatest(-30, least(30, a * x + b)))) - y AS e FROM gd, op WHERE i < 200) GROUP BY i, a, b),
ab AS (SELECT a, b FROM gd WHERE i = 200), ot AS (SELECT count(x) >= 10 AS fitted, count(*) AS n_items, count(x) AS n_scored, count(*) FILTER (NOT known) AS no_doc, count(*) FILTER (known AND x IS NULL) AS no_chunks FROM os)"""


@query(f"""WITH RECURSIVE {_OOS_SQL} SELECT CASE WHEN fitted THEN 'fitted' ELSE 'unavailable' END AS status, CASE WHEN NOT fitted THEN 'fewer than 10 items with candidates' END AS reason, CASE WHEN fitted THEN round(a, 4) END AS slope, CASE WHEN fitted THEN round(b, 4) END AS "offset",
n_items, n_scored, no_doc AS skipped_no_doc_id, no_chunks AS skipped_no_chunks, CASE WHEN fitted THEN round(coalesce(m1, 0), 4) END AS mean_in_scope, CASE WHEN fitted THEN round(coalesce(m0, 0), 4) END AS mean_oos
FROM ot LEFT JOIN ab ON true, (SELECT avg(1 / (1 + exp(-(a * x + b)))) FILTER (y = 1) AS m1, avg(1 / (1 + exp(-(a * x + b)))) FILTER (y = 0) AS m0 FROM os LEFT JOIN ab ON true)""")
def oos_calibration(spark, sf_dir):
    """The whole calibration job over items whose document has lines to retrieve."""
    items = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select(F.col("doc_id").alias("item"), F.when(F.col("doc_id") % 9 > 0, F.col("doc_id")).alias("doc_id"), F.col("quality").alias("in_scope"))
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.explode(F.split("text", "\n")).alias("l")).where(F.length("l") >= 40)
    return H.oos_calibration(items, lines.select("item", (F.length("l") % 97 / 24.0 - 2).alias("logit")))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r < round_even(n * 0.8::DOUBLE, 0) THEN 'train' WHEN r < round_even(n * 0.8::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM r""")
def exact_split(spark, sf_dir):
    """80/10/10 with exact counts by a hash order."""
    return H.exact_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM labels) SELECT doc_id, CASE WHEN r < n // 2 THEN 'groundedness' ELSE 'entailment' END AS gold_set, 'seed-' || lpad((CASE WHEN r < n // 2 THEN r ELSE r - n // 2 END)::VARCHAR, 8, '0') AS item_id FROM i""")
def seed_gold_halves(spark, sf_dir):
    """Two gold sets from one list of pairs, disjoint by its order."""
    l = table(spark, sf_dir, "labels").select("doc_id")
    half = l.count() // 2
    r = ranked(l, F.col("doc_id"))
    first = F.col("rank") < half
    n = F.lpad(F.when(first, F.col("rank")).otherwise(F.col("rank") - half).cast("string"), 8, "0")
    return r.select("doc_id", F.when(first, "groundedness").otherwise("entailment").alias("gold_set"), F.concat(F.lit("seed-"), n).alias("item_id"))


@query("""SELECT name, CASE WHEN v IS NULL THEN '_unavailable_' ELSE format('{:,.4f}', v) END AS cell FROM (SELECT event_type AS name, CASE WHEN event_type <> 'error' THEN round(sum(value), 4) END AS v FROM events GROUP BY event_type)""")
def report_cells(spark, sf_dir):
    """Values as a report prints them; what was not measured says so."""
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.when(F.col("event_type") != "error", F.round(F.sum("value"), 4)).alias("v"))
    return g.select("name", F.coalesce(F.format_number("v", 4), F.lit("_unavailable_")).alias("cell"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 'live' ELSE 'cached ' || p_size END AS prediction, CASE WHEN p_partkey % 5 = 0 THEN 'OCR_FAIL' ELSE 'OCR_OK' END AS status FROM part""")
def cached_predictions(spark, sf_dir):
    """The cached text first, the live one where there is none; a blank one is a failure."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    cache = p.where("p_partkey % 5 <> 1").select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("cached "), F.col("p_size").cast("string"))).otherwise("  ").alias("text"))
    j = p.select("p_partkey").join(cache, "p_partkey", "left").withColumn("text", F.coalesce("text", F.lit("live")))
    ok = F.length(F.trim("text")) > 0
    return j.select("p_partkey", F.when(ok, F.col("text")).alias("prediction"), F.when(ok, "OCR_OK").otherwise("OCR_FAIL").alias("status"))


@query("SELECT l.doc_id, l.toxic FROM labels l WHERE l.doc_id % 10 IN (8, 9) AND l.doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 4 = 0)")
def holdout_only(spark, sf_dir):
    """Rows whose id the test list has and the train list has not."""
    l = table(spark, sf_dir, "labels")
    return l.join(l.where("doc_id % 10 IN (8, 9)").select("doc_id"), "doc_id", "left_semi").join(l.where("doc_id % 4 = 0").select("doc_id"), "doc_id", "left_anti").select("doc_id", "toxic")


@query("SELECT doc_id, row_number() OVER (PARTITION BY CASE WHEN doc_id % 3 = 0 THEN 'train' ELSE 'test' END ORDER BY doc_id) AS n, CASE WHEN doc_id % 3 = 0 THEN 'train' ELSE 'test' END AS split FROM documents WHERE doc_id % 17 > 0 QUALIFY n <= 50")
def batch_requests(spark, sf_dir):
    """Request rows of a batch: dropped documents left out, a limit per split."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    kept = d.join(d.where("doc_id % 17 = 0"), "doc_id", "left_anti").withColumn("split", F.when(F.col("doc_id") % 3 == 0, "train").otherwise("test"))
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("split").orderBy("doc_id")).cast("bigint")).where("n <= 50").select("doc_id", "n", "split")
