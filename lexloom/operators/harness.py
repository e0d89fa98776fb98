"""Evaluation harness: measures as rows, agreement by task, decisions, calibration, gold sets and annotation logs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom import config
from lexloom.functions import measures as M
from lexloom.functions.text import let
from lexloom.operators.evaluation import platt_fit
from lexloom.sources.files import save_scaler

#: What a registry can answer, and which of the answers mean that the target exists.
REGISTRY_STATUSES = ("in_force", "repealed", "superseded", "not_found")
#: Fields that would tell a rater which system made an item.
BLINDED_FIELDS = ("system", "system_name", "model", "model_id", "run_id", "arm", "condition", "baseline", "is_ours", "provenance", "proposed_by")


def measure_rows(df: DataFrame, keys: list[str], measures: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """keys, name, value, status, n, reason: one row per measure from (value, n, reason where the value is null)."""
    structs = [M.measure(name, F.round(value, 4), n, reason) for name, (value, n, reason) in measures.items()]
    return df.select(*keys, F.inline(F.array(*structs)))


def citation_measures(citations: DataFrame, keys: list[str]) -> DataFrame:
    """Five measures for each run from its claims: (has_citation, status, supported); what cannot be measured is a row with a reason, never 0.

    status is null for a claim without citation; supported is null where nobody judged.
    """
    status = F.col("status")
    known = status.isin(*[s for s in REGISTRY_STATUSES if s != "not_found"])
    c = citations.groupBy(*keys).agg(
        F.count("*").alias("claims"),
        F.count_if("has_citation").alias("cited"),
        F.count(status).alias("resolved"),
        F.count_if(known).alias("known"),
        F.count_if(status.isin("repealed", "superseded")).alias("old"),
        F.min(F.when(~status.isin(*REGISTRY_STATUSES), status)).alias("bad"),
        F.count("supported").alias("judged"),
        F.count_if("supported").alias("supported"),
    )
    col, none = F.col, F.lit("no_resolved_citations_supplied")
    share = lambda a, b: F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return measure_rows(
        c,
        keys,
        {
            "citation_coverage": (share("cited", "claims"), col("claims"), F.lit("no_claims_generated")),
            "registry_coverage_rate": (share("known", "resolved"), col("resolved"), none),
            "citation_validity_rate": (F.when(col("bad").isNull(), share("known", "resolved")), col("resolved"), F.coalesce(F.concat(F.lit("malformed_registry_status:"), "bad"), none)),
            "repealed_citation_rate": (share("old", "known"), F.when(col("known") > 0, col("known")).otherwise(col("resolved")), F.when(col("resolved") > 0, "registry_resolved_nothing").otherwise(none)),
            "citation_support_rate": (share("supported", "judged"), F.when(col("judged") > 0, col("judged")).otherwise(col("claims")), F.lit("no_judged_citations")),
        },
    )


def retrieval_measures(per_query: DataFrame, keys: list[str], ks=config.K_VALUES) -> DataFrame:
    """Means of the per-query measures as rows; without any judged query each is unavailable. per_query has a judged flag."""
    names = [*[f"recall{k}" for k in ks], *[f"precision{k}" for k in ks], "rr", "ndcg"]
    c = per_query.groupBy(*keys).agg(F.count("*").alias("__n"), F.max("judged").alias("__judged"), *[F.avg(x).alias(x) for x in names])
    label = lambda x: "mrr" if x == "rr" else f"ndcg@{config.NDCG_K}" if x == "ndcg" else x.rstrip("0123456789") + "@" + x.lstrip("recalpison")
    return measure_rows(c, keys, {label(x): (F.when(F.col("__judged"), F.col(x)), F.col("__n"), F.lit("no_relevance_judgments")) for x in names})


def agreement_by(ratings: DataFrame, task: str, item: str = "item_id", rater: str = "rater_id", label: str = "label") -> DataFrame:
    """One row per task: statistic, value, n_items, n_raters, reason.

    Under two raters there is none; two raters get Cohen's kappa over the items both rated, more get Krippendorff's
    alpha over items rated more than once. One label only makes the value null with a reason. No pair of raters is formed.
    """
    tasks = ratings.groupBy(task).agg(F.countDistinct(rater).alias("n_raters"), F.countDistinct(item).alias("all_items"))
    two = ratings.groupBy(task, item).agg(F.count("*").alias("c"), F.min_by(label, rater).alias("a"), F.max_by(label, rater).alias("b")).where("c = 2")
    n = two.groupBy(task).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    left, right = two.groupBy(task, F.col("a").alias("l")).agg(F.count("*").alias("na")), two.groupBy(task, F.col("b").alias("l")).agg(F.count("*").alias("nb"))
    both = left.join(right, [task, "l"]).groupBy(task).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("both"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("both", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    kappa = n.join(both, task, "left").select(task, F.col("n").alias("kappa_n"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))
    c = ratings.groupBy(task, item, label).agg(F.count("*").alias("c")).withColumn("m", F.sum("c").over(Window.partitionBy(task, item))).where("m > 1")
    w = c.groupBy(task, label).agg(F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("same"), F.sum("c").cast("double").alias("k"))
    t = w.groupBy(task).agg(F.sum("k").alias("total"), F.sum("same").alias("same"), F.sum(F.col("k") * (F.col("k") - 1)).alias("chance"))
    de = (F.col("total") * (F.col("total") - 1) - F.col("chance")) / (F.col("total") - 1)
    items = c.groupBy(task).agg(F.countDistinct(item).alias("alpha_n"))
    alpha = t.join(items, task).select(task, "alpha_n", F.when(de > 0, 1 - (F.col("total") - F.col("same")) / de).alias("alpha"))
    j = tasks.join(kappa, task, "left").join(alpha, task, "left")
    few, pair = F.col("n_raters") < 2, F.col("n_raters") == 2
    value = F.when(few, None).when(pair, F.round("kappa", 4)).otherwise(F.round("alpha", 4))
    found = F.when(few, F.col("all_items")).when(pair, F.coalesce("kappa_n", "all_items")).otherwise(F.coalesce("alpha_n", F.lit(0)))
    reason = F.when(few, "fewer_than_two_raters").when(pair & F.col("kappa_n").isNull(), "no_commonly_rated_items").when(value.isNull(), "one_label_only").otherwise("")
    return j.select(task, F.when(few | pair, "cohen_kappa").otherwise("krippendorff_alpha").alias("statistic"), value.alias("value"), found.alias("n_items"), "n_raters", reason.alias("reason"))


def half_width(n: Column, p: float = 0.5, z: float = config.Z_95) -> Column:
    """Half of the normal interval of a share p from n rows; null for none."""
    return F.when(n > 0, z * F.sqrt(p * (1 - p) / n))


def sizing_note(name: Column, n: Column, target: Column) -> Column:
    """One line that states the achieved size, whether it meets the target, and the interval that follows."""
    head = F.concat(name, F.lit(": n="), n.cast("string"), F.lit(" ("), F.when(n >= target, "meets target").otherwise("BELOW target"), F.lit(", target "), target.cast("string"), F.lit(") gives a 95% CI half-width of +/-"))
    none = F.concat(name, F.lit(": 0 items -- no interval exists. Target was "), target.cast("string"), F.lit("."))
    return F.when(n == 0, none).otherwise(F.concat(head, F.format_number(half_width(n) * 100, 1), F.lit("% on a proportion at p=0.5.")))


def blind(df: DataFrame, fields: tuple[str, ...] = BLINDED_FIELDS) -> DataFrame:
    """df without the fields that tell the system, at any depth of structs."""

    def kept(c: Column, t: T.DataType) -> Column:
        if not isinstance(t, T.StructType):
            return c
        return F.when(c.isNotNull(), F.struct(*[kept(c[f.name], f.dataType).alias(f.name) for f in t if f.name not in fields]))

    return df.select(*[kept(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema if f.name not in fields])


def bridge(claims: DataFrame, answer: str, threshold: float = config.FAITHFULNESS_THRESHOLD) -> DataFrame:
    """Decision from a single verifier's (status, score, n_passages): ANSWER, PARTIAL_ALLOW or REFUSE with its reason.

    Any unavailable verdict refuses, whatever the other claims say; a claim stands with a passage and a score at the threshold.
    """
    stands = (F.col("n_passages") > 0) & F.coalesce(F.col("score") >= threshold, F.lit(False))
    g = claims.groupBy(answer).agg(F.count("claim_id").alias("n"), F.max(F.col("status") == "unavailable").alias("down"), F.count_if(stands).alias("ok"))
    decision = F.when((F.col("n") == 0) | F.col("down") | (F.col("ok") == 0), "REFUSE").when(F.col("ok") < F.col("n"), "PARTIAL_ALLOW").otherwise("ANSWER")
    reason = F.when(F.col("n") == 0, "no_claims").when(F.col("down"), "verifier_unavailable").when(F.col("ok") == 0, "all_claims_struck_by_verification")
    return g.select(answer, decision.alias("decision"), reason.when(F.col("ok") < F.col("n"), "partial_claims_verified").otherwise("all_claims_verified").alias("reason"))


def blend(h: Column, j: Column, threshold: float = config.FAITHFULNESS_THRESHOLD) -> Column:
    """struct(score, passed): 0.6 h + 0.4 j; a missing part makes both null, never a stand-in."""
    score = F.round(0.6 * h + 0.4 * j, 4)
    return F.struct(score.alias("score"), (score >= threshold).alias("passed"))


def calibration_pairs(verifications: DataFrame, gold: DataFrame, item: str) -> DataFrame:
    """verifications (item, status, score) with correct, and usage: used, unavailable (no score) or unlabelled (no gold)."""
    j = verifications.join(gold.select(item, "correct"), item, "left")
    usage = F.when((F.col("status") != "ok") | F.col("score").isNull(), "unavailable").when(F.col("correct").isNull(), "unlabelled").otherwise("used")
    return j.withColumn("usage", usage)


def stratified_draw(rows: DataFrame, key: str, stratum: str, band: str, n: int, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """n rows drawn by a hash order: each band's share of n, one row of each of its strata first; what bands lack goes to the bands in order.

    Within a band rows are ranked by (first of its stratum, hash); a band gives its budget, then the shortfall is
    shared out over one row per band. Only the best n of a band are ever ranked against each other.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    h = rows.withColumn("__h", order)
    h = h.withColumn("__later", (F.row_number().over(Window.partitionBy(band, stratum).orderBy("__h", key)) > 1).cast("int"))
    h = h.withColumn("__r", F.row_number().over(Window.partitionBy(band).orderBy("__later", "__h", key))).where(F.col("__r") <= n)
    names = sorted(shares)
    sizes = {r[0]: r[1] for r in h.groupBy(band).count().collect()}  # one row per band
    left, taken = n, {}
    for b in names:
        taken[b] = min(sizes.get(b, 0), round(n * shares[b]), left)
        left -= taken[b]
    for b in names:
        more = min(sizes.get(b, 0) - taken[b], left)
        taken[b] += more
        left -= more
    quota = F.lit(0)
    for b in names:
        quota = F.when(F.col(band) == b, taken[b]).otherwise(quota)
    return h.where(F.col("__r") <= quota).drop("__h", "__later", "__r")


def exact_split(df: DataFrame, key: str, seed: int = config.SPLIT_SEED, ratios=config.SPLIT_RATIOS) -> DataFrame:
    """df with split: the first round(n * train) of a hash order, the next round(n * val), the rest; the counts are exact."""
    from lexloom.operators.ordering import ranked

    n = df.count()
    a, b = round(n * ratios[0]), round(n * ratios[1])
    h = df.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    r = F.col("__r")
    return ranked(h, F.col("__h"), F.col(key), name="__r").withColumn("split", F.when(r < a, "train").when(r < a + b, "val").otherwise("test")).drop("__h", "__r")


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """struct(wer, hits, substitutions, deletions, insertions) of two texts by words; of all shortest alignments one with the fewest substitutions.

    An empty reference has rate 0 against an empty hypothesis, else 1. A null hypothesis, a page that could not be read,
    has no errors and no rate.
    """

    @F.pandas_udf("wer double, hits long, substitutions long, deletions long, insertions long")
    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 5 if h is None else _aligned((r or "").split(), h.split()) for r, h in zip(left, right, strict=True)]
        return pd.DataFrame(rows, columns=["wer", "hits", "substitutions", "deletions", "insertions"]).astype({"wer": "float64", **dict.fromkeys(["hits", "substitutions", "deletions", "insertions"], "Int64")})

    return run(reference, hypothesis)


#: A substitution costs one more than the unit of a deletion or an insertion, so that the sum tells both numbers.
EDIT = 1 << 24


def _aligned(reference: list[str], hypothesis: list[str]) -> tuple[float, int, int, int, int]:
    n, m = len(reference), len(hypothesis)
    if n == 0:
        return (float(m > 0), 0, 0, 0, m)
    codes: dict[str, int] = {}
    r, h = ([codes.setdefault(w, len(codes)) for w in words] for words in (reference, hypothesis))
    h, steps = np.array(h, np.int64), np.arange(m + 1) * EDIT
    row = steps.copy()
    for i, word in enumerate(r):
        best = row + EDIT  # a deletion
        best[1:] = np.minimum(best[1:], row[:-1] + np.where(h == word, 0, EDIT + 1))
        best[0] = (i + 1) * EDIT
        row = np.minimum.accumulate(best - steps) + steps  # any number of insertions
    edits, substitutions = divmod(int(row[-1]), EDIT)
    deletions = (edits - substitutions + n - m) // 2
    return edits / n, n - substitutions - deletions, substitutions, deletions, edits - substitutions - deletions


def error_rates(rows: DataFrame, group: str, wer: str) -> DataFrame:
    """group, n, n_failed, mean and upper median (the place n // 2 in order) of the rates; rows without a rate have failed and count only there."""
    sizes = rows.groupBy(group).agg(F.count(wer).alias("n"), F.count_if(F.col(wer).isNull()).alias("n_failed"), F.avg(wer).alias("mean"))
    # equal rates are one row with their number, so no task holds a group's rates
    counts = rows.where(F.col(wer).isNotNull()).groupBy(group, wer).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(group).orderBy(wer))
    placed = counts.withColumn("__upto", upto).join(sizes, group).where((F.col("__upto") > F.floor(F.col("n") / 2)) & (F.col("__upto") - F.col("__c") <= F.floor(F.col("n") / 2)))
    return sizes.join(placed.select(group, F.col(wer).alias("upper_median")), group, "left").select(group, "n", "n_failed", "mean", "upper_median")


def oos_calibration(items: DataFrame, candidates: DataFrame, item: str = "item", doc: str = "doc_id", label: str = "in_scope", least: int = 10, rounds: int = 200, path: str | None = None) -> DataFrame:
    """The calibration job for questions in and out of scope as one row: status, reason, slope, offset, n_items, n_scored, what was skipped and why, and the mean probability of each class.

    items have a document (null: skipped) and a label; candidates are the chunks that retrieval and reranker gave for an item, with their logit, of which
    the largest counts; an item without candidates is skipped. Below `least` scored items nothing is fitted. With a path a fitted scaler is saved there.
    """
    top = candidates.groupBy(F.col(item).alias("__item")).agg(F.max("logit").alias("x"))
    rows = items.join(top, F.col(item) == F.col("__item"), "left").select(F.col(doc).isNotNull().alias("known"), F.col(label).cast("double").alias("y"), F.when(F.col(doc).isNotNull(), F.col("x")).alias("x")).checkpoint()
    scored = rows.where("x IS NOT NULL")
    fitted = scored.count() >= least
    a, b = platt_fit(scored, "x", "y", rounds=rounds) if fitted else (None, None)
    if fitted and path is not None:
        save_scaler(items.sparkSession, path, a, b, 0.5)
    p = M.sigmoid(F.lit(a) * F.col("x") + F.lit(b)) if fitted else F.lit(None).cast("double")
    mean = lambda y: F.round(F.coalesce(F.avg(F.when(F.col("y") == y, p)), F.lit(0.0 if fitted else None).cast("double")), 4)
    return rows.agg(
        F.lit("fitted" if fitted else "unavailable").alias("status"),
        F.lit(None if fitted else f"fewer than {least} items with candidates").cast("string").alias("reason"),
        *[F.round(F.lit(v).cast("double"), 4).alias(n) for n, v in (("slope", a), ("offset", b))],
        F.count("*").alias("n_items"),
        F.count("x").alias("n_scored"),
        F.count_if(~F.col("known")).alias("skipped_no_doc_id"),
        F.count_if(F.col("known") & F.col("x").isNull()).alias("skipped_no_chunks"),
        mean(1).alias("mean_in_scope"),
        mean(0).alias("mean_oos"),
    )


def overlap_f(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys and the F measure of two multisets of items (n-grams): twice the common count over the sum of the sizes."""
    ca, cb = a.groupBy(*keys, item).agg(F.count("*").alias("x")), b.groupBy(*keys, item).agg(F.count("*").alias("y"))
    j = ca.join(cb, [*keys, item], "full").groupBy(*keys).agg(F.sum(F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))).alias("c"), F.coalesce(F.sum("x"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("m"))
    return j.select(*keys, F.round(2 * F.col("c") / (F.col("n") + F.col("m")), 4).alias("f"))


def lcs_f(a: Column, b: Column) -> Column:
    """F measure of the longest common subsequence of two arrays of words; null if both are empty.

    Bit-parallel: the row of the table is one integer, with a bit for each word of b.
    """

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_lcs_f(x, y) for x, y in zip(left, right)], dtype="float64")

    return F.round(run(a, b), 4)


def _lcs_f(a, b) -> float | None:
    n, m = (0 if a is None else len(a)), (0 if b is None else len(b))
    if n + m == 0:
        return None
    at: dict[str, int] = {}
    for j in range(m):
        at[b[j]] = at.get(b[j], 0) | 1 << j
    full = (1 << m) - 1
    row = full
    for i in range(n):
        hit = row & at.get(a[i], 0)
        row = (row + hit | row - hit) & full
    common = m - row.bit_count()
    return 2 * common / (n + m)
