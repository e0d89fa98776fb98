"""Evaluation: retrieval, refusal, agreement, calibration and comparison of runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import config
from lexloom.functions import measures as M


def retrieval_per_query(ranked: DataFrame, judged: DataFrame, queries: DataFrame, ks=config.K_VALUES, ndcg_k: int = config.NDCG_K) -> DataFrame:
    """Per query: recall and precision at each k, reciprocal rank, nDCG.

    ranked (query_id, doc_id, rank from 1), judged (query_id, doc_id, gain > 0), queries (query_id).
    Recall of a query without judgments is 0; its nDCG is null and leaves the mean.
    """
    hit = ranked.join(judged, ["query_id", "doc_id"], "left")
    got = hit.groupBy("query_id").agg(
        *[F.count(F.when((F.col("rank") <= k) & F.col("gain").isNotNull(), 1)).alias(f"hits{k}") for k in ks],
        *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"shown{k}") for k in ks],
        F.min(F.when(F.col("gain").isNotNull(), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= ndcg_k, F.coalesce("gain", F.lit(0)) / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    ideal = judged.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id")))
    best = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("i") <= ndcg_k, F.col("gain") / F.log2(F.col("i") + 1))).alias("idcg"))
    q = queries.join(got, "query_id", "left").join(best, "query_id", "left")
    zero = F.lit(0.0)
    return q.select(
        "query_id",
        *[F.coalesce(F.try_divide(F.col(f"hits{k}"), F.col("relevant")), zero).alias(f"recall{k}") for k in ks],
        *[F.coalesce(F.try_divide(F.col(f"hits{k}"), F.col(f"shown{k}")), zero).alias(f"precision{k}") for k in ks],
        F.coalesce(1.0 / F.col("first"), zero).alias("rr"),
        F.try_divide(F.coalesce("dcg", F.when(F.col("idcg").isNotNull(), zero)), F.col("idcg")).alias("ndcg"),
    )


def refusal(items: DataFrame) -> DataFrame:
    """One row from items (gold, decision): counts, precision, recall, F1, over-refusal, accuracy."""
    should, did = F.col("gold").isin("out_of_scope", "advice_seeking"), F.col("decision") == "REFUSE"
    c = items.agg(F.count_if(should & did).alias("tp"), F.count_if(~should & did).alias("fp"), F.count_if(should & ~did).alias("fn"), F.count_if(should == did).alias("right"), F.count_if(~should).alias("in_scope"), F.count("*").alias("n"))
    p, r, f = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("tp", "fp", "fn", "n", p.alias("precision"), r.alias("recall"), f.alias("f1"), M.ratio(F.col("fp"), F.col("in_scope")).alias("over_refusal"), M.ratio(F.col("right"), F.col("n")).alias("accuracy"))


def groundedness(labels: DataFrame, label: str) -> DataFrame:
    """Share of true among judged labels, and its exact complement; null labels are counted apart."""
    c = labels.agg(F.count_if(F.col(label)).alias("yes"), F.count(label).alias("n"), F.count("*").alias("total"))
    g = M.ratio(F.col("yes"), F.col("n"))
    return c.select(g.alias("groundedness"), F.round(1 - g, 4).alias("hallucination"), "n", (F.col("total") - F.col("n")).alias("n_unavailable"))


def cohen_kappa(pairs: DataFrame, a: str = "a", b: str = "b", total_is_one: bool = False) -> DataFrame:
    """Kappa of two raters over common items; with one label only it is null, or 1 in the variant that says so."""
    n = pairs.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    left = pairs.groupBy(F.col(a).alias("l")).agg(F.count("*").alias("na"))
    right = pairs.groupBy(F.col(b).alias("l")).agg(F.count("*").alias("nb"))
    chance = left.join(right, "l").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("both"))
    po, pe = F.col("same") / F.col("n"), F.col("both") / (F.col("n").cast("double") * F.col("n"))
    single = F.lit(1.0 if total_is_one else None).cast("double")
    return n.crossJoin(chance).select("n", F.when(F.col("n") > 0, F.when(F.col("both") == F.col("n").cast("double") * F.col("n"), single).otherwise(F.round((po - pe) / (1 - pe), 4))).alias("kappa"))  # one row each


def krippendorff_alpha(ratings: DataFrame, item: str = "item_id", label: str = "label") -> DataFrame:
    """Nominal alpha from label counts per item; items rated once are left out. No pair of raters is formed.

    Within an item of m ratings the pairs with equal labels weigh sum(c * (c - 1)) / (m - 1).
    """
    c = ratings.groupBy(item, label).agg(F.count("*").alias("c")).withColumn("m", F.sum("c").over(Window.partitionBy(item))).where("m > 1")
    w = c.groupBy(label).agg(F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("same"), F.sum("c").alias("marginal"))
    t = w.agg(F.sum("marginal").cast("double").alias("total"), F.sum("same").alias("same"), F.sum(F.col("marginal").cast("double") * (F.col("marginal") - 1)).alias("chance"))
    items = c.agg(F.countDistinct(item).alias("n_items"))
    do, de = F.col("total") - F.col("same"), (F.col("total") * (F.col("total") - 1) - F.col("chance")) / (F.col("total") - 1)
    return t.crossJoin(items).select("n_items", F.when(de > 0, F.round(1 - do / de, 4)).alias("alpha"))  # one row each


def percent_agreement(ratings: DataFrame, item: str = "item_id", rater: str = "rater_id", label: str = "label") -> DataFrame:
    """Share of equal labels over all pairs of raters on the same item, from counts."""
    c = ratings.groupBy(item, label).agg(F.count("*").alias("c")).groupBy(item).agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"))
    return c.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).cast("bigint").alias("n_pairs"), F.sum("same").alias("same")).select("n_pairs", M.ratio(F.col("same"), F.col("n_pairs")).alias("agreement"))


def majority(ratings: DataFrame, item: str = "item_id", label: str = "label") -> DataFrame:
    """The most frequent label of each item, the first by string order on a tie, with a tie flag."""
    c = ratings.groupBy(item, label).agg(F.count("*").alias("c"))
    top = Window.partitionBy(item)
    c = c.withColumn("best", F.max("c").over(top)).where("c = best")
    return c.groupBy(item).agg(F.min(label).alias("label"), F.max("c").alias("votes"), (F.count("*") > 1).alias("tie"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[o.desc() for o in order]))).where("__n = 1").drop("__n")


def reliability(pairs: DataFrame, confidence: str, correct: str, bins: int = config.ECE_BINS) -> DataFrame:
    """bin, n, mean confidence and accuracy (rounded); confidences are clamped, nulls skipped, empty bins absent."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))
    binned = pairs.where(F.col(confidence).isNotNull() & F.col(correct).isNotNull()).withColumn("bin", F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(c), 4).alias("confidence"), F.round(F.avg(F.col(correct).cast("double")), 4).alias("accuracy"))


def ece(bins: DataFrame) -> DataFrame:
    """Expected calibration error over the rounded bin means."""
    return bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n"), 4).alias("ece"), F.sum("n").alias("n"))


#: Distinct (logit, label) pairs that platt_fit takes to the driver.
FEW_PAIRS = 100_000


def platt_fit(pairs: DataFrame, x: str, y: str, rounds: int = 100, rate: float = 0.1) -> tuple[float, float]:
    """Slope and offset by full-batch gradient descent over the distinct pairs with their counts.

    Up to FEW_PAIRS of them are gone through by the driver in one array; of more each round is one aggregate of two numbers.
    """
    a, b = 1.0, 0.0
    pairs = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("__c")).checkpoint()
    if pairs.count() <= FEW_PAIRS:
        some = np.array(sorted((float(r[0]), float(r[1]), float(r[2])) for r in pairs.collect())).reshape(-1, 3)
        xs, ys, cs = some.T
        for _ in range(rounds if len(some) else 0):
            e = (1 / (1 + np.exp(-np.clip(a * xs + b, -30, 30))) - ys) * cs
            a, b = a - rate * float((e * xs).sum() / cs.sum()), b - rate * float(e.sum() / cs.sum())
        return a, b
    for _ in range(rounds):
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * F.col(x) + b))
        e = (M.sigmoid(z) - F.col(y)) * F.col("__c")
        g = pairs.agg(F.sum(e * F.col(x)) / F.sum("__c"), F.sum(e) / F.sum("__c")).first()
        if g[0] is None:
            break
        a, b = a - rate * g[0], b - rate * g[1]
    return a, b


def _poisson(most: int = 8) -> list[tuple[float, int]]:
    """For each number below most: the probability that a Poisson(1) number is at most that."""
    out, cumulative, p = [], 0.0, math.exp(-1)
    for k in range(most):
        cumulative += p
        out.append((cumulative, k))
        p /= k + 1
    return out


POISSON = _poisson()


def mixed32(h: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser, in 64-bit integers."""
    h = (h ^ (h >> 16)) * 0x7FEB352D & 0xFFFFFFFF
    h = (h ^ (h >> 15)) * 0x846CA68B & 0xFFFFFFFF
    return h ^ (h >> 16)


def paired_bootstrap(pairs: DataFrame, item: str, a: str, b: str, rounds: int = config.BOOTSTRAP_ROUNDS, seed: int = 42, alpha: float = config.ALPHA) -> DataFrame:
    """Mean difference, its bootstrap interval and Cohen's d.

    Each resample weighs every item by a Poisson(1) number drawn from a hash of (seed, item) and the round, so reruns
    agree. A task adds up the weighted differences of its items for all rounds and gives one row per round; these are
    what is shuffled, however many items there are.
    """
    d = pairs.select(F.col(item).cast("string").alias("i"), (F.col(a) - F.col(b)).cast("double").alias("d"))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("i"))), 1, 8), 16, 10).cast("long")
    upto = np.array([x for x, _ in POISSON])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B9) & np.uint64(0xFFFFFFFF)
        total, weight, seen = np.zeros(rounds), np.zeros(rounds), False
        for batch in batches:
            first, difference = batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy()
            for k in range(0, len(first), 64):
                drawn = mixed32(first[k : k + 64, None] ^ turns[None, :]) / float(1 << 32)
                w = np.searchsorted(upto, drawn, side="right")
                total, weight, seen = total + difference[k : k + 64] @ w, weight + w.sum(0), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, rounds + 1)), pa.array(total), pa.array(weight)], ["r", "total", "weight"])

    sums = d.where(F.col("d").isNotNull() & F.col("i").isNotNull()).select(start.alias("h"), "d").mapInArrow(run, "r long, total double, weight double")
    means = sums.groupBy("r").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("m"))
    ci = means.agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
    base = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), F.try_divide(F.avg("d"), F.stddev_samp("d")).alias("cohens_d"))
    return base.crossJoin(ci).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))  # one row each


def compare_runs(baseline: DataFrame, current: DataFrame, tolerance: float = config.REGRESSION_TOLERANCE) -> DataFrame:
    """metric, before, after, state: ok, regressed or disappeared; latency metrics do not count."""
    b = baseline.where(~F.col("metric").startswith("latency_")).select("metric", F.col("value").alias("before"))
    both = b.join(current.select("metric", F.col("value").alias("after")), "metric", "left")
    state = F.when(F.col("before").isNull(), "ok").when(F.col("after").isNull(), "disappeared").when(F.col("before") - F.col("after") > tolerance, "regressed").otherwise("ok")
    return both.select("metric", "before", "after", state.alias("state"))
