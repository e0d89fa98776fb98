"""Column functions for measures. A measure without evidence is null with a reason, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom import config


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded; null if whole is 0 or null."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def measure(name: str, value: Column, n: Column, reason: str) -> Column:
    """struct(name, value, status, n, reason)."""
    ok = value.isNotNull()
    return F.struct(F.lit(name).alias("name"), value.alias("value"), F.when(ok, "ok").otherwise("unavailable").alias("status"), n.cast("bigint").alias("n"), F.when(ok, "").otherwise(reason).alias("reason"))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 from counts, each 0 where its denominator is."""
    p = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    return F.round(p, 4), F.round(r, 4), F.round(f1(p, r), 4)


def sigmoid(z: Column) -> Column:
    """Stable on both sides."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def wilson(successes: Column, n: Column, z: float = config.Z_95) -> tuple[Column, Column]:
    """Wilson interval clamped to [0, 1]; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = successes / n
    den = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / den, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def kappa_band(k: Column) -> Column:
    return F.when(k.isNull(), None).when(k < 0.0, "poor").when(k <= 0.2, "slight").when(k <= 0.4, "fair").when(k <= 0.6, "moderate").when(k <= 0.8, "substantial").otherwise("almost perfect")


def parse_date(text: Column) -> Column:
    """A date from the first ten characters in one of three layouts; null if none fits."""
    t = F.left(text, F.lit(10))
    return F.coalesce(*[F.try_to_date(t, f) for f in ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy")])


def cold(seed: int, item: Column, fraction: float = config.COLD_FRACTION) -> Column:
    """Whether the first 32 bits of sha256(seed:item) lie below the fraction."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), item.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return bits / 4294967295.0 < fraction
