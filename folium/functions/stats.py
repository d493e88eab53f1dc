"""Guarded rates, intervals and agreement coefficients as expressions over counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNMEASURED = -1.0


def guarded_rate(n: Column, d: Column, digits: int = 3) -> Column:
    """n / d rounded half to even; the sentinel where d is zero."""
    return F.when(d == 0, UNMEASURED).otherwise(F.bround(n / F.nullif(d, F.lit(0)), digits))


def metric(n: Column, d: Column, digits: int = 3) -> Column:
    """struct(value, valid) of a guarded rate."""
    return F.struct(guarded_rate(n, d, digits).alias("value"), (d != 0).alias("valid"))


def routing_summary(drafts: DataFrame, *keys: str) -> DataFrame:
    """Drafts by destination: vault, inbox, and unresolved where there is none."""
    goes = F.col("destination")
    return drafts.groupBy(*keys).agg(
        F.count_if(goes == "vault").alias("vault"), F.count_if(goes == "inbox").alias("inbox"), F.count_if(goes.isNull()).alias("unresolved")
    )


def wilson(successes: Column, total: Column, z: float = 1.96) -> Column:
    """struct(lo, hi) of the Wilson score interval, three digits, (0, 0) without data."""
    n = F.nullif(total, F.lit(0)).cast("double")
    p = successes / n
    denom = 1 + z * z / n
    center = (p + z * z / (2 * n)) / denom
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    return F.struct(
        F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(center - margin, 3))).alias("lo"),
        F.when(total == 0, 0.0).otherwise(F.least(F.lit(1.0), F.round(center + margin, 3))).alias("hi"),
    )


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def agreement(n: Column, same: Column, first: list[Column], second: list[Column]) -> Column:
    """struct(percent, kappa, ac1, alpha) from the counts of two raters per category."""
    m = F.nullif(n, F.lit(0)).cast("double")
    k = len(first)
    observed = same / m
    chance = _total([(a / m) * (b / m) for a, b in zip(first, second, strict=True)])
    share = [(a + b) / (2 * m) for a, b in zip(first, second, strict=True)]
    gwet = _total([s * (1 - s) for s in share]) / (k - 1)
    both = 2 * m
    expected = (both * both - _total([(a + b) * (a + b) for a, b in zip(first, second, strict=True)])) / (both * (both - 1))
    return F.struct(
        observed.alias("percent"),
        F.when(chance < 1, (observed - chance) / F.nullif(1 - chance, F.lit(0.0))).alias("kappa"),
        F.when(gwet < 1, (observed - gwet) / F.nullif(1 - gwet, F.lit(0.0))).alias("ac1"),
        F.when(expected == 0, 1.0).otherwise(1 - (1 - observed) / F.nullif(expected, F.lit(0.0))).alias("alpha"),
    )
