"""Intervals: quantile, percentile, z-score and median intervals of samples, credible intervals of distributions, gaps between ranges."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.describe import median_absolute_deviation, ranked_values, true_median


def percentile_interval(df: DataFrame, column: str, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """(by, low, high): the values at sorted positions floor(n * low) and floor(n * high), at most n - 1."""
    by = by or []
    at = ranked_values(df, column, sorted({low, high}), by)
    return at.groupBy(*by).agg(F.max(F.when(F.col("q") == low, F.col("value"))).alias("low"), F.max(F.when(F.col("q") == high, F.col("value"))).alias("high"))


def quantile_intervals(df: DataFrame, column: str, share: float, by: list[str] | None = None) -> DataFrame:
    """(by, part, low, high): consecutive intervals of equal probability; share 0.25 gives quartiles."""
    by, n = by or [], round(1 / share)
    at = ranked_values(df, column, [k / n for k in range(n + 1)], by)
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.lit(k / n).alias("a"), F.lit((k + 1) / n).alias("b")) for k in range(n)]))
    each = at.withColumn("p", part).where((F.col("q") == F.col("p.a")) | (F.col("q") == F.col("p.b")))
    return each.groupBy(*by, F.col("p.part").alias("part")).agg(F.max(F.when(F.col("q") == F.col("p.a"), F.col("value"))).alias("low"), F.max(F.when(F.col("q") == F.col("p.b"), F.col("value"))).alias("high"))


def z_interval(df: DataFrame, column: str, z: float, by: list[str] | None = None) -> DataFrame:
    """(by, low, high): mean and z population standard deviations to either side."""
    m, s = F.avg(column), F.stddev_pop(column)
    return df.groupBy(*(by or [])).agg((m - z * s).alias("low"), (m + z * s).alias("high"))


def median_interval(df: DataFrame, column: str, z: float, by: list[str]) -> DataFrame:
    """(by, low, high): median and z median absolute deviations to either side."""
    far = median_absolute_deviation(df, column, by).select(*[F.col(b).alias(f"_{b}") for b in by], "median_abs_dev")
    both = true_median(df, column, by).join(far, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    return both.select(*by, (F.col("median") - z * F.col("median_abs_dev")).alias("low"), (F.col("median") + z * F.col("median_abs_dev")).alias("high"))


def gaps(ranges: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """What sorted disjoint ranges (end exclusive) leave of [low, high), empty pieces left out."""
    edges = [low, *[x for r in ranges for x in r], high]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]


def outside(df: DataFrame, position: Column, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows whose position is in none of the sorted disjoint ranges, with `slice`, the number of ranges before them."""
    inside = F.lit(False)
    before = F.lit(0)
    for a, b in ranges:
        inside = inside | ((position >= a) & (position < b))
        before = before + (position >= b).cast("int")
    return df.withColumn("slice", before).where(~inside)


def _incomplete_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: its series below a + 1, its continued fraction beyond."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return total * front
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b or 1e-300)
        c = b + n / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or 1e-300)
            c = 1 + n / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def cdf(family: str, x: float, *p: float) -> float:
    """normal(mean, variance), gamma(shape, scale), beta(a, b)."""
    if family == "normal":
        return NormalDist(p[0], math.sqrt(p[1])).cdf(x)
    if family == "gamma":
        return _incomplete_gamma(p[0], x / p[1])
    if family == "beta":
        return _incomplete_beta(p[0], p[1], x)
    raise ValueError(f"no family {family}")


def quantile(family: str, q: float, *p: float) -> float:
    if family == "normal":
        return NormalDist(p[0], math.sqrt(p[1])).inv_cdf(q)
    low, high = 0.0, 1.0
    while family == "gamma" and cdf(family, high, *p) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(family, mid, *p) < q else (low, mid)
    return (low + high) / 2


def credible(family: str, mass: float, *p: float) -> tuple[float, float]:
    """The interval of this probability with equal tails."""
    return quantile(family, (1 - mass) / 2, *p), quantile(family, (1 + mass) / 2, *p)
