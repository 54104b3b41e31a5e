"""Equal-width histograms, their summaries, empirical distributions and kernel densities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.densities import AREA, kernel
from statloom.functions.scalar import normal_cdf
from statloom.operators.prefix import prefix


def bin_count(binning: str | int | float, n: int, low: float, high: float) -> int:
    """Bins by a rule (sqrt, sturges, rice), a count (int) or a width (float)."""
    if isinstance(binning, str):
        rules = {"sqrt": math.sqrt(n), "sturges": math.log2(max(n, 1)) + 1, "rice": 2 * n ** (1 / 3)}
        if binning not in rules:
            raise ValueError(f"no rule {binning}")
        return max(1, math.ceil(rules[binning]))
    return max(1, binning if isinstance(binning, int) else math.ceil((high - low) / binning))


def partition(df: DataFrame, column: str, bins: int | str | float, by: list[str] | None = None) -> DataFrame:
    """(by, low, high, n, n_bins, width): one row for each group."""
    by = by or []
    s = df.groupBy(*by).agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"), F.count(column).alias("n"))
    if isinstance(bins, int):
        k = F.lit(bins)
    elif isinstance(bins, float):
        k = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / bins))
    else:
        rules = {"sqrt": F.sqrt("n"), "sturges": F.log2("n") + 1, "rice": 2 * F.cbrt("n")}
        if bins not in rules:
            raise ValueError(f"no rule {bins}")
        k = F.greatest(F.lit(1), F.ceil(rules[bins]))
    return s.withColumn("n_bins", k.cast("long")).withColumn("width", (F.col("high") - F.col("low")) / F.col("n_bins"))


def bin_of(x: Column, low: Column, width: Column, n_bins: Column) -> Column:
    """Bin from 0; the last is closed; null outside or for null."""
    b = F.when(width == 0, F.lit(0).cast("long")).otherwise(F.least(F.floor((x - low) / width), n_bins - 1))
    return F.when((x >= low) & (x <= low + width * n_bins * (1 + 1e-12)), b)


def histogram(df: DataFrame, column: str, bins: int | str | float = 16, by: list[str] | None = None, dense: bool = True) -> DataFrame:
    """(by, bin, low, high, count, prop). dense: with the empty bins.

    One pass for the limits, which are one row for each group, and one for the counts, combined before the shuffle.
    """
    by = by or []
    limits = partition(df, column, bins, by).select(*[F.col(b).alias(f"_{b}") for b in by], "low", "width", "n_bins", "n")
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    some = df.where(F.col(column).isNotNull())
    both = some.join(limits, on) if by else some.crossJoin(F.broadcast(limits))  # one row
    counts = both.withColumn("bin", bin_of(F.col(column), F.col("low"), F.col("width"), F.col("n_bins"))).groupBy(*by, "bin", F.col("low").alias("_low"), F.col("width").alias("_width"), F.col("n").alias("_all")).agg(F.count(F.lit(1)).alias("count"))
    if dense:
        own = limits.withColumn("_bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)))
        here = (F.col("bin") == F.col("_bin"))
        for b in by:
            here = here & F.col(b).eqNullSafe(F.col(f"_{b}"))
        full = own.join(counts, here, "left")
        counts = full.select(*[F.col(f"_{b}").alias(b) for b in by], F.col("_bin").alias("bin"), F.col("low").alias("_low"), F.col("width").alias("_width"), F.col("n").alias("_all"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    low = F.col("_low") + F.col("_width") * F.col("bin")
    return counts.select(*by, "bin", low.alias("low"), (low + F.col("_width")).alias("high"), "count", (F.col("count") / F.col("_all")).alias("prop"))


def histogram_mean(hist: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    return hist.groupBy(*(by or [])).agg((F.sum(value * F.col("count")) / F.sum("count")).alias("mean"), (F.sum(value * value * F.col("count")) / F.sum("count") - F.pow(F.sum(value * F.col("count")) / F.sum("count"), F.lit(2.0))).alias("var"))


def cumulative(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """hist with the running count and share."""
    by = by or []
    run = prefix(hist, ["bin"], {"cum_count": F.col("count")}, by)
    totals = hist.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.sum("count").alias("_all"))
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    both = run.join(totals, on) if by else run.crossJoin(F.broadcast(totals))  # one row
    return both.withColumn("cum_prob", F.col("cum_count") / F.col("_all")).drop("_all", *[f"_{b}" for b in by])


def histogram_quantiles(hist: DataFrame, quantiles: list[float]) -> DataFrame:
    """(q, bin): the first bin whose share exceeds q, else the last."""
    c = cumulative(hist).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    return c.groupBy("q").agg(F.coalesce(F.min(F.when(F.col("cum_prob") > F.col("q"), F.col("bin"))), F.max("bin")).alias("bin"))


def joint_histogram(df: DataFrame, x: str, y: str, bins_x: int, bins_y: int) -> DataFrame:
    """(bx, by, count, joint, marginal_x, marginal_y, y_given_x) of the cells that are not empty."""
    px, py = partition(df, x, bins_x), partition(df, y, bins_y)
    p = px.select(F.col("low").alias("_lx"), F.col("width").alias("_wx")).crossJoin(py.select(F.col("low").alias("_ly"), F.col("width").alias("_wy")))  # one row
    both = df.crossJoin(F.broadcast(p))
    cells = both.select(bin_of(F.col(x), F.col("_lx"), F.col("_wx"), F.lit(bins_x)).alias("bx"), bin_of(F.col(y), F.col("_ly"), F.col("_wy"), F.lit(bins_y)).alias("by")).where("bx IS NOT NULL AND by IS NOT NULL").groupBy("bx", "by").agg(F.count(F.lit(1)).alias("count"))
    mx = cells.groupBy(F.col("bx").alias("_bx")).agg(F.sum("count").alias("_nx"))
    my = cells.groupBy(F.col("by").alias("_by")).agg(F.sum("count").alias("_ny"))
    n = cells.agg(F.sum("count").alias("_n"))
    out = cells.join(mx, F.col("bx") == F.col("_bx")).join(my, F.col("by") == F.col("_by")).crossJoin(F.broadcast(n))  # one row
    return out.select("bx", "by", "count", (F.col("count") / F.col("_n")).alias("joint"), (F.col("_nx") / F.col("_n")).alias("marginal_x"), (F.col("_ny") / F.col("_n")).alias("marginal_y"), (F.col("count") / F.col("_nx")).alias("y_given_x"))


def marginal_histograms(df: DataFrame, x: str, y: str, bins: int | str | float = 16) -> tuple[DataFrame, DataFrame]:
    """The histograms of two columns, each over its own limits."""
    return histogram(df, x, bins), histogram(df, y, bins)


def joint_cumulative(cells: DataFrame, bins_x: int, bins_y: int) -> DataFrame:
    """(bx, by, cum): counts of all cells at or below in both directions, over the dense grid of bins_x * bins_y cells."""
    spark = cells.sparkSession
    grid = spark.range(bins_x).select(F.col("id").alias("gx")).crossJoin(spark.range(bins_y).select(F.col("id").alias("gy")))  # bins_x * bins_y rows
    dense = grid.join(cells, (F.col("gx") == F.col("bx")) & (F.col("gy") == F.col("by")), "left").select(F.col("gx").alias("bx"), F.col("gy").alias("by"), F.coalesce("count", F.lit(0)).alias("count"))
    row = prefix(dense, ["by"], {"_row": F.col("count")}, ["bx"])
    return prefix(row, ["bx"], {"cum": F.col("_row")}, ["by"]).select("bx", "by", "cum")


def ecdf(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, cum_prob) of the distinct values."""
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return cumulative(counts, by).select(*by, F.col("bin").alias("value"), "cum_prob")


def ks_two_sample(df: DataFrame, column: str, side: Column) -> DataFrame:
    """(value, diff, n_a, n_b): where and how far the two empirical distributions are apart most. side: true for the first sample."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    run = prefix(counts, ["value"], {"ca": F.col("a"), "cb": F.col("b")})
    n = counts.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    d = run.crossJoin(F.broadcast(n)).withColumn("diff", F.abs(F.col("ca") / F.col("n_a") - F.col("cb") / F.col("n_b")))  # one row
    top = d.groupBy("n_a", "n_b").agg(F.max(F.struct("diff", (-F.col("value")).alias("v"))).alias("m"))
    return top.select((-F.col("m.v")).alias("value"), F.col("m.diff").alias("diff"), "n_a", "n_b")


def ks_normal(df: DataFrame, column: str, mean: float, sd: float, two_sided: bool = False) -> DataFrame:
    """(value, diff): the largest distance of the empirical distribution from a normal one, at right limits, or on both sides."""
    e = ecdf(df, column)
    f = normal_cdf(F.col("value"), mean, sd)
    right = F.abs(f - F.col("cum_prob"))
    if two_sided:
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        total = counts.agg(F.sum("_n").alias("_all"))
        e = e.join(counts, F.col("value") == F.col("_v")).crossJoin(F.broadcast(total)).withColumn("_left", F.col("cum_prob") - F.col("_n") / F.col("_all"))  # one row
        right = F.greatest(right, F.abs(f - F.col("_left")))
    top = e.agg(F.max(F.struct(right.alias("diff"), (-F.col("value")).alias("v"))).alias("m"))
    return top.select((-F.col("m.v")).alias("value"), F.col("m.diff").alias("diff"))


def kde(df: DataFrame, column: str, grid: list[float], kind: str, h: float, normalize: bool = False, truncate: bool = False) -> DataFrame:
    """(x, density) at the points of the grid: the mean kernel value, over its integral if normalize.

    The grid travels as a literal and its kernels are summed map-side: one pass, one row for each task and grid point.
    """
    at = F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    each = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"), at.alias("x"))
    area = AREA[kind](h) if normalize else 1.0
    return each.groupBy("x").agg((F.avg(kernel(kind, F.col("x") - F.col("_v"), h, truncate)) / area).alias("density"))
