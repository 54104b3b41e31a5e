"""Descriptive statistics: one partial and one final aggregation each, whatever the groups' sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.scalar import entropy_term
from statloom.operators.prefix import numbered, prefix
from statloom.shared import need, written


def aggregates(x: Column) -> dict[str, Column]:
    """Name -> aggregate of one numeric column. NaN and null are left out; geometric and harmonic means want positive values."""
    x = F.when(~F.isnan(x.cast("double")), x.cast("double"))
    return {
        "n": F.count(x),
        "mean": F.avg(x),
        "int_mean": F.floor(F.sum(x) / F.count(x)).cast("long"),
        "var_pop": F.var_pop(x),
        "var_samp": F.var_samp(x),
        "sd_pop": F.stddev_pop(x),
        "geometric_mean": F.exp(F.avg(F.ln(x))),
        "harmonic_mean": 1 / F.avg(1 / x),
        "skewness": F.skewness(x),
        "kurtosis": F.kurtosis(x) + 3,
        "min": F.min(x),
        "max": F.max(x),
        "extent": F.max(x) - F.min(x),
    }


def describe(df: DataFrame, column: str, by: list[str] | None = None, which: list[str] | None = None) -> DataFrame:
    need(df, column, *(by or []))
    found = aggregates(F.col(column))
    return df.groupBy(*(by or [])).agg(*[found[k].alias(k) for k in which or found])


def weighted_moments(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """mean and variance under weights that need not sum to one; sd is the root of the variance."""
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    sums = df.groupBy(*(by or [])).agg(F.sum(w).alias("w"), F.sum(w * v).alias("wv"), F.sum(w * v * v).alias("wvv"))
    mean = F.col("wv") / F.col("w")
    var = F.col("wvv") / F.col("w") - mean * mean
    return sums.select(*(by or []), mean.alias("mean"), var.alias("var"), F.sqrt(F.greatest(F.lit(0.0), var)).alias("sd"))


def absolute_deviation(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Mean absolute deviation about the mean: two aggregations; the groups' means are joined back."""
    means = df.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.avg(column).alias("_m"))
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    return df.join(means, on).groupBy(*by).agg(F.avg(F.abs(F.col(column) - F.col("_m"))).alias("abs_dev"))


def median_absolute_deviation(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Median of the distances from the group's median, both true medians; no group is gathered in one task."""
    middle = true_median(df, column, by).select(*[F.col(b).alias(f"_{b}") for b in by], F.col("median").alias("_m"))
    far = df.join(middle, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]).select(*by, F.abs(F.col(column) - F.col("_m")).alias("_d"))
    return true_median(far, "_d", by).withColumnRenamed("median", "median_abs_dev")


def ranked_values(df: DataFrame, column: str, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, q, pos, value): the value at sorted position floor(n * q), at most n - 1. Equal values are counted first, then
    prefix sums over the distinct values find the positions; no group is gathered in one task."""
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    each = prefix(counts, [column], {"_upto": F.col("_n")}, by, {"_total": "_upto"}).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    pos = F.least(F.floor(F.col("_total") * F.col("q")), F.col("_total") - 1)
    return each.withColumn("pos", pos).where((F.col("pos") < F.col("_upto")) & (F.col("pos") >= F.col("_upto") - F.col("_n"))).select(*by, "q", "pos", F.col(column).alias("value"))


def rank_summary(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """min, q25, median (the upper of two), q75, max and iqr by position."""
    names = {0.0: "min", 0.25: "q25", 0.5: "median", 0.75: "q75", 1.0: "max"}
    at = ranked_values(df, column, list(names), by)
    out = at.groupBy(*by).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(k) for q, k in names.items()])
    return out.withColumn("iqr", F.col("q75") - F.col("q25"))


def true_median(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The middle value, or the mean of the two middle values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    both = prefix(counts, [column], {"_upto": F.col("_n")}, by, {"_total": "_upto"})
    holds = lambda p: (p < F.col("_upto")) & (p >= F.col("_upto") - F.col("_n"))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    return both.groupBy(*by).agg(((F.max(F.when(holds(low), F.col(column))) + F.max(F.when(holds(high), F.col(column)))) / 2).alias("median"))


def mode_of_counts(df: DataFrame, position: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Position and size of the largest count; of equal ones the last position."""
    top = F.max(F.struct(F.col(value).alias("v"), F.col(position).alias("p"))).alias("_m")
    return df.groupBy(*(by or [])).agg(top).select(*(by or []), F.col("_m.p").alias("pos"), F.col("_m.v").alias("val"))


def to_probabilities(df: DataFrame, count: str, by: list[str] | None = None, of: str = "sum") -> DataFrame:
    """df with prob = count / total (of='sum') or count / largest (of='max')."""
    by = by or []
    total = (F.sum if of == "sum" else F.max)(F.col(count).cast("double")).alias("_total")
    totals = df.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(total)
    both = df.join(totals, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]) if by else df.crossJoin(F.broadcast(totals))  # one row
    return both.withColumn("prob", F.col(count) / F.col("_total")).drop("_total", *[f"_{b}" for b in by])


def entropy(df: DataFrame, prob: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.sum(entropy_term(F.col(prob))).alias("entropy"))


def quantiles_of_counts(df: DataFrame, bin_: str, count: str, quantiles: list[float]) -> DataFrame:
    """(q, bin, cumulative): for each q the first bin whose cumulative share reaches it."""
    each = prefix(df, [bin_], {"cumulative": F.col(count)}, whole={"_total": "cumulative"}).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    hit = each.where(F.col("cumulative") >= F.col("q") * F.col("_total"))
    return hit.groupBy("q").agg(F.min(F.struct(F.col(bin_).alias("b"), "cumulative")).alias("m")).select("q", F.col("m.b").alias("bin"), F.col("m.cumulative").alias("cumulative"))


def standardized(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """df with centered and standardized values by the group's mean and population sd."""
    stats = df.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    both = df.join(stats, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    return both.withColumn("centered", F.col(column) - F.col("_m")).withColumn("standardized", F.col("centered") / F.col("_s")).drop("_m", "_s", *[f"_{b}" for b in by])


def factor_codes(df: DataFrame, column: str, order: str, limit: int | None = None) -> DataFrame:
    """(level, code): distinct values by first appearance, from 0; with a limit the later levels have no code and go."""
    levels = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.min(order).alias("_first"))
    out = numbered(levels, ["_first"], "code").select("level", "code")
    return out if limit is None else out.where(F.col("code") < limit)


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman (mean ranks of ties)."""
    rx, ry = mean_ranks(df, x, "_rx"), mean_ranks(df, y, "_ry")
    ranked = df.select(x, y).join(rx, x).join(ry, y)
    return ranked.agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def mean_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(value, mean rank from 1): of the distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return prefix(counts, [column], {"_upto": F.col("_n")}).select(column, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """tau-b. Concordant less discordant pairs come from prefix sums, one for each bit of y's rank: two values of y part at one bit, and
    within the values that agree above it a running sum over x counts what lies on either side. Cells of equal (x, y) are counted first."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    cells = written(cells)
    levels = written(numbered(cells.select("y").distinct(), ["y"], "rank").select(F.col("y").alias("_y"), "rank"))
    bits = max(1, int(levels.agg(F.max("rank")).head()[0] or 0).bit_length())
    each = cells.join(levels, F.col("y") == F.col("_y")).select("x", "n", "rank", F.explode(F.array(*[F.lit(k) for k in range(bits)])).alias("level"))
    high = F.expr("bigint(rank) >> (level + 1)")
    set_ = F.expr("(rank >> level) & 1") == 1
    at = each.groupBy("level", high.alias("above"), "x").agg(F.sum(F.when(~set_, F.col("n"))).alias("zero"), F.sum(F.when(set_, F.col("n"))).alias("one")).na.fill(0, ["zero", "one"])
    at = written(at)
    run = prefix(at, ["x"], {"upto": F.col("zero")}, ["level", "above"])
    totals = at.groupBy(F.col("level").alias("_l"), F.col("above").alias("_a")).agg(F.sum("zero").alias("all"))
    met = run.join(totals, (F.col("level") == F.col("_l")) & (F.col("above") == F.col("_a")))
    s = met.agg(F.coalesce(F.sum(F.col("one").cast("double") * (2 * F.col("upto") - F.col("zero") - F.col("all"))), F.lit(0.0)).alias("s"))
    n = cells.agg(F.sum("n").cast("double").alias("n"))
    ties = lambda c, name: cells.groupBy(c).agg(F.sum("n").cast("double").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(name))
    all_ = s.crossJoin(n).crossJoin(ties("x", "tx")).crossJoin(ties("y", "ty"))  # one row each
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return all_.select((F.col("s") / F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))).alias("kendall"))
