"""Queries: histograms, empirical distributions, densities and kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import densities as L
from statloom.functions import scalar as S
from statloom.operators import histogram as H
from statloom.plans.define import query
from statloom.plans.descriptive import rounded
from statloom.shared import table

_BINS = """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events), h AS (SELECT lo, (hi - lo) / 16 AS w, n FROM s),
c AS (SELECT least(floor((value - lo) / w), 15)::BIGINT AS bin, count(*) AS c FROM events, h GROUP BY ALL),
f AS (SELECT r.bin, lo + w * r.bin AS low, lo + w * r.bin + w AS high, coalesce(c.c, 0) AS count, coalesce(c.c, 0) / n AS prop FROM (SELECT unnest(range(16)) AS bin) r CROSS JOIN h LEFT JOIN c ON c.bin = r.bin)
"""


@query(_BINS + "SELECT bin, round(low, 6) AS low, round(high, 6) AS high, count, round(prop, 9) AS prop FROM f")
def histogram(spark, sf):
    return rounded(rounded(H.histogram(table(spark, sf, "events"), "value", 16), "low", "high"), "prop", digits=9)


@query("""
WITH s AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem GROUP BY ALL), h AS (SELECT *, ceil(log2(n) + 1) AS k FROM s)
SELECT l_returnflag, least(floor((l_extendedprice - lo) / ((hi - lo) / k)), k - 1)::BIGINT AS bin, count(*) AS count FROM lineitem JOIN h USING (l_returnflag) GROUP BY ALL""")
def histogram_sturges(spark, sf):
    return H.histogram(table(spark, sf, "lineitem"), "l_extendedprice", "sturges", ["l_returnflag"], dense=False).select("l_returnflag", "bin", "count")


@query(_BINS + ", r AS (SELECT bin, sum(count) OVER (ORDER BY bin) AS cum, sum(count) OVER () AS n FROM f) SELECT bin, cum::BIGINT AS cum_count, round(cum / n, 9) AS cum_prob FROM r")
def histogram_cumulative(spark, sf):
    return rounded(H.cumulative(H.histogram(table(spark, sf, "events"), "value", 16)).select("bin", "cum_count", "cum_prob"), "cum_prob", digits=9)


@query(_BINS + "SELECT round(sum(bin * count) / sum(count), 6) AS mean, round(sum(bin * bin * count) / sum(count) - power(sum(bin * count) / sum(count), 2), 6) AS var FROM f")
def histogram_mean(spark, sf):
    return rounded(H.histogram_mean(H.histogram(table(spark, sf, "events"), "value", 16), F.col("bin")), "mean", "var")


@query(_BINS + """, r AS (SELECT bin, sum(count) OVER (ORDER BY bin) / sum(count) OVER () AS p FROM f)
SELECT q, coalesce(min(bin) FILTER (p > q), max(bin)) AS bin FROM r, (VALUES (0.25::DOUBLE), (0.5), (0.9)) AS t(q) GROUP BY q""")
def histogram_quantiles(spark, sf):
    return H.histogram_quantiles(H.histogram(table(spark, sf, "events"), "value", 16), [0.25, 0.5, 0.9])


_JOINT = """
WITH s AS (SELECT min(l_quantity) AS lx, (max(l_quantity) - min(l_quantity)) / 8 AS wx, min(l_extendedprice) AS ly, (max(l_extendedprice) - min(l_extendedprice)) / 6 AS wy FROM lineitem),
c AS (SELECT least(floor((l_quantity - lx) / wx), 7)::BIGINT AS bx, least(floor((l_extendedprice - ly) / wy), 5)::BIGINT AS "by", count(*) AS count FROM lineitem, s GROUP BY ALL)
"""


@query(_JOINT + """SELECT bx, "by", count, round(count / sum(count) OVER (), 9) AS joint, round(sum(count) OVER (PARTITION BY bx) / sum(count) OVER (), 9) AS marginal_x, round(sum(count) OVER (PARTITION BY "by") / sum(count) OVER (), 9) AS marginal_y, round(count / sum(count) OVER (PARTITION BY bx), 9) AS y_given_x FROM c""")
def joint_histogram(spark, sf):
    return rounded(H.joint_histogram(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 8, 6), "joint", "marginal_x", "marginal_y", "y_given_x", digits=9)


@query(_JOINT + """SELECT gx AS bx, gy AS "by", (SELECT coalesce(sum(count), 0) FROM c WHERE c.bx <= gx AND c."by" <= gy)::BIGINT AS cum FROM (SELECT unnest(range(8)) AS gx), (SELECT unnest(range(6)) AS gy)""")
def joint_cumulative(spark, sf):
    cells = H.joint_histogram(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 8, 6).select("bx", "by", "count")
    return H.joint_cumulative(cells, 8, 6)


@query("SELECT DISTINCT l_returnflag, l_quantity AS value, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 9) AS cum_prob FROM lineitem")
def ecdf(spark, sf):
    return rounded(H.ecdf(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"]), "cum_prob", digits=9)


@query("""
WITH c AS (SELECT l_extendedprice AS value, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY ALL),
r AS (SELECT value, abs(sum(a) OVER (ORDER BY value) / (SELECT sum(a) FROM c) - sum(b) OVER (ORDER BY value) / (SELECT sum(b) FROM c)) AS diff FROM c)
SELECT round(max(diff), 9) AS diff, (SELECT sum(a) FROM c)::BIGINT AS n_a, (SELECT sum(b) FROM c)::BIGINT AS n_b FROM r""")
def ks_two_sample(spark, sf):
    return rounded(H.ks_two_sample(table(spark, sf, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R").drop("value"), "diff", digits=9)


@query("""
WITH v AS (SELECT DISTINCT value, cume_dist() OVER (ORDER BY value) AS p FROM events), z AS (SELECT value, p, (value - 50.0) / (30.0 * sqrt(2)) AS z FROM v),
e AS (SELECT value, p, CASE WHEN abs(z) >= 6 THEN sign(z) ELSE 2 / sqrt(pi()) * z * exp(-z * z) * list_reduce(list_concat([1.0::DOUBLE], list_transform(range(0, 140), lambda i: (281 - 2 * i)::DOUBLE)), lambda a, k: 1 + 2 * z * z / k * a) END AS erf FROM z),
d AS (SELECT value, round(abs((1 + erf) / 2 - p), 12) AS diff FROM e)
SELECT arg_min(value, struct_pack(d := -diff, v := value)) AS value, round(max(diff), 6) AS diff FROM d""")
def ks_normal(spark, sf):
    """Against a normal distribution; the SQL sums the same series for the error function."""
    return rounded(H.ks_normal(table(spark, sf, "events"), "value", 50.0, 30.0), "diff")


@query("""
WITH g AS (SELECT unnest(range(0, 101, 10))::DOUBLE AS x), d AS (SELECT x, x - value AS d FROM g, events)
SELECT x, round(avg(exp(-d * d / 50)), 6) AS gaussian, round(avg(CASE WHEN abs(d) <= 5 THEN 1.0 ELSE 0.0 END), 6) AS tophat, round(avg(1 - d * d / 25), 4) AS epanechnikov, round(avg(exp(-abs(d) / 25)), 6) AS exponential,
  round(avg(CASE WHEN abs(d) <= 5 THEN 1 - abs(d) / 5 ELSE 0.0 END), 6) AS linear, round(avg(CASE WHEN abs(d) <= 5 THEN cos(pi() * d / 10) ELSE 0.0 END), 6) AS cosine FROM d GROUP BY x""")
def kernel_densities(spark, sf):
    events, grid = table(spark, sf, "events"), [float(x) for x in range(0, 101, 10)]
    each = events.select(F.col("value"), F.explode(F.array(*[F.lit(x) for x in grid])).alias("x"))
    d = F.col("x") - F.col("value")
    kinds = ["gaussian", "tophat", "epanechnikov", "exponential", "linear", "cosine"]
    return each.groupBy("x").agg(*[F.round(F.avg(L.kernel(k, d, 5.0)), 4 if k == "epanechnikov" else 6).alias(k) for k in kinds])


@query("SELECT x, round(avg(exp(-(x - value) * (x - value) / 50)) / (sqrt(2 * pi()) * 5), 9) AS density FROM (SELECT unnest([10.0::DOUBLE, 50.0, 90.0]) AS x), events GROUP BY x")
def kde_normalized(spark, sf):
    return rounded(H.kde(table(spark, sf, "events"), "value", [10.0, 50.0, 90.0], "gaussian", 5.0, normalize=True), "density", digits=9)


@query("""
SELECT l_orderkey, l_linenumber, round(-0.5 * (ln(2 * pi()) + ln(200.0) + (l_quantity - 25) * (l_quantity - 25) / 200), 6) AS normal, round(CASE WHEN l_returnflag = 'R' THEN ln(0.3) ELSE ln(0.7) END, 6) AS bernoulli,
  round(lgamma(51) - lgamma(l_quantity + 1) - lgamma(51 - l_quantity) + l_quantity * ln(0.4) + (50 - l_quantity) * ln(0.6), 6) AS binomial, round(l_quantity * ln(25.0) - 25 - lgamma(l_quantity + 1), 6) AS poisson,
  round(1.5 * ln(l_quantity) - l_quantity / 10 - 2.5 * ln(10) - lgamma(2.5), 6) AS gamma, round(ln(l_discount + 0.01) + 4 * ln(1 - (l_discount + 0.01)) - (lgamma(2) + lgamma(5) - lgamma(7)), 6) AS beta, round(lgamma(l_quantity + 0.5), 6) AS lgamma_ FROM lineitem""")
def log_densities(spark, sf):
    q, p = F.col("l_quantity"), F.col("l_discount") + 0.01
    return rounded(
        table(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", L.normal(q, 25.0, 200.0).alias("normal"), L.bernoulli((F.col("l_returnflag") == "R").cast("int"), 0.3).alias("bernoulli"), L.binomial(q, 50.0, 0.4).alias("binomial"),
            L.poisson(q, 25.0).alias("poisson"), L.gamma(q, 2.5, 10.0).alias("gamma"), L.beta(p, 2.0, 5.0).alias("beta"), S.lgamma(q + 0.5).alias("lgamma_"),
        ), "normal", "bernoulli", "binomial", "poisson", "gamma", "beta", "lgamma_",
    )


@query("""
SELECT l_orderkey, l_linenumber, round(-0.5 * (2 * ln(2 * pi()) + ln(200.0 * 0.001 - 0.01)) - 0.5 * (0.001 * a * a - 2 * 0.1 * a * b + 200.0 * b * b) / (200.0 * 0.001 - 0.01), 6) AS log_prob
FROM (SELECT *, l_quantity - 25 AS a, l_discount - 0.05 AS b FROM lineitem)""")
def multinormal_log_density(spark, sf):
    lp = L.multinormal([F.col("l_quantity"), F.col("l_discount")], [25.0, 0.05], [[200.0, 0.1], [0.1, 0.001]])
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", lp.alias("log_prob")), "log_prob")


@query("""
SELECT event_type, count(value) AS n, round(sum(value), 6) AS sum_y, round(sum(value * value), 4) AS sum_yy, round(sum(ln(value + 1)), 6) AS sum_ln_y FROM events GROUP BY ALL""")
def sufficient_statistics(spark, sf):
    y = F.col("value")
    normal, gamma = L.sufficient("normal", y), L.sufficient("gamma", y + 1)
    d = table(spark, sf, "events").groupBy("event_type").agg(normal["n"], normal["sum_y"], normal["sum_yy"], gamma["sum_ln_y"])
    return rounded(rounded(d, "sum_y", "sum_ln_y"), "sum_yy", digits=4)


@query("""
SELECT r.rate, round(sum(l_quantity * ln(r.rate) - r.rate - lgamma(l_quantity + 1)), 3) AS log_prob, round(sum(l_quantity / r.rate - 1), 3) AS score FROM lineitem, (SELECT unnest([5.0::DOUBLE, 15.0, 25.0, 35.0]) AS rate) r GROUP BY ALL""")
def likelihood_sweep(spark, sf):
    """Log-likelihood and score over a grid of a Poisson rate."""
    each = table(spark, sf, "lineitem").select("l_quantity", F.explode(F.array(*[F.lit(r) for r in (5.0, 15.0, 25.0, 35.0)])).alias("rate"))
    return each.groupBy("rate").agg(F.round(F.sum(L.poisson(F.col("l_quantity"), F.col("rate"))), 3).alias("log_prob"), F.round(F.sum(F.col("l_quantity") / F.col("rate") - 1), 3).alias("score"))
