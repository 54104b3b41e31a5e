"""Queries: descriptive statistics, ranks, prefix sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import scalar as S
from statloom.operators import describe as D
from statloom.operators import prefix as P
from statloom.plans.define import query
from statloom.shared import table


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


FLAG = ["l_returnflag", "l_linestatus"]


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(var_pop(l_extendedprice), 2) AS var_pop, round(exp(avg(ln(l_extendedprice))), 6) AS geometric_mean,
  round(1 / avg(1 / l_extendedprice), 6) AS harmonic_mean, min(l_extendedprice) AS min, max(l_extendedprice) AS max, floor(sum(l_extendedprice) / count(*))::BIGINT AS int_mean,
  round(var_samp(l_extendedprice), 2) AS var_samp FROM lineitem GROUP BY ALL""")
def describe_by_flag(spark, sf):
    d = D.describe(table(spark, sf, "lineitem"), "l_extendedprice", FLAG, ["n", "mean", "var_pop", "geometric_mean", "harmonic_mean", "min", "max", "int_mean", "var_samp"])
    return rounded(rounded(d, "mean", "geometric_mean", "harmonic_mean"), "var_pop", "var_samp", digits=2)


@query("""
WITH m AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(avg(power((l_quantity - m) / s, 3)), 6) AS skewness, round(avg(power((l_quantity - m) / s, 4)), 6) AS kurtosis FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY ALL""")
def higher_moments(spark, sf):
    return rounded(D.describe(table(spark, sf, "lineitem"), "l_quantity", FLAG, ["skewness", "kurtosis"]), "skewness", "kurtosis")


@query("""
WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, v[1] AS min, v[floor(n * 0.25)::INT + 1] AS q25, v[floor(n * 0.5)::INT + 1] AS median, v[floor(n * 0.75)::INT + 1] AS q75, v[n] AS max, v[floor(n * 0.75)::INT + 1] - v[floor(n * 0.25)::INT + 1] AS iqr FROM s""")
def rank_summary(spark, sf):
    return D.rank_summary(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query("""
WITH s AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS v, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderpriority, q, least(floor(n * q), n - 1)::BIGINT AS pos, v[least(floor(n * q), n - 1)::INT + 1] AS value FROM s, (VALUES (0.1::DOUBLE), (0.5), (0.99), (1.0)) AS t(q)""")
def floor_quantiles(spark, sf):
    return D.ranked_values(table(spark, sf, "orders"), "o_totalprice", [0.1, 0.5, 0.99, 1.0], ["o_orderpriority"])


@query("SELECT c_mktsegment, round(median(c_acctbal), 6) AS median FROM customer GROUP BY ALL")
def true_median(spark, sf):
    return rounded(D.true_median(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"]), "median")


@query("""
WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY ALL)
SELECT c_mktsegment, round(avg(abs(c_acctbal - m)), 6) AS abs_dev FROM customer JOIN m USING (c_mktsegment) GROUP BY ALL""")
def absolute_deviation(spark, sf):
    return rounded(D.absolute_deviation(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"]), "abs_dev")


@query("SELECT c_mktsegment, round(mad(c_acctbal), 6) AS median_abs_dev FROM customer GROUP BY ALL")
def median_absolute_deviation(spark, sf):
    return rounded(D.median_absolute_deviation(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"]), "median_abs_dev")


@query("""
SELECT event_id, (SELECT count(*) FROM events f WHERE f.user_id = e.user_id AND f.event_id < e.event_id AND f.value <= e.value)::INT AS insert_rank FROM events e""")
def rank_among_all_before(spark, sf):
    return P.rank_on_insert(table(spark, sf, "events"), ["event_id"], "value", ["user_id"]).select("event_id", "insert_rank")


@query("""
WITH s AS (SELECT l_returnflag, sum(l_quantity) AS w, sum(l_quantity * l_discount) AS wv, sum(l_quantity * l_discount * l_discount) AS wvv FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(wv / w, 6) AS mean, round(wvv / w - (wv / w) * (wv / w), 6) AS var, round(sqrt(wvv / w - (wv / w) * (wv / w)), 6) AS sd FROM s""")
def weighted_moments(spark, sf):
    return rounded(D.weighted_moments(table(spark, sf, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"]), "mean", "var", "sd")


@query("""
WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, arg_max(p_size, n * 1000 + p_size) AS pos, max(n) AS val FROM c GROUP BY ALL""")
def mode_of_counts(spark, sf):
    return D.mode_of_counts(table(spark, sf, "part").groupBy("p_brand", "p_size").count(), "p_size", "count", ["p_brand"])


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY p_brand) AS p FROM c)
SELECT p_brand, round(-sum((p + 2.220446049250313e-16) * ln(p + 2.220446049250313e-16)), 6) AS entropy FROM t GROUP BY ALL""")
def entropy_by_brand(spark, sf):
    p = D.to_probabilities(table(spark, sf, "part").groupBy("p_brand", "p_type").count(), "count", ["p_brand"])
    return rounded(D.entropy(p, "prob", ["p_brand"]), "entropy")


@query("SELECT event_type, count(*) AS count, round(count(*) / max(count(*)) OVER (), 9) AS prob FROM events GROUP BY event_type")
def odds_to_probabilities(spark, sf):
    return rounded(D.to_probabilities(table(spark, sf, "events").groupBy("event_type").count(), "count", of="max"), "prob", digits=9)


@query("""
WITH c AS (SELECT p_size AS bin, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total FROM c)
SELECT q, min(bin) AS bin, min(cum)::BIGINT AS cumulative FROM r, (VALUES (0.25::DOUBLE), (0.5), (0.75)) AS t(q) WHERE cum >= q * total GROUP BY q""")
def quantiles_of_counts(spark, sf):
    c = table(spark, sf, "part").groupBy(F.col("p_size").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return D.quantiles_of_counts(c, "bin", "n", [0.25, 0.5, 0.75])


@query("""
WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer GROUP BY ALL)
SELECT c_custkey, round(c_acctbal - m, 6) AS centered, round((c_acctbal - m) / s, 6) AS standardized FROM customer JOIN m USING (c_mktsegment)""")
def standardized(spark, sf):
    return rounded(D.standardized(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"]).select("c_custkey", "centered", "standardized"), "centered", "standardized")


@query("""
SELECT l_orderkey, l_linenumber, round(p / (1 - p), 9) AS odds, round(ln(p / (1 - p)), 9) AS logit, round(1 / (1 + exp(-l_quantity / 10) + 2.220446049250313e-16), 9) AS sigmoid,
  round(l_quantity / 7, 9) AS unscaled, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS is_returned, round((l_tax - 0.04) * (l_tax - 0.04), 9) AS sq_dev, l_quantity BETWEEN 10 AND 20 AS inside
FROM (SELECT *, (l_discount + 0.01) / 2 AS p FROM lineitem)""")
def transformations(spark, sf):
    p = (F.col("l_discount") + 0.01) / 2
    return rounded(
        table(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", S.odds(p).alias("odds"), S.logit(p).alias("logit"), S.sigmoid(F.col("l_quantity") / 10).alias("sigmoid"), S.unscale(F.col("l_quantity"), F.lit(7.0)).alias("unscaled"),
            S.indicator(F.col("l_returnflag"), F.lit("R")).alias("is_returned"), S.squared_deviation(F.col("l_tax"), F.lit(0.04)).alias("sq_dev"), F.col("l_quantity").between(10, 20).alias("inside"),
        ), "odds", "logit", "sigmoid", "unscaled", "sq_dev", digits=9,
    )


@query("""
SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson, (SELECT round(corr(rx, ry), 6) FROM (SELECT avg(r1) OVER (PARTITION BY l_quantity) AS rx, avg(r2) OVER (PARTITION BY l_extendedprice) AS ry
  FROM (SELECT l_quantity, l_extendedprice, row_number() OVER (ORDER BY l_quantity) AS r1, row_number() OVER (ORDER BY l_extendedprice) AS r2 FROM lineitem))) AS spearman FROM lineitem""")
def correlations(spark, sf):
    return rounded(D.correlations(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), "pearson", "spearman")


@query("""
WITH c AS (SELECT l_discount AS x, l_tax AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) AS s FROM c a JOIN c b ON a.x > b.x),
t AS (SELECT sum(n) AS n FROM c), tx AS (SELECT sum(t * (t - 1) / 2) AS v FROM (SELECT sum(n) AS t FROM c GROUP BY x)), ty AS (SELECT sum(t * (t - 1) / 2) AS v FROM (SELECT sum(n) AS t FROM c GROUP BY y))
SELECT round(s.s / sqrt((t.n * (t.n - 1) / 2 - tx.v) * (t.n * (t.n - 1) / 2 - ty.v)), 6) AS kendall FROM s, t, tx, ty""")
def kendall_tau(spark, sf):
    return rounded(D.kendall(table(spark, sf, "lineitem"), "l_discount", "l_tax"), "kendall")


@query("SELECT event_id, round(sum(value) OVER w, 4) AS cum, round(sum(value * value) OVER w, 4) AS cum_sq, row_number() OVER w - 1 AS pos FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def cumulative_sums(spark, sf):
    run = P.prefix(table(spark, sf, "events").select("event_id", "value"), ["event_id"], {"cum": F.col("value"), "cum_sq": F.col("value") * F.col("value"), "pos": F.lit(1).cast("long")})
    return run.select("event_id", F.round("cum", 4).alias("cum"), F.round("cum_sq", 4).alias("cum_sq"), (F.col("pos") - 1).alias("pos"))


@query("""
WITH r AS (SELECT user_id, row_number() OVER w - 1 AS pos, sum(value) OVER w AS val FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, min(pos) AS pos, round(arg_min(val, pos), 6) AS val FROM r WHERE val >= 100 GROUP BY user_id""")
def first_reaching(spark, sf):
    return rounded(P.first_reaching(table(spark, sf, "events"), ["event_id"], "value", 100, ["user_id"]), "val")


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)
SELECT event_type, round(coalesce(sum(value) FILTER (k > 5 AND k <= 50), 0), 6) AS range_sum FROM r GROUP BY event_type""")
def range_sum(spark, sf):
    return rounded(P.range_sum(table(spark, sf, "events"), ["event_id"], "value", 5, 50, ["event_type"]), "range_sum")


@query("""
SELECT event_id, (list_sort(l))[len(l) // 2 + 1] AS rolling_median FROM (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM events)""")
def rolling_median(spark, sf):
    return P.rolling_median(table(spark, sf, "events"), ["event_id"], "value", 5, ["user_id"]).select("event_id", "rolling_median")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders")
def ranks(spark, sf):
    return P.numbered(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "rank")


@query("""
SELECT event_id, len(list_filter(l, lambda x: x <= value))::INT AS insert_rank FROM (SELECT event_id, value, coalesce(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), []) AS l FROM events)""")
def rank_on_insert(spark, sf):
    return P.rank_on_insert(table(spark, sf, "events"), ["event_id"], "value", ["user_id"], 20).select("event_id", "insert_rank")


@query("""
WITH p AS (SELECT event_id, value / sum(value) OVER () AS p FROM events)
SELECT event_id, round(sum(-(p + 2.220446049250313e-16) * ln(p + 2.220446049250313e-16)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS cum_entropy FROM p""")
def cumulative_entropy(spark, sf):
    p = D.to_probabilities(table(spark, sf, "events").select("event_id", "value"), "value")
    return rounded(P.prefix(p, ["event_id"], {"cum_entropy": S.entropy_term(F.col("prob"))}).select("event_id", "cum_entropy"), "cum_entropy")


@query("SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey LIMIT 25")
def top_n(spark, sf):
    """A limit that is the feature: the n largest."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice").orderBy(F.col("l_extendedprice").desc(), "l_orderkey").limit(25)


@query("SELECT p_type AS level, (row_number() OVER (ORDER BY min(p_partkey)) - 1)::BIGINT AS code FROM part GROUP BY p_type")
def factor_codes(spark, sf):
    """Category codes in order of first appearance."""
    return D.factor_codes(table(spark, sf, "part"), "p_type", "p_partkey")


@query("SELECT n_regionkey, to_json(list({'key': n_nationkey, 'name': n_name} ORDER BY n_nationkey))::VARCHAR AS rows FROM nation GROUP BY ALL")
def table_as_json(spark, sf):
    """A table's rows as a JSON array of objects, one for each region."""
    rows = F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(rows).alias("rows"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS loc, round(var_samp(value), 6) AS scale FROM events GROUP BY ALL")
def distribution_aggregate(spark, sf):
    """A group's values as a distribution (n, loc, scale) by a SQL aggregate; n counts nulls, the moments skip them."""
    d = table(spark, sf, "events").groupBy("event_type").agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("value").alias("loc"), F.var_samp("value").alias("scale")).alias("d"))
    return d.select("event_type", "d.n", F.round("d.loc", 6).alias("loc"), F.round("d.scale", 6).alias("scale"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf):
    return table(spark, sf, "lineitem").cube(*FLAG).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("q"))
