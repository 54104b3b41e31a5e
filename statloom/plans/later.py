"""Queries: modal partitions, graphs, interpolation, errors of a decision, streams run as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import sql
from statloom.operators import graph as G
from statloom.operators import histogram as H
from statloom.operators import interpolate as I
from statloom.operators import interval as V
from statloom.operators import model as M
from statloom.operators import partition as P
from statloom.plans.define import query
from statloom.plans.descriptive import rounded
from statloom.shared import table
from statloom.streaming import online as O


def _hist(spark, sf):
    return H.histogram(table(spark, sf, "events"), "value", 32, ["event_type"])


@query()
def highest_density_partition(spark, sf):
    return rounded(P.partitions(_hist(spark, sf), lambda p: P.highest_density(p, 3, 1, 0.6), ["event_type"]), "mass")


@query()
def entropy_partition(spark, sf):
    return rounded(P.partitions(_hist(spark, sf), lambda p: P.least_entropy(p, (2, 4), (4, 16)), ["event_type"]), "mass")


@query()
def median_mode_partition(spark, sf):
    return rounded(P.partitions(_hist(spark, sf), lambda p: P.closest_median_mode(p, (1, 4), (4, 16), 12, 0.05), ["event_type"]), "mass")


_DENSE = """
WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY ALL), h AS (SELECT *, (hi - lo) / 32 AS w FROM s),
c AS (SELECT event_type, least(floor((value - lo) / w), 31)::INT AS bin, count(*) AS c FROM events JOIN h USING (event_type) GROUP BY ALL),
p AS (SELECT h.event_type, b.bin, coalesce(c.c, 0) / h.n AS p FROM h CROSS JOIN (SELECT unnest(range(32))::INT AS bin) b LEFT JOIN c ON c.event_type = h.event_type AND c.bin = b.bin),
o AS (SELECT x.event_type, x.bin AS a, y.bin + 1 AS b, sum(z.p) AS mass FROM p x JOIN p y ON y.event_type = x.event_type AND y.bin >= x.bin + 2 JOIN p z ON z.event_type = x.event_type AND z.bin BETWEEN x.bin AND y.bin GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(-mass / (b - a), 12), a, b) AS k FROM o),
k1 AS (SELECT * FROM k WHERE k = 1),
k2 AS (SELECT k.* FROM k JOIN k1 ON k1.event_type = k.event_type AND (k.b <= k1.a OR k.a >= k1.b) QUALIFY row_number() OVER (PARTITION BY k.event_type ORDER BY k.k) = 1),
k3 AS (SELECT k.* FROM k JOIN k1 ON k1.event_type = k.event_type AND (k.b <= k1.a OR k.a >= k1.b) JOIN k2 ON k2.event_type = k.event_type AND (k.b <= k2.a OR k.a >= k2.b) QUALIFY row_number() OVER (PARTITION BY k.event_type ORDER BY k.k) = 1),
f AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3)
SELECT f.event_type, (row_number() OVER (PARTITION BY f.event_type ORDER BY a) - 1)::INT AS part, a AS first, (SELECT arg_max(bin, round(p.p, 12) * 1000 + bin * 1e-9) FROM p WHERE p.event_type = f.event_type AND p.bin >= a AND p.bin < b) AS mode, b - 1 AS last, round(mass, 6) AS mass FROM f"""


@query(_DENSE)
def density_intervals(spark, sf):
    return rounded(P.partitions(_hist(spark, sf), lambda p: P.density_intervals(p, 1, 3, 3), ["event_type"]), "mass")


@query("""
WITH e AS (SELECT DISTINCT l_partkey AS parent, l_orderkey AS child FROM lineitem)
SELECT child AS node, parent AS member, 'parent' AS role FROM e UNION SELECT parent, child, 'child' FROM e UNION SELECT a.parent, b.parent, 'coparent' FROM e a JOIN e b ON a.child = b.child AND a.parent <> b.parent""")
def markov_blankets(spark, sf):
    """Parts are the parents of the orders that hold them; every line is an edge."""
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("parent"), F.col("l_orderkey").alias("child"))
    return G.markov_blankets(edges)


@query("SELECT round(sum(-0.5 * (ln(2 * pi()) + ln(900.0) + power(value - 50, 2) / 900) + 0.5 * (ln(2 * pi()) + ln(400.0) + power(value - 40, 2) / 400)), 2) AS log_evidence_ratio FROM events")
def evidence_ratio(spark, sf):
    a = G.Graph().add("value", "normal", loc=50.0, scale=900.0)
    b = G.Graph().add("value", "normal", loc=40.0, scale=400.0)
    return rounded(G.evidence_ratio(table(spark, sf, "events"), a.log_probability(), b.log_probability()), "log_evidence_ratio", digits=2)


@query("""
WITH d AS (SELECT l_quantity AS s, (l_returnflag = 'R')::INT AS y FROM lineitem), t AS (SELECT DISTINCT s AS threshold FROM d),
e AS (SELECT threshold, sum(CASE WHEN (d.s >= threshold)::INT <> d.y THEN 1 ELSE 0 END)::BIGINT AS errors FROM t, d GROUP BY threshold)
SELECT threshold, errors FROM (SELECT * FROM e UNION ALL SELECT 'infinity'::DOUBLE, sum(y)::BIGINT FROM d) ORDER BY errors, threshold LIMIT 1""")
def decision_boundary(spark, sf):
    return G.decision_boundary(table(spark, sf, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y")), "l_quantity", "y")


@query("""
WITH c AS (SELECT l_quantity AS s, count(*) FILTER (l_returnflag = 'R') AS one, count(*) FILTER (l_returnflag <> 'R') AS zero FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(zero) OVER (ORDER BY s) AS zeros FROM c) SELECT round(sum(one * (zeros - zero / 2)) / (sum(one) * sum(zero)), 9) AS auc FROM r""")
def auc(spark, sf):
    return rounded(G.auc(table(spark, sf, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y")), "l_quantity", "y"), "auc", digits=9)


@query("""
WITH p AS (SELECT c_custkey, c_acctbal / 100 + 10 AS x, c_nationkey::DOUBLE AS y FROM customer)
SELECT c_custkey, round(CASE WHEN x BETWEEN 0 AND 120 AND y BETWEEN 0 AND 30 THEN (1 * (1 - x / 120) * (1 - y / 30) + 3 * (x / 120) * (1 - y / 30) + 2 * (1 - x / 120) * (y / 30) + 7 * (x / 120) * (y / 30)) END, 8) AS z FROM p""")
def bilinear(spark, sf):
    c = table(spark, sf, "customer")
    z = I.bilinear(F.col("c_acctbal") / 100 + 10, F.col("c_nationkey").cast("double"), [0, 120], [0, 30], [[1, 2], [3, 7]])
    return rounded(c.select("c_custkey", z.alias("z")), "z", digits=8)


@query("SELECT event_id, (event_id >= 200)::INT + (event_id >= 900)::INT AS slice FROM events WHERE NOT (event_id >= 100 AND event_id < 200) AND NOT (event_id >= 500 AND event_id < 900)")
def outside_ranges(spark, sf):
    return V.outside(table(spark, sf, "events"), F.col("event_id"), [(100, 200), (500, 900)]).select("event_id", "slice")


@query("""
WITH c AS (SELECT l_quantity AS threshold, count(*) FILTER (l_returnflag = 'R') AS one, count(*) FILTER (l_returnflag <> 'R') AS zero FROM lineitem GROUP BY ALL)
SELECT threshold, round(sum(one) OVER (ORDER BY threshold DESC) / (SELECT sum(one) FROM c), 9) AS tpr, round(sum(zero) OVER (ORDER BY threshold DESC) / (SELECT sum(zero) FROM c), 9) AS fpr FROM c""")
def roc_curve(spark, sf):
    d = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(M.roc(d, "l_quantity", "y"), "tpr", "fpr", digits=9)


_SORTED = "WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY ALL) "


@query(_SORTED + "SELECT event_type, v[least(floor(n * 0.05), n - 1)::INT + 1] AS low, v[least(floor(n * 0.95), n - 1)::INT + 1] AS high FROM s")
def percentile_interval(spark, sf):
    return V.percentile_interval(table(spark, sf, "events"), "value", 0.05, 0.95, ["event_type"])


@query(_SORTED + "SELECT event_type, part, v[least(floor(n * part / 4), n - 1)::INT + 1] AS low, v[least(floor(n * (part + 1) / 4), n - 1)::INT + 1] AS high FROM s, (SELECT unnest([0, 1, 2, 3])::INT AS part)")
def quartile_intervals(spark, sf):
    return V.quantile_intervals(table(spark, sf, "events"), "value", 0.25, ["event_type"])


@query("SELECT event_type, round(avg(value) - 1.96 * stddev_pop(value), 6) AS low, round(avg(value) + 1.96 * stddev_pop(value), 6) AS high FROM events GROUP BY ALL")
def z_interval(spark, sf):
    return rounded(V.z_interval(table(spark, sf, "events"), "value", 1.96, ["event_type"]), "low", "high")


@query("SELECT event_type, round(median(value) - 2 * mad(value), 6) AS low, round(median(value) + 2 * mad(value), 6) AS high FROM events GROUP BY ALL")
def median_interval(spark, sf):
    return rounded(V.median_interval(table(spark, sf, "events"), "value", 2.0, ["event_type"]), "low", "high")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS loc, round(var_samp(value), 6) AS scale, len(list(value)) AS size FROM events GROUP BY ALL")
def sql_distribution(spark, sf):
    """The SQL function of a sample's distribution, with its data: of runs of 65,536 rows at most, so that no group is one array."""
    sql.register(spark)
    events = table(spark, sf, "events").select("event_type", "value", F.shiftright(F.monotonically_increasing_id(), 16).alias("run"))
    d = events.groupBy("event_type", "run").agg(F.expr("norm_of(collect_list(struct(value)).value)").alias("d"))
    part = F.struct("d.n", F.size(F.filter("d.data", lambda v: v.isNotNull())).cast("long").alias("known"), "d.loc", "d.scale")
    all_ = d.groupBy("event_type").agg(sql.pooled(F.collect_list(part)).alias("d"), F.sum(F.size("d.data")).alias("size"))
    return all_.select("event_type", "d.n", F.round("d.loc", 6).alias("loc"), F.round("d.scale", 6).alias("scale"), "size")


@query("""
SELECT l_linestatus, round(sum(-0.5 * (ln(2 * pi() * 200) + (l_quantity - 25) * (l_quantity - 25) / 200) + CASE l_returnflag WHEN 'A' THEN ln(0.25) WHEN 'N' THEN ln(0.5) ELSE ln(0.25) END), 3) AS log_prob FROM lineitem GROUP BY ALL""")
def graph_log_probability(spark, sf):
    """A normal and a categorical node over every row."""
    g = G.Graph().add("q", "normal", loc=25.0, scale=200.0).add("flag", "categorical", probs=[0.25, 0.5, 0.25])
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    d = table(spark, sf, "lineitem").select("l_linestatus", F.col("l_quantity").alias("q"), code.alias("flag"))
    return d.groupBy("l_linestatus").agg(F.round(F.sum(g.log_probability()), 3).alias("log_prob"))


@query("SELECT user_id, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events GROUP BY ALL")
def running_summary(spark, sf):
    """The batch twin of the streaming summary; tests run it as a stream."""
    return rounded(rounded(O.running_summary(table(spark, sf, "events"), "value", ["user_id"]), "mean"), "variance", digits=4)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_totals(spark, sf):
    w = O.windowed(table(spark, sf, "events"), "ts", "value", "1 day", "1 hour", ["event_type"])
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
