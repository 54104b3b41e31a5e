"""Queries: linear models, conjugate updates, distances, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import scalar as S
from statloom.operators import cluster as C
from statloom.operators import conjugate as J
from statloom.operators import linear as M
from statloom.plans.define import query
from statloom.plans.descriptive import rounded
from statloom.shared import table


@query("SELECT unnest(['(intercept)', 'l_quantity']) AS term, unnest([round(regr_intercept(l_extendedprice, l_quantity), 4), round(regr_slope(l_extendedprice, l_quantity), 4)]) AS beta, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols(spark, sf):
    fit = M.ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(fit.table(spark), "beta", digits=4).withColumn("r2", F.round(F.lit(float(fit.r2)), 6))


@query("""
WITH s AS (SELECT sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy FROM (SELECT 1 / (l_tax + 0.1) AS w, l_quantity AS x, l_extendedprice AS y FROM lineitem))
SELECT unnest(['(intercept)', 'l_quantity']) AS term, unnest([round((wy - (w * wxy - wx * wy) / (w * wxx - wx * wx) * wx) / w, 3), round((w * wxy - wx * wy) / (w * wxx - wx * wx), 3)]) AS beta FROM s""")
def wls(spark, sf):
    return rounded(M.ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], weight=1 / (F.col("l_tax") + 0.1)).table(spark), "beta", digits=3)


def _newton(rows: str, mean: str, variance: str, names: str) -> str:
    """Fisher scoring of an intercept and one slope by a recursion of 30 steps over rows (y, x)."""
    return f"""
WITH RECURSIVE d AS ({rows}), r(step, b0, b1) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT step + 1, b0 + (s11 * g0 - s01 * g1) / (s00 * s11 - s01 * s01), b1 + (s00 * g1 - s01 * g0) / (s00 * s11 - s01 * s01)
  FROM (SELECT step, b0, b1, sum({variance}) AS s00, sum({variance} * x) AS s01, sum({variance} * x * x) AS s11, sum(y - m) AS g0, sum((y - m) * x) AS g1
    FROM (SELECT step, b0, b1, x, y, {mean} AS m FROM r, d WHERE step < 30) GROUP BY step, b0, b1))
SELECT unnest({names}) AS term, unnest([round(b0, 6), round(b1, 6)]) AS beta FROM r WHERE step = 30"""


@query(_newton("SELECT (l_returnflag = 'R')::INT::DOUBLE AS y, l_quantity / 50 AS x FROM lineitem", "1 / (1 + exp(-(b0 + b1 * x)))", "m * (1 - m)", "['(intercept)', 'x']"))
def logistic_irls(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_quantity") / 50).alias("x"))
    return rounded(M.irls(d, "y", ["x"], "binomial").table(spark), "beta")


@query(_newton("SELECT l_linenumber::DOUBLE AS y, l_discount AS x FROM lineitem", "exp(b0 + b1 * x)", "m", "['(intercept)', 'l_discount']"))
def poisson_irls(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("double").alias("y"), "l_discount")
    return rounded(M.irls(d, "y", ["l_discount"], "poisson").table(spark), "beta")


@query("""
WITH l AS (SELECT user_id, value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS x FROM events)
SELECT unnest(['(intercept)', 'lag_1']) AS term, unnest([round(regr_intercept(y, x), 6), round(regr_slope(y, x), 6)]) AS beta FROM l WHERE x IS NOT NULL""")
def wiener_filter(spark, sf):
    return rounded(M.wiener(table(spark, sf, "events"), ["event_id"], "value", 1, ["user_id"]).table(spark), "beta")


def _fold(start: str, new: str, digits: int) -> str:
    """Each user's filter as a fold over the rows in order; a struct holds a row (y, x) and the state."""
    empty = start.replace("1e-6", "0.0").replace("100.0", "0.0")
    return f"""
SELECT user_id, n, round(s.b0, {digits}) AS b0, round(s.b1, {digits}) AS b1 FROM (SELECT user_id, count(*) AS n, list_reduce(
  list_concat([{{'y': 0.0::DOUBLE, 'x': 0.0::DOUBLE, {start}}}], list({{'y': value, 'x': (event_id % 7 / 7)::DOUBLE, {empty}}} ORDER BY event_id)), lambda a, e: {new}) AS s FROM events GROUP BY user_id)"""


_LMS = _fold("'b0': 1e-6::DOUBLE, 'b1': 1e-6::DOUBLE", "{'y': 0.0::DOUBLE, 'x': 0.0::DOUBLE, 'b0': a.b0 + 0.05 * (e.y - a.b0 - a.b1 * e.x), 'b1': a.b1 + 0.05 * (e.y - a.b0 - a.b1 * e.x) * e.x}", 6)
_V = "(0.99 + a.p + 2 * a.q * e.x + a.r * e.x * e.x)"  # forgetting factor and x'Px for P = [[p, q], [q, r]]
_RLS = _fold(
    "'b0': 0.0::DOUBLE, 'b1': 0.0::DOUBLE, 'p': 100.0::DOUBLE, 'q': 0.0::DOUBLE, 'r': 100.0::DOUBLE",
    f"{{'y': 0.0::DOUBLE, 'x': 0.0::DOUBLE, 'b0': a.b0 + (a.p + a.q * e.x) / {_V} * (e.y - a.b0 - a.b1 * e.x), 'b1': a.b1 + (a.q + a.r * e.x) / {_V} * (e.y - a.b0 - a.b1 * e.x), "
    f"'p': (a.p - (a.p + a.q * e.x) * (a.p + a.q * e.x) / {_V}) / 0.99, 'q': (a.q - (a.p + a.q * e.x) * (a.q + a.r * e.x) / {_V}) / 0.99, 'r': (a.r - (a.q + a.r * e.x) * (a.q + a.r * e.x) / {_V}) / 0.99}}",
    4,
)


def _coefficients(df, digits):
    return df.select("user_id", "n", *[F.round(F.get("b", F.lit(k)), digits).alias(f"b{k}") for k in (0, 1)])


@query(_LMS)
def lms_filter(spark, sf):
    """Each user's adaptive coefficients."""
    d = table(spark, sf, "events").select("user_id", "event_id", F.col("value").alias("y"), F.lit(1.0).alias("one"), (F.col("event_id") % 7 / 7).alias("x"))
    return M.adaptive(d, "user_id", "event_id", "y", ["one", "x"], lambda: M.LMS(2, 0.05)).transform(_coefficients, 6)


@query(_RLS)
def rls_filter(spark, sf):
    d = table(spark, sf, "events").select("user_id", "event_id", F.col("value").alias("y"), F.lit(1.0).alias("one"), (F.col("event_id") % 7 / 7).alias("x"))
    return M.adaptive(d, "user_id", "event_id", "y", ["one", "x"], lambda: M.RLS(2, 0.01, 0.99)).transform(_coefficients, 4)


@query("SELECT l_linestatus, 2.0 + sum(y) AS alpha, 3.0 + count(*) - sum(y) AS beta FROM (SELECT l_linestatus, (l_returnflag = 'R')::INT AS y FROM lineitem) GROUP BY ALL")
def beta_bernoulli(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return J.beta_bernoulli(d, "y", 2.0, 3.0, ["l_linestatus"])


@query("SELECT l_linestatus, (1.0 + sum(l_linenumber))::DOUBLE AS alpha, (0.5 + count(*))::DOUBLE AS beta FROM lineitem GROUP BY ALL")
def gamma_poisson(spark, sf):
    return J.gamma_poisson(table(spark, sf, "lineitem"), "l_linenumber", 1.0, 0.5, ["l_linestatus"])


@query("SELECT event_type, round((40.0 * 0.01 + sum(value) * 0.002) / (0.01 + count(*) * 0.002), 6) AS mean, round(1 / (0.01 + count(*) * 0.002), 6) AS variance FROM events GROUP BY ALL")
def normal_normal(spark, sf):
    return rounded(J.normal_normal(table(spark, sf, "events"), "value", 40.0, 0.01, 0.002, ["event_type"]), "mean", "variance")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance FROM events GROUP BY ALL")
def normal_mle(spark, sf):
    return rounded(J.normal_mle(table(spark, sf, "events"), "value", ["event_type"]), "mean", "variance")


@query("""
SELECT unnest(['l_discount', 'l_quantity', 'l_tax']) AS a, round(unnest([covar_pop(l_discount, l_discount), covar_pop(l_discount, l_quantity), covar_pop(l_discount, l_tax)]), 6) AS with_discount,
  round(unnest([avg(l_discount), avg(l_quantity), avg(l_tax)]), 6) AS mean FROM lineitem""")
def joint_normal_mle(spark, sf):
    names = ["l_discount", "l_quantity", "l_tax"]
    mean, cov, _ = J.joint_normal(table(spark, sf, "lineitem"), names)
    return spark.createDataFrame([(n, round(float(cov[0, i]), 6), round(float(mean[i]), 6)) for i, n in enumerate(names)], "a string, with_discount double, mean double")


_E = "embedding::DOUBLE[]"


@query(f"""
SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.{_E}, b.{_E}), 6) AS euclidean, round(list_sum(list_transform(range(1, 65), lambda k: abs(a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE))), 6) AS manhattan,
  round(power(list_distance(a.{_E}, b.{_E}), 2), 6) AS squared, round(list_max(list_transform(range(1, 65), lambda k: abs(a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE))), 6) AS chebyshev
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0""")
def distances(spark, sf):
    """Distances of the query set (ids divisible by 50) from all vectors."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("i"), F.col("v").alias("a"))
    both = q.join(e.select(F.col("vec_id").alias("j"), "v"), F.lit(True))
    a, b = F.col("a"), F.col("v")
    return rounded(both.select("i", "j", S.euclidean(a, b).alias("euclidean"), S.manhattan(a, b).alias("manhattan"), S.squared_euclidean(a, b).alias("squared"), S.minkowski(a, b, 0).alias("chebyshev")), "euclidean", "manhattan", "squared", "chebyshev")


@query(f"""
SELECT i, j, rank FROM (SELECT a.vec_id AS i, b.vec_id AS j, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.{_E}, b.{_E}), b.vec_id)::INT AS rank FROM embeddings a, embeddings b
  WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5""")
def nearest_neighbours(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("point"))
    return C.neighbours(e.where(F.col("id") % 50 == 0), e, 5).select("i", "j", "rank")


_P = "(SELECT c_custkey AS id, c_acctbal / 100 AS x, c_nationkey::DOUBLE AS y FROM customer)"


def _points(spark, sf):
    return C.points(table(spark, sf, "customer").withColumn("x", F.col("c_acctbal") / 100), "c_custkey", ["x", "c_nationkey"])


@query(f"SELECT a.id AS i, b.id AS j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS dist FROM {_P} a JOIN {_P} b ON a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 1.0")
def neighbours_within(spark, sf):
    return rounded(C.within(_points(spark, sf), 1.0), "dist", digits=9)


@query(f"""
WITH p AS (SELECT *, id % 4 AS c FROM {_P}), m AS (SELECT c, avg(x) AS mx, avg(y) AS my FROM p GROUP BY c)
SELECT p.id, arg_min(m.c, struct_pack(d := (p.x - m.mx) * (p.x - m.mx) + (p.y - m.my) * (p.y - m.my), c := m.c))::INT AS cluster FROM p, m GROUP BY p.id""")
def kmeans_step(spark, sf):
    """One of Lloyd's steps from given allocations."""
    pts = _points(spark, sf)
    first = pts.select("id", (F.col("id") % 4).cast("int").alias("cluster"))
    centers = [r["mean"] for r in sorted(C.means(pts.join(first, "id"), 2).collect(), key=lambda r: r["cluster"])]  # 4 rows
    return C.nearest(pts, "point", centers).select("id", "cluster")


def _away(of: str) -> str:
    return f"sqrt((p.x - {of}.x) * (p.x - {of}.x) + (p.y - {of}.y) * (p.y - {of}.y))"


_KMEANS = f"""
WITH RECURSIVE p AS (SELECT id, x, y FROM {_P}), s1 AS (SELECT * FROM p ORDER BY id LIMIT 1),
s2 AS (SELECT p.* FROM p, s1 WHERE p.id <> s1.id ORDER BY {_away("s1")} DESC, p.id LIMIT 1),
s3 AS (SELECT p.* FROM p, s1, s2 WHERE p.id NOT IN (s1.id, s2.id) ORDER BY {_away("s1")} + {_away("s2")} DESC, p.id LIMIT 1),
s4 AS (SELECT p.* FROM p, s1, s2, s3 WHERE p.id NOT IN (s1.id, s2.id, s3.id) ORDER BY {_away("s1")} + {_away("s2")} + {_away("s3")} DESC, p.id LIMIT 1),
r(step, c) AS (SELECT 0, [{{'x': s1.x, 'y': s1.y}}, {{'x': s2.x, 'y': s2.y}}, {{'x': s3.x, 'y': s3.y}}, {{'x': s4.x, 'y': s4.y}}] FROM s1, s2, s3, s4 UNION ALL
  SELECT step + 1, list({{'x': mx, 'y': my}} ORDER BY k) FROM (SELECT step, k, avg(x) AS mx, avg(y) AS my FROM
    (SELECT step, x, y, list_position(d, list_min(d)) AS k FROM (SELECT step, p.x, p.y, list_transform(c, lambda z: (p.x - z.x) * (p.x - z.x) + (p.y - z.y) * (p.y - z.y)) AS d FROM r, p WHERE step < 50)) GROUP BY step, k) GROUP BY step)
SELECT id, (list_position(d, list_min(d)) - 1)::INT AS cluster, round(list_min(d), 6) AS dist FROM (SELECT id, list_transform(c, lambda z: sqrt((p.x - z.x) * (p.x - z.x) + (p.y - z.y) * (p.y - z.y))) AS d FROM r, p WHERE step = 50)"""


@query(_KMEANS)
def kmeans(spark, sf):
    return C.kmeans(_points(spark, sf), 4)[0].select("id", "cluster", F.round("dist", 6).alias("dist"))


@query(f"""
WITH RECURSIVE p AS (SELECT id, x, y FROM {_P}), near AS (SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 1.0),
core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 3), e AS (SELECT i, j FROM near WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
r AS (SELECT i, i AS j FROM core UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i), label AS (SELECT i, min(j) AS c FROM r GROUP BY i),
border AS (SELECT near.i, min(label.c) AS c FROM near JOIN label ON label.i = near.j GROUP BY near.i)
SELECT p.id, coalesce(label.c, border.c, -1) AS cluster, CASE WHEN label.c IS NOT NULL THEN 'core' WHEN border.c IS NOT NULL THEN 'border' ELSE 'noise' END AS role
FROM p LEFT JOIN label ON label.i = p.id LEFT JOIN border ON border.i = p.id""")
def dbscan(spark, sf):
    """Core, border and noise."""
    return C.dbscan(_points(spark, sf), 1.0, 3)


@query(f"""
WITH RECURSIVE p AS (SELECT id, x, y FROM {_P}), e AS (SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 0.8),
r AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i)
SELECT i AS id, min(j) AS cluster FROM r GROUP BY i""")
def threshold_clusters(spark, sf):
    return C.threshold_clusters(_points(spark, sf), 0.8)


@query()
def hierarchical(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("point"))
    return C.agglomerate(e, "complete", 8)


_S = "(SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey * 100.0 AS y FROM supplier)"


@query(f"SELECT a.id AS i, b.id AS j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS dist FROM {_S} a JOIN {_S} b ON a.id <= b.id")
def distance_matrix(spark, sf):
    """All pairs of suppliers with i <= j: the matrix is what is asked for."""
    pts = C.points(table(spark, sf, "supplier").withColumn("y", F.col("s_nationkey") * 100.0), "s_suppkey", ["s_acctbal", "y"])
    return rounded(C.distance_matrix(pts), "dist")


@query("""
WITH p AS (SELECT value, 0.6 * exp(-(value - 20) * (value - 20) / 200) / sqrt(200 * pi()) AS a, 0.4 * exp(-(value - 70) * (value - 70) / 800) / sqrt(800 * pi()) AS b FROM events)
SELECT z, count(*) AS n, round(sum(CASE WHEN z = 0 THEN a ELSE b END / (a + b + 1e-300)), 4) AS total FROM p, (SELECT unnest([0, 1]) AS z) GROUP BY z""")
def mixture_shares(spark, sf):
    """Every value with every component of a mixture, summed."""
    each = C.responsibilities(table(spark, sf, "events"), "value", [(0.6, 20.0, 100.0), (0.4, 70.0, 400.0)])
    return each.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("share"), 4).alias("total"))


@query("SELECT o_orderpriority, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY ALL")
def cluster_extremes(spark, sf):
    return C.extremes(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
