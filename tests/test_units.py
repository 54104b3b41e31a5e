"""Golden values, invariants and brute force for what SQL does not cover."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions import densities as L
from statloom.functions import scalar as S
from statloom.operators import cluster as C
from statloom.operators import conjugate as J
from statloom.operators import graph as G
from statloom.operators import histogram as H
from statloom.operators import interpolate as I
from statloom.operators import linear as M
from statloom.operators import partition as P
from statloom.operators import prefix
from statloom.streaming import online as O
from tests.conftest import DATA


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head()[0]


def test_special_functions(spark):
    xs = [0.1, 0.5, 1.0, 2.5, 5.5, 30.0, 1000.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.lgamma(F.col("x")).alias("g"), S.erf(F.col("x") - 3).alias("e")).collect()
    for r in got:
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-13)
        assert r.e == pytest.approx(math.erf(r.x - 3), abs=1e-14)


def test_densities(spark):
    x = F.lit
    assert value(spark, L.normal(x(3.0), 1.0, 10.0)) == pytest.approx(-2.270231079701696)
    assert value(spark, L.beta(x(0.3), 2.0, 5.0)) == pytest.approx(0.7705248015812911)
    assert value(spark, L.binomial(x(3.0), 10.0, 0.2)) == pytest.approx(-1.6028268537197237)
    assert value(spark, L.poisson(x(4.0), 2.5)) == pytest.approx(-2.0128909028513244)
    assert value(spark, L.gamma(x(2.0), 2.5, 1.5)) == pytest.approx(-1.591958203236746)
    assert value(spark, L.bernoulli(x(0), 0.3)) == pytest.approx(math.log(0.7))
    assert value(spark, S.logit(x(1.0))) == math.inf


def test_least_squares(spark):
    rows = [(1.0, 1.0, 0.1), (1.4, 1.5, 0.1), (2.1, 2.0, 0.2), (2.4, 2.5, 0.3), (3.1, 3.0, 0.4)]
    df = spark.createDataFrame(rows, "y double, v double, s double")
    fit = M.ols(df, "y", ["v"])
    assert fit.beta == pytest.approx([-0.08, 1.04]) and fit.r2 == pytest.approx(0.986861313868613)
    assert fit.inverse == pytest.approx(np.array([[1.8, -0.8], [-0.8, 0.4]]))
    assert M.ols(df, "y", ["v"], weight=1 / F.col("s")).beta == pytest.approx([-0.07078652, 1.03146067])
    with pytest.raises(ValueError):
        M.ols(df.withColumn("w", F.col("v")), "y", ["v", "w"])


def test_logistic(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.5), (1.0, 2.0), (0.0, 2.5), (1.0, 3.0)], "y double, v double")
    assert M.irls(df, "y", ["v"], "binomial").beta == pytest.approx([0.405465108, 0], abs=1e-6)


def test_filters(spark):
    rng = np.random.default_rng(1)
    rows = [(k % 3, k, float(rng.normal()), float(rng.normal())) for k in range(90)]
    df = spark.createDataFrame(rows, "k int, t int, y double, x double")
    got = {r.k: (r.n, r.b) for r in M.adaptive(df, "k", "t", "y", ["x"], lambda: M.LMS(1, 0.1)).collect()}
    for key in range(3):
        f = M.LMS(1, 0.1)
        for k, _, y, x in rows:
            if k == key:
                f.step(np.array([x]), y)
        assert got[key] == (30, pytest.approx(f.b.tolist()))


def test_rolling_median(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(1, 11)], "g int, t int, v double")
    got = [r.rolling_median for r in prefix.rolling_median(df, ["t"], "v", 5, ["g"]).orderBy("t").collect()]
    assert got == [1, 2, 2, 3, 3, 4, 5, 6, 7, 8]


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(0, 0.3, (30, 2)), rng.normal(5, 0.3, (30, 2)), rng.uniform(-3, 8, (10, 2))))
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(x)], "id long, point array<double>")
    got = {r.id: (r.cluster, r.role) for r in C.dbscan(df, 0.5, 4).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = (d < 0.5) & ~np.eye(len(x), dtype=bool)
    core = near.sum(1) >= 4
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        for i in np.flatnonzero(core):
            label[i] = min([label[i], *label[near[i] & core]])
    for i in range(len(x)):
        if not core[i]:
            own = label[near[i] & core]
            assert got[i] == ((own.min(), "border") if len(own) else (-1, "noise"))
        else:
            assert got[i] == (label[i], "core")


def test_kmeans(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.1, (20, 2)) for m in (0, 5, 10)])
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(x)], "id long, point array<double>")
    out, centers, _ = C.kmeans(df, 3)
    assert sorted(np.round(centers[:, 0]).astype(int)) == [0, 5, 10]
    assert sorted(r["count"] for r in out.groupBy("cluster").count().collect()) == [20, 20, 20]


def test_partitions():
    p = np.array([0.01, 0.05, 0.2, 0.1, 0.02, 0.01, 0.02, 0.12, 0.3, 0.1, 0.05, 0.02])
    parts = P.highest_density(p, 2, 1, 0.7)
    assert sum(P.mass(p, x) for x in parts) >= 0.7
    assert all(a[2] < b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert all(a <= m <= b for a, m, b in parts)
    for found in (P.least_entropy(p, (1, 3), (3, 9)), P.density_intervals(p, 1, 2, 2)):
        assert found and all(a <= m <= b for a, m, b in found)


def test_graph(spark):
    g = G.Graph().add("a", "normal").add("b", "normal", scale=2.0).condition("b", "a", weights=[2.0])
    assert g.order() == ["a", "b"] and g.family("a")["children"] == [{"child": "b", "coparents": []}]
    assert G.Graph.from_json(g.to_json()).edges == g.edges
    row = spark.createDataFrame([(1.0, 3.0)], "a double, b double").select(g.log_probability()).head()[0]
    assert row == pytest.approx(-0.5 * (math.log(2 * math.pi) + 1) - 0.5 * (math.log(4 * math.pi) + 0.5))
    with pytest.raises(ValueError):
        g.condition("a", "b")


def test_ks_normal(spark):
    xs = np.random.default_rng(4).normal(0, 1, 200)
    got = H.ks_normal(spark.createDataFrame([(float(x),) for x in xs], "x double"), "x", 0.0, 1.0).head()
    s = np.sort(xs)
    f = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in s])
    assert got.diff == pytest.approx(np.abs(f - np.arange(1, 201) / 200).max(), abs=1e-12)


def test_interpolation(spark):
    x, y = np.meshgrid(range(4), range(4))
    surface = I.ThinPlate(x.ravel(), y.ravel(), (x + 2 * y).ravel())
    assert surface([1.5], [2.0])[0] == pytest.approx(5.5, abs=1e-6)
    assert value(spark, surface.column(F.lit(1.5), F.lit(2.0))) == pytest.approx(5.5, abs=1e-6)
    assert value(spark, I.polynomial(F.lit(3.0), [0, 1, 2], [0, 1, 4])) == pytest.approx(9)


def test_joint_normals():
    cov = np.array([[2.0, 0.5], [0.5, 1.0]])
    mean, left = J.conditional(np.zeros(2), cov, {1: 2.0})
    assert mean == pytest.approx([1.0]) and left == pytest.approx(np.array([[1.75]]))
    assert J.partial_correlation(cov, 0, 1) == pytest.approx(J.correlation(cov)[0, 1])
    assert J.is_positive_definite(J.nearest_positive_definite(np.array([[1.0, 2.0], [2.0, 1.0]])))


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = O.drained(O.running_summary(stream, "value", ["event_type"]), "summary", "complete", str(tmp_path / "c"))
    batch = O.running_summary(events, "value", ["event_type"])
    rows = lambda df: sorted((r.event_type, r.n, r.min, r.max, round(r.mean, 9)) for r in df.collect())
    assert rows(got) == rows(batch)
