"""What must not grow with the square of the input, or through the driver."""

import time

import numpy as np
from pyspark.sql import functions as F


from statloom.functions import sql
from statloom.operators import cluster as C
from statloom.operators import graph as G


def test_linkage_in_rounds_has_no_table_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.3, (15, 3)) for m in (0, 5)] + [rng.integers(0, 3, (15, 3)).astype(float)])  # the last with equal distances
    df = spark.createDataFrame([(k * 7 % 1000, p.tolist()) for k, p in enumerate(x)], "id long, point array<double>")
    rows = lambda d: sorted(map(tuple, d.collect()))
    want = rows(C.agglomerate(df, "complete", 4))
    monkeypatch.setattr(C, "distance_matrix", None)
    monkeypatch.setattr(C, "BLOCK", 8)
    assert rows(C.agglomerate(df, "complete", 4, most=20)) == want


def _near(x, far):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return (d < far) & ~np.eye(len(x), dtype=bool)


def _least(near):
    label = np.arange(len(near))
    for _ in label:
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(near))])
    return label


def test_dense_points_are_linked_without_their_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.uniform(0, 2, (120, 2)), rng.uniform(4, 9, (40, 2)), [[2.9, 1.0], [3.8, 1.0], [12, 12], [12, 12], [12.0, 13]], [[np.nan, 0], [np.nan, 0]])).round(2)
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(x)], "id long, point array<double>").unionByName(spark.createDataFrame([(500, None)], "id long, point array<double>"))
    for far in (0.3, 1.0):
        near = _near(x, far)
        label = _least(near)
        assert {r.id: r.cluster for r in C.threshold_clusters(df, far).collect()} == {**dict(enumerate(label.tolist())), 500: 500}
        core = near.sum(1) >= 3
        label = _least(near & core[:, None] & core[None])
        want = {500: (-1, "noise")}
        for i in range(len(x)):
            own = label[near[i] & core]
            want[i] = (label[i], "core") if core[i] else (own.min(), "border") if len(own) else (-1, "noise")
        assert {r.id: (r.cluster, r.role) for r in C.dbscan(df, far, 3).collect()} == want
    assert {(r.i, r.j) for r in C.within(df, 1.0).collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))


def test_what_grows_is_not_broadcast(spark):
    df = spark.range(50).selectExpr("id", "array(double(id), 0D) point")
    plan = C.within(df, 1.5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_norm_of_takes_time_in_proportion(spark):
    sql.register(spark)
    began = time.time()
    d = spark.range(60_000).selectExpr("norm_of(collect_list(struct(double(id) v)).v) d").selectExpr("d.n", "d.loc", "d.scale").head()
    assert time.time() - began < 20  # its square is 3.6e9 values
    assert (d.n, d.loc) == (60_000, 29_999.5) and abs(d.scale / (60_000 * 60_001 / 12) - 1) < 1e-12


def test_pooled_samples(spark):
    parts = "array(named_struct('n', 3L, 'known', 2L, 'loc', 2D, 'scale', 2D), named_struct('n', 1L, 'known', 0L, 'loc', double(null), 'scale', double(null)), named_struct('n', 1L, 'known', 1L, 'loc', 8D, 'scale', double(null)))"
    d = spark.range(1).select(F.expr(parts).alias("p")).select(sql.pooled(F.col("p")).alias("d")).head().d
    assert (d.n, d.loc, d.scale) == (5, 4.0, 13.0)  # 1, 3, 8


def test_markov_blankets_shuffle_edges_once(spark):
    edges = spark.createDataFrame([(1, 10), (2, 10), (1, 10), (2, 11), (1, 11), (None, 11)], "parent long, child long")
    d = G.markov_blankets(edges)
    assert sorted(map(tuple, d.where("node is not null and member is not null").collect())) == sorted([(10, 1, "parent"), (10, 2, "parent"), (11, 2, "parent"), (11, 1, "parent"), (1, 10, "child"), (2, 10, "child"), (2, 11, "child"), (1, 11, "child"), (1, 2, "coparent"), (2, 1, "coparent")])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(child") <= 4 and "Exchange hashpartitioning(node" not in plan


def test_neighbours_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "distance_pairs", None)
    monkeypatch.setattr(C, "GROUP", 40)
    x = np.random.default_rng(7).integers(0, 4, (90, 3)).astype(float)  # with equal distances and places
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(x)], "id long, point array<double>")
    got = {}
    for r in C.neighbours(df.where("id % 10 = 0"), df, 4).collect():
        got[r.i, r["rank"]] = (r.j, r.dist)
    for i in range(0, 90, 10):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        for k, j in enumerate([j for j in np.lexsort((np.arange(90), d)) if j != i][:4]):
            assert got[i, k + 1] == (j, d[j])
    assert len(got) == 36


def test_matrix_and_centers_are_spread_and_compiled(spark):
    df = spark.range(30).selectExpr("id", "array(double(id), 1D) point").coalesce(1)
    assert C.distance_matrix(df).rdd.getNumPartitions() > 1
    plan = C.nearest(df, "point", np.array([[1.0, 0.0], [3.0, 0.0]]))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and C.nearest(df, "point", np.array([[1.0, 0.0], [3.0, 0.0]])).where("id = 2").head().cluster == 0
