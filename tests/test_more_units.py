"""Readers, regressions off centre, sampling, intervals, documents, the command line, SQL functions, linkage, streams."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.__main__ import main
from statloom.functions import densities as L
from statloom.functions import sql
from statloom.operators import basis, describe, interpolate, interval, prefix
from statloom.operators import cluster as C
from statloom.operators import graph as G
from statloom.operators import linear as M
from statloom.operators import model as E
from statloom.operators import sampling as R
from statloom.sources import files
from statloom.sources.documents import Document, read_document, write_document
from statloom.streaming import online as O
from tests.conftest import DATA


def test_csv_with_malformed_rows(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b,s\n1.5,2,"x, y"\n9,1.5,2,"z"\nzz,1,w\n\n2,3,"q"\n')
    good, bad = files.read_csv(spark, str(path), "a double, b double, s string")
    assert [tuple(r) for r in good.collect()] == [(1.5, 2.0, "x, y"), (2.0, 3.0, "q")]
    assert [r[0] for r in bad.collect()] == ['9,1.5,2,"z"', "zz,1,w"]
    assert files.create_statement(good, "t") == "CREATE TABLE t (`a` double, `b` double, `s` string)"
    assert json.loads(files.show_values(b=2, a=np.array([1.0]))) == {"a": [1.0], "b": 2}


def test_range_sum_beyond_a_group(spark):
    df = spark.createDataFrame([("a", k, 1.0) for k in range(20)] + [("b", k, 1.0) for k in range(3)], "g string, t int, v double")
    assert {r.g: r.range_sum for r in prefix.range_sum(df, ["t"], "v", 5, 50, ["g"]).collect()} == {"a": 15.0, "b": 0.0}
    assert {r.g: r.range_sum for r in prefix.range_sum(df, ["t"], "v", 0, 2, ["g"]).collect()} == {"a": 2.0, "b": 2.0}


def test_neighbours_of_one_coordinate(spark):
    df = spark.createDataFrame([(k, [k * 0.4]) for k in range(10)], "id long, point array<double>")
    want = {(i, j) for i in range(10) for j in range(10) if i != j and abs(i - j) * 0.4 < 1.0}
    assert {(r.i, r.j) for r in C.within(df, 1.0).collect()} == want


def test_regressions_far_from_zero(spark):
    rng = np.random.default_rng(0)
    t, x, w = 1.7e9 + rng.integers(0, 10**6, 300), rng.normal(size=300), rng.uniform(0.1, 3, 300)
    y = 3e-4 * (t - 1.7e9) + 2 * x + rng.normal(size=300)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, t, x, w, strict=True)], "y double, t double, x double, w double")
    a = np.stack((np.ones(300), t - 1.7e9, x), 1)
    for weight, root in ((None, np.ones(300)), (F.col("w"), np.sqrt(w))):
        fit = M.ols(df, "y", ["t", "x"], weight=weight)
        b = np.linalg.lstsq(a * root[:, None], y * root, rcond=None)[0]
        assert fit.beta[1:] == pytest.approx(b[1:], rel=1e-6) and fit.beta[0] == pytest.approx(b[0] - b[1] * 1.7e9, rel=1e-6)
        inner = np.linalg.inv((a * root[:, None]).T @ (a * root[:, None]))
        assert fit.inverse[1:, 1:] == pytest.approx(inner[1:, 1:], rel=1e-5)
    free = M.ols(df, "y", ["x"], M.Settings(add_intercept=False), F.col("w"))
    b = (w * x * y).sum() / (w * x * x).sum()
    m = np.average(y, weights=w)
    assert free.beta[0] == pytest.approx(b) and free.r2 == pytest.approx(1 - (w * (y - b * x) ** 2).sum() / (w * (y - m) ** 2).sum())
    fixed = M.ols(df, "y", ["t", "x"], M.Settings(fixed={"x": 2.0}))
    assert fixed.names == ["(intercept)", "t"] and fixed.beta[1] == pytest.approx(np.polyfit(t - 1.7e9, y - 2 * x, 1)[0], rel=1e-6)
    own = spark.createDataFrame([(float(v > 0), float(k)) for k, v in zip(t, np.sin(t) + x, strict=True)], "z double, t double")
    fit = M.irls(own, "z", ["t"], "binomial")
    p = 1 / (1 + np.exp(-(fit.beta[0] + fit.beta[1] * t)))
    z = (np.sin(t) + x > 0).astype(float)
    assert (z - p).sum() == pytest.approx(0, abs=1e-4) and ((z - p) * (t - t.mean())).sum() / 1e6 == pytest.approx(0, abs=1e-4)


def test_poisson_scores_and_recursive_filter(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = rng.poisson(np.exp(0.3 + 0.5 * x)).astype(float)
    fit = M.irls(spark.createDataFrame(list(zip(y.tolist(), x.tolist(), strict=True)), "y double, x double"), "y", ["x"], "poisson")
    m = np.exp(fit.beta[0] + fit.beta[1] * x)
    assert [(y - m).sum(), ((y - m) * x).sum()] == pytest.approx([0, 0], abs=1e-6)
    f = M.RLS(2, 1e-6, 1.0)
    for a, b in zip(x, y, strict=True):
        f.step(np.array([1.0, a]), b)
    assert f.b == pytest.approx(np.linalg.lstsq(np.stack((np.ones(200), x), 1), y, rcond=None)[0], abs=1e-4)
    got = M.least_absolute(spark.createDataFrame([(float(v), float(v)) for v in range(20)] + [(100.0, 3.0)], "y double, x double"), "y", ["x"])
    assert got.beta == pytest.approx([0, 1], abs=1e-3)


def test_null_keys_of_a_filter(spark):
    df = spark.createDataFrame([(None, k, 1.0, 2.0) for k in range(5)] + [(1.0, k, 1.0, 2.0) for k in range(3)], "k double, t int, y double, x double")
    assert sorted(r.n for r in M.adaptive(df, "k", "t", "y", ["x"], lambda: M.LMS(1, 0.1)).collect()) == [3, 5]


def test_kendall_and_ranks_without_nested_loops(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), float(b)) for a, b in zip(rng.integers(0, 9, 150), rng.normal(size=150).round(1), strict=True)]
    sign = lambda k: np.sign(np.subtract.outer(*[np.array([r[k] for r in rows])] * 2))
    a, b = sign(0), sign(1)
    got = describe.kendall(spark.createDataFrame(rows, "x int, y double"), "x", "y").head()[0]
    assert got == pytest.approx((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()))
    df = spark.createDataFrame([(k % 2, k, r[0]) for k, r in enumerate(rows)], "g int, t int, v int")
    for r in prefix.rank_on_insert(df, ["t"], "v", ["g"]).collect():
        assert r.insert_rank == sum(1 for k in range(r.t) if k % 2 == r.g and rows[k][0] <= r.v)


def test_graph_families(spark):
    g = G.Graph().add("c", "categorical", probs=[0.2, 0.8]).add("one", "constant", value=1.0).add("p", "poisson", rate=3.0).add("q", "gamma", shape=2.0, scale=1.5).add("b", "beta", a=2.0, b=3.0).add("k", "binomial", n=6, theta=0.5)
    lp = spark.createDataFrame([(1, 1.0)], "c int, one double").select(g.node_log_probability("c"), g.node_log_probability("one")).head()
    assert tuple(lp) == pytest.approx((math.log(0.8), 0.0))
    s = g.sample(spark, 8000).agg(*[f(c) for c in ("c", "p", "q", "b", "k") for f in (F.avg, F.var_pop)]).head()
    assert list(s) == pytest.approx([0.8, 0.16, 3, 3, 3, 4.5, 0.4, 0.04, 3, 1.5], rel=0.09)
    assert g.sample(spark, 50).collect() == g.sample(spark, 50).repartition(3).orderBy("sample").collect()
    assert G.Graph.from_json(g.to_json()).nodes == g.nodes and g.tables(spark)[0].count() == 6
    m = L.moments("categorical", 0.2, 0.3, 0.5)
    assert tuple(spark.range(1).select(m["mean"], m["mode"], m["variance"]).head()) == pytest.approx((1.3, 2.0, 0.61))
    never = spark.createDataFrame([(1.0, 0), (2.0, 0), (0.5, 1)], "s double, y int")
    assert tuple(G.decision_boundary(never, "s", "y").head()) == (math.inf, 1)


def test_draws(spark):
    cov = [[2.0, 0.5], [0.5, 1.0]]
    x = np.array([r.x for r in R.draws(spark, 8000, lambda *k: R.multinormal([1.0, 2.0], cov, *k)).collect()])
    assert x.mean(0) == pytest.approx([1, 2], abs=0.06) and np.cov(x.T) == pytest.approx(np.array(cov), abs=0.08)
    d = np.array([r.x for r in R.draws(spark, 4000, lambda *k: R.dirichlet([1.0, 2.0, 3.0], *k)).collect()])
    assert d.sum(1) == pytest.approx(np.ones(4000)) and d.mean(0) == pytest.approx([1 / 6, 1 / 3, 1 / 2], abs=0.02)
    large = R.draws(spark, 4000, lambda *k: R.poisson(700.0, *k)).agg(F.avg("x"), F.var_pop("x")).head()
    assert list(large) == pytest.approx([700, 700], rel=0.08)
    walk = R.random_walks(spark, 3, 50, 4.0, 1).collect()
    assert len(walk) == 150 and len({r.walk for r in walk}) == 3
    near = spark.range(100).select(R.jittered(F.lit(5.0), 0.5, F.col("id")).alias("x")).agg(F.min("x"), F.max("x")).head()
    assert 5 <= near[0] < near[1] <= 5.5
    chain = R.gibbs([lambda r, x: r.normal(0.5 * x[1], math.sqrt(0.75)), lambda r, x: r.normal(0.5 * x[0], math.sqrt(0.75))], [0, 0], 6000)
    assert np.cov(chain.T) == pytest.approx(np.array([[1, 0.5], [0.5, 1]]), abs=0.1)


def test_intervals():
    assert interval.credible("normal", 0.95, 0.0, 4.0) == pytest.approx((-3.919927969, 3.919927969))
    assert interval.credible("beta", 0.95, 2.0, 3.0) == pytest.approx((0.06758599, 0.80587955), abs=1e-7)
    for f, p in (("gamma", (2.5, 1.5)), ("beta", (0.5, 4.0)), ("gamma", (30.0, 0.1))):
        for q in (0.01, 0.3, 0.99):
            assert interval.cdf(f, interval.quantile(f, q, *p), *p) == pytest.approx(q, abs=1e-9)
    assert interval.cdf("gamma", 3.0, 1.0, 2.0) == pytest.approx(1 - math.exp(-1.5)) and interval.cdf("beta", 0.3, 1.0, 2.0) == pytest.approx(1 - 0.7**2)
    assert interval.gaps([(2, 4), (4, 5), (8, 9)], 0, 10) == [(0, 2), (5, 8), (9, 10)] and interval.gaps([], 0, 3) == [(0, 3)]


DOCUMENTS = [
    {"bernoulli": 1.0}, {"normal": {"mu": 0.0, "sigma": 1.0}}, {"bernoulli": {"n": 4, "prop": 0.5, "obs": [0.0, 1.0, 1.0, 1.0]}}, {"bernoulli": {"prop": {"alpha": 1.0, "beta": 1.0}, "n": 10}},
    {"poisson": {"gamma": {"alpha": 1.0, "beta": 1.0}}}, {"multinormal": {"mu": [1.0, 2.0], "sigma": [[1.0, 0.0], [0.0, 1.0]], "scale": [[1.0, 2.0], [3.0, 4.0]]}},
    {"bernoulli": {"multinormal": {"mu": [1.0], "sigma": [[1.0]], "scale": [[1.0]]}}}, {"multinormal": {"mu": {"multinormal": {"mu": [1.0], "sigma": [[1.0]]}}, "sigma": [[1.0]], "scale": [[1.0]]}},
    {"multinormal": {"mu": [1.0], "sigma": [[1.0]], "scale": {"pre": {"categorical": [0.2, 0.8]}, "pos": [[1.0]]}}},
]


def test_documents(spark, tmp_path):
    for k, tree in enumerate(DOCUMENTS):
        assert Document.of(tree).tree() == tree
        write_document(spark, str(tmp_path / f"{k}"), Document.of(tree))
        assert read_document(spark, str(tmp_path / f"{k}")).tree() == tree
    assert [Document.of(DOCUMENTS[k]).depth() for k in (0, 3, 4, 7)] == [1, 2, 2, 2]
    assert Document.of(DOCUMENTS[2]).log_prob() == pytest.approx(4 * math.log(0.5))
    assert len(Document.of(DOCUMENTS[4]).sample(5)) == 5
    with pytest.raises(ValueError):
        Document.of({"cauchy": 1.0})


def test_command_line(spark, tmp_path):
    data, prior, post, out = (tmp_path / n for n in ("d.csv", "prior.json", "post.json", "s.csv"))
    data.write_text("y,x\n1,1\n0,1.5\n1,2\n0,2.5\n1,3\n")
    for tree, want in ((DOCUMENTS[3], {"bernoulli": {"prop": {"alpha": 4.0, "beta": 3.0}, "n": 5}}), (DOCUMENTS[4], {"poisson": {"gamma": {"alpha": 4.0, "beta": 6.0}, "n": 5}})):
        prior.write_text(json.dumps(tree))
        main(["fit", "-m", str(prior), "-d", str(data), "-o", str(post), "-c", "y"])
        assert json.loads(post.read_text()) == want
    main(["summary", "-m", str(post), "-o", str(out)])
    head, row = out.read_text().splitlines()
    assert head == "parameter,mean,variance,low,high" and row.split(",")[0] == "rate" and float(row.split(",")[1]) == pytest.approx(4 / 6)
    prior.write_text(json.dumps(DOCUMENTS[6]))
    main(["fit", "-m", str(prior), "-d", str(data), "-o", str(post)])
    assert json.loads(post.read_text())["bernoulli"]["multinormal"]["mu"] == pytest.approx([0.405465108, 0], abs=1e-6)
    prior.write_text(json.dumps(DOCUMENTS[5]))
    main(["fit", "-m", str(prior), "-d", str(data), "-o", str(post), "-c", "x,y"])
    main(["summary", "-m", str(post), "-o", str(out)])
    assert len(out.read_text().splitlines()) == 3


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT norm(1, 2) AS a, norm_of(array(1D, 2D, 4D, NULL)) AS b, condition(norm(1, 2), norm(3, 4)) AS c, condition_data(array(5D), norm(3, 4)) AS d, odds(0.2D) AS e, logit(1D) AS f, norm_log_prob(3, 1, 10) AS g").head()
    assert tuple(r.a) == (None, 1, 1.0, 2.0) == tuple(r.c) and r.b.n == 4 and (r.b.loc, r.b.scale) == pytest.approx((7 / 3, 7 / 3))
    assert tuple(r.d) == ([5.0], 2, 3.0, 4.0) and r.e == pytest.approx(0.25) and r.f == math.inf and r.g == pytest.approx(-2.270231079701696)
    doc = json.dumps(DOCUMENTS[2])
    p, s = spark.createDataFrame([(doc,)], "doc string").selectExpr("log_prob(doc)", "sample_from(doc)").head()
    assert p == pytest.approx(4 * math.log(0.5)) and len(json.loads(s)["bernoulli"]["obs"]) == 4


def test_models_by_condition(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(k, float(v), float(2 * v + 1 + e), int(v + e > 0)) for k, (v, e) in enumerate(zip(x, rng.normal(size=300) / 3, strict=True))], "id long, x double, y double, z int")
    model = E.Likelihood("y") | "x"
    assert model.estimate(df).beta == pytest.approx([1, 2], abs=0.1)
    assert model.given([0.0, 0.0], [[1e9, 0], [0, 1e9]], 1.0).estimate(df).beta == pytest.approx([0, 0], abs=1e-4)
    folds = E.cross_validate(df, E.Likelihood("z", "binomial").condition("x"), "id", 3).collect()
    assert sum(r.n for r in folds) == 300 and all(r.auc > 0.9 for r in folds)
    cov = np.array([[2, 0.5, 0.1], [0.5, 1, 0.2], [0.1, 0.2, 3]])
    names, mean, back = E.joint(E.factored(["a", "b", "c"], np.array([1.0, 2, 3]), cov))
    assert names == ["a", "b", "c"] and mean == pytest.approx([1, 2, 3]) and back == pytest.approx(cov)


def test_linkage_in_rounds_and_components(spark):
    x = np.random.default_rng(4).normal(size=(50, 3))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, point array<double>")
    rows = lambda d: sorted(map(tuple, d.collect()))
    for how in ("single", "complete"):
        assert rows(C.agglomerate(df, how, 6)) == rows(C.agglomerate(df, how, 6, most=5))
    links = C.within(df, 1.0).select(F.col("i").alias("a"), F.col("j").alias("b"))
    assert rows(C.components(links)) == rows(C.components(links, 0))
    d = C.ordered_distances(df).collect()
    assert len(d) == 50 * 49 // 2 and [r.dist for r in d] == sorted(r.dist for r in d)
    label = df.select("id", (F.col("id") % 3).alias("cluster"))
    got = {(r.a, r.b): r.dist for r in C.linkage(C.distance_matrix(df), label, "complete").collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert got == {(a, b): pytest.approx(far[a::3, b::3].max()) for a in range(3) for b in range(a + 1, 3)}
    shown = C.described(df.join(label, "id"), 3).collect()
    assert {r.cluster: r.members for r in shown} == {k: list(range(k, 50, 3)) for k in range(3)}


def test_bases_and_surface(spark):
    x = np.random.default_rng(5).normal(size=13)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "g string, t int, v double")
    c = np.fft.rfft(x)
    assert [complex(r.re, r.im) for r in basis.spectrum(df, "g", "t", "v").orderBy("k").collect()] == pytest.approx(list(c))
    w = [r.coefficient for r in basis.wavelets(df, "g", "t", "v").orderBy("k").collect()]
    assert basis.unhaar(np.array(w))[:13] == pytest.approx(x) and sum(v * v for v in w) == pytest.approx((x**2).sum())
    gx, gy = map(np.ravel, np.meshgrid(range(4), range(4)))
    assert interpolate.PolySurface(3, gx, gy, gx + 2 * gy)([1.5], [2.25])[0] == pytest.approx(6.0, abs=1e-6)


def test_bounded_rank_sets(spark):
    df = spark.createDataFrame([(k % 2, k, float(k * 7 % 31)) for k in range(60)], "g int, t int, v double")
    for r in O.rank_sets(df, "g", "t", "v", 5).collect():
        s = O.RankSet(5)
        for k in range(r.g, 60, 2):
            s.add(float(k * 7 % 31))
        assert r["values"] == s.values == sorted(set(s.values)) and len(s.values) == 5
    s = O.RankSet(2)
    for v in (1.0, 1.0, 5.0, 4.0, 9.0):
        s.add(v)
    assert s.values == [1.0, 9.0] and s.quantile(0.5) == 9.0 and s.quantile(1.0) is None


def test_streams_equal_their_batch_twins(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("x", (F.col("event_id") % 7 / 7)).withColumn("one", F.lit(1.0))
    folder = str(tmp_path / "in")
    events.coalesce(1).orderBy("event_id").write.parquet(folder)
    stream = lambda: spark.readStream.schema(events.schema).parquet(folder)
    got = O.drained(O.online_median(stream(), "user_id", "event_id", "value", 5), "medians", "append", str(tmp_path / "m"))
    want = prefix.rolling_median(events, ["event_id"], "value", 5, ["user_id"]).select("user_id", "event_id", "rolling_median")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = O.drained(O.online_filter(stream(), "user_id", "event_id", "value", ["one", "x"], 0.05), "filters", "update", str(tmp_path / "f"))
    want = M.adaptive(events, "user_id", "event_id", "value", ["one", "x"], lambda: M.LMS(2, 0.05))
    rows = lambda d: sorted((r.user_id, r.n, [round(v, 9) for v in r.b]) for r in d.collect())
    assert rows(got) == rows(want)
    got = O.drained(O.running_histogram(stream(), "value", 0.0, 10.0, 12, ["event_type"]), "bins", "complete", str(tmp_path / "h"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, O.running_histogram(events, "value", 0.0, 10.0, 12, ["event_type"]).collect()))
    got = O.drained(O.running_beta(stream().withColumn("y", (F.col("value") > 50).cast("int")), "y", 1.0, 1.0, ["event_type"]), "betas", "complete", str(tmp_path / "b"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, O.running_beta(events.withColumn("y", (F.col("value") > 50).cast("int")), "y", 1.0, 1.0, ["event_type"]).collect()))
