"""Every registered statistics query against its SQL twin; the few without one against brute force on the same tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import histogram as H
from statloom.operators import partition as P
from statloom.plans.registry import ORACLE, QUERIES
from tests.conftest import DATA

BRUTE = {"highest_density_partition", "entropy_partition", "median_mode_partition", "hierarchical"}


def test_every_query_is_held():
    assert set(QUERIES) - set(ORACLE) == BRUTE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(name, same):
    same(QUERIES[name], ORACLE[name])


@pytest.fixture(scope="module")
def bins(spark):
    rows = H.histogram(spark.read.parquet(f"{DATA}/events.parquet"), "value", 32, ["event_type"]).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r.bin):
        found.setdefault(r.event_type, []).append(r.prop)
    return {k: np.array(v) for k, v in found.items()}


def parts(spark, name):
    out = {}
    for r in QUERIES[name](spark, DATA).orderBy("event_type", "part").collect():
        out.setdefault(r.event_type, []).append((r.first, r.mode, r.last))
        assert r.first <= r.mode <= r.last
    return out


def cuts(base, modes, most):
    """All ways to cut base intervals into consecutive groups, by the bits of a number."""
    n = len(base)
    for bits in range(1 << (n - 1)):
        edges = [0, *[k + 1 for k in range(n - 1) if bits >> k & 1], n]
        groups = [base[a:b] for a, b in itertools.pairwise(edges)]
        if modes[0] <= len(groups) <= modes[1] and all(len(g) <= most for g in groups):
            yield [(g[0][0], g[-1][2]) for g in groups]


def test_entropy_partition(spark, bins):
    for key, got in parts(spark, "entropy_partition").items():
        p = bins[key]

        def score(spans, p=p):
            h = lambda q: -(q + P.EPS) * math.log(q + P.EPS)
            return sum(sum(h(q) for q in p[a : b + 1]) / max(p[a : b + 1].sum(), P.EPS) - math.log(max(p[a : b + 1].sum(), P.EPS)) for a, b in spans) / len(spans)

        best = min(map(score, cuts(P.base_intervals(p, 4), (2, 4), 5)))
        assert score([(a, b) for a, _, b in got]) == pytest.approx(best, abs=1e-9)
        assert got[0][0] == 0 and got[-1][2] == len(p) - 1 and all(x[2] + 1 == y[0] for x, y in itertools.pairwise(got))
        assert all(p[m] == p[a : b + 1].max() for a, m, b in got)


def test_median_mode_partition(spark, bins):
    for key, got in parts(spark, "median_mode_partition").items():
        p = bins[key]

        def far(spans, p=p):
            out = []
            for a, b in spans:
                own = p[a : b + 1]
                if own.sum() >= 0.05:
                    median = next(k for k in range(len(own)) if own[: k + 1].sum() >= own.sum() / 2 - 1e-12)
                    out.append(abs(len(own) - 1 - int(np.argmax(own[::-1])) - median))
            return sum(out) / len(out) if out and max(out) <= 12 else math.inf

        best = min(map(far, cuts(P.base_intervals(p, 4), (1, 4), 5)))
        assert far([(a, b) for a, _, b in got]) == pytest.approx(best)


def test_highest_density_partition(spark, bins):
    for key, got in parts(spark, "highest_density_partition").items():
        p = bins[key]
        spans = [(a, b) for a, _, b in got]
        total = sum(p[a : b + 1].sum() for a, b in spans)
        assert total >= 0.6 - 1e-12 and all(x[1] < y[0] for x, y in itertools.pairwise(spans))
        for k, (a, m, b) in enumerate(got):  # no region can lose a bin on both sides and keep its mode inside, its width and the mass
            less = total - p[a] - p[b]
            assert b - a + 1 <= 3 or not (a + 1 < m < b - 1) or less < 0.6
            assert k == 0 or got[k - 1][2] < a


def test_hierarchical(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).orderBy("vec_id").collect()
    x = np.array([r.v for r in rows])
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    clusters = [[k] for k in range(len(x))]
    far = d.copy()
    np.fill_diagonal(far, np.inf)
    while len(clusters) > 8:
        i, j = sorted(np.unravel_index(np.argmin(far), far.shape))
        merged = np.maximum(far[i], far[j])
        merged[i] = np.inf
        far[i], far[:, i] = merged, merged
        far = np.delete(np.delete(far, j, 0), j, 1)
        clusters[i] = clusters[i] + clusters[j]
        del clusters[j]
    want = {rows[k].vec_id: rows[min(c)].vec_id for c in clusters for k in c}
    assert {r.id: r.cluster for r in QUERIES["hierarchical"](spark, DATA).collect()} == want
