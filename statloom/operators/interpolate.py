"""Interpolation: fits over a few thousand nodes on the driver, evaluated as expressions or by joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most nodes of a dense solve.
MOST_NODES = 3000


def _rbf(r: np.ndarray, order: int = 2) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        out = r**order * np.log(r) if order % 2 == 0 else r**order
    return np.where(r > 0, out, 0.0)


class ThinPlate:
    """A smoothing surface through (x, y, z): r^2 ln r with the L1 distance, regularised by lam times the squared mean distance."""

    def __init__(self, x, y, z, lam: float = 0.0):
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        n = len(self.x)
        if n > MOST_NODES:
            raise ValueError(f"{n} nodes; at most {MOST_NODES}")
        r = np.abs(self.x[:, None] - self.x) + np.abs(self.y[:, None] - self.y)
        alpha = r.sum() / max(n * n, 1)
        p = np.stack((np.ones(n), self.x, self.y), 1)
        a = np.block([[_rbf(r) + lam * alpha**2 * np.eye(n), p], [p.T, np.zeros((3, 3))]])
        self.w = np.linalg.lstsq(a, np.concatenate((np.asarray(z, float), np.zeros(3))), rcond=None)[0]

    def __call__(self, x, y) -> np.ndarray:
        x, y = np.atleast_1d(np.asarray(x, float)), np.atleast_1d(np.asarray(y, float))
        r = np.abs(x[:, None] - self.x) + np.abs(y[:, None] - self.y)
        return _rbf(r) @ self.w[:-3] + self.w[-3] + self.w[-2] * x + self.w[-1] * y

    def column(self, x: Column, y: Column) -> Column:
        """The surface as an expression: one term for each node, in one array fold."""
        nodes = F.array(*[F.array(F.lit(float(a)), F.lit(float(b)), F.lit(float(w))) for a, b, w in zip(self.x, self.y, self.w, strict=False)])

        def term(acc: Column, node: Column) -> Column:
            r = F.abs(x - F.get(node, F.lit(0))) + F.abs(y - F.get(node, F.lit(1)))
            return acc + F.when(r > 0, r * r * F.ln(r) * F.get(node, F.lit(2))).otherwise(0.0)

        c, bx, by = (float(v) for v in self.w[-3:])
        return F.aggregate(nodes, F.lit(0.0), term) + c + bx * x + by * y


class PolySpline:
    """A polyharmonic curve of order k through (x, y), solved by the pseudo-inverse; s is added to the diagonal."""

    def __init__(self, k: int, x, y, s: float = 0.0):
        self.k, self.x = k, np.asarray(x, float)
        n = len(self.x)
        p = np.stack((np.ones(n), self.x), 1)
        a = np.block([[_rbf(np.abs(self.x[:, None] - self.x), k) + s * np.eye(n), p], [p.T, np.zeros((2, 2))]])
        self.w = np.linalg.pinv(a) @ np.concatenate((np.asarray(y, float), np.zeros(2)))

    def __call__(self, x) -> np.ndarray:
        x = np.atleast_1d(np.asarray(x, float))
        return _rbf(np.abs(x[:, None] - self.x), self.k) @ self.w[:-2] + self.w[-2] + self.w[-1] * x


class PolySurface:
    """A polyharmonic surface of order k through (x, y, z) with Euclidean distances, solved by the pseudo-inverse; s is added to the diagonal."""

    def __init__(self, k: int, x, y, z, s: float = 0.0):
        self.k, self.p = k, np.stack((np.asarray(x, float), np.asarray(y, float)), 1)
        n = len(self.p)
        if n > MOST_NODES:
            raise ValueError(f"{n} nodes; at most {MOST_NODES}")
        one = np.concatenate((np.ones((n, 1)), self.p), 1)
        a = np.block([[_rbf(self._far(self.p), k) + s * np.eye(n), one], [one.T, np.zeros((3, 3))]])
        self.w = np.linalg.pinv(a) @ np.concatenate((np.asarray(z, float), np.zeros(3)))

    def _far(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(((q[:, None] - self.p[None]) ** 2).sum(-1))

    def __call__(self, x, y) -> np.ndarray:
        q = np.stack((np.atleast_1d(np.asarray(x, float)), np.atleast_1d(np.asarray(y, float))), 1)
        return _rbf(self._far(q), self.k) @ self.w[:-3] + self.w[-3] + q @ self.w[-2:]


def bilinear(x: Column, y: Column, xs: list[float], ys: list[float], z: list[list[float]]) -> Column:
    """Between the four nodes around (x, y) of a grid z[i][j] at (xs[i], ys[j]); null outside."""
    gx, gy = F.array(*[F.lit(float(v)) for v in xs]), F.array(*[F.lit(float(v)) for v in ys])
    flat = F.array(*[F.lit(float(v)) for row in z for v in row])
    i = F.least(F.size(F.filter(gx, lambda v: v <= x)) - 1, F.lit(len(xs) - 2))
    j = F.least(F.size(F.filter(gy, lambda v: v <= y)) - 1, F.lit(len(ys) - 2))
    u = (x - F.get(gx, i)) / (F.get(gx, i + 1) - F.get(gx, i))
    v = (y - F.get(gy, j)) / (F.get(gy, j + 1) - F.get(gy, j))
    at = lambda a, b: F.get(flat, (i + a) * len(ys) + j + b)
    inside = (x >= xs[0]) & (x <= xs[-1]) & (y >= ys[0]) & (y <= ys[-1])
    return F.when(inside, at(0, 0) * (1 - u) * (1 - v) + at(1, 0) * u * (1 - v) + at(0, 1) * (1 - u) * v + at(1, 1) * u * v)


def fill_gaps(df: DataFrame, order: str, value: str, by: list[str], how: str = "linear") -> DataFrame:
    """df with filled: nulls between known values by the nearest of them or on the line between them."""
    w = Window.partitionBy(*by).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("double").alias("t"), F.col(value).cast("double").alias("v")))
    out = df.withColumn("_a", F.last(known, ignorenulls=True).over(before)).withColumn("_b", F.first(known, ignorenulls=True).over(after))
    t = F.col(order).cast("double")
    near = F.when(F.col("_b").isNull() | (t - F.col("_a.t") <= F.col("_b.t") - t), F.col("_a.v")).otherwise(F.col("_b.v"))
    line = F.when(F.col("_a.t") == F.col("_b.t"), F.col("_a.v")).otherwise(F.col("_a.v") + (t - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t")) * (F.col("_b.v") - F.col("_a.v")))
    return out.withColumn("filled", near if how == "nearest" else line).drop("_a", "_b")


def inverse_distance(x: list[Column], nodes: list[tuple[list[float], float]], power: float = 2.0) -> Column:
    """The mean of few nodes' values weighted by distance to a power; at a node its value."""
    d = [F.sqrt(reduce(lambda a, b: a + b, [(c - float(p)) * (c - float(p)) for c, p in zip(x, at, strict=True)])) for at, _ in nodes]
    exact = F.coalesce(*[F.when(r == 0, F.lit(float(v))) for r, (_, v) in zip(d, nodes, strict=True)])
    w = [F.pow(r, F.lit(-power)) for r in d]
    return F.coalesce(exact, reduce(lambda a, b: a + b, [a * float(v) for a, (_, v) in zip(w, nodes, strict=True)]) / reduce(lambda a, b: a + b, w))


def polynomial(x: Column, xs: list[float], ys: list[float]) -> Column:
    """The polynomial through few points, by Newton's divided differences."""
    c = list(map(float, ys))
    for k in range(1, len(c)):
        for i in range(len(c) - 1, k - 1, -1):
            c[i] = (c[i] - c[i - 1]) / (xs[i] - xs[i - k])
    out = F.lit(c[-1])
    for k in range(len(c) - 2, -1, -1):
        out = out * (x - float(xs[k])) + c[k]
    return out
