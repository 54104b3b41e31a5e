"""Linear and generalized linear models: only k x k moments reach the driver, whatever the number of rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.shared import need, written


@dataclass
class Settings:
    """add_intercept: a first column of ones. fixed: coefficients held at a value, by column name. tol, max_iter: for IRLS."""

    add_intercept: bool = True
    fixed: dict[str, float] = field(default_factory=dict)
    tol: float = 1e-8
    max_iter: int = 50


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    inverse: np.ndarray
    n: int
    r2: float | None = None
    iterations: int = 1

    def predict(self, df: DataFrame, name: str = "fitted") -> DataFrame:
        return df.withColumn(name, linear_predictor(self.names, self.beta))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, float(b)) for k, b in zip(self.names, self.beta, strict=True)], "term string, beta double")


INTERCEPT = "(intercept)"


def _x(name: str) -> Column:
    return F.lit(1.0) if name == INTERCEPT else F.col(name).cast("double")


def linear_predictor(names: list[str], beta) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(b)) * _x(n) for n, b in zip(names, beta, strict=True)])


def moments(df: DataFrame, y: Column, names: list[str], w: Column | None = None, offset: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, float, float, int]:
    """X'WX, X'Wy, sum w*y*y, sum w*y, sum w and n over the rows without a null, by one aggregation."""
    w = F.lit(1.0) if w is None else w
    xs = [_x(n) for n in names]
    if offset is not None:
        y = y - offset
    rows = df.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in [y, w, *xs]]))
    k = len(xs)
    sums = [F.sum(w * xs[i] * xs[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * x * y) for x in xs] + [F.sum(w * y * y), F.sum(w * y), F.sum(w), F.count(F.lit(1))]
    got = list(rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).head())
    a = np.zeros((k, k))
    at = iter(got)
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = next(at) or 0.0
    b = np.array([next(at) or 0.0 for _ in range(k)])
    return a, b, next(at) or 0.0, next(at) or 0.0, next(at) or 0.0, next(at)


def _solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solution and inverse by way of the matrix with a diagonal of ones, so that the columns' units do not matter."""
    d = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    scaled = a / np.outer(d, d)
    if np.linalg.matrix_rank(scaled, tol=1e-12 * max(len(a), 1), hermitian=True) < len(a):
        raise ValueError("the design matrix is singular")
    inverse = np.linalg.inv(scaled)
    return np.linalg.solve(scaled, b / d) / d, inverse / np.outer(d, d)


def _means(df: DataFrame, columns: list[Column], w: Column | None) -> tuple[list[float], DataFrame]:
    """The columns' (weighted) means, and the rows without a null."""
    rows = df.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in [*columns, *([] if w is None else [w])]]))
    mean = [F.avg(c) if w is None else F.sum(w * c) / F.sum(w) for c in columns]
    return list(rows.agg(*[m.alias(f"m{i}") for i, m in enumerate(mean)]).head()), rows


def _centered(df: DataFrame, y: Column, xs: list[Column], w: Column | None) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float, float, int]:
    """Centred X'WX, X'Wy and y'Wy, the means of X and y, the sum of the weights and n.

    Without weights Spark's covariances give them in one pass; with weights the means come first, in a pass of their own.
    """
    k, own = len(xs), [*xs, y]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    if w is None:
        rows = df.where(reduce(lambda a, b: a & b, [c.isNotNull() for c in own]))
        got = list(rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(own)], *[F.covar_pop(own[i], own[j]).alias(f"c{i}_{j}") for i, j in pairs], F.count(F.lit(1)).alias("n")).head())
        mean, n = got[: k + 1], got[-1]
        cells, total = [(x or 0.0) * n for x in got[k + 1 : -1]], float(n)
    else:
        mean, rows = _means(df, own, w)
        d = [c - F.lit(m) for c, m in zip(own, mean, strict=True)]
        got = list(rows.agg(*[F.sum(w * d[i] * d[j]).alias(f"c{i}_{j}") for i, j in pairs], F.sum(w).alias("w"), F.count(F.lit(1)).alias("n")).head())
        cells, total, n = [x or 0.0 for x in got[:-2]], got[-2] or 0.0, got[-1]
    full = np.zeros((k + 1, k + 1))
    for (i, j), x in zip(pairs, cells, strict=True):
        full[i, j] = full[j, i] = x
    mean = np.array([m or 0.0 for m in mean])
    return full[:k, :k], full[:k, k], full[k, k], mean[:k], mean[k], total, n


def ols(df: DataFrame, y: str, xs: list[str], settings: Settings | None = None, weight: Column | None = None) -> Fit:
    """Least squares, weighted by `weight` (a precision; 1 / variance for variances). R2 is about the weighted mean of y.

    With an intercept all columns are centred in the aggregation, so that columns far from 0 (seconds since 1970) lose no digits.
    """
    s = settings or Settings()
    need(df, y, *xs)
    names = [x for x in xs if x not in s.fixed]
    offset = linear_predictor(list(s.fixed), list(s.fixed.values())) if s.fixed else None
    target = F.col(y).cast("double") if offset is None else F.col(y).cast("double") - offset
    tiny = 2.220446049250313e-16
    if not s.add_intercept:
        a, b, yy, ysum, total, n = moments(df, target, names, weight)
        if n == 0:
            raise ValueError("no rows to fit")
        beta, inverse = _solve(a, b)
        residual = yy - 2 * beta @ b + beta @ a @ beta
        return Fit(names, beta, inverse, n, 1 - residual / (yy - ysum**2 / total + tiny))
    a, b, yy, mean, ymean, total, n = _centered(df, target, [_x(x) for x in names], weight)
    if n == 0:
        raise ValueError("no rows to fit")
    beta, inner = _solve(a, b)
    residual = yy - 2 * beta @ b + beta @ a @ beta
    inverse = np.block([[np.array([[1 / total + mean @ inner @ mean]]), -(inner @ mean)[None, :]], [-(inner @ mean)[:, None], inner]])
    return Fit([INTERCEPT, *names], np.concatenate(([ymean - beta @ mean], beta)), inverse, n, 1 - residual / (yy + tiny))


def ridge(df: DataFrame, y: str, xs: list[str], prior_mean: list[float], prior_precision: list[list[float]], noise_variance: float, settings: Settings | None = None) -> Fit:
    """Least squares with a normal prior on the coefficients; prior precision lambda * I / noise is ridge regression."""
    s = settings or Settings()
    names = ([INTERCEPT] if s.add_intercept else []) + list(xs)
    a, b, *_, n = moments(df, F.col(y).cast("double"), names)
    p = np.asarray(prior_precision, float)
    beta, inverse = _solve(a / noise_variance + p, b / noise_variance + p @ np.asarray(prior_mean, float))
    return Fit(names, beta, inverse, n)


FAMILIES = {
    "normal": (lambda e: e, lambda m: F.lit(1.0)),
    "binomial": (lambda e: 1 / (1 + F.exp(-e)), lambda m: m * (1 - m)),
    "poisson": (F.exp, lambda m: m),
}


def irls(df: DataFrame, y: str, xs: list[str], family: str, settings: Settings | None = None) -> Fit:
    """Maximum likelihood under the canonical link by Fisher scoring: one aggregation for each step.

    y and the regressors are written once, centred (with an intercept) and scaled; every step reads that narrow table, and the
    coefficients come back to the columns' own units at the end.
    """
    s = settings or Settings()
    need(df, y, *xs)
    names = ([INTERCEPT] if s.add_intercept else []) + list(xs)
    inverse_link, variance = FAMILIES[family]
    columns = [F.col(x).cast("double") for x in xs]
    some = df.where(reduce(lambda a, b: a & b, [F.col(y).isNotNull(), *[c.isNotNull() for c in columns]]))
    stats = list(some.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).head())
    if not stats[0]:
        raise ValueError("no rows to fit")
    mean = np.array(stats[1::2] if s.add_intercept else np.zeros(len(xs)), float)
    scale = np.array([v or abs(m) or 1.0 for m, v in zip(stats[1::2], stats[2::2], strict=True)], float)
    own = written(some.select(F.col(y).cast("double").alias("_y"), *[((c - F.lit(m)) / F.lit(v)).alias(f"_x{i}") for i, (c, m, v) in enumerate(zip(columns, mean.tolist(), scale.tolist(), strict=True))]))
    inner = ([INTERCEPT] if s.add_intercept else []) + [f"_x{i}" for i in range(len(xs))]
    back = np.diag(np.concatenate(([1.0] if s.add_intercept else [], 1 / scale)))
    if s.add_intercept:
        back[0, 1:] = -mean / scale
    beta = np.zeros(len(names))
    for step in range(1, s.max_iter + 1):
        eta = linear_predictor(inner, beta)
        mu = inverse_link(eta)
        v = F.greatest(variance(mu), F.lit(1e-12))
        a, b, *_, n = moments(own, eta + (F.col("_y") - mu) / v, inner, v)
        new, inverse = _solve(a, b)
        if np.linalg.norm(new - beta) < s.tol:
            return Fit(names, back @ new, back @ inverse @ back.T, n, iterations=step)
        beta = new
    raise ValueError(f"no convergence in {s.max_iter} steps")


def least_absolute(df: DataFrame, y: str, xs: list[str], settings: Settings | None = None) -> Fit:
    """Least absolute errors by reweighting with 1 / max(|error|, 1e-12)."""
    s = settings or Settings(tol=1e-6, max_iter=200)
    fit = ols(df, y, xs, s)
    for step in range(2, s.max_iter + 1):
        e = F.abs(F.col(y) - linear_predictor(fit.names, fit.beta))
        new = ols(df, y, xs, s, 1 / F.greatest(e, F.lit(1e-12)))
        done = np.linalg.norm(new.beta - fit.beta) < s.tol
        new.iterations, fit = step, new
        if done:
            break
    return fit


def lagged(df: DataFrame, order: list[str], value: str, k: int, by: list[str]) -> DataFrame:
    """df with lag_1 .. lag_k, for prediction from the k samples before; rows without all of them go."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumns({f"lag_{i}": F.lag(value, i).over(w) for i in range(1, k + 1)})
    return out.where(F.col(f"lag_{k}").isNotNull())


def wiener(df: DataFrame, order: list[str], value: str, k: int, by: list[str]) -> Fit:
    return ols(lagged(df, order, value, k, by), value, [f"lag_{i}" for i in range(1, k + 1)])


class LMS:
    """b += rate * (y - b.x) * x; b starts at 1e-6."""

    def __init__(self, k: int, rate: float):
        self.b, self.rate = np.full(k, 1e-6), rate

    def step(self, x: np.ndarray, y: float) -> float:
        e = y - float(self.b @ x)
        self.b = self.b + self.rate * e * x
        return e


class RLS:
    """Recursive least squares; P starts at I / lam, `rate` is the forgetting factor."""

    def __init__(self, k: int, lam: float, rate: float):
        self.b, self.p, self.rate = np.zeros(k), np.eye(k) / lam, rate

    def step(self, x: np.ndarray, y: float) -> float:
        e = y - float(self.b @ x)
        g = self.p @ x / (self.rate + x @ self.p @ x)
        self.b = self.b + g * e
        self.p = (self.p - np.outer(g, x @ self.p)) / self.rate
        return e


def adaptive(df: DataFrame, by: str, order: str, y: str, xs: list[str], start) -> DataFrame:
    """(by, n, b): the filter's coefficients after all of a key's rows in order. start() makes a filter; a key is the unit of work.

    Rows are sorted by Spark and stream through; a task holds one batch and the filter.
    """
    placed = df.select(by, order, y, *xs).repartition(by).sortWithinPartitions(by, order)
    kind = df.schema[by].dataType.simpleString()

    def fold(batches):
        key, filter_, n = None, None, 0
        for pdf in batches:
            for k, t, *x in pdf[[by, y, *xs]].itertuples(index=False):
                if filter_ is None or not (k == key or pd.isna(k) and pd.isna(key)):
                    if filter_ is not None:
                        yield pd.DataFrame({by: [key], "n": [n], "b": [filter_.b.tolist()]})
                    key, filter_, n = k, start(), 0
                filter_.step(np.array(x, float), float(t))
                n += 1
        if filter_ is not None:
            yield pd.DataFrame({by: [key], "n": [n], "b": [filter_.b.tolist()]})

    return placed.mapInPandas(fold, f"`{by}` {kind}, n long, b array<double>")
