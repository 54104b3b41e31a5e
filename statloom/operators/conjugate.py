"""Conjugate updates, maximum likelihood and joint normals: one aggregation of sufficient statistics for each fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beta_bernoulli(df: DataFrame, y: str, a: float, b: float, by: list[str] | None = None) -> DataFrame:
    s = df.groupBy(*(by or [])).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    return s.select(*(by or []), (F.lit(a) + F.col("s")).alias("alpha"), (F.lit(b) + F.col("n") - F.col("s")).alias("beta"))


def gamma_poisson(df: DataFrame, y: str, a: float, b: float, by: list[str] | None = None) -> DataFrame:
    s = df.groupBy(*(by or [])).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    return s.select(*(by or []), (F.lit(a) + F.col("s")).alias("alpha"), (F.lit(b) + F.col("n")).alias("beta"))


def normal_normal(df: DataFrame, y: str, mean: float, precision: float, data_precision: float, by: list[str] | None = None) -> DataFrame:
    """Posterior of a normal mean at known precision of the data."""
    s = df.groupBy(*(by or [])).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    v = 1 / (F.lit(precision) + F.col("n") * data_precision)
    return s.select(*(by or []), (v * (mean * precision + F.col("s") * data_precision)).alias("mean"), v.alias("variance"))


def normal_mle(df: DataFrame, y: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(y).alias("mean"), F.var_pop(y).alias("variance"))


def joint_normal(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector, population covariance and n of the rows without a null, by one aggregation."""
    some = df.dropna(subset=columns)
    k = len(columns)
    cells = [F.avg(c) for c in columns] + [F.covar_pop(columns[i], columns[j]) for i in range(k) for j in range(i, k)] + [F.count(F.lit(1))]
    got = list(some.agg(*[c.alias(f"s{i}") for i, c in enumerate(cells)]).head())
    cov = np.zeros((k, k))
    at = k
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = got[at]
            at += 1
    return np.array(got[:k], float), cov, got[-1]


def multinormal_mean(mean0: np.ndarray, precision0: np.ndarray, data_mean: np.ndarray, data_precision: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and covariance of a mean vector at known precision of the data."""
    cov = np.linalg.inv(precision0 + n * data_precision)
    return cov @ (precision0 @ mean0 + n * data_precision @ data_mean), cov


def marginal(mean: np.ndarray, cov: np.ndarray, keep: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return mean[keep], cov[np.ix_(keep, keep)]


def conditional(mean: np.ndarray, cov: np.ndarray, fixed: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """The others' mean and covariance, given values of some variables."""
    f = list(fixed)
    o = [i for i in range(len(mean)) if i not in fixed]
    gain = cov[np.ix_(o, f)] @ np.linalg.inv(cov[np.ix_(f, f)])
    return mean[o] + gain @ (np.array([fixed[i] for i in f]) - mean[f]), cov[np.ix_(o, o)] - gain @ cov[np.ix_(f, o)]


def correlation(cov: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(cov))
    return cov / np.outer(d, d)


def partial_correlation(cov: np.ndarray, a: int, b: int) -> float:
    p = np.linalg.inv(cov)
    return float(-p[a, b] / np.sqrt(p[a, a] * p[b, b]))


def homoscedastic(n: int, variance: float) -> np.ndarray:
    return np.eye(n) * variance


def is_positive_definite(m: np.ndarray) -> bool:
    try:
        np.linalg.cholesky(m)
    except np.linalg.LinAlgError:
        return False
    return True


def nearest_positive_definite(m: np.ndarray) -> np.ndarray:
    """The nearest symmetric positive semi-definite matrix (Higham 1988), lifted until Cholesky succeeds."""
    sym = (m + m.T) / 2
    values, vectors = np.linalg.eigh(sym)
    out = vectors @ np.diag(np.maximum(values, 0)) @ vectors.T
    lift = np.spacing(np.linalg.norm(out)) or 1e-300
    while not is_positive_definite(out):
        out = out + np.eye(len(out)) * lift
        lift *= 10
    return (out + out.T) / 2
