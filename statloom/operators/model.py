"""Models by condition: an outcome's family given its predictors, fitted by the estimator that fits the family."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators import linear
from statloom.operators.graph import Graph, auc
from statloom.operators.prefix import prefix


class Code(IntEnum):
    """Codes of distributions (fixed values)."""

    NORMAL = 0
    BINOMIAL = 1
    POISSON = 2
    GAMMA = 3


class Estimator(Protocol):
    """Whatever makes a fit of rows under settings."""

    def estimate(self, df: DataFrame, settings: linear.Settings | None = None) -> linear.Fit: ...


@dataclass
class Likelihood:
    """An outcome and its family: normal, binomial or poisson."""

    outcome: str
    family: str = "normal"
    predictors: list[str] = field(default_factory=list)
    weight: Column | None = None
    prior: tuple[list[float], list[list[float]], float] | None = None

    def condition(self, *predictors: str) -> Likelihood:
        return Likelihood(self.outcome, self.family, [*self.predictors, *predictors], self.weight, self.prior)

    def __or__(self, predictors: str | list[str] | tuple[str, ...]) -> Likelihood:
        return self.condition(*([predictors] if isinstance(predictors, str) else predictors))

    def weighted(self, weight: Column) -> Likelihood:
        """By precisions, 1 / variance of each row for rows of unequal variance."""
        return Likelihood(self.outcome, self.family, self.predictors, weight, self.prior)

    def given(self, mean: list[float], precision: list[list[float]], noise_variance: float) -> Likelihood:
        """A normal prior on the coefficients."""
        return Likelihood(self.outcome, self.family, self.predictors, self.weight, (mean, precision, noise_variance))

    def estimate(self, df: DataFrame, settings: linear.Settings | None = None) -> linear.Fit:
        if self.family != "normal":
            return linear.irls(df, self.outcome, self.predictors, self.family, settings)
        if self.prior:
            return linear.ridge(df, self.outcome, self.predictors, *self.prior, settings)
        return linear.ols(df, self.outcome, self.predictors, settings, self.weight)


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tpr, fpr): shares of ones and of zeros with a score of threshold or more, at each distinct score."""
    counts = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("one"), F.count_if(F.col(label) == 0).alias("zero"))
    run = prefix(counts, [F.col("threshold").desc()], {"ones": F.col("one"), "zeros": F.col("zero")})
    total = counts.agg(F.sum("one").alias("_one"), F.sum("zero").alias("_zero"))
    return run.crossJoin(F.broadcast(total)).select("threshold", (F.col("ones") / F.col("_one")).alias("tpr"), (F.col("zeros") / F.col("_zero")).alias("fpr"))  # one row


def folds(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(17), key), F.lit(k)).cast("int"))


def cross_validate(df: DataFrame, model: Likelihood, key: str, k: int = 5) -> DataFrame:
    """(fold, auc, n) of a model of an outcome of 0 and 1: each fold scored by the fit of the others."""
    dealt, out = folds(df, key, k), None
    for i in range(k):
        held = model.estimate(dealt.where(F.col("fold") != i)).predict(dealt.where(F.col("fold") == i), "_score")
        one = auc(held, "_score", model.outcome).crossJoin(held.agg(F.count(F.lit(1)).alias("n"))).select(F.lit(i).alias("fold"), "auc", "n")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def factored(names: list[str], mean: np.ndarray, covariance: np.ndarray) -> Graph:
    """A joint normal as a graph: each variable given those before it."""
    g, m, s = Graph(), np.asarray(mean, float), np.asarray(covariance, float)
    for i, name in enumerate(names):
        w = np.linalg.solve(s[:i, :i], s[:i, i]) if i else np.zeros(0)
        g.add(name, "normal", loc=float(m[i] - w @ m[:i]), scale=float(s[i, i] - w @ s[:i, i]))
        if i:
            g.condition(name, *names[:i], weights=w.tolist())
    return g


def joint(graph: Graph) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, mean, covariance) of a graph of normals, in its order."""
    names = graph.order()
    if any(graph.nodes[n][0] != "normal" for n in names):
        raise ValueError("only graphs of normals are joint normals")
    at = {n: k for k, n in enumerate(names)}
    b = np.zeros((len(names), len(names)))
    for p, c, w in graph.edges:
        b[at[c], at[p]] = 1.0 if w is None else w
    loc = np.array([graph.nodes[n][1].get("loc", 0.0) for n in names])
    scale = np.diag([graph.nodes[n][1].get("scale", 1.0) for n in names])
    a = np.linalg.inv(np.eye(len(names)) - b)
    return names, a @ loc, a @ scale @ a.T
