"""Draws from distributions as Column expressions: numbers are hashes of a seed, a row's key and a counter, so that a lost task draws the same again."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attempts of a rejection sampler, made at once; each is accepted with probability 0.95 at least.
ATTEMPTS = 48
#: Largest rate of one Poisson draw by inversion; a larger rate is a sum of draws.
STEP_RATE = 256.0


def uniform(*key: Column) -> Column:
    """In (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def normal(*key: Column) -> Column:
    return F.sqrt(-2 * F.ln(uniform(F.lit(1), *key))) * F.cos(2 * math.pi * uniform(F.lit(2), *key))


def gamma(shape: Column | float, scale: Column | float, *key: Column) -> Column:
    """Marsaglia and Tsang's method; a shape below 1 is drawn at shape + 1 and shrunk by a power of a uniform number."""
    a = F.lit(float(shape)) if isinstance(shape, (int, float)) else shape.cast("double")
    low = a < 1
    d = F.when(low, a + 1).otherwise(a) - 1 / 3
    c = 1 / F.sqrt(9 * d)

    def attempt(i: Column) -> Column:
        z = normal(F.lit(3), i, *key)
        v = F.pow(1 + c * z, F.lit(3.0))
        ok = (1 + c * z > 0) & (F.ln(uniform(F.lit(4), i, *key)) < z * z / 2 + d - d * v + d * F.ln(F.when(1 + c * z > 0, v).otherwise(1.0)))
        return F.when(ok, d * v)

    first = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(ATTEMPTS)), attempt), lambda v: v.isNotNull()), F.lit(0))
    return first * F.when(low, F.pow(uniform(F.lit(5), *key), 1 / a)).otherwise(1.0) * scale


def beta(a: Column | float, b: Column | float, *key: Column) -> Column:
    x, y = gamma(a, 1.0, F.lit(6), *key), gamma(b, 1.0, F.lit(7), *key)
    return x / (x + y)


def poisson(rate: Column | float, *key: Column) -> Column:
    """By inversion: how many cumulative probabilities a uniform number exceeds; large rates in parts of STEP_RATE at most."""
    r = F.lit(float(rate)) if isinstance(rate, (int, float)) else rate.cast("double")
    parts = F.greatest(F.ceil(r / STEP_RATE), F.lit(1)).cast("int")
    each = r / parts

    def one(i: Column) -> Column:
        u = uniform(F.lit(8), i, *key)
        start = F.struct(F.exp(-each).alias("p"), F.exp(-each).alias("cum"), F.lit(0).alias("k"))
        most = (each + 12 * F.sqrt(each) + 30).cast("int")
        step = lambda s, j: F.when(s["cum"] < u, F.struct((s["p"] * each / j).alias("p"), (s["cum"] + s["p"] * each / j).alias("cum"), (s["k"] + 1).alias("k"))).otherwise(s)
        return F.aggregate(F.sequence(F.lit(1), most), start, step)["k"]

    return F.aggregate(F.transform(F.sequence(F.lit(1), parts), one), F.lit(0), lambda s, k: s + k)


def binomial(n: int, theta: Column | float, *key: Column) -> Column:
    hit = lambda i: (uniform(F.lit(9), i, *key) < theta).cast("int")
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(int(n))), hit), F.lit(0), lambda s, x: s + x)


def categorical(probabilities: list[float], *key: Column) -> Column:
    cum = np.cumsum(probabilities) / sum(probabilities)
    u = uniform(F.lit(10), *key)
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cum[:-1]]), lambda c: c <= u))


def dirichlet(alpha: list[float], *key: Column) -> Column:
    """Gammas over their sum."""
    g = F.array(*[gamma(float(a), 1.0, F.lit(20 + k), *key) for k, a in enumerate(alpha)])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.get(F.transform(F.array(g), lambda v: F.transform(v, lambda x: x / total(v))), F.lit(0))


def multinormal(mean: list[float], covariance: list[list[float]], *key: Column) -> Column:
    """mean + L z with the Cholesky factor L."""
    low = np.linalg.cholesky(np.asarray(covariance, float))
    z = [normal(F.lit(40 + k), *key) for k in range(len(mean))]
    return F.array(*[F.lit(float(m)) + sum((F.lit(float(low[i, j])) * z[j] for j in range(i + 1)), F.lit(0.0)) for i, m in enumerate(mean)])


def draws(spark: SparkSession, n: int, draw, seed: int = 0, name: str = "x") -> DataFrame:
    """(sample, name): n draws; draw takes key columns, as `lambda *k: gamma(2.0, 1.0, *k)`."""
    return spark.range(n).select(F.col("id").alias("sample"), draw(F.lit(seed), F.col("id")).alias(name))


def jittered(x: Column, amplitude: float, *key: Column) -> Column:
    return x + uniform(F.lit(11), *key) * amplitude


def random_walks(spark: SparkSession, walks: int, steps: int, scale: float, seed: int = 0) -> DataFrame:
    """(walk, step, x): sums of independent normals; a walk is shared by many tasks."""
    from statloom.operators.prefix import prefix

    each = spark.range(walks).select(F.col("id").alias("walk"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    each = each.withColumn("z", normal(F.lit(seed), F.col("walk"), F.col("step")) * math.sqrt(scale))
    return prefix(each, ["step"], {"x": F.col("z")}, ["walk"]).drop("z")


def gibbs(conditionals: list, start: list[float], steps: int, seed: int = 0) -> np.ndarray:
    """A chain of one model: each coordinate in turn is drawn by conditionals[i](rng, x), given the others."""
    rng = np.random.default_rng(seed)
    x, out = np.array(start, float), np.empty((steps, len(start)))
    for k in range(steps):
        for i, draw in enumerate(conditionals):
            x[i] = draw(rng, x)
        out[k] = x
    return out
