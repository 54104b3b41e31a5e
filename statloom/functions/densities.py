"""Log-densities, sufficient statistics, moments of families, and kernels. Every function is a Column expression."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions.scalar import col, lgamma

LN_2PI = math.log(2 * math.pi)


def normal(x: Column, loc: Column | float, variance: Column | float) -> Column:
    v = col(variance)
    d = x - col(loc)
    return F.lit(-0.5) * (F.lit(LN_2PI) + F.ln(v) + d * d / v)


def std_normal(z: Column, sd: Column | float) -> Column:
    """Log-density at x = mean + z * sd."""
    return F.lit(-0.5 * LN_2PI) - F.ln(col(sd)) - z * z / 2


def multinormal(xs: list[Column], mean: list[float], covariance: list[list[float]]) -> Column:
    """A k x k covariance is inverted here; the quadratic form is plain arithmetic."""
    s = np.asarray(covariance, float)
    sign, logdet = np.linalg.slogdet(s)
    if sign <= 0:
        raise ValueError("the covariance is not positive definite")
    p = np.linalg.inv(s)
    d = [x - F.lit(float(m)) for x, m in zip(xs, mean, strict=True)]
    q = sum((F.lit(float(p[i, j])) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return F.lit(-0.5 * (len(d) * LN_2PI + logdet)) - q / 2


def bernoulli(x: Column, theta: Column | float) -> Column:
    return F.when(x.cast("int") == 1, F.ln(col(theta))).otherwise(F.ln(1 - col(theta)))


def log_binomial_coefficient(n: Column | float, k: Column) -> Column:
    return lgamma(col(n) + 1) - lgamma(k + 1) - lgamma(col(n) - k + 1)


def binomial(x: Column, n: Column | float, theta: Column | float) -> Column:
    # the coefficient stands outside the branches, where generated code computes what it repeats once
    n, t = col(n), col(theta)
    some, others = F.when(x == 0, 0.0).otherwise(x * F.ln(t)), F.when(x == n, 0.0).otherwise((n - x) * F.ln(1 - t))
    return log_binomial_coefficient(n, x) + some + others


def poisson(x: Column, rate: Column | float) -> Column:
    return x * F.ln(col(rate)) - col(rate) - lgamma(x + 1)


def gamma(x: Column, shape: Column | float, scale: Column | float) -> Column:
    a, b = col(shape), col(scale)
    return (a - 1) * F.ln(x) - x / b - a * F.ln(b) - lgamma(a)


def beta(x: Column, a: Column | float, b: Column | float) -> Column:
    a, b = col(a), col(b)
    return (a - 1) * F.ln(x) + (b - 1) * F.ln(1 - x) - (lgamma(a) + lgamma(b) - lgamma(a + b))


def categorical(code: Column, probabilities: list[float]) -> Column:
    return F.ln(F.get(F.array(*[F.lit(float(p)) for p in probabilities]), code.cast("int")))


def dirichlet(xs: list[Column], alpha: list[float]) -> Column:
    constant = math.lgamma(sum(alpha)) - sum(math.lgamma(a) for a in alpha)
    return sum((F.lit(a - 1.0) * F.ln(x) for x, a in zip(xs, alpha, strict=True)), F.lit(constant))


def exponential(x: Column, rate: Column | float) -> Column:
    return F.ln(col(rate)) - col(rate) * x


def mixture(parts: list[tuple[float, Column]]) -> Column:
    """ln of the sum of weight * exp(log-density), by the largest term."""
    logs = [F.lit(math.log(w)) + lp for w, lp in parts]
    most = F.greatest(*logs) if len(logs) > 1 else logs[0]
    return most + F.ln(sum((F.exp(x - most) for x in logs), F.lit(0.0)))


def _log_bessel_i0(kappa: float) -> float:
    terms, term, k = 1.0, 1.0, 1
    while term > 1e-17 * terms:
        term *= (kappa / 2) ** 2 / k**2
        terms += term
        k += 1
    return math.log(terms)


def von_mises(x: Column, loc: float, kappa: float) -> Column:
    return F.lit(float(kappa)) * F.cos(x - F.lit(float(loc))) - F.lit(LN_2PI + _log_bessel_i0(kappa))


#: family -> link, inverse link, variance function of the mean
LINKS = {
    "normal": (lambda m: m, lambda e: e, lambda m: F.lit(1.0) + 0 * m),
    "bernoulli": (lambda m: F.ln(m / (1 - m)), lambda e: 1 / (1 + F.exp(-e)), lambda m: m * (1 - m)),
    "poisson": (F.ln, F.exp, lambda m: m),
}


def normal_parts(x: Column, mean: Column | float, variance: Column | float) -> dict[str, Column]:
    """base measure, natural statistic and log-partition of the normal family at known variance."""
    m, v = col(mean), col(variance)
    return {"base_measure": F.lit(1 / math.sqrt(2 * math.pi)) * F.exp(-x * x / (2 * v)), "statistic": m * x / v, "log_partition": m * m / (2 * v) + F.ln(v) / 2}


def sufficient(family: str, y: Column) -> dict[str, Column]:
    """Aggregates that carry all that a family's fit needs."""
    n = F.count(y).alias("n")
    sums = {
        "bernoulli": {"sum_y": F.sum(y)}, "poisson": {"sum_y": F.sum(y)}, "normal": {"sum_y": F.sum(y), "sum_yy": F.sum(y * y)},
        "gamma": {"sum_y": F.sum(y), "sum_ln_y": F.sum(F.ln(y))}, "beta": {"sum_ln_y": F.sum(F.ln(y)), "sum_ln_1y": F.sum(F.ln(1 - y))},
    }[family]
    return {"n": n} | {k: v.alias(k) for k, v in sums.items()}


def moments(family: str, *p: Column | float) -> dict[str, Column]:
    """mean, mode and variance."""
    a = [col(x) for x in p]
    if family == "beta":
        return {"mean": a[0] / (a[0] + a[1]), "mode": (a[0] - 1) / (a[0] + a[1] - 2), "variance": a[0] * a[1] / ((a[0] + a[1]) * (a[0] + a[1]) * (a[0] + a[1] + 1))}
    if family == "gamma":
        return {"mean": a[0] * a[1], "mode": F.greatest(F.lit(0.0), (a[0] - 1) * a[1]), "variance": a[0] * a[1] * a[1]}
    if family == "bernoulli":
        return {"mean": a[0], "mode": (a[0] > 0.5).cast("double"), "variance": a[0] * (1 - a[0])}
    if family == "categorical":  # of the code, from 0
        mean = sum((F.lit(float(k)) * q for k, q in enumerate(a)), F.lit(0.0))
        square = sum((F.lit(float(k * k)) * q for k, q in enumerate(a)), F.lit(0.0))
        return {"mean": mean, "mode": (F.array_position(F.array(*a), F.array_max(F.array(*a))) - 1).cast("double"), "variance": square - mean * mean}
    raise ValueError(f"no family {family}")


def kernel(kind: str, d: Column, h: float, truncate: bool = False) -> Column:
    """Value at distance d under bandwidth h. Kernels are not normalised; Epanechnikov has no cut-off unless truncate."""
    inside = F.abs(d) <= h
    if kind == "gaussian":
        return F.exp(-d * d / (2 * h * h))
    if kind == "tophat":
        return F.when(inside, 1.0).otherwise(0.0)
    if kind == "epanechnikov":
        e = 1 - d * d / (h * h)
        return F.when(inside, e).otherwise(0.0) if truncate else e
    if kind == "exponential":
        return F.exp(-F.abs(d) / (h * h))
    if kind == "linear":
        return F.when(inside, 1 - F.abs(d) / h).otherwise(0.0)
    if kind == "cosine":
        return F.when(inside, F.cos(F.lit(math.pi) * d / (2 * h))).otherwise(0.0)
    raise ValueError(f"no kernel {kind}")


#: The integral of each kernel, for normalised densities.
AREA = {
    "gaussian": lambda h: math.sqrt(2 * math.pi) * h, "tophat": lambda h: 2 * h, "epanechnikov": lambda h: 4 * h / 3,
    "exponential": lambda h: 2 * h * h, "linear": lambda h: h, "cosine": lambda h: 4 * h / math.pi,
}
