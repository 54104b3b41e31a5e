"""Model documents: JSON that nests distributions in the parameters of distributions.

A document is {family: body}. bernoulli and poisson have a number (their parameter), {"alpha", "beta"} or {"gamma": ...} for a
conjugate prior, or {"multinormal": ...} for regression coefficients; normal has mu and sigma (a variance), multinormal mu,
sigma and scale, where mu may be a multinormal again (levels) and scale {"pre": categorical, "pos": matrix} (hidden clusters).
n and obs hold the number of observations and themselves.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators import conjugate, interval, linear

FAMILIES = ("bernoulli", "poisson", "normal", "multinormal", "beta", "gamma", "categorical")


@dataclass
class Document:
    family: str
    params: dict = field(default_factory=dict)
    n: int | None = None
    obs: list | None = None

    @staticmethod
    def of(tree: dict) -> Document:
        if not isinstance(tree, dict) or len(tree) != 1 or next(iter(tree)) not in FAMILIES:
            raise ValueError(f"a document is {{family: body}} with one of {', '.join(FAMILIES)}; this is {json.dumps(tree)[:80]}")
        family, body = next(iter(tree.items()))
        if family == "categorical" and isinstance(body, list):
            return Document(family, {"probs": body})
        if not isinstance(body, dict):
            return Document(family, {{"bernoulli": "prop", "poisson": "rate"}.get(family, "value"): float(body)})
        body = dict(body)
        n, obs = body.pop("n", None), body.pop("obs", None)
        if family in ("bernoulli", "poisson") and "multinormal" in body:
            return Document(family, {"coefficients": Document.of(body)}, n, obs)
        if family == "poisson" and "gamma" in body:
            return Document(family, {"rate": Document.of(body)}, n, obs)
        if isinstance(body.get("prop"), dict):
            body["prop"] = Document("beta", body["prop"])
        if family == "multinormal" and isinstance(body.get("mu"), dict):
            body["mu"] = Document.of(body["mu"])
        if isinstance(body.get("scale"), dict):
            body["scale"] = {"pre": Document.of(body["scale"]["pre"]), "pos": body["scale"]["pos"]}
        return Document(family, body, n, obs)

    def tree(self) -> dict:
        plain = lambda v: v.tree() if isinstance(v, Document) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v.tolist() if isinstance(v, np.ndarray) else v
        p = self.params
        extra = {k: v for k, v in (("n", self.n), ("obs", self.obs)) if v is not None}
        if self.family == "categorical":
            return {"categorical": p["probs"]}
        if "coefficients" in p:
            return {self.family: p["coefficients"].tree() | extra}
        if isinstance(p.get("rate"), Document):
            return {self.family: p["rate"].tree() | extra}
        if isinstance(p.get("prop"), Document):
            return {self.family: {"prop": p["prop"].params} | extra}
        if len(p) == 1 and not extra and next(iter(p)) in ("prop", "rate", "value"):
            return {self.family: next(iter(p.values()))}
        return {self.family: {k: plain(v) for k, v in p.items()} | extra}

    def to_json(self) -> str:
        return json.dumps(self.tree(), indent=4)

    def prior(self) -> Document | None:
        return next((v for v in self.params.values() if isinstance(v, Document)), None)

    def depth(self) -> int:
        """How many distributions stand above one another."""
        return 1 + max([v.depth() for v in self.params.values() if isinstance(v, Document)] + [0])

    def log_prob(self, obs: list | None = None) -> float:
        """Of the observations under numbers as parameters; a prior counts by its mean."""
        obs = self.obs if obs is None else obs
        if obs is None:
            raise ValueError("the document has no observations")
        p = self.params
        if self.family == "bernoulli":
            t = p["prop"].mean() if isinstance(p["prop"], Document) else p["prop"]
            return sum(math.log(t if y == 1 else 1 - t) if 0 < t < 1 or y == (t == 1) else -math.inf for y in obs)
        if self.family == "poisson":
            r = p["rate"].mean() if isinstance(p["rate"], Document) else p["rate"]
            return sum(y * math.log(r) - r - math.lgamma(y + 1) for y in obs)
        if self.family == "normal":
            return sum(-0.5 * (math.log(2 * math.pi * p["sigma"]) + (y - p["mu"]) ** 2 / p["sigma"]) for y in obs)
        if self.family == "categorical":
            return sum(math.log(p["probs"][int(y)]) for y in obs)
        raise ValueError(f"{self.family} has no log-probability of a list")

    def mean(self) -> float:
        p = self.params
        if self.family == "beta":
            return p["alpha"] / (p["alpha"] + p["beta"])
        if self.family == "gamma":
            return p["alpha"] / p["beta"]
        own = p.get({"bernoulli": "prop", "poisson": "rate", "normal": "mu"}.get(self.family, ""))
        if own is None:
            raise ValueError(f"{self.family} has no mean of its own")
        return own.mean() if isinstance(own, Document) else own

    def sample(self, n: int, seed: int = 0) -> list[float]:
        """n draws, the parameter from its prior first."""
        rng = np.random.default_rng(seed)
        p = self.params
        drawn = lambda v: (rng.beta(v.params["alpha"], v.params["beta"]) if v.family == "beta" else rng.gamma(v.params["alpha"], 1 / v.params["beta"])) if isinstance(v, Document) else v
        if self.family == "bernoulli":
            return (rng.random(n) < drawn(p["prop"])).astype(float).tolist()
        if self.family == "poisson":
            return rng.poisson(drawn(p["rate"]), n).astype(float).tolist()
        if self.family == "normal":
            return rng.normal(p["mu"], math.sqrt(p["sigma"]), n).tolist()
        if self.family == "categorical":
            return rng.choice(len(p["probs"]), n, p=np.array(p["probs"]) / sum(p["probs"])).astype(float).tolist()
        raise ValueError(f"{self.family} cannot be sampled")

    def posterior(self, df: DataFrame, columns: list[str]) -> Document:
        """This model given the rows of df: a conjugate update, the fit of a regression (the first column on the others) or the most likely normal."""
        y, xs = columns[0], columns[1:]
        n = df.where(F.col(y).isNotNull()).count()
        prior = self.prior()
        if "coefficients" in self.params:
            fit = linear.irls(df, y, xs, {"bernoulli": "binomial", "poisson": "poisson"}[self.family])
            return Document(self.family, {"coefficients": Document("multinormal", {"mu": fit.beta.tolist(), "sigma": fit.inverse.tolist()})}, fit.n)
        if self.family == "bernoulli" and prior:
            r = conjugate.beta_bernoulli(df, y, prior.params["alpha"], prior.params["beta"]).head()
            return Document("bernoulli", {"prop": Document("beta", {"alpha": float(r.alpha), "beta": float(r.beta)})}, n)
        if self.family == "poisson" and prior:
            r = conjugate.gamma_poisson(df, y, prior.params["alpha"], prior.params["beta"]).head()
            return Document("poisson", {"rate": Document("gamma", {"alpha": float(r.alpha), "beta": float(r.beta)})}, n)
        if self.family in ("bernoulli", "poisson", "normal"):
            r = conjugate.normal_mle(df, y).head()
            if r.mean is None:
                raise ValueError("no rows to fit")
            p = {"bernoulli": {"prop": r.mean}, "poisson": {"rate": r.mean}, "normal": {"mu": r.mean, "sigma": r.variance}}[self.family]
            return Document(self.family, p, n)
        if self.family == "multinormal" and "scale" in self.params and xs:
            fit = linear.ols(df, y, xs)
            return Document("multinormal", {"mu": fit.beta.tolist(), "sigma": fit.inverse.tolist()}, fit.n)
        mean, cov, n = conjugate.joint_normal(df, columns)
        return Document("multinormal", {"mu": mean.tolist(), "sigma": cov.tolist()}, n)

    def summary(self, mass: float = 0.95) -> list[dict]:
        """One row for each parameter: name, mean, variance and, where it is known, the credible interval with equal tails."""
        prior, p, rows = self.prior(), self.params, []
        if "coefficients" in p or self.family == "multinormal" and not isinstance(p.get("mu"), Document):
            c = p.get("coefficients", self).params
            for k, m in enumerate(c["mu"]):
                v = c["sigma"][k][k]
                low, high = interval.credible("normal", mass, m, v) if v > 0 else (m, m)
                rows.append({"parameter": f"mu[{k}]", "mean": m, "variance": v, "low": low, "high": high})
        elif prior is not None and prior.family in ("beta", "gamma"):
            a, b = prior.params["alpha"], prior.params["beta"]
            own = (a, b) if prior.family == "beta" else (a, 1 / b)
            v = a * b / ((a + b) ** 2 * (a + b + 1)) if prior.family == "beta" else a / b**2
            low, high = interval.credible(prior.family, mass, *own)
            rows.append({"parameter": "prop" if prior.family == "beta" else "rate", "mean": prior.mean(), "variance": v, "low": low, "high": high})
        else:
            rows += [{"parameter": k, "mean": float(v), "variance": 0.0, "low": float(v), "high": float(v)} for k, v in p.items() if isinstance(v, (int, float))]
        return rows


def read_document(spark: SparkSession, path: str) -> Document:
    return Document.of(json.loads(spark.read.text(path, wholetext=True).head()[0]))


def write_document(spark: SparkSession, path: str, document: Document) -> None:
    spark.createDataFrame([(document.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)
