"""Models as directed graphs of distributions, their JSON documents, and what is computed over them."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import densities as L
from statloom.operators import sampling as R

FAMILIES = ("normal", "bernoulli", "poisson", "gamma", "beta", "binomial", "exponential", "categorical", "constant")


@dataclass
class Graph:
    """nodes: id -> (family, parameters). edges: (parent, child, weight)."""

    nodes: dict[str, tuple[str, dict[str, float]]] = field(default_factory=dict)
    edges: list[tuple[str, str, float | None]] = field(default_factory=list)

    def add(self, node: str, family: str, **parameters: float) -> Graph:
        if family not in FAMILIES:
            raise ValueError(f"no family {family}")
        if node in self.nodes:
            raise ValueError(f"{node} is there already")
        self.nodes[node] = (family, parameters)
        return self

    def condition(self, child: str, *parents: str, weights: list[float] | None = None) -> Graph:
        for k, parent in enumerate(parents):
            if parent not in self.nodes or child not in self.nodes:
                raise ValueError(f"no node {parent if parent not in self.nodes else child}")
            self.edges.append((parent, child, weights[k] if weights else None))
        self.order()
        return self

    def parents(self, node: str) -> list[str]:
        return [p for p, c, _ in self.edges if c == node]

    def children(self, node: str) -> list[str]:
        return [c for p, c, _ in self.edges if p == node]

    def family(self, node: str) -> dict:
        """The Markov blanket: parents, and children with their other parents."""
        return {"parents": self.parents(node), "children": [{"child": c, "coparents": [p for p in self.parents(c) if p != node]} for c in self.children(node)]}

    def order(self) -> list[str]:
        """Parents before children; of nodes that are free the one added first."""
        left = {n: len(self.parents(n)) for n in self.nodes}
        out = []
        while left:
            free = next((n for n, k in left.items() if k == 0), None)
            if free is None:
                raise ValueError("the graph has a cycle")
            out.append(free)
            del left[free]
            for c in self.children(free):
                left[c] -= 1
        return out

    def find(self, name: str) -> str | None:
        """The first node of this family or id, in order."""
        return next((n for n in self.order() if n == name or self.nodes[n][0] == name), None)

    def predictor(self, node: str) -> Column | None:
        """The weighted sum of the columns named as the parents."""
        terms = [F.lit(1.0 if w is None else w) * F.col(p) for p, c, w in self.edges if c == node]
        return reduce(lambda a, b: a + b, terms) if terms else None

    def log_probability(self) -> Column:
        """Of a row with a column for each node: the sum of the nodes' conditional log-densities."""
        return reduce(lambda a, b: a + b, [self.node_log_probability(n) for n in self.order()])

    def node_log_probability(self, node: str) -> Column:
        kind, p = self.nodes[node]
        x, eta = F.col(node), self.predictor(node)
        if kind == "normal":
            return L.normal(x, p.get("loc", 0.0) if eta is None else eta + p.get("loc", 0.0), p.get("scale", 1.0))
        if kind == "bernoulli":
            return L.bernoulli(x, p["theta"] if eta is None else 1 / (1 + F.exp(-eta)))
        if kind == "poisson":
            return L.poisson(x, p["rate"] if eta is None else F.exp(eta))
        if kind == "gamma":
            return L.gamma(x, p["shape"], p["scale"])
        if kind == "beta":
            return L.beta(x, p["a"], p["b"])
        if kind == "binomial":
            return L.binomial(x, p["n"], p["theta"])
        if kind == "exponential":
            return L.exponential(x, p["rate"])
        if kind == "categorical":
            return L.categorical(x, p["probs"])
        if kind == "constant":
            return F.when(x == p["value"], 0.0).otherwise(-math.inf)
        raise ValueError(f"{kind} has no log-probability")

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """n rows, each node drawn after its parents. Numbers are hashes of the seed, the row and the node, so a lost task draws the same again."""
        df = spark.range(n).withColumnRenamed("id", "sample")
        for k, node in enumerate(self.order()):
            kind, p = self.nodes[node]
            eta = self.predictor(node)
            key = (F.lit(seed), F.lit(k), F.col("sample"))
            u = R.uniform(*key)
            if kind == "normal":
                loc = F.lit(p.get("loc", 0.0)) if eta is None else eta + p.get("loc", 0.0)
                df = df.withColumn(node, loc + R.normal(*key) * math.sqrt(p.get("scale", 1.0)))
            elif kind == "bernoulli":
                df = df.withColumn(node, (u < (F.lit(p["theta"]) if eta is None else 1 / (1 + F.exp(-eta)))).cast("int"))
            elif kind == "exponential":
                df = df.withColumn(node, -F.ln(1 - u) / p["rate"])
            elif kind == "poisson":
                df = df.withColumn(node, R.poisson(p["rate"] if eta is None else F.exp(eta), *key))
            elif kind == "gamma":
                df = df.withColumn(node, R.gamma(p["shape"], p["scale"], *key))
            elif kind == "beta":
                df = df.withColumn(node, R.beta(p["a"], p["b"], *key))
            elif kind == "binomial":
                df = df.withColumn(node, R.binomial(p["n"], p["theta"], *key))
            elif kind == "categorical":
                df = df.withColumn(node, R.categorical(p["probs"], *key))
            elif kind == "constant":
                df = df.withColumn(node, F.lit(p["value"]))
            else:
                raise ValueError(f"{kind} cannot be sampled")
        return df

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(nodes(id, kind, params), edges(parent, child, weight))."""
        flat = lambda p: {f"{a}_{i}" if isinstance(b, list) else a: float(x) for a, b in p.items() for i, x in enumerate(b if isinstance(b, list) else [b])}
        nodes = [(k, f, flat(p)) for k, (f, p) in self.nodes.items()]
        return spark.createDataFrame(nodes, "id string, kind string, params map<string,double>"), spark.createDataFrame(self.edges, "parent string, child string, weight double")

    def to_json(self) -> str:
        nodes = [{"id": k, "prob": f, **p} for k, (f, p) in self.nodes.items()]
        edges = [{"parent": p, "child": c, "weight": w} for p, c, w in self.edges]
        return json.dumps({"nodes": nodes, "edges": edges}, indent=2, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Graph:
        doc = json.loads(text)
        out = Graph()
        for n in doc["nodes"]:
            out.add(n["id"], n["prob"], **{k: v for k, v in n.items() if k not in ("id", "prob")})
        out.edges = [(e["parent"], e["child"], e.get("weight")) for e in doc["edges"]]
        out.order()
        return out

    def to_dot(self) -> str:
        lines = [f'  "{k}" [label="{k}: {f}"];' for k, (f, _) in self.nodes.items()]
        lines += [f'  "{p}" -> "{c}";' for p, c, _ in self.edges]
        return "\n".join(["digraph {", *lines, "}"])


def markov_blankets(edges: DataFrame) -> DataFrame:
    """(node, member, role) for all nodes of edges (parent, child): parents, children and children's other parents, by joins.

    Edges are dealt by their child once, which serves the distinct edges and the join; of two coparents only one order is shuffled.
    """
    edges = edges.select("parent", "child").repartition("child").distinct()
    parents = edges.select(F.col("child").alias("node"), F.col("parent").alias("member"), F.lit("parent").alias("role"))
    children = edges.select(F.col("parent").alias("node"), F.col("child").alias("member"), F.lit("child").alias("role"))
    a, b = edges.alias("a"), edges.alias("b")
    co = a.join(b.hint("merge"), (F.col("a.child") == F.col("b.child")) & (F.col("a.parent") < F.col("b.parent"))).select(F.col("a.parent").alias("p"), F.col("b.parent").alias("q")).distinct()
    both = F.explode(F.array(F.struct(F.col("p").alias("node"), F.col("q").alias("member")), F.struct(F.col("q").alias("node"), F.col("p").alias("member"))))
    return parents.unionByName(children).unionByName(co.select(both.alias("_b")).select("_b.*", F.lit("coparent").alias("role")))


def metropolis(log_prob, start: list[float], steps: int, scale: float, seed: int = 0) -> np.ndarray:
    """A random-walk chain of one model; independent chains are independent calls, see `chains`."""
    rng = np.random.default_rng(seed)
    x = np.array(start, float)
    lp, out = log_prob(x), np.empty((steps, len(x)))
    for k in range(steps):
        y = x + rng.normal(0, scale, len(x))
        new = log_prob(y)
        if math.log(rng.random() + 1e-300) < new - lp:
            x, lp = y, new
        out[k] = x
    return out


def chains(spark: SparkSession, log_prob, start: list[float], steps: int, scale: float, n: int, seed: int = 0) -> DataFrame:
    """(chain, step, x): n independent chains, one task's work each."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for c in pdf["id"]:
                x = metropolis(log_prob, start, steps, scale, seed + int(c))
                yield pd.DataFrame({"chain": c, "step": range(steps), "x": x.tolist()})

    return spark.range(0, n, 1, n).mapInPandas(run, "chain long, step long, x array<double>")


def evidence_ratio(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """log of the factor between two models' densities, over all rows."""
    return df.agg((F.sum(a) - F.sum(b)).alias("log_evidence_ratio"))


def decision_boundary(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, errors): the score from which on to say 1, with the fewest errors; of equal ones the lowest. Infinity: never say 1."""
    from statloom.operators.prefix import prefix

    counts = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("one"), F.count_if(F.col(label) == 0).alias("zero"))
    run = prefix(counts, ["threshold"], {"ones": F.col("one"), "zeros": F.col("zero")})
    total = counts.agg(F.sum("zero").alias("all_zero"), F.sum("one").alias("all_one"))
    each = run.crossJoin(F.broadcast(total)).select("threshold", (F.col("ones") - F.col("one") + F.col("all_zero") - F.col("zeros") + F.col("zero")).alias("errors"))  # one row
    never = total.select(F.lit(math.inf).alias("threshold"), F.col("all_one").alias("errors"))
    each = each.select(F.col("threshold").cast("double").alias("threshold"), "errors").unionByName(never)
    return each.agg(F.min(F.struct("errors", "threshold")).alias("m")).select("m.threshold", "m.errors")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by mean ranks over the distinct scores."""
    from statloom.operators.prefix import prefix

    counts = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("one"), F.count_if(F.col(label) == 0).alias("zero"))
    run = prefix(counts, ["s"], {"zeros": F.col("zero")})
    wins = F.sum(F.col("one") * (F.col("zeros") - F.col("zero") / 2))
    return run.agg((wins / (F.sum("one") * F.sum("zero"))).alias("auc"))
