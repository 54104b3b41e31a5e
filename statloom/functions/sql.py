"""Functions for Spark SQL: `register(spark)` adds them to a session. All but log_prob and sample_from are SQL that Catalyst inlines.

A distribution is struct(data, n, loc, scale). `norm(loc, scale)` is one without data; `norm_of(values)` has its values, their
number, mean and sample variance (aggregate with `norm_of(collect_list(struct(x)).x)`, which keeps nulls in n);
`condition(a, b)` is a given b, `condition_data(values, d)` gives d more data, of which the aggregate form is
`condition_data(collect_list(struct(x)).x, d)`.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DISTRIBUTION = "STRUCT<data: ARRAY<DOUBLE>, n: BIGINT, loc: DOUBLE, scale: DOUBLE>"
_SUM = "aggregate({0}, 0D, (s, v) -> s + coalesce({1}, 0D))"
_KNOWN = "size(filter({0}, v -> v IS NOT NULL))"
FUNCTIONS = {
    "odds(p DOUBLE)": ("DOUBLE", "p / (1 - p)"),
    "logit(p DOUBLE)": ("DOUBLE", "CASE WHEN p = 1 THEN double('infinity') ELSE ln(greatest(p, 2.220446049250313e-16D) / (1 - greatest(p, 2.220446049250313e-16D))) END"),
    "sigmoid(x DOUBLE)": ("DOUBLE", "1 / (1 + exp(-x) + 2.220446049250313e-16D)"),
    "standardize(x DOUBLE, mean DOUBLE, sd DOUBLE)": ("DOUBLE", "(x - mean) / sd"),
    "norm_log_prob(x DOUBLE, loc DOUBLE, scale DOUBLE)": ("DOUBLE", "-0.5D * (ln(2 * pi() * scale) + (x - loc) * (x - loc) / scale)"),
    "norm(loc DOUBLE, scale DOUBLE)": (DISTRIBUTION, f"CAST(named_struct('data', NULL, 'n', 1L, 'loc', loc, 'scale', scale) AS {DISTRIBUTION})"),
    "mean_of(x ARRAY<DOUBLE>)": ("DOUBLE", f"{_SUM.format('x', 'v')} / nullif({_KNOWN.format('x')}, 0)"),
    "norm_of(x ARRAY<DOUBLE>)": (
        DISTRIBUTION,
        # the mean is a lambda's variable: written twice into the sum, it was computed anew for every value
        f"transform(array(mean_of(x)), m -> named_struct('data', x, 'n', bigint(size(x)), 'loc', m, 'scale', {_SUM.format('x', '(v - m) * (v - m)')} / nullif({_KNOWN.format('x')} - 1, 0)))[0]",
    ),
    f"condition(a {DISTRIBUTION}, b {DISTRIBUTION})": (DISTRIBUTION, "a"),
    f"condition_data(x ARRAY<DOUBLE>, d {DISTRIBUTION})": (DISTRIBUTION, "named_struct('data', concat(coalesce(d.data, array()), x), 'n', d.n + size(x), 'loc', d.loc, 'scale', d.scale)"),
}


def log_prob(document: str | None) -> float | None:
    from statloom.sources.documents import Document

    return None if document is None else Document.of(json.loads(document)).log_prob()


def sample_from(document: str | None) -> str | None:
    """The document with as many new observations as its n says (1 if it says nothing), drawn by a seed that its text gives."""
    from zlib import crc32

    from statloom.sources.documents import Document

    if document is None:
        return None
    found = Document.of(json.loads(document))
    found.obs = found.sample(found.n or 1, crc32(document.encode()))
    return json.dumps(found.tree())


def register(spark: SparkSession) -> None:
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")

    @F.pandas_udf("double")
    def log_probs(documents: pd.Series) -> pd.Series:
        return documents.map(log_prob)

    @F.pandas_udf("string")
    def samples(documents: pd.Series) -> pd.Series:
        return documents.map(sample_from)

    spark.udf.register("log_prob", log_probs)
    spark.udf.register("sample_from", samples)


def distribution(x: Column) -> Column:
    """The aggregate without the data: struct(n, loc, scale); n counts nulls, the moments skip them. Bounded whatever the group's size."""
    return F.struct(F.count(F.lit(1)).alias("n"), F.avg(x).alias("loc"), F.var_samp(x).alias("scale"))


def pooled(parts: Column) -> Column:
    """struct(n, loc, scale) of the union of samples, by an array of struct(n, known, loc, scale); known: values without nulls."""
    start = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "known")], *[F.lit(0.0).alias(c) for c in ("loc", "m2")])

    def add(s, p):
        known, d = s["known"] + p["known"], p["loc"] - s["loc"]
        empty = p["known"] == 0
        loc = F.when(empty, s["loc"]).otherwise(s["loc"] + d * p["known"] / known)
        m2 = F.when(empty, s["m2"]).otherwise(s["m2"] + F.coalesce(p["scale"], F.lit(0.0)) * (p["known"] - 1) + d * d * s["known"] * p["known"] / known)
        return F.struct((s["n"] + p["n"]).alias("n"), known.alias("known"), loc.alias("loc"), m2.alias("m2"))

    def end(s):
        return F.struct(s["n"].alias("n"), F.when(s["known"] > 0, s["loc"]).alias("loc"), F.when(s["known"] > 1, s["m2"] / (s["known"] - 1)).alias("scale"))

    return F.aggregate(parts, start, add, end)
