"""Incremental operators on streams: running summaries, histograms, conjugate updates, and stateful folds."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_summary(events: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, min, max, mean and variance so far; the same plan runs on a batch and, in update or complete mode, on a stream."""
    v = F.col(value)
    return events.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"))


def running_histogram(events: DataFrame, value: str, low: float, width: float, n_bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts by bin under known limits; values outside are left out."""
    b = F.least(F.floor((F.col(value) - low) / width), F.lit(n_bins - 1).cast("long"))
    inside = events.where((F.col(value) >= low) & (F.col(value) <= low + width * n_bins))
    return inside.groupBy(*(by or []), b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def running_beta(events: DataFrame, y: str, a: float, b: float, by: list[str]) -> DataFrame:
    s = events.groupBy(*by).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    return s.select(*by, (F.col("s") + a).alias("alpha"), (F.col("n") - F.col("s") + b).alias("beta"))


def windowed(events: DataFrame, time: str, value: str, width: str, late: str, by: list[str] | None = None) -> DataFrame:
    """Event-time windows with a watermark. A TIMESTAMP_NTZ column is cast first: watermarks need TIMESTAMP."""
    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = own.groupBy(F.window(time, width), *(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *(by or []), "n", "total")


def online_median(events: DataFrame, by: str, order: str, value: str, k: int) -> DataFrame:
    """(by, order, rolling_median): the value at sorted position floor(m / 2) of the last k of a key, kept as state of k numbers.

    Rows of one micro-batch are taken in order; batches come as they come.
    """
    kind, order_kind = events.schema[by].dataType.simpleString(), events.schema[order].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for at, v in zip(rows[order], rows[value], strict=True):
            last = [*last, float(v)][-k:]
            out.append((key[0], at, sorted(last)[len(last) // 2]))
        state.update((last,))
        yield pd.DataFrame(out, columns=[by, order, "rolling_median"])

    return events.select(by, order, value).groupBy(by).applyInPandasWithState(step, f"`{by}` {kind}, `{order}` {order_kind}, rolling_median double", "last array<double>", "append", "NoTimeout")


def online_filter(events: DataFrame, by: str, order: str, y: str, xs: list[str], rate: float) -> DataFrame:
    """(by, n, b): LMS coefficients of a key after each micro-batch; the state is the coefficients."""
    from statloom.operators.linear import LMS

    kind = events.schema[by].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        f, n = LMS(len(xs), rate), 0
        if state.exists:
            b, n = state.get
            f.b = np.array(b)
        for row in pd.concat(list(batches)).sort_values(order)[[y, *xs]].itertuples(index=False):
            f.step(np.array(row[1:], float), float(row[0]))
            n += 1
        state.update((f.b.tolist(), n))
        yield pd.DataFrame({by: [key[0]], "n": [n], "b": [f.b.tolist()]})

    return events.select(by, order, y, *xs).groupBy(by).applyInPandasWithState(step, f"`{by}` {kind}, n long, b array<double>", "b array<double>, n long", "update", "NoTimeout")


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All there is, once: the stream's result as a table in memory (for tests and small results)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


class RankSet:
    """Distinct values in order, at most `size` of them: a value that comes into a full set takes the place of its nearer neighbour in rank."""

    def __init__(self, size: int):
        if size < 2:
            raise ValueError("a set of ranks holds two values at least")
        self.size, self.values = size, []

    def add(self, value: float) -> None:
        k = bisect_left(self.values, value)
        if k < len(self.values) and self.values[k] == value:
            return
        if len(self.values) < self.size:
            self.values.insert(k, value)
        elif k in (0, len(self.values)):
            self.values[min(k, self.size - 1)] = value
        else:
            self.values[k if self.values[k] - value <= value - self.values[k - 1] else k - 1] = value

    def quantile(self, q: float) -> float | None:
        k = int(len(self.values) * q)
        return self.values[k] if k < len(self.values) else None


def rank_sets(df: DataFrame, by: str, order: str, value: str, size: int) -> DataFrame:
    """(by, values): each key's bounded set after all its rows in order. Rows are sorted by Spark and stream through; a task holds one set."""
    placed = df.where(F.col(value).isNotNull()).select(by, order, value).repartition(by).sortWithinPartitions(by, order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, found = None, None
        for pdf in batches:
            for k, v in zip(pdf[by], pdf[value], strict=True):
                if found is None or not (k == key or pd.isna(k) and pd.isna(key)):
                    if found is not None:
                        yield pd.DataFrame({by: [key], "values": [found.values]})
                    key, found = k, RankSet(size)
                found.add(float(v))
        if found is not None:
            yield pd.DataFrame({by: [key], "values": [found.values]})

    return placed.mapInPandas(fold, f"`{by}` {df.schema[by].dataType.simpleString()}, `values` array<double>")
