"""Prefix sums in a total order without a single-partition window.

Rows are range-partitioned and sorted; each partition sums on its own, and the partitions' totals, one row for each partition
and group, give what came before. So a group of any size is shared by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.shared import written


def prefix(df: DataFrame, order: list[str | Column], sums: dict[str, Column], by: list[str] | None = None, whole: dict[str, str] | None = None) -> DataFrame:
    """df with the inclusive running sums; order must tell rows of a group apart, else ties fall in any order.

    whole: name -> running sum; a column of that name has the sum of the whole group, from the same few rows as the offsets.
    """
    by, whole = by or [], whole or {}
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = df.withColumns({f"_s_{k}": v for k, v in sums.items()}).repartitionByRange(*[F.col(b) for b in by], *keys)
    placed = written(placed.withColumn("_pid", F.spark_partition_id()))
    own = Window.partitionBy("_pid", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("_pid", *by).agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_pid").alias("_p"), *[F.col(b).alias(f"_b_{b}") for b in by], *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
        *[F.sum(f"_t_{k}").over(Window.partitionBy(*by)).alias(name) for name, k in whole.items()],
    )
    on = F.col("_pid") == F.col("_p")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    out = placed.withColumns({k: F.sum(f"_s_{k}").over(own) for k in sums}).join(offsets, on)
    out = out.withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in sums})
    return out.drop("_pid", "_p", *[f"_s_{k}" for k in sums], *[f"_o_{k}" for k in sums], *[f"_b_{b}" for b in by])


def numbered(df: DataFrame, order: list[str | Column], name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """df with the position in order, from 0."""
    return prefix(df, order, {name: F.lit(1).cast("long")}, by).withColumn(name, F.col(name) - 1)


def first_reaching(df: DataFrame, order: list[str], value: str, least: float, by: list[str] | None = None) -> DataFrame:
    """(by, pos, val): the first position whose running sum is at least `least`; no row if it never is."""
    by = by or []
    run = prefix(df, order, {"_run": F.col(value).cast("double"), "_at": F.lit(1).cast("long")}, by)
    hit = run.where(F.col("_run") >= least).groupBy(*by).agg(F.min(F.struct("_at", "_run")).alias("m"))
    return hit.select(*by, (F.col("m._at") - 1).alias("pos"), F.col("m._run").alias("val"))


def range_sum(df: DataFrame, order: list[str], value: str, start: int, end: int, by: list[str] | None = None) -> DataFrame:
    """Sum of positions start (inclusive) to end (exclusive) by prefix sums; positions beyond a group's end count as 0."""
    by = by or []
    run = prefix(df, order, {"_run": F.col(value).cast("double"), "_at": F.lit(1).cast("long")}, by)
    upto = lambda k: F.when(F.col("_at") <= k, F.col("_at"))
    at = lambda k: F.coalesce(F.max_by("_run", upto(k)), F.lit(0.0)) if k > 0 else F.lit(0.0)
    return run.where(F.col("_at") <= max(end, 1)).groupBy(*by).agg((at(max(start, end)) - at(start)).alias("range_sum"))


def rolling_median(df: DataFrame, order: list[str], value: str, k: int, by: list[str]) -> DataFrame:
    """df with the middle of the last k values, the value at sorted position floor(m / 2) of the m values there are so far.

    A frame of k rows is sorted for each row; groups are the unit of work, as each row needs its k - 1 predecessors.
    """
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(k - 1), 0)
    return df.withColumn("_last", F.sort_array(F.collect_list(value).over(frame))).withColumn("rolling_median", F.get("_last", F.floor(F.size("_last") / 2).cast("int"))).drop("_last")


def rank_on_insert(df: DataFrame, order: list[str], value: str, by: list[str], last: int | None = None) -> DataFrame:
    """df with insert_rank: how many of the earlier values (of the last `last`, if given) are not above the row's own.

    Over the last k a frame of k rows serves each row. Over all earlier rows the values' ranks part at one bit: for each bit a running
    sum in order counts the earlier values below, so n log n rows are summed and no row meets all before it.
    """
    if last is not None:
        frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(-last, -1)
        seen = F.collect_list(value).over(frame)
        return df.withColumn("_seen", seen).withColumn("insert_rank", F.size(F.filter("_seen", lambda v: v <= F.col(value)))).drop("_seen")
    rows = written(numbered(df, order, "_at", by))
    # of equal values the later row ranks higher, so every earlier value that is not above has a lower rank
    ranked = written(numbered(rows.select(*by, "_at", F.col(value).alias("_v")).where(F.col("_v").isNotNull()), ["_v", "_at"], "_r", by))
    bits = max(1, int(ranked.agg(F.max("_r")).head()[0] or 0).bit_length())
    each = ranked.select(*by, "_at", "_r", F.explode(F.array(*[F.lit(k) for k in range(bits)])).alias("_level"))
    each = each.withColumns({"_above": F.expr("bigint(_r) >> (_level + 1)"), "_one": F.expr("(_r >> _level) & 1")})
    run = prefix(each, ["_at"], {"_below": 1 - F.col("_one")}, [*by, "_level", "_above"])
    found = run.groupBy(*[F.col(b).alias(f"_b_{b}") for b in by], F.col("_at").alias("_p")).agg(F.sum(F.when(F.col("_one") == 1, F.col("_below"))).alias("_n"))
    on = [F.col("_at") == F.col("_p"), *[F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by]]
    out = rows.join(found, on, "left").withColumn("insert_rank", F.coalesce("_n", F.lit(0)).cast("int"))
    return out.drop("_at", "_p", "_n", *[f"_b_{b}" for b in by])
