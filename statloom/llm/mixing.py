"""Mixing sources to target weights by pivotal dependent rounding.

Every document has the fraction target / source_size of copies. The whole part is sure; the fractional parts are rounded
by the pivotal method: two documents meet, mass (in words) moves from one to the other in a random direction that keeps
both expectations, until one of them holds a whole copy or none. The one that is left over meets the next. Groups of
about `fan_in` documents run this on their own, and the single leftover of each group goes on to the next level of a
reduction tree, so that a source's words miss their target by less than one document. Moving words rather than copies
keeps the sum of words fixed at every meeting.

Rows that repeat (doc_id, source, words) are pre-aggregated, so that one key with a third of all rows is one item.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.llm.common import numbered, packed, scratch, spread_join, table, unpacked, word_count, written

WEIGHTS = (5, 2, 1)
CEILING = 3
FAN_IN = 64
#: Fractions nearer than this to a whole number count as whole.
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, items, rows, target) from (source, size, m): water-filling of the total by weight under ceiling * source_size.

    One row for each source passes through the unpartitioned windows, never a document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    s = (
        sizes.groupBy("source")
        .agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("items"), F.count(F.lit(1)).alias("rows"))
        .withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("ceil", ceiling * F.col("source_size").cast("double"))
        .withColumn("ratio", F.col("ceil") / F.col("w"))
    )
    s = s.withColumn("n", F.row_number().over(by_ratio)).withColumn(
        "level",
        (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("ceil").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    )
    s = s.withColumn("share", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("n", "level"))).over(everything)["level"])
    return s.select("source", "source_size", "items", "rows", F.least(F.col("ceil"), F.coalesce(F.col("share"), F.lit(0.0)) * F.col("w")).alias("target"))


#: One group's pivotal pass. it: the item being met, s.left: the leftover so far (null, or 0 < x < 1).
_MEET = """
aggregate(its,
  named_struct('left', cast(null as {item}), 'done', cast(array() as array<{item}>)),
  (s, it) -> CASE WHEN s.left IS NULL THEN named_struct('left', it, 'done', s.done)
    ELSE transform(array(named_struct('up', least(s.left.a * (1 - s.left.x), it.a * it.x), 'down', least(s.left.a * s.left.x, it.a * (1 - it.x)),
                         'u', shiftrightunsigned(xxhash64({seed}L, s.left.k, it.k), 11) / 9007199254740992D)),
      m -> transform(array(CASE WHEN m.u * (m.up + m.down) < m.down THEN m.up ELSE -m.down END),
        t -> transform(array(named_struct('p', named_struct({fields_left}, 'x', s.left.x + t / s.left.a), 'q', named_struct({fields_it}, 'x', it.x - t / it.a))),
          z -> named_struct(
            'left', CASE WHEN z.p.x > {eps} AND z.p.x < 1 - {eps} THEN z.p WHEN z.q.x > {eps} AND z.q.x < 1 - {eps} THEN z.q END,
            'done', concat(s.done, filter(array(z.p, z.q), e -> e.x <= {eps} OR e.x >= 1 - {eps}))))[0])[0])[0] END)
"""


def pivotal(items: DataFrame, most: int, fan_in: int = FAN_IN, seed: int = 20_240_517) -> DataFrame:
    """Round x in (0, 1) to 0 or 1 within each source, keeping the sum of a * x. items: source, n (items of the source), a double, x double, k long
    (a hash that tells items apart) and payload columns; the result has `bit` for x. most: the largest n, which fixes the tree's height."""
    payload = [c for c in items.columns if c not in ("n", "x")]
    kinds = dict(items.select(*payload).dtypes)
    item = "struct<" + ",".join(f"{c}:{kinds[c]}" for c in payload) + ",x:double>"
    fields = lambda of: ", ".join(f"'{c}', {of}.{c}" for c in payload)
    done, level, width = [], 0, max(most, 1)
    now = items
    while True:
        buckets = F.ceil(F.col("n") / F.lit(fan_in)).cast("long")
        last = width <= fan_in
        meet = _MEET.format(item=item, seed=seed + level, fields_left=fields("s.left"), fields_it=fields("it"), eps=EPS)
        grouped = (
            now.withColumn("b", F.pmod(F.xxhash64(F.lit(seed + 31 * level), "k"), buckets))
            .groupBy("source", F.col("n").alias("n_before"), "b")
            .agg(F.sort_array(F.collect_list(F.struct((-F.col("a")).alias("big"), F.col("k").alias("ord"), F.struct(*payload, "x").alias("it")))).alias("its"))
            .withColumn("its", F.expr("transform(its, e -> e.it)"))
            .select(F.ceil(F.col("n_before") / F.lit(fan_in)).cast("long").alias("n"), F.expr(meet).alias("r"))
        )
        met = written(grouped.select("n", F.col("r.left").alias("left"), F.col("r.done").alias("done")), f"mix-{level}")
        done.append(met.select(F.explode("done").alias("e")).select(*[F.col(f"e.{c}").alias(c) for c in payload], (F.col("e.x") > 0.5).cast("int").alias("bit")))
        rest = met.where(F.col("left").isNotNull()).select(*[F.col(f"left.{c}").alias(c) for c in payload], F.col("left.x").alias("x"), "n")
        if last:
            done.append(rest.select(*payload, (F.shiftrightunsigned(F.xxhash64(F.lit(seed - 1), "k"), 11) / F.lit(float(1 << 53)) < F.col("x")).cast("int").alias("bit")))
            break
        now, width, level = rest, ceil(width / fan_in), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _key(name: str) -> list:
    """A column that may be null as two that are not."""
    return [F.coalesce(F.col(name).cast("string"), F.lit("")).alias(f"_{name}"), F.col(name).isNull().alias(f"_{name}_none")]


def mix_plan(docs: DataFrame, weights: tuple = WEIGHTS, ceiling: int = CEILING, fan_in: int = FAN_IN, seed: int = 20_240_517) -> DataFrame:
    """How often each document is taken: one row for each distinct (doc_id, source, size) with its multiplicity m, source_size, target,
    base (copies that each of the m rows has) and extra (how many of the m rows have one more).

    Null text counts as no words; a null source is a source of its own, last in order. Documents without words are taken 0 times.
    Ties fall by a hash of (doc_id, source, size). An empty table gives an empty result. Only doc_id, text and source are read.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    sizes = written(sizes, "mix-sizes")
    targets = written(source_targets(sizes, weights, ceiling).coalesce(1), "mix-targets")
    most = targets.agg(F.max("items")).head()[0] or 0
    t = written(targets.select(*_key("source"), "source_size", "target", F.col("items").alias("n"), F.col("rows").alias("_n")), "mix-shares")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    items = (
        spread_join(sizes.select("*", *_key("source")), t, ["_source", "_source_none"])
        .drop("_source", "_source_none")
        .withColumn("base", F.when(F.col("size") > 0, F.floor(rate + EPS)).otherwise(F.lit(0)))
        .withColumn("mass", F.when(F.col("size") > 0, F.col("m") * F.greatest(F.lit(0.0), rate - F.col("base"))).otherwise(F.lit(0.0)))
        .withColumn("extra", F.floor(F.col("mass") + EPS))
        .withColumn("x", F.greatest(F.lit(0.0), F.col("mass") - F.col("extra")))
        .withColumn("a", F.col("size").cast("double"))
        .withColumn("k", F.xxhash64(F.lit(seed), "doc_id", "source", "size"))
    )
    keep = ["doc_id", "source", "size", "m", "source_size", "target", "base", "extra"]
    open_ = (F.col("size") > 0) & (F.col("x") > EPS)
    rounded = pivotal(items.where(open_).select(*keep, "a", "k", "n", "x"), most, fan_in, seed).select(*keep[:-1], (F.col("extra") + F.col("bit")).alias("extra"))
    return items.where(~open_).select(*keep).unionByName(rounded)


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """The contract of op5: doc_id, size, source_size, target, taken, one row for each row of docs."""
    with scratch(docs.sparkSession):
        plan = written(mix_plan(docs, **how), "mix-plan", keep=True)
    each = plan.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    copies = F.col("base") + (F.col("i") <= F.col("extra")).cast("long")
    return each.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * copies).cast("long").alias("taken"), "source")


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with `copies` (how often the mix takes the row); rows that are taken 0 times are left out.

    Rows are told apart by (doc_id, source, words). Where m rows share all three, `extra` of them, whichever, get one copy more:
    partitions number their own rows, so that no group meets in one task. Null and empty texts are never taken; an empty table
    gives an empty result. Other columns come back as they are, one named copies as copies_in.
    """
    needed = ("doc_id", "source", "text")
    with scratch(docs.sparkSession):
        plan = mix_plan(docs, **how).select(*_key("doc_id"), *_key("source"), F.col("size").alias("_size"), F.col("m").alias("_n"), F.struct("m", "base", "extra").alias("_p"))
        plan = written(plan.where("_p.base > 0 OR _p.extra > 0"), "mix-plan", keep=True)
    own = packed(docs, *needed).select("*", *_key("doc_id"), *_key("source"), word_count(F.col("text")).alias("_size"))
    keys = ["_doc_id", "_doc_id_none", "_source", "_source_none", "_size"]
    p = F.col("_p")
    even = (p["m"] == 1) | (p["extra"] == 0) | (p["extra"] == p["m"])
    uneven = written(plan.where(~even), "mix-uneven")
    every = spread_join(own, plan.where(even), keys, large=True).withColumn("_copies", p["base"] + (p["extra"] > 0).cast("long"))
    if not uneven.isEmpty():  # only then do the texts pass a second time
        some = numbered(spread_join(own, uneven, keys), keys, "_number").withColumn("_copies", p["base"] + (F.col("_number") <= p["extra"]).cast("long"))
        every = every.unionByName(some.drop("_number")).where("_copies > 0")
    return unpacked(every, docs.columns, needed, copies=F.col("_copies"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))
