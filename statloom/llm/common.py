"""What the training-data operators share: the shared folder, columns of callers, hot keys, word splitting and held-out folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the contracts have it: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
#: A key with more than one row in HOT of a join's rows is hot; there are fewer than HOT such keys, so their rows of the other side may be broadcast.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one, as in tests, gets one of our own; a cluster an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="statloom-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


#: The tables of the scratch blocks that are open now, innermost last.
_made: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, readable after the loss of any executor.

    Within a `scratch` block the table goes at the block's end; with keep it goes with the block around that, if there is one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_made) > keep:
        _made[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written in this block are deleted at its end, but for those to keep. What leaves the block must not read the others."""
    _made.append([])
    try:
        yield
    finally:
        jvm, conf = getattr(spark, "_jvm", None), getattr(getattr(spark, "_jsc", None), "hadoopConfiguration", None)
        for name in _made.pop() if jvm is not None and conf is not None else []:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf()).delete(path, True)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct `_rest`: names of the caller's cannot meet names of an operator's."""
    rest = [c for c in df.columns if c not in needed]
    return df.select(*[quoted(c) for c in needed], (F.struct(*[quoted(c) for c in rest]) if rest else F.lit(None).cast("boolean")).alias("_rest"))


def unpacked(df: DataFrame, columns: list[str], needed: tuple[str, ...], **added: Column | None) -> DataFrame:
    """The columns of the caller as they were and in their order, then those added (None: the column of that name of df).

    A caller's column with the name of an added one comes back as that name with `_in` behind it.
    """
    taken = {c.lower() for c in columns} | {c.lower() for c in added}
    out = []
    for c in columns:
        name = c
        if c.lower() in {a.lower() for a in added}:
            while name.lower() in taken:
                name += "_in"
            taken.add(name.lower())
        out.append((quoted(c) if c in needed else F.col("_rest").getField(c)).alias(name))
    return df.select(*out, *[(F.col(k) if v is None else v).alias(k) for k, v in added.items()])


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], n: str = "_n", how: str = "inner", large: bool = False) -> DataFrame:
    """left joined with right on keys that are unique in right. n: how many rows of left a row of right meets (a column that goes).

    Rows of hot keys take their partner from a broadcast of fewer than HOT rows and are dealt by a hash of the whole row, so no
    key gathers in one task; without hot keys it is one join. right must be a written table. Null keys meet nothing. large: right
    grows with the input, so it is sorted and merged at every size and never broadcast.
    """
    total, most = right.agg(F.sum(n), F.max(n)).head()
    limit = max((total or 0) / HOT, 1000)
    payload = [c for c in right.columns if c not in (*keys, n)]
    names = {c: f"_h_{c}" for c in (*keys, *payload)}
    is_hot = F.col(n) > limit
    if (most or 0) <= limit:
        only = right.select(*[F.col(c).alias(names[c]) for c in (*keys, *payload)])
        both = left.join(only.hint("merge") if large else only, reduce(lambda a, b: a & b, [F.col(c) == F.col(names[c]) for c in keys]), how)
        return both.select(*left.columns, *[F.col(names[c]).alias(c) for c in payload])
    hot = right.where(is_hot).select(*[F.col(c).alias(names[c]) for c in (*keys, *payload)], F.lit(True).alias("_hot"))
    cold = right.where(~is_hot).select(*[F.col(c).alias(f"_c_{c}") for c in (*keys, *payload)], F.lit(True).alias("_cold"))
    met = left.join(F.broadcast(hot), reduce(lambda a, b: a & b, [F.col(c) == F.col(names[c]) for c in keys]), "left")
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_c_{c}") for c in keys])
    # a hot row's first key becomes a salt that meets nothing: it is dealt by the salt and passes the second join alone
    salt = F.when(F.col("_hot"), F.xxhash64(F.monotonically_increasing_id())).cast("string")
    met = met.withColumn("_salt", F.coalesce(salt, F.lit("")))
    cold = cold.withColumn("_c_salt", F.lit(""))
    cold = cold.hint("merge") if large else cold
    both = met.join(cold, on & (F.col("_salt") == F.col("_c_salt")), "left")
    if how == "inner":
        both = both.where(F.col("_hot") | F.col("_cold"))
    return both.select(*left.columns, *[F.coalesce(F.col(names[c]), F.col(f"_c_{c}")).alias(c) for c in payload])


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with a number from 1 on in each key, in any order. Partitions number their own rows and their counts are summed, so no key gathers in one task."""
    placed = written(df.withColumn("_part", F.spark_partition_id()), "numbered")
    own = F.row_number().over(Window.partitionBy("_part", *keys).orderBy("_part"))
    counts = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_part").alias("_of_part"), *[F.col(k).alias(f"_k_{k}") for k in keys], before.alias("_before"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_of_part"))
    out = placed.withColumn(name, own).join(offsets, on)
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_of_part", "_before", *[f"_k_{k}" for k in keys])


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters outside SPACE; 0 for null."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def words(text: Column) -> Column:
    """The words themselves; an empty array for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.filter(F.split(bare, SPACES), lambda w: w != "")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, mod 5; a null id has the fold of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def uniform(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)
