"""Readers and writers: CSV with malformed rows reported, schemas as DDL, JSON models, named values as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.operators.graph import Graph

BAD = "_malformed"


def read_csv(spark: SparkSession, path: str, schema: str, quote: str = '"') -> tuple[DataFrame, DataFrame]:
    """(rows, malformed): rows that do not fit the schema come back as text in a table of their own, with one column `_malformed`.

    The first line is a header, wherever it stands again it is one too; blank lines are no rows; a field holds no line break.
    """
    lines = spark.read.text(path)
    header = lines.head()
    kinds = T.StructType.fromDDL(schema).add(BAD, T.StringType())
    rows = lines.where(F.trim("value") != "") if header is None else lines.where((F.trim("value") != "") & (F.col("value") != F.lit(header[0])))
    parsed = rows.select(F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "quote": quote}).alias("r"))
    good = parsed.where(F.col(f"r.{BAD}").isNull()).select("r.*").drop(BAD)
    return good, parsed.where(F.col(f"r.{BAD}").isNotNull()).select(f"r.{BAD}")


def create_statement(df: DataFrame, name: str) -> str:
    return f"CREATE TABLE {name} ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)})"


def rows_as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row: a table of text that any number of tasks write."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_values(spark: SparkSession, path: str, **values: object) -> None:
    """Named values as one JSON document with sorted keys."""
    import json

    text = json.dumps(values, indent=2, sort_keys=True, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def show_values(**values: object) -> str:
    import json

    return json.dumps(values, indent=2, sort_keys=True, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x))


def read_model(spark: SparkSession, path: str) -> Graph:
    """A model from a JSON document that Spark can read, wherever it lies."""
    return Graph.from_json(spark.read.text(path, wholetext=True).head()[0])


def write_model(spark: SparkSession, path: str, model: Graph) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)
