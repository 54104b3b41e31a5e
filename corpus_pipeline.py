"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's docs.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents; where a stage changes a text, n_chars follows it.

Null texts have no words: the classifier scores them as it scores empty ones, and what passes stays until the mix, which takes
no row without words. Rows that repeat are near-duplicates of one another, so one of them stays. Empty tables give an empty
result (without labels every row passes the classifier). Columns beside doc_id, text, source and n_chars may have any name and pass
unchanged; the result has `copies` beside them, or, where documents have such a column, that comes back as copies_in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import decontamination, line_dedup, minhash, mixing, quality_classifier
from statloom.llm.common import quoted, table, written


def _own(df: DataFrame, columns: list[str]) -> DataFrame:
    """The first columns of an operator's result, which are its input's, under their own names."""
    return df.select(*[quoted(c).alias(own) for c, own in zip(df.columns, columns, strict=False)])


def _with_length(df: DataFrame, columns: list[str]) -> DataFrame:
    df = _own(df, columns)
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in columns else df


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores under its threshold go. It learns from the labelled rows of docs outside the held-out fold."""
    field = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    kept = quality_classifier.score(docs, field).where(F.col("score") >= quality_classifier.THRESHOLD)
    return _own(kept, docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts; rows of which every line went, go."""
    done = line_dedup.dedup_lines(docs).where((F.col("n_lines") == 0) | (F.size("deleted") < F.col("n_lines")))
    return _with_length(done, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays."""
    return minhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go from the texts; rows that are mostly such passages go."""
    return _with_length(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with `copies`: how often it takes each."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixture),
]

#: SQL can express neither the classifier nor the sampling; tests hold each stage of run() against brute force on its input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
