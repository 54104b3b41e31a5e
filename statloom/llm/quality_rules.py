"""Quality rules: lines that too many documents of a host share go, and documents that they deplete are rejected.

Lines are normalised (lower case, white space runs to one space, trimmed) and hashed; for each host (`source`) the distinct
documents of each hash are counted. A line of more than max(min_docs, sqrt(growth * documents of the host)) documents goes
from all of them: the limit is 14 of 200, 316 of 100,000, 3,162 of ten million. A document is depleted if fewer than min_left
words or less than min_left_share of its words stay.

Rows that repeat (doc_id, source, text) are one document when lines are counted, and all get its verdict. Null text has no
words, so it fails the base rules; a null source is a host of its own. Rows without a doc_id are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import SPACE, SPACES, packed, scratch, spread_join, table, unpacked, words, written

MIN_WORDS = 10
REPEATED_PERCENT = 20
WINDOW = 5
MIN_DOCS = 10
#: The limit grows as the root of a host's documents: a share of them would let through what thousands of a large host have in common.
GROWTH = 1
MIN_LEFT = 10
MIN_LEFT_SHARE = 0.3
SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]"


def base_metrics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; one pass, nothing is shuffled.

    Windows of WINDOW words are compared by a 64-bit hash of their words' 64-bit hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    starts = lambda n: F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    df = (
        docs.withColumn("_h", F.transform(words(text), lambda w: F.xxhash64(w)))
        .withColumn("n_words", F.size("_h").cast("long"))
        .withColumn("_w", F.transform(starts(F.size("_h")), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + j) for j in range(WINDOW)])))
        .withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    )
    at = lambda j: F.get(F.col("_s"), j)["h"]
    twin = F.transform("_s", lambda e, j: F.when((F.coalesce(at(j - 1), e["h"] + F.lit(0)) == e["h"]) & (j > 0) | (j < F.size("_s") - 1) & (F.coalesce(at(j + 1), e["h"]) == e["h"]), e["i"]))
    df = df.withColumn("_p", F.sort_array(F.filter(twin, lambda i: i.isNotNull())))
    step = lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), j + 1) - x, F.lit(WINDOW)))
    real = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD))
    return (
        df.withColumn("n_repeat_words", F.coalesce(F.aggregate(F.transform("_p", step), F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
        .withColumn("_lines", real)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(text, SPACES, "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")))
        .drop("_h", "_w", "_s", "_p", "_lines")
    )


def normalised(line):
    return F.lower(F.btrim(F.regexp_replace(line, SPACES, " "), F.lit(SPACE)))


def _keys(docs: DataFrame) -> list:
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    host = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce(F.col("source"), F.lit("")))  # a null source is a host of its own
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("_id"), own.alias("_th"), host.alias("_host")]


KEYS = ["_id", "_th", "_host"]


def host_lines(docs: DataFrame) -> DataFrame:
    """(_id, _th, _host, h, i, n): each document's lines with a word, once however often its row repeats."""
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda s, i: F.struct(i.alias("i"), normalised(s).alias("s")))
    lines = F.transform(F.filter(lines, lambda e: e["s"] != ""), lambda e: F.struct(e["i"].alias("i"), F.xxhash64(e["s"]).alias("h"), F.size(F.split(e["s"], " ")).alias("n")))
    each = docs.select(*_keys(docs), F.explode(lines).alias("e")).select("_id", "_th", "_host", "e.h", "e.i", "e.n")
    return each.distinct()


def frequent_lines(lines: DataFrame, base: DataFrame, min_docs: int = MIN_DOCS, growth: int = GROWTH) -> DataFrame:
    """(_host, h, n_docs) of the lines above their host's limit. base: one row (_id, _th, _host) for each document."""
    hosts = base.groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs")).withColumnRenamed("_host", "_of")
    counts = lines.select(*KEYS, "h").distinct().groupBy("_host", "h").agg(F.count(F.lit(1)).alias("n_docs"))
    few = counts.where(F.col("n_docs") > min_docs)
    return few.join(hosts, F.col("_host") == F.col("_of")).where(F.col("n_docs") > growth * F.col("host_docs") / F.col("n_docs")).select("_host", "h", "n_docs")


def verdicts(docs: DataFrame, min_docs: int = MIN_DOCS, growth: int = GROWTH, min_left: int = MIN_LEFT, min_left_share: float = MIN_LEFT_SHARE) -> DataFrame:
    """One row for each row of docs: doc_id, the base metrics, n_removed_lines, n_removed_words, kept, and removed (hashes of the lines that go)."""
    with scratch(docs.sparkSession):
        base, gone = _judged(docs, min_docs, growth)
        gone = written(gone, "rules-gone", keep=True)
    df = spread_join(base, gone, KEYS, how="left", large=True)
    df = df.withColumn("n_removed_lines", F.coalesce("n_removed_lines", F.lit(0)).cast("long")).withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < min_left) | (left < min_left_share * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & ~depleted)


def _judged(docs: DataFrame, min_docs: int, growth: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their base metrics, and for each document that loses lines: which, and how many rows it has (_n)."""
    base = written(base_metrics(docs.select("doc_id", "source", "text")).select("doc_id", *_keys(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), "rules-base", keep=True)
    lines = written(host_lines(docs), "rules-lines")
    each = written(base.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")), "rules-documents")
    over = written(frequent_lines(lines, each, min_docs, growth).withColumnRenamed("n_docs", "_n"), "rules-over")
    gone = spread_join(lines, over, ["_host", "h"]).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_removed_lines"), F.sum("n").alias("n_removed_words"), F.collect_set("h").alias("removed"))
    rows = each.select(*[F.col(k).alias(f"_{k}") for k in KEYS], "_n")
    on = [F.col(k) == F.col(f"_{k}") for k in KEYS]
    return base, gone.join(rows, on).drop(*[f"_{k}" for k in KEYS])


def apply_rules(docs: DataFrame, **limits) -> DataFrame:
    """docs without the lines above the limits and without the rejected documents; the columns are those of docs, of any name.

    Null text fails the base rules, so such rows go; an empty table gives an empty result.
    """
    with scratch(docs.sparkSession):
        v = verdicts(docs, **limits).where("kept").groupBy(*KEYS).agg(F.first("removed").alias("_removed"), F.count(F.lit(1)).alias("_n"))
        v = written(v.withColumn("_removed", F.coalesce("_removed", F.array().cast("array<bigint>"))), "rules-kept", keep=True)
    own = packed(docs, "doc_id", "source", "text")
    keep = F.filter(F.split(F.col("text"), "\n", -1), lambda s: ~F.array_contains(F.col("_removed"), F.xxhash64(normalised(s))))
    both = spread_join(own.select("*", *_keys(own)), v, KEYS, large=True)
    return unpacked(both.withColumn("text", F.array_join(keep, "\n")), docs.columns, ("doc_id", "source", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words"
    )


_NORM = r"lower(trim(regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g')))"
SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS l, text FROM d),
win AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM w)),
dup AS (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM dup GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
lines AS (SELECT doc_id, source, {_NORM.format("s")} AS s FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS s FROM d)),
host AS (SELECT source, count(*) AS n FROM d GROUP BY source),
freq AS (SELECT source, s, count(DISTINCT doc_id) AS n FROM lines WHERE s <> '' GROUP BY source, s),
over_ AS (SELECT f.source, f.s FROM freq f JOIN host h ON h.source = f.source WHERE f.n > {MIN_DOCS} AND f.n > {GROWTH} * h.n / f.n),
gone AS (SELECT l.doc_id, count(*) AS nl, sum(len(string_split(l.s, ' '))) AS nw FROM lines l JOIN over_ o ON o.source = l.source AND o.s = l.s GROUP BY l.doc_id),
v AS (SELECT base.*, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, coalesce(nl, 0)::BIGINT AS n_removed_lines, coalesce(nw, 0)::BIGINT AS n_removed_words
  FROM base LEFT JOIN gone ON gone.doc_id = base.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {MIN_LEFT} OR n_words - n_removed_words < {MIN_LEFT_SHARE} * n_words))) AS kept,
  n_removed_lines, n_removed_words
FROM v
"""
