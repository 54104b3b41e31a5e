"""Line dedup: later copies of repeated runs of lines go.

Lines become identifiers, documents sequences of identifiers. The suffixes of these sequences are ranked by distributed prefix
doubling: ranks of prefixes of 2^k lines give, in pairs (rank at i, rank at i + 2^k), the ranks of prefixes of 2^(k+1) lines,
by a range-partitioned sort of the distinct pairs. Suffixes whose prefix occurs once leave at each level. An interval of
suffixes whose longest common prefix has at least l lines is a class of equal pairs (rank at i, rank at i + l - 2^k); its
first suffix in order of (doc_id, line) stays, and the l lines of every other are a later copy. Runs count from `min_words`
words on: at each suffix the interval is taken at the first depth that has so many words, going on from each line and back
to each line. The union of these spans is the union of all maximal repeated runs of at least min_words words, less first copies.

Whole copies of an earlier text are such runs too; they are found by their hash beforehand and do not enter the ranking.
Lines are compared without white space at their ends. Runs may overlap their first copy within one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.llm.common import SPACE, packed, scratch, spread_join, table, unpacked, word_count, written

MIN_WORDS = 50
DOC = ["_id", "_th"]


def _keys(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), "_th": F.xxhash64(text)})


def _ranked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs with r, the rank of `by` in order of `by`, for classes of two rows or more; the others leave. A very common class is spread over tasks."""
    classes = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    ranks = written(classes.orderBy(*by).withColumn("r", F.monotonically_increasing_id()), "lines-ranks")
    return spread_join(pairs, ranks, by, large=True).drop(*by)


def _runs(repeated: DataFrame, min_words: int) -> DataFrame:
    """(_id, _th, pos, r, stop, begin): lines of unbroken stretches of repeated lines with min_words words or more. stop: the line behind
    the shortest run of so many words that begins here; begin: the first line of the shortest one that ends here; null if there is none.

    A line holds the words from `before` to `upto` of its stretch. Where word number x lies is the last line that begins at x or
    before: lines and questions are put in one order, and a running last value answers them, linear in the stretch's lines.
    """
    order = Window.partitionBy(*DOC).orderBy("pos")
    isle = Window.partitionBy(*DOC, "isle")
    isles = (
        repeated.withColumn("isle", F.col("pos") - F.row_number().over(order))
        .withColumn("upto", F.sum("n").over(isle.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("all", F.sum("n").over(isle))
        .where(F.col("all") >= min_words)
        .withColumn("before", F.col("upto") - F.col("n"))
    )
    ahead, back = F.col("before") + (min_words - 1), F.col("upto") - min_words
    asked = F.filter(
        F.array(
            F.struct(F.col("before").alias("x"), F.lit(0).alias("kind")),
            F.struct(F.when(ahead < F.col("all"), ahead).alias("x"), F.lit(1).alias("kind")),
            F.struct(F.when(back >= 0, back).alias("x"), F.lit(2).alias("kind")),
        ),
        lambda e: e["x"].isNotNull(),
    )
    each = isles.select(*DOC, "isle", "pos", "r", "n", F.explode(asked).alias("e")).select(*DOC, "isle", "pos", "r", "n", "e.x", "e.kind")
    upto_here = isle.orderBy("x", "kind", "pos").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when((F.col("kind") == 0) & (F.col("n") > 0), F.col("pos")), ignorenulls=True).over(upto_here)
    found = each.withColumn("at", at).groupBy(*DOC, "pos").agg(F.max("r").alias("r"), F.max(F.when(F.col("kind") == 1, F.col("at") + 1)).alias("stop"), F.max(F.when(F.col("kind") == 2, F.col("at"))).alias("begin"))
    return found


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _th, start, len): spans of lines that are later copies; they may overlap. docs: _id, _th, text; one row for each document."""
    lines = F.transform(F.split("text", "\n", -1), lambda s: F.btrim(s, F.lit(SPACE)))
    each = docs.select(*DOC, F.posexplode(lines).alias("pos", "s")).select(*DOC, "pos", F.xxhash64("s").alias("h"), F.xxhash64(F.lit(1), "s").alias("g"), word_count(F.col("s")).alias("n"))
    each = written(each, "lines-ids")
    # consecutive repeated lines; stretches without enough words can hold no run
    isles = written(_runs(_ranked(each, ["h", "g"]), min_words), "lines-isles")
    runs = isles.select(*DOC, F.col("pos").alias("start"), (F.col("stop") - F.col("pos")).alias("len")).unionByName(isles.select(*DOC, F.col("begin").alias("start"), (F.col("pos") + 1 - F.col("begin")).alias("len")))
    runs = written(runs.where(F.col("start").isNotNull() & (F.col("len") > 0)).distinct(), "lines-runs")
    longest = runs.agg(F.max("len")).head()[0] or 0
    level, now, found = 0, isles.select(*DOC, "pos", "r"), []
    while (1 << level) <= longest:
        width = 1 << level
        own = runs.where((F.col("len") >= width) & (F.col("len") < 2 * width))
        at = lambda name, now=now: now.select(F.col("_id").alias("_i"), F.col("_th").alias("_t"), F.col("pos").alias("_p"), F.col("r").alias(name))
        here = (F.col("_id") == F.col("_i")) & (F.col("_th") == F.col("_t"))
        own = own.join(at("r1"), here & (F.col("start") == F.col("_p"))).drop("_i", "_t", "_p")
        own = own.join(at("r2"), here & (F.col("start") + F.col("len") - width == F.col("_p"))).drop("_i", "_t", "_p")
        own = written(own, "lines-depth")
        first = own.groupBy("len", "r1", "r2").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*DOC, "start")).alias("first")).where("_n > 1")
        later = spread_join(own, written(first, "lines-first"), ["len", "r1", "r2"], large=True).where(F.struct(*DOC, "start") > F.col("first"))
        found.append(later.select(*DOC, "start", "len"))
        if 2 * width > longest:
            break
        pairs = now.withColumnRenamed("r", "a").join(at("b"), here & (F.col("pos") + width == F.col("_p"))).drop("_i", "_t", "_p")
        now = written(_ranked(pairs, ["a", "b"]), f"lines-{level + 1}")
        level += 1
    if not found:
        return runs.select(*DOC, "start", "len").where("false")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def merged(spans: DataFrame) -> DataFrame:
    """(_id, _th, start, end): the union of each document's spans as disjoint intervals (end exclusive), linear in the spans."""
    order = Window.partitionBy(*DOC).orderBy("start", "end")
    high = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = spans.select(*DOC, "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    placed = placed.withColumn("new", (high.isNull() | (F.col("start") > high)).cast("int"))
    placed = placed.withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.groupBy(*DOC, "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("k")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _th, _n, whole, gone): for documents that lose lines, their rows, whether all lines go, else the intervals that do, in order."""
    keyed = _keys(docs.select("doc_id", "text")).where(F.col("text").isNotNull())
    prints = keyed.select(*DOC, F.xxhash64(F.lit(2), "text").alias("_th2"), word_count(F.col("text")).alias("n"))
    prints = written(prints.groupBy(*DOC, "_th2", "n").agg(F.count(F.lit(1)).alias("rows")), "lines-docs")
    first = written(prints.groupBy("_th", "_th2").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "lines-equal")
    copies = written(spread_join(prints, first, ["_th", "_th2"], large=True).where(F.col("_id") > F.col("first")).select(*DOC, "n"), "lines-copies")
    # only where rows repeat must they be made distinct, which moves every text
    once = keyed.select(*DOC, "text").dropDuplicates(DOC) if prints.where("rows > 1").limit(1).count() else keyed.select(*DOC, "text")
    spans = merged(repeated_spans(once.join(copies.select(*DOC).hint("merge"), DOC, "left_anti"), min_words))
    parts = spans.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("gone"))
    whole = copies.where(F.col("n") >= min_words).select(*DOC, F.lit(True).alias("whole"), F.array().cast("array<struct<start:int,end:int>>").alias("gone"))
    rows = prints.select(F.col("_id").alias("_pi"), F.col("_th").alias("_pt"), F.col("rows").alias("_n"))
    both = parts.select(*DOC, F.lit(False).alias("whole"), "gone").unionByName(whole)
    return both.join(rows, (F.col("_id") == F.col("_pi")) & (F.col("_th") == F.col("_pt"))).select(*DOC, "_n", "whole", "gone")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text less its later copies, n_lines and deleted (numbers of the lines that went, from 0).

    Null text has no lines and stays null; an empty text has one. Of equal runs the one in the lowest (doc_id, line) stays;
    null doc_ids come first. Rows that repeat doc_id and text are one document and get one result. An empty table gives an
    empty result. Other columns come back as they are; one that is named n_lines or deleted as n_lines_in or deleted_in.
    """
    with scratch(docs.sparkSession):
        gone = written(later_copies(docs, min_words), "lines-gone", keep=True)
    own = _keys(packed(docs, "doc_id", "text"))
    both = spread_join(own, gone, DOC, how="left", large=True)
    both = both.withColumn("_lines", F.when(F.col("text").isNotNull(), F.split("text", "\n", -1)))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    numbers = F.flatten(F.transform("gone", lambda g: F.sequence(g["start"], g["end"] - 1)))
    deleted = F.when(F.col("whole"), every).when(F.col("gone").isNotNull(), numbers).otherwise(F.array().cast("array<int>"))
    both = both.withColumn("_deleted", deleted)
    # what lies between the intervals, in order
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["end"]))
    kept = F.flatten(F.transform(starts, lambda a, k: F.slice(F.col("_lines"), a + 1, F.coalesce(F.get(F.col("gone"), k)["start"], F.size("_lines")) - a)))
    text = F.when(F.col("whole"), F.lit("")).when(F.col("gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    both = both.withColumn("text", text)
    return unpacked(both, docs.columns, ("doc_id", "text"), n_lines=F.coalesce(F.size("_lines"), F.lit(0)).cast("long"), deleted=F.col("_deleted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", F.size("deleted").cast("long").alias("n_deleted"), F.array_join("deleted", ",").alias("deleted"), "text")


_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
SQL = rf"""
WITH l0 AS (SELECT doc_id, unnest(range(0, len(p))) AS pos, unnest(p) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
l AS (SELECT doc_id, pos, s AS line, {_TRIM.format("s")} AS s, len(list_filter(string_split_regex(s, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM l0),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l),
fwd AS (SELECT a.doc_id, a.pos AS start, min(b.pos) AS stop FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY ALL),
bwd AS (SELECT b.doc_id, max(a.pos) AS start, b.pos AS stop FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY b.doc_id, b.pos),
runs AS (SELECT DISTINCT * FROM (SELECT doc_id, start, stop FROM fwd UNION ALL SELECT doc_id, start, stop FROM bwd)),
content AS (SELECT r.doc_id, r.start, r.stop, r.stop - r.start AS m, md5(string_agg(l.s, chr(10) ORDER BY l.pos)) AS g FROM runs r JOIN l ON l.doc_id = r.doc_id AND l.pos BETWEEN r.start AND r.stop GROUP BY ALL),
later AS (SELECT doc_id, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY m, g ORDER BY doc_id, start) AS k FROM content) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS pos FROM later),
per AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_deleted, coalesce(string_agg(g.pos::VARCHAR, ',' ORDER BY l.pos), '') AS deleted,
  coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS text FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(deleted, '') AS deleted, per.text FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""
