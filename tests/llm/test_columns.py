"""Columns of the caller with any name, those of the operators' own columns among them, come back as they were."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from statloom.llm import decontamination, html_extract, language_id, licenses, line_dedup, minhash, mixing, pii, quality_classifier, quality_rules

FOLDER = Path(quality_rules.__file__).parent
INNER = sorted({n for f in FOLDER.glob("*.py") for n in re.findall(r'"(_[a-z][a-z_0-9]*)"', f.read_text())} | {"v", "b", "id", "th", "s", "w", "c", "r", "n", "h", "k", "x", "isle", "clean"})
ROWS = [(1, "one two three four five six seven eight nine ten eleven twelve", "s"), (1, "one two three four five six seven eight nine ten eleven twelve", "s"), (2, "Mr. John Smith, john@mail.com", "t"), (3, None, None), (None, "", "s")]


def bench(df):
    return df.sparkSession.createDataFrame([("q", "three four five six seven eight nine ten eleven twelve")], "item_id string, text string")


def labels(df):
    return df.sparkSession.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")


#: operator -> (function, columns that it adds, rows that it keeps)
CASES = {
    "near": (minhash.near_duplicates, ["class_id", "class_size", "is_first"], 5),
    "one_of_each": (minhash.one_of_each, [], 4),
    "lines": (line_dedup.dedup_lines, ["n_lines", "deleted"], 5),
    "pii": (pii.replaced, [*[f"n_{k}" for k in pii.PATTERNS], "n_entities"], 5),
    "mix": (mixing.mix, ["copies"], None),
    "hits": (lambda df: decontamination.find_hits(df, bench(df)), ["n_words", "spans", "items"], 5),
    "decontaminate": (lambda df: decontamination.decontaminate(df, bench(df), max_share=1.0), [], 5),
    "score": (lambda df: quality_classifier.score(df, quality_classifier.fit(df.select("doc_id", "text"), labels(df))), ["score"], 5),
    "rules": (quality_rules.apply_rules, [], 2),
    "licenses": (licenses.scan, ["sentence_ids", "licenses"], 5),
    "identify": (lambda df: language_id.identify(df, None), ["lang_pred", "score"], 5),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_any_name(name, spark):
    f, added, kept = CASES[name]
    extra = [*INNER, *added]
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").select("*", *[F.lit(f"mine {c}").alias(c) for c in extra])
    out = f(df)
    rows = out.collect()
    assert kept is None or len(rows) == kept
    for c in INNER:
        assert {r[c] for r in rows} <= {f"mine {c}"}, c
    for c in added:
        assert {r[f"{c}_in"] for r in rows} <= {f"mine {c}"} and not any(r[c] == f"mine {c}" for r in rows), c
    empty = f(df.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_pages(spark):
    page = "<body><nav><a>Home</a></nav><article><h1>Title here</h1><p>Some words of text.</p></article></body>"
    df = spark.createDataFrame([(1, page), (1, page), (2, None)], "page_id long, html string").select("*", *[F.lit(f"mine {c}").alias(c) for c in [*INNER, "text"]])
    out = html_extract.extract_pages(df, html_extract.fit(df))
    rows = out.collect()
    assert [r["text"] for r in rows] == ["Title here\n\nSome words of text."] * 2 + [""]
    assert all(r[c] == f"mine {c}" for r in rows for c in INNER) and {r["text_in"] for r in rows} == {"mine text"}
    assert html_extract.extract_pages(df.limit(0), html_extract.fit(df.limit(0))).columns == out.columns
