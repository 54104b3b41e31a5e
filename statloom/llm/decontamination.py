"""Benchmark decontamination: windows of 10 words of the benchmark as a hash set, looked up for every window of every document.

The benchmark's windows go to the workers by broadcast as sorted arrays, in blocks of at most BLOCK_BYTES of benchmark text. A
window takes 20 bytes beside the text and a text has at most half as many words as bytes, so a block takes at most
11 * BLOCK_BYTES and the bits of its sieve (2^22 bytes): under 50 MB. One block is looked up in one pass that moves nothing.
More blocks are passes of their own, one after another, that write what they hit; documents that were hit get the union by a
join. A hit of a 64-bit window hash is verified by the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import textscan as T
from statloom.llm.common import packed, scratch, spread_join, table, unpacked, written

WINDOW = 10
BLOCK_BYTES = 4 << 20
_BLOOM = 22
#: Bytes of documents looked up at once; a longer text is one block.
_TEXT = 1 << 19
#: Rows whose texts a worker writes anew at once.
ROWS = 500


def _words(text: str) -> list[bytes]:
    data = T.LOWER[np.frombuffer(text.encode(), np.uint8)]
    s, e = T.spans(data, np.array([0, len(data)]), T.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


class Windows:
    """The windows of some benchmark items, sorted by hash for each length: hash, place in the items' words and item."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        blob, ends, n_words = [], [], 0
        self.items: list[str] = []
        for item, text in items:
            w = _words(text)
            if not w:
                continue
            n = min(window, len(w))
            data = np.frombuffer(b" ".join(w), np.uint8)
            h, _ = T.scan(data, np.array([0, len(data)]), T.ALNUM)
            found = T.windows(h, n)
            parts.setdefault(n, []).append((found, n_words + np.arange(len(found)), len(self.items)))
            self.items.append(item)
            ends += [len(x) for x in w]
            blob += w
            n_words += len(w)
        self.blob = b"".join(blob)
        self.at = np.concatenate(([0], np.cumsum(ends, dtype=np.int64))).astype(np.int32)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, own in parts.items():
            keys = np.concatenate([k for k, _, _ in own])
            order = np.argsort(keys, kind="stable")
            place = np.concatenate([p for _, p, _ in own]).astype(np.int32)
            of = np.repeat(np.array([i for _, _, i in own], np.int32), [len(k) for k, _, _ in own])
            self.tables[n] = keys[order], place[order], of[order]
        self.near: dict[int, np.ndarray] = {}

    def sieve(self, n: int) -> np.ndarray:
        """A bit for each of the hashes' low bits; made in the worker."""
        if n not in self.near:
            self.near[n] = np.zeros(1 << _BLOOM, bool)
            self.near[n][self.tables[n][0] & np.uint64((1 << _BLOOM) - 1)] = True
        return self.near[n]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"near": {}}

    def same(self, n: int, h: int, words: list[bytes]) -> set[str]:
        """The items with a window of this hash and these words."""
        keys, place, of = self.tables[n]
        found: set[str] = set()
        for k in range(int(np.searchsorted(keys, np.uint64(h), "left")), int(np.searchsorted(keys, np.uint64(h), "right"))):
            p, item = int(place[k]), self.items[of[k]]
            if item not in found and all(self.blob[self.at[p + j] : self.at[p + j + 1]] == words[j] for j in range(n)):
                found.add(item)
        return found

    def find(self, texts: pa.Array) -> tuple[list[int], list[list[int]], list[list[str]]]:
        """For each text: number of words, spans of hit words (flat: start, end, start, end ...; merged) and the items that occur."""
        n_words, spans, items = [], [], []
        data, at = T.buffers(texts)
        for lo, hi in T.groups(at, _TEXT):
            part, cut = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            h, bounds = T.scan(part, cut, T.ALNUM, T.LOWER)
            n_words += np.diff(bounds).tolist()
            hits: dict[int, list[tuple[int, int]]] = {}
            ids: dict[int, set[str]] = {}
            for n, (keys, _, _) in self.tables.items():
                w = T.windows(h, n)
                maybe = np.flatnonzero(self.sieve(n)[w & np.uint64((1 << _BLOOM) - 1)] & T.inside(bounds, n))
                if len(maybe):
                    maybe = maybe[keys[np.minimum(np.searchsorted(keys, w[maybe]), len(keys) - 1)] == w[maybe]]
                rows = np.searchsorted(bounds, maybe, "right") - 1
                for row in np.unique(rows).tolist():
                    own = _words(part[cut[row] : cut[row + 1]].tobytes().decode())
                    first = int(bounds[row])
                    known: dict[int, tuple[list[bytes], set[str]]] = {}
                    for k in maybe[rows == row].tolist():
                        a = k - first
                        words = own[a : a + n]
                        if known.get(int(w[k]), (None,))[0] != words:
                            known[int(w[k])] = words, self.same(n, int(w[k]), words)
                        got = known[int(w[k])][1]
                        if got:
                            hits.setdefault(row, []).append((a, a + n))
                            ids.setdefault(row, set()).update(got)
            for row in range(hi - lo):
                spans.append(merged(hits.get(row, [])))
                items.append(sorted(ids.get(row, ())))
        return n_words, spans, items


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The benchmark's rows with words as tables (item, text), each with at most block_bytes of text, or with one item.

    Items are dealt by a hash into more and more blocks until none is too large. Rows that repeat an id and a text count once.
    """
    rows = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, -(-size // block_bytes))
    while n > 1:
        block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
        sums = rows.groupBy(block.alias("k")).agg(F.sum(F.octet_length("text")).alias("s"), F.count(F.lit(1)).alias("c"))
        if not sums.where((F.col("s") > block_bytes) & (F.col("c") > 1)).limit(1).count():
            return [rows.where(block == r[0]) for r in sums.select("k").orderBy("k").collect()]  # one number for each block
        n *= 2
    return [rows] if size else []


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words int, spans array<int> (hit words, flat and merged) and items array<string> (ids that occur, sorted).

    Null text has no words; a benchmark item without words has no windows; items that repeat an id count once; an item
    without an id goes by the name "null". Rows of docs that repeat are treated alike; an empty table gives an empty result.
    Other columns come back as they are; one named as a column of the result with `_in` behind its name.
    """
    out = _found(packed(docs, "doc_id", "text"), benchmark, window, block_bytes)
    return unpacked(out, docs.columns, ("doc_id", "text"), n_words=F.col("_n_words"), spans=F.col("_spans"), items=F.col("_items"))


def _found(own: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """docs as packed, with _n_words, _spans and _items."""
    parts = blocks(benchmark, block_bytes)
    if len(parts) <= 1:
        return _pass(own, Windows([tuple(r) for r in parts[0].collect()] if parts else [], window))
    with scratch(own.sparkSession):
        each = None
        for rows in parts:
            keyed = own.select(F.xxhash64("text").alias("_th"), F.length("text").alias("_tl"), "text")
            hit = _pass(keyed, Windows([tuple(r) for r in rows.collect()], window)).where(F.size("_spans") > 0).drop("_n_words", "text")
            hit = written(hit.groupBy("_th", "_tl").agg(F.first(F.struct("_spans", "_items")).alias("z"), F.count(F.lit(1)).alias("_n")), "windows-hit")
            each = hit if each is None else each.unionByName(hit)
        union = each.groupBy("_th", "_tl").agg(F.collect_list("z").alias("z"), F.max("_n").alias("_n"))
        pairs = F.flatten(F.transform("z", lambda z: F.transform(F.filter(z["_spans"], lambda _, i: i % 2 == 0), lambda a, i: F.struct(a.alias("a"), F.get(z["_spans"], i * 2 + 1).alias("b")))))
        union = written(union.select("_th", "_tl", "_n", _merged(F.sort_array(pairs)).alias("_spans"), F.sort_array(F.array_distinct(F.flatten(F.transform("z", lambda z: z["_items"])))).alias("_items")), "windows-all", keep=True)
    counted = _pass(own, Windows([], window)).drop("_spans", "_items")
    both = spread_join(counted.withColumns({"_th": F.xxhash64("text"), "_tl": F.length("text")}), union, ["_th", "_tl"], how="left").drop("_th", "_tl")
    return both.withColumns({"_spans": F.coalesce("_spans", F.array().cast("array<int>")), "_items": F.coalesce("_items", F.array().cast("array<string>"))})


def _merged(pairs):
    """Sorted (a, b) as flat, merged bounds."""

    def step(out, p):
        last = F.element_at(out, -1)
        joins = (F.size(out) > 0) & (p["a"] <= F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(-1)))
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.greatest(last, p["b"])))).otherwise(F.concat(out, F.array(p["a"], p["b"])))

    return F.aggregate(pairs, F.array().cast("array<int>"), step)


def _pass(docs: DataFrame, windows: Windows) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(windows)
    names = docs.columns
    schema = docs.withColumns({"_n_words": F.lit(0), "_spans": F.array().cast("array<int>"), "_items": F.array().cast("array<string>")}).schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, items = sent.value.find(batch.column(names.index("text")))
            new = [pa.array(n, pa.int32()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "_n_words", "_spans", "_items"])

    return docs.mapInArrow(step, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.5, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the benchmark's passages: hit words go with what stands between them; a document of which more than max_share is hit goes whole.

    The columns are those of docs, of any name. See find_hits for nulls, empty tables and repeated rows.
    """
    own, parts = packed(docs, "doc_id", "text"), blocks(benchmark, block_bytes)
    if len(parts) <= 1:
        return unpacked(_cleaned(own, Windows([tuple(r) for r in parts[0].collect()] if parts else [], window), max_share), docs.columns, ("doc_id", "text"))
    hits = _found(own, benchmark, window, block_bytes)
    hit = F.aggregate("_spans", F.lit(0), lambda a, x: x - a)  # ends minus starts: x - a alternates the sign
    kept = hits.withColumn("_hit", hit).where((F.col("_hit") == 0) | (F.col("_hit") <= max_share * F.col("_n_words"))).drop("_items", "_n_words", "_hit")
    names = kept.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            for k, spans in enumerate(batch.column(names.index("_spans")).to_pylist()):
                if spans:
                    texts[k] = without(texts[k], spans)
            columns = [pa.array(texts, batch.column(j).type) if c == "text" else batch.column(j) for j, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return unpacked(kept.mapInArrow(cut, kept.schema), docs.columns, ("doc_id", "text"))


def _cleaned(docs: DataFrame, windows: Windows, max_share: float) -> DataFrame:
    """Both steps of decontaminate in one pass, for one block of windows."""
    sent = docs.sparkSession.sparkContext.broadcast(windows)
    names = docs.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = names.index("text")
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            n_words, spans, _ = sent.value.find(batch.column(k))
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            columns = list(batch.columns)
            if any(hit):
                texts = columns[k].to_pylist()
                columns[k] = pa.array([without(t, s) if s else t for t, s in zip(texts, spans, strict=True)], columns[k].type)
            keep = pa.array([h == 0 or h <= max_share * n for h, n in zip(hit, n_words, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=names)

    return docs.mapInArrow(step, docs.schema)


def without(text: str, spans: list[int]) -> str:
    """text without the words of the spans (flat bounds by word number)."""
    raw = text.encode()
    s, e = T.spans(T.LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), T.ALNUM)
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[last : s[a]])
        last = int(e[b - 1])
    return b"".join([*out, raw[last:]]).decode()


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0), lambda a, x: x - a)
    return hits.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_W = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, sizes)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id
"""
