"""Quality classifier: a linear-chain conditional random field labels every line of a document good or bad.

A line is seen through its own features and those of the lines before and after it. Forward-backward gives each line's
marginal; weighted by the lines' lengths these make the document's quality, which one fitted logistic curve brings to
[0, 1] so that 0.3 parts the labels best on the sampled rows.

The field is fitted on the driver, on the line features of a bounded sample of about SAMPLE labelled documents; each line
has its document's label. Only text makes features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import textscan as T
from statloom.llm.common import fold, held_out, packed, table, unpacked

SAMPLE = 4000
CHAIN = 64  # lines of a training chain; longer documents are several chains
STEPS = 200
THRESHOLD = 0.3
WINDOW = 5
#: Bytes of text whose line features are held at once; a longer text is one block.
BLOCK = 1 << 19

_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#$%&*<>{}[]\\^~=+_@", "bar": b"|", "bang": b"!?", "stop": b".,;:", "wide": range(192, 256)}
_MASKS = {k: np.isin(np.arange(256), list(v)) for k, v in _KINDS.items()}
_CUTS = {"upper": (0.15, 0.3, 0.7), "digit": (0.02, 0.1), "symbol": (0.02, 0.1, 0.25), "bar": (0.01, 0.05), "bang": (0.02, 0.1), "stop": (0.005, 0.1), "wide": (0.02,), "long": (0.25, 0.45), "same": (0.5, 0.8), "again": (0.1, 0.3, 0.7)}
N_LINE = 6 + sum(1 + len(c) for c in _CUTS.values())


def line_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows: (first row, last row + 1, features [lines, N_LINE], lengths of lines, bounds of the rows' lines)."""
    data, at = T.buffers(texts)
    for lo, hi in T.groups(at, BLOCK):
        part, cut = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        breaks = np.flatnonzero(part == 10) + 1
        starts = np.sort(np.concatenate((cut[:-1], breaks)), kind="stable")
        # a row has as many lines as line breaks and one more; a break at a row's end starts its last, empty line
        per_row = np.searchsorted(breaks, cut[1:], "right") - np.searchsorted(breaks, cut[:-1], "right") + 1
        bounds = np.concatenate(([0], np.cumsum(per_row)))
        starts = np.concatenate([np.concatenate(([cut[r]], breaks[np.searchsorted(breaks, cut[r], "right") : np.searchsorted(breaks, cut[r + 1], "right")])) for r in range(hi - lo)]) if hi > lo else starts
        ends = np.append(starts[1:], cut[-1])
        size = (ends - starts).astype(float)
        some = np.maximum(size, 1)

        def count(mask: np.ndarray, part=part, starts=starts, ends=ends) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
            return (sums[ends] - sums[starts]).astype(float)

        n = {k: count(m[part]) for k, m in _MASKS.items()}
        letters = np.maximum(n["upper"] + n["lower"] + n["wide"], 1)
        s, e = T.spans(part, cut, T.VISIBLE)
        h = T.hashes(part, s, e)
        line_of = np.searchsorted(starts, s, "right") - 1
        words = np.bincount(line_of, minlength=len(starts)).astype(float)
        held = np.maximum(words, 1)
        key = (line_of.astype(np.uint64) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
        key = np.unique(key)
        distinct = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=len(starts))
        doc_words = np.searchsorted(s, cut)
        w = T.windows(h, WINDOW)
        again = np.zeros(len(starts))
        if len(w):
            ok = np.flatnonzero(T.inside(doc_words, WINDOW))
            doc_of = np.searchsorted(doc_words, ok, "right") - 1
            both = (doc_of.astype(np.uint64) << np.uint64(44)) | (w[ok] & np.uint64((1 << 44) - 1))
            order = np.argsort(both, kind="stable")
            same = both[order][1:] == both[order][:-1]
            twice = np.zeros(len(ok), bool)
            twice[order[1:][same]] = True  # later ones; the first stands
            again = np.bincount(line_of[ok[twice]], minlength=len(starts)) / held
        ratio = {"upper": n["upper"] / letters, "digit": n["digit"] / some, "symbol": n["symbol"] / some, "bar": n["bar"] / some, "bang": n["bang"] / some, "stop": n["stop"] / some, "wide": n["wide"] / some, "long": size / held / 20, "same": 1 - distinct / held, "again": np.minimum(again, 1)}
        columns = [np.ones(len(starts)), np.log1p(size) / 5, words < 1, (words > 0) & (words < 3), words < 8, np.log1p(words) / 5]
        for k, cuts in _CUTS.items():
            columns += [np.minimum(ratio[k], 1.5), *(ratio[k] > c for c in cuts)]
        yield lo, hi, np.stack(columns, 1).astype(np.float64), size + 1, bounds


def in_context(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each line's features beside those of its neighbours; zeros where a document begins or ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[bounds[:-1][np.diff(bounds) > 0]] = 0
    after[bounds[1:][np.diff(bounds) > 0] - 1] = 0
    return np.concatenate((x, before, after), 1)


class Field:
    """w: weights of 'good'; t: [2, 2] scores of transitions (from, to)."""

    def __init__(self, d: int):
        self.w, self.t, self.a, self.b = np.zeros(d), np.zeros((2, 2)), 1.0, 0.0

    def marginals(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and expected transitions of each step [lines, 2, 2] (0 where a chain begins)."""
        u = np.clip(x @ self.w, -30, 30)
        lens = np.diff(bounds)
        order = np.argsort(-lens, kind="stable")
        lens, first = lens[order], bounds[:-1][order]
        emit = np.stack((np.ones_like(u), np.exp(u)), 1)
        emit /= emit.sum(1)[:, None]
        move = np.exp(self.t - self.t.max())
        a, b, pairs = np.zeros((len(u), 2)), np.ones((len(u), 2)), np.zeros((len(u), 2, 2))
        longest = int(lens[0]) if len(lens) else 0
        live = np.searchsorted(-lens, -np.arange(longest + 1), "left")  # chains with more than t lines
        for t in range(longest):
            at = first[: live[t]] + t
            v = emit[at] if t == 0 else emit[at] * (a[at - 1] @ move)
            a[at] = v / v.sum(1)[:, None]
        for t in range(longest - 2, -1, -1):
            at = first[: live[t + 1]] + t
            v = (emit[at + 1] * b[at + 1]) @ move.T
            b[at] = v / v.sum(1)[:, None]
        g = a * b
        g /= np.maximum(g.sum(1), 1e-300)[:, None]
        later = np.ones(len(u), bool)
        later[bounds[:-1][np.diff(bounds) > 0]] = False
        k = np.flatnonzero(later)
        p = a[k - 1][:, :, None] * move[None] * (emit[k] * b[k])[:, None, :]
        pairs[k] = p / np.maximum(p.sum((1, 2)), 1e-300)[:, None, None]
        return g[:, 1], pairs

    def document(self, x: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals, as log-odds."""
        good, _ = self.marginals(x, bounds)
        total = np.add.reduceat(lengths, bounds[:-1])
        q = np.clip(np.add.reduceat(lengths * good, bounds[:-1]) / total, 1e-6, 1 - 1e-6)
        return np.log(q / (1 - q))

    def score(self, x: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.document(x, lengths, bounds) + self.b, -30, 30)))

    def fit(self, x: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> None:
        """Maximum likelihood with a small ridge, by Adam over all chains; both labels weigh the same, and so do documents of one label."""
        lens = np.diff(bounds)
        y = np.repeat(labels, lens)
        chains = np.unique(np.concatenate([np.concatenate((np.arange(a, b, CHAIN), [b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]))
        share = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1))
        weight = np.repeat(share / lens, lens)
        begun = np.zeros(len(y), bool)
        begun[chains[:-1]] = True
        wanted = np.zeros((2, 2))
        k = np.flatnonzero(~begun)
        np.add.at(wanted, (y[k - 1].astype(int), y[k].astype(int)), weight[k])
        m = np.zeros(len(self.w) + 4)
        v = np.zeros_like(m)
        for step in range(1, steps + 1):
            good, pairs = self.marginals(x, chains)
            g = np.concatenate((x.T @ (weight * (y - good)) - 1e-4 * self.w, (wanted - (weight[:, None, None] * pairs).sum(0) - 1e-3 * self.t).ravel()))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.w += move[:-4]
            self.t += move[-4:].reshape(2, 2)
        z = self.document(x, lengths, bounds)
        order = np.argsort(z, kind="stable")
        below_bad = np.cumsum(labels[order] == 0) / max((labels == 0).sum(), 1)
        below_good = np.cumsum(labels[order] == 1) / max((labels == 1).sum(), 1)
        best = int(np.argmax(below_bad - below_good))
        edge = (z[order][best] + z[order][min(best + 1, len(z) - 1)]) / 2
        self.a, self.b = 0.5, float(np.log(THRESHOLD / (1 - THRESHOLD)) - 0.5 * edge)


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, quality) of about `sample` labelled rows outside fold 0. A document with several labels has the lowest."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    drawn = known.where(F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id"), 11) / F.lit(float(1 << 53)) < min(1.0, sample / max(n, 1)))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # about `sample` rows of two numbers
    # however often a row or an id is repeated, each id gives one text: the one with the least hash
    one = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("z"))
    return one.select(F.col("doc_id").cast("long").alias("doc_id"), "z.text", "quality")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """The fitted field. Without labels of both kinds all scores are 0.5 or more alike."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x, lengths, bounds in line_features(batch.column(1)):
                cut = bounds
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo).cast(pa.int32()), pa.array([x[a:b].astype(np.float32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([lengths[a:b].astype(np.float32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                    names=["doc_id", "quality", "x", "n"],
                )

    field = Field(3 * N_LINE)
    rows = sampled(docs, labels, sample).mapInArrow(step, "doc_id bigint, quality int, x binary, n binary").toArrow()
    rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "quality", "x", "n")), strict=True))
    y = np.array([q for _, q, _, _ in rows], float)
    if not len(rows) or y.min() == y.max():
        field.a, field.b = 0.0, 0.0
        return field
    x = [np.frombuffer(r[2], np.float32).reshape(-1, N_LINE) for r in rows]
    lengths = np.concatenate([np.frombuffer(r[3], np.float32) for r in rows]).astype(float)
    bounds = np.concatenate(([0], np.cumsum([len(a) for a in x])))
    field.fit(in_context(np.concatenate(x).astype(float), bounds), lengths, bounds, y)
    return field


def score(docs: DataFrame, field: Field) -> DataFrame:
    """docs with score. Null and empty texts are one empty line; rows that repeat get the same score; an empty table gives an empty result.

    Other columns come back as they are, one named score as score_in.
    """
    own = packed(docs, "text")
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            for _, _, x, lengths, bounds in line_features(batch.column(0)):
                found.append(sent.value.score(in_context(x, bounds), lengths, bounds))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found), pa.float64())], names=["text", "_rest", "_score"])

    return unpacked(own.mapInArrow(step, own.withColumn("_score", F.lit(0.0)).schema), docs.columns, ("text",), score=F.col("_score"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
