"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is the sum over all
ways to cut it into pieces, by a forward algorithm over its bytes; a text is scored as the product over its words. The
probabilities come from expectation maximisation (forward and backward) on a bounded sample of labelled rows.

Text is lower-cased; whatever is no letter or mark parts words. A word begins with one space byte, as the vocabulary has
it. The vocabulary is that of a public tokenizer, whole, but for pieces that hold anything else than letters and marks, which no
word can use. Single bytes are pieces too, so that every text has a probability. Words of any length are scored whole; where
the sum of a long word would vanish it is scaled and the scale's logarithm kept.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import textscan as T
from statloom.llm.common import fold, held_out, packed, table, unpacked

#: Where the vocabulary is, unless the session's `spark.statloom.vocabulary` says so.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: About so many labelled rows of each language are sampled for the fit.
PER_LANG = 300
ROUNDS = 4
FLOOR = 1e-6
#: Sums under TINY are scaled by 1 / TINY, every STRIDE bytes: one byte costs FLOOR / 2 at least, so none vanishes in between.
TINY, STRIDE = 1e-120, 16
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[32] = False


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces as bytes, with a space for the mark of a word's start; lower-cased letters and marks only, and all single bytes that these can have."""
    import sentencepiece

    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}; set spark.statloom.vocabulary to a sentencepiece model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in (32, *range(97, 123), *range(128, 256))}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        bare = piece.lstrip("▁")
        if bare and all(unicodedata.category(c)[0] in "LM" for c in bare) and len(piece) - len(bare) <= 1:
            found.add((" " * (len(piece) - len(bare)) + bare).encode())
    return sorted(found)


class Unigrams:
    def __init__(self, pieces: list[bytes], langs: list[str]):
        self.pieces, self.langs = pieces, langs
        self.longest = max(map(len, pieces))
        seen = sorted({b for p in pieces for b in p})
        self.code = np.zeros(256, np.uint8)
        self.code[seen] = np.arange(len(seen), dtype=np.uint8)
        self.width = len(seen)
        rows: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, p in enumerate(pieces):
            node = 0
            for b in p:
                c = int(self.code[b])
                if c not in rows[node]:
                    rows[node][c] = len(rows)
                    rows.append({})
                    ends.append(-1)
                node = rows[node][c]
            ends[node] = k
        self.next = np.zeros(len(rows) * self.width, np.int32)
        for node, to in enumerate(rows):
            for c, x in to.items():
                self.next[node * self.width + c] = x
        self.piece = np.array(ends, np.int32)
        self.p = np.full((len(pieces), len(langs)), 1 / len(pieces))

    def _forward(self, chars: np.ndarray, lens: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """chars: [longest, words], words in order of falling length. alpha [longest + 1, words, languages], the logarithm of what it was
        scaled by [longest + 1, words], and the logarithm of its last value for each word."""
        longest, n = chars.shape
        alpha = np.zeros((longest + 1, n, len(self.langs)))
        scale = np.zeros((longest + 1, n))
        alpha[0] = 1
        reach = np.searchsorted(-lens, -np.arange(longest + 2), "right")  # words with at least so many bytes
        for s in range(longest):
            live_words = reach[s + 1]
            if s and s % STRIDE == 0:
                ahead = alpha[s : s + self.longest, :live_words]
                low = np.flatnonzero(ahead.max((0, 2)) < TINY)
                if len(low):
                    alpha[s : s + self.longest, low] /= TINY
                    scale[s:, low] += np.log(TINY)
            at = np.arange(live_words)
            node = np.zeros(len(at), np.int32)
            for m in range(1, min(self.longest, longest - s) + 1):
                most = np.searchsorted(at, reach[s + m])
                at, node = at[:most], node[:most]
                node = self.next[node * self.width + chars[s + m - 1, at]]
                live = node > 0
                at, node = at[live], node[live]
                if not len(at):
                    break
                p = self.piece[node]
                has = p >= 0
                who, which = at[has], p[has]
                if len(who):
                    alpha[s + m, who] += alpha[s, who] * self.p[which]
                    if keep is not None:
                        keep.append((s, m, who, which))
        every = np.arange(n)
        return alpha, scale, np.log(np.maximum(alpha[lens, every], 1e-300)) + scale[lens, every][:, None]

    def blocks(self, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, chars, lens) of words given as (data, starts, ends), by falling length; about 16 MB of sums at once, or one word."""
        data, starts, ends = words
        lens = ends - starts
        order = np.argsort(-lens, kind="stable")
        lo = 0
        while lo < len(order):
            longest = int(lens[order[lo]])
            own = order[lo : lo + max(1, 2_000_000 // ((longest + 1) * (len(self.langs) + 1)))]
            # a block spans no more than a factor of two in length, so short words do not fill the places of long ones
            own = own[: np.searchsorted(-lens[own], -(longest // 2), "right")] if longest > 32 else own
            places = np.minimum(starts[own] + np.arange(longest)[:, None], len(data) - 1)
            yield own, self.code[data[places]], lens[own]
            lo += len(own)

    def score(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(starts), len(self.langs)))
        for own, chars, lens in self.blocks((data, starts, ends)):
            out[own] = self._forward(chars, lens)[2]
        return out

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> None:
        """One round of expectation maximisation; counts: [words, languages]."""
        found = np.zeros_like(self.p)
        for own, chars, lens in self.blocks((data, starts, ends)):
            keep: list = []
            alpha, scale, z = self._forward(chars, lens, keep)
            # beta at a place is scaled so that alpha * beta there is the word's probability by its own scale
            beta = np.zeros_like(alpha)
            every = np.arange(len(lens))
            beta[lens, every] = np.exp(np.minimum(scale[lens, every][:, None] - z, 700))
            for s, m, who, which in reversed(keep):
                part = self.p[which] * beta[s + m, who] * np.exp(scale[s, who] - scale[s + m, who])[:, None]
                beta[s, who] += part
                got = alpha[s, who] * part * counts[own][who]
                for k in range(len(self.langs)):
                    found[:, k] += np.bincount(which, got[:, k], len(found))
        found /= np.maximum(found.sum(0), 1e-300)
        self.p = np.maximum(found, FLOOR)
        self.p /= self.p.sum(0)


def cleaned(text: Column) -> Column:
    """A space before every word; letters and marks only."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " ")))


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of words with the space before them."""
    s, e = T.spans(data, at, NOT_SPACE)
    return s - 1, e


def fit(docs: DataFrame, path: str | None = None, per_lang: int = PER_LANG, rounds: int = ROUNDS) -> Unigrams | None:
    """Learn from about per_lang distinct texts of each language among rows with a language and a fold other than 0; None if there are none.

    What reaches the driver is a count for each language and distinct word of this sample.
    """
    path = path or docs.sparkSession.conf.get("spark.statloom.vocabulary", VOCABULARY)
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0)).select("lang", "text", F.xxhash64(F.lit(10), "text").alias("h"))
    sizes = {r[0]: r[1] for r in train.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    draw = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    chance = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, per_lang / max(sizes[x], 1)))) for x in langs])
    drawn = train.where(draw < chance).dropDuplicates(["lang", "h"]).select("lang", F.explode(F.split(cleaned(F.col("text")), " ")).alias("word")).where("word <> ''")
    counted = drawn.groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n")).collect()
    words = sorted({r.word for r in counted})
    if not words:
        return None
    place, column = {w: k for k, w in enumerate(words)}, {x: k for k, x in enumerate(langs)}
    weights = np.zeros((len(words), len(langs)))
    for r in counted:
        weights[place[r.word], column[r.lang]] = r.n
    data = np.frombuffer("".join(" " + w for w in words).encode(), np.uint8)
    starts, ends = word_spans(data, np.array([0, len(data)]))
    model = Unigrams(vocabulary(path), langs)
    for _ in range(rounds):
        model.learn(data, starts, ends, weights)
    return model


def identify(docs: DataFrame, model: Unigrams | None) -> DataFrame:
    """docs with lang_pred and score (the posterior of lang_pred under equal priors), without text.

    `und` with score 0 where text is null or has no letter, or where there was nothing to learn from. Whole texts are
    scored; rows that repeat get the same answer; ties go to the first language by code point; an empty table gives an empty
    result. Other columns come back as they are; one named lang_pred or score with `_in` behind its name.
    """
    own = packed(docs, "text").select(F.when(F.col("text").rlike(r"\p{L}"), cleaned(F.col("text"))).alias("clean"), "_rest")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = own.drop("clean").withColumns({"_pred": F.lit(""), "_score": F.lit(0.0)}).schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            pred, sure = [], []
            data, at = T.buffers(batch.column(0))
            for lo, hi in T.groups(at, 1 << 20) if m else [(0, batch.num_rows)]:
                total = np.zeros((hi - lo, len(m.langs) if m else 1))
                if m:
                    part, cut = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                    s, e = word_spans(part, cut)
                    if len(s):
                        _, first, inverse = np.unique(T.hashes(part, s, e), return_index=True, return_inverse=True)
                        each = m.score(part, s[first], e[first])
                        rows = np.searchsorted(cut, s, "right") - 1
                        for k in range(len(m.langs)):
                            total[:, k] = np.bincount(rows, each[inverse, k], hi - lo)
                    best = total.argmax(1)
                    odds = 1 / np.exp(total - total.max(1)[:, None]).sum(1)
                    none = np.diff(cut) == 0
                    pred += ["und" if x else m.langs[b] for b, x in zip(best.tolist(), none.tolist(), strict=True)]
                    sure += np.where(none, 0.0, odds).tolist()
                else:
                    pred += ["und"] * (hi - lo)
                    sure += [0.0] * (hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(pred, pa.string()), pa.array(sure, pa.float64())], names=["_rest", "_pred", "_score"])

    return unpacked(own.mapInArrow(step, schema), [c for c in docs.columns if c != "text"], (), lang_pred=F.col("_pred"), score=F.col("_score"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
