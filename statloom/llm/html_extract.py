"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of tokens: words and tags. A word scores the sum of the weights of what it stands in: its block's tag, a
link, the elements around it, the words of their class, id and role, and how long its block is. Tags cost. The weights are the
most probable ones of a logistic model, given prior weights (PRIOR) and labelled pages: pages that mark their article
themselves, of which a bounded sample of about SAMPLE distinct ones is read. Whether a word stands in a marked article is the
label and no feature, so pages without a mark are read by the same weights. The tags of sections cost as often as the labelled pages have
them outside or at the edge of their article.

One linear scan finds the contiguous region with the highest sum. A run of words that score negative (an advert between two
paragraphs) costs the region at most BOX, and its words do not enter the text. An element that holds an article or nearly all
words of its page is a frame around it: its tag and names say nothing.

Whole pages are read. Null html gives the empty text; broken markup is text or is skipped, never an error; rows that repeat
get the same answer; of regions with equal sums the first and shortest counts; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import packed, table, unpacked

SAMPLE = 400
#: The most that one run of negative words costs a region.
BOX = 4.0
#: Least score of a word, and the most that its block can give it; a word of a heading counts as HEADING words.
LEAST, MOST, HEADING = -4.0, 2.5, 3
#: Cost of an ordinary tag, and what a section's tag costs more at most.
TAG, EDGE = 0.2, 40.0
#: An element with so much of its page's words is a frame.
FRAME = 0.95
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "select", "noembed", "noframes", "canvas", "video", "audio"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul td th".split()
)
MAIN = {"article", "main"}
#: Elements that say something about the words in them, beside the innermost block.
AROUND = set("nav header footer aside form button dialog menu label fieldset head section table figure figcaption details address blockquote ul ol dl".split())
#: Share of a section's tags that stand outside of or at the edge of articles, before any page is seen, worth PRIOR_TAGS tags.
SECTIONS = {"nav": 0.9, "header": 0.6, "footer": 0.9, "aside": 0.1, "form": 0.15, "dialog": 0.9, "menu": 0.9, "article": 1.0, "main": 1.0, "section": 0.05}
PRIOR_TAGS = 20
#: Prior weights of features (log-odds of a word to be of the article). Others begin at 0.
PRIOR = {
    "bias": 1.5,
    **dict.fromkeys(["block:p", "block:h1", "block:h2", "block:h3", "block:blockquote", "block:pre"], 1.0),
    **dict.fromkeys(["link"], -1.0),
    "long": 0.5,
    **dict.fromkeys(["in:nav", "in:footer", "in:aside", "in:form", "in:button", "in:dialog", "in:menu", "in:label", "in:fieldset", "in:head", "hidden"], -5.0),
    "in:header": -4.0,
    **dict.fromkeys(
        ["name:" + w for w in "ad advert advertisement adsense banner cookie consent gdpr promo promotion sponsor sponsored sidebar nav navbar navigation menu breadcrumb footer masthead contentinfo complementary comment reply disqus newsletter subscribe signup popup modal overlay toolbar pagination pager login search advertising".split()],
        -5.0,
    ),
    **dict.fromkeys(["name:" + w for w in "share sharing social related recommended recommendation notice notification alert alertdialog widget skip copyright".split()], -4.0),
}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(text)} if text.strip() else {}


def names(attrs: dict[str, str]) -> set[str]:
    """The words of class, id and role, singular."""
    found = {w.lower() for a in ("class", "id", "role") for w in _WORD.findall(attrs.get(a, ""))}
    return {w[:-1] if len(w) > 2 and w.endswith("s") and not w.endswith("ss") else w for w in found}


class Page:
    """tokens: ("w", element, words, text), ("t", element, 0, tag) or ("b", ...), a break between blocks; elements by number, 0 is the page."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, int, int, str]] = []
        self.parent, self.tag, self.own = [0], [""], [()]
        self.first, self.held, self.main = [0], [0], [False]
        self.words = 0
        self.marks: list[int] = []  # outermost articles
        stack, open_ = [0], Counter()
        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            self._text(source[at : m.start() if m else n], stack[-1])
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:-3], stack[-1])
                continue
            closing, extra = m[1] or m[4], m[3] if m[2] else m[6]
            if closing:
                if open_[tag]:
                    while self._close(stack, open_) != tag:
                        pass
                elif tag == "p":
                    self._break(stack[-1])
                continue
            bare = extra.rstrip().endswith("/")
            if tag in RAW and not bare:
                end = _END[tag].search(source, at)
                at = end.end() if end else n
                continue
            if tag == "br":
                self._text(" ", stack[-1])
                continue
            if tag in VOID:
                if tag == "hr":
                    self._break(stack[-1])
                continue
            top = self.tag[stack[-1]]
            if top == "p" and tag in BLOCKS or top == tag and tag in ("li", "dt", "dd", "tr", "td", "th"):
                self._close(stack, open_)
            e = self._open(tag, attributes(extra), stack[-1])
            if bare:
                self._leave(e)
            else:
                stack.append(e)
                open_[tag] += 1
        while len(stack) > 1:
            self._close(stack, open_)
        self.held[0] = self.words

    def _open(self, tag: str, attrs: dict[str, str], parent: int) -> int:
        e = len(self.tag)
        self.parent.append(parent)
        self.tag.append(tag)
        self.first.append(self.words)
        self.held.append(0)
        self.main.append(False)
        if tag in MAIN or attrs.get("itemprop") == "articleBody":
            up = parent
            while up and not self.main[up]:
                self.main[up] = True  # it holds an article
                up = self.parent[up]
            if not any(self._within(parent, x) for x in self.marks[-1:]):
                self.marks.append(e)
        if tag == "header" and self.marks and self._within(parent, self.marks[-1]):
            self.tag[e] = "inner-header"
        own = {"in:" + tag} if self.tag[e] in AROUND else set()
        if tag not in ("html", "body") and attrs:
            own |= {"name:" + w for w in names(attrs)}
            if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
                own.add("hidden")
        self.own.append(tuple(sorted(own)))
        self._edge(e)
        return e

    def _within(self, e: int, outer: int) -> bool:
        while e > outer:
            e = self.parent[e]
        return e == outer

    def _close(self, stack: list[int], open_: Counter) -> str:
        e = stack.pop()
        tag = self.tag[e].removeprefix("inner-")
        open_[tag] -= 1
        self._leave(e)
        return tag

    def _leave(self, e: int) -> None:
        self.held[e] = self.words - self.first[e]
        self._edge(e)

    def _edge(self, e: int) -> None:
        if self.tag[e] in BLOCKS or self.tag[e] == "inner-header":
            self._break(e)
        self.tokens.append(("t", e, 0, self.tag[e]))

    def _break(self, e: int) -> None:
        self.tokens.append(("b", e, 0, ""))

    def _text(self, raw: str, e: int) -> None:
        if raw:
            text = references.unescape(raw)
            n = len(text.split())
            self.words += n
            self.tokens.append(("w", e, n, text))

    def features(self) -> list[tuple[str, ...]]:
        """What each token's weight depends on: features of a word; empty for tags and breaks."""
        around: list[tuple[str, ...]] = [()]
        block, link = ["-"], [False]
        for e in range(1, len(self.tag)):
            up = self.parent[e]
            frame = self.held[e] > FRAME * self.words or self.main[e]
            extra = () if frame else tuple(x for x in self.own[e] if x not in around[up])
            around.append(tuple(sorted((*around[up], *extra))) if extra else around[up])
            block.append(self.tag[e] if self.tag[e] in BLOCKS else block[up])
            link.append(link[up] or self.tag[e] == "a")
        sizes, number, now = Counter(), [], 0
        for kind, _, n, _ in self.tokens:
            now += kind == "b"
            number.append(now)
            sizes[now] += n
        out: list[tuple[str, ...]] = []
        known: dict[tuple, tuple[str, ...]] = {}
        for (kind, e, _, _), k in zip(self.tokens, number, strict=True):
            if kind != "w":
                out.append(())
                continue
            key = (e, sizes[k] >= 25)
            if key not in known:
                known[key] = ("bias", f"block:{block[e]}", *(["link"] if link[e] else []), *(["long"] if key[1] else []), *around[e])
            out.append(known[key])
        return out


class Weights:
    """word: feature -> weight; tag: section -> cost."""

    def __init__(self, word: dict[str, float] | None = None, tag: dict[str, float] | None = None):
        self.word = PRIOR if word is None else word
        self.tag = {k: TAG + EDGE * v for k, v in SECTIONS.items()} if tag is None else tag

    def scores(self, page: Page) -> list[float]:
        """Of each token; runs of negative words are scaled to cost BOX at most."""
        known: dict[tuple, float] = {}
        out, run, sum_ = [], [], 0.0

        def end() -> None:
            if sum_ < -BOX:
                for k in run:
                    out[k] *= BOX / -sum_

        for (kind, e, n, tag), features in zip(page.tokens, page.features(), strict=True):
            if kind == "w" and n:
                if features not in known:
                    block = sum(self.word.get(f, 0.0) for f in features if f[:3] not in ("in:", "nam", "hid"))
                    s = max(LEAST, min(MOST, block) + sum(self.word.get(f, 0.0) for f in features if f[:3] in ("in:", "nam", "hid")))
                    known[features] = s * (HEADING if s > 0 and features[1] in ("block:h1", "block:h2") else 1)
                s = known[features] * n
                if s < 0:
                    run.append(len(out))
                    sum_ += s
                else:
                    end()
                    run, sum_ = [], 0.0
                out.append(s)
            else:
                out.append(-self.tag.get(tag, TAG) if kind == "t" else 0.0)
        end()
        return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """(low, high) of the contiguous region with the highest positive sum, by one scan; (0, 0) if there is none. Of equal sums the first."""
    best, low, high, total, begin = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        total += s
        if total <= 0:
            total, begin = 0.0, k + 1
        elif total > best:
            best, low, high = total, begin, k + 1
    return low, high


def extract(source: str | None, weights: Weights) -> str:
    if not source:
        return ""
    page = Page(source)
    scores = weights.scores(page)
    low, high = best_region(scores)
    blocks, now = [], []
    for (kind, _, n, text), s in zip(page.tokens[low:high], scores[low:high], strict=True):
        if kind == "b":
            blocks.append("".join(now))
            now = []
        elif kind == "w" and (s >= 0 or not n):
            now.append(text)
    blocks.append("".join(now))
    return "\n\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def counted(source: str | None) -> list[tuple[str, str, float, float]]:
    """(kind, key, inside, outside) of a page that marks one article: for each set of features its share of the words inside and of those
    outside, for each section's tag how often it stands inside and how often outside or at the edge. Words inside that PRIOR
    takes for a box are in doubt and left out."""
    page = Page(source or "")
    if len(page.marks) != 1:
        return []
    mark = page.marks[0]
    inside = [False] * len(page.tag)
    for e in range(mark, len(page.tag)):
        inside[e] = e == mark or inside[page.parent[e]]
    words: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0])
    tags: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for (kind, e, n, tag), features in zip(page.tokens, page.features(), strict=True):
        if kind == "w" and n:
            if not inside[e] or sum(PRIOR.get(f, 0.0) for f in features) > 0:
                words[features][not inside[e]] += n
        elif kind == "t" and tag in SECTIONS:
            tags[tag][e == mark or not inside[e]] += 1
    total = [max(sum(v[k] for v in words.values()), 1.0) for k in (0, 1)]
    return [("w", " ".join(k), v[0] / total[0], v[1] / total[1]) for k, v in words.items()] + [("t", k, *v) for k, v in tags.items()]


def learn(counts: list[tuple[str, str, float, float]], rounds: int = 30) -> Weights:
    """The weights of highest posterior probability: normal around PRIOR with variance 1, by Newton's steps."""
    rows = sorted(r for r in counts if r[0] == "w")
    seen = sorted({f for _, k, _, _ in rows for f in k.split(" ")})
    place = {f: k for k, f in enumerate(seen)}
    prior = np.array([PRIOR.get(f, 0.0) for f in seen])
    x = np.zeros((len(rows), len(seen)))
    for i, r in enumerate(rows):
        x[i, [place[f] for f in r[1].split(" ")]] = 1
    a, b = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    w = prior.copy()
    for _ in range(rounds if rows else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (a * (1 - p) - b * p) - (w - prior)
        move = np.linalg.solve((x.T * ((a + b) * p * (1 - p))) @ x + np.eye(len(w)), gradient)
        w = w + move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
    tags = {k: [sum(r[j] for r in counts if r[:2] == ("t", k)) for j in (2, 3)] for k in SECTIONS}
    return Weights(PRIOR | dict(zip(seen, w.tolist(), strict=True)), {k: TAG + EDGE * (v[1] + PRIOR_TAGS * SECTIONS[k]) / (v[0] + v[1] + PRIOR_TAGS) for k, v in tags.items()})


def fit(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from about `sample` distinct pages that mark one article. What reaches the driver is a count for each set of features."""
    marked = pages.where(F.lower("html").rlike(r"<(article|main)[\s>]")).select("html", F.xxhash64(F.lit(4), "html").alias("h"))
    n = marked.agg(F.approx_count_distinct("h")).head()[0]
    drawn = marked.where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < min(1.0, sample / max(n, 1))).dropDuplicates(["h"]).select("html")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0):
                found = counted(source.as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=["kind", "key", "a", "b"])

    each = drawn.mapInArrow(step, "kind string, key string, a double, b double")
    sums = each.groupBy("kind", "key").agg(F.round(F.sum("a"), 6), F.round(F.sum("b"), 6))
    return learn([tuple(r) for r in sums.collect()])


def extract_pages(pages: DataFrame, weights: Weights) -> DataFrame:
    """pages without html and with text at the end. Other columns come back as they are, one named text as text_in."""
    own = packed(pages, "html")
    schema = own.drop("html").withColumn("_text", F.lit("")).schema
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(x.as_py(), sent.value) for x in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(1), texts], names=["_rest", "_text"])

    return unpacked(own.mapInArrow(step, schema), [c for c in pages.columns if c != "html"], (), text=F.col("_text"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
