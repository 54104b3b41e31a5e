"""Brute-force versions of the training-data operators in plain Python, written without their code."""

import math
import re
from collections import Counter
from itertools import combinations, product

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def bags(texts, n=5):
    """Each text's shingles of n words (or all, if it has fewer) and how often it has them."""
    out = []
    for t in texts:
        w = WORD.findall(lowered(t))
        out.append(Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else []))
    return out


def weighted_jaccard(texts, damp, floor):
    """Similarity of all pairs: counts times 1 + damp * idf, idf from the share of documents, 1 from the share `floor` down."""
    found = bags(texts)
    n = sum(1 for b in found if b)
    df = Counter(s for b in found for s in b)
    rarest = max(floor(sum(len(b) for b in found)), 1) / max(n, 1)

    def weight(s):
        top = math.log(1 / min(rarest, 1))
        return 1 + damp * min(max(math.log(n / df[s]) / top, 0), 1) if top > 0 else 1.0

    heavy = [{s: c * weight(s) for s, c in b.items()} for b in found]
    total = [sum(b.values()) for b in heavy]
    for i, j in combinations(range(len(texts)), 2):
        if heavy[i] and heavy[j]:
            both = sum(min(w, heavy[j][s]) for s, w in heavy[i].items() if s in heavy[j])
            yield i, j, both / (total[i] + total[j] - both)


def classes(texts, similar, words=lowered):
    """Least index of each text's class, by the pairs that are similar and equal texts."""
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(i, j):
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)

    for i, j in similar:
        join(i, j)
    seen = {}
    for k, t in enumerate(texts):
        key = " ".join(WORD.findall(words(t))) if t is not None and WORD.search(words(t)) else (t,)
        join(seen.setdefault(key, k), k) if t is not None else None
    return [root(k) for k in range(len(texts))]


def targets(sizes, weights=(5, 2, 1), ceiling=3):
    """source -> target from source -> size: shares by weight, what is above the ceiling shared again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if share * w[s] > ceiling * sizes[s]}
        if not over:
            out |= {s: share * w[s] for s in open_}
            break
        for s in over:
            out[s] = float(ceiling * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def hits(text, items, window=10):
    """(hit word numbers, ids that occur) of a text; items: (id, text)."""
    w = WORD.findall(lowered(text))
    hit, ids = set(), set()
    for item, t in items:
        b = WORD.findall(lowered(t))
        n = min(window, len(b))
        own = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else []:
            if tuple(w[k : k + n]) in own:
                hit |= set(range(k, k + n))
                ids.add("null" if item is None else str(item))
    return hit, sorted(ids)


def chain_marginals(unary, move):
    """P(label 1) of each place of a chain, by the sum over all labelings. unary: score of label 1; move: [from][to]."""
    n = len(unary)
    total, ones = 0.0, [0.0] * n
    for y in product((0, 1), repeat=n):
        p = math.exp(sum(u for u, k in zip(unary, y, strict=True) if k) + sum(move[a][b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        for k in range(n):
            ones[k] += p * y[k]
    return [x / total for x in ones]


def segmentations(word, p):
    """Sum over all ways to cut the bytes into pieces of the product of their probabilities."""
    if not word:
        return 1.0
    return sum(p[word[:k]] * segmentations(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


def best_region(scores):
    """(sum, low, high) of the best contiguous region; of equal sums the first and shortest."""
    best = (0.0, 0, 0)
    for low in range(len(scores)):
        total = 0.0
        for high in range(low + 1, len(scores) + 1):
            total += scores[high - 1]
            if total > best[0] + 1e-9:
                best = (total, low, high)
    return best
