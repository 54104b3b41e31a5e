"""Modal partitions of histograms: highest density, least entropy, closest median and mode, highest-density intervals.

Spark builds the histogram; a search sees its bins only, a few hundred numbers for each group, and runs in a grouped function.
Partitions are (first, mode, last) with inclusive bounds.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EPS = 2.220446049250313e-16
#: The most base intervals of an exhaustive search; it looks at up to 2 to this power of groupings.
MOST_BASE = 16
Part = tuple[int, int, int]


def argmax_last(values: np.ndarray, low: int, high: int) -> int:
    """Position of the largest of values[low:high]; of equal ones the last."""
    return high - 1 - int(np.argmax(values[low:high][::-1]))


def local_mode(p: np.ndarray, low: int, high: int, size: int) -> Part | None:
    """A window of exactly `size` bins in [low, high) around the largest; None if the range is shorter."""
    if high - low < size:
        return None
    mode = argmax_last(p, low, high)
    first = min(max(low, mode - size // 2), high - size)
    return first, mode, first + size - 1


def seeded(p: np.ndarray, size: int) -> list[Part]:
    """Windows by repeated search: each round adds the best window of all gaps."""
    found: list[Part] = []
    for _ in range(len(p) // size):
        edges = [-1, *[x for part in found for x in (part[0], part[2])], len(p)]
        gaps = [(edges[k] + 1, edges[k + 1]) for k in range(0, len(edges), 2)]
        options = [w for a, b in gaps if (w := local_mode(p, a, b, size))]
        if not options:
            break
        best = max(enumerate(options), key=lambda e: (p[e[1][1]], e[0]))[1]
        found = sorted([*found, best])
    return found


def mass(p: np.ndarray, part: Part) -> float:
    return float(p[part[0] : part[2] + 1].sum())


def merged(parts: list[Part], p: np.ndarray) -> list[Part]:
    """Overlapping or touching neighbours become one, with the larger mode."""
    out: list[Part] = []
    for part in sorted(parts):
        if out and part[0] <= out[-1][2] + 1:
            a = out.pop()
            mode = a[1] if p[a[1]] > p[part[1]] else part[1]
            part = (a[0], mode, max(a[2], part[2]))
        out.append(part)
    return out


def highest_density(
    p: np.ndarray, min_interval: int, step: int, min_prob: float, min_mode_ratio: float = 0.0, local_prob: float | None = None, modes: tuple[int, int] | None = None, recursive: bool = False
) -> list[Part]:
    """Regions of mass min_prob grown from the local modes.

    local_prob: regions count if they have so much each. modes: (least, most) regions of the smallest total width instead.
    Empty if no growth reaches the mass.
    """
    parts = seeded(p, min_interval)
    if not parts:
        return []
    top = max(p[x[1]] for x in parts)
    parts = [x for x in parts if p[x[1]] >= min_mode_ratio * top]
    while True:
        chosen = _pick(p, parts, min_prob, local_prob, modes)
        if chosen is None:
            return []
        if chosen:
            break
        width = sum(x[2] - x[0] + 1 for x in parts)
        parts = merged([(max(0, a - step), m, min(len(p) - 1, b + step)) for a, m, b in parts], p)
        if sum(x[2] - x[0] + 1 for x in parts) == width:
            return []
    if recursive:
        chosen = _split(p, chosen, min_interval, step, min_prob, min_mode_ratio, local_prob, modes)
    return _trimmed(p, chosen, min_interval, min_prob)


def _pick(p: np.ndarray, parts: list[Part], min_prob: float, local_prob: float | None, modes: tuple[int, int] | None) -> list[Part] | None:
    """The parts that hold the mass; empty if they do not yet, None if they never will."""
    if modes is None:
        some = [x for x in parts if mass(p, x) >= (local_prob or 0.0)]
        return some if sum(mass(p, x) for x in some) >= min_prob else []
    low, high = modes
    if len(parts) < low:
        return None
    if sum(mass(p, x) for x in parts) < min_prob:
        return []
    best, width = [], math.inf
    for n in range(low, min(high, len(parts)) + 1):
        for combo in itertools.combinations(parts, n):
            w = sum(x[2] - x[0] + 1 for x in combo)
            if w < width and sum(mass(p, x) for x in combo) >= min_prob:
                best, width = list(combo), w
    return best


def _split(p, chosen, min_interval, step, min_prob, ratio, local_prob, modes) -> list[Part]:
    out: list[Part] = []
    for k, part in enumerate(chosen):
        own = p[part[0] : part[2] + 1]
        inner = []
        if len(own) >= 2 * min_interval and own.sum() > 0:
            inner = [(a + part[0], m + part[0], b + part[0]) for a, m, b in highest_density(own / own.sum(), min_interval, step, min_prob, ratio, local_prob, modes)]
        others = out + chosen[k + 1 :]
        holds = sum(mass(p, x) for x in [*others, *inner]) >= min_prob
        out += inner if len(inner) >= 2 and holds else [part]
    return out


def _trimmed(p: np.ndarray, parts: list[Part], min_interval: int, min_prob: float) -> list[Part]:
    """One bin off both sides of each part while the mass holds, the part is wide enough and its mode stays inside."""
    parts = list(parts)
    moved = True
    while moved:
        moved = False
        for k, (a, m, b) in enumerate(parts):
            less = (a + 1, m, b - 1)
            if b - a + 1 > min_interval and less[2] - less[0] + 1 >= 1 and less[0] < m < less[2]:
                if sum(mass(p, x) for x in [*parts[:k], less, *parts[k + 1 :]]) >= min_prob:
                    parts[k], moved = less, True
    return parts


def base_intervals(p: np.ndarray, size: int) -> list[Part]:
    """Seeds stretched to cover all bins: gaps are shared half and half, the right half to the right; at most MOST_BASE stay."""
    seeds = seeded(p, size)
    if not seeds:
        return [(0, argmax_last(p, 0, len(p)), len(p) - 1)]
    cuts = [0] + [(a[2] + 1 + b[0] + 1) // 2 if b[0] - a[2] - 1 > 3 else b[0] for a, b in itertools.pairwise(seeds)] + [len(p)]
    out = [(a, s[1], b - 1) for (a, b), s in zip(itertools.pairwise(cuts), seeds, strict=True)]
    while len(out) > MOST_BASE:
        for k in range(len(out) - 2, -1, -2):
            if len(out) <= MOST_BASE:
                break
            a, b = out[k], out[k + 1]
            out[k : k + 2] = [(a[0], a[1] if p[a[1]] > p[b[1]] else b[1], b[2])]
    return out


def groupings(base: list[Part], p: np.ndarray, modes: tuple[int, int], most: int) -> list[list[Part]]:
    """All ways to cut the intervals into consecutive groups of at most `most`."""

    def joined(group: list[Part]) -> Part:
        m = max(enumerate(group), key=lambda e: (p[e[1][1]], e[0]))[1][1]
        return group[0][0], m, group[-1][2]

    n, out = len(base), []
    for k in range(max(1, modes[0]), min(modes[1], n) + 1):
        for cuts in itertools.combinations(range(1, n), k - 1):
            sizes = itertools.pairwise([0, *cuts, n])
            groups = [base[a:b] for a, b in sizes]
            if all(len(g) <= most for g in groups):
                out.append([joined(g) for g in groups])
    return out


def least_entropy(p: np.ndarray, modes: tuple[int, int], ranges: tuple[int, int]) -> list[Part]:
    """The cut with the smallest mean of (entropy of a part's bins / mass - ln mass); of equal ones the first."""
    h = -(p + EPS) * np.log(p + EPS)
    best, low = [], math.inf
    for parts in groupings(base_intervals(p, ranges[0]), p, modes, ranges[1] // ranges[0] + 1):
        masses = [max(mass(p, x), EPS) for x in parts]
        score = float(np.mean([h[x[0] : x[2] + 1].sum() / m - math.log(m) for x, m in zip(parts, masses, strict=True)]))
        if score < low - 1e-15:
            best, low = parts, score
    return best


def median_of(p: np.ndarray, part: Part) -> int:
    own = np.cumsum(p[part[0] : part[2] + 1])
    return part[0] + int(np.searchsorted(own, own[-1] / 2))


def closest_median_mode(p: np.ndarray, modes: tuple[int, int], ranges: tuple[int, int], max_distance: int, min_prob: float) -> list[Part]:
    """The cut with the smallest mean distance of mode and median over parts of mass min_prob; parts with less go in the end."""
    best, low = [], math.inf
    for parts in groupings(base_intervals(p, ranges[0]), p, modes, ranges[1] // ranges[0] + 1):
        far = [abs(x[1] - median_of(p, x)) for x in parts if mass(p, x) >= min_prob]
        if far and len(far) >= modes[0] and max(far) <= max_distance and float(np.mean(far)) < low - 1e-15:
            best, low = parts, float(np.mean(far))
    return [x for x in best if mass(p, x) >= min_prob]


def density_intervals(p: np.ndarray, step: int, min_width: int, n: int) -> list[Part]:
    """The n densest disjoint intervals of min_width bins or more, by mass over width; widths grow by step."""
    sums = np.concatenate(([0.0], np.cumsum(p)))
    options = sorted(((round(-(sums[b] - sums[a]) / (b - a), 12), a, b) for a in range(0, len(p), step) for b in range(a + min_width, len(p) + 1, step)))
    out: list[Part] = []
    for _, a, b in options:
        if len(out) == n:
            break
        if all(b <= x[0] or a > x[2] for x in out):
            out.append((a, argmax_last(p, a, b), b - 1))
    return sorted(out)


def normals(p: np.ndarray, domain: np.ndarray, parts: list[Part]) -> list[tuple[float, float, float]]:
    """(weight, mean, variance) of each part's bins."""
    out = []
    for a, _, b in parts:
        w, x = p[a : b + 1], domain[a : b + 1]
        total = float(w.sum())
        mean = float((w * x).sum() / max(total, EPS))
        out.append((total, mean, float((w * (x - mean) ** 2).sum() / max(total, EPS))))
    return out


def partitions(hist: DataFrame, search: Callable[[np.ndarray], list[Part]], by: list[str] | None = None) -> DataFrame:
    """(by, part, first, mode, last, mass) of dense histograms (bin, prop): the search runs on each group's bins."""
    by = by or []
    kinds = ", ".join(f"`{b}` {hist.schema[b].dataType.simpleString()}" for b in by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("bin")["prop"].to_numpy(float)
        rows = [(*key, k, *x, mass(p, x)) for k, x in enumerate(search(p))]
        return pd.DataFrame(rows, columns=[*by, "part", "first", "mode", "last", "mass"])

    return hist.select(*by, "bin", "prop").groupBy(*by).applyInPandas(run, ", ".join(x for x in (kinds, "part int, first int, mode int, last int, mass double") if x))
