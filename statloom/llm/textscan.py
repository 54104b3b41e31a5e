"""Words and their hashes out of Arrow string columns, by numpy over the bytes: no Python loop over words.

A text is taken in blocks of a few MB that end outside a word, so memory is bounded by the block and by 8 bytes for each
word of the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21

_rng = np.random.default_rng(20_240_517)
#: Random odd factors; the same on every worker.
FACTORS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = FACTORS[0]
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased: digits, letters and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Word bytes of [^\x20\x09-\x0D]+.
VISIBLE = np.ones(256, bool)
VISIBLE[[32, 9, 10, 11, 12, 13]] = False


def translated(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for bytes and a table of 256 bytes or booleans; several times as fast."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, _BASE))))
        down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, _INVERSE))))
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well spread bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def spans(data: np.ndarray, cuts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data; a word ends at each of cuts (sorted positions)."""
    mask = translated(data, is_word)
    if not mask.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:-1]
    last[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    up, down = _powers(1 << max(len(data), 1).bit_length())
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(up[: len(data)] * data, out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * FACTORS[1])


def groups(at: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about block bytes each, or one row with more."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + block, "right")) - 1)
        yield lo, hi
        lo = hi


def scan(data: np.ndarray, at: np.ndarray, is_word: np.ndarray, lower: np.ndarray | None = None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows of data (bounds: at), and the row bounds among them."""
    found, counts = [], np.zeros(len(at) - 1, np.int64)
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + block)
        while hi < n and hi not in (at[np.searchsorted(at, hi)],):
            # to the next byte outside a word, or a row's end
            ahead = data[hi : hi + 4096] if lower is None else lower[data[hi : hi + 4096]]
            stop = np.flatnonzero(~is_word[ahead])
            row_end = at[np.searchsorted(at, hi)]
            if len(stop):
                hi = int(min(row_end, hi + stop[0]))
                break
            hi = int(min(row_end, hi + len(ahead)))
        part = data[lo:hi] if lower is None else translated(data[lo:hi], lower)
        inner = at[np.searchsorted(at, lo) : np.searchsorted(at, hi, "right")] - lo
        s, e = spans(part, inner, is_word)
        found.append(hashes(part, s, e))
        if len(s):
            rows = np.searchsorted(at, s + lo, "right") - 1
            counts += np.bincount(rows, minlength=len(counts))
        lo = hi
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words (len(words) - n + 1 of them; a run may cross rows: mask those)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[: len(words) - n + 1] * FACTORS[2]
        for j in range(1, n):
            out = out + words[j : len(words) - n + 1 + j] * FACTORS[2 + j]
        return mixed(out)


def inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """Which runs of n words, as windows() numbers them, lie within one row."""
    total = int(bounds[-1])
    if total < n:
        return np.zeros(0, bool)
    ok = np.zeros(total + 1, np.int32)
    size = np.diff(bounds)
    has = size >= n
    np.add.at(ok, bounds[:-1][has], 1)
    np.add.at(ok, bounds[:-1][has] + (size[has] - n + 1), -1)
    return np.cumsum(ok)[: total - n + 1] > 0
