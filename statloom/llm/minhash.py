"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are runs of WORDS words (A-Z lower-cased); a text of fewer words is one shingle. A shingle weighs its number in
the text times 1 + DAMP * idf, with idf in [0, 1]. The idf is damped because near copies share their shingles and not their
edits: undamped, a group of thousands of copies would lower the weight of all that its members share, and push them below
the threshold. Document frequencies of all documents are counted in CELLS cells by hash, a sketch of fixed size however
large the corpus. The idf goes by the share of documents that have a shingle, so it does not change as a corpus grows; shares
below the mean load of a cell (about one document in CELLS / mean number of shingles) rank as fully rare.

BANDS bands of ROWS samples find a pair at similarity 0.8 with probability 0.998, at 0.9 with 0.99999. Texts of equal words
are one vertex of a graph. Two exact bounds let texts and pairs leave before they are compared, and nothing else does. Of every
text in a bucket with another, the weight is summed of its shingles that no other such text has: these cannot be shared, so with
weights w and shareable weights s a pair is similar at most min(s, s') / (w + w' - min(s, s')). And each text's weight is
summed by CLASSES classes of shingles: two texts share at most the sum of the smaller ones.

In a band's bucket every member is then compared with a hub, the member with the least share of its own; what is similar to it
joins its class. Buckets whose members are in one class are done. The others go on with 64 and then MOST_HUBS hubs against
the members of other classes until every hub has met every one: no candidate pair of different classes that the bounds allow
stays unverified, and a group of copies costs about as many comparisons as it has members. Classes are connected components of
the verified links. Members of large buckets and rows of large groups are spread over tasks.

A text moves only if a sketch of bits says that it may have a partner: of all rows with text, those outside it stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.llm import textscan as T
from statloom.llm.common import HOT, numbered, packed, scratch, spread_join, table, unpacked, written

WORDS = 5
SIMILARITY = 0.8
BANDS = 12
ROWS = 4
CELLS = 1 << 18
CHUNK = 1 << 10
DAMP = 0.5
#: What sums of weights may be off by rounding.
SLACK = 1e-4
#: The most hubs of a bucket in one round.
MOST_HUBS = 1000
#: Classes of shingles of the bound by classes.
CLASSES = 128
BLOCK = 1 << 18
#: Links whose components one task finds; more take star rounds over tables. Both are exact.
MOST_LINKS = 300_000
#: The most rows of a sketch of keys, 64 bits each; keys beyond 8 for each row only let more rows pass it.
MOST_MASKS = 1 << 17
#: Bits of a shingle's hash; the others hold the row, of which a block has at most BLOCK.
_BITS = np.uint64(44)

_rng = np.random.default_rng(20_240_518)
_SPREAD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_BETA = _rng.random(1 << 16).astype(np.float32)


def shingles(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, hashes, counts) of the distinct shingles of each row, in order of row and hash, and two hashes of each row's words."""
    h, bounds = T.scan(data, at, T.ALNUM, T.LOWER)
    n = np.diff(bounds)
    s = T.windows(h, words)[T.inside(bounds, words)]
    rows = np.repeat(np.arange(len(n)), np.maximum(n - words + 1, 0))
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for size in range(1, words):
            w = T.windows(h, size)
            k = n[short] == size
            own[k] = w[bounds[:-1][short[k]]]
        s, rows = np.concatenate((s, own)), np.concatenate((rows, short))
    both = np.sort((rows.astype(np.uint64) << _BITS) | (s >> (np.uint64(64) - _BITS)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    first = np.flatnonzero(new)
    found = both[first]
    prints = np.zeros((len(n), 2), np.uint64)
    if len(h):
        with np.errstate(over="ignore"):
            place = (np.arange(len(h)) - np.repeat(bounds[:-1], n)).astype(np.uint64)
            for k in range(2):
                sums = np.concatenate(([np.uint64(0)], np.cumsum(T.mixed(h + (place + np.uint64(1)) * T.FACTORS[40 + k]))))
                prints[:, k] = T.mixed(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64))
    return (found >> _BITS).astype(np.int64), found << (np.uint64(64) - _BITS), np.diff(np.append(first, len(s))), prints


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def frequencies(docs: DataFrame) -> np.ndarray:
    """Weights by cell: 1 + DAMP * idf. One pass over all texts; the sketch is all that moves, CELLS numbers for each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            data, at = T.buffers(batch.column(0))
            for lo, hi in T.groups(at, BLOCK):
                rows, s, _, _ = shingles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                total += np.bincount(_cells(s), minlength=CELLS)
                n += len(np.unique(rows))
        parts = [(k, p.tobytes()) for k, p in enumerate(total.reshape(-1, CHUNK)) if p.any()]
        parts.append((-1, np.array([n], np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["chunk", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(p, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([p.tobytes() for p in total.values()], pa.binary())], names=["chunk", "n"])

    kind = "chunk int, n binary"
    found = docs.select("text").mapInArrow(count, kind).repartition("chunk").mapInArrow(add, kind).collect()  # CELLS numbers
    n, counts = 0, np.zeros((CELLS // CHUNK, CHUNK), np.int64)
    for k, p in found:
        if k < 0:
            n = int(np.frombuffer(p, np.int64)[0])
        else:
            counts[k] = np.frombuffer(p, np.int64)
    share = np.maximum(counts.ravel(), 1) / max(n, 1)
    rarest = max(counts.sum() / CELLS, 1) / max(n, 1)
    idf = np.clip(np.log(1 / np.minimum(share, 1)) / max(np.log(1 / min(rarest, 1)), 1e-9), 0, 1)
    return (1 + DAMP * idf).astype(np.float32)


def samples(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bands' keys [rows, BANDS] of rows that begin at starts (none empty).

    A sample is the shingle k and step t with the least a = c / (y * exp(r)), ln y = r * (t - beta), t = floor(ln w / r + beta);
    r, c and beta of a shingle and sample come from tables of 2^16 draws by a hash of both.
    """
    log_w = np.log(weights).astype(np.float32)
    low = (hashes >> np.uint64(24)).astype(np.uint32)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    ordered = np.empty(len(hashes), np.uint64)
    halves = ordered.view(np.uint32)  # the upper half is the second
    with np.errstate(over="ignore"):
        for j in range(BANDS * ROWS):
            k = ((hashes * _SPREAD[j]) >> np.uint64(48)).view(np.int64)
            r, beta = _R.take(k), _BETA.take(k)
            t = log_w / r
            t += beta
            np.floor(t, out=t)
            beta -= t
            beta -= np.float32(1)
            beta *= r
            beta += _LOG_C.take(k)
            beta += np.float32(128)  # log a + 128, which is positive: its bits are in its order
            halves[1::2] = beta.view(np.uint32)
            halves[::2] = (t.view(np.uint32) * np.uint32(0x9E3779B1)) ^ low
            least = np.minimum.reduceat(ordered, starts) & np.uint64(0xFFFFFFFF)
            keys[:, j // ROWS] += (least + np.uint64(1)) * T.FACTORS[j % ROWS + 3]
        return T.mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * T.FACTORS[20])


def sketched(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(id, th, f1, f2, w, bands): one row for each row with text; f1 and f2 are hashes of its words, w its weight, bands is null if it has none."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, total, bands = [np.zeros((0, 2), np.uint64)], [np.zeros(0)], []
            data, at = T.buffers(batch.column(2))
            for lo, hi in T.groups(at, BLOCK):
                rows, s, n, f = shingles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                some = np.unique(rows)
                w = n * sent.value[_cells(s)]
                keys = samples(s, w, np.searchsorted(rows, some)) if len(some) else np.zeros((0, BANDS), np.uint64)
                total.append(np.bincount(rows, w, hi - lo))
                own: list = [None] * (hi - lo)
                for k, x in zip(some.tolist(), keys.view(np.int64), strict=True):
                    own[k] = x
                prints.append(f)
                bands += own
            f = np.concatenate(prints).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(np.concatenate(total)), pa.array(bands, pa.list_(pa.int64()))], names=["id", "th", "f1", "f2", "w", "bands"])

    keyed = _keyed(docs).where(F.col("text").isNotNull()).select("id", "th", "text")
    out = keyed.mapInArrow(step, "id bigint, th bigint, f1 bigint, f2 bigint, w double, bands array<bigint>")
    # texts without words are equal only as they stand
    return out.withColumn("f1", F.when(F.col("bands").isNull(), F.col("th")).otherwise(F.col("f1"))).withColumn("f2", F.when(F.col("bands").isNull(), F.lit(0)).otherwise(F.col("f2")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("id"), F.xxhash64("text").alias("th"), "text")


def unshared(texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """(v, u): the weight of each text's shingles that no other of the texts has; texts without such shingles are left out."""
    sent = texts.sparkSession.sparkContext.broadcast(weights)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_numpy()
            data, at = T.buffers(batch.column(1))
            for lo, hi in T.groups(at, BLOCK):
                rows, s, n, _ = shingles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(v[lo + rows]), pa.array((n * sent.value[_cells(s)]).astype(np.float32))], names=["s", "v", "w"])

    each = texts.select("v", "text").mapInArrow(step, "s bigint, v bigint, w float")
    once = each.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v"), F.max("w").alias("w")).where("n = 1")
    return once.groupBy("v").agg(F.sum(F.col("w").cast("double")).alias("u"))


def profiles(texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """(v, profile): each text's weight by CLASSES classes of shingles."""
    sent = texts.sparkSession.sparkContext.broadcast(weights)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [np.zeros((0, CLASSES), np.float32)]
            data, at = T.buffers(batch.column(1))
            for lo, hi in T.groups(at, BLOCK):
                rows, s, n, _ = shingles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                of = (s >> np.uint64(22)).astype(np.int64) % CLASSES
                sums.append(np.bincount(rows * CLASSES + of, n * sent.value[_cells(s)], (hi - lo) * CLASSES).reshape(-1, CLASSES).astype(np.float32))
            flat = np.concatenate(sums)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * CLASSES, pa.array(flat.ravel()))], names=["v", "profile"])

    return texts.select("v", "text").mapInArrow(step, "v bigint, profile array<float>")


def similarity(batch_a: pa.Array, batch_b: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of two columns, row by row."""
    out = []
    (da, aa), (db, ab) = T.buffers(batch_a), T.buffers(batch_b)
    for lo, hi in T.groups(aa + ab, 2 * BLOCK):
        ra, sa, na, _ = shingles(da[aa[lo] : aa[hi]], aa[lo : hi + 1] - aa[lo])
        rb, sb, nb, _ = shingles(db[ab[lo] : ab[hi]], ab[lo : hi + 1] - ab[lo])
        w = np.concatenate((na * weights[_cells(sa)], nb * weights[_cells(sb)])).astype(float)
        rows, s = np.concatenate((ra, rb)), np.concatenate((sa, sb))
        order = np.lexsort((s, rows))
        r, s, v = rows[order], s[order], w[order]
        k = np.flatnonzero((r[1:] == r[:-1]) & (s[1:] == s[:-1]))
        both = np.bincount(r[k], np.minimum(v[k], v[k + 1]), hi - lo)
        total = np.bincount(rows, w, hi - lo)
        out.append(both / np.maximum(total - both, 1e-300))
    return np.concatenate(out) if out else np.zeros(0)


def verified(pairs: DataFrame, texts: DataFrame, weights: np.ndarray, least: float) -> DataFrame:
    """(a, b) of the pairs whose texts are similar. texts: v, text."""
    sent = pairs.sparkSession.sparkContext.broadcast(weights)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array(similarity(batch.column(2), batch.column(3), sent.value) >= least - 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    both = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(step, "a bigint, b bigint")


def components(links: DataFrame, rounds: int | None = None, most: int = MOST_LINKS) -> DataFrame:
    """(v, c): every vertex of the links (a, b) but the least of its component, and that least one.

    Up to `most` links are one task's work. More take large-star and small-star rounds, each written to the shared folder; edges
    stay as many as vertices after the first. With `rounds` these stop early: c is then connected with v, but not always the least.
    links must be written tables.
    """
    if links.count() <= most:
        return _joined(links)
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges, before = written(edges, "near-edges"), None
    while True:
        if rounds is None:
            mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).head()
            if mark == before:
                return edges.select(F.col("a").alias("v"), F.col("b").alias("c"))
            before = mark
        elif rounds == 0:
            return edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c"))
        else:
            rounds -= 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("_n"))
        large = spread_join(both.where("b > a"), written(least, "near-least"), ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large.where("a > b"), "near-large")
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        met = large.join(low, F.col("a") == F.col("u"))
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
        edges = written(small.where("a > b").distinct(), "near-edges")


def _joined(links: DataFrame) -> DataFrame:
    """components() in one task, without an exchange: every root takes the least root that it meets, until all that meet are one."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
        ids, ends = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *parts], axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        root = np.arange(len(ids))
        while (root[a] != root[b]).any():
            low, at = np.minimum(root[a], root[b]), root.copy()
            np.minimum.at(root, at[a], low)
            np.minimum.at(root, at[b], low)
            while (root != root[root]).any():
                root = root[root]
        k = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(ids[root[k]])], names=["v", "c"])

    return links.select("a", "b").coalesce(1).mapInArrow(step, "v bigint, c bigint")


def _parted(rows: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows that may have one of keys (a written table), and rows that have none. A sketch of bits tells them apart; no row moves."""
    masks = min(MOST_MASKS, 1 << max(keys.count() // 8, 1).bit_length())
    h = F.xxhash64(F.lit(13), *columns)
    at, bit = F.pmod(F.shiftright(h, 6), F.lit(masks)), h.bitwiseAND(F.lit(63)).cast("int")
    marks = keys.select(at.alias("_at"), bit.alias("_bit")).groupBy("_at").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mask"))
    marks = F.broadcast(written(marks, "near-marks"))  # MOST_MASKS rows at most
    met = rows.join(marks, at == F.col("_at"), "left").withColumn("_in", F.coalesce(F.getbit("_mask", bit) == 1, F.lit(False)))
    return met.where("_in").select(*rows.columns), met.where("NOT _in").select(*rows.columns)


def _several(members: DataFrame) -> DataFrame:
    """The members of buckets with more than one."""
    shared = written(members.groupBy("b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "near-shared")
    return spread_join(members, shared, ["b"], large=True)


def _open(m: DataFrame, least: float) -> DataFrame:
    """The members that may still be similar to one of another class in their bucket: their bound with the bucket's lightest text reaches the threshold."""
    low = m.groupBy("b").agg(F.min("w").alias("_w"), F.min("c").alias("_low"), F.max("c").alias("_high"), F.count(F.lit(1)).alias("_n")).where("_low < _high")
    some = spread_join(m, written(low.select("b", "_w", "_n"), "near-low"), ["b"])
    some = some.where(F.col("s") >= (least - SLACK) * (F.col("w") + F.greatest(F.lit(0.0), F.col("_w") - F.col("s")))).drop("_w")
    some = written(some, "near-some")
    still = some.groupBy("b").agg(F.min("c").alias("_low"), F.max("c").alias("_high"), F.count(F.lit(1)).alias("_n")).where("_low < _high")
    return written(spread_join(some, written(still.select("b", "_n"), "near-still"), ["b"]), "near-open")


def _salted(m: DataFrame, total: int, hub: DataFrame, hubs: int) -> tuple[DataFrame, DataFrame]:
    """Members (total of them) and hubs with a column `salt`: a large bucket's members are dealt over several salts, and its hubs (hubs at most) stand at each of them."""
    sizes = m.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    large = max(total / HOT, 1000 / min(hubs, 10))
    hot = written(sizes.where(F.col("n") > large).select(F.col("b").alias("_hb"), F.ceil(F.col("n") / large).cast("int").alias("_k")), "near-hot")  # fewer than 10 * HOT buckets
    mine = m.join(F.broadcast(hot), F.col("b") == F.col("_hb"), "left").withColumn("salt", F.pmod(F.xxhash64(F.lit(11), "v"), F.coalesce("_k", F.lit(1)))).drop("_hb", "_k")
    theirs = hub.join(F.broadcast(hot), F.col("_b") == F.col("_hb"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_k", F.lit(1)).cast("long") - 1))).drop("_hb", "_k")
    return mine, theirs


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(id, th, n, class_id, class_size, first): one row for each distinct (doc_id, text) with text; n rows have both.

    class_id is the least id of the class; first marks one row of each class, the one with the least (id, th). A doc_id of null is -1.
    """
    with scratch(docs.sparkSession):
        return written(_classes(docs, least), "near-classes", keep=True)


def _classes(docs: DataFrame, least: float) -> DataFrame:
    weights = frequencies(docs)
    rows = written(sketched(docs, weights), "near-rows")
    each = written(rows.groupBy("id", "th", "f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("w", "bands")).alias("k")), "near-each")
    texts = each.groupBy("f1", "f2").agg(F.min(F.struct("id", "th", "n", "k")).alias("r"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("copies"))
    texts = written(texts.select(F.monotonically_increasing_id().alias("v"), "f1", "f2", "r.id", "r.th", "r.n", "r.k.w", "r.k.bands", "rows", "copies"), "near-texts")
    kept = texts.where("bands IS NOT NULL").select("v", F.explode("bands").alias("b"))
    members = written(_several(kept), "near-members")
    wanted = members.select(F.col("v").alias("_v")).distinct().join(texts.select("v", "id", "th", F.col("n").alias("_n")), F.col("v") == F.col("_v")).drop("_v")
    own = _keyed(docs).where(F.col("text").isNotNull())
    wanted = written(wanted, "near-wanted")
    candidates = written(spread_join(_parted(own, wanted, ["id", "th"])[0], wanted, ["id", "th"], large=True).select("v", "text").dropDuplicates(["v"]), "near-candidates")
    alone = unshared(candidates, weights).withColumnRenamed("v", "_v")
    able = candidates.select("v").join(texts.select(F.col("v").alias("_t"), "w"), F.col("v") == F.col("_t")).drop("_t")
    able = able.join(alone, F.col("v") == F.col("_v"), "left").select(F.col("v").alias("_v"), "w", (F.col("w") - F.coalesce("u", F.lit(0.0))).alias("s"))
    able = able.where(F.col("s") >= (least - SLACK) * F.col("w"))
    members = written(_several(members.join(able, F.col("v") == F.col("_v")).select("b", "v", "w", "s")), "near-able")

    left = members.select(F.col("v").alias("_v")).distinct()
    prints = texts.join(left, F.col("v") == F.col("_v")).select(F.col("v").alias("p"), "bands")
    shapes = profiles(candidates.join(left, F.col("v") == F.col("_v")), weights)
    prints = written(prints.join(shapes, F.col("p") == F.col("v")).select("p", "bands", "profile"), "near-prints")
    hubs, links, label = 1, None, None
    order = F.struct((1 - F.col("s") / F.col("w")).alias("alone"), "v")
    while True:
        m = members.withColumn("c", F.col("v")) if label is None else members.join(label.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v"), "left").select("b", "v", "w", "s", F.coalesce("c", "v").alias("c"))
        m = _open(written(m, "near-labelled"), least)
        total = m.count()
        if not total:
            break
        if hubs == 1:
            hub = m.groupBy(F.col("b").alias("_b")).agg(F.min(F.struct(order.alias("o"), "v", "w", "s", "c")).alias("h")).select("_b", F.col("h.v").alias("h"), F.col("h.w").alias("hw"), F.col("h.s").alias("hs"), F.col("h.c").alias("hc"))
        else:
            # each task sends on no more than `hubs` rows of a bucket, and salts share them once more
            salted = m.withColumn("_salt", F.pmod(F.xxhash64(F.lit(12), "v"), F.lit(32)))
            some = salted.withColumn("k", F.row_number().over(Window.partitionBy("b", "_salt").orderBy(order))).where(F.col("k") <= hubs).drop("k", "_salt")
            ranked = some.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy(order)))
            hub = ranked.where(F.col("k") <= hubs).select(F.col("b").alias("_b"), F.col("v").alias("h"), F.col("w").alias("hw"), F.col("s").alias("hs"), F.col("c").alias("hc"))
        hub = written(hub, "near-hubs")
        both = F.least("s", "hs")
        # hubs come first in the order, so this keeps every pair with a hub, and a pair of hubs once
        later = F.struct((1 - F.col("hs") / F.col("hw")).alias("alone"), F.col("h").alias("v")) < order
        able = lambda shared: shared >= (least - SLACK) * (F.col("w") + F.col("hw") - shared)
        # a pair that shares several buckets meets in the first of them, which stays open for it
        first = F.get("bands", (F.array_position(F.zip_with("bands", "hbands", lambda x, y: x == y), True) - 1).cast("int")) == F.col("b")
        shared = F.aggregate(F.zip_with("profile", "hprofile", lambda x, y: F.least(x, y).cast("double")), F.lit(0.0), lambda n, x: n + x)
        mine, theirs = _salted(m, total, hub, hubs)
        mine = mine.join(prints, F.col("v") == F.col("p")).drop("p")
        theirs = theirs.join(prints, F.col("h") == F.col("p")).drop("p").withColumnsRenamed({"bands": "hbands", "profile": "hprofile"})
        pairs = mine.join(theirs, (F.col("b") == F.col("_b")) & (F.col("salt") == F.col("_salt")) & later & (F.col("c") != F.col("hc")) & able(both) & first & able(shared))
        pairs = pairs.select(F.greatest("v", "h").alias("a"), F.least("v", "h").alias("b")).distinct()
        found = written(verified(written(pairs, "near-pairs"), candidates, weights, least), "near-links")
        links = found if links is None else links.unionByName(found)
        if label is None or not found.isEmpty():
            # labels that are not yet the least of their class only make more pairs meet
            label = written(components(links if label is None else found.unionByName(label.select(F.col("v").alias("a"), F.col("c").alias("b"))), 2), "near-labels")
        members = m.select("b", "v", "w", "s").join(hub.select("_b", F.col("h").alias("_h")), (F.col("b") == F.col("_b")) & (F.col("v") == F.col("_h")), "left_anti")
        hubs = min(MOST_HUBS, hubs * 64)

    label = None if links is None else components(links)
    of = texts.select("v", "f1", "f2", "id", "th", "rows", "copies")
    of = of.withColumn("c", F.col("v")) if label is None else of.join(label.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v"), "left").withColumn("c", F.coalesce("c", "v")).drop("_v")
    of = written(of, "near-of")
    sizes = written(of.groupBy("c").agg(F.min(F.struct("id", "th")).alias("low"), F.sum("rows").alias("class_size"), F.count(F.lit(1)).alias("_n")), "near-sizes")
    of = written(spread_join(of, sizes, ["c"], large=True).select("f1", "f2", "low", "class_size", F.col("copies").alias("_n")), "near-low")
    out = spread_join(each.drop("k"), of, ["f1", "f2"], large=True)
    return out.select("id", "th", "n", F.col("low.id").alias("class_id"), "class_size", (F.struct("id", "th") == F.col("low")).alias("first"))


def _classified(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """docs packed: its rows with text with n, class_id, class_size and first of their (doc_id, text), and those without. Rows that are a class alone do not move."""
    found = classes(docs.select("doc_id", "text"), least).where("class_size > 1")
    f = found.select(F.col("id").alias("_i"), F.col("th").alias("_t"), F.col("n").alias("_rows"), F.col("n").alias("_n"), F.struct("class_id", "class_size", "first").alias("_k"))
    own = packed(docs, "doc_id", "text").withColumn("_i", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")))
    has = own.where(F.col("text").isNotNull()).withColumn("_t", F.xxhash64("text"))
    some, alone = _parted(has, f, ["_i", "_t"])
    one, single = F.lit(1).cast("long"), F.struct(F.col("_i").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("first"))
    some = spread_join(some, f, ["_i", "_t"], how="left", large=True)
    some = some.withColumns({"_rows": F.coalesce("_rows", one), "_k": F.coalesce("_k", single)})
    return some.unionByName(alone.withColumns({"_rows": one, "_k": single})), own.where(F.col("text").isNull())


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with class_id, class_size and is_first, one row for each row of docs.

    Null text is like nothing else: a class of its own with class_id doc_id. Texts without words are copies only if equal.
    Rows that repeat doc_id and text are copies of one another; one of them, chosen by no rule, is first. An empty table gives
    an empty result. Other columns come back as they are; one named as a column of the result with `_in` behind its name.
    """
    both, none = _classified(docs, least)
    k = F.col("_k")
    shape = lambda df, **made: unpacked(df, docs.columns, ("doc_id", "text"), **made)
    once = shape(both.where("_rows = 1 OR NOT _k.first"), class_id=k["class_id"], class_size=k["class_size"], is_first=k["first"])
    many = numbered(both.where("_rows > 1 AND _k.first"), ["_i", "_t"], "_number")
    many = shape(many, class_id=k["class_id"], class_size=k["class_size"], is_first=F.col("_number") == 1)
    none = shape(none, class_id=F.col("_i"), class_size=F.lit(1).cast("long"), is_first=F.lit(True))
    return once.unionByName(many).unionByName(none)


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class; rows without text stay. The columns are those of docs; see near_duplicates."""
    both, none = _classified(docs, least)
    first = both.where("_k.first")
    once, many = first.where("_rows = 1"), first.where("_rows > 1").dropDuplicates(["_i", "_t"])
    shape = lambda df: unpacked(df, docs.columns, ("doc_id", "text"))
    return shape(once).unionByName(shape(many)).unionByName(shape(none))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, the least doc_id of its class, the class's rows, whether it is the one kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classes(docs)
    each = found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "first", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    each = each.select("doc_id", "class_id", "class_size", (F.col("first") & (F.col("k") == 1)).alias("kept"))
    none = docs.where(F.col("text").isNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("doc_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return each.unionByName(none.withColumn("class_id", F.col("doc_id")).select("doc_id", "class_id", "class_size", "kept"))
