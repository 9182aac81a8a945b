"""Document fingerprints: digests of improbable features in chained Bloom filters.

A feature is a window of ``WINDOW`` bytes of UTF-8. Its entropy is the collision entropy of its bytes, known from the
number of equal pairs in it. A first pass over all documents counts how frequent each entropy is; the rarer, the lower
a window's rank. Windows under ``LEAST_BITS`` of entropy come last. Among every ``NEIGHBOURS`` windows in a row the
leftmost of least rank gains a point; windows with ``POPULAR`` points, and all windows of texts under ``DENSE`` bytes,
are selected; if a text has none, all windows with a point. Their hashes set 5 of 2048 bits of
a Bloom filter; a filter takes 160 features, then the next one begins. The likeness of two digests is, for each filter
of the one with fewer filters, its best overlap of bits beyond chance with a filter of the other, on the mean.

Texts shorter than the least length that yields a feature are padded with zero bytes, so null and empty texts have one
digest of their own. Equal texts have equal digests. No text is cut.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, over_batches, texts

WINDOW = 16
NEIGHBOURS = 32
POPULAR = 5
LEAST_BITS = 2.0
#: Texts of fewer bytes take all their windows.
DENSE = 256
BITS, PER_FILTER, HASHES = 2048, 160, 5
PAIRS = WINDOW * (WINDOW - 1) // 2 + 1
SHORTEST = WINDOW + NEIGHBOURS + POPULAR
#: Bytes that are processed at a time.
PIECE = 1 << 22
#: Ranges of ids for each shuffle partition; the next document is found inside a range.
RANGES = 4


def equal_pairs(x: np.ndarray) -> np.ndarray:
    """For each window of bytes: how many pairs of its bytes are equal."""
    n = len(x)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (x[:-lag] == x[lag:]).view(np.uint8)
        ahead[:-lag] += same
        behind[lag:] += same
    first = sum(int((x[:WINDOW][: WINDOW - lag] == x[lag:WINDOW]).sum()) for lag in range(1, WINDOW))
    change = behind[WINDOW:].astype(np.int32) - ahead[: n - WINDOW]
    out = np.empty(n - WINDOW + 1, np.int32)
    out[0] = first
    np.cumsum(change, out=out[1:])
    out[1:] += first
    return out


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    padded = [p if len(p) >= SHORTEST else p + bytes(SHORTEST - len(p)) for p in parts]
    return np.frombuffer(b"".join(padded), np.uint8), np.cumsum([0, *map(len, padded)])


def _starts(at: np.ndarray, length: int) -> np.ndarray:
    """True where a stretch of so many positions lies within one text."""
    ok = np.ones(at[-1] - length + 1, bool)
    for end in at[1:-1]:
        ok[max(end - length + 1, 0) : end] = False
    return ok


def _pieces(parts: list[bytes]):
    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p)
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def entropy_counts(parts: list[bytes]) -> np.ndarray:
    out = np.zeros(PAIRS, np.int64)
    for some in _pieces(parts):
        x, at = _joined(some)
        out += np.bincount(equal_pairs(x)[_starts(at, WINDOW)], minlength=PAIRS)
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """A rank for each number of equal pairs: rare ones first, windows of little entropy last."""
    pairs = np.arange(PAIRS)
    bits = -np.log2((WINDOW + 2 * pairs) / WINDOW**2)
    rank = np.empty(PAIRS, np.int64)
    rank[np.lexsort((pairs, counts, bits < LEAST_BITS))] = pairs
    return rank


def features(parts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of the selected windows of each text, in order."""
    x, at = _joined(parts)
    ok = _starts(at, WINDOW)
    key = rank[equal_pairs(x)]
    key[~ok] = PAIRS
    n = len(key)
    key = (key << 40) | np.arange(n)
    width = 1
    least = key
    while width < NEIGHBOURS:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    whole = _starts(at, WINDOW + NEIGHBOURS - 1)[: len(least)]
    points = np.bincount(least[whole] & ((1 << 40) - 1), minlength=n)
    dense = np.repeat(np.diff(at) < DENSE, np.diff(at))[:n]
    taken = (points >= POPULAR) | (dense & ok)
    some = np.add.reduceat(taken, at[:-1], dtype=np.int64) > 0
    taken |= (points > 0) & ~np.repeat(some, np.diff(at))[:n]
    chosen = np.flatnonzero(taken)
    words = x[chosen[:, None] + np.arange(WINDOW)].view("<u8").astype(np.uint64)
    h = np.zeros(len(chosen), np.uint64)
    for c in range(words.shape[1]):
        h = (h ^ words[:, c]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.split(h, np.searchsorted(chosen, at[1:-1]))


def digest(hashes: np.ndarray) -> np.ndarray:
    """Chained filters, one row of bytes each, from the distinct features in order."""
    _, first = np.unique(hashes, return_index=True)
    h = hashes[np.sort(first)]
    bits = np.zeros((max(1, -(-len(h) // PER_FILTER)), BITS), bool)
    row = np.arange(len(h)) // PER_FILTER
    for k in range(HASHES):
        bits[row, ((h >> np.uint64(12 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def digests(parts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    return [digest(h) for some in _pieces(parts) for h in features(some, rank)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 (no more common bits than by chance) to 1 (equal bits)."""
    if np.array_equal(a, b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    x, y = a.view(np.uint64), b.view(np.uint64)
    nx, ny = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
    scores = []
    for row, n in zip(x, nx, strict=True):
        common = np.bitwise_count(row & y).sum(1, dtype=np.int64)
        chance, most = n * ny / BITS, np.minimum(n, ny)
        scores.append(max(0.0, float(((common - chance) / np.maximum(most - chance, 1e-9)).max())))
    return min(1.0, sum(scores) / len(scores))


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks from the entropies of all windows of all documents; the driver gets one row for each entropy."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = entropy_counts([t.encode() for t in batch["text"].to_pylist()])
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["pairs", "n"])

    counts = np.zeros(PAIRS, np.int64)
    for r in over_batches(texts(docs), count, "pairs int, n long").groupBy("pairs").agg(F.sum("n").alias("n")).collect():
        counts[r.pairs] = r.n
    return rarity(counts)


def fingerprints(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """doc_id and the chained filters (binary, 256 bytes each) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = digests([t.encode() for t in batch["text"].to_pylist()], shared.value)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([d.tobytes() for d in found], pa.binary())], ["doc_id", "fingerprint"])

    return over_batches(texts(docs), run, "doc_id long, fingerprint binary")


def cuts_above(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` exceed the key, by about twice the square root of their number of comparisons."""
    if not cuts:
        return F.lit(0)
    down, wide = cuts[::-1], math.isqrt(len(cuts) - 1) + 1
    above = lambda found: F.size(F.filter(found, lambda c: c > key))
    whole = above(F.array(*map(F.lit, down[::wide])))
    rest = above(F.slice(F.array(*map(F.lit, down)), (whole - 1) * wide + 1, F.lit(wide)))
    return F.when(whole == 0, 0).otherwise((whole - 1) * wide + rest)


def in_order(docs: DataFrame) -> DataFrame:
    """(range, extra, doc_id, text): every text in a range of ids, and the text behind the range once more as extra.

    Ids descend; null ids come last; the first text of all stands behind the last one. The driver gets one row for
    each range. Each text is shuffled once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    ids = docs.select(F.col("doc_id").cast("double").alias("d")).where("d is not null")
    cuts = ids.approxQuantile("d", [i / (RANGES * parts) for i in range(1, RANGES * parts)], 0.2 / (RANGES * parts))
    cuts = sorted({int(c) for c in cuts})
    ranged = texts(docs).withColumn("key", key).withColumn("range", cuts_above(F.col("key"), cuts))
    firsts = sorted(ranged.groupBy("range").agg(F.max("key").alias("key")).collect())
    behind = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    heads = spark.createDataFrame(behind, "key long, more int")
    both = F.array(F.struct(F.col("range"), F.lit(False).alias("extra")), F.struct(F.col("more").alias("range"), F.lit(True).alias("extra")))
    spread = ranged.join(F.broadcast(heads), "key", "left").withColumn("to", F.explode(F.when(F.col("more").isNull(), F.slice(both, 1, 1)).otherwise(both)))
    dealt = spread.select("to.range", "to.extra", "key", "doc_id", "text").repartition(parts, "range")
    return dealt.sortWithinPartitions("range", "extra", F.desc("key"), "text").drop("key")


def compare_with_next(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """Fingerprints of every text and of its edit, whose second half is the next document's beginning, and likenesses."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(rows: list[tuple[int, bool, int | None, str]]) -> pa.RecordBatch:
        """All rows but the last have their next one behind them, unless they are extra."""
        pairs = [(i, rows[i][3]) for i in range(len(rows) - 1) if not rows[i][1]]
        edited = [t[: len(t) - len(t) // 2] + rows[i + 1][3][: len(t) // 2] for i, t in pairs]
        raw = [e.encode() for e in edited]
        prints = digests([r[3].encode() for r in rows] + raw, shared.value)
        own, edit = prints[: len(rows)], prints[len(rows) :]
        out = [(rows[i][2], len(t), hashlib.sha256(raw[j]).hexdigest(), own[i].tobytes().hex(), edit[j].tobytes().hex(), likeness(own[i], edit[j]), likeness(own[i], own[i + 1])) for j, (i, t) in enumerate(pairs)]
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches):
        held: list = []
        for batch in batches:
            held += zip(*(batch[c].to_pylist() for c in ("range", "extra", "doc_id", "text")), strict=True)
            while len(held) > BATCH_ROWS:
                yield compare(held[: BATCH_ROWS + 1])
                held = held[BATCH_ROWS:]
        if held:
            yield compare(held)

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
