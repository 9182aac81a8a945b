"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms are words, hashed to ``WORDS`` columns, and the form of a text, which all languages share: pairs of byte classes,
word lengths, and words that repeat the word before. Rates of terms, square-rooted and weighted by rarity, are projected on the leading singular
vectors of a labelled sample. The labelled vectors (at most ``SAMPLE`` rows of ``RANK`` floats: 2 MB) are broadcast;
every document is compared with all of them, block by block, and its ``K`` best neighbours vote with their similarity.

Empty and null texts have a zero vector; they, and all texts if there are no labels, get the share of label 1 in the
sample (0.5 without labels). Equal texts get equal scores. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, over_batches, texts, utf8

#: Most labelled rows that a model is fitted on.
SAMPLE = 4096
RANK = 48
K = 15
#: Similarities are raised to this power before they weigh a vote.
SHARPNESS = 8
BLOCK = 1024
#: Repeated words are counted within stretches of so many words, so that long texts don't count as repetitive.
STRETCH = 2000
#: Texts are processed in pieces of about so many bytes, cut behind blanks; terms don't depend on the cuts.
PIECE = 1 << 22

#: Hashed words of the vocabulary, and what their shares count beside those of the form.
WORDS = 512
WORD_SHARE = 0.25

_KINDS = 16
_LENGTHS = 16
_FORM = _KINDS * _KINDS
_LEXICAL = _FORM + _LENGTHS
_REPEATS = _LEXICAL + WORDS
TERMS = _REPEATS + 4
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, 15, np.uint8)
    kinds[128:192], kinds[192:] = 13, 14
    kinds[ord("a") : ord("z") + 1], kinds[ord("A") : ord("Z") + 1], kinds[ord("0") : ord("9") + 1] = 1, 2, 3
    for kind, chars in ((0, " \t"), (4, "\n\r"), (5, "."), (6, ","), (7, "!?"), (8, "|"), (9, "$%&*#@^~"), (10, "'\"`"), (11, "-_/\\"), (12, "()[]{}<>=+:;")):
        kinds[[ord(c) for c in chars]] = kind
    return kinds


KINDS = _byte_kinds()
_POSITION = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.int64).astype(np.uint64)


def _word_hashes(data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the length of every word of a piece."""
    blank = (kinds == 0) | (kinds == 4)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.concatenate((np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(data))))))
    return np.add.reduceat(np.where(blank, np.uint64(0), data.astype(np.uint64) * _POSITION[place & 63]), start), end - start


def _cut(data: np.ndarray, begin: int, end: int) -> int:
    """Where a piece that begins at ``begin`` ends: behind its last blank, or else behind the next one."""
    stop = begin + PIECE
    while stop < end:
        blank = np.flatnonzero(np.isin(KINDS[data[max(begin, stop - PIECE) : stop]], (0, 4)))
        if len(blank):
            return max(begin, stop - PIECE) + int(blank[-1]) + 1
        stop += PIECE
    return end


def _terms(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Counts of the terms of one text; the same however it is cut in pieces."""
    counts, words, at = np.zeros(TERMS), [np.zeros(0, np.uint64)], begin
    while at < end:
        stop = _cut(data, at, end)
        kinds = KINDS[data[max(at - 1, begin) : stop]]
        if len(kinds) > 1:
            counts[: _KINDS * _KINDS] += np.bincount(kinds[:-1].astype(np.int16) * _KINDS + kinds[1:], minlength=_KINDS * _KINDS)
        word, length = _word_hashes(data[at:stop], KINDS[data[at:stop]])
        if len(word):
            counts[_FORM : _FORM + _LENGTHS] += np.bincount(np.minimum(length, _LENGTHS) - 1, minlength=_LENGTHS)
            counts[_LEXICAL : _LEXICAL + WORDS] += np.bincount(((word * _SPREAD) >> np.uint64(40)).astype(np.int64) % WORDS, minlength=WORDS)
        words.append(word)
        at = stop
    word = np.concatenate(words)
    counts[_REPEATS] = np.count_nonzero(word[1:] == word[:-1])
    counts[_REPEATS + 1] = np.count_nonzero(word[2:] == word[:-2])
    for first in range(0, len(word), STRETCH):
        some = word[first : first + STRETCH]
        distinct = len(np.unique(some))
        counts[_REPEATS + 2] += len(some) - distinct
        counts[_REPEATS + 3] += distinct
    return counts


def term_rates(column: pa.Array) -> np.ndarray:
    """A row of term rates for each text: square roots of the shares within pairs, lengths, words and repeats."""
    data, at = utf8(column)
    out = np.zeros((len(column), TERMS), np.float32)
    for i in range(len(column)):
        counts = _terms(data, int(at[i]), int(at[i + 1]))
        for a, b in ((0, _FORM), (_FORM, _LEXICAL), (_LEXICAL, _REPEATS)):
            counts[a:b] /= max(counts[a:b].sum(), 1)
        counts[_LEXICAL:_REPEATS] *= WORD_SHARE
        words = max(counts[_REPEATS + 2 :].sum(), 1)
        counts[_REPEATS:] /= [words, words, words, 4 * words]
        out[i] = np.sqrt(np.minimum(counts, 1))
    return out


@dataclass
class NeighbourModel:
    weight: np.ndarray  # of each term
    axes: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled rows x rank, of length 1
    y: np.ndarray
    prior: float

    def project(self, rates: np.ndarray) -> np.ndarray:
        """Vectors of length 1 on a grid of 2 ** -26.

        Factors are on grids so coarse that every sum of products is exact, so a vector doesn't depend on its batch: terms'
        rates have a length below 3, columns of weighted axes one below 10, and 5 + 24 + 24 bits make a double.
        """
        v = _on_grid(rates, 24) @ _on_grid(self.weight[:, None] * self.axes, 24)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return _on_grid(np.divide(v, norm, out=np.zeros_like(v), where=norm > 0), 26)

    def score(self, rates: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity; of equally near ones the first count.

        Products of two grids of 26 bits are exact in doubles, whatever order they are summed in.
        """
        out = np.full(len(rates), self.prior)
        if not len(self.y):
            return out
        queries, k = self.project(rates), min(K, len(self.y))
        best, vote = np.zeros((len(rates), 0)), np.zeros((len(rates), 0), np.float32)
        for at in range(0, len(self.y), BLOCK):
            best = np.hstack((best, queries @ self.vectors[at : at + BLOCK].T))
            vote = np.hstack((vote, np.broadcast_to(self.y[at : at + BLOCK], (len(rates), len(self.y[at : at + BLOCK])))))
            if best.shape[1] > k:
                least = np.partition(best, -k, axis=1)[:, [-k]]
                above, level = best > least, best == least
                taken = above | (level & (np.cumsum(level, 1, dtype=np.int32) <= k - above.sum(1, keepdims=True)))
                best, vote = best[taken].reshape(-1, k), vote[taken].reshape(-1, k)
        w = np.maximum(best, 0) ** SHARPNESS
        some = w.sum(1) > 0
        out[some] = (w * vote)[some].sum(1) / w[some].sum(1)
        return np.clip(out, 0, 1)


def _on_grid(x: np.ndarray, bits: int) -> np.ndarray:
    return np.ldexp(np.rint(np.ldexp(x.astype(np.float64), bits)), -bits)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> NeighbourModel:
    """Fit on at most ``bound`` labelled rows that are not held out."""

    def rates(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = term_rates(batch["text"])
        flat = pa.array([r.tobytes() for r in x], pa.binary())
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], flat], ["doc_id", "y", "x"])

    sample = over_batches(labelled_sample(docs, labels, label, bound), rates, "doc_id long, y int, x binary")
    rows = sample.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("one")).select("doc_id", "one.*").orderBy("doc_id").limit(bound).collect()
    y = np.array([r.y for r in rows], np.float32)
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(-1, TERMS)
    x, y = (x[(x > 0).any(1)], y[(x > 0).any(1)]) if len(x) else (x, y)
    weight = 1 + np.log((1 + len(x)) / (1 + (x > 0).sum(0)))
    values, axes = np.linalg.eigh((x * weight).T @ (x * weight))
    axes = axes[:, np.argsort(-values)[:RANK]]
    model = NeighbourModel(weight, axes, np.zeros((0, RANK)), y, float(y.mean()) if len(y) else 0.5)
    if len(x):
        model.vectors = model.project(x)
    return model


def score_quality(docs: DataFrame, model: NeighbourModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= threshold) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.score(term_rates(batch["text"]))
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return over_batches(texts(docs), score, "doc_id long, score double, predicted int")
