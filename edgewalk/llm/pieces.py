r"""SentencePiece encoding and decoding as weighted finite-state transducers.

Three transducers are compiled from a model file: the normaliser (a dummy space in front; spaces become U+2581), the
pieces with byte fallback (an arc for each piece, and a chain of byte arcs for a character that no piece has), and, for
a BPE model, a constraint on neighbouring pieces. ``Automaton`` holds them as states and weighted arcs, composes them with
an input, and takes the tropical shortest path; ``lattice`` and ``encode_by_composition`` are the definition that tests
hold. ``PieceTransducer`` is its compiled form for whole tables: the same composition, made as the input is read; states
are positions (and the piece before), arc weights add up, and the shortest path is the encoding.

For a unigram model an arc's weight is minus its score. For a BPE model the weight of a pair of pieces is 0 if merging
their joint text gives just this pair, and infinite otherwise. A text is the merge result exactly if all its
neighbouring pairs are (and pieces that merging can't reach have no arc), so one path has a finite weight, and it is
what merging gives; pair weights are computed once and kept.

No piece has U+2581 behind another character, and a line end is in no piece, so inputs are cut before spaces and at
line ends; the paths of cut parts are kept in a bounded table in each Python worker. Decoding concatenates pieces or
bytes, turns U+2581 into spaces, and drops the dummy space; bytes that are no UTF-8 become U+FFFD.

Null and empty texts have no ids. A text with U+2581 itself decodes to one with spaces (as with the model's own
library). Texts are never cut. The model file is read on the driver and broadcast (0.5 MB); its path is a parameter.
"""

from __future__ import annotations

import re
import string
import struct
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, texts, tokenizer_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Most parts whose paths a worker keeps, most characters of such a part, most pairs whose weights it keeps.
KEPT, KEPT_CHARS, KEPT_PAIRS = 800_000, 64, 1_000_000

# Field numbers and kinds of the model's protocol buffer.
NORMAL, UNKNOWN, BYTE, UNUSED, USER = 1, 2, 6, 5, 4
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            value = struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0]
            at += n
        yield tag >> 3, value


@dataclass
class PieceModel:
    """What the model file says: pieces, scores, kinds, and how texts are normalised."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    dummy_prefix: bool = True
    strip_spaces: bool = True
    rules: bytes = b""

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                m.pieces.append(piece[1].decode())
                m.scores.append(piece.get(2, 0.0))
                m.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                m.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                m.rules, m.dummy_prefix, m.strip_spaces = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if m.rules or m.strip_spaces:
            raise ValueError("only models with the identity normaliser that keep all spaces are compiled")
        return m

    @classmethod
    def load(cls, path: str | None = None) -> PieceModel:
        with open(path or tokenizer_path(MODEL), "rb") as f:
            return cls.parse(f.read())


class Automaton:
    """A weighted transducer: ``arcs[state]`` lists (symbol read, ids written, weight, next state); ``final`` states."""

    def __init__(self, start, final):
        self.start, self.final, self.arcs = start, set(final), {}

    def arc(self, state, read, write: tuple, weight: float, to) -> None:
        self.arcs.setdefault(state, []).append((read, write, weight, to))

    def compose(self, then: Automaton) -> Automaton:
        """Reads what ``self`` reads and writes what ``then`` writes; ``self`` writes one symbol an arc at most."""
        out, todo = Automaton((self.start, then.start), ()), [(self.start, then.start)]
        seen = set(todo)
        while todo:
            a, b = state = todo.pop()
            if a in self.final and b in then.final:
                out.final.add(state)
            for read, write, w, a2 in self.arcs.get(a, ()):
                after = [((), 0.0, b)] if not write else [(o, v, b2) for r, o, v, b2 in then.arcs.get(b, ()) if r == write[0]]
                for o, v, b2 in after:
                    out.arc(state, read, o, w + v, (a2, b2))
                    if (a2, b2) not in seen:
                        seen.add((a2, b2))
                        todo.append((a2, b2))
        return out

    def shortest(self) -> list:
        """What the path of least weight from start to a final state writes; by relaxation, as weights may be negative."""
        best = {self.start: (0.0, ())}
        todo = [self.start]
        while todo:
            state = todo.pop(0)
            cost, written = best[state]
            for _, write, w, to in self.arcs.get(state, ()):
                if cost + w < best.get(to, (float("inf"),))[0]:
                    best[to] = (cost + w, written + write)
                    todo.append(to)
        ends = [best[s] for s in self.final if s in best]
        return list(min(ends)[1]) if ends else []


def normaliser(model: PieceModel, text: str) -> Automaton:
    """The input as a chain of characters, written as the model's pieces spell them."""
    line = Automaton(0, [len(text) + 1])
    line.arc(0, "", (SPACE,) if model.dummy_prefix and text else (), 0.0, 1)
    for i, c in enumerate(text, 1):
        line.arc(i, c, (SPACE if c == " " else c,), 0.0, i + 1)
    return line


def lattice(t: PieceTransducer, text: str) -> Automaton:
    """Characters of a normalised text to piece ids: pieces at their weights, and bytes where a character has no piece."""
    m, out = t.model, Automaton(0, [len(text)])
    floor = -min(m.scores, default=0.0) + 10.0
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + t.longest) + 1):
            piece = t.arcs.get(text[i:j])
            if piece is not None:
                out.arc(i, text[i:j], (piece,), 0.0 if m.kind == BPE else -m.scores[piece], j)
        if text[i] not in t.arcs:
            out.arc(i, text[i], (-1 - ord(text[i]),), 0.0 if m.kind == BPE else floor, i + 1)
    return out


def neighbours(t: PieceTransducer, ids: set[int]) -> Automaton:
    """For a BPE model: passes pairs of pieces whose joint text merges to just them; states are the piece before."""
    out = Automaton(None, [None, *ids])
    for left in (None, *ids):
        for right in ids:
            if left is None or left < 0 or right < 0 or t.merged(t.model.pieces[left] + t.model.pieces[right]) == [t.model.pieces[left], t.model.pieces[right]]:
                out.arc(left, right, (right,), 0.0, right)
    return out


def encode_by_composition(t: PieceTransducer, text: str) -> list[int]:
    """Ids of a short text by composing normaliser, pieces, byte fallback and, for BPE, the constraint on neighbours."""
    line = normaliser(t.model, text)
    normal = "".join(write[0] for state in sorted(line.arcs) for _, write, _, _ in line.arcs[state] if write)
    paths = lattice(t, normal)
    if t.model.kind == BPE:
        paths = paths.compose(neighbours(t, {w[0] for arcs in paths.arcs.values() for _, w, _, _ in arcs}))
    return [i for x in paths.shortest() for i in ([x] if x >= 0 else t.fallback(chr(-1 - x)))]


class PieceTransducer:
    """The composed transducer; compiled lazily in each worker."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.compile()

    def __getstate__(self):
        return self.model

    def __setstate__(self, model):
        self.__init__(model)

    def compile(self) -> None:
        m = self.model
        self.arcs = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(m.kinds) if k == UNKNOWN), 0)
        self.longest = max(map(len, self.arcs), default=1)
        self.pairs: dict[int, bool] = {}
        self.paths: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.joints = {p[k : k + 2] for p in self.arcs for k in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.arcs):
            raise ValueError("pieces with a space or line end inside; parts can't be cut there")
        if m.kind == BPE:
            self.arcs = {p: i for p, i in self.arcs.items() if len(p) == 1 or self.merged(p) == [p]}
        # Beginnings of pieces; the value is the piece that ends there, or -1.
        self.trie = {p[:k]: -1 for p in self.arcs for k in range(1, len(p))} | self.arcs
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else b"" for p, k in zip(m.pieces, m.kinds, strict=True)]
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def merged(self, text: str) -> list[str]:
        """The pair weights' definition: neighbours merge, best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((-self.model.scores[self.arcs[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.arcs), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the pair has weight 0."""
        a, b = self.model.pieces[left], self.model.pieces[right]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def fallback(self, char: str) -> list[int]:
        raw = char.encode()
        return [self.bytes[b] for b in raw] if len(self.bytes) == 256 else [self.unknown]

    def shortest(self, text: str) -> list[int]:
        """Ids on the shortest path through the composition with one normalised part."""
        return self._unigram(text) if self.model.kind == UNIGRAM else self._bpe(text)

    def _bpe(self, text: str) -> list[int]:
        trie, pairs, n = self.trie, self.pairs, len(text)
        # last[i]: the piece that ends the only finite path to position i; -1: byte arcs, the start, or none yet.
        last, back = [-1] * (n + 1), [-1] * (n + 1)
        for j in range(n):
            before = last[j]
            if j and back[j] < 0:
                back[j] = j - 1
            k = j + 1
            piece = trie.get(text[j:k])
            while piece is not None:
                # Starts ascend, so the first arc that fits is the longest.
                if piece >= 0 and back[k] < 0:
                    if before < 0:
                        last[k], back[k] = piece, j
                    else:
                        fits = pairs.get(before << 32 | piece)
                        if fits is None:
                            fits = self.fits(before, piece)
                        if fits:
                            last[k], back[k] = piece, j
                k += 1
                if k > n:
                    break
                piece = trie.get(text[j:k])
        if n and back[n] < 0:
            back[n] = n - 1
        out: list[int] = []
        i = n
        while i:
            j = back[i]
            out += [last[i]] if last[i] >= 0 else self.fallback(text[j])[::-1]
            i = j
        return out[::-1]

    def _unigram(self, text: str) -> list[int]:
        n, scores = len(text), self.model.scores
        floor = -min(scores, default=0.0) + 10.0
        cost, back = [0.0] + [np.inf] * n, [(0, -1)] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                piece = self.arcs.get(text[j:i])
                w = cost[j] - scores[piece] if piece is not None else cost[j] + floor if j == i - 1 else np.inf
                if w < cost[i]:
                    cost[i], back[i] = w, (j, -1 if piece is None else piece)
        out: list[int] = []
        i = n
        while i:
            j, piece = back[i]
            out += [piece] if piece >= 0 else self.fallback(text[j])[::-1]
            i = j
        return out[::-1]

    def part(self, part: str) -> bytes:
        """Packed ids (int32) of a part: a space in front is implied unless it begins with a line end."""
        stem = part.rstrip(string.punctuation)
        if stem and len(stem) < len(part) and stem != "\n" and part[len(stem) - 1 : len(stem) + 1] not in self.joints:
            # No piece spans the two characters, so the paths of both sides may be computed, and kept, apart.
            packed = (self.paths.get(stem) or self.part(stem)) + self.tail(part[len(stem) :])
        else:
            ids = self.shortest("\n" + part[1:] if part[:1] == "\n" else SPACE + part)
            packed = array("i", ids).tobytes()
        if len(part) <= KEPT_CHARS:
            if len(self.paths) >= KEPT:
                self.paths.clear()
            self.paths[part] = packed
        return packed

    def tail(self, marks: str) -> bytes:
        packed = self.tails.get(marks)
        if packed is None:
            packed = array("i", self.shortest(marks)).tobytes()
            if len(marks) <= KEPT_CHARS:
                if len(self.tails) >= KEPT:
                    self.tails.clear()
                self.tails[marks] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Packed ids (int32) of a text."""
        if not text:
            return b""
        if not self.model.dummy_prefix or "  " in text or SPACE in text or text[0] in " \n" or " \n" in text or text[-1] == " ":
            return self._encode_slowly(text)
        # Every word gets the space before it; a line end starts a part of its own that has none.
        parts = text.replace("\n", " \n").split(" ")
        get = self.paths.get
        found = [get(p) for p in parts]
        if None in found:
            found = [f if f is not None else self.part(p) for f, p in zip(found, parts, strict=True)]
        return b"".join(found)

    def _encode_slowly(self, text: str) -> bytes:
        line = (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        return b"".join(np.array(self.shortest(p), "<i4").tobytes() for p in re.findall(rf"\n[^\n{SPACE}]*|{SPACE}+[^\n{SPACE}]*|[^\n{SPACE}]+", line))

    def decode(self, ids: np.ndarray) -> str:
        size = self.sizes[ids]
        total = int(size.sum())
        at = np.arange(total) + np.repeat(self.begins[ids] - (np.cumsum(size) - size), size)
        text = self.flat[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def encode_pieces(docs: DataFrame, model: PieceModel | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to ``keep``, and ids (array of int) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(PieceTransducer(model or PieceModel.load()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = shared.value
        packed = [t.encode(x) for x in batch["text"].to_pylist()]
        offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
        return pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", *keep)), ids], ["doc_id", *keep, "ids"])

    more = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return over_batches(texts(docs, *keep), run, f"doc_id long, {more}ids array<int>")


def decode_pieces(encoded: DataFrame, model: PieceModel | None = None) -> DataFrame:
    """The columns of ``encoded`` (doc_id, ids) with the decoded text and its number of ids; null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(PieceTransducer(model or PieceModel.load()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t, column = shared.value, batch["ids"]
        offsets = column.offsets.to_numpy()
        ids = column.values.to_numpy()
        out = [t.decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch["doc_id"], column, pa.array(np.diff(offsets).astype(np.int64)), pa.array(out, pa.string())], ["doc_id", "ids", "n_ids", "text"])

    return over_batches(encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")), run, "doc_id long, ids array<int>, n_ids long, text string")
