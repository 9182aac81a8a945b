"""Secret scans: fixed patterns, then strings that a tokenizer's vocabulary compresses badly.

Base kinds: ``assign`` (a value behind password, token and the like), ``access`` (AKIA keys) and ``hex`` (24 or more
lower-case hex digits). The method adds ``token`` spans: stretches of 20 or more characters within runs of the base64
and URL alphabets that hold some letters and average under ``CHARS_PER_TOKEN`` characters a token. Whole runs, their parts
(between / = _ - +) and all windows of 20 characters are tried. Known digests (hex of the usual lengths) and UUIDs are
excluded, and a stretch of a run neither begins nor ends with a name: a short number, or a word that the vocabulary itself
compresses well. Times, numbers and codes with few letters, and alphabets in order, are no secrets. What a base span covers is left out of a stretch, and the rest of it is reported.

Positions are code points, ends exclusive. Null and empty texts have no spans. No text is cut. The vocabulary file is
read on the driver and broadcast (under 1 MB); its path is a parameter.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, texts, tokenizer_path, utf8

VOCABULARY = "byte_bpe_50k.tiktoken"
CHARS_PER_TOKEN = 2.1
SHORTEST_TOKEN = 20
SHORTEST_HEX = 24
#: Least letters of a token span, and their least share among letters and digits; in random hex digits, which have the
#: smallest share of the usual alphabets, it is 0.375 on the mean.
LETTERS, LETTER_SHARE = 6, 0.2
KINDS = ("assign", "access", "hex", "token")

# The patterns of the contract, digest lengths in hex digits, and the splitting pattern of the vocabulary.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
DIGESTS = (32, 40, 48, 56, 64, 96, 128)
KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|" + "|".join(f"[0-9A-Fa-f]{{{n}}}" for n in DIGESTS) + r")(?![A-Za-z0-9])"
)
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PART = re.compile(r"[A-Za-z0-9]+")
SHORT = re.compile(r"[0-9]{1,4}\Z|[A-Za-z]{1,2}[0-9]{0,2}\Z")
WORD = re.compile(r"[A-Z]?[a-z]{3,}\Z|[A-Z]{3,}\Z")
#: Letters that are tokenised at a time, since the time for one word grows faster than its length.
SLICE = 1024

_IS_HEX, _IS_TOKEN = np.zeros(256, bool), np.zeros(256, bool)
_IS_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_IS_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


class Vocabulary:
    """Rank file of a tiktoken encoding, built once in each Python worker."""

    def __init__(self, data: bytes):
        self.data, self._encoding = data, None

    def __getstate__(self):
        return {"data": self.data, "_encoding": None}

    def lengths(self, text: str) -> np.ndarray:
        """Bytes of each token of a text."""
        if self._encoding is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}
            self._encoding = tiktoken.Encoding("secret-scan", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
            self._bytes[list(ranks.values())] = [len(r) for r in ranks]
        return self._bytes[[i for at in range(0, len(text), SLICE) for i in self._encoding.encode_ordinary(text[at : at + SLICE])]]


def random_stretches(text: str, vocabulary: Vocabulary, limit: float = CHARS_PER_TOKEN) -> list[tuple[int, int]]:
    """Stretches of a run that have few characters a token, without known digests and UUIDs; merged and in order."""
    out, begin = [], 0
    for stop, after in [*((m.start(), m.end()) for m in KNOWN.finditer(text)), (len(text), len(text))]:
        if stop - begin >= SHORTEST_TOKEN:
            out += [(begin + a, begin + b) for a, b in _stretches(text[begin:stop], vocabulary, limit)]
        begin = after
    return out


def _stretches(text: str, vocabulary: Vocabulary, limit: float) -> list[tuple[int, int]]:
    size = vocabulary.lengths(text)
    end = np.cumsum(size)
    start = end - size
    short, word, part = np.zeros(len(size), bool), np.zeros(len(size), bool), np.full(len(size), -1)
    for k, m in enumerate(PART.finditer(text)):
        i, j = np.searchsorted(start, [m.start(), m.end()])
        short[i:j] = bool(SHORT.match(m[0]))
        word[i:j] = bool(WORD.match(m[0])) and len(m[0]) >= limit * (j - i)
        part[i:j] = k
    inside = part >= 0
    odd = np.flatnonzero(inside & ~short & ~word)
    if not len(odd):
        return []
    # Pairs of first and last token: windows, parts (without separators) and the whole run (with them).
    last = np.searchsorted(end[odd], start[odd] + SHORTEST_TOKEN)
    some = np.flatnonzero(last < len(odd))
    edge = np.flatnonzero(np.r_[True, part[odd][1:] != part[odd][:-1]])
    first = np.r_[odd[some], odd[edge]]
    final = np.r_[odd[last[some]], odd[np.append(edge[1:], len(odd)) - 1]]
    chars, tokens = np.cumsum(np.r_[0, size * inside]), np.cumsum(np.r_[0, inside])
    keep = (chars[final + 1] - chars[first] < limit * (tokens[final + 1] - tokens[first])) & (end[final] - start[first] >= SHORTEST_TOKEN)
    found = list(zip(start[first[keep]].tolist(), end[final[keep]].tolist(), strict=True))
    if len(text) < limit * len(size):
        rest = np.flatnonzero(inside & ~word)
        found.append((int(start[rest[0]]), int(end[rest[-1]])))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if b - a >= SHORTEST_TOKEN and lettered(text[a:b])]


def lettered(text: str) -> bool:
    """Enough letters for a random string, and no alphabet in order; times, numbers and codes of digits have fewer."""
    chars = np.frombuffer("".join(PART.findall(text)).encode(), np.uint8)
    letters = int((chars > ord("9")).sum())
    return letters >= LETTERS and letters >= LETTER_SHARE * len(chars) and 2 * int((np.diff(chars) == 1).sum()) < len(chars)


def _without(a: int, b: int, covers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What ``covers`` leave of a stretch."""
    out = []
    for c, d in sorted(covers):
        if c > a:
            out.append((a, min(c, b)))
        a = max(a, d)
        if a >= b:
            break
    return [(x, y) for x, y in [*out, (a, b)] if y > x]


def token_spans(text: str, base: list[tuple[int, int]], vocabulary: Vocabulary, limit: float = CHARS_PER_TOKEN) -> list[tuple[int, int]]:
    """Random stretches of a run outside its base spans; what is left between them is searched again."""
    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a < SHORTEST_TOKEN:
            continue
        hits = [(a + x, a + y) for x, y in random_stretches(text[a:b], vocabulary, limit)]
        held = [(c, d) for c, d in base if c < b and a < d]
        out += [p for h in hits for p in _without(*h, held) if PART.search(text, *p)]
        if hits or held:
            todo += _without(a, b, hits + held)
    return sorted(out)


def _runs(data: np.ndarray, at: np.ndarray, allowed: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of runs of allowed bytes within texts."""
    ok = allowed[data[at[0] : at[-1]]]
    edge = np.flatnonzero(ok[1:] != ok[:-1]) + 1
    edge = np.union1d(edge, at - at[0])
    start, end = edge[:-1], edge[1:]
    keep = (end - start >= least) & ok[np.minimum(start, len(ok) - 1)] if len(ok) else np.zeros(len(start), bool)
    return start[keep] + at[0], end[keep] + at[0]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]{24,}", text)]
    return found


def order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(column: pa.Array, vocabulary: Vocabulary, limit: float = CHARS_PER_TOKEN) -> list[list[tuple[int, int, str]]]:
    """Spans of every text; only texts with a hint in their bytes are searched one by one."""
    data, at = utf8(column)
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(column))]
    if not len(column) or at[-1] == at[0]:
        return out
    low = data[at[0] : at[-1]].tobytes()
    hints = [_runs(data, at, _IS_HEX, SHORTEST_HEX)[0]]
    tokens, token_ends = _runs(data, at, _IS_TOKEN, SHORTEST_TOKEN)
    for word, where in [(b"AKIA", low), *((w, low.lower()) for w in WORDS)]:
        k = where.find(word)
        while k >= 0:
            hints.append(np.array([k + at[0]]))
            k = where.find(word, k + 1)
    doc_of = lambda x: np.searchsorted(at, x, "right") - 1
    for i in np.unique(doc_of(np.concatenate(hints))):
        out[i] = base_spans(column[int(i)].as_py())
    for i, a, b in zip(doc_of(tokens), tokens, token_ends, strict=True):
        start = int((data[at[i] : a] & 0xC0 != 0x80).sum())
        base = [(s - start, e - start) for s, e, kind in out[i] if kind != "token" and s < start + b - a and start < e]
        out[i] += [(start + s, start + e, "token") for s, e in token_spans(data[a:b].tobytes().decode(), base, vocabulary, limit)]
    return [order(s) for s in out]


def load_vocabulary(path: str | None = None) -> Vocabulary:
    with open(path or tokenizer_path(VOCABULARY), "rb") as f:
        return Vocabulary(f.read())


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, limit: float = CHARS_PER_TOKEN) -> DataFrame:
    """doc_id and spans (array of start, end, kind), by start, then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in scan(batch["text"], shared.value, limit)]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, kind)], ["doc_id", "spans"])

    return over_batches(texts(docs), run, "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every stretch that spans cover replaced by the mark of its first kind."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, vocabulary: str | None = None, limit: float = CHARS_PER_TOKEN) -> DataFrame:
    """The rows and columns of ``docs``, with secrets in ``text`` replaced; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    where = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch["text"].fill_null("") if batch["text"].null_count else batch["text"]
        hits = {i: s for i, s in enumerate(scan(column, shared.value, limit)) if s}
        if not hits:
            return batch
        new = [redact(t, hits[i]) if i in hits else t for i, t in enumerate(batch["text"].to_pylist())]
        return batch.set_column(where, batch.schema.field(where), pa.array(new, batch["text"].type))

    return over_batches(docs, run, docs.schema)


def span_digests(scanned: DataFrame) -> DataFrame:
    """Counts and digests of what ``scan_secrets`` returned."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "token")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", *map(n, KINDS),
        F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
