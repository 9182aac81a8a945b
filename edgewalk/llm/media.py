"""Media columns: texts as greyscale PNG in binary columns, read back with checks, hashed by low cosine frequencies.

``encode_media`` pads the UTF-8 bytes of a text with zero bytes to a positive multiple of 64 and writes them as rows of
64 8-bit samples: signature, IHDR, IDAT (zlib), IEND, each chunk with its CRC. The text's byte count travels in a
private chunk, so padding is told from trailing zero bytes of the text. ``read_media`` walks the chunks of any
non-interlaced 8-bit greyscale PNG, tests every checksum, inflates, undoes all five row filters with numpy, and hashes
the 8 x 8 lowest cosine frequencies against their median.

Null and empty texts become one row of zeros. A medium that is null, torn or has a wrong checksum gives null outputs
and its reason in ``status``; no row is dropped. Equal texts give equal media and hashes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, texts

WIDTH = 64
LEVEL = 6
LOW = 8
# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def to_png(data: bytes) -> bytes:
    """One row filter for the whole picture: the one whose residues have the least sum of absolute values."""
    rows = np.frombuffer(pad(data), np.uint8).reshape(-1, WIDTH)
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], above[1:] = rows[:, :-1], rows[:-1]
    residues = {NONE: rows, SUB: rows - left, UP: rows - above}
    kind = min(residues, key=lambda k: (np.abs(residues[k].view(np.int8).astype(np.int16)).sum(), k))
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, residues[kind]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"teXl", struct.pack(">Q", len(data))) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> list[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    out, at = [], 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("torn chunk")
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if len(body) < n or len(png) < at + 12 + n:
            raise ValueError("torn chunk")
        if struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] != zlib.crc32(png[at + 4 : at + 8 + n]):
            raise ValueError(f"wrong checksum of {kind.decode('latin-1')}")
        out.append((kind, body))
        at += 12 + n
    if not out or out[0][0] != b"IHDR" or out[-1][0] != b"IEND":
        raise ValueError("chunks are missing")
    return out


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of rows that each begin with their filter's number; runs of one filter are undone together."""
    kinds, x = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > PAETH:
        raise ValueError("unknown filter")
    ends = np.append(np.flatnonzero(np.diff(kinds)) + 1, len(kinds))
    begin = 0
    for end in ends:
        kind, run = kinds[begin], x[begin:end]
        before = x[begin - 1] if begin else np.zeros(x.shape[1], np.uint8)
        if kind == SUB:
            x[begin:end] = np.cumsum(run, axis=1, dtype=np.uint8)
        elif kind == UP:
            x[begin:end] = np.cumsum(run, axis=0, dtype=np.uint8) + before
        elif kind in (AVERAGE, PAETH):
            for r in range(begin, end):
                above = x[r - 1].astype(int) if r else np.zeros(x.shape[1], int)
                left = corner = 0
                for c in range(x.shape[1]):
                    if kind == AVERAGE:
                        guess = (left + above[c]) // 2
                    else:
                        p = left + above[c] - corner
                        guess = min((abs(p - left), 0, left), (abs(p - above[c]), 1, above[c]), (abs(p - corner), 2, corner))[2]
                    left = (int(x[r, c]) + int(guess)) & 255
                    corner = int(above[c])
                    x[r, c] = left
        begin = end
    return x


def from_png(png: bytes) -> tuple[np.ndarray, int | None]:
    """The samples, and the text's byte count if the private chunk is there."""
    parts = chunks(png)
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    if (depth, colour, interlaced) != (8, 0, 0):
        raise ValueError("only 8-bit greyscale without interlacing")
    flat = np.frombuffer(zlib.decompress(b"".join(b for k, b in parts if k == b"IDAT")), np.uint8)
    if len(flat) != height * (width + 1):
        raise ValueError("wrong number of samples")
    n = next((struct.unpack(">Q", b)[0] for k, b in parts if k == b"teXl"), None)
    return unfilter(flat.reshape(height, width + 1)), n


def cosine_hash(rows: np.ndarray) -> bytes:
    """64 bits: which of the lowest 8 x 8 cosine frequencies exceed their median."""
    h, w = rows.shape
    basis = lambda n: np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(n) + 1) / (2 * n)) / n
    low = basis(h) @ rows.astype(np.float64) @ basis(w).T
    flat = low.ravel()
    return np.packbits(flat > np.median(flat[1:])).tobytes()


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the PNG in ``media``."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.encode() for t in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(b) for b in raw], pa.int64()), pa.array([to_png(b) for b in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return over_batches(texts(docs), encode, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """The columns of ``media`` but n_bytes, with status, n_bytes, payload (binary) and cosine_hash (binary) as read."""

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for png in batch["media"].to_pylist():
            try:
                if png is None:
                    raise ValueError("null")
                rows, n = from_png(png)
                out.append(("ok", n, rows.tobytes(), cosine_hash(rows)))
            except (ValueError, zlib.error, struct.error) as e:
                out.append((str(e), None, None, None))
        cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["media"], *cols], ["doc_id", "media", "status", "n_bytes", "payload", "cosine_hash"])

    return over_batches(media.select("doc_id", "media"), decode, "doc_id long, media binary, status string, n_bytes long, payload binary, cosine_hash binary")


def media_digests(read: DataFrame) -> DataFrame:
    """Lengths and digests of what ``read_media`` returned; the JVM computes them."""
    tail = F.expr(f"substring(payload, greatest(1, length(payload) - {WIDTH - 1}), {WIDTH})")
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("cosine_hash")).alias("feature"), "status",
    )
