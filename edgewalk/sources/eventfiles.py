"""Event files of training runs: framed records with checksums, read and written by Spark tasks.

A record is the length of its data (8 bytes, little endian), that length's masked CRC-32C, the data and the data's masked
CRC-32C; the data is a tagged message with wall time, step and a summary of tagged values. ``read_events`` returns a row for
each value and for each fault:

=============  ==================================================================================================
state          meaning
=============  ==================================================================================================
``ok``         a value; ``kind`` is scalar, image or other
``torn``       the file ends within this record, as while its writer still runs; what stands before it is returned
``bad_length`` the length's checksum fails, so the rest of the file can't be framed
``bad_data``   the data's checksum fails; the record is left out, the next ones are read
``bad_event``  the checksums hold but the data is no event
=============  ==================================================================================================

A file is read by one task, since records can be found only one after the other; files are packed into tasks up to
``spark.sql.files.maxPartitionBytes``, and a file may have 2 GB. Empty files have no rows. Scalars are single precision
in such files. A run is the folder of its files, and may have many.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The reflected polynomial of CRC-32C, the constant added by the mask, and numbers of the message's fields.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
EVENT_TIME, EVENT_STEP, EVENT_VERSION, EVENT_SUMMARY = 1, 2, 3, 5
SUMMARY_VALUE = 1
VALUE_TAG, VALUE_SIMPLE, VALUE_IMAGE, VALUE_TENSOR = 1, 2, 4, 8
IMAGE_HEIGHT, IMAGE_WIDTH, IMAGE_BYTES = 1, 2, 4
TENSOR_TYPE, TENSOR_BYTES, TENSOR_FLOATS, TENSOR_DOUBLES = 1, 4, 5, 6
FLOAT_TYPE, DOUBLE_TYPE = 1, 2
FORMAT_VERSION = "brain.Event:2"
FILE_MARK = "tfevents"

EVENT_SCHEMA = "offset long, state string, tag string, step long, wall_time double, kind string, value double, image binary, height long, width long"
_NAMES = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
#: Bytes checked at once, and rows of a batch that a task returns.
_BLOCK, _ROWS = 1024, 4096


def _tables() -> np.ndarray:
    """Row k: what a byte adds to the checksum if k bytes follow it in its block."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    rows = [one]
    for _ in range(_BLOCK - 1):
        rows.append((rows[-1] >> 8) ^ one[rows[-1] & 0xFF])
    return np.stack(rows)


_TABLES = _tables()


def crc32c(data: bytes) -> int:
    """The checksum is linear in the bytes, so a block's is the exclusive or of what its bytes add."""
    raw, state = np.frombuffer(data, np.uint8), 0xFFFFFFFF
    for at in range(0, len(raw), _BLOCK):
        block = raw[at : at + _BLOCK].copy()
        n, head = len(block), np.frombuffer(state.to_bytes(4, "little"), np.uint8)
        block[: min(n, 4)] ^= head[:n]
        state = int(np.bitwise_xor.reduce(_TABLES[np.arange(n - 1, -1, -1), block])) ^ (state >> 8 * n if n < 4 else 0)
    return state ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    crc = crc32c(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return length + struct.pack("<I", masked(length)) + data + struct.pack("<I", masked(data))


def frames(data: bytes) -> Iterator[tuple[int, str, bytes]]:
    """(offset, state, data) of each record; nothing follows a torn record or a bad length."""
    at = 0
    while at < len(data):
        if at + 12 > len(data):
            yield at, "torn", b""
            return
        size, check = struct.unpack_from("<QI", data, at)
        if masked(data[at : at + 8]) != check:
            yield at, "bad_length", b""
            return
        if at + 16 + size > len(data):
            yield at, "torn", b""
            return
        body = data[at + 12 : at + 12 + size]
        good = masked(body) == struct.unpack_from("<I", data, at + 12 + size)[0]
        yield at, "ok" if good else "bad_data", body
        at += 16 + size


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        if shift > 63:
            raise ValueError("a number of over ten bytes")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: integers as such, all others as their bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield key >> 3, value
            continue
        if kind == 2:
            size, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise ValueError(f"no field of kind {kind}")
        if at + size > len(data):
            raise ValueError("a field that leaves its message")
        yield key >> 3, data[at : at + size]
        at += size


def _tensor_scalar(data: bytes) -> float | None:
    """The number of a tensor of one float or double; None for any other tensor."""
    held = dict(fields(data))
    kind = held.get(TENSOR_TYPE)
    if kind not in (FLOAT_TYPE, DOUBLE_TYPE):
        return None
    raw = held.get(TENSOR_BYTES) or held.get(TENSOR_FLOATS if kind == FLOAT_TYPE else TENSOR_DOUBLES, b"")
    code, size = ("<f", 4) if kind == FLOAT_TYPE else ("<d", 8)
    return struct.unpack(code, raw)[0] if len(raw) == size else None


def event_values(data: bytes) -> list[tuple]:
    """(tag, step, wall_time, kind, value, image, height, width) of an event's values; raises if the data is no event."""
    step, wall, summaries = 0, None, []
    for number, value in fields(data):
        if number == EVENT_TIME:
            (wall,) = struct.unpack("<d", value)
        elif number == EVENT_STEP:
            step = value - (1 << 64) if value >> 63 else value
        elif number == EVENT_SUMMARY:
            summaries.append(value)
    out = []
    for raw in (v for s in summaries for n, v in fields(s) if n == SUMMARY_VALUE):
        held = dict(fields(raw))
        tag = held.get(VALUE_TAG, b"").decode()
        if VALUE_SIMPLE in held:
            out.append((tag, step, wall, "scalar", struct.unpack("<f", held[VALUE_SIMPLE])[0], None, None, None))
        elif VALUE_IMAGE in held:
            image = dict(fields(held[VALUE_IMAGE]))
            out.append((tag, step, wall, "image", None, image.get(IMAGE_BYTES, b""), image.get(IMAGE_HEIGHT, 0), image.get(IMAGE_WIDTH, 0)))
        else:
            number = _tensor_scalar(held[VALUE_TENSOR]) if VALUE_TENSOR in held else None
            out.append((tag, step, wall, "other" if number is None else "scalar", number, None, None, None))
    return out


def _file_rows(data: bytes) -> Iterator[tuple]:
    for offset, state, body in frames(data):
        if state == "ok":
            try:
                yield from ((offset, "ok", *v) for v in event_values(body))
                continue
            except (ValueError, IndexError, struct.error, TypeError, AttributeError):
                state = "bad_event"
        yield (offset, state, *[None] * 8)


def read_events(spark: SparkSession, path: str, pattern: str = f"*{FILE_MARK}*") -> DataFrame:
    """The values and faults of all event files below ``path``: run, file and the columns of ``EVENT_SCHEMA``.

    ``run`` is the path of the file's folder.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("state", pa.string()), ("tag", pa.string()), ("step", pa.int64()), ("wall_time", pa.float64()), ("kind", pa.string()), ("value", pa.float64()), ("image", pa.binary()), ("height", pa.int64()), ("width", pa.int64())])

    def decoded(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                held = []
                for row in _file_rows(content.as_py()):
                    held.append((name.as_py(), *row))
                    # An image counts by its bytes, so that no batch grows with them.
                    if len(held) == _ROWS or row[7]:
                        yield _batch(held, schema)
                        held = []
                if held:
                    yield _batch(held, schema)

    rows = files.select("path", "content").mapInArrow(decoded, f"file string, {EVENT_SCHEMA}")
    return rows.select(F.regexp_extract("file", r"(?s)\A(.*)/[^/]*\z", 1).alias("run"), "file", *_NAMES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def event_scalars(events: DataFrame) -> DataFrame:
    """(run, tag, step, wall_time, value) of the scalars."""
    return events.where("state = 'ok' and kind = 'scalar'").select("run", "tag", "step", "wall_time", "value")


def event_faults(events: DataFrame) -> DataFrame:
    """(run, file, offset, state) of what couldn't be read."""
    return events.where("state <> 'ok'").select("run", "file", "offset", "state")


def last_images(events: DataFrame) -> DataFrame:
    """(run, tag, step, image, height, width): the image of each tag at its last step; of equal steps the later one."""
    images = events.where("state = 'ok' and kind = 'image'")
    best = F.max_by(F.struct("step", "image", "height", "width"), F.struct("step", "wall_time", "file", "offset")).alias("_b")
    return images.groupBy("run", "tag").agg(best).select("run", "tag", "_b.*")


def _put(number: int, value: int | bytes, kind: int = 2) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    key = varint(number << 3 | kind)
    if kind == 0:
        return key + varint(value & 0xFFFFFFFFFFFFFFFF)
    return key + (varint(len(value)) if kind == 2 else b"") + value


def scalar_event(tag: str, step: int, value: float, wall_time: float = 0.0) -> bytes:
    """An event with one scalar, of single precision; a number beyond it is infinite."""
    inner = _put(VALUE_TAG, tag.encode()) + _put(VALUE_SIMPLE, _single(value), 5)
    return _put(EVENT_TIME, struct.pack("<d", wall_time), 1) + _put(EVENT_STEP, step, 0) + _put(EVENT_SUMMARY, _put(SUMMARY_VALUE, inner))


def _single(value: float) -> bytes:
    with np.errstate(over="ignore"):
        return np.float32(value).astype("<f4").tobytes()


def write_events(rows: DataFrame, base: str) -> int:
    """Write (run, tag, step, value) rows as event files ``<base>/<run>/events.out.tfevents.<part>``; the number of files.

    Rows are dealt to tasks by ranges of run and step, so a long run becomes several files and many short runs share a
    task. A file is written beside its place and moved there when whole: a task that is run again replaces its files. Files
    of an earlier write stay, so write to a new folder. A null run, tag or step is no event and raises ValueError; a null value is left out.
    """
    uri = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(base).toUri()
    fs, root = (None, os.path.abspath(uri.getPath())) if uri.getScheme() in (None, "file") else pyarrow.fs.FileSystem.from_uri(base)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.where("value is not null").select("run", "tag", "step", "value").repartitionByRange(parts, "run", "step").sortWithinPartitions("run", "step", "tag", "value")

    def written(batches):
        from pyspark import TaskContext

        store = fs or pyarrow.fs.LocalFileSystem()
        part, run, out, fresh, n = TaskContext.get().partitionId(), None, None, "", 0

        def close():
            if out is not None:
                out.close()
                store.move(fresh, f"{root}/{run}/events.out.{FILE_MARK}.{part:05d}")

        for batch in batches:
            for name, tag, step, value in zip(*(batch[c].to_pylist() for c in ("run", "tag", "step", "value")), strict=True):
                if name is None or tag is None or step is None:
                    raise ValueError("an event needs a run, a tag and a step")
                if name != run:
                    close()
                    run, n = name, n + 1
                    store.create_dir(f"{root}/{run}", recursive=True)
                    fresh = f"{root}/{run}/.new-{uuid.uuid4().hex}"
                    out = store.open_output_stream(fresh)
                    out.write(frame(_put(EVENT_TIME, struct.pack("<d", 0.0), 1) + _put(EVENT_VERSION, FORMAT_VERSION.encode())))
                out.write(frame(scalar_event(tag, step, value)))
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return ordered.mapInArrow(written, "n long").agg(F.sum("n")).first()[0] or 0
