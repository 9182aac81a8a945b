"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in the order of a hash of their id, are cut in blocks of ``BLOCK_ROWS``. A source with the share
w of all weights releases its i-th block of a phase at slot floor((i-1) / w) and must place it by ceil(i / w); in every
slot the released block with the earliest deadline goes next. All windows are met, so at every slot of a phase a source
has been given within one block of its share. Shares are exact to 2^-32. When a source has no blocks left, the others
share its weight, and a new phase begins; all blocks are placed once and none is repeated.

A phase is cut in stretches of ``STRETCH`` slots, so that no loop runs over all blocks. At the cut before slot t a
source has been given floor(w t) blocks, or one more: the sources with the largest remainders get what the floors leave
of t. Between two such cuts the blocks, with windows that end at the cuts, still fit (for any interval the blocks that
must lie in it are no more than its slots), so a task places a stretch by itself. The driver only finds where phases end:
counts at cuts tell the stretch in which a source runs out, and that one stretch is placed, once for each source.

Numbers of rows within their source come from hash buckets of bounded size, each numbered in its own task behind the sum
of the buckets before it, so a source with most rows is spread over many tasks. Blocks are joined to their rows, by
broadcast up to ``BROADCAST_BLOCKS``.

A null source counts as the source ''. Without weights, a source's weight is the power ``TEMPERATURE`` of its rows. A
source whose weight is missing or not positive gets the least share. Ties of the hash are ordered by id and the hash of
the row; rows that repeat another keep their own places. Rows with a null doc_id are spread by the hash of the row. An empty table gives an empty result. More than ``MOST_SOURCES``
sources raise ValueError.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 64
#: Slots of a stretch, which one task places at a time.
STRETCH = 1 << 14
#: Shares are multiples of one part in so many.
SHARES = 1 << 32
BROADCAST_BLOCKS = 1 << 20
TEMPERATURE = 0.5
MOST_SOURCES = 256
#: Rows of a bucket that one task numbers.
BUCKET_ROWS = 4096


def quotas(weights: dict[str, float], period: int) -> dict[str, int]:
    """Slots of a period for each source, one at least, by largest remainders."""
    names = sorted(weights)
    positive = {s: max(weights[s], 0.0) for s in names}
    total = sum(positive.values()) or 1.0
    spare = period - len(names)
    exact = {s: positive[s] / total * spare for s in names}
    out = {s: 1 + int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: (-(exact[s] - int(exact[s])), s))[: period - sum(out.values())]:
        out[s] += 1
    out[names[0]] += period - sum(out.values())
    return out


def given(quota: dict[str, int], slot: int) -> dict[str, int]:
    """Blocks of each source that lie before a cut: floors of the shares, and one more for the largest remainders."""
    out = {s: q * slot // SHARES for s, q in quota.items()}
    spare = slot - sum(out.values())
    for s in sorted(quota, key=lambda s: (-(quota[s] * slot % SHARES), s))[:spare]:
        out[s] += 1
    return out


def stretch(quota: dict[str, int], begin: int, end: int) -> Iterator[tuple[int, str, int, int, int]]:
    """(slot, source, number, release, deadline) of the blocks between two cuts, by earliest deadline first."""
    window = lambda s, i: (i * SHARES // quota[s], -(-(i + 1) * SHARES // quota[s]))
    number, last = given(quota, begin), given(quota, end)
    waiting = [(window(s, number[s])[0], s) for s in quota if number[s] < last[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    for slot in range(begin, end):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            release, deadline = window(s, number[s])
            heapq.heappush(ready, (min(deadline, end), s, release, deadline))
        due, s, release, deadline = heapq.heappop(ready)
        if slot >= due:
            raise ValueError("a deadline was missed")
        yield slot, s, number[s], release, deadline
        number[s] += 1
        if number[s] < last[s]:
            heapq.heappush(waiting, (window(s, number[s])[0], s))


@dataclass
class Phase:
    """Slots ``base`` to ``base + slots``: the shares of the sources with blocks left, and their blocks placed before."""

    base: int
    slots: int
    quota: dict[str, int]
    done: dict[str, int]

    def stretches(self) -> int:
        return -(-self.slots // STRETCH)

    def placed(self, k: int) -> Iterator[tuple[str, int, int, int, int]]:
        """(source, block, slot, release, deadline) of the k-th stretch."""
        begin = k * STRETCH
        for slot, s, i, release, deadline in stretch(self.quota, begin, begin + STRETCH):
            if slot >= self.slots:
                return
            yield s, self.done[s] + i, self.base + slot, self.base + release, self.base + deadline


def phases(blocks: dict[str, int], weights: dict[str, float]) -> list[Phase]:
    """The phases in which all blocks are placed; each one ends with the last block of some source."""
    left, done, base, out = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        quota = quotas({s: weights.get(s, 0.0) for s in left}, SHARES)
        over = lambda k: any(n >= left[s] for s, n in given(quota, (k + 1) * STRETCH).items())  # noqa: E731, B023
        low, high = 0, 1
        while not over(high):
            high *= 2
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if over(middle) else (middle + 1, high)
        counts = given(quota, low * STRETCH)
        for slot, s, i, _, _ in stretch(quota, low * STRETCH, (low + 1) * STRETCH):
            counts[s] = i + 1
            if counts[s] == left[s]:
                break
        out.append(Phase(base, slot + 1, quota, dict(done)))
        base += slot + 1
        for name, n in counts.items():
            done[name] += n
            left[name] -= n
        left = {name: n for name, n in left.items() if n}
    return out


def block_table(spark, plan: list[Phase]) -> DataFrame:
    """(source, block, slot, release, deadline) of every block; each stretch is placed by the task that holds its number."""
    first = np.concatenate([[0], np.cumsum([p.stretches() for p in plan], dtype=np.int64)])

    def run(batches):
        for batch in batches:
            for k in batch["id"].to_pylist():
                at = int(np.searchsorted(first, k, "right")) - 1
                columns = list(zip(*plan[at].placed(k - int(first[at])), strict=True)) or [()] * 5
                kinds = [pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["source", "block", "slot", "release", "deadline"])

    total = int(first[-1])
    return spark.range(0, total, 1, max(1, min(total, 4096))).mapInArrow(run, "source string, block long, slot long, release long, deadline long")


def scheduled(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """row (a struct of all columns of ``docs``), source, block, slot, release, deadline and place (in the block)."""
    spark = docs.sparkSession
    own = F.when(docs["doc_id"].isNull(), F.xxhash64(F.struct("*"))).otherwise(F.xxhash64(docs["doc_id"]))
    named = docs.select(F.struct("*").alias("row"), F.coalesce(docs["source"], F.lit("")).alias("source"), own.alias("hash"))
    counts = {r["source"]: r["count"] for r in named.groupBy("source").count().limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    weights = weights or {s: n**TEMPERATURE for s, n in counts.items()}
    blocks_of = {s: -(-n // block_rows) for s, n in counts.items()}
    table = block_table(spark, phases(blocks_of, weights))
    if sum(blocks_of.values()) <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    sizes = spark.createDataFrame([(s, max(1, -(-n // BUCKET_ROWS))) for s, n in counts.items()], "source string, buckets long")
    dealt = named.join(F.broadcast(sizes), "source").withColumn("bucket", F.pmod("hash", F.col("buckets"))).drop("buckets")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("source", "bucket").count().select("source", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "row.doc_id", F.xxhash64("row"))
    numbered = dealt.join(offsets, ["source", "bucket"]).withColumn("n", F.col("offset") + F.row_number().over(inside) - 1)
    placed = numbered.select("row", "source", F.floor(F.col("n") / block_rows).alias("block"), (F.col("n") % block_rows).alias("place"))
    return placed.join(table, ["source", "block"]).select("row", "source", "block", "slot", "release", "deadline", "place")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows and columns of ``docs`` in the schedule's order: written files follow one another in that order."""
    rows = scheduled(docs, weights, block_rows)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "slot", "place").sortWithinPartitions("slot", "place").select("row.*")
