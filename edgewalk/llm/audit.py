"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

A document's failures are a mask of five bits. The first-failure table tells for each of the 32 masks and 120 orders at
which step such a document goes (or that it stays), so a batch of masks becomes removals by one lookup and one
``np.bincount`` a label; partial arrays of batches are summed. Texts are read once; only their masks, a digest and ids
move on. Copies are found by the least doc_id of each digest: digests that hold over a ``HOT_SHARE``-th of all rows are
joined by broadcast (fewer than ``HOT_SHARE`` rows), the others by a shuffle.

Null texts count as empty; a null source is the part of the empty one. A row with a null doc_id is no copy and makes none, and
has no labels; rows that share id and text are no copies of each other. Labels that repeat an id count as 1 where any row
says 1. Other columns are not read. An empty table gives no parts.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, over_batches, utf8

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)
#: The bounds of the filters and the characters of D.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 2, b"#$%&*|"
#: A digest is hot if it holds over 1 / HOT_SHARE of all rows.
HOT_SHARE = 1024
#: Parts whose partial arrays a task holds at a time (about 17 KB each).
HELD_PARTS = 1024


def first_failure() -> np.ndarray:
    """32 x 120: the step (0 to 4) at which an order removes a document with this mask of failures; 5 if none does."""
    places = np.array([[order.index(f) for f in FILTERS] for order in ORDERS])
    fails = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS) & 1).astype(bool)
    return np.where(fails[:, None, :], places[None], STEPS).min(2)


def text_failures(data: bytes, code_points: int) -> int:
    """Failures of A to D as bits 0 to 3. ``bytes.split`` parts words at exactly the six ASCII spaces."""
    words = data.split()
    bytes_ = np.frombuffer(data, np.uint8)
    capitals = int(((bytes_ >= 65) & (bytes_ <= 90)).sum())
    short = len(words) < LEAST_WORDS
    repeats = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    loud = 100 * capitals > CAPITAL_PERCENT * code_points
    return short | repeats << 1 | loud << 2 | any(m in data for m in MARKS) << 3


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of A to D, and digest (16 bytes) of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = utf8(batch["text"])
        masks, digests = [], []
        for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), batch["n"].to_pylist(), strict=True):
            text = data[a:b].tobytes()
            masks.append(text_failures(text, n))
            digests.append(xxhash.xxh3_128_digest(text))
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.length(text).alias("n"))
    return over_batches(rows, run, "doc_id long, part string, mask int, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest, mask, ...) with bit 4 of the mask set where a smaller doc_id has the digest."""
    total = rows.count()
    kinds = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    repeated = checkpointed(kinds.where("least < most"))
    hot = F.col("n") > total // HOT_SHARE
    few = repeated.where(hot).select("digest", F.col("least").alias("hot_least"))
    rest = repeated.where(~hot).select(F.col("digest").alias("rest_digest"), F.col("least").alias("rest_least"))
    known = rows.join(F.broadcast(few), "digest", "left")
    # A row whose digest is hot needs no second lookup: its key is spread by its id.
    key = F.when(F.col("hot_least").isNull(), F.col("digest")).otherwise(F.xxhash64("doc_id", "digest").cast("string").cast("binary"))
    met = known.withColumn("_key", key).join(rest, F.col("_key") == F.col("rest_digest"), "left")
    copy = F.coalesce(F.col("doc_id") > F.coalesce("hot_least", "rest_least"), F.lit(False))
    return met.withColumn("mask", F.col("mask") + copy.cast("int") * (1 << 4)).drop("_key", "hot_least", "rest_digest", "rest_least")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good and toxic (0 or 1). Rows without an id are spread by their digest, so that no task gets them all."""
    one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    known = known.withColumn("label_spread", F.lit(0).cast("long"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    met = rows.withColumn("_spread", spread).join(known, (F.col("doc_id") == F.col("label_id")) & (F.col("_spread") == F.col("label_spread")), "left")
    return met.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def removals(rows: DataFrame) -> DataFrame:
    """Partial counts (part, place, n, good, toxic): place is order * 6 + step, step 5 for documents that stay.

    Places from 720 on count failures of each filter, and from 725 on documents that fail one filter only.
    """
    table = first_failure()
    flat = (np.arange(len(ORDERS)) * (STEPS + 1))[None] + table
    size = flat.max() // (STEPS + 1) * (STEPS + 1) + STEPS + 1
    fails = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS) & 1).astype(np.int64)
    alone = fails * (fails.sum(1, keepdims=True) == 1)

    def emitted(held: dict) -> pa.RecordBatch:
        parts = list(held)
        counts = np.concatenate([held[p] for p in parts], axis=1)
        places = np.tile(np.arange(counts.shape[1] // len(parts), dtype=np.int32), len(parts))
        names = pa.array(parts, pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), counts.shape[1] // len(parts))))
        some = pa.array(counts[0] > 0)
        return pa.RecordBatch.from_arrays([names, pa.array(places), *map(pa.array, counts)], ["part", "place", "n", "good", "toxic"]).filter(some)

    def run(batches):
        held = defaultdict(lambda: np.zeros((3, size + 2 * STEPS), np.int64))
        for batch in batches:
            named = batch["part"].dictionary_encode()
            code, mask = named.indices.to_numpy(), batch["mask"].to_numpy()
            label = [np.ones(len(mask), np.int64), batch["good"].to_numpy(), batch["toxic"].to_numpy()]
            order = np.argsort(code, kind="stable")
            for rows_ in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                if len(rows_):
                    sums = held[named.dictionary[int(code[rows_[0]])].as_py()]
                    for at in range(0, len(rows_), 1 << 13):
                        some = rows_[at : at + (1 << 13)]
                        for k, values in enumerate(label):
                            chosen = mask[some[values[some] > 0]]
                            sums[k, :size] += np.bincount(flat[chosen].ravel(), minlength=size)
                            sums[k, size:] += np.concatenate([fails[chosen].sum(0), alone[chosen].sum(0)])
            if len(held) > HELD_PARTS:
                yield emitted(held)
                held.clear()
        if held:
            yield emitted(held)

    return rows.mapInArrow(run, "part string, place int, n long, good long, toxic long")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    rows = with_labels(with_copies(checkpointed(masked(docs))), labels)
    summed = removals(rows).groupBy("part", "place").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    # One row a part: maps of places that hold any document, at most 730 entries.
    entries = lambda c: F.map_from_entries(F.collect_list(F.struct("place", c))).alias(c)
    parts = summed.groupBy("part").agg(*(entries(c) for c in ("n", "good", "toxic")))
    n_orders, width = len(ORDERS), STEPS + 1
    scaffold = [(o, s, FILTERS.index(order[s - 1]), order) for o, order in enumerate(ORDERS) for s in range(1, STEPS + 1)]
    steps = spark.createDataFrame(scaffold, "o int, step int, f int, filter_order string")
    at = lambda c, place: F.coalesce(F.element_at(c, place.cast("int")), F.lit(0))
    mine = F.col("o") * width + F.col("step") - 1
    gone = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0).cast("long"), lambda total, s: total + at("n", F.col("o") * width + s - 1))
    whole = F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0).cast("long"), lambda total, s: total + at("n", s))
    fails = at("n", F.lit(n_orders * width) + F.col("f"))
    counts = parts.crossJoin(F.broadcast(steps)).select(
        "part", "filter_order", "step", "f", (whole - gone).alias("kept"), at("n", mine).alias("removed"), (fails - at("n", mine)).alias("redundant"),
        at("n", F.lit(n_orders * width + STEPS) + F.col("f")).alias("unique_fails"), at("good", mine).alias("good_lost"), at("toxic", mine).alias("toxic_lost"),
    )
    shapley = counts.groupBy("part", "f").agg(F.sum("removed").alias("shapley"))
    return counts.join(shapley, ["part", "f"]).drop("f").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
