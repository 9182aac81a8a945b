"""Nearest neighbours by cosine through multi-index hashing of learned binary codes.

Codes: unit vectors are centred, turned to their principal axes (64 at most) and rotated so that signs lose least
(iterative quantisation), all learned on a bounded sample; each code has 64 bits. Index: a code is split into four
substrings of 16 bits, each of them filed in a table of its own. Probing: if two codes differ in at most r bits, then in
some substring i by at most t_i, where the t_i sum to r - 3 (the pigeonhole principle); a query visits every shard of
table i whose leading bits differ in t_i at most, and in it the buckets within t_i. So every code within the radius is
met, and it is taken in the first table that meets the bound, so once. Then floats decide: the exact cosine ranks.

The radius is measured, not set: for ``PROBES`` vectors of the sample the true neighbours are found among all rows, in
one pass, and the radius is the least that holds a share ``SHARE`` of them. It follows the data and their number. A
query that meets too few codes is asked again with a wider radius, up to all bits, which meets every row.

A shard grows with its rows, a hot one too: it is cut in chunks, and where many queries visit it, these are cut too. A
task holds a bounded number of queries while rows stream by, and merges what its chunks find before it gives it back.

Vectors that are null, zero or not finite, of another length than most, or without a vec_id take no part. Candidates of a
query are the rows with other ids; a query that repeats id and vector is asked once, rows that repeat an id as candidates
are rows of their own. Ties go to the smaller vec_id. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

BITS, TABLES = 64, 4
WIDTH = BITS // TABLES
TOP = 5
#: Most rows that the codes are learned on, and vectors whose true neighbours set the radius.
SAMPLE, PROBES = 4096, 128
#: Share of true neighbours that the radius holds.
SHARE = 0.97
#: Bits by which the radius grows for queries that found too few.
WIDER = 8
#: Rows of a chunk of a shard, by the number of all rows: 1 / CHUNK_SHARE of them within these bounds.
CHUNK_SHARE, CHUNK_LEAST, CHUNK_MOST = 4096, 1024, 1 << 18
#: Queries that a task holds at a time; pairs that are compared, and pairs whose floats are, at a time.
HELD, PAIRS, FLOATS = 4096, 1 << 21, 1 << 15
#: Found rows (32 bytes each) that a task holds before it merges them or sends them out.
MERGED = 1 << 20
ROUNDS = 40


@dataclass
class Coder:
    """Codes are signs of (v / |v| - mean) @ turn."""

    mean: np.ndarray
    turn: np.ndarray

    def codes(self, unit: np.ndarray) -> np.ndarray:
        bits = (unit - self.mean) @ self.turn > 1e-9
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; cosines don't change."""
    _, exponent = np.frexp(np.abs(vectors).max(1, initial=0.0, keepdims=True))
    return np.ldexp(vectors, -exponent)


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(1))


def fit_coder(vectors: np.ndarray, rounds: int = ROUNDS, seed: int = 42) -> Coder:
    """Principal axes of unit vectors, then the rotation whose signs lie nearest to them."""
    unit = scaled(vectors)
    unit = unit / norms(unit)[:, None]
    mean = unit.mean(0)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :BITS]
    low = np.zeros((len(unit), BITS))
    low[:, : axes.shape[1]] = centred @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(BITS, BITS)))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(low @ rotation > 0, 1.0, -1.0).T @ low)
        rotation = (u @ v).T
    return Coder(mean, axes @ rotation[: axes.shape[1]])


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def sound(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, vector) of the vectors that take part, and their number."""
    vector = F.col(vector_col)
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(vector, lambda x: x != 0)
    rows = embeddings.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    most = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return (rows.where(F.size("vector") == most["size"]), most["n"]) if most else (rows, 0)


def coded(rows: DataFrame, coder: Coder) -> DataFrame:
    """``rows`` (vec_id, vector) with code, 64 bits as a long."""

    def run(batches):
        for batch in batches:
            vectors = scaled(matrix(batch["vector"]))
            codes = coder.codes(vectors / norms(vectors)[:, None])
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["vector"], pa.array(codes.view(np.int64))], ["vec_id", "vector", "code"])

    return rows.mapInArrow(run, f"vec_id long, vector {rows.schema['vector'].dataType.simpleString()}, code long")


class Best:
    """The ``TOP`` candidates of each of some queries, by score, then by the smaller id."""

    def __init__(self):
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        query, score, id_ = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, id_])
        order = np.lexsort((id_, -score, query))
        query = query[order]
        begin = np.searchsorted(query, query)
        keep = np.arange(len(query)) - begin < TOP
        self.query, self.score, self.id = query[keep], score[order][keep], id_[order][keep]


def measured_radius(rows: DataFrame, probe_ids: np.ndarray, probes: np.ndarray, coder: Coder, share: float = SHARE) -> int:
    """The least radius that holds the share of the ``TOP`` true neighbours, among all ``rows``, of the probes."""
    unit = scaled(probes)
    unit = unit / norms(unit)[:, None]
    codes = coder.codes(unit)

    def run(batches):
        best, distance = Best(), {}
        for batch in batches:
            ids, vectors = batch["vec_id"].to_numpy(), scaled(matrix(batch["vector"]))
            near = (vectors / norms(vectors)[:, None]) @ unit.T
            near[ids[:, None] == probe_ids[None]] = -np.inf
            k = min(TOP, len(ids))
            at = np.argpartition(-near, k - 1, axis=0)[:k] if k else np.zeros((0, len(unit)), np.int64)
            query = np.broadcast_to(np.arange(len(unit)), at.shape)
            row, query = at.ravel(), query.ravel()
            real = near[row, query] > -np.inf
            row, query = row[real], query[real]
            bits = np.bitwise_count(batch["code"].to_numpy().view(np.uint64)[row] ^ codes[query])
            distance |= {(q, i): d for q, i, d in zip(query.tolist(), ids[row].tolist(), bits.tolist(), strict=True)}
            best.add(query, near[row, query], ids[row])
            distance = {(q, i): distance[q, i] for q, i in zip(best.query.tolist(), best.id.tolist(), strict=True)}
        away = [distance[q, i] for q, i in zip(best.query.tolist(), best.id.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.score), pa.array(best.id), pa.array(away, pa.int64())], ["query", "score", "vec_id", "away"])

    met = rows.mapInArrow(run, "query long, score double, vec_id long, away long")
    first = F.slice(F.array_sort(F.collect_list(F.struct((0.0 - F.col("score")).alias("s"), "vec_id", "away"))), 1, TOP)
    away = sorted(r.away for r in met.groupBy("query").agg(first.alias("t")).select(F.explode("t.away").alias("away")).collect())
    return away[math.ceil(share * len(away)) - 1] if away else 0


def bounds_of(radius: int) -> list[int]:
    """Most differing bits in each substring such that any code within the radius keeps to one of them; -1: never."""
    if radius >= BITS:
        return [WIDTH] + [-1] * (TABLES - 1)
    least, more = divmod(radius - TABLES + 1, TABLES)
    return [least + (i < more) for i in range(TABLES)]


def substring(code: Column, table: int) -> Column:
    return F.shiftrightunsigned(code, BITS - WIDTH * (table + 1)).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long")).cast("int")


class Held:
    """Queries of one chunk and the best of the rows that have met them."""

    def __init__(self, table: int, radius: int):
        self.table, self.radius, self.bounds = table, radius, bounds_of(radius)
        self.parts, self.best = [], Best()

    def ask(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)

    def ready(self) -> None:
        asked = pa.Table.from_batches(self.parts).combine_chunks()
        self.parts = []
        self.ids, self.asks = asked["id"].to_numpy(), asked["ask"].to_numpy()
        self.codes = asked["code"].to_numpy().view(np.uint64)
        self.vectors = scaled(matrix(asked["vector"].combine_chunks()))
        self.norms = norms(self.vectors)

    def _sub(self, codes: np.ndarray, table: int) -> np.ndarray:
        return (codes >> np.uint64(BITS - WIDTH * (table + 1))).astype(np.uint16)

    def meet(self, rows: pa.RecordBatch) -> None:
        """Probe the buckets of these rows, keep the codes within the radius, and rank them by their floats."""
        if self.parts:
            self.ready()
        ids, codes = rows["id"].to_numpy(), rows["code"].to_numpy().view(np.uint64)
        vectors = scaled(matrix(rows["vector"]))
        lengths = norms(vectors)
        sub = self._sub(codes, self.table)
        filed = np.argsort(sub, kind="stable")
        buckets, begin, count = np.unique(sub[filed], return_index=True, return_counts=True)
        mine = self._sub(self.codes, self.table)
        step = max(1, PAIRS // len(codes))
        for at in range(0, len(mine), step):
            q, b = np.nonzero(np.bitwise_count(mine[at : at + step, None] ^ buckets[None]) <= self.bounds[self.table])
            n = count[b]
            query = np.repeat(q + at, n)
            row = filed[np.arange(n.sum()) + np.repeat(begin[b] - (np.cumsum(n) - n), n)]
            differ = self.codes[query] ^ codes[row]
            near = (np.bitwise_count(differ) <= self.radius) & (self.ids[query] != ids[row])
            for earlier in range(self.table):
                near &= np.bitwise_count(self._sub(differ, earlier)) > self.bounds[earlier]
            query, row = query[near], row[near]
            for cut in range(0, len(query), FLOATS):
                a, c = query[cut : cut + FLOATS], row[cut : cut + FLOATS]
                score = (self.vectors[a] * vectors[c]).sum(1) / (self.norms[a] * lengths[c])
                self.best.add(a, score, ids[c])

    def found(self) -> list[np.ndarray]:
        """query_id, ask, vec_id and score of the best."""
        at = self.best.query
        ids, asks = (self.ids[at], self.asks[at]) if len(at) else (np.zeros(0, np.int64),) * 2
        return [ids, asks, self.best.id, self.best.score]


class Merged:
    """The best of all chunks that a task has seen, so that a query gets ``TOP`` rows from a task, not from each chunk."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, found: list[np.ndarray]) -> bool:
        """Take the best of a chunk; True if so many are held that they should go out."""
        self.parts.append(found)
        self.n += len(found[0])
        if self.n > MERGED:
            self.parts = [self._merge()]
            self.n = len(self.parts[0][0])
        return self.n > MERGED // 2

    def _merge(self) -> list[np.ndarray]:
        query, ask, id_, score = map(np.concatenate, zip(*self.parts, strict=True))
        order = np.lexsort((id_, -score, ask, query))
        query, ask, id_, score = query[order], ask[order], id_[order], score[order]
        new = np.r_[True, (query[1:] != query[:-1]) | (ask[1:] != ask[:-1])] if len(query) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        keep = np.arange(len(query)) - begin[np.cumsum(new) - 1] < TOP if len(query) else new
        return [x[keep] for x in (query, ask, id_, score)]

    def out(self) -> pa.RecordBatch:
        merged = self._merge()
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in merged], ["query_id", "ask", "vec_id", "score"])


def search(rows: DataFrame, asked: DataFrame, n: int, radius: int) -> DataFrame:
    """(query_id, ask, top): the nearest of ``rows`` within the radius of each query; top has (minus score, vec_id) in order.

    ``rows`` are vec_id, vector and code, ``asked`` the same with query_id and ask, a hash of the vector. Only the counts
    of shards are broadcast: ``TABLES`` * 2 ** ``WIDTH`` rows at most.
    """
    chunk = min(max(n // CHUNK_SHARE, CHUNK_LEAST), CHUNK_MOST)
    lead = min(max(math.ceil(math.log2(max(n / chunk, 1))), 0), WIDTH)
    bounds = bounds_of(radius)
    shard = lambda table: F.shiftright(substring(F.col("code"), table), WIDTH - lead)
    used = [t for t in range(TABLES) if bounds[t] >= 0]
    filed = F.array(*(F.struct(F.lit(t).alias("tab"), shard(t).alias("shard")) for t in used))
    every = F.sequence(F.lit(0), F.lit((1 << lead) - 1))
    near = lambda t: F.transform(F.filter(every, lambda s: F.bit_count(s.bitwiseXOR(shard(t))) <= bounds[t]), lambda s: F.struct(F.lit(t).alias("tab"), s.alias("shard")))
    index = rows.select("*", F.explode(filed).alias("at")).select("vec_id", "vector", "code", "at.*")
    visits = asked.select("*", F.explode(F.flatten(F.array(*map(near, used)))).alias("at")).select("query_id", "ask", "vector", "code", "at.*")
    sizes = index.groupBy("tab", "shard").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    crowds = visits.groupBy("tab", "shard").agg(F.ceil(F.count("*") / HELD).cast("int").alias("crowds"))
    plan = F.broadcast(checkpointed(sizes.join(crowds, ["tab", "shard"])))
    deal = lambda c, k: F.pmod(c, F.col(k)).cast("int")
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    key = ["tab", "shard", "chunk", "crowd"]
    cands = index.join(plan, ["tab", "shard"]).select("tab", "shard", deal(F.xxhash64("vec_id", "code"), "chunks").alias("chunk"), upto("crowds").alias("crowd"), F.lit(1).alias("role"), F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("ask"), "code", "vector")
    asks = visits.join(plan, ["tab", "shard"]).select("tab", "shard", upto("chunks").alias("chunk"), deal(F.xxhash64("query_id", "ask"), "crowds").alias("crowd"), F.lit(0).alias("role"), F.col("query_id").alias("id"), "ask", "code", "vector")

    def run(batches):
        held, present, merged = None, None, Merged()
        for batch in batches:
            columns = np.stack([batch[c].to_numpy() for c in (*key, "role")], axis=1)
            cuts = np.append(np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1, len(columns))
            start = 0
            for end in cuts.tolist():
                if end == start:
                    continue
                *group, role = columns[start].tolist()
                if group != present:
                    if held and merged.add(held.found()):
                        yield merged.out()
                    held, present = Held(group[0], radius), group
                (held.meet if role else held.ask)(batch.slice(start, end - start))
                start = end
        if held:
            merged.add(held.found())
            yield merged.out()

    met = asks.unionByName(cands).repartition(*key).sortWithinPartitions(*key, "role").mapInArrow(run, "query_id long, ask long, vec_id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((0.0 - F.col("score")).alias("less"), "vec_id"))), 1, TOP)
    return met.groupBy("query_id", "ask").agg(best.alias("top"))


def nearest(embeddings: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", radius: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine) of the nearest rows of each row that ``asks`` (of vec_id) chooses."""
    rows, n = sound(embeddings, id_col, vector_col)
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    vectors = matrix(sample["vector"].combine_chunks())
    coder = fit_coder(vectors)
    rows = checkpointed(coded(rows, coder))
    radius = measured_radius(rows, sample["vec_id"].to_numpy()[:PROBES], vectors[:PROBES], coder) if radius is None else radius
    asked = checkpointed(rows.where(asks).select(F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("ask"), "vector", "code").dropDuplicates(["query_id", "ask"]))
    done = None
    while True:
        found = checkpointed(search(rows, asked, n, radius))
        full = found if radius >= BITS else found.where(F.size("top") == TOP)
        done = full if done is None else done.unionByName(full)
        if radius >= BITS:
            break
        asked = checkpointed(asked.join(full, ["query_id", "ask"], "left_anti"))
        if not asked.take(1):
            break
        radius = min(radius + WIDER, BITS)
    return done.select("query_id", F.posexplode("top").alias("i", "t")).select("query_id", (F.col("i") + 1).alias("rank"), "t.vec_id", (0.0 - F.col("t.less")).alias("score"))
