"""SimHash near-dedup: fingerprints, shards of nodes that share a key, and a BK-tree in every shard.

Rows with equal fingerprints (near copies: equal sets of shingles) are one node. Each node goes to several shards. In a
shard the nodes form a BK-tree whose children are keyed by their Hamming distance to the parent; a query follows only
edges whose key differs from its distance by the radius at most. A shard emits a spanning forest of its links, not its
pairs; connected components over those edges give the groups.

``simhash_components`` is exact: for a radius r and B blocks of bits, one table of shards for each choice of B - r blocks
finds every pair within r (the pigeonhole principle), and B grows with the number of nodes so that shards stay small.
``near_copy_components`` finds texts by the similarity of their sets of shingles; there a shard holds the nodes whose
least shingle, by one of ``TABLES`` hash orders, is the same. A pair of similarity s shares a shard with probability
1 - (1 - s)^8 (0.999997 at 0.8), whatever the number of documents.

A group of more nodes than its bound is cut in chunks. The first chunk's tree meets all chunks; what it links is one
component already, so only the rest, chunk by chunk, meets all chunks again. No pair that could join two components is
left out, and a large group of near copies costs time in proportion to its size. Trees and chunks travel with the
shuffle: trees of all fingerprints would grow with the data, so they are not broadcast. A task reads its shards one
after the other and holds one bounded stretch of them.

Texts are never cut. Null texts count as empty; texts without words have fingerprint 0 and link like any other. Ties
don't matter: a group is named by its smallest doc_id. Rows with a null doc_id are returned, but name no group. Rows
that share a doc_id but not their text are nodes of their own. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, join_spread, over_batches, texts
from .components import connected_components

SEED = 42
RADIUS = 4
#: Most nodes of a chunk of a shard, and the mean number of nodes of a shard that the exact tables aim at.
SHARD = 8192
MEAN_SHARD = 64
#: Most documents and shingles (about) of a chunk whose texts are compared exactly.
CHUNK_DOCS, CHUNK_SHINGLES = 1024, 1 << 18
#: Pairs of query and tree node that are compared at a time; rows and bytes of shards that are held at a time.
FRONTIER = 1 << 20
HELD_ROWS, HELD_BYTES = 1 << 15, 1 << 25
#: Most groups above their bound whose keys are broadcast (some MB); more are joined by a shuffle.
BROADCAST_GROUPS = 100_000

# Odd multipliers that make further 64-bit hashes from one.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
#: The same for the orders in which shingles are least; each order is a table of shards.
ORDERS = tuple(m ^ 0x5851F42D4C957F2C for m in MULTIPLIERS) + tuple(m ^ 0x14057B7EF767814E for m in MULTIPLIERS)
TABLES = len(ORDERS)


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-k])).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def remixed(hashes: np.ndarray, multiplier: int) -> np.ndarray:
    h = hashes * np.uint64(multiplier)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprint(text: str, shingles: tuple[int, ...], wide: bool) -> bytes:
    """64 bits for each shingle size, or 256 each if wide; big-endian."""
    words, out = text.encode().lower().split(), []
    for k in shingles:
        h = shingle_hashes(words, k)
        out += [majority(remixed(h, m)) for m in MULTIPLIERS] if wide else [majority(h)]
    return b"".join(x.to_bytes(8, "big") for x in out)


def copy_print(text: str) -> tuple[bytes, bytes, int, np.ndarray]:
    """256 bits over the distinct five-word shingles of a text, a digest of their set, their number, and the least ones.

    A text without words has one shingle of its own, so that it shares shards with its like.
    """
    h = np.unique(shingle_hashes(text.encode().lower().split(), 5))
    bits = b"".join(majority(remixed(h, m)).to_bytes(8, "big") for m in MULTIPLIERS)
    some = h if len(h) else np.zeros(1, np.uint64)
    least = np.array([remixed(some, m).min() for m in ORDERS])
    return bits, xxhash.xxh3_128_digest(h.tobytes()), len(h), least.view(np.int64)


def copy_prints(docs: DataFrame) -> DataFrame:
    """doc_id, own (a hash of the text), node (equal for equal sets of shingles), fingerprint, size and least of every row."""
    names = ["doc_id", "own", "node", "fingerprint", "size", "least"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits, same, size, least = zip(*map(copy_print, batch["text"].to_pylist()), strict=True) if batch.num_rows else ((), (), (), ())
        columns = [pa.array(same, pa.binary()), pa.array(bits, pa.binary()), pa.array(size, pa.int64()), pa.array(least, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["own"], *columns], names)

    return over_batches(texts(docs).withColumn("own", F.xxhash64("text")), run, "doc_id long, own long, node binary, fingerprint binary, size long, least array<long>")


def simhashes(docs: DataFrame, shingles: tuple[int, ...] = (4,), wide: bool = False) -> DataFrame:
    """doc_id and fingerprint (binary) of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([fingerprint(t, shingles, wide) for t in batch["text"].to_pylist()], pa.binary())], ["doc_id", "fingerprint"])

    return over_batches(texts(docs), run, "doc_id long, fingerprint binary")


def exact_tables(nodes: int, bits: int = 64, radius: int = RADIUS) -> list[list[int]]:
    """Bit positions of tables that together hold every pair within the radius in one shard at least."""
    for blocks in range(radius + 1, bits + 1):
        parts = [list(p) for p in np.array_split(np.arange(bits), blocks)]
        tables = [sum(c, []) for c in itertools.combinations(parts, blocks - radius)]
        if nodes <= MEAN_SHARD << min(map(len, tables)) or len(tables) > 500:
            return tables
    return tables


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class BKForest:
    """A BK-tree for each shard; built and searched level by level for all shards at once.

    ``shard`` is ascending; the first row of a shard is its root. The children of a node, ordered by their key, lie
    behind one another in ``child``.
    """

    def __init__(self, codes: np.ndarray, shard: np.ndarray):
        self.codes, n = codes, len(codes)
        key, parent = np.zeros(n, np.int64), np.full(n, -1)
        rest, group, above, edge = np.arange(n), shard, np.full(n, -1), np.zeros(n, np.int64)
        while len(rest):
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            size = np.diff(np.append(first, len(rest)))
            root = np.repeat(rest[first], size)
            parent[rest[first]], key[rest[first]] = above[first], edge[first]
            left = np.ones(len(rest), bool)
            left[first] = False
            rest, above = rest[left], root[left]
            edge = distance(codes[rest], codes[above])
            order = np.lexsort((rest, edge, above))
            rest, above, edge = rest[order], above[order], edge[order]
            group = above * 1024 + edge
        self.key = key
        self.child = np.lexsort((key, parent))
        bounds = np.searchsorted(parent[self.child], np.arange(n + 1))
        self.begin, self.count = bounds[:-1], np.diff(bounds)
        self.roots = np.flatnonzero(parent < 0)
        self.root_shard = shard[self.roots]

    def within(self, queries: np.ndarray, shard: np.ndarray, radius: int):
        """Yields arrays (query, node) of pairs within the radius, each query in the tree of its shard."""
        at = np.searchsorted(self.root_shard, shard)
        hit = np.minimum(at, max(len(self.roots) - 1, 0))
        known = (self.root_shard[hit] == shard) if len(self.roots) else np.zeros(len(shard), bool)
        todo = [(np.flatnonzero(known), self.roots[hit[known]])]
        while todo:
            q, node = todo.pop()
            if len(q) > FRONTIER:
                todo += [(q[FRONTIER:], node[FRONTIER:])]
                q, node = q[:FRONTIER], node[:FRONTIER]
            d = distance(queries[q], self.codes[node])
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            n = self.count[node]
            if n.any():
                which = np.repeat(np.arange(len(q)), n)
                child = self.child[np.arange(n.sum()) + np.repeat(self.begin[node] - (np.cumsum(n) - n), n)]
                follow = np.abs(self.key[child] - d[which]) <= radius
                if follow.any():
                    todo.append((q[which[follow]], child[follow]))


class Groups:
    """Least labels of linked rows."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            low = np.minimum(x, y)
            np.minimum.at(self.label, x, low)
            np.minimum.at(self.label, y, low)
            while (self.label != self.label[self.label]).any():
                self.label = self.label[self.label]


def _groups(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each row's group; rows are sorted by ``keys``."""
    new = np.zeros(max(len(rows) - 1, 0), bool)
    for c in keys:
        values = rows[c].combine_chunks()
        new |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(np.r_[False, new])[: len(rows)]


def by_group(rows: DataFrame, keys: list[str], find) -> DataFrame:
    """Edges (a, b) that ``find`` makes of whole groups; a task holds one group, or a stretch of small ones, at a time."""

    def run(batches):
        held, n, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n > HELD_ROWS or size > HELD_BYTES:
                got = pa.Table.from_batches(held).combine_chunks()
                border = int(np.searchsorted(group := _groups(got, keys), group[-1]))
                if border:
                    yield find(got.slice(0, border), group[:border])
                rest = got.slice(border).combine_chunks()
                held, n, size = rest.to_batches(), rest.num_rows, rest.nbytes
        if n:
            got = pa.Table.from_batches(held).combine_chunks()
            yield find(got, _groups(got, keys))

    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a binary, b binary")


def spanning(rows: DataFrame, keys: list[str], large: DataFrame, find, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that keep every component of the links that ``find`` sees within groups of ``rows``.

    ``large`` has the ``keys`` of groups above the bound and the number of their ``chunks``. ``find`` gets groups with
    roles: 0 (tree and query), 1 (tree only) or 2 (query only).
    """
    meeting = [*keys, "one", "two"]
    n_large = large.count()
    met = rows.join(F.broadcast(large) if n_large <= BROADCAST_GROUPS else large, keys, "left") if n_large else rows.withColumn("chunks", F.lit(1))
    placed = met.withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    at = lambda one, two, role: F.struct(one.cast("int").alias("one"), two.cast("int").alias("two"), role.alias("role"))
    upto = lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))
    zero, columns = F.lit(0), rows.columns
    leaders = F.transform(upto(F.col("chunks")), lambda x: at(zero, x, F.when(x == 0, 0).otherwise(1)))
    dealt = placed.withColumn("meet", F.explode(F.when(F.col("mine") == 0, leaders).otherwise(F.array(at(zero, F.col("mine"), zero)))))
    first = by_group(dealt.select(*columns, "meet.*"), meeting, find)
    if not n_large:
        return first
    first = scratch.write(first)
    linked = connected_components(first, scratch).select("node", F.col("component").alias("linked"))
    labelled = placed.where("chunks > 1").join(linked, "node", "left").withColumn("label", F.coalesce("linked", "node"))
    sizes = labelled.groupBy(*keys, "chunks", "label").agg(F.count("*").alias("n")).groupBy(*keys, "chunks").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
    rests = scratch.write(sizes.where("all > most").select(*keys, "main", F.ceil((F.col("all") - F.col("most")) * F.col("chunks") / F.col("all")).cast("int").alias("rests")))
    n_rests = rests.count()
    if not n_rests:
        return first
    again = labelled.join(F.broadcast(rests) if n_rests <= BROADCAST_GROUPS else rests, keys)
    asks = again.withColumn("meet", F.explode(F.transform(upto(F.col("rests")), lambda x: at(x, F.col("mine"), F.lit(2)))))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rests"))
    trees = again.where("label <> main").withColumn("meet", F.explode(F.transform(upto(F.col("chunks")), lambda x: at(own, x, F.lit(1)))))
    return first.unionByName(by_group(asks.unionByName(trees).select(*columns, "meet.*"), meeting, find))


def near_in_shards(radius: int):
    """For ``spanning``: links of fingerprints within the radius, by the BK-trees of all shards of a stretch."""

    def find(rows: pa.Table, shard: np.ndarray) -> pa.RecordBatch:
        several = np.bincount(shard, minlength=1)[shard] > 1
        rows, shard = rows.filter(pa.array(several)).combine_chunks(), shard[several]
        if not len(rows):
            return pa.RecordBatch.from_arrays([pa.array([], pa.binary())] * 2, ["a", "b"])
        codes = np.frombuffer(b"".join(rows["fingerprint"].to_pylist()), ">u8").astype(np.uint64).reshape(len(rows), -1)
        role, groups = rows["role"].to_numpy(), Groups(len(rows))
        in_tree, asks = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        if len(in_tree):
            for q, t in BKForest(codes[in_tree], shard[in_tree]).within(codes[asks], shard[asks], radius):
                a, b = asks[q], in_tree[t]
                keep = (a < b) | (role[a] == 2) | (role[b] == 1)
                held.append((a[keep], b[keep]))
                if sum(len(x) for x, _ in held) > FRONTIER:
                    groups.link(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            groups.link(*map(np.concatenate, zip(*held, strict=True)))
        tied = np.flatnonzero(groups.label != np.arange(len(rows)))
        node = rows["node"].combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(tied)), node.take(pa.array(groups.label[tied]))], ["a", "b"])

    return find


def shard_links(rows: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that keep every component of the links within shards (tab, key) of nodes (node, fingerprint)."""
    sizes = rows.groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
    large = scratch.write(sizes.select("tab", "key", F.ceil(F.col("n") / SHARD).cast("int").alias("chunks")))
    return spanning(rows.select("tab", "key", "node", "fingerprint"), ["tab", "key"], large, near_in_shards(radius), scratch)


def dealt(nodes: DataFrame, tables: list[list[int]]) -> DataFrame:
    """(tab, key, node, fingerprint): each node in one shard of every table of bit positions."""
    places = [np.array(t) for t in tables]

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(batch["fingerprint"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        bits = np.unpackbits(raw, axis=1)
        keys = np.concatenate([bits[:, p].astype(np.int64) @ (1 << np.arange(len(p), dtype=np.int64)) for p in places])
        index = pa.array(np.tile(np.arange(batch.num_rows), len(places)))
        tab = pa.array(np.repeat(np.arange(len(places), dtype=np.int32), batch.num_rows))
        return pa.RecordBatch.from_arrays([tab, pa.array(keys), batch["node"].take(index), batch["fingerprint"].take(index)], ["tab", "key", "node", "fingerprint"])

    return over_batches(nodes.select("node", "fingerprint"), deal, "tab int, key long, node binary, fingerprint binary")


def named(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, doc_id, component (the least node that ``edges`` tie to it, at least itself) and whether there are any edges."""
    found = connected_components(edges, scratch)
    rooted = nodes.select("node", "doc_id").join(found, "node", "left")
    return rooted.select("node", "doc_id", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("tied"))


def with_least(rows: DataFrame) -> DataFrame:
    """``rows`` (component, doc_id, tied, ...) with component_id, the least doc_id of the component."""
    least = rows.where("tied").groupBy("component").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "component", "left").withColumn("component_id", F.when(F.col("tied"), F.col("least")).otherwise(F.col("doc_id"))).drop("least")


def components(prints: DataFrame, tables_for=exact_tables, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint and component_id of rows (doc_id, fingerprint), exactly; equal fingerprints are one node."""
    scratch = Scratch(prints.sparkSession)
    prints = scratch.write(prints.select("doc_id", "fingerprint"))
    nodes = scratch.write(prints.groupBy(F.col("fingerprint").alias("node")).agg(F.min("doc_id").alias("doc_id")))
    links = shard_links(dealt(nodes.withColumn("fingerprint", F.col("node")), tables_for(nodes.count())), radius, scratch)
    ids = with_least(named(nodes, links, scratch))
    return prints.join(ids.select(F.col("node").alias("fingerprint"), "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """Exact groups of 64-bit fingerprints of 4-word shingles that differ in 4 bits at most."""
    return components(simhashes(docs))


#: Least share of common five-word shingles (distinct ones) among all of two near copies.
SIMILARITY = 0.8
#: A pair of that similarity differs in 38.8 of 256 bits on the mean (256 acos(2 s / (1 + s)) / pi for sets of one size),
#: with a standard deviation of 5.7. The radius is four of them above the mean.
NEAR_RADIUS = 62
#: A pair of similarity 0.8 agrees in three of the orders at least with probability 0.9988, so it mostly meets several times.
LEVELS = 3
#: Ratio of the sizes of neighbouring classes of sets; pairs of ``SIMILARITY`` differ by that factor at most.
SIZE_STEP = 1 / SIMILARITY


def size_class(size: Column) -> Column:
    """The class of a set's size. Sets of ``SIMILARITY`` lie in one class or in neighbouring ones (rounding is allowed for)."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(math.log(SIZE_STEP) * (1 + 1e-9))).cast("long")


def near_shards(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(tab, key, node, fingerprint): shards of nodes with the same least shingle by an order; ``tab`` is the order.

    Where many documents share a passage, its shingles fill a shard. Such a shard is dealt by classes of the sets' sizes,
    each node to its own class and the next, so that every pair that could have ``SIMILARITY`` still meets; what is
    above the bound then is compared chunk by chunk (``spanning``). No pair of a shard is left out.
    """
    rows = nodes.select("node", "fingerprint", "size", F.posexplode("least").alias("tab", "key"))
    large = scratch.write(rows.groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).select("tab", "key", F.lit(True).alias("crowded")))
    n_large = large.count()
    if not n_large:
        return rows.select("tab", "key", "node", "fingerprint")
    met = rows.join(F.broadcast(large) if n_large <= BROADCAST_GROUPS else large, ["tab", "key"], "left")
    own = size_class(F.col("size"))
    keys = F.when(F.col("crowded"), F.array(F.xxhash64("key", own), F.xxhash64("key", own + 1))).otherwise(F.array("key"))
    return met.select("tab", F.explode(keys).alias("key"), "node", "fingerprint")


def alike(sets: list[np.ndarray], role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row, least row) of the pairs of sets with ``SIMILARITY``; of roles 1 and 2, only across."""
    size = np.array([len(x) for x in sets], np.int64)
    at = np.append(0, np.cumsum(size))
    _, items = np.unique(np.concatenate(sets), return_inverse=True)
    groups, flags = Groups(len(sets)), np.zeros(len(items) + 1, np.int8)
    for i in range(len(sets)):
        fit = (groups.label != groups.label[i]) & ((role == 0) | (role != role[i]))
        fit &= np.minimum(size, size[i]) >= SIMILARITY * np.maximum(size, size[i])
        fit[: i + 1] = False
        if not fit.any():
            continue
        flags[items[at[i] : at[i + 1]]] = 1
        other = np.flatnonzero(fit)
        begins = np.append(0, np.cumsum(size[other])[:-1])
        taken = items[np.repeat(at[other] - begins, size[other]) + np.arange(size[other].sum())]
        common = np.add.reduceat(flags[taken], begins, dtype=np.int64) if len(taken) else np.zeros(len(other), np.int64)
        flags[items[at[i] : at[i + 1]]] = 0
        other = other[common >= SIMILARITY * (size[i] + size[other] - common)]
        groups.link(np.full(len(other), i), other)
    tied = np.flatnonzero(groups.label != np.arange(len(sets)))
    return tied, groups.label[tied]


def alike_in_groups(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
    """For ``spanning``: links of texts whose sets of shingles have ``SIMILARITY``; a repeated node counts once.

    A text that has another set than its node (another one under the same id) is left out.
    """
    node, role = rows["node"].to_pylist(), rows["role"].to_numpy()
    sets = {}
    for i, text in enumerate(rows["text"]):
        if node[i] not in sets:
            made = np.unique(shingle_hashes(text.as_py().encode().lower().split(), 5))
            if xxhash.xxh3_128_digest(made.tobytes()) == node[i]:
                sets[node[i]] = made
    known = np.flatnonzero([x in sets for x in node])
    first = known[[i == 0 or group[x] != group[y] or node[x] != node[y] or role[x] != role[y] for i, (x, y) in enumerate(zip(known, np.roll(known, 1), strict=True))]]
    a, b = [], []
    for one in np.split(first, np.flatnonzero(np.diff(group[first])) + 1):
        if len(one) > 1:
            x, y = alike([sets[node[i]] for i in one], role[one])
            a += one[x].tolist()
            b += one[y].tolist()
    return pa.RecordBatch.from_arrays([pa.array([node[i] for i in a], pa.binary()), pa.array([node[i] for i in b], pa.binary())], ["a", "b"])


def exact_links(docs: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that keep every component of the pairs with ``SIMILARITY`` within groups of ``members``.

    ``members`` are component, node, doc_id (of a row with that set of shingles) and size. Texts are read again; of a
    doc_id with several texts only those of the node count. Texts travel to their groups, where their sets are made:
    hashes take more bytes than the words they stand for, and don't compress.
    """
    found = texts(docs).join(members.select("doc_id", "component", "node"), "doc_id").select("component", "node", "text")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_DOCS), F.ceil(F.sum("size") / CHUNK_SHINGLES)).cast("int").alias("chunks")
    large = scratch.write(members.groupBy("component").agg(chunks).where("chunks > 1"))
    return spanning(found, ["component"], large, alike_in_groups, scratch)


def near_copy_groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, own (xxhash64 of the text), component (a node's digest), and tied, of every row.

    Groups of near fingerprints are candidates only. Within each, texts are held to the exact similarity of their
    distinct five-word shingles; texts with equal sets of shingles are one node, whose digest names it: two texts under
    one doc_id are two nodes. A node whose rows all have null ids links nothing. All tables lie in ``scratch``.
    """
    prints = scratch.write(copy_prints(docs))
    kinds = prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("fingerprint").alias("fingerprint"), F.first("size").alias("size"), F.first("least").alias("least"))
    nodes = scratch.write(kinds.where("doc_id is not null"))
    links = scratch.write(shard_links(near_shards(nodes, scratch), NEAR_RADIUS, scratch))
    candidates = scratch.write(named(nodes, links, scratch).where("tied").join(nodes.select("node", "size"), "node"))
    ids = named(nodes, scratch.write(exact_links(docs, candidates, scratch)), scratch)
    return prints.select("doc_id", "own", "node").join(ids.select("node", "component", "tied"), "node", "left").select("doc_id", "own", F.coalesce("component", "node").alias("component"), F.coalesce("tied", F.lit(False)).alias("tied"))


def near_copy_components(docs: DataFrame) -> DataFrame:
    """doc_id, own (xxhash64 of the text) and component_id: the least doc_id of the group that links of ``SIMILARITY`` hold together."""
    scratch = Scratch(docs.sparkSession)
    groups = near_copy_groups(docs, scratch)
    least = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = checkpointed(groups.join(least, "component").select("doc_id", "own", "component_id"))
    scratch.clear()
    return out


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest doc_id stays.

    Of a group's rows with that id, the one whose text has the least hash stays, and of rows that repeat it, one. Rows
    with a null doc_id stay. Groups are named by their node and rows are told apart by id and text, so neither a row nor
    a group goes because another shares its id. Intermediate tables are deleted before this returns.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(near_copy_groups(docs, scratch).where("doc_id is not null").groupBy("doc_id", "own").agg(F.first("component").alias("component"), F.count("*").alias("n")))
    heads = scratch.write(rows.groupBy("component").agg(F.min(F.struct("doc_id", "own")).alias("head"), F.count("*").alias("n"), F.max("n").alias("most")).where("n > 1 or most > 1").drop("most"))
    judged = join_spread(rows.withColumnRenamed("n", "times"), heads, "component").withColumn("stays", F.struct("doc_id", "own") == F.col("head"))
    marks = checkpointed(judged.where("not stays or times > 1").select(F.col("doc_id").alias("i"), F.col("own").alias("h"), "stays"))
    scratch.clear()
    whole = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    met = whole.join(marks, (F.col("row.doc_id") == F.col("i")) & (F.col("own") == F.col("h")), "left")
    once = met.where("stays").groupBy("i", "h").agg(F.first("row").alias("row")).select("row")
    return met.where("stays is null").select("row").unionByName(once).select("row.*")
