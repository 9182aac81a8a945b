"""A Merkle manifest of a dataset, with an authentication path for every document, by fractal traversal.

Documents are leaves; those of one language, in the order of their ids, form a tree, and the languages' roots form the
tree above. Leaves are dealt in aligned blocks of ``BLOCK`` (a power of two), so that a block's nodes belong to nobody
else. A task walks its blocks leaf by leaf with two stacks of subtrees of height ``STEP``: the existing ones hold all
siblings of the present leaf, the desired ones grow by one leaf a step and stand ready when the walk leaves an existing
one. So paths come out in order, from memory of a few subtrees. Blocks' roots are the leaves of the level above, which
is walked in the same way until one block is left; a block's upper path comes back to it as its first row.

A run of one node is hashed alone, so a path has no sibling there. Nulls are written ``-``. Null languages form a tree
of their own, the first one. Rows with a null doc_id come first and are never tampered with; rows that repeat an id are
ordered by their leaf; rows that repeat a leaf too get neighbouring places. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ranking import rank_by_range, running_sums
from .common import checkpointed

#: Height of a subtree, and levels and leaves of a block.
STEP, LEVELS = 5, 10
BLOCK = 1 << LEVELS


def joined(left: str | None, right: str | None) -> str | None:
    """The node above two nodes, of which the right one or both may not exist."""
    return None if left is None else sha256((left + (right or "")).encode()).hexdigest()


class Subtree:
    """The nodes from one root at level ``top`` down to the next multiple of ``STEP``, filled leaf by leaf from the left."""

    def __init__(self, index: int, top: int):
        self.index, self.top, self.low = index, top, max(top - 1, 0) // STEP * STEP
        self.next, self.nodes, self.open = index << top, {}, []

    def grow(self, leaves: list[str]) -> None:
        """Take the next leaf (none beyond the last) and close the nodes that end with it."""
        at, level = self.next, 0
        node = leaves[at] if at < len(leaves) else None
        while True:
            if level >= self.low:
                self.nodes[level, at] = node
            if level == self.top:
                break
            if at % 2 == 0:
                self.open.append(node)
                break
            node, at, level = joined(self.open.pop(), node), at // 2, level + 1
        self.next += 1

    def whole(self) -> bool:
        return self.next == (self.index + 1) << self.top


def height_of(n: int) -> int:
    """Levels from ``n`` nodes to one."""
    return max(n - 1, 0).bit_length()


def block_root(leaves: list[str], height: int) -> str:
    tree = Subtree(0, height)
    while not tree.whole():
        tree.grow(leaves)
    return tree.nodes[height, 0]


def traversed(leaves: list[str], height: int) -> Iterator[str]:
    """The path of each leaf in order: for each level L or R (the sibling's side) and its digest, or ``-`` without one."""
    tops = sorted({min(t, height) for t in range(STEP, height + STEP, STEP)}) if height else []
    exist = [Subtree(0, top) for top in tops]
    for tree in exist:
        while not tree.whole():
            tree.grow(leaves)
    desired = [Subtree(1, top) for top in tops]
    for at in range(len(leaves)):
        for i, top in enumerate(tops):
            if at >> top != exist[i].index:
                exist[i], desired[i] = desired[i], Subtree((at >> top) + 1, top)
        path = []
        for level in range(height):
            tree = exist[level // STEP]
            sibling = tree.nodes[level, (at >> level) ^ 1]
            path.append("-" if sibling is None else ("L" if at >> level & 1 else "R") + sibling)
        yield "".join(path)
        for i, top in enumerate(tops):
            if top < height and (desired[i].index << top) < len(leaves):
                desired[i].grow(leaves)


def siblings(path: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(path):
        side = path[at]
        yield side, "" if side == "-" else path[at + 1 : at + 65]
        at += 1 if side == "-" else 65


def folded(leaf: str, path: str) -> str:
    """The root that a leaf and its path lead to."""
    for side, node in siblings(path):
        leaf = sha256((node + leaf if side == "L" else leaf + node).encode()).hexdigest()
    return leaf


def proof_digest(path: str) -> str:
    return sha256("".join(node for _, node in siblings(path)).encode()).hexdigest()


def _blocks(batches) -> Iterator[pa.Table]:
    """Whole blocks of rows sorted by (key, block); one block is held at a time, besides a batch."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        held, keys, blocks = None, rows["key"].to_pylist(), rows["block"].to_pylist()
        start = 0
        for i in range(1, len(rows)):
            if blocks[i] != blocks[start] or keys[i] != keys[start]:
                yield rows.slice(start, i - start)
                start = i
        held = rows.slice(start)
    if held is not None and len(held):
        yield held


def _block_height(n: int) -> int:
    """Levels inside a block of a tree with ``n`` nodes in all."""
    return min(height_of(n), LEVELS)


def by_block(rows: DataFrame, fn, schema: str) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "place").mapInArrow(fn, schema)


def block_roots(nodes: DataFrame) -> DataFrame:
    """(key, place, digest, n): the root of every block of ``nodes`` (key, place, digest, n), a node of the level above."""

    def run(batches):
        for rows in _blocks(batches):
            n = rows["n"][0].as_py()
            root = block_root(rows["digest"].to_pylist(), _block_height(n))
            yield pa.RecordBatch.from_pylist([{"key": rows["key"][0].as_py(), "place": rows["block"][0].as_py(), "digest": root, "n": -(-n // BLOCK)}], pa.schema([("key", pa.string()), ("place", pa.int64()), ("digest", pa.string()), ("n", pa.int64())]))

    placed = nodes.select("key", "place", "digest", "n", F.floor(F.col("place") / BLOCK).alias("block"))
    return by_block(placed, run, "key string, place long, digest string, n long")


def authenticated(nodes: DataFrame) -> DataFrame:
    """(key, place, path, top): the path of every node of ``nodes`` (key, place, digest, n) to the top of its key's tree.

    Blocks' roots are authenticated first, level by level; each level is the 1,024th part of the one below.
    """
    return walked(nodes, upper_paths(nodes), _emit_paths, "key string, place long, path string, top string")


def upper_paths(nodes: DataFrame) -> DataFrame:
    """(key, place, path, top) of the roots of all blocks of ``nodes``; place is the block's number."""
    roots = checkpointed(block_roots(nodes))
    if roots.where("n > 1").take(1):
        return checkpointed(authenticated(roots))
    return roots.select("key", "place", F.lit("").alias("path"), F.col("digest").alias("top"))


def walked(nodes: DataFrame, uppers: DataFrame, emit, schema: str) -> DataFrame:
    """Walk every block of ``nodes``; its upper path comes as the block's first row, place -1."""
    placed = nodes.withColumn("block", F.floor(F.col("place") / BLOCK))
    first = uppers.select("key", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), *(c for c in uppers.columns if c not in ("key", "place")))

    def run(batches):
        for rows in _blocks(batches):
            yield emit(rows)

    return by_block(placed.unionByName(first, allowMissingColumns=True), run, schema)


def _emit_paths(rows: pa.Table) -> pa.RecordBatch:
    upper, top, leaves = rows["path"][0].as_py(), rows["top"][0].as_py(), rows.slice(1)
    paths = [p + upper for p in traversed(leaves["digest"].to_pylist(), _block_height(leaves["n"][0].as_py()))]
    columns = [leaves["key"].combine_chunks(), leaves["place"].combine_chunks(), pa.array(paths, pa.string()), pa.array([top] * len(paths), pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["key", "place", "path", "top"])


OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _emit_proofs(rows: pa.Table) -> pa.RecordBatch:
    upper, subroot, root, leaves = rows["path"][0].as_py(), rows["top"][0].as_py(), rows["root"][0].as_py(), rows.slice(1)
    digests, changed = leaves["digest"].to_pylist(), leaves["tampered"].to_pylist()
    proofs, roots = [], []
    for leaf, other, path in zip(digests, changed, traversed(digests, _block_height(leaves["n"][0].as_py())), strict=True):
        proofs.append(proof_digest(path + upper))
        roots.append(folded(other or leaf, path + upper))
    same = [subroot] * len(proofs), [root] * len(proofs)
    columns = [leaves["doc_id"].combine_chunks(), leaves["digest"].combine_chunks(), *(pa.array(x, pa.string()) for x in (*same, proofs, roots)), pa.array([x == root for x in roots], pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(n_chars: Column) -> Column:
    return F.sha2(F.concat(_field(F.col("doc_id")), _field(F.col("source")), _field(F.col("lang")), _field(n_chars), _field(F.col("text"))).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """key (of the language; the null one sorts first), doc_id, digest, and tampered: the changed row's digest where one is tried."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    key = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("lang")))
    return docs.select(key.alias("key"), F.col("doc_id").cast("long"), _leaf(F.col("n_chars")).alias("digest"), F.when(chosen, _leaf(more)).alias("tampered"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    Texts are read once, for their leaves. Places within a language come from a range shuffle and running sums, so a
    language that holds most rows is ordered by many tasks.
    """
    # Rows that repeat all else are told apart by where they were written.
    found = checkpointed(leaves(docs).withColumn("one", F.lit(1).cast("long")).withColumn("tie", F.monotonically_increasing_id()))
    placed = running_sums(found, ["key"], [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("tie")], {"one": "place"})
    nodes = checkpointed(placed.select("key", (F.col("place") - 1).alias("place"), "digest", F.col("place_all").alias("n"), "doc_id", "tampered"))
    uppers = checkpointed(upper_paths(nodes.select("key", "place", "digest", "n")))
    tops = uppers.groupBy("key").agg(F.first("top").alias("digest"))
    ranked = checkpointed(rank_by_range(tops, ["key"], "place").withColumnRenamed("key", "lang_key"))
    above = ranked.select(F.lit("").alias("key"), "place", "digest", F.lit(ranked.count()).cast("long").alias("n"))
    roots = authenticated(above).select("place", F.col("path").alias("lang_path"), F.col("top").alias("root"))
    by_lang = ranked.join(roots, "place").select(F.col("lang_key").alias("key"), "lang_path", "root")
    whole = uppers.join(by_lang, "key").select("key", "place", F.concat("path", "lang_path").alias("path"), "top", "root")
    return walked(nodes, whole, _emit_proofs, OUT)
