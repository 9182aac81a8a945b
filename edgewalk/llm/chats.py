r"""Chat formatting: a prefix tree of conversations, shared turns emitted once, depth first.

A turn is ``<|im_start|>role\ntext<|im_end|>\n``; the two marks are token ids of their own. In texts and roles, ``<``,
any backslashes, ``|`` gains one backslash, so no control string is left and the change can be undone; in roles,
backslashes and line ends are escaped too. Head, body and tail of a turn are tokenised apart, so conversations with the
same first turns share the same tokens, and the loss mask (assistant bodies) falls on whole tokens.

Each turn has a key that chains over the turns before it. Conversations are sorted by their lists of keys, which is the
tree's depth-first order; the first conversation that holds a turn owns it. A conversation's own turns form a segment
of the packed stream, with its start there and the position id of its first token. Besides itself, it may attend only to
the intervals of the stream that hold its ancestors.

Turns are ordered by turn, role and text; null texts and roles are empty; rows with a null conv_id form one
conversation. Repeated conversations own nothing and consist of ancestors. An empty table gives empty results.

A row holds one turn at most, or an interval of up to ``BLOCK`` turns, so no row grows with a conversation. Only the keys
of turns that a conversation shares with others, and one more, make its sorting key (16 bytes each). Turns are tokenised
and decoded where they lie; the chain of keys and the digests, which follow a conversation's order, stream through one
task for each conversation, one turn at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, over_batches, tokenizer_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
#: Most turns that one interval covers.
BLOCK = 1024
# Fixed value: the splitting pattern of the vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Coder:
    """The vocabulary's encoding with two more ids for the marks; built once in each Python worker."""

    def __init__(self, path: str | None = None):
        with open(path or tokenizer_path(VOCABULARY), "rb") as f:
            self.data = f.read()
        self._own = None

    def __getstate__(self):
        return {"data": self.data, "_own": None}

    @property
    def own(self):
        if self._own is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}
            top = max(ranks.values()) + 1
            self._own = tiktoken.Encoding("chats", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={START: top, END: top + 1})
        return self._own

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Token ids of a turn, and where its body begins and ends among them."""
        e = self.own
        head = [e.encode_single_token(START), *e.encode_ordinary(escape_role(role) + "\n")]
        body = e.encode_ordinary(escape(text))
        return [*head, *body, e.encode_single_token(END), *e.encode_ordinary("\n")], len(head), len(head) + len(body)

    def text(self, ids: list[int]) -> str:
        return self.own.decode_bytes(ids).decode()


class Packed(NamedTuple):
    """A packed stream.

    segments: rank, conv_id, start, length, position; one row for each conversation, in the order of ``start``.
    turns: rank, conv_id, depth, start, position, size, loss_from, loss_to, tokens; one row for each turn of the stream.
    intervals: rank, conv_id, owner, position, start, length, first_depth, last_depth; where a conversation's turns lie,
    those of ancestors (``owner`` differs from ``rank``) and its own.
    """

    segments: DataFrame
    turns: DataFrame
    intervals: DataFrame


def tokenised(conversations: DataFrame, coder: Coder) -> DataFrame:
    """One row for each turn: conv (conv_id as text) and the table's columns, tokens, size, the body under the loss, and a digest."""
    shared = conversations.sparkSession.sparkContext.broadcast(coder)
    conv_id, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    rows = conversations.select(
        F.coalesce(conv_id.cast("string"), F.lit("")).alias("conv"), conv_id.alias("conv_id"), turn.alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )

    def run(batch):
        tokens, size, begin, end, digest = [], [], [], [], []
        for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
            ids, a, b = shared.value.turn(role, text)
            r = role.encode()
            tokens.append(np.array(ids, "<i4").tobytes())
            size.append(len(ids))
            begin.append(a)
            end.append(b if role == "assistant" else a)
            digest.append(hashlib.blake2b(struct.pack("<q", len(r)) + r + text.encode(), digest_size=16).digest())
        more = [pa.array(tokens, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, begin, end)), pa.array(digest, pa.binary())]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "tokens", "size", "loss_from", "loss_to", "digest"])

    return over_batches(rows, run, "conv string, conv_id long, turn long, role string, text string, tokens binary, size long, loss_from long, loss_to long, digest binary")


def keyed_turns(conversations: DataFrame, coder: Coder) -> DataFrame:
    """Tokenised turns with their depth, their chained key and the position of their first token."""
    dealt = tokenised(conversations, coder).repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    kept = dealt.select("conv", "conv_id", "digest", "size", "loss_from", "loss_to", "tokens")

    def run(batches):
        conv, depth, key, position = None, 0, b"", 0
        for batch in batches:
            depths, keys, positions = [], [], []
            for c, digest, size in zip(*(batch[n].to_pylist() for n in ("conv", "digest", "size")), strict=True):
                if c != conv:
                    conv, depth, key, position = c, 0, b"", 0
                key = hashlib.blake2b(key + digest, digest_size=16).digest()
                depths.append(depth)
                keys.append(key)
                positions.append(position)
                depth, position = depth + 1, position + size
            names = ["conv", "conv_id", "size", "loss_from", "loss_to", "tokens"]
            more = [pa.array(depths, pa.int64()), pa.array(keys, pa.binary()), pa.array(positions, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), *more], [*names, "depth", "key", "position"])

    return kept.mapInArrow(run, "conv string, conv_id long, size long, loss_from long, loss_to long, tokens binary, depth long, key binary, position long")


def pack(conversations: DataFrame, coder: Coder) -> Packed:
    """Pack conversations into one stream in which turns shared from the start on occur once."""
    turns = checkpointed(keyed_turns(conversations, coder))
    # Written, as are the tables below, so that joins may split the key of a turn that most conversations share.
    repeated = turns.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("shared"))
    thin = checkpointed(
        turns.select("conv", "conv_id", "key", "depth", "position", "size").join(repeated, "key", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    )
    # Keys chain, so shared turns come first; a conversation's first turn of its own tells it from all others.
    at = F.struct("depth", "key")
    paths = thin.groupBy("conv").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("shared"), at))), lambda x: x["key"]).alias("common"),
        F.min(F.when(~F.col("shared"), at))["key"].alias("own"),
    ).select("conv", F.concat("common", F.array_compact(F.array("own"))).alias("path"))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_convs = paths.repartitionByRange(parts, "path", "conv").sortWithinPartitions("path", "conv")
    ranks = checkpointed(sorted_convs.select("conv", F.monotonically_increasing_id().alias("rank")))
    named = thin.join(ranks, "conv")
    owners = checkpointed(named.where("shared").groupBy("key").agg(F.min("rank").alias("owner")))
    columns = ("rank", "conv", "conv_id", "owner", "depth", "position", "size")
    alone = named.where("not shared").withColumn("owner", F.col("rank")).select(*columns)
    owned = checkpointed(named.where("shared").join(owners, "key").select(*columns).union(alone))

    mine = F.col("owner") == F.col("rank")
    end = F.col("position") + F.col("size")
    lengths = owned.groupBy("rank", "conv_id").agg(
        F.sum(F.when(mine, F.col("size")).otherwise(0)).alias("length"),
        F.coalesce(F.min(F.when(mine, F.col("position"))), F.max(end)).alias("position"),
    ).withColumn("part", F.shiftright("rank", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.groupBy("part").agg(F.sum("length").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = lengths.withColumn("inside", F.coalesce(F.sum("length").over(within), F.lit(0)))
    segments = checkpointed(placed.join(F.broadcast(offsets), "part").select("rank", "conv_id", (F.col("offset") + F.col("inside")).alias("start"), "length", "position"))

    shifts = segments.select(F.col("rank").alias("owner"), (F.col("start") - F.col("position")).alias("shift"))
    runs = owned.groupBy("rank", "conv_id", "owner", F.floor(F.col("depth") / BLOCK).alias("block")).agg(
        F.min("position").alias("position"), F.max(end).alias("end"), F.min("depth").alias("first_depth"), F.max("depth").alias("last_depth")
    )
    intervals = runs.join(shifts, "owner").select(
        "rank", "conv_id", "owner", "position", (F.col("position") + F.col("shift")).alias("start"), (F.col("end") - F.col("position")).alias("length"), "first_depth", "last_depth"
    )
    own = owned.where(mine).join(shifts, "owner").select("conv", "depth", "rank", "conv_id", (F.col("position") + F.col("shift")).alias("start"), "position", "size")
    bodies = turns.select("conv", "depth", "loss_from", "loss_to", "tokens")
    return Packed(segments, own.join(bodies, ["conv", "depth"]).drop("conv"), intervals)


def read_turns(packed: Packed, coder: Coder) -> DataFrame:
    """Every conversation's turns, decoded from the stream where the conversation's intervals point.

    Columns: rank, conv_id, position, turns (array of role and text), loss (text under the mask), formatted_chars.
    """
    shared = packed.turns.sparkSession.sparkContext.broadcast(coder)
    wanted = packed.intervals.withColumn("depth", F.explode(F.sequence("first_depth", "last_depth"))).drop("first_depth", "last_depth")
    source = packed.turns.select(F.col("rank").alias("owner"), "depth", F.col("start").alias("at"), "loss_from", "loss_to", "tokens")
    inside = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("length"))
    found = wanted.join(source, ["owner", "depth"]).where(inside)
    rows = found.select("rank", "conv_id", (F.col("position") + F.col("at") - F.col("start")).alias("position"), "loss_from", "loss_to", "tokens")
    said = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batch):
        turns, loss, chars = [], [], []
        for a, b, tokens in zip(*(batch[n].to_pylist() for n in ("loss_from", "loss_to", "tokens")), strict=True):
            ids = np.frombuffer(tokens, "<i4").tolist()
            text = shared.value.text(ids)
            turns.append([{"role": unescape_role(m[1]), "text": unescape(m[2])} for m in TURN.finditer(text)])
            loss.append(unescape(shared.value.text(ids[a:b])))
            chars.append(len(text))
        more = [pa.array(turns, said), pa.array(loss, pa.string()), pa.array(chars, pa.int64())]
        return pa.RecordBatch.from_arrays([batch["rank"], batch["conv_id"], batch["position"], *more], ["rank", "conv_id", "position", "turns", "loss", "formatted_chars"])

    return over_batches(rows, run, "rank long, conv_id long, position long, turns array<struct<role:string,text:string>>, loss string, formatted_chars long")


def read_back(packed: Packed, coder: Coder) -> DataFrame:
    """Digests of every conversation's turns and loss text, from the packed stream and its intervals alone.

    Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    ordered = read_turns(packed, coder).repartition("rank").sortWithinPartitions("rank", "position")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        now = None
        for batch in batches:
            out = []
            for rank, conv_id, turns, loss, chars in zip(*(batch[n].to_pylist() for n in ("rank", "conv_id", "turns", "loss", "formatted_chars")), strict=True):
                if rank != now:
                    if now is not None:
                        out.append((conv, n, said.hexdigest(), n_loss, lost.hexdigest(), n_chars))
                    now, conv, n, n_loss, n_chars = rank, conv_id, 0, 0, 0
                    said, lost = hashlib.sha256(), hashlib.sha256()
                for t in turns:
                    said.update(f"{t['role']}\n{t['text']}\n".encode())
                lost.update(loss.encode())
                n, n_loss, n_chars = n + len(turns), n_loss + len(loss), n_chars + chars
            if out:
                yield as_batch(out)
        if now is not None:
            yield as_batch([(conv, n, said.hexdigest(), n_loss, lost.hexdigest(), n_chars)])

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
