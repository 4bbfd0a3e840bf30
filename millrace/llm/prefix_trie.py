"""The trie of conversation prefixes, by ROLLUP over positional columns of turn ids.

A turn's id is a hash of its role and text and the length of the text. A conversation is
laid out in blocks of ``WIDTH`` turns, one row each, with an id column for every position.
``ROLLUP`` over the columns of a block gives all its prefixes in one aggregation, and
``grouping_id`` says how long each is. A block further on is grouped by the node at which
the block before it ended: nodes are named by the exclusive or of hashes of (position,
turn), so that name follows from sums over blocks and no round trip is needed.

What a node has to know of its subtree comes down to sums over its members. Every node is
owned by its smallest member. If a conversation owns a node it owns all nodes behind it,
so "owned from this depth on" says it all: the children of a node are its members that
own theirs at the next depth, its leaves the members that own a childless end, and what
is saved below it are the turns that its members have but don't own. A first ROLLUP
finds the owners, a second one adds these up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._scratch import written

WIDTH = 8
# Blocks that are summed up in one group before those sums are.
SUPER = 1024
CHUNK_BYTES = 1 << 20


def numbered(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv_id``, ``position`` (from 0) and the turn's id, ``one`` and ``two``, for each turn.

    Turns are ordered by ``turn``, null first, ties by their ids; equal ones stay both.
    A null role or text is empty. Rows without a ``conv_id`` are left out. ``two`` has the
    UTF-8 length of the text in its upper half, so ids have 96 bits of hash beside it.

    Positions come from ranges of (conversation, turn), so one conversation may fill many
    tasks; for each conversation and range one row tells how many turns came before.
    """
    said = [F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))]
    low = F.xxhash64(F.lit(1), *said).bitwiseAND(F.lit(0xFFFFFFFF))
    length = F.shiftleft(F.octet_length(said[1]).cast("long"), 32)
    own = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.xxhash64(*said).alias("one"),
        length.bitwiseOR(low).alias("two"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "one", "two"]
    ordered = own.repartitionByRange(*order).sortWithinPartitions(*order)
    # Ranges in order, and rows within each: an id that grows from one row to the next.
    place = F.monotonically_increasing_id()
    ordered = ordered.select("conv_id", "one", "two", place.alias("place"))
    ordered = written(ordered.withColumn("range", F.shiftright("place", 33)), "ordered-turns")
    parts = ordered.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")
    parts = parts.select("conv_id", "range", shift.alias("shift"))
    placed = ordered.join(parts, ["conv_id", "range"])
    return placed.select("conv_id", (F.col("place") + F.col("shift")).alias("position"), "one", "two")


def _slots(name: str) -> list[str]:
    return [f"{name}{k}" for k in range(WIDTH)]


def _xor(values: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), values)


def _marks(salt: int) -> list[Column]:
    """For each slot, the hash of its position and turn; 0 where it is empty."""
    first = F.col("block") * WIDTH
    return [
        F.when(F.col(f"one{k}").isNotNull(), F.xxhash64(F.lit(salt), first + k, f"one{k}", f"two{k}")).otherwise(0)
        for k in range(WIDTH)
    ]


def _size(k: int) -> Column:
    """Bytes of the turn in a slot."""
    return F.coalesce(F.shiftright(f"two{k}", 32), F.lit(0).cast("long"))


def _blocks(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conversation and block: its turns, the name ``up1``, ``up2`` of the node and
    the ``bytes`` of the turns before it, and the conversation's ``length``, ``all_bytes`` and end."""
    block = F.floor(F.col("position") / WIDTH).cast("long")
    rows = turns.select("conv_id", block.alias("block"), F.pmod("position", F.lit(WIDTH)).alias("slot"), "one", "two")
    # Without turns a conversation has one empty block. Blocks, not conversations, are dealt.
    empty = conversations.select("conv_id", *(F.lit(x).cast("long") for x in (0, None, None, None)))
    rows = rows.union(empty.toDF(*rows.columns))
    rows = rows.repartition("conv_id", "block")
    slots = [
        F.max(F.when(F.col("slot") == k, F.col(c))).alias(f"{c}{k}") for k in range(WIDTH) for c in ("one", "two")
    ]
    blocks = rows.groupBy("conv_id", "block").agg(F.count("slot").alias("n"), *slots)
    blocks = blocks.withColumns(
        {
            "x1": _xor(_marks(1)),
            "x2": _xor(_marks(2)),
            "size": reduce(lambda a, b: a + b, (_size(k) for k in range(WIDTH))),
            "super": F.floor(F.col("block") / SUPER),
        }
    )
    blocks = written(blocks, "turn-blocks")

    def sums(rows: DataFrame, keys: list[str], order: str, prefix: str) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns(
            {
                f"{prefix}1": F.coalesce(F.bit_xor("x1").over(before), F.lit(0)),
                f"{prefix}2": F.coalesce(F.bit_xor("x2").over(before), F.lit(0)),
                f"{prefix}_bytes": F.coalesce(F.sum("size").over(before), F.lit(0)),
            }
        )

    supers = blocks.groupBy("conv_id", "super").agg(
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("size").alias("size"), F.sum("n").alias("n")
    )
    whole = Window.partitionBy("conv_id")
    supers = sums(supers, ["conv_id"], "super", "super").select(
        "conv_id",
        "super",
        "super1",
        "super2",
        "super_bytes",
        F.sum("n").over(whole).alias("length"),
        F.sum("size").over(whole).alias("all_bytes"),
        F.bit_xor("x1").over(whole).alias("end1"),
        F.bit_xor("x2").over(whole).alias("end2"),
    )
    placed = sums(blocks, ["conv_id", "super"], "block", "own").join(supers, ["conv_id", "super"])
    return placed.select(
        "conv_id",
        "block",
        *(f"{c}{k}" for k in range(WIDTH) for c in ("one", "two")),
        F.col("own1").bitwiseXOR(F.col("super1")).alias("up1"),
        F.col("own2").bitwiseXOR(F.col("super2")).alias("up2"),
        (F.col("own_bytes") + F.col("super_bytes")).alias("bytes"),
        "length",
        "all_bytes",
        "end1",
        "end2",
    )


def _rolled(blocks: DataFrame, sums: str) -> DataFrame:
    """``block``, ``up1``, ``up2``, the slots and ``depth`` of every node, and ``sums`` over its members,
    in which ``LEVEL`` stands for the number of the block's turns that lead to the node."""
    columns = ", ".join(f"(one{k}, two{k})" for k in range(WIDTH))
    slots = ", ".join(f"one{k}, two{k}" for k in range(WIDTH))
    level = f"CAST({WIDTH} - bit_count(grouping_id()) DIV 2 AS INT)"
    rolled = blocks.sparkSession.sql(
        f"SELECT block, up1, up2, {slots}, {level} AS level, {sums.replace('LEVEL', level)} "
        f"FROM {{blocks}} GROUP BY block, up1, up2, ROLLUP({columns})",
        blocks=blocks,
    )
    # A group whose last turn is null ends earlier, and a block's start is its predecessor's end.
    last = F.element_at(F.array(*_slots("one")), F.greatest("level", F.lit(1)))
    here = F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last.isNotNull())
    return rolled.where(here).withColumn("depth", F.col("block") * WIDTH + F.col("level"))


def _own_bytes() -> Column:
    """Bytes of a node's last turn; 0 for the root."""
    last = F.element_at(F.array(*(_size(k) for k in range(WIDTH))), F.greatest("level", F.lit(1)))
    return F.when(F.col("level") > 0, last).otherwise(F.lit(0).cast("long"))


def _ends(blocks: DataFrame) -> DataFrame:
    """``end1``, ``end2`` and ``ends_sha256`` of each node at which conversations end.

    Ids are sorted by ranges and put together in chunks there; a node with all its ids
    within one range is hashed at once. Of the others the chunks are hashed in order: a hash
    of that kind cannot be taken in parts, so this much is one pass over a node's ids.
    """
    keys = ["end1", "end2"]
    order = [*keys, "conv_id"]
    rows = blocks.where("block = 0").select(*order)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = [*keys, "first", "chunk", "ends_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, opened, out = None, [], True, []

        def packed(done: bool) -> None:
            """What is held of the present node: a hash if that is all of it, a chunk if not."""
            text = ",".join(map(str, ids)).encode()
            if done and not opened:
                out.append((*key, None, None, sha256(text).hexdigest()))
            elif ids:
                out.append((*key, ids[0], text, None))
            ids.clear()

        def table() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (batch.column(k).to_numpy() for k in keys)
            at = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
            for a, b in zip(at, np.append(at[1:], len(one)), strict=True):
                now = (int(one[a]), int(two[a]))
                if now != key:
                    if key is not None:
                        packed(True)
                        opened = False
                    key = now
                ids += batch.column("conv_id").slice(a, b - a).to_pylist()
                if len(ids) > CHUNK_BYTES // 16:
                    opened = True
                    packed(False)
            yield table()
        if key is not None:
            opened = True
            packed(True)
            yield table()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows_ = []
            for row in zip(*(batch.column(k).to_pylist() for k in (*keys, "chunk")), strict=True):
                if row[:2] != key:
                    if key is not None:
                        rows_.append((*key, state.hexdigest()))
                    key, state = row[:2], sha256(row[2])
                else:
                    state.update(b"," + row[2])
            yield _digests(rows_)
        if key is not None:
            yield _digests([(*key, state.hexdigest())])

    def _digests(rows_: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows_, strict=True)) or [[], [], []]
        made = [pa.array(c, t) for c, t in zip(columns, (types[0], types[1], types[4]), strict=True)]
        return pa.RecordBatch.from_arrays(made, [*keys, "ends_sha256"])

    made = "end1 long, end2 long, first long, chunk binary, ends_sha256 string"
    found = written(rows.mapInArrow(chunks, made), "trie-ends")
    open_ = found.where("chunk IS NOT NULL").repartition(*keys).sortWithinPartitions(*keys, "first")
    open_ = open_.select(*keys, "chunk").mapInArrow(hashed, "end1 long, end2 long, ends_sha256 string")
    return found.where("chunk IS NULL").select(*keys, "ends_sha256").union(open_)


def prefixes(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Every distinct prefix of conversations, a row each: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns`` is what ``numbered`` gives (or any rows of ``conv_id``, ``position`` and a
    turn's id, positions from 0 without gaps); ``conversations`` has further ``conv_id``,
    which have no turns. Ids of conversations are bigint. A conversation is a member of the
    node of each of its prefixes, the empty one (the root) included. ``saved_tokens`` sums,
    over a node's subtree and itself, the bytes of the last turn times the members but one.
    ``ends_sha256`` is the hash of the ids that end at the node, ascending and
    comma-joined. No conversations give no node.
    """
    members = turns.select("conv_id")
    if conversations is not None:
        members = members.union(conversations.select("conv_id").where("conv_id IS NOT NULL"))
    blocks = written(_blocks(turns, members.distinct()), "trie-blocks")

    found = _rolled(blocks, "min(conv_id) AS owner, max(length) AS longest, min(bytes) AS before")
    level = F.col("level")
    within = reduce(lambda a, b: a + b, (_size(k) for k in range(WIDTH)))
    # The bytes before a node's last turn.
    found = found.withColumn("before", F.col("before") + within - F.when(level > 0, _own_bytes()).otherwise(0))
    owners = found.groupBy(F.col("owner").alias("conv_id")).agg(
        F.min("depth").alias("owned"),
        F.min_by("before", "depth").alias("shared_bytes"),
        F.max((F.col("longest") == F.col("depth")).cast("int")).alias("leaf"),
    )
    known = blocks.join(owners, "conv_id", "left")
    known = known.withColumns(
        {
            # A conversation like a smaller one owns nothing.
            "owned": F.coalesce("owned", F.col("length") + 1),
            "shared_bytes": F.coalesce("shared_bytes", "all_bytes"),
            "leaf": F.coalesce("leaf", F.lit(0)),
        }
    )
    # For each level of the block, bytes before its last turn, of the turns up to it.
    upto = [F.col("bytes")]
    for k in range(WIDTH):
        upto.append(upto[-1] + _size(k))
    unowned = [F.greatest(F.col("shared_bytes") - b, F.lit(0).cast("long")) for b in (upto[0], *upto[:-1])]
    depth = [F.col("block") * WIDTH + k for k in range(WIDTH + 1)]
    child = [((F.col("owned") <= d + 1) & (d + 1 <= F.col("length"))).cast("long") for d in depth]
    known = known.withColumns({"unowned": F.array(*unowned), "child": F.array(*child)})
    nodes = _rolled(
        known,
        "min(conv_id) AS conv_id, count(1) AS n_convs, sum(leaf) AS n_leaves, "
        "sum(element_at(child, LEVEL + 1)) AS n_children, sum(element_at(unowned, LEVEL + 1)) AS saved_tokens",
    )
    names = [_xor([F.col(f"up{k}"), *_marks(k)]) for k in (1, 2)]
    nodes = nodes.withColumns({"name1": names[0], "name2": names[1]})
    parents = [
        F.col(f"name{k}").bitwiseXOR(F.element_at(F.array(*_marks(k)), F.greatest("level", F.lit(1))))
        for k in (1, 2)
    ]
    nodes = nodes.select(
        "conv_id",
        "depth",
        "name1",
        "name2",
        *(F.when(level > 0, p).alias(f"up{k}") for k, p in enumerate(parents, 1)),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
    )
    nodes = written(nodes, "trie-nodes")
    above = nodes.where("n_children > 0").select(
        F.col("name1").alias("up1"), F.col("name2").alias("up2"), F.col("conv_id").alias("parent_conv_id")
    )
    ends = _ends(blocks).toDF("name1", "name2", "ends_sha256")
    nodes = nodes.join(above, ["up1", "up2"], "left").join(ends, ["name1", "name2"], "left")
    return nodes.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
