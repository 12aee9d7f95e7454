"""Prefix trie of conversations, by Patricia construction over their sorted sequences of turns.

A conversation becomes one row: 16 bytes of hash and a word count for each turn. Equal ones become one sequence. The
sequences are range-partitioned by their bytes, so that a common first turn is spread like any other. Each task builds
the Patricia trie of its stretch from the common prefixes of neighbours: points where sequences branch or end, with
compressed edges between them; only along the border with a neighbouring task all nodes are points, and these are added
up over the tasks by their prefix. All sums are over members or over nodes that a task is the first to hold, so they add
up. In the end the nodes within an edge, which have one child and the members of its lower point, are written out with
the edge's suffix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.llm.common import materialise, n_parts, word_count

TURN = 16  # bytes of a turn's hash
RUN_IDS = 4_000  # ids written as one text before a group's ids are hashed
POINTS = (
    "part int, no long, parent_no long, key binary, depth long, first long, n_convs long, n_children long, n_leaves long, saved long, "
    "ends_sha256 string, edge_saved array<long>"
)
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NONE = hashlib.sha256(b"").hexdigest()


def turn_hash(role: Column, text: Column) -> Column:
    """32 hex digits of a turn; null role or text are empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN)


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, hash, words>>) by turn, null first; equal turns by hash. Rows without conv_id are in no conversation."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), turn_hash(F.col("role"), F.col("text")).alias("hash"), word_count(F.col("text")).alias("words"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(whole: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversations of sequences() that start as a template: the first h turns of conversation c - c % every, all if it has fewer and
    none if there is no such one, then their own after the first h; h is crc32(c as text) % heads."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    head = whole.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    joined = whole.withColumns({"h": h, "of": F.col("conv_id") - F.col("conv_id") % every}).join(head, F.col("of") == F.col("base"), "left")
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("h")))
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("head", 1, F.col("h")), none), own).alias("turns"))


def keyed(whole: DataFrame) -> DataFrame:
    """(conv_id, key, words): the hashes end to end, and the words of each turn."""
    return whole.select("conv_id", F.unhex(F.array_join("turns.hash", "")).alias("key"), F.col("turns.words").alias("words"))


def id_hashes(members: DataFrame) -> DataFrame:
    """(group, ends_sha256): hash of a group's ids, ascending, joined by commas. members: (group binary, conv_id).

    Ids are sorted over all tasks; each task writes its stretch of a group as texts of RUN_IDS ids, and only these meet in one task,
    which hashes them one after another and holds one.
    """
    parts = n_parts(members.sparkSession)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"group": pa.array([group], pa.binary()), "since": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

        group, ids = None, []
        for batch in batches:
            for g, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (g != group or len(ids) == RUN_IDS):
                    yield row()
                    ids = []
                group = g
                ids.append(i)
        if ids:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            groups, digests = [], []
            for g, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if g != group or state is None:
                    if state is not None:
                        groups.append(group)
                        digests.append(state.hexdigest())
                    group, state = g, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"group": pa.array(groups, pa.binary()), "ends_sha256": pa.array(digests, pa.string())})
        if state is not None:
            yield pa.RecordBatch.from_pydict({"group": pa.array([group], pa.binary()), "ends_sha256": [state.hexdigest()]})

    runs = members.select("group", "conv_id").repartitionByRange(parts, "group", "conv_id").sortWithinPartitions("group", "conv_id").mapInArrow(joined, "group binary, since long, ids string")
    return runs.repartition(parts, "group").sortWithinPartitions("group", "since").mapInArrow(hashed, "group binary, ends_sha256 string")


def shared(a: bytes | None, b: bytes | None) -> int:
    """Turns that two keys start with alike; -1 if there is no such key."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0] if len(differ) else n) // TURN


class Point:
    """A branch, an end, a leaf or a node of the border. below and distinct leave out the point's own turn."""

    __slots__ = ("no", "depth", "first", "n", "children", "leaves", "below", "distinct", "ends", "is_old", "is_open", "is_inner")

    def __init__(self, no: int, depth: int, is_old: bool = False):
        self.no, self.depth, self.is_old = no, depth, is_old
        self.first, self.n, self.children, self.leaves, self.below, self.distinct = None, 0, 0, 0, 0, 0
        self.ends, self.is_open, self.is_inner = None, False, False


class Patricia:
    """Builds the points of one stretch of sorted sequences. before, after: the neighbouring stretches' nearest keys, or None.

    is_old: an earlier stretch has the node; its turn and its place among its parent's children are counted there.
    """

    def __init__(self, part: int, before: bytes | None, after: bytes | None):
        self.part, self.before, self.after = part, before, after
        self.path: list[Point] = []
        self.key, self.sums, self.n_points = None, None, 0
        self.border = -1  # nodes of the current path down to this depth are points of the border
        self.out: list[tuple] = []

    def point(self, depth: int, is_old: bool = False) -> Point:
        self.n_points += 1
        return Point(self.n_points - 1, depth, is_old)

    def close(self, until: int) -> None:
        """Points deeper than until leave the path; the path then ends in a point of that depth."""
        while self.path[-1].depth > until:
            low = self.path.pop()
            if self.path[-1].depth < until:
                self.path.append(self.point(until))
            self.finish(low, self.path[-1])

    def finish(self, low: Point, top: Point | None) -> None:
        """Write a point, and add it to the one above."""
        above = top.depth if top else low.depth
        own = int(self.sums[low.depth] - self.sums[low.depth - 1]) if low.depth else 0
        if low.ends and not low.is_inner and not low.is_open:
            low.leaves += 1
        members, distinct = low.below + low.n * own, low.distinct + (0 if low.is_old else own)
        # nodes within the edge: from the point above down to this one, what a node and all below it save
        inner = self.sums[low.depth - 1] - self.sums[above : max(above, low.depth - 1)] if low.depth > above + 1 else np.empty(0, np.int64)
        edge = (members - distinct + (low.n - 1) * inner).tolist()
        on_border = low.depth <= self.border
        key = hashlib.sha256(self.key[: low.depth * TURN]).digest()[:TURN] if on_border else None
        self.out.append((self.part, low.no, top.no if top else None, key, low.depth, low.first, low.n, low.children, low.leaves, members - distinct, low.ends, edge))
        if top:
            rest = int(self.sums[low.depth - 1] - self.sums[above]) if low.depth > above + 1 else 0
            top.below += members + low.n * rest
            top.distinct += distinct + rest
            top.n += low.n
            top.first = low.first if top.first is None else min(top.first, low.first)
            top.leaves += low.leaves
            top.children += not low.is_old
            top.is_inner = True

    def add(self, key: bytes, words: list[int], n: int, first: int, ends: str) -> None:
        """The next sequence: n conversations, the smallest of which is first."""
        depth = len(key) // TURN
        if self.key is None:
            old = shared(self.before, key)
            self.border = max(old, 0)
            self.sums = np.append(0, np.cumsum(np.array(words, dtype=np.int64)))
            self.path = [self.point(d, d <= old) for d in range(self.border + 1)]
        else:
            alike = shared(self.key, key)
            self.close(alike)
            self.border = min(self.border, alike)
        self.key, self.sums = key, np.append(0, np.cumsum(np.array(words, dtype=np.int64)))
        if self.path[-1].depth < depth:
            self.path.append(self.point(depth))
        end = self.path[-1]
        end.ends, end.n = ends, end.n + n
        end.first = first if end.first is None else min(end.first, first)

    def end(self) -> None:
        """Close the path. What the next stretch shares of it is border: all its nodes are points."""
        if self.key is None:
            return
        right = shared(self.key, self.after)
        if right >= 0:
            if right == len(self.key) // TURN:
                self.path[-1].is_open = True  # the next stretch goes on from here
            self.close(right)
            have = {p.depth: p for p in self.path}
            self.path = [have.get(d) or self.point(d) for d in range(right + 1)]
            self.border = max(self.border, right)
        while self.path:
            low = self.path.pop()
            self.finish(low, self.path[-1] if self.path else None)

    def rows(self) -> pa.RecordBatch:
        columns, self.out = list(zip(*self.out)) or [[]] * len(POINTS.split(", ")), []
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
        fields = [f.split() for f in POINTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def points(distinct: DataFrame) -> DataFrame:
    """Points of all stretches. distinct: (part, key, words, n, first, ends_sha256), in which part is a range of keys."""
    ends = distinct.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = Window.orderBy("part")  # one row for each stretch, of which there are as many as partitions
    borders = ends.select(F.col("part").alias("of"), F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    rows = distinct.join(borders, F.col("part") == F.col("of")).select("part", "key", "words", "n", "first", "ends_sha256", "before", "after")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = None
        for batch in batches:
            for part, key, words, n, first, ends, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                if trie is None or trie.part != part:
                    if trie is not None:
                        trie.end()
                        yield trie.rows()
                    trie = Patricia(part, before, after)
                trie.add(key, words, n, first, ends)
                if len(trie.out) >= 10_000:
                    yield trie.rows()
        if trie is not None:
            trie.end()
            yield trie.rows()

    return rows.repartition(n_parts(distinct.sparkSession), "part").sortWithinPartitions("part", "key").mapInArrow(run, POINTS)


def nodes(whole: DataFrame) -> DataFrame:
    """Every node of the trie of conversations (conv_id, turns), as sequences() gives them: its smallest member, depth, parent's
    smallest member, members, children, leaves below, tokens that storing shared turns once saves below it, and the hash of the ids that end in it.

    Conversations without turns end in the root. Equal conversations are one sequence. Without conversations there are no
    nodes. Turns count as equal if 128 bits of their SHA-256 are.
    """
    spark = whole.sparkSession
    rows = materialise(keyed(whole).withColumn("group", F.substring(F.unhex(F.sha2("key", 256)), 1, TURN)), "conversations")
    groups = rows.groupBy("group").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    one = rows.join(groups.select(F.col("first").alias("conv_id")), "conv_id", "left_semi").select("group", "key", "words")
    distinct = one.join(groups, "group").join(id_hashes(rows), "group").select("key", "words", "n", "first", "ends_sha256")
    ranged = materialise(distinct.repartitionByRange(n_parts(spark), "key").withColumn("part", F.spark_partition_id()), "sequences")
    found = materialise(points(ranged), "points")
    inner = found.filter("key is null").drop("key")
    border = found.filter("key is not null").select("part", "no", "parent_no", "key", "depth", "first", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = border.groupBy("key").agg(F.first("depth").alias("depth"), F.min("first").alias("first"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.min(F.struct("part", "parent_no")).alias("up"))
    lower = inner.select("part", F.col("no").alias("of"), F.col("first").alias("parent"))
    names = lower.unionByName(border.join(merged.select("key", F.col("first").alias("parent")), "key").select("part", F.col("no").alias("of"), "parent"))
    low = inner.select("part", "parent_no", "depth", "first", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256", "edge_saved")
    high = merged.select("up.part", "up.parent_no", "depth", "first", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256", F.array().cast("array<long>").alias("edge_saved"))
    known = low.unionByName(high).alias("p").join(names.withColumnRenamed("part", "in_part"), (F.col("part") == F.col("in_part")) & (F.col("parent_no") == F.col("of")), "left")
    length = F.size("edge_saved")
    own = F.struct(
        F.lit(0).alias("back"), F.col("n_children").alias("n_children"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256")
    )
    unary = F.transform("edge_saved", lambda s, i: F.struct((length - i).alias("back"), F.lit(1).cast("long").alias("n_children"), s.alias("saved_tokens"), F.lit(NONE).alias("ends_sha256")))
    all_of = known.select("*", F.explode(F.array_append(unary, own)).alias("node"))
    return all_of.select(
        F.col("first").alias("conv_id"),
        (F.col("depth") - F.col("node.back")).cast("long").alias("depth"),
        F.when(F.col("node.back") == length, F.col("parent")).otherwise(F.col("first")).alias("parent_conv_id"),
        "n_convs",
        "node.n_children",
        "n_leaves",
        "node.saved_tokens",
        "node.ends_sha256",
    )
