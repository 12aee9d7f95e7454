"""Exact dedup by Patricia-trie owners.

Texts are dealt by their length and content hash, so that equal texts meet in one partition. A partition
inserts the full byte strings into a compressed radix trie; a terminal node holds the identifier that
owns the text and how many rows have it. Equal texts of one block meet before they travel, so a text that
a third of all rows carry reaches its trie as one row per block.

When the trie of a partition outgrows its budget, its largest subtree is spilled: the texts below it, and
all that reach it later, go to another round with more partitions. Rounds pass through tables in the
shared folder. A trie keeps at least one terminal, so each round ends with fewer texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import materialise, n_parts

TRIE_BYTES = 128_000_000
NODE_BYTES = 300
PARTIAL = "text binary, best long, n long"
OWNERS = "sha256 string, keep_id long, group_size long, text binary"


class Node:
    __slots__ = ("label", "kids", "best", "n")

    def __init__(self, label: bytes):
        self.label, self.kids, self.best, self.n = label, {}, None, 0


class Trie:
    """A radix trie over byte strings. owner: max or min, of the identifiers of equal strings."""

    def __init__(self, owner=max, budget: int = TRIE_BYTES):
        self.root, self.owner, self.budget, self.used, self.terminals = Node(b""), owner, budget, 0, 0
        self.spilled: list[bytes] = []

    def insert(self, key: bytes, best: int | None, n: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.used += len(kid.label) + NODE_BYTES
            elif not key.startswith(kid.label, at):
                same = self.common(kid.label, key, at)
                middle = Node(kid.label[:same])
                kid.label = kid.label[same:]
                middle.kids[kid.label[0]] = kid
                kid = node.kids[key[at]] = middle
                self.used += NODE_BYTES
            node, at = kid, at + len(kid.label)
        self.terminals += not node.n
        node.n += n
        if best is not None:
            node.best = best if node.best is None else self.owner(best, node.best)

    @staticmethod
    def common(label: bytes, key: bytes, at: int) -> int:
        """Length of the common start of label and key[at:]."""
        low, high = 0, min(len(label), len(key) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if key.startswith(label[low:mid], at + low):
                low = mid
            else:
                high = mid - 1
        return low

    def walk(self, node: Node | None = None, path: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        """(string, owner, rows) of each terminal at or below a node whose string is path."""
        todo = [(node or self.root, path)]
        while todo:
            node, path = todo.pop()
            if node.n:
                yield path, node.best, node.n
            todo.extend((kid, path + kid.label) for kid in node.kids.values())

    def spill(self) -> list[tuple[bytes, int | None, int]]:
        """Take out the largest subtree below the first fork; nothing if there is but one terminal."""
        if self.terminals < 2:
            return []
        node, path = self.root, b""
        while len(node.kids) == 1 and not node.n:
            (node,) = node.kids.values()
            path += node.label
        below = {first: sum(len(s) for s, _, _ in self.walk(kid)) for first, kid in node.kids.items()}
        kid = node.kids.pop(max(below, key=below.get))
        rows = list(self.walk(kid, path + kid.label))
        self.spilled.append(path + kid.label[:1])
        self.terminals -= len(rows)
        self.used = sum(len(s) + 2 * NODE_BYTES for s, _, _ in self.walk())
        return rows

    def add(self, key: bytes, best: int | None, n: int) -> list[tuple[bytes, int | None, int]]:
        """Insert a string; the rows that have to go to the next round."""
        if self.spilled and key.startswith(tuple(self.spilled)):
            return [(key, best, n)]
        self.insert(key, best, n)
        return self.spill() if self.used > self.budget else []


def partials(docs: DataFrame, id_col: str, text: str, owner=max) -> DataFrame:
    """Equal texts of a block of rows as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list] = {}
            for i, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = found.setdefault(key, [i, 0])
                x[1] += 1
                if i is not None:
                    x[0] = i if x[0] is None else owner(i, x[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, type=pa.binary()), pa.array((x[0] for x in found.values()), type=pa.int64()), pa.array((x[1] for x in found.values()), type=pa.int64())], names=["text", "best", "n"]
            )

    return docs.select(F.col(id_col).cast("long").alias("best"), F.expr(text).cast("binary").alias("text")).mapInArrow(run, PARTIAL)


def tries(rows: DataFrame, parts: int, salt: int, owner=max, budget: int = TRIE_BYTES) -> DataFrame:
    """Owners of the texts that fit, and rows with a text and no sha256 for the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(owner, budget)

        def out(rows: list, done: bool) -> pa.RecordBatch:
            keys, best, n = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(k).hexdigest() if done else None for k in keys], type=pa.string()),
                    pa.array(best, type=pa.int64()),
                    pa.array(n, type=pa.int64()),
                    pa.array([None if done else k for k in keys], type=pa.binary()),
                ],
                names=["sha256", "keep_id", "group_size", "text"],
            )

        for batch in batches:
            for key, best, n in zip(*(c.to_pylist() for c in batch.columns)):
                if later := trie.add(key, best, n):
                    yield out(later, False)
        rows = []
        for row in trie.walk():
            rows.append(row)
            if len(rows) == 10_000:
                yield out(rows, True)
                rows = []
        if rows:
            yield out(rows, True)

    return rows.repartition(parts, F.octet_length("text"), F.xxhash64("text", F.lit(salt))).mapInArrow(run, OWNERS)


def owners(docs: DataFrame, id_col: str = "doc_id", text: str = "coalesce(text, '')", owner=max, budget: int = TRIE_BYTES, max_rounds: int = 40) -> DataFrame:
    """(sha256, keep_id, group_size) of each distinct text; text is an SQL expression. owner picks the id that stays."""
    spark = docs.sparkSession
    rows, done, parts = partials(docs, id_col, text, owner), None, n_parts(spark)
    for salt in range(max_rounds):
        dealt = materialise(tries(rows, parts << min(salt, 6), salt, owner, budget), "owners")
        found = dealt.filter("sha256 is not null").drop("text")
        done = found if done is None else done.unionByName(found)
        rows = dealt.filter("sha256 is null").selectExpr("text", "keep_id best", "group_size n")
        if rows.isEmpty():
            return done
    raise RuntimeError(f"texts left after {max_rounds} rounds; raise the budget of a trie")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "coalesce(text, '')", owner=max, budget: int = TRIE_BYTES) -> DataFrame:
    """Every row of docs as (doc_id, keep_id, group_size, kept, text_sha256).

    Null texts count as empty. Of equal texts the row of the largest id stays (owner=min: the smallest). Rows that
    repeat both id and text of the one that stays are kept alike. Null ids own a text only if it has no other.
    Other columns are not read; an empty table gives an empty one.
    """
    own = owners(docs, id_col, text, owner, budget)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.expr(text).cast("binary"), 256).alias("sha256"))
    return ids.join(own, "sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256"))
