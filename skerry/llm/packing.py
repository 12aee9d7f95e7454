"""Best-fit packing under conflicts.

Documents, or the pieces of those that are longer than a bin, go to bins of one capacity, largest first.
Bins are kept by what is left in them; the search starts at the first that could hold the piece and goes
on to its successors until it meets one whose bitmaps allow the piece's source and duplicate cluster: the
tightest compatible bin. A source may stand `per_source` times in a bin (one bitmap for each time), a
cluster once; pieces of one document don't conflict with each other by cluster.

Rows are dealt to groups of about `group_rows` by a hash of their id, and bins belong to one group, so that no
task grows with the input and only lengths travel, no texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm import ngramjoin
from skerry.llm.common import SPACE, materialise, word_count

CAPACITY, PER_SOURCE, GROUP_ROWS = 2048, 8, 20_000
PACKED = "doc_id long, piece int, n_units long, bin_id string, bin_offset long, bin_used long"


class Bins:
    """Open bins by residual. Full bins, and bins that nothing fits any more, are no longer searched."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[list[int]] = []  # per_source bitmaps of each bin
        self.clusters: list[int] = []
        self.holds: list[list[int]] = []

    def put(self, item: int, size: int, source: int, cluster: int) -> int:
        """source: its bit; cluster: its bit, or 0. Returns the bin."""
        at = bisect_left(self.order, (size, -1))
        for i in range(at, len(self.order)):
            residual, b = self.order[i]
            if not self.sources[b][-1] & source and not self.clusters[b] & cluster:
                del self.order[i]
                break
        else:
            residual, b = self.capacity, len(self.holds)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
            self.holds.append([])
        layers = self.sources[b]
        for k, bits in enumerate(layers):
            if not bits & source:
                layers[k] = bits | source
                break
        self.clusters[b] |= cluster
        self.holds[b].append(item)
        if residual > size:
            insort(self.order, (residual - size, b))
        return b


def pack_rows(rows: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int, int, int, int, int]]:
    """(row, piece, size, bin, offset, used) of rows (id, source, cluster, length)."""
    pieces = []
    for i, (_, _, _, length) in enumerate(rows):
        whole, rest = divmod(length, capacity)
        pieces += [(capacity, i, k) for k in range(whole)]
        if rest or not whole:
            pieces.append((rest, i, whole))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    bins, shared, seen, sources, clusters = Bins(capacity, per_source), set(), set(), {}, {}
    for _, _, cluster, _ in rows:
        (shared if cluster in seen else seen).add(cluster)
    for n, (size, i, _) in enumerate(pieces):
        _, source, cluster, length = rows[i]
        s = 1 << sources.setdefault(source, len(sources))
        # a cluster with one row here can't conflict; full pieces fill a bin alone
        c = 1 << clusters.setdefault(cluster, len(clusters)) if cluster in shared and size < capacity else 0
        bins.put(n, size, s, c)
    out = []
    for b, held in enumerate(bins.holds):
        used = sum(pieces[n][0] for n in held)
        at = 0
        for n in held:
            size, i, k = pieces[n]
            out.append((i, k, size, b, at, used))
            at += size
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", cluster_col: str = "cluster", length_col: str = "n_units", capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every piece of every row as (doc_id, piece, n_units, bin_id, bin_offset, bin_used).

    Rows longer than a bin are cut into pieces; empty ones have one piece of size 0, which a full bin doesn't take. A null length counts as 0, a null
    source is a source of its own, a null cluster never conflicts. Repeated rows are packed like others; ties go by id,
    source and cluster. An empty table gives an empty one. Results don't depend on the number of partitions.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("source"),
        F.coalesce(F.col(cluster_col).cast("string"), F.concat(F.lit("\0"), F.col(id_col).cast("string")), F.lit("\0")).alias("cluster"),
        F.greatest(F.lit(0), F.coalesce(F.col(length_col), F.lit(0))).cast("long").alias("n"),
    )
    groups = max(1, -(-docs.count() // group_rows))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "source", "cluster"), F.lit(groups)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            found = pack_rows(rows, capacity, per_source)
            for a in range(0, len(found), 50_000):
                i, piece, size, b, offset, used = zip(*found[a : a + 50_000])
                columns = [pa.array([rows[k][0] for k in i], type=pa.int64()), pa.array(piece, type=pa.int32()), pa.array(size, type=pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([f"{group}-{k}" for k in b]), pa.array(offset, type=pa.int64()), pa.array(used, type=pa.int64())], names=[c.split()[0] for c in PACKED.split(", ")])

        group, rows = None, []
        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group and rows:
                    yield from out(group, rows)
                    rows = []
                group = g
                rows.append(tuple(row))
        if rows:
            yield from out(group, rows)

    order = ["grp", F.col("n").desc(), "doc_id", "source", "cluster"]
    return rows.repartition("grp").sortWithinPartitions(*order).select("grp", "doc_id", "source", "cluster", "n").mapInArrow(run, PACKED)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_units, the words of the whole text, and cluster, a hash of the text without case and spacing.

    A null or blank text has no words and a null cluster. docs may not have columns of these two names.
    """
    if taken := {"n_units", "cluster"} & set(docs.columns):
        raise ValueError(f"docs has {sorted(taken)} already")
    return docs.withColumn("n_units", word_count(F.col(text_col))).withColumn("cluster", F.when(F.col("n_units") > 0, text_key(F.col(text_col))))


def text_key(text: Column) -> Column:
    """Hash of a text without case and spacing."""
    return F.xxhash64(F.regexp_replace(F.btrim(F.lower(text), F.lit(SPACE)), r"[\x20\x09-\x0D]+", " "))


def clustered(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, n_units, cluster) of each row of docs; cluster is that of all near copies, by n-grams, null without words.

    Words, sources and clusters all come from the pass over the texts that the n-gram join makes; rows without an id, and
    rows that repeat one, have the cluster of their own text. Other columns are not read.
    """
    near = ngramjoin.grouped(docs, n, percent, id_col, text_col, carry=F.col(source_col))
    return materialise(near.select("doc_id", F.col("carried").alias("source"), F.col("n_words").alias("n_units"), F.col("near").alias("cluster")), "clusters")
