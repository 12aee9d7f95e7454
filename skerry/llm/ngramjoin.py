"""N-gram Jaccard self-join by vertical partitioning.

The global order of n-grams is cut into fragments, and overlaps are counted in each fragment by itself and
summed. This happens twice:

1. Over all documents, but only over the first n-grams of each set in the global order. Two sets that link have
   so many n-grams in common that the first of these stand near the start of both (`prefix_length`, `least_shared`).
   A fragment counts, for each set, how many of its first n-grams are among the first of another set; the sums
   over fragments leave only sets that some partner may reach.
2. Over what is left. Sets are ordered from rare to frequent n-grams, a prefix filter with the length filter
   puts those that may link into one candidate group, groups are cut into blocks of TILE sets, and blocks that
   have a prefix n-gram in common meet in a tile. A tile counts the partial overlaps of its pairs in each fragment (as one matrix of counts), and the sums
   decide. Pairs never are rows: a tile returns links as a forest and a degree for each set.

Sets are hashed to 64 bits per n-gram, and to 128 bits as a whole; documents of one set form a class.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.llm.bpe import blocks
from skerry.llm.common import materialise, n_parts
from skerry.llm.components import components

BLOCK_CHARS = 4_000_000
TEXT_BYTES, LONG_WORD = 500_000, 64
TILE, TILE_FRAGMENTS, HOT_RUN, PART = 512, 4, 32, 8192
PREFIX_FRAGMENTS, FRAGMENT_KEYS = 16, 4_000_000  # least number, and keys in each, of the second stage
COMMON_PERCENT = 5  # of a set: n-grams that prefixes of the first stage must have in common
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]

#: A-Z in lower case, and every separator a space.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * ODD[1]
    h = (h ^ (h >> np.uint64(27))) * ODD[2]
    return h ^ (h >> np.uint64(31))


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of data starts, and its 64-bit hash. data: one that PLAIN made, with a space before and 16 behind."""
    solid = np.frombuffer(data, dtype=np.uint8) != 32
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    starts, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))  # the eight bytes from each place on
    h = mixed(size.astype(np.uint64) * ODD[0] + (eight[starts] & FIRST_BYTES[np.minimum(size, 8)]))
    more, k = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        h[more] = mixed(h[more] * ODD[0] + (eight[starts[more] + k] & FIRST_BYTES[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + size[i]])
    return starts, h


def shingled(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 texts: sorted distinct 64-bit hashes of the n-word shingles, text after text, how many each has, and its words.

    A-Z is lower-cased; fewer words than n are one shingle.
    """
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts, w = hashed_words(b" ".join([b"", *texts, b" " * 16]).translate(PLAIN))
    last = np.searchsorted(starts, np.cumsum(lengths + 1))  # words up to the end of each text
    words = np.diff(last, prepend=0)
    first = last - words
    h = np.full(max(0, len(w) - n + 1), n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(32))) * ODD[0] + w[k : len(h) + k]
    h = mixed(h)
    made = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    ends = np.cumsum(made)
    begins = ends - made
    out = np.empty(int(made.sum()), dtype=np.uint64)
    for a, b, x, m in zip(begins.tolist(), ends.tolist(), first.tolist(), words.tolist()):
        if m >= n:
            out[a:b] = h[x : x + b - a]
            out[a:b].sort()
        elif m:
            out[a] = np.uint64(xxhash.xxh3_64_intdigest(w[x : x + m].tobytes(), seed=m))
    fresh = np.append(True, out[1:] != out[:-1]) if len(out) else np.empty(0, dtype=bool)
    fresh[begins[made > 0]] = True
    upto = np.append(0, np.cumsum(fresh))
    return out[fresh], upto[ends] - upto[begins], words


def sets_in(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """shingled() of an array of texts, a few at a time, and the digest of each text's set."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    keys, counts, words = (np.concatenate(x) for x in zip(*(shingled(texts.slice(a, b - a).to_pylist(), n) for a, b in blocks(sizes, TEXT_BYTES))))
    data, ends = memoryview(keys), np.cumsum(counts)
    return keys, counts, words, [digest_of(data[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]


def digest_of(packed: memoryview) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of n can have with a partner."""
    return -(-n * percent // 100)


def common(n):
    """How many n-grams two sets must have in common among their first ones, for the smaller size n of the two."""
    return np.maximum(1, n * COMMON_PERCENT // 100)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """The first n-grams of a set of n that hold common(n) of those that it shares with any set it links to.

    At most n - least_overlap(n) of its n-grams are not in the partner, so the first n - least_overlap(n) + k hold k
    that are. The partner's own prefix holds at least the same first ones, as many as its size asks for.
    """
    least = least_overlap(n, percent)
    return n - least + np.minimum(least, common(n))


def least_shared(n, percent: int):
    """What a set of n must share within prefixes: common() of the smallest set that may link to it. n: a column."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * percent / 100) * COMMON_PERCENT / 100))


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


SPREAD = "fragment int, keys binary, owners binary, sets binary, ids binary, sizes binary, digests binary, carried string"
FRAGMENT_BYTES = 100_000_000  # of text, that a fragment of the first stage stands for
COUNTED = "doc_id long, n long, digest binary, set_id long, shared long, mark long, n_words long, carried string"


def spread(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, fragments: int, carry: Column) -> DataFrame:
    """Blocks of documents: one row for each fragment with the prefix keys there and their owners, and one (fragment < 0) with the documents.

    Prefixes are taken in the order of the keys; fragments go by another hash of them, so that all have as much.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for a, b in blocks(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BLOCK_CHARS):
                found, sizes, words, digests = sets_in(texts.slice(a, b - a), n)
                sets = np.frombuffer(b"".join(digests), dtype=np.int64)[::2]
                ids = batch.column(0).slice(a, b - a)
                valid = np.array(pc.is_valid(ids), dtype=np.int64)
                ids = np.array(pc.fill_null(ids, 0), dtype=np.int64)
                marks, carried = np.array(batch.column(2).slice(a, b - a), dtype=np.int64), batch.column(3).slice(a, b - a).to_pylist()
                rows = [(-1 - (part * 7919 + block) % fragments, b"", b"", sets.tobytes(), np.stack([ids, valid, marks, words]).tobytes(), sizes.tobytes(), b"".join(digests), json.dumps(carried))]
                _, firsts = np.unique(sets, return_index=True)  # of the equal sets of a block, one
                firsts = firsts[sizes[firsts] > 0]
                if len(firsts):
                    firm = prefix_length(sizes[firsts], percent)
                    begins = (np.cumsum(sizes) - sizes)[firsts] - (np.cumsum(firm) - firm)
                    keys = mixed(found[np.repeat(begins, firm) + np.arange(firm.sum())] ^ ODD[0])
                    owners = np.repeat(np.arange(len(firsts), dtype=np.uint32), firm)
                    top = ((keys >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.uint16 if fragments < 65_536 else np.uint32)
                    order = np.argsort(top, kind="stable")  # owners stay in order within a fragment
                    top, owners, small = top[order], owners[order], keys[order].astype(np.uint32)
                    cuts = np.searchsorted(top, np.arange(fragments + 1))
                    fresh = np.append(True, (owners[1:] != owners[:-1]) | (top[1:] != top[:-1]))
                    nth = np.cumsum(fresh) - 1
                    for f, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                        if y > x:
                            there, at = owners[x:y][fresh[x:y]], nth[x:y] - nth[x]
                            at = at.astype(np.uint16 if len(there) < 65_536 else np.uint32)
                            rows.append((f, small[x:y].tobytes(), at.tobytes(), sets[firsts[there]].tobytes(), b"", b"", b"", None))
                block += 1
                types = (pa.int32(), *[pa.binary()] * 6, pa.string())
                for c in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows[c : c + 64]), types)], names=names(SPREAD))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"), carry.cast("string").alias("carried")).mapInArrow(run, SPREAD)


def count_shared(blocks_: DataFrame) -> DataFrame:
    """Documents (doc_id, n, digest, set_id), and partial counts (set_id, shared) of each fragment."""

    def fragment(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, sets, start = [], [], 0
        for _, k, o, s, *_ in rows:
            own = np.frombuffer(o, dtype=np.uint16 if len(o) * 2 == len(k) else np.uint32)
            keys.append(np.frombuffer(k, dtype=np.uint32).astype(np.uint64) << np.uint64(32) | (own.astype(np.uint64) + np.uint64(start)))
            sets.append(np.frombuffer(s, dtype=np.int64))
            start += len(sets[-1])
        keys, sets = np.sort(np.concatenate(keys)), np.concatenate(sets)
        top, own = keys >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        same = top[1:] == top[:-1]
        often = np.append(same, False) | np.append(False, same)
        top, own = top[often], sets[own[often]]
        order = np.lexsort((own, top))
        top, own = top[order], own[order]
        first = np.append(True, (top[1:] != top[:-1]) | (own[1:] != own[:-1])) if len(top) else np.empty(0, dtype=bool)
        top, own = top[first], own[first]  # a set once for each key, however many blocks hold copies of it
        same = top[1:] == top[:-1]
        own = own[np.append(same, False) | np.append(False, same)] if len(top) else own
        found, shared = np.unique(own, return_counts=True)
        if len(found):
            none = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(found), pa.binary()), pa.array(found), pa.array(shared.astype(np.int64)), none, none, pa.nulls(len(found), pa.string())], names=names(COUNTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] < 0:
                    ids, valid, marks, words = np.frombuffer(row[4], dtype=np.int64).reshape(4, -1)
                    digests = [row[6][i : i + 16] for i in range(0, len(row[6]), 16)]
                    columns = [pa.array(ids, mask=valid == 0), pa.array(np.frombuffer(row[5], dtype=np.int64)), pa.array(digests, type=pa.binary()), pa.array(np.frombuffer(row[3], dtype=np.int64))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(ids), pa.int64()), pa.array(marks), pa.array(words), pa.array(json.loads(row[7]), type=pa.string())], names=names(COUNTED))
                    continue
                if rows and rows[0][0] != row[0]:
                    yield from fragment(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from fragment(rows)

    return blocks_.sortWithinPartitions("fragment").mapInArrow(run, COUNTED)


SETS = "digest binary, n long, shingles binary"


def sets_of(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """The set of each row, under its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist(), BLOCK_CHARS):
                keys, sizes, _, digests = sets_in(batch.column(0).slice(a, b - a), n)
                offsets = pa.array(np.append(0, 8 * np.cumsum(sizes)), pa.int32())
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(keys)])
                columns = [pa.array(digests, type=pa.binary()), pa.array(sizes), packed]
                yield pa.RecordBatch.from_arrays(columns, names=names(SETS))

    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")).mapInArrow(run, SETS)


CUT = "fragment int, rep long, keys binary"
ORDERED = "rep long, keys binary, often binary"
PREFIX = "rep long, n long, token long"


def prefixes(sets: DataFrame, percent: int, fragments: int) -> DataFrame:
    """(rep, n, token): of each set that still may link, the shared n-grams in its prefix, from rare to frequent."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rep, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                keys = np.frombuffer(data, dtype=np.uint64)
                cuts = np.searchsorted((keys >> np.uint64(32)).astype(np.int64) * fragments >> 32, np.arange(fragments + 1))
                rows += [(f, rep, keys[x:y].tobytes()) for f, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if y > x]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=names(CUT))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fragment(reps: list[int], data: list[bytes]) -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(data), dtype=np.uint64)
            distinct, at, often = np.unique(keys, return_inverse=True, return_counts=True)
            often, out, x = often[at], [], 0
            for rep, d in zip(reps, data):
                y = x + len(d) // 8
                more = often[x:y] > 1
                out.append((rep, keys[x:y][more].tobytes(), often[x:y][more].astype(np.int64).tobytes()))
                x = y
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=names(ORDERED))

        now, reps, data = None, [], []
        for batch in batches:
            for f, rep, keys in zip(*(c.to_pylist() for c in batch.columns)):
                if f != now and reps:
                    yield fragment(reps, data)
                    reps, data = [], []
                now = f
                reps.append(rep)
                data.append(keys)
        if reps:
            yield fragment(reps, data)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rep, n, parts in zip(*(c.to_pylist() for c in batch.columns)):
                keys = np.frombuffer(b"".join(p["keys"] for p in parts), dtype=np.uint64)
                often = np.frombuffer(b"".join(p["often"] for p in parts), dtype=np.int64)
                least = -(-n * percent // 100)
                slots = n - least + 1 - (n - len(keys))  # n-grams of one set only come first in the order
                if slots > 0:
                    order = np.lexsort((keys, often))[:slots]
                    out.append((np.full(len(order), rep), np.full(len(order), n), keys[order].view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=names(PREFIX))

    counted = sets.mapInArrow(cut, CUT).repartition("fragment").sortWithinPartitions("fragment").mapInArrow(count, ORDERED)
    parts = counted.groupBy("rep").agg(F.collect_list(F.struct("keys", "often")).alias("parts"))
    return sets.select("rep", "n").join(parts, "rep").select("rep", "n", "parts").mapInArrow(choose, PREFIX)


def candidate_groups(prefix: DataFrame, percent: int) -> DataFrame:
    """(node, component): sets that share a prefix n-gram with a set of a length near enough, and transitively so.

    Lengths are classed so that any two of a class are near enough. The sets of an n-gram and a class are a star
    around its smallest; stars of neighbouring classes are joined where the longest of one is near enough to the
    shortest of the next. Aggregates only: no task orders all sets of a frequent n-gram.
    """
    by = F.floor(F.log("n") / math.log(100 / percent)) if percent < 100 else F.col("n")
    classed = prefix.withColumn("cls", by.cast("long"))
    stars = classed.groupBy("token", "cls").agg(F.min("rep").alias("b"), F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("sets"))
    more = stars.filter("sets > 1").select("token", "cls", "b")
    edges = classed.join(more, ["token", "cls"]).selectExpr("rep a", "b")
    longer = stars.selectExpr("token", "cls - 1 cls", "b a", "low next_low")
    chain = stars.join(longer, ["token", "cls"]).filter(100 * F.col("high") >= percent * F.col("next_low")).select("a", "b")
    return components(edges.unionByName(chain).filter("a <> b").distinct())


TILED = "grp long, bi int, bj int, fragment int, side int, at int, rep long, n long, keys binary"
PARTIAL = "grp long, bi int, bj int, reps binary, sizes binary, rows int, counts binary"
LINKS = "a long, b long, degree long"


def overlaps(keys: list[np.ndarray], split: int | None) -> np.ndarray:
    """Matrix of how many keys each two of the sets have in common. split: only pairs of one before and one from it on are needed."""
    size = len(keys)
    owner = np.repeat(np.arange(size), [len(k) for k in keys])
    key = np.concatenate(keys) if size else np.empty(0, dtype=np.uint64)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=np.int64)
    runs = np.diff(np.append(starts, len(key)))
    length = np.repeat(runs, runs)
    counts = np.zeros((size, size), dtype=np.int64)
    hot = np.flatnonzero(length > HOT_RUN)
    column = np.cumsum(np.append(True, key[hot][1:] != key[hot][:-1])) - 1 if len(hot) else hot
    for c in range(0, int(column[-1]) + 1 if len(hot) else 0, 2048):
        mine = hot[(column >= c) & (column < c + 2048)]
        one = np.zeros((size, 2048), dtype=np.float32)
        one[owner[mine], column[(column >= c) & (column < c + 2048)] - c] = 1
        if split is None:
            counts += (one @ one.T).astype(np.int64)
        else:
            counts[:split, split:] += (one[:split] @ one[split:].T).astype(np.int64)
    rest = (length > 1) & (length <= HOT_RUN)
    key, owner = key[rest], owner[rest]
    for k in range(1, HOT_RUN):
        same = key[k:] == key[:-k]
        if not same.any():
            break
        counts += np.bincount(owner[:-k][same] * size + owner[k:][same], minlength=size * size).reshape(size, size)
    return np.triu(counts, 1)


def partial_counts(tiles: DataFrame) -> DataFrame:
    """One row for each tile and fragment: places and counts of the pairs with an overlap there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(at: tuple, rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[0], r[1]))
            split = sum(r[0] == 0 for r in rows) if at[1] != at[2] else None
            counts = overlaps([np.frombuffer(r[4], dtype=np.uint64) for r in rows], split)
            place = np.flatnonzero(counts)
            row = (*at[:3], np.array([r[2] for r in rows]).tobytes(), np.array([r[3] for r in rows]).tobytes(), split or 0, np.stack([place, counts.ravel()[place]]).astype(np.int32).tobytes())
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, types)], names=names(PARTIAL))

        now, rows = None, []
        for batch in batches:
            for g, i, j, f, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (g, i, j, f) and rows:
                    yield tile(now, rows)
                    rows = []
                now = (g, i, j, f)
                rows.append(row)
        if rows:
            yield tile(now, rows)

    keys = ["grp", "bi", "bj", "fragment"]
    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, PARTIAL)


def links_of(partials: DataFrame, percent: int) -> DataFrame:
    """Sum of the fragments of each tile. (a, b): a forest of its links; (a, null, degree): how many links a set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            _, _, _, reps, sizes, split, _ = rows[0]
            reps, sizes = np.frombuffer(reps, dtype=np.int64), np.frombuffer(sizes, dtype=np.int64)
            total = np.zeros(len(reps) ** 2, dtype=np.int64)
            for row in rows:
                place, count = np.frombuffer(row[6], dtype=np.int32).reshape(2, -1)
                total[place] += count
            place = np.flatnonzero(total)
            x, y = np.divmod(place, len(reps))
            both = total[place]
            linked = 100 * both >= percent * (sizes[x] + sizes[y] - both)
            if split:
                linked &= (x < split) & (y >= split)
            x, y = x[linked], y[linked]
            if not len(x):
                return
            root = np.arange(len(reps))
            while True:  # smallest place that is reached, by repeated halving of paths
                before = root.copy()
                np.minimum.at(root, x, root[y])
                np.minimum.at(root, y, root[x])
                root = root[root]
                if (root == before).all():
                    break
            hit, degree = np.unique(np.concatenate([x, y]), return_counts=True)
            columns = [pa.array(reps[hit]), pa.array(reps[root[hit]]), pa.array(degree.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=names(LINKS))

        now, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if now != row[:3] and rows:
                    yield from tile(rows)
                    rows = []
                now = row[:3]
                rows.append(row)
        if rows:
            yield from tile(rows)

    return partials.repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj").mapInArrow(run, LINKS)


def tiles_of(sets: DataFrame, prefix: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The sets of each tile, cut into fragments of the order of n-grams.

    A group is dealt into parts of about PART sets by a hash, and a part is cut into blocks in the order of length.
    Two blocks meet if a prefix n-gram stands in both and their lengths are near enough.
    """
    sized = groups.groupBy("component").agg(F.ceil(F.count("*") / PART).alias("parts"))
    grouped = groups.join(sized, "component").selectExpr("node rep", "component grp", "pmod(xxhash64(node), parts) part")
    order = Window.partitionBy("grp", "part").orderBy("n", "rep")
    placed = sets.select("rep", "n").join(grouped, "rep").withColumn("rn", F.row_number().over(order) - 1)
    blk = F.col("part") * (4 * PART // TILE) + F.floor(F.col("rn") / TILE)  # a part has at most four times its size
    placed = materialise(placed.select("grp", "rep", "n", blk.cast("int").alias("blk"), (F.col("rn") % TILE).cast("int").alias("at")), "placed")
    held = prefix.select("rep", "token").join(placed, "rep").groupBy("grp", "token", "blk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = held.selectExpr("grp", "token", "blk bi", "low low_i", "high high_i"), held.selectExpr("grp", "token", "blk bj", "low low_j", "high high_j")
    near = (100 * F.col("high_i") >= percent * F.col("low_j")) & (100 * F.col("high_j") >= percent * F.col("low_i"))
    pairs = materialise(left.join(right, ["grp", "token"]).filter(near & (F.col("bi") <= F.col("bj"))).select("grp", "bi", "bj").distinct(), "tile-pairs")
    sides = pairs.select("grp", "bi", "bj", F.col("bi").alias("blk"), F.lit(0).alias("side")).unionByName(pairs.filter("bi <> bj").select("grp", "bi", "bj", F.col("bj").alias("blk"), F.lit(1).alias("side")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, i, j, side, at, rep, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                keys = np.frombuffer(data, dtype=np.uint64)
                ends = np.searchsorted((keys >> np.uint64(32)).astype(np.int64) * TILE_FRAGMENTS >> 32, np.arange(TILE_FRAGMENTS + 1))
                rows += [(g, i, j, f, side, at, rep, n, keys[x:y].tobytes()) for f, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()))]
            types = (pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.int64(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names(TILED))

    rows = placed.join(sides, ["grp", "blk"]).join(sets.select("rep", "shingles"), "rep")
    return rows.select("grp", "bi", "bj", "side", "at", "rep", "n", "shingles").mapInArrow(cut, TILED)


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs as (doc_id, n_shingles, component_id, n_links).

    Sets are the distinct n-word shingles of whole texts (words as [^\\x20\\x09-\\x0D]+, A-Z lower-cased; fewer words are
    one shingle). Two documents link if 100 * intersection >= percent * union. component_id: the smallest doc_id
    reachable by links, itself included. n_links: linked sets other than the own. Null and empty texts link with nothing.
    Rows of a null id link like others; they have no id to name a component by, so one of null ids alone is null.
    Rows that repeat an id with another text are rows of their own. Repeated rows stay. An empty table gives an empty one.
    """
    return grouped(docs, n, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "n_links")


def grouped(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """The rows of join() with what else the same pass knows: mark, the hash of the text (which with doc_id tells rows apart), n_words,
    carried (a string column of docs), near, which names the component, null for texts without words, and is_first: of a component's rows the one with the
    smallest doc_id, null last, then the smallest mark; rows that repeat both, and those of texts without words, are all first.
    """
    if not COMMON_PERCENT < percent <= 100:
        raise ValueError(f"percent must be above {COMMON_PERCENT}, at most 100")
    spark = docs.sparkSession
    parts = n_parts(spark)
    total = docs.select(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    fragments = max(parts, -(-total // FRAGMENT_BYTES))
    dealt = spread(docs, id_col, text_col, n, percent, fragments, F.lit(None) if carry is None else carry).repartitionById(parts, F.pmod("fragment", F.lit(parts)))
    counted = materialise(count_shared(dealt), "ngram-counts")
    rows = counted.filter("digest is not null").select("doc_id", "n", "digest", "set_id", "mark", "n_words", "carried")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    classes = rows.groupBy("digest", "set_id", "n").agg(F.min("doc_id").alias("least_id"), F.min(first).alias("first"))
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "ngram-classes")  # rep: the class's own number
    shared = counted.filter("digest is null").groupBy("set_id").agg(F.sum("shared").alias("shared"))
    may = classes.filter("n > 0").join(shared, "set_id").filter(F.col("shared") >= least_shared(F.col("n"), percent))
    may = materialise(may.select("digest", "rep", "least_id"), "ngram-candidates")
    own = F.col(id_col).cast("long").eqNullSafe(F.col("__least_id"))
    left = docs.join(may.select(F.col("least_id").alias("__least_id")).distinct(), own, "left_semi")
    sets = sets_of(left, text_col, n).join(may.select("digest", "rep"), "digest")
    sets = materialise(sets.select("rep", "n", "shingles").dropDuplicates(["rep"]), "ngram-sets")
    keys = sets.agg(F.sum("n")).first()[0] or 0
    prefix = materialise(prefixes(sets, percent, max(PREFIX_FRAGMENTS, -(-keys // FRAGMENT_KEYS))), "ngram-prefixes")
    groups = materialise(candidate_groups(prefix, percent), "ngram-groups")
    links = materialise(links_of(partial_counts(tiles_of(sets, prefix, groups, percent)), percent), "ngram-links")
    linked = materialise(components(links.select("a", "b")).join(classes.select(F.col("rep").alias("node"), "least_id", "first"), "node"), "ngram-components")
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"), F.min("first").alias("first"))
    named = linked.drop("least_id", "first").join(least, "component").select(F.col("node").alias("rep"), "component_id", F.col("first").alias("component_first"))
    degrees = links.groupBy(F.col("a").alias("rep")).agg(F.sum("degree").alias("n_links"))
    found = classes.join(named.join(degrees, "rep"), "rep", "left")
    alone = F.col("n_links").isNull()
    found = found.select(
        F.col("digest").alias("d"),
        F.when(alone, F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("first")).otherwise(F.col("component_first")).alias("first"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    full = rows.join(found, F.col("digest") == F.col("d"))
    alone = F.col("n") == 0
    return full.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, 0).otherwise(F.col("n_links")).alias("n_links"),
        "mark",
        "n_words",
        "carried",
        F.when(~alone, F.xxhash64("first.doc_id", "first.mark")).alias("near"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))).alias("is_first"),
    )
