"""Token-id files: blocks of whole documents, each coded on its own by an adaptive context-mixing range coder.

A block's ids run in lanes that advance in step and share one model, so that numpy codes one id of every
lane at a time. Three distributions predict each id: order 2 puts all its mass on the id last seen after this
pair, order 1 on the one last seen after this id, and order 0 spreads it by adaptive frequencies over the whole
vocabulary. They are mixed, P = w2 P2 + w1 P1 + w0 P0, with weights that are learned for each state of the two
contexts' confidence, and the mixture drives the coder: an id has the mass that every order gives it.
Every block starts with a fresh model and ends with a CRC-32, so blocks are read in any order.

Files are lines of text, one for each block, in ascending order of document ids over the files' names and their
lines: part, block, first document (empty for none), documents, ids, ids before in the part, and the block in
base64, separated by tabs. Block: magic, then little-endian u32 documents, ids, vocabulary, lanes, bytes of the
document table; the table (zlib: i64 document ids, i64 counts); u32 words of each lane; the words; u32 CRC-32 of
all before it.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.llm.bpe import blocks
from skerry.llm.common import new_path

MAGIC = b"SKT2"
BLOCK_IDS = 1_000_000
LANES, LEAST_STEPS = 4096, 128
BLOCK_BYTES, MEMO_PIECES = 4_000_000, 600_000
WORD, LOW_BITS = 31, 1 << 31
MASK = LOW_BITS - 1
SOURCE_BITS, ZERO_BITS, HASH_BITS = 10, 19, 18
ALL_BITS = SOURCE_BITS + ZERO_BITS
NO_ID = -(2**63)  # in a document table: a document without an id
FILE = "part int, block int, first_doc long, n_docs int, n_ids long, ids_before long, data string"
MARK_BYTE = 1
MARK, DIGIT, SPACE, SIGN, LETTER = range(5)  # kinds of bytes; a mark and a digit are pieces by themselves
KINDS = np.array([LETTER if b >= 128 or chr(b).islower() else MARK if b == MARK_BYTE else DIGIT if chr(b).isdigit() else SPACE if b == 32 or 9 <= b <= 13 else SIGN for b in range(256)], dtype=np.uint8)
SPELLED = np.arange(256, dtype="<u4")  # code points that stand for bytes in the vocabulary; line ends stay
SPELLED[[b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]] = np.arange(256, 256 + 68)
SPELLED[10] = 10
READ = "part int, doc_id long, start_in_part long, n_tokens long, packed binary"


class Model:
    """The mixture of the three orders, shared by the lanes of a block. Coder and decoder drive it alike.

    A table entry is an id and, in its two low bits, how sure it is. Masses are of 2^ALL_BITS: a weight has SOURCE_BITS,
    the frequencies of order 0 have ZERO_BITS, and the point masses of orders 1 and 2 are a weight's whole 2^ZERO_BITS.
    """

    def __init__(self, vocabulary: int):
        if not 0 < vocabulary <= 1 << ZERO_BITS - 1:
            raise ValueError(f"a vocabulary has 1 to {1 << ZERO_BITS - 1} ids")
        self.n = vocabulary
        self.table1, self.table2 = np.zeros(vocabulary, dtype=np.int64), np.zeros(1 << HASH_BITS, dtype=np.int64)
        self.mix = np.tile(np.array([2, 1, 2]), (16, 1))  # weights of orders 2, 1 and 0
        self.count, self.fresh, self.step = np.ones(vocabulary, dtype=np.int64), [], 0
        self.rebuild()

    def rebuild(self) -> None:
        """Order-0 frequencies that sum to 2^ZERO_BITS, none below 1."""
        if self.fresh:
            self.count += 32 * np.bincount(np.concatenate(self.fresh), minlength=self.n)
            self.fresh = []
        spare = (1 << ZERO_BITS) - self.n
        self.freq0 = 1 + self.count * spare // self.count.sum()
        self.freq0[np.argmax(self.freq0)] += (1 << ZERO_BITS) - self.freq0.sum()
        self.start0, self.slots = np.cumsum(self.freq0) - self.freq0, None

    def id_at(self, slot: np.ndarray) -> np.ndarray:
        if self.slots is None:
            self.slots = np.repeat(np.arange(self.n), self.freq0)
        return self.slots[slot]

    def predict(self, a: np.ndarray, b: np.ndarray) -> None:
        """Guesses and weights for the lanes whose last two ids are a and b."""
        self.at1, self.at2 = b, ((a * 49_999 + b) * 40_503 >> 7) & ((1 << HASH_BITS) - 1)
        self.entry2, self.entry1 = self.table2[self.at2], self.table1[b]
        self.guess2, self.guess1 = self.entry2 >> 2, self.entry1 >> 2
        self.state = (self.entry2 & 3) << 2 | self.entry1 & 3
        weight = 1 + self.mix * ((1 << SOURCE_BITS) - 3) // self.mix.sum(axis=1, keepdims=True)
        weight[:, 2] += (1 << SOURCE_BITS) - weight.sum(axis=1)
        point = weight << ZERO_BITS
        self.mass2, self.mass1, self.weight0 = point[:, 0][self.state], point[:, 1][self.state], weight[:, 2][self.state]

    def place(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of ids in the mixture, of 2^ALL_BITS: what all three orders have below them, and at them."""
        start = self.start0[ids] * self.weight0 + self.mass2 * (self.guess2 < ids) + self.mass1 * (self.guess1 < ids)
        return start, self.freq0[ids] * self.weight0 + self.mass2 * (self.guess2 == ids) + self.mass1 * (self.guess1 == ids)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """place() of the ids that come next."""
        self.hit2, self.hit1 = self.guess2 == ids, self.guess1 == ids
        return self.place(ids)

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids that come next, by values in their intervals, with starts and lengths."""
        start2, size2 = self.place(self.guess2)
        start1, size1 = self.place(self.guess1)
        end2, end1 = start2 + size2, start1 + size1
        above2, above1 = v >= end2, v >= end1
        self.hit2, self.hit1 = (v >= start2) & ~above2, (v >= start1) & ~above1
        ids, start, size = np.where(self.hit2, self.guess2, self.guess1), np.where(self.hit2, start2, start1), np.where(self.hit2, size2, size1)
        rest = np.flatnonzero(~(self.hit2 | self.hit1))  # that only order 0 has mass for
        weight = self.weight0[rest]
        points = self.mass2[rest] * above2[rest] + self.mass1[rest] * above1[rest]  # the other orders' mass below
        found = ids[rest] = self.id_at((v[rest] - points) // weight)
        start[rest], size[rest] = self.start0[found] * weight + points, self.freq0[found] * weight
        return ids, start, size

    def update(self, ids: np.ndarray) -> None:
        """Learn from the ids that interval() was asked for, or find() found."""
        hits = np.bincount(self.state << 2 | self.hit2.view(np.int8) << 1 | self.hit1, minlength=64).reshape(16, 4)
        self.mix += np.stack([hits[:, 2] + hits[:, 3], hits[:, 1] + hits[:, 3], hits[:, 0]], axis=1) * 4
        if self.step % 16 == 0:
            self.mix = (self.mix + 1 >> 1) + 1
        fresh = ids << 2
        for table, at, entry, hit in ((self.table2, self.at2, self.entry2, self.hit2), (self.table1, self.at1, self.entry1, self.hit1)):
            sure = entry & 3
            table[at] = np.where(hit, entry + (sure < 3), np.where(sure > 0, entry - 1, fresh))
        self.fresh.append(ids)
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 32 == 0:
            self.rebuild()


def encode_ids(ids: np.ndarray, vocabulary: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(lanes, words of each lane, all words)."""
    n = len(ids)
    lanes = int(np.clip(n // LEAST_STEPS, 1, LANES))
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, dtype=np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    low, span = np.zeros(lanes, dtype=np.int64), np.full(lanes, 1 << 61, dtype=np.int64)
    out, at = np.zeros((lanes, steps + 2), dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    model = Model(vocabulary)
    a = b = np.zeros(lanes, dtype=np.int64)
    for t in range(steps):
        s = grid[t]
        model.predict(a, b)
        start, freq = model.interval(s)
        r = span >> ALL_BITS
        low += r * start
        span = r * freq
        full = np.flatnonzero(span < LOW_BITS)
        part = low[full]
        out[full, at[full]] = part >> WORD  # with a carry in bit 31, for now
        at[full] += 1
        low[full] = (part & MASK) << WORD
        span[full] <<= WORD
        model.update(s)
        a, b = b, s
    every = np.arange(lanes)
    out[every, at] = low >> WORD
    out[every, at + 1] = low & MASK
    at += 2
    for c in range(int(at.max()) - 1, 0, -1):  # carries run to the left
        out[:, c - 1] += out[:, c] >> WORD
        out[:, c] &= MASK
    used = np.arange(out.shape[1]) < at[:, None]
    return lanes, at.astype("<u4"), out[used].astype("<u4")


def decode_ids(n: int, vocabulary: int, lanes: int, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    steps = -(-n // lanes)
    words = np.append(words.astype(np.int64), 0)
    at = np.cumsum(counts.astype(np.int64)) - counts
    value = words[at] << WORD | words[at + 1]
    at = at + 2
    span, model, last = np.full(lanes, 1 << 61, dtype=np.int64), Model(vocabulary), len(words) - 1
    grid = np.empty((steps, lanes), dtype=np.int64)
    a = b = np.zeros(lanes, dtype=np.int64)
    for t in range(steps):
        model.predict(a, b)
        r = span >> ALL_BITS
        s, start, freq = model.find(np.minimum(value // r, (1 << ALL_BITS) - 1))
        value -= r * start
        span = r * freq
        full = np.flatnonzero(span < LOW_BITS)
        value[full] = value[full] << WORD | words[np.minimum(at[full], last)]
        at[full] += 1
        span[full] <<= WORD
        model.update(s)
        grid[t] = s
        a, b = b, s
    return grid.T.reshape(-1)[:n]


def write_block(doc_ids: list[int], counts: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    """doc_ids without nulls; ids of all documents end to end."""
    table = zlib.compress(np.array([doc_ids, counts], dtype="<i8").tobytes())
    lanes, sizes, words = encode_ids(ids, vocabulary) if len(ids) else (0, np.empty(0, dtype="<u4"), np.empty(0, dtype="<u4"))
    data = b"".join([MAGIC, struct.pack("<5I", len(doc_ids), len(ids), vocabulary, lanes, len(table)), table, sizes.tobytes(), words.tobytes()])
    return data + struct.pack("<I", zlib.crc32(data))


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, counts and ids of a block; ValueError if it isn't whole."""
    if data[:4] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ValueError("a damaged block of token ids")
    docs, n, vocabulary, lanes, size = struct.unpack("<5I", data[4:24])
    doc_ids, counts = np.frombuffer(zlib.decompress(data[24 : 24 + size]), dtype="<i8").reshape(2, docs)
    at = 24 + size
    sizes = np.frombuffer(data, dtype="<u4", count=lanes, offset=at)
    words = np.frombuffer(data[at + 4 * lanes : -4], dtype="<u4")
    return doc_ids, counts, decode_ids(n, vocabulary, lanes, sizes, words) if n else np.empty(0, dtype=np.int64)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of ranges, end to end."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class Words:
    """Ids of texts, by the parts of the tokenizers library, with a bounded memo of pieces.

    White space never joins words there, and pieces of words are encoded once each. In words of ASCII and Latin letters,
    normalising is lower case, and the kinds of bytes tell where pieces start: all texts of a call are cut at once. The
    bytes of a piece are spelled out by a table. Any other word is replaced by a mark, and the library normalises and splits it.
    """

    loaded: dict[str, "Words"] = {}
    LETTERS = "!-~\u00c0-\u012f\u0131-\u017f"
    ALL_LATIN = re.compile(rf"[\t-\r {LETTERS}]*")
    OTHER = re.compile(rf"(?<![^\t-\r ])((?:[{LETTERS}]*+[^\t-\r {LETTERS}]|[^\t-\r ]*?<\|)[^\t-\r ]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.model, self.normal, self.split = self.coder.model, self.coder.normalizer, self.coder.pre_tokenizer
        self.special = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        self.vocabulary = 1 + max(self.coder.get_vocab(with_added_tokens=True).values())
        self.piece = functools.lru_cache(MEMO_PIECES // 6)(lambda piece: [t.id for t in self.model.tokenize(piece)])
        self.forget()

    @classmethod
    def of(cls, path: str) -> "Words":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def forget(self) -> None:
        self.number: dict[bytes | str, int] = {}  # pieces are bytes, other words are str
        self.ids, self.start, self.size = np.empty(0, dtype="<i4"), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def spelled(self, pieces: list[bytes]) -> list[str]:
        """Pieces as the vocabulary writes them."""
        return SPELLED[np.frombuffer(b"\n".join(pieces), dtype=np.uint8)].tobytes().decode("utf-32-le").split("\n") if pieces else []

    def other(self, word: str) -> list[int]:
        """Ids of a word with other letters, control characters or a special token."""
        if "<|" in word and any(t in word for t in self.special):
            return self.coder.encode(word, add_special_tokens=False).ids
        return [i for p, _ in self.split.pre_tokenize_str(self.normal.normalize_str(word)) for i in self.piece(p)]

    def numbers(self, pieces: list[bytes], others: list[str]) -> np.ndarray:
        """Places in start and size of distinct pieces and of distinct other words; unknown ones are encoded."""
        keys = [*pieces, *others]
        found = np.fromiter(map(self.number.get, keys, itertools.repeat(-1)), dtype=np.int64, count=len(keys))
        fresh = np.flatnonzero(found < 0)
        if len(fresh) and (len(self.number) + len(fresh) > MEMO_PIECES or len(self.ids) > 8 * MEMO_PIECES):
            self.forget()
            fresh = np.arange(len(keys))
        if len(fresh):
            found[fresh] = np.arange(len(self.number), len(self.number) + len(fresh))
            own = [keys[k] for k in fresh.tolist()]
            self.number.update(zip(own, found[fresh].tolist()))
            cut, ids, size = int(np.searchsorted(fresh, len(pieces))), array("i"), []
            for piece in self.spelled(own[:cut]):
                tokens = self.model.tokenize(piece)
                ids.extend([t.id for t in tokens])
                size.append(len(tokens))
            for word in own[cut:]:
                more = self.other(word)
                ids.extend(more)
                size.append(len(more))
            size = np.array(size, dtype=np.int64)
            self.start, self.size = np.append(self.start, len(self.ids) + np.cumsum(size) - size), np.append(self.size, size)
            self.ids = np.append(self.ids, np.array(ids, dtype="<i4"))
        return found

    def cut(self, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces and white space start in lower-case Latin text that ends in two line ends, and which of them are pieces."""
        kind = KINDS[byte]
        at = np.flatnonzero((byte[:-1] == 0xC3) & ((byte[1:] | 0x20) == 0xB7))  # the signs of multiplication and division
        kind[at] = kind[at + 1] = SIGN
        first = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] <= DIGIT))
        at = np.flatnonzero(byte[:-2] == ord("'"))
        at = at[first[at] & (kind[at + 1] == LETTER)]  # may be 's, 't, 'm, 'd, 're, 've or 'll
        pair = byte[at + 1].astype(np.int32) << 8 | byte[at + 2]
        for known, size in ((np.isin(byte[at + 1], list(b"stmd")), 2), (np.isin(pair, [a << 8 | b for a, b in (b"re", b"ve", b"ll")]), 3)):
            first[at[known] + 1] = False
            first[at[known] + size] = True
        start = np.flatnonzero(first)
        return start, kind[start] != SPACE

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """Packed little-endian int32 ids of each text, with the end id."""
        others, lines = [], []
        for text in texts:
            text = text.decode("utf-8", "replace")
            if "<|" in text or not self.ALL_LATIN.fullmatch(text):
                parts = self.OTHER.split(text)
                others += parts[1::2]
                text = chr(MARK_BYTE).join(parts[::2])
            lines.append(text.lower().encode())
        joined = b"\n".join([*lines, b"", b""])
        byte = np.frombuffer(joined, dtype=np.uint8)
        start, word = self.cut(byte)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(byte))), pa.py_buffer(joined)])
        found, start = pieces.filter(pa.array(word)).dictionary_encode(), start[word]
        known = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = {w: len(known) + k for k, w in enumerate(dict.fromkeys(others))}
        numbers = self.numbers(known, list(place))
        number = numbers[found.indices.to_numpy()]
        if others:
            number[byte[start] == MARK_BYTE] = numbers[[place[w] for w in others]]
        size = self.size[number]
        packed = self.ids[ranges(self.start[number], size)].tobytes()
        borders = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in lines)]))
        ends = (4 * np.append(0, np.cumsum(size))[borders]).tolist()
        tail = struct.pack("<i", end)
        return [packed[a:b] + tail for a, b in zip(ends, ends[1:])]


def write_ids(docs: DataFrame, vocabulary: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, path: str | None = None) -> DataFrame:
    """Write the ids of every whole text, in ascending order of doc_id, as files, and return their blocks as open_files() reads them.

    Rows are dealt by ranges of doc_id: part p holds smaller ids than part p+1, blocks within a part ascend. A null
    text counts as empty and has the end id alone. Rows with a null doc_id come first of all and are read back without
    one (so is the id -2^63). Rows that repeat an id stand side by side, by text. An empty table writes no block. path: where the
    files go, by default a new folder in the shared one. vocabulary is a file that each executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Words.of(vocabulary), TaskContext.get().partitionId()
        ids, counts, packed, total, before, block = [], [], [], 0, 0, 0

        def out() -> pa.RecordBatch:
            data = write_block(ids, counts, np.frombuffer(b"".join(packed), dtype="<i4").astype(np.int64), coder.vocabulary)
            row = (part, block, "" if ids[0] == NO_ID else ids[0], len(ids), total, before, base64.b64encode(data).decode())
            return pa.RecordBatch.from_arrays([pa.array(["\t".join(map(str, row))])], names=["value"])

        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for a, b in blocks(sizes, BLOCK_BYTES):
                found = coder.encode([t or b"" for t in batch.column(1).slice(a, b - a).to_pylist()], end)
                for i, p in zip(batch.column(0).slice(a, b - a).to_pylist(), found):
                    ids.append(i)
                    counts.append(len(p) // 4)
                    packed.append(p)
                    total += counts[-1]
                    if total >= block_ids:
                        yield out()
                        before, block = before + total, block + 1
                        ids, counts, packed, total = [], [], [], 0
        if ids:
            yield out()

    spark = docs.sparkSession
    path = path or new_path(spark, "token-ids")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "value string").write.text(path)
    return open_files(spark, path)


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of the files of a folder, one row for each."""
    field = F.split("value", "\t")
    names = [c.split() for c in FILE.split(", ")]
    return spark.read.schema("value string").text(path).select(*(F.nullif(field[k], F.lit("")).cast(kind).alias(name) for k, (name, kind) in enumerate(names)))


def read_ids(files: DataFrame, batch_ids: int = BLOCK_IDS) -> DataFrame:
    """Every document of the blocks: (part, doc_id, start_in_part, n_tokens, packed little-endian u32 ids). Damaged blocks raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids, counts, ids = read_block(base64.b64decode(data))
                packed, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                texts = [packed[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())]
                columns = [pa.array(np.full(len(counts), part, dtype=np.int32)), pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(before + ends - counts), pa.array(counts), pa.array(texts, type=pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in READ.split(", ")])

    return files.select("part", "ids_before", "data").mapInArrow(run, READ)


def starts(files: DataFrame) -> DataFrame:
    """(part, part_start): ids in all parts before. One row for each part, of which there are as many as partitions."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
