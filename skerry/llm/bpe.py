"""Byte-level BPE: merge replay over blocks of the corpus.

A task cuts its documents into blocks of bounded text. The distinct words of a block that are not yet
known form one flat array of byte tokens. An inverted index leads from a merge's rank to the word
positions where its pair stands; merges are applied in rank order, and each one looks again only at
the left and the right neighbour it touched. Words are independent of each other, so blocks never
change a result and no document or dictionary has to travel: the scan's partitioning is kept and there
is no shuffle.

Ranks are indexed in bands of BAND ranks. Within a band, a pass applies to every word the lowest-ranked,
leftmost pair it has there, so that each word sees its merges in exactly the order of the ranks.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

BAND = 6  # bits
BLOCK_CHARS = 2_000_000
MEMO_WORDS = 250_000
ENCODED = "doc_id long, n_tokens long, ids array<int>"
DECODED = "doc_id long, n_tokens long, ids array<int>, decoded binary"

_loaded: dict[tuple[str, str], "MergeReplay"] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes words by a rank table; keeps a bounded memo from word to packed little-endian int32 ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.memo = ranks, regex.compile(pattern), {}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.int64(2**62))
        self.pair_ranks = np.append(np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))[order], np.int32(-1))

    @classmethod
    def of(cls, path: str, pattern: str) -> "MergeReplay":
        """One table for each worker process and vocabulary."""
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = cls(load_ranks(path), pattern)
        return _loaded[path, pattern]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of tokens, -1 where there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(-1))

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, end to end, and how many ids each word has."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        token = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(token)
        word = np.repeat(np.arange(len(words)), size)
        after = np.arange(1, n + 1)
        after[np.cumsum(size) - 1] = -1
        before = np.arange(-1, n - 1)
        before[np.cumsum(size) - size] = -1
        rank = np.full(n, -1, dtype=np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.rank_of(token[inner], token[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        bands: list[int] = []

        def put(at: np.ndarray) -> None:
            band = rank[at] >> BAND
            order = np.argsort(band, kind="stable")
            at, band = at[order], band[order]
            cuts = np.flatnonzero(band[1:] != band[:-1]) + 1
            for part, b in zip(np.split(at, cuts), band[np.append(0, cuts)].tolist()):
                if b in index:
                    index[b].append(part)
                else:
                    index[b] = [part]
                    heapq.heappush(bands, b)

        if (has := inner[rank[inner] >= 0]).size:
            put(has)
        while bands:
            band = heapq.heappop(bands)
            at = np.concatenate(index.pop(band))
            at = at[rank[at] >> BAND == band]  # without pairs that a merge has changed since
            if not at.size:
                continue
            order = np.lexsort((at, rank[at], word[at]))
            at = at[order]
            leads = np.ones(len(at), dtype=bool)
            leads[1:] = word[at[1:]] != word[at[:-1]]
            if not leads.all():
                put(at[~leads])
            at = at[leads]
            gone = after[at]
            right, left = after[gone], before[at]
            token[at] = rank[at]
            token[gone] = rank[gone] = -1
            after[at] = right
            rank[at] = -1
            has = right >= 0
            before[right[has]] = at[has]
            rank[at[has]] = self.rank_of(token[at[has]], token[right[has]])
            has = left >= 0
            rank[left[has]] = self.rank_of(token[left[has]], token[at[has]])
            touched = np.concatenate([at, left[has]])
            touched = touched[rank[touched] >= 0]
            if touched.size:
                put(touched)
        kept = token >= 0
        return token[kept], np.bincount(word[kept], minlength=len(words))

    def learn(self, words: set[str]) -> None:
        """Put the ids of words into the memo. A word that is a token is that token."""
        rest = []
        for w in words:
            whole = self.ranks.get(b := w.encode("utf-8", "replace"))
            if whole is None:
                rest.append((w, b))
            else:
                self.memo[w] = whole.to_bytes(4, "little")
        if rest:
            ids, counts = self.replay([b for _, b in rest])
            packed, at = ids.astype("<i4").tobytes(), 0
            for (w, _), k in zip(rest, (counts * 4).tolist()):
                self.memo[w] = packed[at : at + k]
                at += k

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. The texts of a call are one block."""
        cut = [self.pattern.findall(t) for t in texts]
        fresh: set[str] = set()
        for words in cut:
            fresh.update(words)
        unknown = fresh.difference(self.memo)
        if len(self.memo) + len(unknown) > MEMO_WORDS:
            self.memo.clear()
            unknown = fresh
        if unknown:
            self.learn(unknown)
        return [b"".join(map(self.memo.__getitem__, words)) for words in cut]


def blocks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes come to about limit; a larger row is a block of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Ids of every whole text: (doc_id, n_tokens, ids), one row for each row of docs.

    Nulls and empty texts have no ids; repeated rows and ids stay as they are; other columns are not read;
    an empty table gives an empty one. vocabulary is a file of base64 tokens and ranks that each executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = MergeReplay.of(vocabulary, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in blocks(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), block_chars):
                packed = coder.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                sizes = np.fromiter((len(p) // 4 for p in packed), dtype=np.int64, count=len(packed))
                values = pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(packed))])
                offsets = pa.array(np.append(0, np.cumsum(sizes)), type=pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "n_tokens", "ids"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, vocabulary: str, block_ids: int = BLOCK_CHARS) -> DataFrame:
    """Adds the bytes that the ids stand for, as the column decoded; null or no ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = [b""] * (1 + max((ranks := load_ranks(vocabulary)).values()))
        for t, rank in ranks.items():
            token[rank] = t
        size = np.fromiter(map(len, token), dtype=np.int64, count=len(token))
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(token), dtype=np.uint8)
        for batch in batches:
            for a, b in blocks(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_pylist(), block_ids):
                part, texts = batch.slice(a, b - a), []
                for ids in part.column(2):
                    ids = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid and len(ids) else np.empty(0, dtype=np.int32)
                    long = size[ids]
                    texts.append(flat[np.arange(long.sum()) + np.repeat(start[ids] - (np.cumsum(long) - long), long)].tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, type=pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)
