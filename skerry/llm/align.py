"""Cross-tokenizer alignment: where the tokens of two vocabularies end at the same byte.

Documents are encoded by both tokenizers, A and B. A block of them is one stretch of bytes: the ends of all A tokens
and of all B tokens are counted once for each byte, and the block is cut where both occur. Prefix sums over the cuts,
read at the documents' ends, give each document's groups. An A and a B token are linked if their bytes share a group.

Counts of linked id pairs over the corpus need no row for each document and pair: a block numbers its distinct pairs,
its documents name these numbers, and only the blocks' pairs are shuffled to be summed, and back.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.bpe import blocks
from skerry.llm.common import materialise

BLOCK_BYTES = 2_000_000
CHUNK_CHARS = 200_000  # of words that a library encodes in one call
MEMO_WORDS, MEMO_CHARS = 400_000, 64
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, block string, "
    "pair_at array<int>, pair_times array<int>, block_pairs array<struct<a:int,b:int,docs:int>>"
)
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"

_loaded: dict[tuple[str, str], "Encoders"] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character by which byte-level vocabularies write each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ..., count[i] of them, for all i, end to end."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


class Side:
    """One tokenizer: how it encodes a text that starts with a space, and the bytes of its tokens."""

    def __init__(self, tokens: list[bytes], encode, apart: bool):
        """encode gets a text without its leading space; apart: no token holds a space after another character."""
        self.encode, self.apart, self.tokens = encode, apart, tokens
        self.sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self.starts, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return self.flat[spread(self.starts[ids], self.sizes[ids])].tobytes()


def byte_level(path: str) -> Side:
    """A byte-level vocabulary of the tokenizers library; special tokens' strings are plain text."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(path, encoding="utf-8") as f:
        library = Tokenizer.from_str(f.read())
    library.encode_special_tokens = True
    alphabet, tokens = byte_alphabet(), [b""] * library.get_vocab_size()
    for token, i in library.get_vocab().items():
        tokens[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    splitter = json.loads(library.to_str())["pre_tokenizer"] or {}
    apart = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True)
    return Side(tokens, lambda text: library.encode(f" {text}", add_special_tokens=False).ids, apart)


def pieces(path: str) -> Side:
    """A sentencepiece vocabulary that adds the leading space itself."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return Side(tokens, lambda text: library.encode(text, num_threads=1), not any("▁" in p.lstrip("▁") for p in names))


class Encoders:
    """Both sides, with a memo from words to their ids. A word ends before each space that follows another character than
    white space; neither side has a token across such a place, so words can be encoded apart. If one has, a text is one word."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = byte_level(a_path), pieces(b_path)
        self.apart = all(s.apart for s in self.sides)
        self.forget()

    @classmethod
    def of(cls, a_path: str, b_path: str) -> "Encoders":
        """One for each worker process and pair of vocabularies."""
        if (a_path, b_path) not in _loaded:
            _loaded[a_path, b_path] = cls(a_path, b_path)
        return _loaded[a_path, b_path]

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids = [np.empty(0, dtype=np.int32)] * 2
        self.counts = [np.empty(0, dtype=np.int64)] * 2
        self.exact = np.empty(0, dtype=bool)

    def words(self, text: str) -> list[str]:
        """Words without their leading space."""
        if not self.apart:
            return [text]
        if _SPACED.search(text):
            return _PLACES.split(text)
        return text.split(" ")

    def encoded(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of both sides end to end, ids of each word, and whether a word's tokens give its bytes again.

        Many words are one call, as a text of words; if its tokens don't give its bytes, each is one.
        """
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        text = " ".join(words)
        raw, ids, counts = b" " + text.encode(), [], []
        for side in self.sides:
            own = np.array(side.encode(text), dtype=np.int32)
            if side.joined(own) != raw:
                break
            token_ends = np.cumsum(side.sizes[own])
            at = np.searchsorted(token_ends, ends)
            if (token_ends[at] != ends).any():
                break
            ids.append(own)
            counts.append(np.diff(at + 1, prepend=0))
        else:
            return ids, counts, np.ones(len(words), dtype=bool)
        if len(words) == 1:
            return [np.empty(0, dtype=np.int32)] * 2, [np.zeros(1, dtype=np.int64)] * 2, np.zeros(1, dtype=bool)
        parts = [self.encoded([w]) for w in words]
        return [np.concatenate([p[0][k] for p in parts]) for k in (0, 1)], [np.concatenate([p[1][k] for p in parts]) for k in (0, 1)], np.concatenate([p[2] for p in parts])

    def learn(self, words: list[str]) -> None:
        """Put words into the memo. Those that end in white space, or are nothing but their space, end a text: no word may follow them."""
        last = [w for w in words if not w or w[-1].isspace()]
        words = [w for w in words if w and not w[-1].isspace()]
        found = [self.encoded(words[a:b]) for a, b in blocks(list(map(len, words)), CHUNK_CHARS)]
        for w in last:
            ids, (a, b), exact = self.encoded(["a", w])
            found.append(([ids[0][a[0] :], ids[1][b[0] :]], [a[1:], b[1:]], exact[1:]))
        words += last
        ids, counts, exact = zip((self.ids, self.counts, self.exact), *found)
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words))))
        self.ids = [np.concatenate([p[k] for p in ids]) for k in (0, 1)]
        self.counts = [np.concatenate([p[k] for p in counts]) for k in (0, 1)]
        self.exact = np.concatenate(exact)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of both sides of all texts, end to end, and the bytes of each text that they cover: 0 where its bytes don't come again.

        Empty texts have no tokens.
        """
        cut = [self.words(t) if t else [] for t in texts]
        fresh = set().union(*cut)
        unknown = fresh.difference(self.memo)
        if len(self.memo) + len(unknown) > MEMO_WORDS:
            self.forget()
            unknown = fresh
        self.learn(sorted(unknown))
        lengths = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        at = np.fromiter((self.memo[w] for words in cut for w in words), dtype=np.int64, count=int(lengths.sum()))
        text = np.repeat(np.arange(len(cut)), lengths)
        odd = np.bincount(text[~self.exact[at]], minlength=len(cut)) > 0
        at = at[~odd[text]]
        out = [ids[spread((np.cumsum(n) - n)[at], n[at])] for ids, n in zip(self.ids, self.counts)]
        if any(len(w) > MEMO_CHARS for w in unknown) or len(self.memo) > MEMO_WORDS:
            self.keep_short()
        return out, np.array([len(t.encode()) + 1 if t and not o else 0 for t, o in zip(texts, odd)], dtype=np.int64)

    def keep_short(self) -> None:
        """Long words leave the memo, and all do if there are too many."""
        words = [w for w in self.memo if len(w) <= MEMO_CHARS]
        if len(words) > MEMO_WORDS:
            return self.forget()
        at = np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))
        self.ids = [ids[spread((np.cumsum(n) - n)[at], n[at])] for ids, n in zip(self.ids, self.counts)]
        self.counts, self.exact = [n[at] for n in self.counts], self.exact[at]
        self.memo = dict(zip(words, range(len(words))))


_SPACED = re.compile(r"^ |\s ")
_PLACES = re.compile(r"(?<=\S) ")
#: Decimal digits of ids, eight bytes for each; no vocabulary has ids of more than seven digits.
_DIGITS = 8


def digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, padded to eight bytes each, and how many there are."""
    names = [str(i).encode() for i in range(n)]
    return np.frombuffer(b"".join(s.ljust(_DIGITS) for s in names), dtype=np.uint8).reshape(n, _DIGITS), np.fromiter(map(len, names), dtype=np.int64, count=n)


class Groups:
    """The groups of a block of texts. a, b: ids of both sides; long: the bytes of each text, 0 for those without tokens."""

    def __init__(self, sides: tuple[Side, Side], a: np.ndarray, b: np.ndarray, long: np.ndarray):
        self.a, self.b = a, b
        a_ends, b_ends = np.cumsum(sides[0].sizes[a]), np.cumsum(sides[1].sizes[b])
        n = int(long.sum()) + 1
        cuts = np.flatnonzero((np.bincount(a_ends, minlength=n) > 0) & (np.bincount(b_ends, minlength=n) > 0))
        self.n_a, self.n_b = np.diff(np.searchsorted(a_ends, cuts, "right"), prepend=0), np.diff(np.searchsorted(b_ends, cuts, "right"), prepend=0)
        at = np.searchsorted(cuts, np.cumsum(long), "right")  # groups before each text's end
        self.per_text = np.diff(at, prepend=0)
        self.text = np.repeat(np.arange(len(long)), self.per_text)
        self.at = at

    def sums(self, of_group: np.ndarray) -> np.ndarray:
        """Sum for each text, by prefix sums."""
        running = np.append(0, np.cumsum(of_group))
        return running[self.at] - running[self.at - self.per_text]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and A id << 32 | B id of every link."""
        times = np.repeat(self.n_b, self.n_a)  # partners of each A token
        partners = spread(np.repeat(np.cumsum(self.n_b) - self.n_b, self.n_a), times)
        pairs = np.repeat(self.a.astype(np.int64), times) << 32 | self.b[partners]
        return np.repeat(np.repeat(self.text, self.n_a), times), pairs

    def written(self, tables: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
        """Each text's groups as a1,a2|b1;a3|b2,b3."""
        if not len(self.a):
            return [b""] * len(self.at)
        a_before, b_before = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        group_a, group_b = np.repeat(np.arange(len(self.n_a)), self.n_a), np.repeat(np.arange(len(self.n_b)), self.n_b)
        places = np.arange(len(self.a)) + b_before[group_a], np.arange(len(self.b)) + (a_before + self.n_a)[group_b]
        n = len(self.a) + len(self.b)
        cells, sizes = np.empty((n, _DIGITS), dtype=np.uint8), np.empty(n, dtype=np.int64)
        marks = np.full(n, ord(","), dtype=np.uint8)
        for ids, place, (table, size) in zip((self.a, self.b), places, tables):
            cells[place], sizes[place] = table[ids], size[ids]
        marks[places[0][a_before + self.n_a - 1]] = ord("|")
        marks[places[1][b_before + self.n_b - 1]] = ord(";")
        cells[np.arange(n), sizes] = marks
        flat = cells[np.arange(_DIGITS) <= sizes[:, None]].tobytes()
        bytes_before = np.append(0, np.cumsum(sizes + 1))
        tokens_before = np.append(0, np.cumsum(self.n_a + self.n_b))
        until = bytes_before[tokens_before[self.at]]
        since = bytes_before[tokens_before[self.at - self.per_text]]
        return [flat[s : max(s, e - 1)] for s, e in zip(since.tolist(), until.tolist())]


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), type=pa.int32()), pa.array(values, type=pa.int32()))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: counts of tokens, groups and links, the groups themselves (a1,a2|b1;a3|b2,b3), and
    what count() needs: the block, the document's distinct pairs as numbers of its block's pairs with how often each is
    linked, and, in the block's first row, these pairs with the number of the block's documents that have them.

    Texts that are null, empty, or not what their A or B tokens say byte by byte have no tokens: counts of 0 and no groups.
    Repeated rows and ids stay as they are; other columns are not read; an empty table gives an empty one. The files
    are there on every executor. A task holds a block of about block_bytes, or one longer text: some 100 bytes for each of its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Encoders.of(a_path, b_path)
        tables = [digits(len(s.tokens)) for s in coders.sides]
        number = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, end in blocks(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), block_bytes):
                (a, b), long = coders.encode([t or "" for t in texts.slice(start, end - start).to_pylist()])
                found = Groups(coders.sides, a, b, long)
                rows = end - start
                text, pairs = found.links()
                distinct, which = np.unique(pairs, return_inverse=True)
                keys, times = np.unique(text * max(1, len(distinct)) + which, return_counts=True)
                owner, pair_at = np.divmod(keys, max(1, len(distinct)))
                held = pa.StructArray.from_arrays(
                    [pa.array(c, type=pa.int32()) for c in (distinct >> 32, distinct & 0xFFFFFFFF, np.bincount(pair_at, minlength=len(distinct)))],
                    names=["a", "b", "docs"],
                )
                columns = {
                    "doc_id": ids.slice(start, rows),
                    "n_a": pa.array(found.sums(found.n_a)),
                    "n_b": pa.array(found.sums(found.n_b)),
                    "n_groups": pa.array(found.per_text),
                    "n_links": pa.array(found.sums(found.n_a * found.n_b)),
                    "groups": pa.array(found.written(tables), type=pa.binary()).cast(pa.string()),
                    "block": pa.array([f"{TaskContext.get().partitionId()}-{number}"] * rows),
                    "pair_at": lists(pair_at, np.bincount(owner, minlength=rows)),
                    "pair_times": lists(times, np.bincount(owner, minlength=rows)),
                    "block_pairs": pa.ListArray.from_arrays(pa.array([0] + [len(distinct)] * rows, type=pa.int32()), held),
                }
                number += 1
                yield pa.RecordBatch.from_pydict(columns)

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, ALIGNED)


def count(aligned: DataFrame, more: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds to rows of align() what the corpus says of their links: n_best, those whose count is the highest of their A id, and
    count_sum, the sum of their counts. A pair's count is the number of documents that have it linked.

    more: string columns that stay. aligned is written once, as blocks are numbered by task and read twice. A pair comes once for each block,
    and an A id has at most as many pairs as B has ids, so that no key is large.
    """
    kept = materialise(aligned.select(*[c.split()[0] for c in COUNTED.split(", ")[:5]], *more, "block", "pair_at", "pair_times", "block_pairs"), "aligned")
    rows = kept.filter(F.size("block_pairs") > 0).select("block", F.posexplode("block_pairs").alias("at", "pair")).select("block", "at", "pair.a", "pair.b", "pair.docs")
    totals = rows.groupBy("a", "b").agg(F.sum("docs").alias("total"))
    best = totals.groupBy("a").agg(F.max("total").alias("best"))
    known = totals.join(best, "a").select("a", "b", "total", (F.col("total") == F.col("best")).alias("is_best"))
    answers = rows.join(known, ["a", "b"]).select(F.col("block").alias("of_block"), "at", "total", "is_best")

    def merged(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        total, best = np.zeros(len(answers), dtype=np.int64), np.zeros(len(answers), dtype=np.int64)
        at = answers.column("at").to_numpy()
        total[at], best[at] = answers.column("total").to_numpy(), answers.column("is_best").to_numpy()
        sizes = np.array(pc.list_value_length(docs.column("pair_at")).to_pylist(), dtype=np.int64)
        ends = np.cumsum(sizes)
        which = pc.list_flatten(docs.column("pair_at")).to_numpy()
        times = pc.list_flatten(docs.column("pair_times")).to_numpy()
        sums = [np.append(0, np.cumsum(times * of[which]))[[ends, ends - sizes]] for of in (best, total)]
        out = docs.select([c for c in docs.column_names if c in names])
        for name, s in zip(("n_best", "count_sum"), sums):
            out = out.append_column(name, pa.array(s[0] - s[1], type=pa.int64()))
        return out.select(names)

    schema = ", ".join([COUNTED, *(f"{c} string" for c in more)])
    names = [c.split()[0] for c in schema.split(", ")]
    docs = kept.drop("block_pairs").groupBy("block")
    return docs.cogroup(answers.groupBy("of_block")).applyInArrow(merged, schema)
