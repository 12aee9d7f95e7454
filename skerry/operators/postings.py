"""The inverted index: postings with positions, and look-ups of words and phrases in it alone.

A posting is (field, token, doc_id, at): `n` for words of the name, `f` for words of the files, `e` for extensions. `at` has the
places of the token among all tokens of the field, ascending, so that phrases need no text. Digits that are cut out of mixed
tokens have a posting without places. Parquet stores the places as differences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.arrow import pieces
from skerry.functions.text import ext_of, norm, tokens

POSTINGS = "field string, token string, doc_id long, at array<int>"
TOKENS_AT_ONCE = 100_000  # of documents whose postings are made together, unless one has more
#: Bytes of letters and digits as they are, all others as spaces.
TOKEN_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_DIGITS, _LETTER = re.compile("[0-9]{3,}"), re.compile("[a-z]")


def located(doc_ids: pa.Array, lists: pa.ListArray, field: str) -> pa.RecordBatch:
    """Postings of one field of some documents, from the lists of their tokens. Single letters, and empty tokens (gaps), have none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    document = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(document)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = lists.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    kept = pc.or_(pc.greater(pc.binary_length(words), 1), pc.match_substring_regex(words, "^[0-9]$")).to_numpy(zero_copy_only=False)
    with_run = np.flatnonzero(pc.match_substring_regex(words, "[0-9]{3}").to_numpy(zero_copy_only=False))  # the few that may be mixed
    cut = {int(i): _DIGITS.findall(w) for i, w in zip(with_run, words.take(pa.array(with_run)).to_pylist()) if _LETTER.search(w)}
    parts = [(document[kept[code]], code[kept[code]], place[kept[code]])] if len(code) else []
    if cut:  # without a place; they come before the places of the same token
        runs = pa.array([run for found in cut.values() for run in found], pa.string()).dictionary_encode()
        place_of = pc.index_in(runs.dictionary, words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place_of < 0)
        place_of[new] = len(words) + np.arange(len(new))
        words, runs = pa.concat_arrays([words, runs.dictionary.take(pa.array(new))]), place_of[runs.indices.to_numpy()]
        each = np.zeros(len(kept), dtype=np.int64)
        each[list(cut)] = [len(found) for found in cut.values()]
        mixed = each[code] > 0
        inside, some = code[mixed], each[code[mixed]]
        at = np.repeat((np.cumsum(each) - each)[inside] - (np.cumsum(some) - some), some) + np.arange(some.sum())
        parts.insert(0, (np.repeat(document[mixed], some), runs[at], np.full(len(at), -1)))
    document, code, place = (np.concatenate(p) for p in zip(*parts)) if parts else [np.empty(0, dtype=np.int64)] * 3
    by_word = np.empty(len(words), dtype=np.int64)  # tokens come in order, so that sorting them later finds long runs
    by_word[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    key = by_word[code] * max(1, len(lists)) + document
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=np.int64)
    real = place >= 0
    ends = np.append(np.cumsum(real)[first - 1] * (first > 0), real.sum()) if len(first) else np.zeros(1, dtype=np.int64)
    columns = [
        pa.array([field]).take(pa.array(np.zeros(len(first), dtype=np.int64))),
        words.take(pa.array(code[order][first])),
        doc_ids.take(pa.array(document[order][first])),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[real], pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in POSTINGS.split(", ")])


def token_lists(folded: pa.Array) -> pa.ListArray:
    """The tokens of folded texts, as tokens() has them; null ones have none."""
    texts = [t or b"" for t in folded.cast(pa.binary()).to_pylist()]
    data = b" ".join([b"", *texts, b""]).translate(TOKEN_BYTES)
    solid = np.frombuffer(data, dtype=np.uint8) != 32
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, size = edges[::2], edges[1::2] - edges[::2]
    ends = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1)
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data.replace(b" ", b"")))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), words)


def in_pieces(lists: pa.ListArray, most: int) -> Iterator[tuple[int, int]]:
    """(first, count) of stretches of lists with at most so many tokens together, or one list of more."""
    upto, start = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()), 0
    while start < len(lists):
        end = max(start + 1, int(np.searchsorted(upto, most + (upto[start - 1] if start else 0), "right")))
        yield start, end - start
        start = end


def _postings(rows: DataFrame) -> DataFrame:
    """Postings of (doc_id, then a column for each field, named like it: folded texts, or lists of tokens). A document's postings are made where it is read."""
    fields = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            for column, field in zip(batch.columns[1:], fields):
                lists = column if pa.types.is_list(column.type) else token_lists(column)
                for piece in in_pieces(lists, TOKENS_AT_ONCE):
                    yield located(batch.column(0).slice(*piece), lists.slice(*piece), field)

    return rows.mapInArrow(run, POSTINGS)


def postings(docs: DataFrame, name: str = "name", files: str = "body") -> DataFrame:
    """Postings of names (n) and bodies (f); null ones have none."""
    return _postings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm(F.col(name)).alias("n"), norm(F.col(files)).alias("f")))


def _posted(word: str) -> str:
    """Pattern of the folded texts that have a posting of a word: it stands there as a token, or as a whole run of digits within one."""
    inside = "0-9" if _DIGITS.fullmatch(word) else "a-z0-9"
    return f"(?<![{inside}]){word}(?![{inside}])"


def word_postings_of(docs: DataFrame, asked: list[str], name: str | None = "name", files: str | None = "body") -> DataFrame:
    """(field, token, doc_id) of a few words, without the rest: what postings() has for them but places, so for words and not for phrases.

    Made without Python and without lists of tokens; a column that is None isn't read.
    """
    known = [w for w in dict.fromkeys(asked) if re.fullmatch("[a-z0-9]+", w) and (len(w) > 1 or w.isdigit())]
    columns = {f: c for f, c in (("n", name), ("f", files)) if c is not None}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(norm(F.col(c)).alias(f) for f, c in columns.items()))
    each = [F.when(F.col(f).rlike(_posted(w)), F.struct(F.lit(f).alias("field"), F.lit(w).alias("token"))) for f in columns for w in known]
    found = F.array_compact(F.array(*each)) if each else F.array().cast("array<struct<field:string,token:string>>")
    return rows.select("doc_id", F.explode(found).alias("p")).select("p.field", "p.token", "doc_id")


def file_words() -> Column:
    """The words of all paths of a document, with a gap after each file."""
    return F.flatten(F.transform("files", lambda f: F.concat(tokens(f.path), F.array(F.lit("")))))


def file_postings_of(items: DataFrame, asked: list[str]) -> DataFrame:
    """Postings of a few words of nested files, without the rest: what file_postings() has with places for them, made without Python."""
    known = [w for w in dict.fromkeys(asked) if len(w) > 1 or w.isdigit()]
    places = lambda w: F.filter(F.transform("words", lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
    each = F.array(*(F.struct(F.lit(w).alias("token"), places(w).alias("at")) for w in known)) if known else F.array().cast("array<struct<token:string,at:array<int>>>")
    rows = items.select(F.col("doc_id").cast("long").alias("doc_id"), file_words().alias("words"))
    found = rows.filter(F.arrays_overlap("words", F.array(*map(F.lit, known)).cast("array<string>"))).select("doc_id", F.explode(each).alias("p"))
    return found.filter(F.size("p.at") > 0).select(F.lit("f").alias("field"), "p.token", "doc_id", "p.at")


def file_postings(items: DataFrame) -> DataFrame:
    """Postings of nested files: words of the paths as `f`, with a gap after each file, and extensions as `e`."""
    exts = F.filter(F.transform("files", lambda f: ext_of(f.path)), lambda e: e != "")
    found = _postings(items.select(F.col("doc_id").cast("long").alias("doc_id"), file_words().alias("f")))
    ends = items.select(F.lit("e").alias("field"), F.explode(F.array_distinct(exts)).alias("token"), F.col("doc_id").cast("long").alias("doc_id"))
    return found.unionByName(ends.withColumn("at", F.array().cast("array<int>")))


def merged_postings(*segments: DataFrame) -> DataFrame:
    """Segments of postings as one, each posting once and a row of its own."""
    every = segments[0]
    for segment in segments[1:]:
        every = every.unionByName(segment)
    return every.dropDuplicates(["field", "token", "doc_id"])


def of_token(index: DataFrame, word: str, scope: str | None = None, prefix: bool = False) -> DataFrame:
    """Postings of a word, or of all that start so."""
    hit = index.filter(F.col("token").startswith(word) if prefix else F.col("token") == word)
    return hit if scope is None else hit.filter(F.col("field") == scope)


def with_token(index: DataFrame, word: str, scope: str | None = None, prefix: bool = False) -> DataFrame:
    """doc_ids to be asked for by a semi or anti join; one that has the word in two fields, or by two words, comes twice."""
    return of_token(index, word, scope, prefix).select("doc_id")


def with_phrase(index: DataFrame, phrase: str, scope: str | None = None) -> DataFrame:
    """doc_ids (once for each field) in which the words of a phrase follow one another, in the name or in one file.

    Postings of the words are joined one after another; what stays are the places where the phrase so far has its last word.
    Single letters are in no posting: a phrase with one is in no document, nor is one without words.
    """
    words = re.findall("[a-z0-9]+", phrase)
    if not words:
        return index.filter(F.lit(False)).select("doc_id")
    found = of_token(index, words[0], scope).select("doc_id", "field", F.col("at").alias("last"))
    for word in words[1:]:
        following = of_token(index, word, scope).select(F.col("doc_id").alias("__doc"), F.col("field").alias("__field"), "at")
        # the document alone is the key, so that postings that are dealt by document needn't travel; a field is its own range
        same = (F.col("doc_id") == F.col("__doc")) & (F.col("field") >= F.col("__field")) & (F.col("field") <= F.col("__field"))
        found = found.join(following, same).select("doc_id", "field", F.array_intersect(F.transform("last", lambda x: x + 1), "at").alias("last")).filter(F.size("last") > 0)
    return found.filter(F.size("last") > 0).select("doc_id")
