"""Language ID by compression: the language whose zstandard dictionary makes a text, in lower case, smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample that a dictionary is made of, and of the dictionary.
SAMPLE_ROWS = 2_000
DICTIONARY_BYTES = 64_000
MOST_LANGUAGES = 500
LEVEL = 6
MARGIN = 0.02
PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean, sizes map<string,int>"
LETTER = re.compile(r"[^\W\d_]")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary for each language.

    Of each language about sample_rows rows are candidates by a hash of their text (all, if there are no more); whole
    texts, in the order of that hash, fill dictionary_bytes, which about as many texts do as fit into them: a task holds
    no more of a language than that and its current batch, and of a long text only the start comes into the dictionary.
    Rows with a null or empty text, or a null language, are not used. More than MOST_LANGUAGES languages are an error:
    every task holds a dictionary for each.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text <> '' and lang is not null")
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), sample_rows / F.count("*")).alias("share"))
    if (found := share.count()) > MOST_LANGUAGES:
        raise ValueError(f"{found} languages, at most {MOST_LANGUAGES}")
    picked = rows.join(F.broadcast(share), "lang")  # at most MOST_LANGUAGES rows
    picked = picked.withColumn("h", F.xxhash64("text")).filter(F.pmod("h", F.lit(1_000_003)) < F.col("share") * 1_000_003)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first texts by hash of each language, as many as a dictionary holds."""
        found: dict[str, dict[tuple[int, str], int]] = {}
        for batch in batches:
            for h, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                found.setdefault(lang, {})[h, text] = 0
            for lang, texts in found.items():
                kept, size = {}, 0
                for key in sorted(texts):
                    if size >= dictionary_bytes:
                        break
                    kept[key], size = 0, size + len(key[1].encode("utf-8", "replace"))
                found[lang] = kept
        rows = [(h, lang, text) for lang, texts in found.items() for h, text in texts]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], names=["h", "lang", "text"])

    first = picked.select("h", "lang", "text").mapInArrow(gather, "h long, lang string, text string")
    made: dict[str, bytes] = {}
    for row in first.repartition(1).mapInArrow(gather, "h long, lang string, text string").orderBy("lang", "h", "text").collect():
        made[row.lang] = made.get(row.lang, b"") + row.text.lower().encode("utf-8", "replace") + b"\n"
    return {lang: data[:dictionary_bytes] for lang, data in sorted(made.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN):
        self.margin, self.coders = margin, {}
        for lang, data in dictionaries.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders[lang] = zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, text: str) -> dict[str, int]:
        data = text.lower().encode("utf-8", "replace")
        return {lang: len(coder.compress(data)) for lang, coder in self.coders.items()}

    def predict(self, text: str | None) -> tuple[str, float, bool, dict[str, int]]:
        """Language, score, whether the margin is too narrow, and the compressed sizes. `und` without a letter or a language."""
        if not text or not self.coders or not LETTER.search(text):
            return "und", 0.0, True, {}
        sizes = self.sizes(text)
        (best, least), *others = sorted(sizes.items(), key=lambda x: (x[1], x[0]))
        gap = (others[0][1] - least) / others[0][1] if others else 1.0
        return best, min(1.0, 0.5 + 5 * gap), gap < self.margin, sizes


def classify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """Every row of docs as (doc_id, lang_pred, score, rejected, sizes), from its whole text.

    score: 0.5 for a tie, growing with the gap to the second language. rejected: the gap is below margin (part of the
    second's size); lang_pred still names the smallest. Null texts, and those without a letter, are `und` with score 0.
    Ties go to the first language by name. Repeated rows and ids stay; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries, level, margin)
        for batch in batches:
            lang, score, rejected, sizes = zip(*map(model.predict, batch.column(1).to_pylist())) if batch.num_rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, type=pa.string()), pa.array(score, type=pa.float64()), pa.array(rejected, type=pa.bool_()), pa.array([list(s.items()) for s in sizes], type=pa.map_(pa.string(), pa.int32()))],
                names=["doc_id", "lang_pred", "score", "rejected", "sizes"],
            )

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, PREDICTED)
