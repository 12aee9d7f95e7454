"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence has the probability sigmoid(b + sum of its words' weights); a document is toxic if any of its
sentences is: P = 1 - prod(1 - p), noisy-or. Weights are trained from document labels alone by gradient
descent on the log loss of P, and afterwards the sentences with high p show where the offence is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample, in documents.
SAMPLE_ROWS = 8_000
BITS = 18
EPOCHS = 240
SENTENCE = re.compile(rb"[.!?]+[\x20\x09-\x0D]+|\n+")
DROP = bytes(b for b in range(128) if not chr(b).isalnum())
SCORED = "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>"
MEMO_WORDS = 300_000


PREFIXES = (4, 5, 6, 7)  # bytes
LEAST_DOCS = 4  # of the sample, for a feature to count


def slots_of(word: bytes, bits: int = BITS) -> list[int]:
    """Features of a word: hashes of its letters and digits, and of their first bytes; none if it has none."""
    word = word.translate(None, DROP)
    if not word:
        return []
    size = 1 << bits
    return [zlib.crc32(word) % size, *(zlib.crc32(word[:k], k) % size for k in PREFIXES if k <= len(word))]


def sentences(text: str) -> tuple[list[list[bytes]], list[tuple[int, int]]]:
    """Words of each sentence with one, A-Z lower-cased, and its place in the UTF-8 text."""
    data = text.encode("utf-8", "replace").lower()
    words, places, at = [], [], 0
    for cut in [*SENTENCE.finditer(data), None]:
        end = cut.start() if cut else len(data)
        if own := data[at:end].split():
            words.append(own)
            places.append((at, end))
        at = cut.end() if cut else end
    return words, places


def train(texts: list[str], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, rate: float = 0.2, decay: float = 2e-5) -> np.ndarray:
    """Weights by slot, and the bias at the end. Adam over the whole sample in each epoch; sparse counts, no randomness."""
    n_slots = 1 << bits
    slots, words, bags, memo = [], [], [], {}
    docs_with = np.zeros(n_slots, dtype=np.int64)
    for t in texts:
        own, _ = sentences(t)
        bags.append(len(own))
        seen = set()
        for s in own:
            before = len(slots)
            for w in set(s):
                if w not in memo:
                    memo[w] = slots_of(w, bits)
                slots.extend(memo[w])
            words.append(len(slots) - before)
            seen.update(slots[before:])
        docs_with[list(seen)] += 1
    slots, words, bags = np.array(slots, dtype=np.int64), np.array(words, dtype=np.int64), np.array(bags, dtype=np.int64)
    sentence = np.repeat(np.arange(len(words)), words)
    bag = np.repeat(np.arange(len(bags)), bags)
    common = docs_with >= LEAST_DOCS
    slots, sentence = slots[common[slots]], sentence[common[slots]]
    y = labels.astype(float)
    w = np.zeros(n_slots + 1)
    w[-1] = -4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        z = w[-1] + np.bincount(sentence, weights=w[slots], minlength=len(words))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(bag, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(bags)))
        whole = np.clip(1 - none, 1e-7, 1 - 1e-7)
        # d loss / d z of a sentence: (1-y) p - y p (1-P)/P
        grad = p * ((1 - y) - y * (1 - whole) / whole)[bag] / max(1, len(bags))
        g = np.append(np.bincount(slots, weights=grad[sentence], minlength=n_slots), grad.sum())
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from the rows of a bounded sample of (text, label), as pick() bounds it; one task trains.

    Rows with a null label are not used, null texts are empty ones, equal rows count once. Texts are used whole, so the
    task holds as many words as the sample's texts have, however long. Without rows nothing is toxic.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(t or "", y) for b in batches for t, y in zip(*(c.to_pylist() for c in b.columns))})
        weights = train([t for t, _ in rows], np.array([y for _, y in rows]), bits, epochs) if rows else np.append(np.zeros(1 << bits), -4.0)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], type=pa.binary())], names=["weights"])

    rows = labelled.select(F.col(text_col).cast("string"), F.col(label_col).cast("int")).filter(F.col(label_col).isNotNull())
    found = rows.repartition(1).mapInArrow(run, "weights binary").collect()
    return np.frombuffer(found[0].weights) if found else np.append(np.zeros(1 << bits), -4.0)


def pick(labels: DataFrame, id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` of the labelled rows, by a hash of their id; all of them if there are no more."""
    share = min(1.0, rows / max(1, labels.count()))
    return labels if share == 1.0 else labels.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < share * 1_000_003)


class Scorer:
    def __init__(self, weights: np.ndarray, bits: int = BITS):
        self.weights, self.bits, self.memo = weights, bits, {}

    def value(self, word: bytes) -> float:
        return float(sum(self.weights[k] for k in slots_of(word, self.bits)))

    def __call__(self, text: str, least: float) -> tuple[float, list[dict]]:
        words, places = sentences(text)
        if not words:
            return 0.0, []
        memo, z = self.memo, np.empty(len(words))
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for i, own in enumerate(words):
            seen = set(own)
            try:
                z[i] = sum(map(memo.__getitem__, seen))
            except KeyError:
                for w in seen:
                    if w not in memo:
                        memo[w] = self.value(w)
                z[i] = sum(map(memo.__getitem__, seen))
        p = 1 / (1 + np.exp(-np.clip(z + self.weights[-1], -30, 30)))
        score = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
        return float(min(1.0, max(0.0, score))), [{"start": places[i][0], "end": places[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= least)]


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, bits: int = BITS) -> DataFrame:
    """Every row of docs as (doc_id, score, sentences): P of the whole text, and the sentences of at least `least`.

    Sentences are places in the UTF-8 bytes. Null texts, and those without a word, have score 0 and no sentence.
    Repeated rows and ids stay; other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # 2^bits numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value.astype(float), bits)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            found = [scorer(t or "", least) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], type=pa.float64()), pa.array([x for _, x in found], type=kind)], names=["doc_id", "score", "sentences"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCORED)
