"""A model behind moderation: texts are asked in batches, answers are read in any layout, scores follow.

The model is a function of the caller: it gets a list of texts and returns a JSON answer for each. It may call a service, or be a
local one; it runs inside tasks, on batches of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.numbers import score_of_answers
from skerry.functions.text import alternatives, answer_text, verdict_of

BATCH_ROWS, ATTEMPTS = 16, 2
ASKED = "doc_id long, answer string, error string"

Model = Callable[[list[str]], list[str]]


def ask(model: Model, texts: list[str], attempts: int = ATTEMPTS) -> list[tuple[str | None, str | None]]:
    """(answer, error) for each text. A batch that fails is asked again, then in halves, so that one bad text costs no other its answer."""
    problem = ""
    for _ in range(attempts):
        try:
            found = model(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} answers to {len(texts)} texts")
            return [(a, None) for a in found]
        except Exception as e:  # whatever the caller's model raises
            problem = f"{type(e).__name__}: {e}"
    if len(texts) == 1:
        return [(None, problem)]
    half = len(texts) // 2
    return ask(model, texts[:half], attempts) + ask(model, texts[half:], attempts)


def answers(docs: DataFrame, model: Model, text_col: str = "body", id_col: str = "doc_id", batch_rows: int = BATCH_ROWS, attempts: int = ATTEMPTS) -> DataFrame:
    """(doc_id, answer, error) for each row of docs; null texts are asked as empty ones, and rows stay as many as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                found = ask(model, [t or "" for t in part.column(1).to_pylist()], attempts)
                answer, error = zip(*found)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(answer, pa.string()), pa.array(error, pa.string())], names=["doc_id", "answer", "error"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ASKED)


def scored(found: DataFrame) -> DataFrame:
    """(doc_id, label, score, done, failed) of answers: the label that stands first in the text, 0 to 1 from the alternatives of its first token or, where these
    carry too little mass, from the label. An answer that neither can be read from has failed, like one that never came."""
    rows = found.withColumns({"a": alternatives(F.col("answer")), "label": verdict_of(F.split(F.btrim(answer_text(F.col("answer"))), r"\s+")[0])})
    score = score_of_answers(F.coalesce("a", F.array().cast("array<struct<token:string,logprob:double>>")), F.col("label"))
    rows = rows.withColumn("score", F.when(F.col("answer").isNotNull(), score))
    return rows.select("doc_id", "label", "score", F.col("score").isNotNull().alias("done"), F.col("score").isNull().alias("failed"))
