"""Views that are kept up to date: postings, and hits of rules, of documents that come in order.

A view is a folder of parts, one for each batch, and of runs: how far the documents were read (the watermark) and for which
rules. A run reads only what its watermark and rules don't cover yet. It writes its part first and then its mark, both
under the number of the batch: a part without a mark isn't read, and a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators.postings import POSTINGS, postings
from skerry.operators.rulematch import HITS, rule_hits
from skerry.sources.files import versions, write_postings

RUN = "batch long, watermark long, rules array<string>"


@dataclass(frozen=True)
class Run:
    batch: int
    watermark: int | None
    rules: tuple[str, ...]


def last_run(spark: SparkSession, path: str, before: int | None = None) -> Run | None:
    """The newest whole run of a view, or the newest before a batch."""
    found = [v for v in versions(spark, f"{path}/runs") if before is None or v < before]
    if not found:
        return None
    row = spark.read.schema(RUN).parquet(f"{path}/runs/version={found[-1]}").first()
    return Run(row.batch, row.watermark, tuple(row.rules))


def finish(spark: SparkSession, path: str, run: Run) -> None:
    spark.createDataFrame([(run.batch, run.watermark, list(run.rules))], RUN).coalesce(1).write.mode("overwrite").parquet(f"{path}/runs/version={run.batch}")


def beyond(docs: DataFrame, watermark: int | None) -> DataFrame:
    """Documents that come after the watermark."""
    return docs if watermark is None else docs.filter(F.col("doc_id") > watermark)


def until(docs: DataFrame, before: int | None) -> int | None:
    """The new watermark once docs have been read."""
    top = docs.agg(F.max("doc_id")).first()[0]
    return top if before is None else max(before, top if top is not None else before)


def parts(spark: SparkSession, path: str, name: str, schema: str, run: Run | None) -> DataFrame:
    """Rows of all batches up to a run; none if there is no run."""
    if run is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch long").parquet(f"{path}/{name}").filter(F.col("batch") <= run.batch).drop("batch")


# postings


def index_more(docs: DataFrame, path: str, batch: int) -> Run:
    """Index the documents beyond the watermark as one more segment, sorted by token."""
    spark, before = docs.sparkSession, last_run(docs.sparkSession, path, batch)
    mark = before.watermark if before else None
    fresh = beyond(docs, mark)
    write_postings(postings(fresh), f"{path}/segments/batch={batch}")
    run = Run(batch, until(fresh, mark), ())
    finish(spark, path, run)
    return run


def index_of(spark: SparkSession, path: str, docs: DataFrame | None = None) -> DataFrame:
    """Postings of all segments; with docs, also of those that aren't indexed yet, which are read for that."""
    run = last_run(spark, path)
    stored = parts(spark, path, "segments", POSTINGS, run)
    return stored if docs is None else stored.unionByName(postings(beyond(docs, run.watermark if run else None)))


# hits of rules


def signature(term: str, scope: str, mode: str) -> str:
    """What a rule's hits depend on; its id doesn't matter."""
    return hashlib.sha1("\0".join((term, scope, mode)).encode()).hexdigest()


def hide_more(docs: DataFrame, rules: list[tuple[str, str, str, str]], path: str, batch: int, deleted: DataFrame | None = None) -> Run:
    """Evaluate rules (id, term, scope, mode): all of them on documents beyond the watermark, new ones on all others.

    deleted: (doc_id) of documents that have gone since; they are kept as marks, and no longer hidden.
    """
    spark, before = docs.sparkSession, last_run(docs.sparkSession, path, batch)
    mark = before.watermark if before else None
    asked = {signature(*r[1:]): r[1:] for r in rules}
    every = [(key, *r) for key, r in asked.items()]
    added = [r for r in every if before and r[0] not in before.rules]
    found = rule_hits(beyond(docs, mark), every)
    if added and mark is not None:
        found = found.unionByName(rule_hits(docs.filter(F.col("doc_id") <= mark), added))
    found.write.mode("overwrite").parquet(f"{path}/hits/batch={batch}")
    gone = spark.createDataFrame([], "doc_id long") if deleted is None else deleted.select(F.col("doc_id").cast("long").alias("doc_id"))
    gone.write.mode("overwrite").parquet(f"{path}/gone/batch={batch}")
    run = Run(batch, until(beyond(docs, mark), mark), tuple(sorted(asked)))
    finish(spark, path, run)
    return run


def hidden_by_rules(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id) of the documents that a rule of the last run hits, without those that are gone."""
    run = last_run(spark, path)
    hits = parts(spark, path, "hits", HITS, run).filter(F.col("rule_id").isin(list(run.rules) if run else []))
    return hits.select("doc_id").distinct().join(parts(spark, path, "gone", "doc_id long", run), "doc_id", "left_anti")


def hits_of_rules(spark: SparkSession, path: str, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(doc_id, rule_id) of the stored hits, under the rules' ids."""
    run = last_run(spark, path)
    names = spark.createDataFrame([(signature(*r[1:]), r[0]) for r in rules] or [], "key string, id string")  # as many as there are rules
    hits = parts(spark, path, "hits", HITS, run).distinct().join(names, F.col("rule_id") == F.col("key"))
    return hits.select("doc_id", F.col("id").alias("rule_id")).join(parts(spark, path, "gone", "doc_id long", run), "doc_id", "left_anti")


def each_batch(step: Callable[[DataFrame, int], object]) -> Callable[[DataFrame, int], None]:
    """step for foreachBatch: a batch is documents that come after all before it, and its number is the run's."""

    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            step(kept, number)
        finally:
            kept.unpersist()

    return run
