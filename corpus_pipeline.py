"""From raw documents to packed training bins, in five stages.

Every stage works on all that the one before it kept; documents travel between stages as Parquet tables in the
shared folder. doc_id names a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import exactdedup, ngramjoin, packing, quality, secrets
from skerry.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that their host repeats too often.

    Exact copies are still in the table, and of each group one is to stay: copies count once, and a line stays with the
    first text that holds it, or whole groups of copies would go. Null and short texts go; rows that repeat stay.
    """
    return quality.clean(docs, copies_once=True, first_keeps=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat id and text, one. A null text equals an empty one.

    Rows meet their owner by one key of id and digest, and rows of one key each other, so whole texts travel once.
    """
    key = lambda i, sha: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("")), sha)
    kept = exactdedup.owners(docs, owner=max).select(key(F.col("keep_id"), F.col("sha256")).alias("__skerry_key"))
    rows = docs.withColumn("__skerry_key", key(F.col("doc_id"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)))
    return rows.join(kept, "__skerry_key", "left_semi").dropDuplicates(["__skerry_key"]).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id, null last: five words, a similarity of 0.8 or more.

    A row is told by its id and the hash of its text: rows that repeat an id with another text each have their own group, and
    of those in one group one stays. Rows that repeat both go or stay together. Texts without words are in no group.
    """
    groups = ngramjoin.grouped(docs.select("doc_id", "text"), n=5, percent=80)
    gone = groups.filter("not is_first").selectExpr("doc_id __skerry_id", "mark __skerry_mark").distinct()
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return docs.join(gone, (mark == F.col("__skerry_mark")) & F.col("doc_id").eqNullSafe(F.col("__skerry_id")), "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; n_chars follows. Nulls stay null."""
    return secrets.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, with their bins. Texts without words, null ones too, have one piece of no words."""
    return packing.pack(packing.measured(docs.select("doc_id", "source", "text")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
#: Packing has no equivalent in SQL; the tests hold all stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
