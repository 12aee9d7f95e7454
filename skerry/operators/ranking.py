"""Relevance top-k that reads only the blocks of postings which can still reach the page.

Documents fall into impact classes by what their score has without any word: a tier of their seeders and a class of the length of
their name. There are at most TIERS * LENGTHS classes, however many documents. Postings are stored by (field, token, class): each
such block has a greatest possible score. A first batch of the best blocks gives a threshold; blocks that can't reach it aren't read.
The page is that of the full ranking, ties included.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.text import tokens
from skerry.operators import search as S

TIERS, LENGTHS = 32, 8
#: Scores are rounded to six places, and bounds add up in another order.
SLACK = 2e-6


@dataclass
class Ranked:
    """Stored tables: documents and postings with their class, blocks (field, token, class, n), classes (class, n, shortest, quality)."""

    docs: DataFrame
    index: DataFrame
    blocks: DataFrame
    classes: DataFrame


def quality() -> Column:
    """What seeders add to a score; without a figure, nothing."""
    return F.when(F.col("src") == "scrape", F.coalesce(0.6 * F.log10(1.0 + F.col("seeders")), F.lit(0.0))).otherwise(0.0)


def name_size() -> Column:
    return F.greatest(F.coalesce(F.size(tokens(F.col("name"))), F.lit(1)), F.lit(1))


def length_class(words: int) -> int:
    return sum(words >= 2**p for p in range(1, LENGTHS))


def impact_class() -> Column:
    """A tier of an eighth of a point, and a class for each doubling of the name; the last of each is open."""
    length = sum((F.when(name_size() >= 2**p, 1).otherwise(0) for p in range(1, LENGTHS)), F.lit(0))
    tier = F.least(F.lit(TIERS - 1), F.greatest(F.lit(0), F.floor(quality() * 8)))
    return (tier * LENGTHS + length).cast("int")


def write_ranked(docs: DataFrame, index: DataFrame, path: str, files: int) -> None:
    """Store both by class, and the summaries of their blocks. A document whose seeders or name change is written anew.

    index has postings of docs only. Both tables are cut into ranges that end with the id, so that a frequent word or class has many.
    """
    classed = docs.withColumn("class", impact_class())
    classed.repartitionByRange(files, "class", "doc_id").sortWithinPartitions("class", "doc_id").write.mode("overwrite").parquet(f"{path}/docs")
    kept = docs.sparkSession.read.parquet(f"{path}/docs")
    posted = index.join(kept.select("doc_id", "class"), "doc_id")
    ranged = posted.repartitionByRange(files, "field", "token", "class", "doc_id").sortWithinPartitions("field", "token", "class", "doc_id")
    ranged.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").parquet(f"{path}/index")
    blocks = docs.sparkSession.read.parquet(f"{path}/index").groupBy("field", "token", "class").agg(F.count("*").alias("n"))
    blocks.sort("field", "token", "class").write.mode("overwrite").parquet(f"{path}/blocks")
    summary = kept.groupBy("class").agg(F.count("*").alias("n"), F.min(name_size()).alias("shortest"), F.max(quality()).alias("quality"))
    summary.coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")  # at most TIERS * LENGTHS rows


def read_ranked(spark: SparkSession, path: str) -> Ranked:
    return Ranked(*(spark.read.parquet(f"{path}/{part}") for part in ("docs", "index", "blocks", "classes")))


def block_counts(blocks: DataFrame, words: list[str]) -> dict[tuple[str, str, int], int]:
    """Postings by (word, kind, class): n and f for the word in names and in files, s for other words of names that it starts.

    At most three rows for each word and class.
    """
    found = []
    for w in words:
        hit = blocks.filter(F.col("field").isin("n", "f") & (F.col("token") == w)).select(F.lit(w).alias("word"), F.col("field").alias("kind"), "class", "n")
        found.append(hit)
        if len(w) >= 3:
            longer = blocks.filter((F.col("field") == "n") & F.col("token").startswith(w) & (F.col("token") != w))
            found.append(longer.groupBy("class").agg(F.sum("n").alias("n")).select(F.lit(w).alias("word"), F.lit("s").alias("kind"), "class", "n"))
    every = reduce(DataFrame.unionByName, found)
    return {(r.word, r.kind, r["class"]): r.n for r in every.collect()}


def can_match(counts: dict[tuple[str, str, int], int], group: S.Group, number: int) -> int:
    """How many documents of a class can have all words of a group; phrases, starts and exclusions only make it fewer."""
    kinds = ("n", "f") if group.scope is None else (group.scope,)
    return min((sum(counts.get((w, kind, number), 0) for kind in kinds) for w in group.words), default=-1)


def bound(counts: dict[tuple[str, str, int], int], words: list[str], idf: dict[str, float], row, phrases: Iterable[str], whole: bool) -> float:
    """The greatest score that a document of a class can have by relevance()."""
    number, n = row["class"], max(len(words), 1)
    unknown = [len(w) == 1 and not w.isdigit() for w in words]  # single letters aren't in the index
    exact = [u or (w, "n", number) in counts for w, u in zip(words, unknown)]
    starts = [(w, "s", number) in counts for w in words]
    total = sum(idf[w] * (3.0 if e else 2.0 if s else 1.0) for w, e, s in zip(words, exact, starts))
    total += 2.0 * len(words) / row.shortest + 1.5 * sum(e or s for e, s in zip(exact, starts)) / n
    total += 3.0 if phrases else 0.0
    equal = whole and all(exact) and number % LENGTHS == length_class(len(words))
    return total + (6.0 if equal else 0.0) + row.quality


def ranked(stored: Ranked, search: S.Search, classes: list[int], words: list[str], idf: dict[str, float], now: int, phrases: list[str], whole: bool) -> DataFrame:
    """Matches of some classes with their score."""
    inside = F.col("class").isin(classes)
    found = S.run(stored.docs.filter(inside), stored.index.filter(inside), search, now)
    return found.withColumn("score", F.round(S.relevance(words, idf, phrases, whole), 6))


def plan_classes(stored: Ranked, search: S.Search, words: list[str], idf: dict[str, float], now: int, k: int, phrases: list[str] = (), whole: bool = True) -> tuple[list[int], int]:
    """(classes that must be read for the first k, number of classes). Only counts, and one threshold for each batch, come to the driver.

    Batches take classes by their bound until they can hold 16 k matches, then 16 times as many, until k are found.
    """
    rows = stored.classes.collect()  # at most TIERS * LENGTHS
    asked = list(dict.fromkeys([*words, *(w for g in search.groups for w in g.words)]))
    counts = block_counts(stored.blocks, asked) if asked else {}
    left = []
    for r in rows:
        fits = [can_match(counts, g, r["class"]) for g in search.groups] or [-1]
        most = sum(r.n if x < 0 else min(x, r.n) for x in fits)
        if most:
            left.append((bound(counts, words, idf, r, phrases, whole), r["class"], most))
    left.sort(reverse=True)
    first, room, threshold, at = [], 16 * k, None, 0
    while at < len(left) and threshold is None:
        held = 0
        while at < len(left) and held < room:
            first.append(left[at][1])
            held, at = held + left[at][2], at + 1
        top = ranked(stored, search, first, words, idf, now, phrases, whole).select("score").orderBy(F.col("score").desc()).limit(k)
        got = top.agg(F.count("score").alias("n"), F.min("score").alias("least")).first()
        threshold, room = (got.least if got.n >= k else None), room * 16
    return first + [c for b, c, _ in left[at:] if threshold is not None and b >= threshold - SLACK], len(rows)


def top(stored: Ranked, search: S.Search, words: list[str], idf: dict[str, float], now: int, k: int = 20, phrases: list[str] = (), whole: bool = True) -> DataFrame:
    """The first k documents by score, seeders, date and id, as the full ranking has them; with their score.

    Null names are names without words; a null figure of seeders makes a null score, which comes last. Not for searches by key.
    """
    classes, _ = plan_classes(stored, search, words, idf, now, k, phrases, whole)
    hit = ranked(stored, search, classes, words, idf, now, phrases, whole)
    return hit.orderBy(F.col("score").desc(), F.col("seeders").desc(), F.col("indexed_at").desc(), "doc_id").limit(k)
