"""Mixing sources to target weights by pivotal rounding.

A source's target over its size is how often each of its documents is taken on average. The whole part is certain; the
fraction is rounded to a copy more or none. Two fractions of a source meet: words are moved from one to the other, in a
random direction whose odds keep both averages, until one of the two is whole. What is taken of the two together stays as
it was, so that at the end one fraction is left in each source. Documents are dealt to buckets by hash; a task leaves one
fraction for each bucket and source, and these are combined by a tree of FAN buckets at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.llm.common import materialise, n_parts, word_count

LIMIT = 3  # times its size that a source, and a document, is taken at most
BUCKET_ROWS = 4_000
FAN = 32
WEIGHTS = (1, 2, 3)
_MASK = (1 << 64) - 1


def ranked(names: DataFrame) -> DataFrame:
    """Adds rank, from 0, by code point, null last. names: distinct (source). Ranges of names count for themselves and are then shifted."""
    spark = names.sparkSession
    dealt = materialise(names.repartitionByRange(n_parts(spark), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    shift = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shifts = dealt.groupBy("part").count().select(F.col("part").alias("of"), F.coalesce(F.sum("count").over(shift), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("own", own).join(shifts, F.col("part") == F.col("of")).select(*names.columns, (F.col("own") - 1 + F.col("before")).alias("rank"))


def cycle(weights: tuple[int, ...]) -> Column:
    """Weight of a source by its rank: the given ones in turn."""
    return F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Adds rank and target to distinct sources (source, source_size): the sum of all sizes in shares of the weights, but never more than limit
    times a source's size; what is over goes to the others by weight, until none is above.

    Every round of resharing reads two sums from the sources' table. Null is a source of its own, the last.
    """
    known = materialise(ranked(sizes).withColumn("weight", cycle(weights)).withColumn("most", F.col("source_size") * limit), "weights")
    total = known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, full = 0.0, -1
    while True:
        row = known.agg(
            F.count_if(F.col("weight") * share >= F.col("most")).alias("n"),
            F.sum(F.when(F.col("weight") * share >= F.col("most"), F.col("most")).otherwise(0)).alias("most"),
            F.sum(F.when(F.col("weight") * share >= F.col("most"), 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if row.n == full or not row.weight:
            break
        full, share = row.n, (total - row.most) / row.weight
    return known.select("source", "rank", "source_size", F.when(F.col("weight") * share >= F.col("most"), F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(share)).alias("target"))


def chance(a: int, b: int) -> float:
    """A number from [0, 1) that two rows' random keys decide."""
    x = (a * 0x9E3779B97F4A7C15 ^ b) & _MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return ((x ^ x >> 31) >> 11) / (1 << 53)


def meet(size: int, p: float, other: int, q: float, u: float) -> tuple[float, float]:
    """Fractions p of size and q of other after a transfer that keeps size * p + other * q; one of them is 0 or 1 then.

    u in [0, 1) decides the direction so that both fractions stay the same on average.
    """
    up, down = min((1 - p) * size, q * other), min(p * size, (1 - q) * other)
    if u * (up + down) < down:  # towards p
        return (1.0, q - up / other) if up == (1 - p) * size else (p + up / size, 0.0)
    return (0.0, q + down / other) if down == p * size else (p - down / size, 1.0)


def settle(rows: DataFrame) -> DataFrame:
    """rows: (grp, rank, size, bucket, seq, key, p), 0 < p < 1; rank is the source's. Rows of one grp and source meet one after another, longest first; at most one keeps a fraction."""
    schema = rows.select("grp", "rank", "size", "bucket", "seq", "key", "p").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        arrow, left = None, None
        for batch in batches:
            arrow, done = arrow or batch.schema, []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                row = list(row)
                if left is None or left[:2] != row[:2]:
                    if left is not None:
                        done.append(left)
                    left = row
                    continue
                left[6], row[6] = meet(left[2], left[6], row[2], row[6], chance(left[5], row[5]))
                if 0 < row[6] < 1:
                    left, row = row, left
                done.append(row)
                if not 0 < left[6] < 1:
                    done.append(left)
                    left = None
            if done:
                yield batch_of(done)
        if left is not None:
            yield batch_of([left])

    order = ["grp", "rank", F.col("size").desc(), "key", "bucket", "seq"]
    return rows.select(schema.names).repartition(n_parts(rows.sparkSession), "grp", "rank").sortWithinPartitions(*order).mapInArrow(run, schema)


def rounded(fractions: DataFrame, fan: int = FAN) -> DataFrame:
    """(bucket, rank, seq, copy) for rows (bucket, rank, size, seq, key, p), 0 < p < 1: copy is 0 or 1.

    rank is the source's; with bucket and seq it names a row. The last fraction of a source goes to the nearer whole number.
    """
    done, rest = [], fractions.withColumn("grp", F.col("bucket"))
    while True:
        level = materialise(settle(rest), "settled")
        done.append(level.filter("p <= 0 or p >= 1"))
        rest = level.filter("p > 0 and p < 1")
        if not (row := rest.agg(F.max("grp")).first())[0]:  # one group is left, or no fraction
            break
        rest = rest.withColumn("grp", F.floor(F.col("grp") / fan))
    done.append(rest.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.select("bucket", "rank", "seq", F.col("p").cast("long").alias("copy"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, fan: int = FAN) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs.

    size counts the words of the whole text, none if it is null; taken is copies times size, and copies is the source's
    target over its size, rounded up or down, so at most limit. A source's taken words are its target but for half of one
    document. A row without words has its source's rate, rounded down, as copies. Null sources are one source, the last; null and
    repeated ids are rows like others; rows that are alike in all are rounded one by one. The same table gives the same
    rows, whatever its partitions are. Other columns are not read; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), key.alias("key"))
    rows = materialise(read, "sizes")
    known = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit), "targets")
    buckets = max(1, -(-rows.count() // bucket_rows))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = rows.join(known.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    rated = rated.withColumns({"whole": F.floor("rate").cast("long"), "p": F.col("rate") - F.floor("rate"), "bucket": F.pmod(F.xxhash64(F.lit("bucket"), "key"), F.lit(buckets))})
    seq = F.row_number().over(Window.partitionBy("bucket", "rank").orderBy("key", "doc_id"))  # names a row of a bucket and source
    rated = materialise(rated.withColumn("seq", seq).drop("of", "rate"), "rated")
    copies = rounded(rated.filter("p > 0 and size > 0"), fan)
    at = [F.col(c) == F.col(f"{c}_of") for c in ("bucket", "rank", "seq")]
    whole = rated.join(copies.withColumnsRenamed({c: f"{c}_of" for c in ("bucket", "rank", "seq")}), at, "left")
    whole = whole.withColumn("copies", F.col("whole") + F.coalesce("copy", F.lit(0)))
    return whole.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
