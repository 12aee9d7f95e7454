"""Quality rules, with DataFrame functions only.

Rules on a text's own words and lines come first. Then lines are compared across documents: normalised lines
are hashed, the distinct documents that hold a line are counted for each host, and lines above the limit are
removed. A document that keeps too few words is depleted and rejected. Two options are for corpora that still
hold exact copies: to count copies of a text once, and to leave a line with the first text that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import SPACE, materialise, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A line is above the limit in a host from so many distinct texts on, however many texts the host has.
LINE_DOCS = 50
#: A document is depleted if less than this percentage of its words is left.
LEFT_PERCENT = 30


def lines_of(text: Column) -> Column:
    """The \\n-split lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")


def line_hash(line: Column) -> Column:
    """Hash of a line without case and outer white space."""
    return F.xxhash64(F.lower(F.btrim(line, F.lit(SPACE))))


def let(value: Column, body) -> Column:
    """body of a value that is computed once for each row, wherever the optimiser moves the expression to."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_hashes(words: Column) -> Column:
    """Hash of the window of WINDOW words from each word on."""
    starts = F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - (WINDOW - 1)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, WINDOW))))


def repeat_words(hashes: Column) -> Column:
    """Words in windows whose hash is there twice or more. hashes: as window_hashes() gives them."""

    def twice(placed: Column) -> Column:
        again = F.filter(placed, lambda x, k: (x.h == F.get(placed, k - 1).h) | (x.h == F.get(placed, k + 1).h))
        return F.array_sort(F.transform(again, lambda x: x.i))

    def covered(at: Column) -> Column:
        spans = F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda total, n: total + n)

    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeated, let(let(placed, twice), covered)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed. A null text has none of anything."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_word = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        let(window_hashes(w), repeat_words).alias("n_repeat_words"),
    )
    measured = docs.select(
        *docs.columns,
        let(words_of(text), by_word).alias("__skerry_m"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    measured = measured.select(*docs.columns, "__skerry_m.n_words", "__skerry_m.word_chars", "n_symbols", "n_dup_lines", "__skerry_m.n_repeat_words")
    return measured.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, host, text, text_hash); a null host is a host of its own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\0")).alias("host"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def frequent_lines(docs: DataFrame, line_docs: int = LINE_DOCS, copies_once: bool = False, first_keeps: bool = False) -> DataFrame:
    """(host, line, first): lines in at least line_docs documents of a host. docs as keyed() has them.

    Rows of one id are one document, rows without an id are told apart by their text. copies_once: exact copies of a text
    count once. first_keeps: first is the text of the smallest doc_id with the line, else null. The limit is the same
    for hosts of all sizes; partial counts are summed before rows travel.
    """
    lines = docs.select("doc_id", "host", "text_hash", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), line_hash))).alias("line"))
    counted = F.col("text_hash") if copies_once else F.coalesce("doc_id", "text_hash")
    first = F.min_by("text_hash", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))) if first_keeps else F.first(F.lit(None).cast("long"))
    counts = lines.groupBy("host", "line").agg(F.count_distinct(counted).alias("n"), first.alias("first"))
    return counts.filter(F.col("n") >= line_docs).select("host", "line", "first")


def removed_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, host, text_hash, removed_words, bad) of documents that lose lines; bad: hashes of these lines."""
    line = F.transform(lines_of(F.col("text")), lambda x: F.struct(line_hash(x).alias("line"), F.size(words_of(x)).alias("n")))
    lines = docs.select("doc_id", "host", "text_hash", F.posexplode(line).alias("at", "x")).select("doc_id", "host", "text_hash", "at", "x.line", "x.n")
    hit = lines.join(frequent, ["host", "line"]).filter(~F.col("text_hash").eqNullSafe(F.col("first")))
    hit = hit.dropDuplicates(["doc_id", "host", "text_hash", "at"])  # rows that repeat id, host and text
    return hit.groupBy("doc_id", "host", "text_hash").agg(F.sum("n").alias("removed_words"), F.collect_set("line").alias("bad"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, left_percent: float = LEFT_PERCENT, copies_once: bool = False, first_keeps: bool = False) -> DataFrame:
    """Every row of docs as (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept, bad, host, text_hash).

    Null and empty texts have no words and fail the base rules. Rows that repeat id, host and text get the same verdict.
    copies_once and first_keeps: as in frequent_lines(); a text without any id is never the first.
    Other columns are not read; an empty table gives an empty one.
    """
    rows = keyed(docs, id_col, text_col, host_col)
    frequent = materialise(frequent_lines(rows, line_docs, copies_once, first_keeps), "frequent-lines")
    removed = removed_lines(rows, frequent)
    base = measures(rows).drop("text")
    same = (base.doc_id.eqNullSafe(removed.doc_id)) & (base.host == removed.host) & (base.text_hash == removed.text_hash)
    joined = base.join(removed, same, "left").select(base["*"], F.coalesce(removed.removed_words, F.lit(0)).alias("removed_words"), removed.bad)
    left = F.col("n_words") - F.least("n_words", "removed_words")
    return joined.withColumn("kept", ~F.col("base_failed") & (100 * left >= left_percent * F.col("n_words")))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs; lines above the limit are gone from text, and n_chars follows, if docs has it.

    options: those of judge().

    Rows that repeat id, host and text stay repeated. Columns of docs may have any names but those that begin with
    `__skerry_`. An empty table gives an empty one.
    """
    kept = materialise(judge(docs, id_col, text_col, host_col, **options), "quality").filter("kept").dropDuplicates(["doc_id", "host", "text_hash"])
    kept = kept.selectExpr("doc_id __skerry_id", "host __skerry_host", "text_hash __skerry_hash", "bad __skerry_bad")
    id_, own = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    host, digest = F.coalesce(F.col(host_col).cast("string"), F.lit("\0")), F.xxhash64(F.coalesce(own, F.lit("")))
    joined = docs.join(kept, id_.eqNullSafe(F.col("__skerry_id")) & (host == F.col("__skerry_host")) & (digest == F.col("__skerry_hash")))
    stays = F.filter(F.split(own, "\n"), lambda x: ~F.array_contains("__skerry_bad", line_hash(x)))
    text = F.when(F.col("__skerry_bad").isNull(), own).otherwise(F.array_join(stays, "\n"))
    joined = joined.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.char_length(text_col).cast("long"))
    return joined.select(*docs.columns)
