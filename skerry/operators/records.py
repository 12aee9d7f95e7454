"""Records of the catalogue: categories and extensions by bytes, defaults at ingest, and the full record of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.functions import numbers as N
from skerry.functions.text import EXT_BITS, LEGACY, answered_trackers, category_of_ext, ext_of, magnet
from skerry.operators.health import due_at, health_state

#: Extensions kept of a document; files, trackers and letters of texts kept of a record.
TOP_EXTS, MOST_FILES, MOST_TRACKERS, LONGEST_COMMENT, LONGEST_MAKER = 8, 5000, 20, 2000, 100


def weight() -> Column:
    """Of a file: its size, or 1 without one."""
    return F.when(F.coalesce(F.col("size"), F.lit(0)) == 0, 1).otherwise(F.col("size"))


def dominant_category(files: DataFrame, *order: str) -> DataFrame:
    """(doc_id, category): the category with most bytes among a document's files (doc_id, path, size); ties go to the
    one whose first file, by order, is first. A file without a size counts as one byte."""
    sums = files.groupBy("doc_id", category_of_ext(ext_of(F.col("path"))).alias("category")).agg(F.sum(weight()).alias("w"), F.min(F.struct(*order)).alias("first"))
    heaviest = F.struct((-F.col("w")).alias("w"), F.col("first"))
    return sums.groupBy("doc_id").agg(F.min_by("category", heaviest).alias("category"))


def top_exts(files: DataFrame, *order: str, most: int = TOP_EXTS) -> DataFrame:
    """(doc_id, exts): a document's extensions with most bytes, heaviest first; ties by the first file in order. Files without one don't count."""
    named = files.withColumn("ext", ext_of(F.col("path"))).filter("ext <> ''")
    sums = named.groupBy("doc_id", "ext").agg(F.sum(weight()).alias("w"), F.min(F.struct(*order)).alias("first"))
    ranked = sums.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("w").desc(), "first"))).filter(F.col("rn") <= most)
    return ranked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "ext"))), lambda x: x.ext).alias("exts"))


def file_summary(files: DataFrame, *order: str) -> DataFrame:
    """(doc_id, category, exts, file_count, size): what dominant_category() and top_exts() give, and the files' number and bytes, in one pass over the files."""
    sums = files.groupBy("doc_id", ext_of(F.col("path")).alias("ext")).agg(F.sum(weight()).alias("w"), F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"), F.sum("size").alias("size"))
    entry = F.struct((-F.col("w")).alias("w"), "first", "ext", category_of_ext(F.col("ext")).alias("category"))
    rows = sums.groupBy("doc_id").agg(F.collect_list(entry).alias("e"), F.sum("n").alias("file_count"), F.sum("size").alias("size"))
    of = lambda c: F.filter("e", lambda x: x.category == c)
    cats = F.transform(F.array_distinct(F.transform("e", lambda x: x.category)), lambda c: F.struct(F.aggregate(of(c), F.lit(0).cast("long"), lambda t, x: t + x.w).alias("w"), F.array_min(F.transform(of(c), lambda x: x["first"])).alias("first"), c.alias("category")))
    exts = F.slice(F.transform(F.array_sort(F.filter("e", lambda x: x.ext != "")), lambda x: x.ext), 1, TOP_EXTS)
    return rows.select("doc_id", F.array_min(cats)["category"].alias("category"), F.when(F.size(exts) > 0, exts).alias("exts"), "file_count", "size")


def composition(files: DataFrame, most: int = TOP_EXTS) -> DataFrame:
    """(doc_id, ext, n, bytes): files and bytes of each extension of a document, of the `most` with most bytes."""
    sums = files.groupBy("doc_id", ext_of(F.col("path")).alias("ext")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    order = Window.partitionBy("doc_id").orderBy(F.col("bytes").desc(), "ext")
    return sums.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).drop("rn")


def ext_mask(exts: Column) -> Column:
    """Bits of the extensions that have one."""
    return N.to_mask(exts, EXT_BITS, wide=True)


def ext_facet(docs: DataFrame, most: int = 14) -> DataFrame:
    """(ext, n): in how many documents the bit of each extension is set; the most frequent first."""
    each = docs.select(F.explode(N.from_mask(F.col("mask"), EXT_BITS)).alias("ext"))
    return each.groupBy("ext").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "ext").limit(most)


def ingested(records: DataFrame) -> DataFrame:
    """Raw records (doc_id, name, files, category, exts, health_src, indexed_at, first_seen, trackers, comment, created_by)
    with what is missing filled in: category and extensions from the files (the name's extension without files), legacy
    as the way of measuring, the time first seen as that of indexing; lists and texts at most as long as a record keeps.
    """
    listed = F.filter(F.transform(F.coalesce("files", F.array()), lambda f, i: F.struct(i.alias("i"), ext_of(f.path).alias("ext"), F.when(F.coalesce(f["size"], F.lit(0)) == 0, 1).otherwise(f["size"]).alias("w"))), lambda x: x.i >= 0)
    rows = records.withColumn("__f", listed)

    def heaviest(values: Column, of) -> Column:
        """Distinct values by their weight, ties by their first file."""
        scored = F.transform(F.array_distinct(values), lambda v: F.struct((-F.aggregate(F.filter("__f", lambda x: of(x) == v), F.lit(0).cast("long"), lambda t, x: t + x.w)).alias("w"), F.array_min(F.transform(F.filter("__f", lambda x: of(x) == v), lambda x: x.i)).alias("i"), v.alias("v")))
        return F.transform(F.array_sort(scored), lambda s: s.v)

    cats = heaviest(F.transform("__f", lambda x: category_of_ext(x.ext)), lambda x: category_of_ext(x.ext))
    exts = heaviest(F.filter(F.transform("__f", lambda x: x.ext), lambda e: e != ""), lambda x: x.ext)
    return rows.withColumns(
        {
            "file_count": F.size("__f").cast("long"),
            "category": F.coalesce("category", F.get(cats, F.lit(0)), category_of_ext(ext_of(F.col("name")))),
            "exts": F.slice(F.coalesce("exts", exts), 1, TOP_EXTS),
            "health_src": F.coalesce("health_src", F.lit("legacy")),
            "indexed_at": F.coalesce("indexed_at", "first_seen"),
            "files": F.slice(F.coalesce("files", F.array()), 1, MOST_FILES),
            "trackers": F.slice(F.coalesce("trackers", F.array().cast("array<string>")), 1, MOST_TRACKERS),
            "comment": F.left(F.coalesce("comment", F.lit("")), F.lit(LONGEST_COMMENT)),
            "created_by": F.left(F.coalesce("created_by", F.lit("")), F.lit(LONGEST_MAKER)),
        }
    ).drop("__f")


def full_records(hot: DataFrame, cold: DataFrame, keys: DataFrame, hidden_by: DataFrame | None = None) -> DataFrame:
    """Everything known of some keys (ih): hot columns, cold record, verdict, next check, pieces, link and what hides it.

    keys are joined first, so that only their records are read; hidden_by: (doc_id, reason).
    """
    rows = hot.filter(~F.col("deleted")).join(keys.select("ih").distinct(), "ih", "left_semi").join(cold, "doc_id", "left")
    state = health_state()
    full = rows.withColumns(
        {
            "state": state,
            "next_check_at": due_at(state, F.col("unk")).cast("long"),
            "num_pieces": N.pieces(F.col("size"), F.col("piece_length")).cast("long"),
            "files_truncated": F.col("file_count") > F.size(F.coalesce("files", F.array())),
            "magnet": magnet(F.col("ih"), F.coalesce("name", "ih"), answered_trackers(F.coalesce(F.col("detail.tr"), F.array()), F.col("trackers"))),
        }
    )
    if hidden_by is None:
        return full.withColumn("hidden_by", F.array().cast("array<string>"))
    reasons = hidden_by.groupBy("doc_id").agg(F.array_sort(F.collect_set("reason")).alias("hidden_by"))
    return full.join(reasons, "doc_id", "left").withColumn("hidden_by", F.coalesce("hidden_by", F.array().cast("array<string>")))


def convert(changes: DataFrame, patterns: list[str]) -> DataFrame:
    """Live records of an older catalogue's change log (ih, seq, t, name, category), without those that a pattern blocks."""
    last = changes.filter("t in ('n', 'd')").groupBy("ih").agg(F.max_by(F.struct("seq", "t", "name", "category"), "seq").alias("r")).filter("r.t = 'n'").select("ih", "r.seq", "r.name", "r.category")
    return last.filter(~F.coalesce("name", F.lit("")).rlike("(?i)(" + "|".join(patterns) + ")")) if patterns else last


def import_plan(changes: DataFrame, here: DataFrame, patterns: list[str]) -> DataFrame:
    """One row of counts: what an import of a change log (seq, ih, t, name, category) into keys that are here would do.

    new, already_present, blocked by a pattern, invalid (no key of 40 hex digits, or no name), health events after new
    records, and categories of new records that get their current name.
    """
    last = changes.filter("t in ('n', 'd')").groupBy("ih").agg(F.max_by(F.struct("seq", "t", "name", "category"), "seq").alias("r")).filter("r.t = 'n'")
    known = here.select(F.col("ih").alias("__here")).distinct()
    rows = last.select("ih", "r.*").withColumn("key", F.lower("ih")).join(known, F.col("key") == F.col("__here"), "left")
    valid = F.col("key").rlike("^[0-9a-f]{40}$") & F.col("name").isNotNull()
    stopped = F.coalesce(F.col("name").rlike("(?i)(" + "|".join(patterns) + ")"), F.lit(False)) if patterns else F.lit(False)
    rows = rows.withColumn("kind", F.when(~valid, "invalid").when(F.col("__here").isNotNull(), "already_present").when(stopped, "blocked").otherwise("new"))
    health = changes.filter("t = 'h'").select(F.col("ih").alias("__ih"), F.col("seq").alias("__seq"))
    after = rows.filter("kind = 'new'").join(health, (F.col("ih") == F.col("__ih")) & (F.col("__seq") > F.col("seq"))).agg(F.count("*").alias("health_events"))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("new", "already_present", "blocked", "invalid")]
    renamed = F.count_if((F.col("kind") == "new") & F.col("category").isin(*LEGACY)).alias("categories_translated")
    return rows.agg(*counts, renamed).join(F.broadcast(after))  # one row each


def undo_files(after: DataFrame, current: DataFrame, backup: DataFrame) -> DataFrame:
    """(name, action, content) for each side file that an import changed, when the import is undone.

    after: (name, sha1) as the import left them. A file that is still so is restored from the backup, or removed if that has none; one
    that was changed or deleted since stays as it is: its action is kept. current, backup: (name, content).
    """
    now = current.select(F.col("name").alias("__now"), F.sha1("content").alias("__sha"))
    old = backup.select(F.col("name").alias("__old"), F.col("content"))
    rows = after.join(now, F.col("name") == F.col("__now"), "left").join(old, F.col("name") == F.col("__old"), "left")
    same = F.col("__sha").eqNullSafe(F.col("sha1"))
    action = F.when(~same, "kept").when(F.col("__old").isNull(), "removed").otherwise("restored")
    return rows.select("name", action.alias("action"), F.when(action == "restored", F.col("content")).alias("content"))
