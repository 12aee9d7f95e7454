"""Sources and sinks: JSON lines, pattern files, change logs, snapshots, exports and retention."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

#: Bytes of a row group of postings.
ROW_GROUP = 16 << 20
#: Schemes of tracker links.
SCHEMES = ("udp", "http", "https")

HOT = T.StructType(
    [
        T.StructField("ih", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("file_count", T.LongType()),
        T.StructField("seeders", T.LongType()),
        T.StructField("peers", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("indexed_at", T.LongType()),
        T.StructField("files", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType())]))),
    ]
)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, corrupt lines) of JSON lines; a path that isn't there has none of either."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    try:
        lines = spark.read.text(path).filter("value <> ''")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], "value string")
    rows = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return rows.filter("r._corrupt is null").select("r.*").drop("_corrupt"), rows.filter("r._corrupt is not null").select("value")


def whole_json(spark: SparkSession, path: str, schema: T.StructType, aside: str | None = None) -> DataFrame:
    """Records of JSON files of one value each; of files that aren't JSON none. aside: a folder that their texts are kept in."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    rows = texts.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    if aside:
        bad = rows.filter("r is null or r._corrupt is not null").select(F.to_json(F.struct("file", "value")).alias("value"))
        bad.write.mode("append").text(aside)
    return rows.filter("r._corrupt is null").select("r.*").drop("_corrupt")


def placed_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON lines with file, block and line, which order them as they stand in their files; corrupt lines are left out."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = lines.filter("value <> ''").select("file", "block", "line", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return rows.filter("r._corrupt is null").select("file", "block", "line", "r.*").drop("_corrupt")


#: Layouts of change logs: lines of one event each, and whole files that map keys to records.
JOURNAL = "t string, ih string, r struct<name:string,category:string>, s long, p long, a long, g string, n int"


def journal(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Change log events (seq, t, ih, name, category, s, p, a, g, n) of an older catalogue.

    Lines of events are in the order of their files; a whole file is one object from key to record, whose keys are new in
    the order of their names.
    """
    if not whole:
        rows = placed_lines(spark, path, T._parse_datatype_string(JOURNAL))
        return rows.select(F.struct("file", "block", "line").alias("seq"), "t", F.coalesce("ih", F.lit("")).alias("ih"), "r.name", "r.category", "s", "p", "a", "g", "n")
    texts = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<name:string,category:string>>").alias("m"), F.col("_metadata.file_path").alias("file"))
    each = texts.select("file", F.posexplode(F.array_sort(F.transform(F.map_keys("m"), lambda k: F.struct(k.alias("ih"), F.col("m")[k].alias("r"))))).alias("at", "e")).select("file", "at", "e.ih", "e.r")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    return each.select(F.struct("file", F.lit(0).cast("long").alias("block"), F.col("at").cast("long").alias("line")).alias("seq"), F.lit("n").alias("t"), "ih", "r.name", "r.category", none("s", "long"), none("p", "long"), none("a", "long"), none("g", "string"), none("n", "int"))


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """Distinct patterns of a text file, one in each line, without comments and blanks."""
    line = F.btrim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("pattern")).filter("pattern <> ''").distinct()


def trackers(spark: SparkSession, path: str) -> DataFrame:
    return patterns(spark, path).filter(F.substring_index("pattern", "://", 1).isin(*SCHEMES) & F.contains("pattern", F.lit("://")))


def log_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Events of a change log kept as numbered files, with gen, the file's number, to order them by."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("gen", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("long"))


def last_per_key(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key."""
    names = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("r")).select(key, "r.*")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="skerry-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_once(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new folder of work_folder() and read from there: what follows starts from a table, and survives lost executors."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the whole snapshots below a folder; one that a writer left unfinished has no success mark and isn't among them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/version=*/_SUCCESS")) or []
    return sorted(int(m.getPath().getParent().getName().partition("=")[2]) for m in marks)


def snapshot(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest whole snapshot, or None."""
    found = versions(spark, target)
    return spark.read.parquet(f"{target}/version={found[-1]}") if found else None


def compact(spark: SparkSession, events: DataFrame, key: str, order: str, target: str) -> DataFrame:
    """Write the last event of each key, of the newest snapshot and of events, as a new snapshot beside the older ones.

    Readers see the old one until the new one is whole; a job that dies leaves the old one. events may be read from below target.
    """
    before = snapshot(spark, target)
    every = events if before is None else before.unionByName(events)
    number = (versions(spark, target) or [0])[-1] + 1
    last_per_key(every, key, order).repartition(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{target}/version={number}")
    return snapshot(spark, target)


def export(records: DataFrame, path: str, categories: dict[str, str] | None = None) -> None:
    """One JSON record in each line, with categories renamed."""
    if categories:
        renamed = F.col("category")
        for old, new in categories.items():
            renamed = F.when(F.col("category") == old, new).otherwise(renamed)
        records = records.withColumn("category", renamed)
    records.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def storage_report(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of what is stored below a path; only listings are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def write_by_day(points: DataFrame, path: str) -> None:
    """Append points in partitions by day, so that retention drops folders."""
    points.withColumn("day", F.floor(F.col("t") / 86_400)).write.mode("append").partitionBy("day").parquet(path)


def keep_days(spark: SparkSession, path: str, oldest: int) -> DataFrame:
    """Points from a day on; older partitions aren't read."""
    return spark.read.parquet(path).filter(F.col("day") >= oldest)


def write_postings(index: DataFrame, path: str) -> None:
    """Postings as they are made, each task's sorted in a file of its own: nothing is shuffled or made twice, and no task has more than its share.

    Small row groups and the pages' bounds let a look-up read little but its token, in every file; a frequent token lies in all of
    them. Version 2 of Parquet writes places as differences.
    """
    placed = index.sortWithinPartitions("field", "token", "doc_id")
    placed.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", ROW_GROUP).parquet(path)


def multi_get(cold: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The full records of some keys; Spark broadcasts the keys if their size allows it."""
    return cold.join(keys.select(key).distinct(), key, "left_semi")


def newest(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The newest `most` rows of each group."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).drop("rn")


def compact_peers(blob: Column, version: int = 4) -> Column:
    """(ip, port) of records of an address and a port of two bytes; those of port 0 are left out.

    Addresses of version 4 are numbers of four bytes, those of version 6 are 16 bytes. A rest that is no whole record isn't read.
    """
    wide = 4 if version == 4 else 16
    n = F.floor(F.octet_length(blob) / (wide + 2)).cast("int")
    number = lambda at, size: F.conv(F.hex(F.substr(blob, at, F.lit(size))), 16, 10).cast("long")
    address = (lambda at: number(at, 4)) if version == 4 else (lambda at: F.substr(blob, at, F.lit(16)))
    every = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(address(i * (wide + 2) + 1).alias("ip"), number(i * (wide + 2) + 1 + wide, 2).cast("int").alias("port")))
    kind = "bigint" if version == 4 else "binary"
    return F.when(n > 0, F.filter(every, lambda p: p.port > 0)).otherwise(F.array().cast(f"array<struct<ip:{kind},port:int>>"))
