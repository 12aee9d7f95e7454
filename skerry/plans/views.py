"""The catalogue roles of the tables, as DataFrames and as the same in SQL.

NOW is the time that ages are measured from; it is a parameter of every operator that needs one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_706_700_000
#: What files of an order are ordered by.
FILE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, copies: int = 1) -> DataFrame:
    """Catalogue documents: the first line is the name, the whole text is the one file's text. copies: of each, under ids of their own."""
    d = table(spark, sf_dir, "documents")
    if copies > 1:
        d = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("doc_id", F.col("doc_id") * copies + F.col("copy"))
    i = F.col("doc_id")
    return d.select(
        "doc_id",
        F.sha1(i.cast("string").cast("binary")).alias("ih"),
        F.substring_index("text", "\n", 1).alias("name"),
        F.col("text").alias("body"),
        F.col("lang").alias("category"),
        "source",
        F.col("n_chars").alias("size"),
        F.when(i % 7 == 3, 0).otherwise(i * 7919 % 500).alias("seeders"),
        F.when(i % 14 == 3, 0).otherwise(i * 104729 % 300).alias("peers"),
        (1 + i % 40).alias("file_count"),
        F.when(i % 3 == 0, "scrape").when(i % 3 == 1, "swarm").otherwise("none").alias("src"),
        (NOW - i * 3571 % 40_000_000).alias("indexed_at"),
        (i % 50 == 49).alias("deleted"),
        (i % 31 == 7).alias("hidden"),
        (i % 4 == 1).alias("dead"),
        (1_600_000_000 + i * 997 % 50_000).alias("created"),
    )


DOCS = f"""docs AS (
  SELECT doc_id, sha1(CAST(doc_id AS VARCHAR)) AS ih, string_split(text, chr(10))[1] AS name, text AS body, lang AS category, source, n_chars AS size,
         CASE WHEN doc_id % 7 = 3 THEN 0 ELSE doc_id * 7919 % 500 END AS seeders, CASE WHEN doc_id % 14 = 3 THEN 0 ELSE doc_id * 104729 % 300 END AS peers, 1 + doc_id % 40 AS file_count,
         CASE doc_id % 3 WHEN 0 THEN 'scrape' WHEN 1 THEN 'swarm' ELSE 'none' END AS src, {NOW} - doc_id * 3571 % 40000000 AS indexed_at,
         doc_id % 50 = 49 AS deleted, doc_id % 31 = 7 AS hidden, doc_id % 4 = 1 AS dead, 1600000000 + doc_id * 997 % 50000 AS created FROM documents
), live AS (SELECT * FROM docs WHERE NOT deleted AND NOT hidden),
toks AS (SELECT *, regexp_extract_all(lower(strip_accents(name)), '[a-z0-9]+') AS nt, regexp_extract_all(lower(strip_accents(body)), '[a-z0-9]+') AS ft FROM docs)"""


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each file, with what the files of an order are ordered by, its path and its size."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    path = F.concat(F.lit("order"), F.col("l_orderkey"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), F.lower(F.replace("p_type", F.lit(" "), F.lit(""))))
    return line.select("l_orderkey", *FILE_ORDER, path.alias("path"), F.col("l_extendedprice").cast("long").alias("size"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with nested files: orders with their lines. files has a path and a size for each line."""
    entry = F.struct(*FILE_ORDER, "path", "size")
    files = file_rows(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("f"))
    o = table(spark, sf_dir, "orders").join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    listed = F.coalesce(F.transform("f", lambda x: F.struct(x.path.alias("path"), x["size"].alias("size"))), F.array().cast("array<struct<path:string,size:bigint>>"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("ih"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("indexed_at"), listed.alias("files"))


#: One row for each file, at its place in the document.
FILES = """files AS (
  SELECT l_orderkey AS doc_id, 'order' || l_orderkey || '/' || replace(p_name, ' ', '.') || '.' || lower(replace(p_type, ' ', '')) AS path, CAST(trunc(l_extendedprice) AS BIGINT) AS size,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS pos
  FROM lineitem JOIN part ON l_partkey = p_partkey
), named AS (SELECT *, string_split(path, '/')[-1] AS base, substr(string_split(string_split(path, '/')[-1], '.')[-1], 1, 8) AS ext FROM files)"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health measurements: events of a user are the measurements of a key.

    Every tenth key is found empty by scrapes alone (by two trackers or more), another tenth by one tracker.
    """
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    empty, one = F.col("user_id") % 10 == 3, F.col("user_id") % 10 == 4
    zero = empty | one
    return e.select(
        F.col("user_id").alias("ih"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("mt"),
        F.when(zero | F.col("event_type").isin("view", "signup"), "scrape").otherwise("swarm").alias("src"),
        F.when(zero, 0).otherwise(F.floor(F.col("value") / 10) - 2).cast("long").alias("seeders"),
        F.when(zero, 0).otherwise(k).alias("peers"),
        F.when(empty, 2 + k % 3).when(one, 1).otherwise(k % 5).alias("nrep"),
        F.when(zero, 0).otherwise(k % 4).alias("cs"),
        "event_id",
    )


MEASUREMENTS = """kinds AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id % 10 = 3 AS empty, user_id % 10 = 4 AS one FROM events),
meas AS (
  SELECT user_id AS ih, CAST(floor(epoch(ts)) AS BIGINT) AS mt, CASE WHEN empty OR one OR event_type IN ('view', 'signup') THEN 'scrape' ELSE 'swarm' END AS src,
         CASE WHEN empty OR one THEN 0 ELSE CAST(floor(value / 10) AS BIGINT) - 2 END AS seeders, CASE WHEN empty OR one THEN 0 ELSE k END AS peers,
         CASE WHEN empty THEN 2 + k % 3 WHEN one THEN 1 ELSE k % 5 END AS nrep, CASE WHEN empty OR one THEN 0 ELSE k % 4 END AS cs, event_id FROM kinds
)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a time series: a gauge, two counters of one series."""
    e = table(spark, sf_dir, "events")
    return e.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("gauge"), F.col("event_id").alias("counter"), "event_type", "event_id")


METRICS = "metrics AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t, CASE WHEN event_id % 11 <> 0 THEN value END AS gauge, event_id AS counter, event_type, event_id FROM events)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peer observations, with addresses of the block for benchmarks."""
    return observed(table(spark, sf_dir, "lineitem"))


def observed(line: DataFrame) -> DataFrame:
    """Lines of orders as observations; a table or a stream."""
    return line.select(
        F.col("l_orderkey").alias("ih"),
        (F.lit(3_323_068_416).cast("long") + F.col("l_suppkey")).alias("ip"),
        (1024 + F.col("l_partkey") % 60_000).alias("port"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).otherwise(-1).alias("role"),
        F.when(F.col("l_linestatus") == "O", "client-o").otherwise("").alias("client"),
        F.when(F.col("l_linenumber") % 3 == 0, "c").when(F.col("l_linenumber") % 3 == 1, "d").otherwise("a").alias("src"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ts"),
    )


OBSERVATIONS = """obs AS (
  SELECT l_orderkey AS ih, CAST(3323068416 AS BIGINT) + l_suppkey AS ip, 1024 + l_partkey % 60000 AS port, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE -1 END AS role,
         CASE WHEN l_linestatus = 'O' THEN 'client-o' ELSE '' END AS client, CASE l_linenumber % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'd' ELSE 'a' END AS src, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts FROM lineitem
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier results of documents; those without a label are not done."""
    d = docs(spark, sf_dir).alias("documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    done = F.col("quality").isNotNull()
    i = F.col("doc_id")
    return d.select(
        "documents.*",
        F.when(done, F.col("toxic") * 90 + (1 - F.col("quality")) * 5).cast("long").alias("score"),
        F.expr("shiftleft(1L, cast(documents.doc_id % 7 as int))").alias("cats"),
        done.alias("done"),
        F.when(i % 97 == 3, "allow").when(i % 89 == 5, "hide").alias("override"),
    )


SCORES = (
    DOCS
    + """, scores AS (
  SELECT docs.*, CAST(toxic * 90 + (1 - quality) * 5 AS BIGINT) AS score, CAST(1 << CAST(docs.doc_id % 7 AS INT) AS BIGINT) AS cats, quality IS NOT NULL AS done,
         CASE WHEN docs.doc_id % 97 = 3 THEN 'allow' WHEN docs.doc_id % 89 = 5 THEN 'hide' END AS override FROM docs LEFT JOIN labels ON labels.doc_id = docs.doc_id
)"""
)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log of keys (customers): new, health and delete events in the order of seq."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "n").when(F.col("o_orderstatus") == "O", "h").otherwise("d")
    return o.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("ih"), kind.alias("t"), F.col("o_totalprice").cast("long").alias("size"), F.col("o_orderpriority").alias("category"))


CHANGES = """log AS (
  SELECT o_orderkey AS seq, o_custkey AS ih, CASE o_orderstatus WHEN 'F' THEN 'n' WHEN 'O' THEN 'h' ELSE 'd' END AS t, CAST(trunc(o_totalprice) AS BIGINT) AS size, o_orderpriority AS category FROM orders
)"""


#: Extensions of the media files by the part's key; none, upper case and unknown ones among them.
MEDIA_EXTS = ["mkv", "mp3", "jpg", "pdf", "exe", "zip", "csv", "nfo", "", "MKV", "tar.gz", "srt", "longextension"]


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line of an order, as a file: doc_id, the keys that order it, path and size; every fifth has no size."""
    ext = F.get(F.array(*map(F.lit, MEDIA_EXTS)), (F.col("l_partkey") % len(MEDIA_EXTS)).cast("int"))
    name = F.concat(F.lit("disc"), F.col("l_linenumber"), F.lit("/track"), F.col("l_partkey"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    size = F.when(F.col("l_partkey") % 5 == 0, 0).otherwise(F.col("l_extendedprice").cast("long"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), *FILE_ORDER, name.alias("path"), size.alias("size"))


MEDIA = (
    "media AS (SELECT l_orderkey AS doc_id, 'disc' || l_linenumber || '/track' || l_partkey || CASE WHEN ext = '' THEN '' ELSE '.' || ext END AS path, size, lower(substr(string_split(ext, '.')[-1], 1, 8)) AS ext,"
    " row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS pos FROM (SELECT *, ["
    + ", ".join(f"'{e}'" for e in MEDIA_EXTS)
    + f"][l_partkey % {len(MEDIA_EXTS)} + 1] AS ext, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE CAST(trunc(l_extendedprice) AS BIGINT) END AS size FROM lineitem)),\n"
    + """kinds_of(ext, category) AS (VALUES ('mkv', 'Video'), ('mp3', 'Audio'), ('jpg', 'Images'), ('pdf', 'Documents'), ('exe', 'Software'), ('zip', 'Archives'), ('gz', 'Archives'), ('csv', 'Data')),
media_kinds AS (SELECT media.*, coalesce(category, 'Other') AS category FROM media LEFT JOIN kinds_of ON kinds_of.ext = media.ext)"""
)


def records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a catalogue: (hot columns, cold records with files, trackers and the last measurement's sources)."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    hot = o.select(
        k.alias("doc_id"),
        F.sha1(k.cast("string").cast("binary")).alias("ih"),
        F.concat(F.lit("Órder "), k, F.lit(" track box "), F.col("o_custkey")).alias("name"),
        F.when(k % 11 == 2, 0).otherwise(k * 7919 % 500).alias("seeders"),
        (k * 104729 % 300).alias("peers"),
        F.when(k % 3 == 0, "scrape").when(k % 3 == 1, "swarm").otherwise("none").alias("src"),
        (NOW - k % 4_000_000).alias("health_at"),
        (NOW - k % 3_000_000).alias("checked_at"),
        F.when(k % 5 == 0, NOW - k % 2_000_000).otherwise(0).alias("seed_ok_at"),
        (k % 9).alias("unk"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("indexed_at"),
        (1_500_000_000 + k % 1000).alias("created"),
        (k % 4 == 1).alias("dead"),
        (k % 50 == 49).alias("deleted"),
        (k % 31 == 7).alias("hidden"),
        (k % 17 == 0).alias("private"),
    )
    entry = F.struct(*FILE_ORDER, "path", "size")
    files = media_files(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("f"))
    url = lambda i: F.concat(F.lit("udp://t"), F.lit(str(i)), F.lit(".example:80/announce"))
    number = lambda keep, value: F.when(keep, value).cast("long")
    source = lambda i, s, e: F.struct(url(i).alias("u"), s.alias("s"), number(k % 2 == 0, k % 7).alias("l"), F.lit(None).cast("long").alias("r"), e.alias("e"))
    tr = F.array(source(1, number(k % 4 != 0, k % 50), F.lit(None).cast("string")), source(2, number(k % 3 == 0, k % 90), F.lit(None).cast("string")), source(3, number(F.lit(False), k), F.when(k % 2 == 0, "timed out")))
    detail = F.when(k % 6 != 5, F.struct((NOW - k % 1000).alias("at"), (k % 3).alias("cs"), (k % 8).alias("cp"), (k % 20).alias("dht"), F.lit(1).cast("long").alias("md"), tr.alias("tr")))
    listed = F.coalesce(F.transform("f", lambda x: F.struct(x.path.alias("path"), x["size"].alias("size"))), F.array().cast("array<struct<path:string,size:bigint>>"))
    cold = o.select(k.alias("doc_id"), F.array(url(9), url(1)).alias("trackers"), F.when(k % 2 == 0, k % 1000 + 1).otherwise(0).alias("piece_length"), detail.alias("detail")).join(files, "doc_id", "left")
    return hot, cold.select("doc_id", "trackers", "piece_length", "detail", listed.alias("files"))


RECORDS = (
    MEDIA
    + f""", hot AS (
  SELECT o_orderkey AS doc_id, sha1(CAST(o_orderkey AS VARCHAR)) AS ih, 'Órder ' || o_orderkey || ' track box ' || o_custkey AS name, CASE WHEN o_orderkey % 11 = 2 THEN 0 ELSE o_orderkey * 7919 % 500 END AS seeders,
         o_orderkey * 104729 % 300 AS peers, CASE o_orderkey % 3 WHEN 0 THEN 'scrape' WHEN 1 THEN 'swarm' ELSE 'none' END AS src, {NOW} - o_orderkey % 4000000 AS health_at, {NOW} - o_orderkey % 3000000 AS checked_at,
         CASE WHEN o_orderkey % 5 = 0 THEN {NOW} - o_orderkey % 2000000 ELSE 0 END AS seed_ok_at, o_orderkey % 9 AS unk, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS indexed_at, 1500000000 + o_orderkey % 1000 AS created,
         o_orderkey % 4 = 1 AS dead, o_orderkey % 50 = 49 AS deleted, o_orderkey % 31 = 7 AS hidden, o_orderkey % 17 = 0 AS private FROM orders
), sums AS (SELECT doc_id, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS size FROM media GROUP BY doc_id),
cat_sums AS (SELECT doc_id, category, sum(CASE WHEN size = 0 THEN 1 ELSE size END) AS w, min(pos) AS first FROM media_kinds GROUP BY doc_id, category),
cats AS (SELECT doc_id, arg_max(category, (w, -first)) AS category FROM cat_sums GROUP BY doc_id),
ext_sums AS (SELECT doc_id, ext, sum(CASE WHEN size = 0 THEN 1 ELSE size END) AS w, min(pos) AS first FROM media WHERE ext <> '' GROUP BY doc_id, ext),
exts AS (SELECT doc_id, array_to_string(list(ext ORDER BY w DESC, first)[1 : 8], ',') AS exts, array_to_string(list(ext ORDER BY w DESC, first)[1 : 5], ',') AS five FROM ext_sums GROUP BY doc_id),
full_rows AS (SELECT hot.*, coalesce(sums.file_count, 0) AS file_count, coalesce(sums.size, 0) AS size, coalesce(category, 'Other') AS category, coalesce(exts, '') AS exts, coalesce(five, '') AS five,
         CASE WHEN src = 'none' THEN 'unknown' WHEN seeders > 0 THEN 'alive' WHEN peers > 0 THEN 'weak' WHEN src <> 'scrape' THEN 'unknown' WHEN dead THEN 'dead' ELSE 'quiet' END AS state
  FROM hot LEFT JOIN sums ON sums.doc_id = hot.doc_id LEFT JOIN cats ON cats.doc_id = hot.doc_id LEFT JOIN exts ON exts.doc_id = hot.doc_id)"""
)
