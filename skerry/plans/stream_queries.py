"""Streams run over the stored tables to their end, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.plans.register import Register
from skerry.plans.views import OBSERVATIONS, observed
from skerry.sources.files import work_folder
from skerry.streaming import peers, queues, rollup

query = Register()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of files; the pattern finds a file as well as a folder of files."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/event[s].parquet")


MEAN10 = "CAST(sum(value) / count(*) AS DECIMAL(30, 12)) * 10"


@query(
    f"""SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, CAST(floor({MEAN10}) + CASE WHEN {MEAN10} - floor({MEAN10}) > 0.5 OR ({MEAN10} - floor({MEAN10}) = 0.5 AND floor({MEAN10}) % 2 <> 0) THEN 1 ELSE 0 END AS DOUBLE) / 10 AS gauge,
arg_max(event_id, (ts, event_id)) AS counter, count(*) AS n FROM events GROUP BY 1"""
)
def stream_roll_up(spark, sf_dir):
    points = events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("gauge"), F.col("event_id").alias("counter"))
    return rollup.latest_of(rollup.drained(rollup.roll_up(points, "1 hour", "30 days"), work_folder(spark, "roll-up")), "start")


TENTHS = f"CAST(floor({MEAN10}) + CASE WHEN {MEAN10} - floor({MEAN10}) > 0.5 OR ({MEAN10} - floor({MEAN10}) = 0.5 AND floor({MEAN10}) % 2 <> 0) THEN 1 ELSE 0 END AS DOUBLE) / 10"


@query(
    "WITH closed AS (SELECT max(epoch(ts)) - 3600 AS until FROM events), b AS ("
    + " UNION ALL ".join(f"SELECT '{tier}' AS tier, CAST(floor(epoch(ts) / {s}) * {s} AS BIGINT) AS start, {s} AS step, {TENTHS} AS gauge, arg_max(event_id, (ts, event_id)) AS counter, count(*) AS n FROM events GROUP BY 2" for tier, s in (("m5", 300), ("h1", 3600)))
    + ") SELECT tier, start, gauge, counter, n FROM b, closed WHERE start + step <= until"
)
def stream_tiers(spark, sf_dir):
    """Both tiers of one stream, as far as their buckets are closed when the stream has come to its end."""
    points = events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("gauge"), F.col("event_id").alias("counter"))
    return rollup.drained(rollup.tiers(points), work_folder(spark, "tiers"), "append").drop("batch")


@query(
    f"""WITH {OBSERVATIONS}, b AS (SELECT ih, ip, max(role) AS role, coalesce(arg_max(port, (ts, port)) FILTER (src = 'c' AND port > 0), arg_min(port, (ts, port))) AS port,
coalesce(arg_max(client, (ts, client)) FILTER (client <> ''), '') AS client, bit_or(CASE src WHEN 'c' THEN 1 WHEN 'd' THEN 2 ELSE 4 END) AS src, min(ts) AS first, max(ts) AS last FROM obs GROUP BY ih, ip)
SELECT ih, ip, role, port, client, src, first, last FROM b WHERE src <> 2 OR role <> -1"""
)
def stream_peers(spark, sf_dir):
    """Merged addresses at the end of a stream of observations."""
    stored = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = spark.readStream.schema(stored.schema).parquet(f"{sf_dir}/lineite[m].parquet")
    found = peers.peers(observed(lines), keep_s=100 * 365 * 86_400, shards=1 + stored.count() // peers.SHARD_ROWS)
    return peers.current(rollup.drained(found, work_folder(spark, "peers"))).select("ih", "ip", "role", "port", "client", "src", "first", "last")


@query()
def stream_queues(spark, sf_dir):
    """What is taken from bounded queues, and what they forget, over the events of eight nodes."""
    kind, k = F.col("event_type"), F.col("event_id")
    event = F.when(kind.isin("click", "purchase"), "take").when(kind == "error", "done").otherwise("put")
    queue = F.get(F.array(*map(F.lit, queues.QUEUES)), (k % 4).cast("int"))
    e = events(spark, sf_dir).select((F.col("user_id") % 8).alias("node"), k.alias("seq"), event.alias("event"), queue.alias("queue"), (k * 7919 % 400).alias("ih"))
    return rollup.drained(queues.queues(e, 20), work_folder(spark, "queues")).drop("batch")


@query()
def stream_discovery(spark, sf_dir):
    """State of each key at the end of the stream."""
    kind = F.when(F.col("event_type") == "view", "seen").when(F.col("event_type") == "click", "probe").when(F.col("event_type") == "purchase", "peer").when(F.col("event_type") == "error", "fail").otherwise("announce")
    kind = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 20 == 0), "ok").otherwise(kind)
    e = events(spark, sf_dir).select(F.col("user_id").alias("ih"), kind.alias("kind"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"))
    return rollup.latest_of(rollup.drained(rollup.discovery(e), work_folder(spark, "discovery")), "ih")


@query("SELECT DISTINCT user_id AS ih FROM events")
def stream_first_seen(spark, sf_dir):
    """Every key once, however often it is seen again."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("ih"), F.col("ts").cast("timestamp").alias("time"))
    return rollup.drained(rollup.first_seen(e, "40 days"), work_folder(spark, "first-seen"), "append").select("ih")


@query(
    """WITH s AS (SELECT 'h' || (event_id % 500) AS ih, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'peer' ELSE 'announce' END WHEN 'error' THEN 'fail' ELSE 'seen' END AS kind FROM events)
SELECT ih, kind, count(*) AS n FROM s GROUP BY ih, kind"""
)
def stream_sightings(spark, sf_dir):
    """Sightings that arrive as files of JSON lines, by key and kind: an announcement with an address is one of a peer, and a kind that is given stays."""
    k, kind = F.col("event_id"), F.col("event_type")
    folder = work_folder(spark, "sightings")
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("h"), k % 500).alias("ih"), F.when(kind == "click", "announce").otherwise("sample").alias("src"),
        F.when(kind == "error", "fail").alias("kind"), F.when(k % 3 == 0, "198.18.0.1").alias("peer_ip"), F.lit(6881).alias("peer_port"), k.alias("seq"),
    )
    lines.repartition(8).write.json(f"{folder}/in")
    seen = rollup.drained(rollup.sightings(spark, f"{folder}/in", 3), f"{folder}/out", "append")
    return seen.groupBy("ih", "kind").agg(F.count("*").alias("n"))
