"""Metric roll-up and discovery state as streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skerry.operators.series import to_tenths

#: Fixed values of the discovery state machine, times in seconds. A failed key that a peer announces waits a sixth of REVIVE_S.
RETRY_LIMIT, PRIORITY_HITS, RETRY_DELAY_S, REVIVE_S = 3, 2, 300, 6 * 3600
STATE = "first_seen long, last_seen long, hits long, attempts long, status string, failed_at long, retry_at long, announced boolean, priority boolean"
OUT = f"ih long, {STATE}"


def roll_up(points: DataFrame, width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Tumbling roll-up of a stream of (ts, event_id, gauge, counter). Points later than the watermark are dropped by Spark."""
    windows = points.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
    mean = to_tenths(F.sum("gauge") / F.count("*"))
    last = F.max_by("counter", F.when(F.col("counter").isNotNull(), F.struct("ts", "event_id")))
    return windows.agg(mean.alias("gauge"), last.alias("counter"), F.count("*").alias("n")).select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "gauge", "counter", "n")


def tiers(points: DataFrame, late: str = "1 hour") -> DataFrame:
    """Closed buckets (tier, start, gauge, counter, n) of five minutes and of an hour, from one stream of (ts, event_id, gauge, counter).

    Hours are summed from the sums of their five-minute buckets, not from points, and close by the same watermark; each
    bucket comes once. Points later than the watermark are dropped, and counted by Spark in the progress of the query.
    """
    at = F.struct("ts", "event_id", "counter")
    five = points.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes").alias("w")).agg(
        F.sum("gauge").alias("sum"), F.count("*").alias("n"), F.max(F.when(F.col("counter").isNotNull(), at)).alias("last")
    )
    hour = five.groupBy(F.window(F.window_time("w"), "1 hour").alias("w")).agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.max("last").alias("last"))
    shown = lambda rows, tier: rows.select(F.lit(tier).alias("tier"), F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), to_tenths(F.col("sum") / F.col("n")).alias("gauge"), F.col("last.counter").alias("counter"), "n")
    return shown(five, "m5").unionByName(shown(hour, "h1"))


def step(state: dict | None, kind: str, ts: int, revive_after: int = 0) -> dict:
    """One event of a key: seen, announce (by somebody who has it), peer (with an address), probe, fail or ok.

    Waits go by the events' own times. A retry whose time has come is pending from the key's next event on.
    """
    new = {"first_seen": ts, "last_seen": ts, "hits": 0, "attempts": 0, "status": "pending", "failed_at": 0, "retry_at": 0, "announced": False, "priority": False}
    s = dict(state) if state else new
    s["last_seen"] = max(s["last_seen"], ts)
    if s["status"] == "indexed":
        return s
    if s["status"] == "retry" and ts >= s["retry_at"]:
        s["status"], s["priority"] = "pending", True
    was, waited = s["status"], ts - s["failed_at"]
    if kind in ("seen", "announce", "peer"):
        s["hits"] += 1
        s["announced"] |= kind != "seen"
        if kind == "peer" and (was in ("pending", "retry") or (was == "failed" and waited > revive_after / 6)):
            if was != "pending":
                s["attempts"] = min(s["attempts"], RETRY_LIMIT - 1)
            s["status"], s["priority"] = "pending", True
        elif was == "failed" and waited > revive_after:
            s["status"], s["attempts"], s["priority"] = "pending", 0, True
        elif was == "retry":
            s["status"], s["priority"] = "pending", True
        elif was == "pending" and (kind == "announce" or s["hits"] >= PRIORITY_HITS):
            s["priority"] = True
    elif kind == "probe":
        s["status"], s["priority"] = "probing", False
    elif kind == "ok":
        s["status"], s["priority"] = "indexed", False
    else:
        s["attempts"] += 1
        s["priority"] = False
        if s["attempts"] >= (RETRY_LIMIT if s["hits"] > 1 or s["announced"] else 1):
            s["status"], s["failed_at"] = "failed", ts
        else:
            s["status"], s["retry_at"] = "retry", ts + RETRY_DELAY_S
    return s


def release(state: dict) -> dict:
    """A key whose wait for a retry is over."""
    return {**state, "status": "pending", "priority": True} if state["status"] == "retry" else state


def discover(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold a micro-batch of a key's events, or release its retry when the watermark has come to its time."""
    now = dict(zip((c.split()[0] for c in STATE.split(", ")), state.get)) if state.exists else None
    if state.hasTimedOut:
        now = release(now)
    else:
        events = pd.concat(list(frames)).sort_values(["ts", "seq"])
        for kind, ts in zip(events["kind"], events["ts"]):
            now = step(now, kind, int(ts), REVIVE_S)
    state.update(tuple(now.values()))
    if now["status"] == "retry":
        state.setTimeoutTimestamp(max(now["retry_at"] * 1000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([{"ih": key[0], **now}])


def discovery(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """State of each key after each micro-batch that changes it. events: (ih, kind, ts, seq), ts in seconds."""
    timed = events.withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", late)
    return timed.groupBy("ih").applyInPandasWithState(discover, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


#: Events of a crawler as files of JSON lines.
SIGHTINGS = "ts long, ih string, src string, kind string, peer_ip string, peer_port int, seq long"


def sightings(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Stream of the sightings that arrive in a folder. An announcement of a peer with an address is of kind peer."""
    rows = spark.readStream.schema(SIGHTINGS).option("maxFilesPerTrigger", files_at_once).json(path)
    kind = F.when((F.col("src") == "announce") & F.col("peer_ip").isNotNull() & (F.col("peer_port") > 0), "peer").when(F.col("src") == "announce", "announce").otherwise("seen")
    return rows.withColumn("kind", F.coalesce("kind", kind))


def first_seen(events: DataFrame, late: str = "6 hours") -> DataFrame:
    """Each key once for as long as the watermark remembers it. events: with ih and time."""
    return events.withWatermark("time", late).dropDuplicatesWithinWatermark(["ih"])


def drained(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Run a stream over all that is there, and return what its micro-batches have put out so far, with the number of each as batch.

    Batches are written to a folder that executors and driver share; nothing passes through the driver. The same folder goes on from the same state.
    """
    return drained_with_late(stream, folder, mode)[0]


def drained_with_late(stream: DataFrame, folder: str, mode: str = "update") -> tuple[DataFrame, int]:
    """drained(), and how many rows this run dropped because they were later than the watermark (of partial sums, where there are such)."""
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def write(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/{number}")  # a batch that is run again replaces itself

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in p["stateOperators"])
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows"), late


def latest_of(rows: DataFrame, *keys: str) -> DataFrame:
    """The last row that batches put out for each key."""
    names = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("r")).select(*keys, "r.*")
