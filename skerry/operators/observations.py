"""Observations of addresses: merging, caps, aggregates by address and range look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.functions.numbers import is_global
from skerry.sources.files import stored_once

#: Caps of the reference: merged rows of a key, nodes of the registry, nodes that are kept.
KEY_ROWS, REGISTRY_NODES, KEPT_NODES = 300, 50_000, 100_000
SRC_BIT = {"c": 1, "d": 2, "a": 4}
UNKNOWN_ROLE = -1
LEAST_WAIT_S, MOST_WAIT_S = 60, 6 * 3600


def merge(obs: DataFrame) -> DataFrame:
    """One row for each (ih, ip): highest role, port of the last connection that has one (else of the first sight), last client, union of sources.

    Of equal times the higher port and the later client by name count as the last.
    """
    bit = F.lit(0)
    for name, value in SRC_BIT.items():
        bit = F.when(F.col("src") == name, value).otherwise(bit)
    order = F.struct("ts", "port")
    connected = F.max_by("port", F.when((F.col("src") == "c") & (F.col("port") > 0), order))
    client = F.max_by("client", F.when(F.col("client") != "", F.struct("ts", "client")))
    return obs.groupBy("ih", "ip").agg(
        F.max("role").alias("role"), F.coalesce(connected, F.min_by("port", order)).alias("port"), F.coalesce(client, F.lit("")).alias("client"), F.bit_or(bit).alias("src"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


def role_of(seed_flag: Column, known: Column, progress: Column) -> Column:
    """1 for a seeder: by its flag, or, once the contents are known, by its progress; then 0, before that -1."""
    return F.when(seed_flag | (known & (F.coalesce(progress, F.lit(0.0)) >= 1.0)), 1).when(known, 0).otherwise(-1)


def cap(merged: DataFrame, most: int = KEY_ROWS, by: str = "ih") -> DataFrame:
    """The latest `most` rows of each group."""
    order = Window.partitionBy(by).orderBy(F.col("last").desc(), "ip")
    return merged.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).drop("rn")


def persisted(merged: DataFrame, all_nodes: bool = False) -> DataFrame:
    """The merged rows that are stored: not those of unknown role that only the node network told, unless all_nodes."""
    return merged if all_nodes else merged.filter((F.col("src") != SRC_BIT["d"]) | (F.col("role") != UNKNOWN_ROLE))


RANGES, AT_ONCE = 1_000, 100_000


def smallest(rows: DataFrame, n: int, *order: str, at_once: int = AT_ONCE) -> DataFrame:
    """The n smallest rows by whole-number columns without nulls, for any n: a filter by cut values, not a sorted limit.

    The cut lies in one of RANGES ranges of a column, found by their exact counts; that range is cut again until it has at most at_once
    rows, of which the least are taken by order, or one value, of which the next column decides. rows are read once for each cut.
    """
    whole, rest, left = F.lit(False), F.lit(True), n
    for c in order:
        while left > 0:
            at = rows.filter(rest).agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).first()
            if at.n <= left:
                return rows.filter(whole | rest)
            if at.n <= at_once:
                return rows.filter(whole).unionByName(rows.filter(rest).orderBy(*order).limit(left))
            if at.low == at.high:
                break
            width = -(-(at.high - at.low + 1) // RANGES)
            counts = rows.filter(rest).groupBy(F.floor((F.col(c) - at.low) / width).alias("r")).count().orderBy("r").collect()  # RANGES rows at most
            passed = 0
            for r in counts:
                if passed + r["count"] > left:
                    break
                passed += r["count"]
            low = at.low + r.r * width
            whole, left = whole | (rest & (F.col(c) < low)), left - passed
            rest = rest & F.col(c).between(low, low + width - 1)
    return rows.filter(whole).unionByName(rows.filter(rest).limit(max(0, left)))  # rows that are alike in all columns


def over_cap(merged: DataFrame, most: int) -> DataFrame:
    """The rows that go when at most `most` may stay in all: the oldest, ties by key and address."""
    kept = stored_once(merged, "merged")
    return smallest(kept, max(0, kept.count() - most), "last", "ih", "ip")


def peers_of(merged: DataFrame, most: int = 500) -> DataFrame:
    """The rows of each key with their place rn: highest role first, then the latest; at most `most`."""
    order = Window.partitionBy("ih").orderBy(F.col("role").desc(), F.col("last").desc(), "ip")
    return merged.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)


def by_address(merged: DataFrame, hidden: DataFrame) -> DataFrame:
    """Addresses of hidden keys with what they do there, and in how many other keys they are. One pass: no self-join.

    Ports and clients are the first six and three of their distinct values.
    """
    inside = merged.join(hidden.select("ih", F.lit(True).alias("inside")).distinct(), "ih", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    own = lambda c: F.when(F.col("inside"), F.col(c))
    port, client = F.when(F.col("port") > 0, own("port")), F.when(F.col("client") != "", own("client"))
    return (
        inside.groupBy("ip")
        .agg(
            F.count_if("inside").alias("n"),
            F.count_if(F.col("inside") & (F.col("role") == 1)).alias("n_seed"),
            F.max(own("role")).alias("role"),
            F.slice(F.array_sort(F.collect_set(port)), 1, 6).alias("ports"),
            F.slice(F.array_sort(F.collect_set(client)), 1, 3).alias("clients"),
            F.bit_or(own("src")).alias("src"),
            F.max(own("last")).alias("last"),
            F.count_if(~F.col("inside")).alias("elsewhere"),
        )
        .filter("n > 0")
    )


STEP_BITS = 16  # of an address: ranges are cut at these steps, so that they can be joined by equal steps


def in_ranges(merged: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows whose address lies in one of the ranges (low, high). An equi-join: by the step of the address that each
    range covers a part of, then by its bounds; Spark broadcasts the ranges only if their size allows it."""
    steps = F.sequence(F.shiftright("low", STEP_BITS), F.shiftright("high", STEP_BITS))
    cut = ranges.withColumn("step", F.explode(steps)).select("step", "low", "high")
    placed = merged.withColumn("step", F.shiftright("ip", STEP_BITS))
    near = (placed.step == cut.step) & (placed.ip >= cut.low) & (placed.ip <= cut.high)
    return placed.join(cut, near, "left_semi").drop("step")


def hits_of(found: DataFrame, docs: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """Keys in which addresses were found, with what the catalogue knows of them: the `most` with the most addresses, and (total, truncated)."""
    keys = found.groupBy("ih").agg(F.count("*").alias("addresses"), F.max("role").alias("role"), F.max("last").alias("last"))
    joined = keys.join(docs, "ih")
    total = joined.agg(F.count("*").alias("total")).withColumn("truncated", F.col("total") > most)
    return joined.orderBy(F.col("addresses").desc(), F.col("last").desc(), "ih").limit(most), total


def last_endpoints(obs: DataFrame, most: int = 4) -> DataFrame:
    """The last distinct endpoints of each key."""
    seen = obs.groupBy("ih", "ip", "port").agg(F.max("ts").alias("last"))
    order = Window.partitionBy("ih").orderBy(F.col("last").desc(), "ip", "port")
    return seen.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)


def registry(obs: DataFrame, own: int, most: int = REGISTRY_NODES, everywhere: bool = False) -> DataFrame:
    """The first distinct endpoints with a port and a global address (everywhere: any), without one's own address."""
    there = F.lit(True) if everywhere else is_global(F.col("ip"))
    return obs.filter(F.col("port").between(1, 65_535) & (F.col("ip") != own) & there).select("ip", "port").distinct().orderBy("ip", "port").limit(most)


def next_due(replies: DataFrame) -> DataFrame:
    """(ip, port, due) of nodes from their replies (ip, port, ts, interval): when each may be asked again, by its last reply.

    A node says how many seconds it wants to be left alone, from LEAST_WAIT_S to MOST_WAIT_S; up to three tenths more, by a hash of its address, keep nodes
    that answered together from falling due together.
    """
    last = replies.groupBy("ip", "port").agg(F.max("ts").alias("ts"), F.max_by("interval", F.struct("ts", "interval")).alias("interval"))
    more = F.pmod(F.xxhash64("ip", "port"), F.lit(1000)) / 1000 * 0.3
    wait = F.least(F.lit(MOST_WAIT_S), F.greatest(F.lit(LEAST_WAIT_S), F.coalesce("interval", F.lit(LEAST_WAIT_S))))
    return last.select("ip", "port", (F.col("ts") + F.floor(wait * (1 + more))).cast("long").alias("due"), "ts", wait.cast("long").alias("wait"))


def node_union(here: DataFrame, there: DataFrame, most: int = KEPT_NODES) -> DataFrame:
    """The ids of both, each once, the first `most`."""
    return here.union(there).distinct().orderBy(*here.columns).limit(most)


def source_health(reports: DataFrame) -> DataFrame:
    """(source, ok, fail, rate, last_ok, last_fail, last_error) of reports (source, ok, ts, error); 0 and no text where there is none."""
    ok, time = F.col("ok"), lambda c: F.coalesce(F.max(F.when(c, F.col("ts"))), F.lit(0))
    error = F.max_by("error", F.when(~ok, F.struct("ts", "error")))
    return reports.groupBy("source").agg(
        F.count_if(ok).alias("ok"), F.count_if(~ok).alias("fail"), (F.count_if(ok) / F.count("*")).alias("rate"), time(ok).alias("last_ok"), time(~ok).alias("last_fail"), F.coalesce(error, F.lit("")).alias("last_error")
    )


REACHABLE = ("seed", "leecher", "connected")


def verdict(seeds: Column, reachable: Column, reported: Column) -> Column:
    """What probes and claims together say of a key."""
    claimed = F.coalesce(reported, F.lit(0)) > 0
    return F.when(seeds > 0, "seeders").when(claimed & (reachable == 0), "claims only").when(claimed, "leechers only").when(reachable > 0, "no seeders").otherwise("nobody")


def probe_counts() -> list[Column]:
    status = F.col("status")
    return [F.count("*").alias("tested"), F.count_if(status.isin(*REACHABLE)).alias("reachable"), F.count_if(status == "seed").alias("seeds"), F.count_if(status == "leecher").alias("leechers")]


def verification_by_source(probes: DataFrame, claims: DataFrame) -> DataFrame:
    """Probes (source, ip, status) and claims (source, reported) summed up by source, with a verdict."""
    counted = probes.groupBy("source").agg(*probe_counts()).join(claims, "source", "left")
    return counted.withColumn("verdict", verdict(F.col("seeds"), F.col("reachable"), F.col("reported"))).drop("reported")


def verification_totals(probes: DataFrame, claims: DataFrame) -> DataFrame:
    """One row over all addresses, each with its best status; sources_ok: those that answered."""
    place = F.array_position(F.array(*map(F.lit, REACHABLE)), F.col("status"))
    best = probes.groupBy("ip").agg(F.min_by("status", F.when(place > 0, place).otherwise(len(REACHABLE) + 1)).alias("status"))
    said = claims.agg(F.coalesce(F.max("reported"), F.lit(0)).alias("most_reported"), F.count("reported").alias("sources_ok"))
    both = best.agg(*probe_counts()).join(F.broadcast(said))  # one row each
    return both.withColumn("verdict", verdict(F.col("seeds"), F.col("reachable"), F.col("most_reported")))
