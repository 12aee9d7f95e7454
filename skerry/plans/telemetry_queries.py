"""Queries over measurements, time series, observations, moderation scores and change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.functions import numbers as N
from skerry.functions.text import bucket, clean, magnet
from skerry.operators import health as H
from skerry.operators import moderation as M
from skerry.operators import observations as O
from skerry.operators import series as T
from skerry.plans.register import Register
from skerry.sources.files import stored_once
from skerry.plans.views import CHANGES, DOCS, FILES, MEASUREMENTS, METRICS, NOW, OBSERVATIONS, SCORES, changes, docs, items, measurements, metrics, observations, scores, table

query = Register()
#: The mean over all points of a bucket, to one place, halves to the even digit, on decimals.
def tenths(n: str) -> str:
    mean = f"CAST(sum(gauge) / {n} AS DECIMAL(30, 12)) * 10"
    return f"CAST(floor({mean}) + CASE WHEN {mean} - floor({mean}) > 0.5 OR ({mean} - floor({mean}) = 0.5 AND floor({mean}) % 2 <> 0) THEN 1 ELSE 0 END AS DOUBLE) / 10"


TENTHS = tenths("count(*)")

FOLD = f"""WITH RECURSIVE {MEASUREMENTS}, o AS (SELECT * REPLACE (greatest(seeders, 0) AS seeders), row_number() OVER (PARTITION BY ih ORDER BY mt, event_id) AS k FROM meas),
fold AS (
  SELECT ih, k, seeders, peers, src, mt AS health_at, mt AS checked_at, CAST(CASE WHEN cs > 0 THEN mt ELSE 0 END AS BIGINT) AS seed_ok_at, CAST(1 AS BIGINT) AS n_kept, true AS kept FROM o WHERE k = 1
  UNION ALL
  SELECT o.ih, o.k, CASE WHEN keep THEN f.seeders ELSE o.seeders END, CASE WHEN keep THEN f.peers ELSE o.peers END, CASE WHEN keep THEN f.src ELSE o.src END,
         CASE WHEN keep THEN f.health_at ELSE o.mt END, o.mt, CASE WHEN o.cs > 0 THEN o.mt ELSE f.seed_ok_at END, f.n_kept + CASE WHEN keep THEN 0 ELSE 1 END, NOT keep
  FROM (SELECT f.*, o.k AS nk, o.src <> 'scrape' AND f.src = 'scrape' AND o.mt - f.health_at < 1209600 AND o.seeders < f.seeders AS keep FROM fold f JOIN o ON o.ih = f.ih AND o.k = f.k + 1) f JOIN o ON o.ih = f.ih AND o.k = f.nk
), state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ih ORDER BY k DESC) AS rn FROM fold) WHERE rn = 1),
hist AS (SELECT o.* FROM o JOIN fold ON fold.ih = o.ih AND fold.k = o.k WHERE kept),
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ih ORDER BY mt DESC) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY ih, mt ORDER BY event_id DESC) AS one FROM hist) WHERE one = 1) WHERE rn <= 40),
unk AS (SELECT ih, least(255, coalesce(min(CASE WHEN src = 'scrape' THEN rn END) - 1, count(*))) AS unk FROM recent GROUP BY ih),
zeros AS (SELECT *, max(CASE WHEN src = 'scrape' AND seeders = 0 AND peers = 0 AND nrep >= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY ih ORDER BY rn) AS broken FROM recent),
dead AS (SELECT ih, count(*) AS run, max(mt) - min(mt) AS span, count(*) >= 3 AND max(mt) - min(mt) >= 43200 AS dead FROM zeros WHERE broken = 0 GROUP BY ih),
verdict AS (SELECT state.*, unk, CASE WHEN src = 'none' THEN 'unknown' WHEN seeders > 0 THEN 'alive' WHEN peers > 0 THEN 'weak' WHEN src <> 'scrape' THEN 'unknown' WHEN coalesce(dead, false) THEN 'dead' ELSE 'quiet' END AS state
  FROM state LEFT JOIN dead ON dead.ih = state.ih JOIN unk ON unk.ih = state.ih),
wait AS (SELECT *, CASE state WHEN 'alive' THEN 21600 WHEN 'weak' THEN 43200 WHEN 'quiet' THEN 21600 WHEN 'dead' THEN 259200 ELSE least(259200, 1800 * CAST(pow(2, least(unk, 8)) AS BIGINT)) END AS wait FROM verdict),
due AS (SELECT ih, state, greatest(health_at, checked_at) + wait AS due_at FROM wait)
"""


def verdicts(spark, sf_dir):
    return H.verdicts(measurements(spark, sf_dir))


@query(FOLD + "SELECT ih, seeders, peers, src, health_at, checked_at, seed_ok_at, n_kept FROM state")
def health_fold(spark, sf_dir):
    return H.fold(measurements(spark, sf_dir))


@query(FOLD + "SELECT ih, mt, seeders, peers, src, rn FROM recent")
def health_history(spark, sf_dir):
    return H.history(measurements(spark, sf_dir)).select("ih", "mt", "seeders", "peers", "src", F.col("rn").cast("long").alias("rn"))


@query(FOLD + "SELECT ih, run, CAST(span AS BIGINT) AS span, dead FROM dead")
def health_dead_confirmation(spark, sf_dir):
    return H.dead_keys(measurements(spark, sf_dir))


@query(FOLD + "SELECT ih, CAST(unk AS BIGINT) AS unk FROM unk")
def health_unknown_run(spark, sf_dir):
    return H.unknown_run(measurements(spark, sf_dir))


@query(FOLD + "SELECT state, count(*) AS n FROM verdict GROUP BY state")
def health_states(spark, sf_dir):
    return verdicts(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query(FOLD + "SELECT ih, due_at FROM due")
def health_due(spark, sf_dir):
    return verdicts(spark, sf_dir).select("ih", "due_at")


@query(FOLD + f"SELECT ih, state, {NOW} - due_at AS overdue_s FROM due WHERE due_at <= {NOW} ORDER BY due_at, ih LIMIT 512")
def health_refresh_queue(spark, sf_dir):
    """The most overdue keys."""
    return verdicts(spark, sf_dir).filter(F.col("due_at") <= NOW).orderBy("due_at", "ih").limit(512).select("ih", "state", (F.lit(NOW) - F.col("due_at")).alias("overdue_s"))


@query(FOLD + f"SELECT ih, CASE WHEN ih % 3 = 0 THEN greatest(health_at, checked_at, {NOW}) ELSE greatest(health_at, checked_at) END + wait AS due_at FROM wait")
def health_deferred(spark, sf_dir):
    """Every third key is put off: it counts as checked now."""
    current = verdicts(spark, sf_dir)
    return H.defer(current, current.filter("ih % 3 = 0"), NOW).select("ih", "due_at")


@query(FOLD + "SELECT recent.ih, mt AS health_at, seeders, peers, src, coalesce(dead.dead, false) AS dead, CAST(unk AS BIGINT) AS unk FROM recent LEFT JOIN dead ON dead.ih = recent.ih JOIN unk ON unk.ih = recent.ih WHERE rn = 1")
def health_restore(spark, sf_dir):
    """Current figures from the newest entry of the history, flags from all of it."""
    return H.restored(H.states(measurements(spark, sf_dir)))


@query(FOLD + "SELECT state.ih, seeders, peers, src, health_at, checked_at, seed_ok_at, n_kept, coalesce(dead.dead, false) AS dead, CAST(unk AS BIGINT) AS unk FROM state LEFT JOIN dead ON dead.ih = state.ih JOIN unk ON unk.ih = state.ih")
def health_folded_on(spark, sf_dir):
    """Half of each key's measurements are in stored states; the later half is folded into these."""
    m = measurements(spark, sf_dir)
    half = m.groupBy("ih").agg(F.floor((F.min("mt") + F.max("mt")) / 2).alias("until"))
    m = m.join(half, "ih")
    stored = stored_once(H.states(m.filter("mt <= until")), "health")
    return H.flagged(H.fold_into(stored, m.filter("mt > until"))).drop("history", "run", "span")


@query(f"WITH {METRICS} SELECT CAST(floor(t / 300) * 300 + 150 AS BIGINT) AS t, {TENTHS} AS gauge, arg_max(counter, (t, event_id)) FILTER (counter IS NOT NULL) AS counter, count(*) AS n FROM metrics GROUP BY floor(t / 300)")
def metrics_five_minutes(spark, sf_dir):
    return T.roll_up(metrics(spark, sf_dir), 300)


@query(f"WITH {METRICS} SELECT CAST(floor(t / 3600) * 3600 + 1800 AS BIGINT) AS t, {TENTHS} AS gauge, arg_max(counter, (t, event_id)) FILTER (counter IS NOT NULL) AS counter, count(*) AS n FROM metrics GROUP BY floor(t / 3600)")
def metrics_hours(spark, sf_dir):
    return T.roll_up(metrics(spark, sf_dir), 3600)


SEGMENTS = f"""WITH {METRICS}, s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY event_type ORDER BY t, event_id) > 1200 THEN 1 ELSE 0 END AS broken FROM metrics),
seg AS (SELECT *, sum(broken) OVER (PARTITION BY event_type ORDER BY t, event_id) AS seg FROM s),
placed AS (SELECT *, row_number() OVER (PARTITION BY event_type, seg ORDER BY t, event_id) AS rn FROM seg), g AS (SELECT event_type, greatest(1, ceil(count(*) / 600)) AS g FROM metrics GROUP BY event_type)
"""


@query(SEGMENTS + "SELECT event_type, CAST(seg AS BIGINT) AS seg, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM placed GROUP BY event_type, seg")
def metrics_gaps(spark, sf_dir):
    return T.segments(metrics(spark, sf_dir), 1200).groupBy("event_type", "seg").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(SEGMENTS + "SELECT placed.event_type, CAST(seg AS BIGINT) AS seg, max(t) AS t, " + tenths("nullif(count(gauge), 0)") + " AS gauge, arg_max(counter, (t, event_id)) FILTER (counter IS NOT NULL) AS counter FROM placed JOIN g ON g.event_type = placed.event_type GROUP BY placed.event_type, seg, floor((rn - 1) / g)")
def metrics_down_sample(spark, sf_dir):
    return T.down_sample(metrics(spark, sf_dir), 600, 300)


def rates_sql(window: int, source: str, *values: str) -> str:
    """Tables of a source of points (event_type, t, event_id and counters without nulls), the last of which, r, has the rate of each counter."""
    first = ", ".join(f"arg_min({v}, (t, event_id)) AS {v}_first" for v in values)
    last = ", ".join(f"arg_max({v}, event_id) AS {v}_last" for v in values)
    rate = ", ".join(f"CASE WHEN x.t - coalesce(lasts.t, t0) >= 0.8 * w THEN greatest(0.0, (x.{v} - coalesce({v}_last, {v}_first)) / (x.t - coalesce(lasts.t, t0))) END AS {v}_rate" for v in values)
    return f"""s AS (SELECT *, t - lag(t) OVER (PARTITION BY event_type ORDER BY t, event_id) AS dt FROM {source}),
m AS (SELECT event_type, list_sort(list(dt))[len(list(dt)) // 2 + 1] AS med FROM s WHERE dt IS NOT NULL GROUP BY event_type),
b AS (SELECT s.*, greatest({window}, 3 * med) AS w, CASE WHEN dt > greatest(60, 4 * med) THEN 1 ELSE 0 END AS broken FROM s JOIN m ON m.event_type = s.event_type),
seg AS (SELECT *, sum(broken) OVER (PARTITION BY event_type ORDER BY t, event_id) AS seg FROM b),
firsts AS (SELECT event_type, seg, min(t) AS t0, {first} FROM seg GROUP BY event_type, seg),
lasts AS (SELECT event_type, seg, t, {last} FROM seg GROUP BY event_type, seg, t),
r AS (SELECT x.event_type, x.t, x.event_id, {rate} FROM (SELECT *, t - w AS back FROM seg) x
  ASOF LEFT JOIN lasts ON x.event_type = lasts.event_type AND x.seg = lasts.seg AND x.back >= lasts.t JOIN firsts ON firsts.event_type = x.event_type AND firsts.seg = x.seg)"""


@query(f"WITH {METRICS}, {rates_sql(7200, 'metrics', 'counter')} SELECT event_type, t, event_id, round(counter_rate, 9) AS rate FROM r")
def metrics_rates(spark, sf_dir):
    return T.rates(metrics(spark, sf_dir), 7200).withColumn("rate", F.round("rate", 9))


@query(
    f"""WITH {METRICS}, counters AS (SELECT 'all' AS event_type, t, event_id, sum(CAST(event_type = 'purchase' AS BIGINT)) OVER o AS ok, sum(CAST(event_type = 'error' AS BIGINT)) OVER o AS fail FROM metrics WINDOW o AS (ORDER BY t, event_id)),
{rates_sql(120, 'counters', 'ok', 'fail')} SELECT t, event_id, CASE WHEN ok_rate + fail_rate > 0 THEN round(100 * ok_rate / (ok_rate + fail_rate), 6) END AS success FROM r"""
)
def success_rate(spark, sf_dir):
    """Purchases in percent of purchases and errors, as the ratio of the rates of two counters."""
    kinds = metrics(spark, sf_dir).select(F.lit("all").alias("event_type"), "t", "event_id", *((F.col("event_type") == kind).cast("long").alias(name) for name, kind in (("ok", "purchase"), ("fail", "error"))))
    width = T.stretch_width(kinds, "event_type")
    counted = T.running(kinds, "event_type", width=width, ok=("sum", F.col("ok")), fail=("sum", F.col("fail")))
    return T.share_of_rates(counted, 120, "ok", "fail", width=width).select("t", "event_id", F.round("share", 6).alias("success"))


@query(f"WITH {METRICS}, m AS (SELECT event_id, max(t) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS t FROM metrics) SELECT CAST(floor(t / 3600) AS BIGINT) AS hour, count(*) AS n FROM m GROUP BY hour")
def metrics_late_points(spark, sf_dir):
    """Late points count at the latest time seen so far."""
    return T.monotonic(metrics(spark, sf_dir)).groupBy(F.floor(F.col("t") / 3600).alias("hour")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {METRICS}, h AS (SELECT CAST(floor(t / 3600) * 3600 + 1800 AS BIGINT) AS t, count(*) AS n FROM metrics WHERE t < 1705000000 GROUP BY 1), m AS (SELECT CAST(floor(t / 300) * 300 + 150 AS BIGINT) AS t, count(*) AS n FROM metrics GROUP BY 1)
SELECT t, n FROM h UNION ALL SELECT t, n FROM m WHERE t > (SELECT max(t) FROM h) + 1800"""
)
def metrics_stitched(spark, sf_dir):
    p = metrics(spark, sf_dir)
    coarse, fine = T.roll_up(p.filter("t < 1705000000"), 3600), T.roll_up(p, 300)
    return T.stitch(coarse, fine, 3600).select("t", "n")


@query(f"WITH {METRICS}, m AS (SELECT max(t) AS last FROM metrics) SELECT event_type, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM metrics WHERE t >= 1706659000 - 86400 GROUP BY event_type")
def metrics_retention(spark, sf_dir):
    return T.retained(metrics(spark, sf_dir), "raw", 1_706_659_000).groupBy("event_type").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"WITH {METRICS}, d AS (SELECT event_type, t - lag(t) OVER (PARTITION BY event_type ORDER BY t, event_id) AS dt FROM metrics) SELECT event_type, CAST(coalesce(sum(CASE WHEN dt > 0 AND dt < 1200 THEN dt END), 0) AS BIGINT) AS uptime_s FROM d GROUP BY event_type")
def metrics_uptime(spark, sf_dir):
    return T.uptime(metrics(spark, sf_dir), most=1200)


@query()
def distinct_sketch(spark, sf_dir):
    """Estimated distinct users of all event types, from mergeable sketches."""
    return T.estimate(T.sketch(table(spark, sf_dir, "events"), "event_type", "user_id"))


@query("SELECT event_type, round(list_reduce(list_prepend(0.0, list(value ORDER BY ts, event_id)), lambda a, x: 0.95 * a + 0.05 * x), 6) AS average FROM events GROUP BY event_type")
def moving_average(spark, sf_dir):
    average = T.moving_average(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")
    return average.select("event_type", F.round("average", 6).alias("average"))


@query("WITH l AS (SELECT CASE WHEN value < 10 THEN '<10' WHEN value < 20 THEN '<20' WHEN value < 30 THEN '<30' WHEN value < 45 THEN '<45' WHEN value < 60 THEN '<60' WHEN value < 90 THEN '<90' ELSE '>=90' END AS label FROM events) SELECT label, count(*) AS n FROM l GROUP BY label")
def latency_histogram(spark, sf_dir):
    edges = [10, 20, 30, 45, 60, 90]
    label = bucket(F.col("value"), edges, [f"<{e}" for e in edges] + [">=90"])
    return table(spark, sf_dir, "events").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


REPORTS = "r AS (SELECT l_suppkey AS source, l_returnflag <> 'R' AS ok, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts, CASE WHEN l_returnflag = 'R' THEN 'error ' || (l_linenumber % 5) END AS error FROM lineitem)"


@query(f"WITH {REPORTS} SELECT source, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS fail, round(count(*) FILTER (ok) / count(*), 3) AS rate, coalesce(max(ts) FILTER (ok), 0) AS last_ok, coalesce(max(ts) FILTER (NOT ok), 0) AS last_fail, coalesce(arg_max(error, (ts, error)) FILTER (NOT ok), '') AS last_error, source % 3 = 0 AS configured FROM r GROUP BY source")
def source_report(spark, sf_dir):
    """How often each source answered, when last, and with what error it last did not."""
    line = table(spark, sf_dir, "lineitem")
    r = line.select(F.col("l_suppkey").alias("source"), (F.col("l_returnflag") != "R").alias("ok"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ts"), F.concat(F.lit("error "), F.col("l_linenumber") % 5).alias("error"))
    return O.source_health(r).withColumns({"rate": F.round("rate", 3), "configured": F.col("source") % 3 == 0})


PROBES = """p AS (SELECT l_suppkey AS source, l_orderkey % 500 AS ip, CASE WHEN l_returnflag = 'R' AND l_suppkey % 4 < 2 THEN 'seed' WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_suppkey % 4 < 3 THEN 'leecher' WHEN l_returnflag = 'N' AND l_linenumber = 7 AND l_suppkey % 4 < 3 THEN 'connected' WHEN l_linestatus = 'O' THEN 'timeout' ELSE 'refused' END AS status FROM lineitem),
s AS (SELECT source, count(*) AS tested, count(*) FILTER (status IN ('seed', 'leecher', 'connected')) AS reachable, count(*) FILTER (status = 'seed') AS seeds, count(*) FILTER (status = 'leecher') AS leechers, source % 7 * (source % 3) AS reported FROM p GROUP BY source)"""


def probes(spark, sf_dir):
    """Probes of addresses that sources gave: (source, ip, status)."""
    flag, line, four = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_suppkey") % 4
    status = F.when((flag == "R") & (four < 2), "seed").when((flag == "A") & (line == "F") & (four < 3), "leecher").when((flag == "N") & (F.col("l_linenumber") == 7) & (four < 3), "connected").when(line == "O", "timeout").otherwise("refused")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_orderkey") % 500).alias("ip"), status.alias("status"))


def claims(spark, sf_dir):
    """Seeders that each source reports; every tenth didn't answer."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("source"), F.when(k % 10 != 9, k % 7 * (k % 3)).alias("reported"))


@query(f"WITH {PROBES} SELECT source, tested, reachable, seeds, leechers, CASE WHEN seeds > 0 THEN 'seeders' WHEN source % 10 <> 9 AND reported > 0 AND reachable = 0 THEN 'claims only' WHEN source % 10 <> 9 AND reported > 0 THEN 'leechers only' WHEN reachable > 0 THEN 'no seeders' ELSE 'nobody' END AS verdict FROM s")
def verification_summary(spark, sf_dir):
    return O.verification_by_source(probes(spark, sf_dir), claims(spark, sf_dir))


@query(f"""WITH {PROBES}, a AS (SELECT ip, min(CASE status WHEN 'seed' THEN 0 WHEN 'leecher' THEN 1 WHEN 'connected' THEN 2 ELSE 3 END) AS k FROM p GROUP BY ip), c AS (SELECT max(CASE WHEN s_suppkey % 10 <> 9 THEN s_suppkey % 7 * (s_suppkey % 3) END) AS most, count(*) FILTER (s_suppkey % 10 <> 9) AS answered FROM supplier)
SELECT count(*) AS tested, count(*) FILTER (k < 3) AS reachable, count(*) FILTER (k = 0) AS seeds, count(*) FILTER (k = 1) AS leechers, coalesce(any_value(most), 0) AS most_reported, any_value(answered) AS sources_ok,
CASE WHEN count(*) FILTER (k = 0) > 0 THEN 'seeders' WHEN any_value(most) > 0 AND count(*) FILTER (k < 3) = 0 THEN 'claims only' WHEN any_value(most) > 0 THEN 'leechers only' WHEN count(*) FILTER (k < 3) > 0 THEN 'no seeders' ELSE 'nobody' END AS verdict FROM a, c""")
def verification_totals(spark, sf_dir):
    """All addresses once, however many sources gave them, and what the sources claimed at most."""
    return O.verification_totals(probes(spark, sf_dir), claims(spark, sf_dir))


MERGED = f"""WITH {OBSERVATIONS}, merged AS (
  SELECT ih, ip, max(role) AS role, coalesce(arg_max(port, (ts, port)) FILTER (src = 'c' AND port > 0), arg_min(port, (ts, port))) AS port, coalesce(arg_max(client, (ts, client)) FILTER (client <> ''), '') AS client,
         CAST(bit_or(CASE src WHEN 'c' THEN 1 WHEN 'd' THEN 2 ELSE 4 END) AS BIGINT) AS src, min(ts) AS first, max(ts) AS last FROM obs GROUP BY ih, ip
)"""


def merged(spark, sf_dir):
    return O.merge(observations(spark, sf_dir)).withColumn("src", F.col("src").cast("long"))


@query(MERGED + "SELECT * FROM merged")
def peers_merged(spark, sf_dir):
    return merged(spark, sf_dir)


@query(MERGED + "SELECT * FROM merged WHERE src <> 2 OR role <> -1")
def peers_persisted(spark, sf_dir):
    """What is stored of them: addresses that only the node network told, and of whose role nothing is known, aren't."""
    return O.persisted(merged(spark, sf_dir))


@query(MERGED + ", r AS (SELECT *, row_number() OVER (PARTITION BY ih ORDER BY last DESC, ip) AS rn FROM merged) SELECT ih, ip, last FROM r WHERE rn <= 300")
def peers_capped(spark, sf_dir):
    return O.cap(merged(spark, sf_dir)).select("ih", "ip", "last")


@query(MERGED + ", i AS (SELECT *, ih % 10 = 1 AS inside FROM merged) SELECT ip, count(*) FILTER (inside) AS n, count(*) FILTER (inside AND role = 1) AS n_seed, max(role) FILTER (inside) AS role, array_to_string(list_sort(list(DISTINCT port) FILTER (inside AND port > 0))[1 : 6], ',') AS ports, coalesce(array_to_string(list_sort(list(DISTINCT client) FILTER (inside AND client <> ''))[1 : 3], ','), '') AS clients, CAST(bit_or(src) FILTER (inside) AS BIGINT) AS src, max(last) FILTER (inside) AS last, count(*) FILTER (NOT inside) AS elsewhere FROM i GROUP BY ip HAVING count(*) FILTER (inside) > 0")
def peers_by_address(spark, sf_dir):
    hidden = table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 1").select(F.col("o_orderkey").alias("ih")).distinct()
    return O.by_address(merged(spark, sf_dir), hidden).withColumns({"ports": F.array_join(F.col("ports").cast("array<string>"), ","), "clients": F.array_join("clients", ",")})


@query(MERGED + "SELECT ih, ip FROM merged WHERE ip BETWEEN 3323068416 AND 3323068431 OR ip = 3323068450")
def peers_in_ranges(spark, sf_dir):
    spans = [N.block_range("198.18.0.5/28"), N.block_range("198.18.0.34")]
    return O.in_ranges(merged(spark, sf_dir), spark.createDataFrame(spans, "low long, high long")).select("ih", "ip")


@query(MERGED + ", r AS (SELECT *, row_number() OVER (PARTITION BY ih ORDER BY role DESC, last DESC, ip) AS rn FROM merged) SELECT ih, ip, role, last, rn FROM r WHERE rn <= 500")
def peers_of_key(spark, sf_dir):
    return O.peers_of(merged(spark, sf_dir)).select("ih", "ip", "role", "last", F.col("rn").cast("long").alias("rn"))


@query(MERGED + ", f AS (SELECT * FROM merged WHERE ip BETWEEN 3323068416 AND 3323068431 OR ip = 3323068450), k AS (SELECT ih, count(*) AS addresses, max(role) AS role, max(last) AS last FROM f GROUP BY ih) SELECT ih, addresses, role, last, o_custkey AS owner FROM k JOIN orders ON o_orderkey = ih ORDER BY addresses DESC, last DESC, ih LIMIT 500")
def peers_hits(spark, sf_dir):
    """Keys of the catalogue in which the addresses of a request were found."""
    spans = [N.block_range("198.18.0.5/28"), N.block_range("198.18.0.34")]
    found = O.in_ranges(merged(spark, sf_dir), spark.createDataFrame(spans, "low long, high long"))
    hits, _ = O.hits_of(found, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ih"), F.col("o_custkey").alias("owner")))
    return hits


@query(MERGED + ", f AS (SELECT DISTINCT ih FROM merged WHERE ip BETWEEN 3323068416 AND 3323068431 OR ip = 3323068450) SELECT count(*) AS total, count(*) > 500 AS truncated FROM f JOIN orders ON o_orderkey = ih")
def peers_hits_total(spark, sf_dir):
    spans = [N.block_range("198.18.0.5/28"), N.block_range("198.18.0.34")]
    found = O.in_ranges(merged(spark, sf_dir), spark.createDataFrame(spans, "low long, high long"))
    _, total = O.hits_of(found, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ih")))
    return total


@query("SELECT l_orderkey AS ih, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' OR (l_linestatus = 'F' AND l_discount * 10 >= 1.0) THEN 1 WHEN l_linestatus = 'F' THEN 0 ELSE -1 END AS role FROM lineitem")
def peers_roles(spark, sf_dir):
    role = O.role_of(F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.col("l_discount") * 10)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ih"), "l_linenumber", "l_partkey", "l_suppkey", role.alias("role"))


@query(f"WITH {OBSERVATIONS} SELECT count(*) AS entries, count(DISTINCT ih) AS docs, count(DISTINCT ip) AS addresses FROM obs")
def peers_summary(spark, sf_dir):
    return observations(spark, sf_dir).agg(F.count("*").alias("entries"), F.count_distinct("ih").alias("docs"), F.count_distinct("ip").alias("addresses"))


@query(f"WITH {OBSERVATIONS}, s AS (SELECT ih, ip, port, max(ts) AS last FROM obs GROUP BY ih, ip, port), r AS (SELECT *, row_number() OVER (PARTITION BY ih ORDER BY last DESC, ip, port) AS rn FROM s) SELECT ih, ip, port, rn FROM r WHERE rn <= 4")
def peers_last_endpoints(spark, sf_dir):
    return O.last_endpoints(observations(spark, sf_dir)).select("ih", "ip", "port", F.col("rn").cast("long").alias("rn"))


@query(MERGED + "SELECT o_orderkey AS ih, count(merged.ih) AS n FROM orders LEFT JOIN merged ON merged.ih = o_orderkey GROUP BY o_orderkey")
def peers_per_key(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ih"))
    counts = merged(spark, sf_dir).groupBy("ih").agg(F.count("*").alias("n"))
    return keys.join(counts, "ih", "left").select("ih", F.coalesce("n", F.lit(0)).alias("n"))


@query(MERGED + "SELECT count(*) AS left_over FROM merged WHERE ih % 10 <> 3")
def peers_forget(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("ih"))
    return merged(spark, sf_dir).join(gone, "ih", "left_anti").agg(F.count("*").alias("left_over"))


POLICY = "NOT deleted AND coalesce(override, '') <> 'allow' AND (coalesce(override, '') = 'hide' OR coalesce(done AND score >= 50 AND (cats & 63) <> 0, false))"


@query(f"WITH {SCORES} SELECT doc_id FROM scores WHERE {POLICY}")
def moderation_policy(spark, sf_dir):
    return scores(spark, sf_dir).filter(M.policy(50, 63)).select("doc_id")


@query(f"WITH {SCORES}, s AS (SELECT *, CASE WHEN override = 'allow' THEN 'allowed' WHEN override = 'hide' THEN 'manual' WHEN {POLICY} THEN 'hidden' ELSE 'visible' END AS state FROM scores) SELECT doc_id, state, score FROM s WHERE done AND score BETWEEN 5 AND 95 ORDER BY score DESC, doc_id LIMIT 50")
def moderation_list(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("state", M.state(50, 63))
    return s.filter(F.col("done") & F.col("score").between(5, 95)).orderBy(F.col("score").desc(), "doc_id").limit(50).select("doc_id", "state", "score")


@query(f"WITH {SCORES} SELECT least(score // 10, 9) AS bin, count(*) AS n, " + ", ".join(f"count(*) FILTER ((cats & {1 << k}) <> 0) AS cat{k}" for k in range(7)) + " FROM scores WHERE done AND NOT deleted GROUP BY bin")
def moderation_histogram(spark, sf_dir):
    bit = lambda k: F.count_if(F.col("cats").bitwiseAND(1 << k) != 0).alias(f"cat{k}")
    return scores(spark, sf_dir).filter("done and not deleted").groupBy(F.least(F.floor(F.col("score") / 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), *map(bit, range(M.SCORE_CATEGORIES)))


@query(
    f"WITH {SCORES}, s AS (SELECT *, {POLICY} AS hid FROM scores) SELECT count(*) FILTER (done AND NOT deleted) AS analysed, count(*) FILTER (NOT done AND NOT deleted) AS pending, count(*) FILTER (hid) AS hidden, count(*) FILTER (override = 'allow' AND NOT deleted) AS allowed, count(*) FILTER (override = 'hide' AND NOT deleted) AS manual, "
    + ", ".join(f"count(*) FILTER (done AND NOT deleted AND least(score // 10, 9) = {k}) AS bin{k}" for k in range(10))
    + ", "
    + ", ".join(f"count(*) FILTER (hid AND (cats & {1 << k}) <> 0) AS cat{k}" for k in range(7))
    + " FROM s"
)
def moderation_counts(spark, sf_dir):
    return M.counts(scores(spark, sf_dir), 50, 63)


@query(f"WITH {SCORES}, s AS (SELECT *, {POLICY} AS hid FROM scores) SELECT doc_id, CASE WHEN override = 'allow' THEN 'allowed' WHEN override = 'hide' THEN 'manual' WHEN hid THEN 'hidden' ELSE 'visible' END AS state, lower(name) AS low FROM s WHERE NOT deleted AND (done OR override IS NOT NULL) AND NOT hid AND coalesce(score, 0) BETWEEN 0 AND 95 AND (coalesce(cats, 0) & 8) = 0 AND (contains(lower(name), 'er') OR starts_with(ih, 'er')) ORDER BY seeders DESC, doc_id LIMIT 30")
def moderation_search(spark, sf_dir):
    """Visible documents with a text in their name, by seeders, without one category."""
    found = M.listing(scores(spark, sf_dir), 50, 63, "visible", 0, 95, text="er", sort="seeders")
    return found.filter(F.coalesce("cats", F.lit(0)).bitwiseAND(8) == 0).limit(30).select("doc_id", "state", F.lower("name").alias("low"))


@query(
    f"""WITH {SCORES}, a AS (SELECT doc_id, doc_id % 50 AS seq, CASE doc_id % 5 WHEN 0 THEN 'allow' WHEN 1 THEN 'hide' WHEN 2 THEN 'reset' ELSE 'reanalyse' END AS action FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 25, CASE doc_id % 3 WHEN 0 THEN 'hide' WHEN 1 THEN 'reanalyse' ELSE 'reset' END FROM documents),
l AS (SELECT doc_id, arg_max(action, seq) FILTER (action <> 'reanalyse') AS last, bool_or(action = 'reanalyse') AS again FROM a GROUP BY doc_id),
s AS (SELECT scores.* REPLACE (CASE WHEN last IS NULL THEN override WHEN last = 'reset' THEN NULL ELSE last END AS override, done AND NOT again AS done, CASE WHEN again THEN NULL ELSE score END AS score, CASE WHEN again THEN NULL ELSE cats END AS cats) FROM scores JOIN l ON l.doc_id = scores.doc_id)
SELECT doc_id, coalesce(override, '') AS override, done, {POLICY} AS hidden FROM s"""
)
def moderation_overrides(spark, sf_dir):
    """Decisions of moderators, in their order; the last of each document counts."""
    s, i = scores(spark, sf_dir), F.col("doc_id")
    one = s.filter("doc_id % 2 = 0 and doc_id % 50 <> 25").select("doc_id", (i % 50).alias("seq"), F.when(i % 5 == 0, "allow").when(i % 5 == 1, "hide").when(i % 5 == 2, "reset").otherwise("reanalyse").alias("action"))
    two = s.select("doc_id", F.lit(25).cast("long").alias("seq"), F.when(i % 3 == 0, "hide").when(i % 3 == 1, "reanalyse").otherwise("reset").alias("action"))
    return M.override(s, one.unionByName(two)).select("doc_id", F.coalesce("override", F.lit("")).alias("override"), "done", M.policy(50, 63).alias("hidden"))


@query(f"WITH {SCORES} SELECT doc_id FROM scores WHERE NOT done AND NOT deleted AND doc_id >= 50 ORDER BY doc_id DESC LIMIT 100")
def moderation_pending(spark, sf_dir):
    return M.pending(scores(spark, sf_dir), 100, 50).select("doc_id")


@query(f"WITH {SCORES}, h AS (SELECT doc_id FROM scores WHERE {POLICY} UNION SELECT doc_id FROM scores WHERE contains(' ' || array_to_string(regexp_extract_all(lower(strip_accents(name)), '[a-z0-9]+'), ' ') || ' ', ' the ')) SELECT count(*) AS hidden FROM h")
def moderation_hidden_union(spark, sf_dir):
    s = scores(spark, sf_dir)
    by_rule = M.rule_hits(s, [("r", "the", "name", "word")]).select("doc_id")
    return s.filter(M.policy(50, 63)).select("doc_id").union(by_rule).distinct().agg(F.count("*").alias("hidden"))


@query(f"WITH {DOCS}, r AS (SELECT doc_id, seeders, hidden FROM toks WHERE contains(' ' || array_to_string(nt, ' ') || ' ', ' with ')) SELECT doc_id, seeders, (SELECT count(*) FROM r) AS total, (SELECT count(*) FILTER (hidden) FROM r) AS already FROM r ORDER BY seeders DESC, doc_id LIMIT 20")
def rule_preview(spark, sf_dir):
    d = docs(spark, sf_dir)
    hit = M.rule_hits(d, [("r", "with", "name", "word")]).join(d.select("doc_id", "seeders", "hidden"), "doc_id")
    total = hit.agg(F.count("*").alias("total"), F.count_if("hidden").alias("already")).first()
    page = hit.orderBy(F.col("seeders").desc(), "doc_id").limit(20).select("doc_id", "seeders")
    return page.withColumns({"total": F.lit(total.total).cast("long"), "already": F.lit(total.already).cast("long")})


@query(f"WITH {DOCS} SELECT 'the' AS rule_id, count(*) AS n FROM toks WHERE contains(' ' || array_to_string(nt, ' ') || ' ', ' the ') UNION ALL SELECT 'und', count(*) FROM toks WHERE contains(' ' || array_to_string(ft, ' ') || ' ', ' und ')")
def rule_hit_counts(spark, sf_dir):
    return M.rule_hits(docs(spark, sf_dir), [("the", "the", "name", "word"), ("und", "und", "files", "word")]).groupBy("rule_id").agg(F.count("*").alias("n"))


#: 500 rules: words and pairs of words of part names as words of names, of files or of both, and shorter stretches as substrings.
RULE_BOOK = """terms AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part WHERE p_partkey <= 500),
book AS (SELECT 'r' || p_partkey AS rule_id, CASE p_partkey % 4 WHEN 0 THEN w[1] WHEN 1 THEN w[1] || ' ' || w[2] WHEN 2 THEN substr(w[1], 1, 2 + p_partkey % 3) ELSE chr(CAST(97 + p_partkey % 26 AS INT)) || chr(CAST(97 + p_partkey % 7 AS INT)) END AS term,
  CASE p_partkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'files' ELSE 'all' END AS scope, CASE WHEN p_partkey % 4 < 2 THEN 'word' ELSE 'substring' END AS mode FROM terms)"""


def rule_book_of(spark, sf_dir):
    """The rules of RULE_BOOK; 500 at most, which a moderator's list may have."""
    k, w = F.col("p_partkey"), F.split("p_name", " ")
    letter = lambda n: F.char(97 + k % n)
    term = F.when(k % 4 == 0, w[0]).when(k % 4 == 1, F.concat_ws(" ", w[0], w[1])).when(k % 4 == 2, F.substr(w[0], F.lit(1), (2 + k % 3).cast("int"))).otherwise(F.concat(letter(26), letter(7)))
    scope = F.when(k % 3 == 0, "name").when(k % 3 == 1, "files").otherwise("all")
    parts = table(spark, sf_dir, "part").filter(k <= 500)
    rows = parts.select(F.concat(F.lit("r"), k).alias("id"), term.alias("term"), scope.alias("scope"), F.when(k % 4 < 2, "word").otherwise("substring").alias("mode")).orderBy(k).collect()
    return [(r.id, r.term, r.scope, r["mode"]) for r in rows]


@query(
    f"""WITH {DOCS}, {RULE_BOOK}, t AS (SELECT doc_id, lower(strip_accents(name)) AS n, lower(strip_accents(body)) AS f, ' ' || array_to_string(nt, ' ') || ' ' AS nw, ' ' || array_to_string(ft, ' ') || ' ' AS fw FROM toks),
h AS (SELECT rule_id, count(*) AS n FROM t JOIN book ON (scope <> 'files' AND CASE mode WHEN 'word' THEN contains(nw, ' ' || term || ' ') ELSE contains(n, term) END)
  OR (scope <> 'name' AND CASE mode WHEN 'word' THEN contains(fw, ' ' || term || ' ') ELSE contains(f, term) END) GROUP BY rule_id)
SELECT book.rule_id, CAST(coalesce(h.n, 0) AS BIGINT) AS n FROM book LEFT JOIN h ON h.rule_id = book.rule_id"""
)
def rule_hits_of_many(spark, sf_dir):
    """How many documents each of 500 rules hits, in one pass."""
    return M.hit_counts(docs(spark, sf_dir), rule_book_of(spark, sf_dir))


@query(f"WITH {DOCS} SELECT category, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM docs WHERE NOT deleted GROUP BY category")
def catalogue_categories(spark, sf_dir):
    return docs(spark, sf_dir).filter("not deleted").groupBy("category").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {DOCS} SELECT count(*) AS docs, CAST(sum(file_count) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(seeders) AS BIGINT) AS seeders, CAST(sum(peers) AS BIGINT) AS peers, count(*) FILTER (seeders = 0) AS no_seeds, count(*) FILTER (src = 'scrape') AS verified, round(100.0 * count(*) FILTER (src = 'scrape') / count(*), 6) AS verified_percent FROM docs WHERE NOT deleted")
def catalogue_totals(spark, sf_dir):
    d, verified = docs(spark, sf_dir).filter("not deleted"), F.count_if(F.col("src") == "scrape")
    sums = [F.sum(a).alias(b) for a, b in (("file_count", "files"), ("size", "bytes"), ("seeders", "seeders"), ("peers", "peers"))]
    return d.agg(F.count("*").alias("docs"), *sums, F.count_if(F.col("seeders") == 0).alias("no_seeds"), verified.alias("verified"), F.round(100.0 * verified / F.count("*"), 6).alias("verified_percent"))


@query(f"WITH {DOCS}, b AS (SELECT CASE WHEN seeders <= 0 THEN '0' WHEN seeders <= 5 THEN '1-5' WHEN seeders <= 50 THEN '6-50' ELSE 'more' END AS label FROM docs), l(label) AS (VALUES ('0'), ('1-5'), ('6-50'), ('more')) SELECT l.label, count(b.label) AS n FROM l LEFT JOIN b ON b.label = l.label GROUP BY l.label")
def catalogue_seed_buckets(spark, sf_dir):
    """All buckets in one pass, empty ones too."""
    labels = ["0", "1-5", "6-50", "more"]
    at = bucket(F.col("seeders"), [0, 5, 50], labels, inclusive=True)
    wide = docs(spark, sf_dir).agg(*(F.count_if(at == x).alias(x) for x in labels))
    return wide.unpivot([], labels, "label", "n")


@query(f"WITH {DOCS} SELECT doc_id, name, seeders FROM live WHERE src = 'scrape' ORDER BY seeders DESC, doc_id LIMIT 8")
def catalogue_top_seeded(spark, sf_dir):
    return docs(spark, sf_dir).filter("not deleted and not hidden and src = 'scrape'").orderBy(F.col("seeders").desc(), "doc_id").limit(8).select("doc_id", "name", "seeders")


LAST = f"WITH {CHANGES}, last AS (SELECT ih, arg_max(t, seq) AS t, max(seq) AS seq, arg_max(size, seq) AS size, arg_max(category, seq) AS category FROM log WHERE t IN ('n', 'd') GROUP BY ih), alive AS (SELECT * FROM last WHERE t = 'n')"


@query(LAST + "SELECT ih, seq, size, category FROM alive")
def change_log_compaction(spark, sf_dir):
    return H.latest(changes(spark, sf_dir))


@query(LAST + ", h AS (SELECT log.ih, log.seq FROM log JOIN alive ON alive.ih = log.ih AND log.seq > alive.seq WHERE log.t = 'h') SELECT ih, count(*) AS n FROM h GROUP BY ih")
def change_log_later_health(spark, sf_dir):
    log = changes(spark, sf_dir)
    alive = H.latest(log).select("ih", F.col("seq").alias("since"))
    return log.filter("t = 'h'").join(alive, "ih").filter("seq > since").groupBy("ih").agg(F.count("*").alias("n"))


@query(LAST + " SELECT ih FROM alive WHERE ih NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)")
def import_new_keys(spark, sf_dir):
    here = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("ih"))
    return H.latest(changes(spark, sf_dir)).join(here, "ih", "left_anti").select("ih")


@query(
    LAST
    + """, here AS (SELECT c_custkey AS ih FROM customer WHERE c_custkey % 4 = 0), imported AS (SELECT ih FROM alive WHERE ih NOT IN (SELECT ih FROM here) AND category <> '1-URGENT'),
after AS (SELECT ih FROM here UNION ALL SELECT ih FROM imported UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 40 = 1 AND c_custkey NOT IN (SELECT ih FROM imported))
SELECT ih FROM after WHERE ih NOT IN (SELECT ih FROM imported)"""
)
def import_undo(spark, sf_dir):
    """After an import and some keys added since, exactly the imported keys go: those that were here or came later stay."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ih"))
    here = customers.filter("ih % 4 = 0")
    imported = H.latest(changes(spark, sf_dir)).filter("category <> '1-URGENT'").select("ih").join(here, "ih", "left_anti")
    later = customers.filter("ih % 40 = 1").join(imported, "ih", "left_anti")
    return here.unionAll(imported).unionAll(later).join(imported, "ih", "left_anti")


@query("WITH u AS (SELECT c_custkey AS id FROM customer UNION SELECT s_suppkey FROM supplier) SELECT id FROM u ORDER BY id LIMIT 100000")
def import_node_union(spark, sf_dir):
    return O.node_union(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "supplier").select("s_suppkey"))


@query("WITH q AS (SELECT event_type AS queue, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) SELECT queue, event_id FROM q WHERE rn <= 50")
def discovery_queues(spark, sf_dir):
    """Bounded queues: the newest entries of each, last in first out."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("event_type").orderBy(F.col("event_id").desc())
    return table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(order)).filter("rn <= 50").select(F.col("event_type").alias("queue"), "event_id")


@query(f"WITH {DOCS} SELECT doc_id, round(100 * (exp(-1.0 - doc_id % 3) + 0.5 * exp(-2.0)) / (exp(-1.0 - doc_id % 3) + exp(-2.0) + exp(-0.5))) AS score, CASE WHEN file_count > 0 THEN CAST(ceil(size / file_count) AS BIGINT) ELSE 0 END AS pieces, least(greatest(size, 100), 5000) AS clamped FROM docs")
def number_functions(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", N.score(-1.0 - F.col("doc_id") % 3, F.lit(-2.0), F.lit(-0.5)).alias("score"), N.pieces(F.col("size"), F.col("file_count")).alias("pieces"), N.clamp(F.col("size"), 100, 5000).alias("clamped"))


UNITS = ["gb", " KB", "h", "d", "", " parsecs", "m", "tb"]


@query(
    f"""WITH u AS (SELECT p_partkey, p_size, {UNITS!r}[1 + p_partkey % 8] AS unit, CASE WHEN p_partkey % 3 = 0 THEN ',5' WHEN p_partkey % 3 = 1 THEN '.25' ELSE '' END AS part FROM part),
v AS (SELECT p_partkey, p_size || part || unit AS text, lower(trim(unit)) AS unit, CAST(p_size || replace(part, ',', '.') AS DOUBLE) AS x FROM u)
SELECT p_partkey, text, CAST(coalesce(trunc(x * CASE unit WHEN 'gb' THEN 1073741824 WHEN 'kb' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'tb' THEN 1099511627776 WHEN '' THEN 1 END), -1) AS BIGINT) AS size_value,
CAST(coalesce(trunc(x * CASE unit WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 WHEN 'm' THEN 60 WHEN '' THEN 1 END), -1) AS BIGINT) AS age_value FROM v"""
)
def unit_literals(spark, sf_dir):
    """Sizes of parts as users write numbers with units: as sizes and as ages, -1 where the unit isn't one."""
    k = F.col("p_partkey")
    text = F.concat(F.col("p_size"), F.when(k % 3 == 0, ",5").when(k % 3 == 1, ".25").otherwise(""), F.get(F.array(*map(F.lit, UNITS)), (k % 8).cast("int")))
    value = lambda units, default: F.coalesce(N.literal(F.col("text"), units, default), F.lit(-1))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text")).select("p_partkey", "text", value(N.SIZE_UNITS, "b").alias("size_value"), value(N.AGE_UNITS, "s").alias("age_value"))


@query(f"WITH {OBSERVATIONS} SELECT DISTINCT ip, (ip // 16777216) || '.' || (ip // 65536 % 256) || '.' || (ip // 256 % 256) || '.' || (ip % 256) AS address, false AS is_global FROM obs")
def address_functions(spark, sf_dir):
    o = observations(spark, sf_dir).select("ip").distinct().withColumn("address", N.ipv4_text(F.col("ip")))
    return o.filter(N.ipv4(F.col("address")) == F.col("ip")).select("ip", "address", N.is_global(F.col("ip")).alias("is_global"))


@query("WITH c AS (SELECT item_id, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1F<>|]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM benchmark) SELECT item_id, substr(t, 1, 120) AS text FROM c")
def cleaned_texts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", clean(F.col("text"), 120).alias("text"))


@query("WITH m AS (SELECT p_partkey, (CASE WHEN contains(p_name, 'red') THEN 1 ELSE 0 END) + (CASE WHEN contains(p_name, 'blue') THEN 2 ELSE 0 END) + (CASE WHEN contains(p_name, 'small') THEN 4 ELSE 0 END) AS mask FROM part) SELECT p_partkey, CAST(mask AS BIGINT) AS mask, concat_ws(',', CASE WHEN mask & 1 <> 0 THEN 'red' END, CASE WHEN mask & 2 <> 0 THEN 'blue' END, CASE WHEN mask & 4 <> 0 THEN 'small' END) AS names FROM m")
def bit_masks(spark, sf_dir):
    known = ["red", "blue", "small"]
    hit = F.filter(F.array(*map(F.lit, known)), lambda k: F.contains(F.col("p_name"), k))
    p = table(spark, sf_dir, "part").select("p_partkey", N.to_mask(hit, known).cast("long").alias("mask"))
    return p.select("p_partkey", "mask", F.array_join(N.from_mask(F.col("mask").cast("int"), known), ",").alias("names"))


@query("SELECT s_suppkey, 'magnet:?xt=urn:btih:' || sha1(CAST(s_suppkey AS VARCHAR)) || '&dn=' || replace(replace(s_name, '#', '%23'), ' ', '%20') || '&tr=udp%3A%2F%2Ft' || s_nationkey || '%2Fannounce' AS link FROM supplier")
def magnet_links(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    url = F.concat(F.lit("udp://t"), F.col("s_nationkey").cast("string"), F.lit("/announce"))
    return s.select("s_suppkey", magnet(F.sha1(F.col("s_suppkey").cast("string").cast("binary")), F.col("s_name"), F.array(url, url)).alias("link"))


@query(f"WITH {FILES} SELECT o_orderkey AS doc_id, count(files.doc_id) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM orders LEFT JOIN files ON files.doc_id = o_orderkey GROUP BY o_orderkey")
def nested_file_totals(spark, sf_dir):
    return items(spark, sf_dir).select("doc_id", F.size("files").cast("long").alias("n_files"), F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["size"]).alias("bytes"))
