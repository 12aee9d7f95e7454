"""Stateful streams against plain versions, in several micro-batches and across restarts."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from skerry.operators import observations as O
from skerry.operators import series as T
from skerry.streaming import peers, queues, rollup

OBSERVED = "ih long, ip long, ts long, port int, role int, client string, src string"


def run_in_parts(spark, tmp_path, schema, rows, parts, make, mode="update"):
    """The changes of a stream over rows that arrive in parts; each part is a run of its own, from the same checkpoint."""
    source, out = str(tmp_path / "in"), None
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(source)
        out = rollup.drained(make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)), str(tmp_path / "out"), mode)
    return out


def sights(seed, n, keys=3, ips=6, step=500):
    rng, t, rows = random.Random(seed), 1_000_000, []
    for _ in range(n):
        t += rng.randrange(1, step)
        rows.append((rng.randrange(keys), rng.randrange(ips), t, rng.choice([0, 7, 8, 9]), rng.choice([-1, -1, 0, 1]), rng.choice(["", "x", "y"]), rng.choice("ccdda")))
    return rows


def addresses(frame):
    return sorted((r.ih, r.ip, r.role, r.port, r.client, r.src, r.first, r.last) for r in frame.collect())


def test_peers_are_the_merged_ones_across_restarts(spark, tmp_path):
    rows = sights(1, 400, step=9_000)
    found = run_in_parts(spark, tmp_path, OBSERVED, rows, 4, lambda s: peers.peers(s, flush_s=-1))
    want = O.persisted(O.merge(spark.createDataFrame(rows, OBSERVED)))
    assert addresses(peers.current(found)) == addresses(want)


def test_full_keys_lose_their_oldest_address(spark, tmp_path):
    """The cap against a plain fold of one observation after another."""
    rows = sights(2, 300, ips=9)
    kept = defaultdict(dict)
    for ih, ip, ts, port, role, client, src in sorted(rows, key=lambda r: r[2]):
        held = kept[ih]
        if ip not in held:
            if len(held) == 4:
                del held[min(held, key=lambda i: (held[i]["last"], i))]
            held[ip] = {"role": role, "port": port, "by": src == "c" and port > 0, "client": client, "src": 0, "first": ts, "last": ts}
        a = held[ip]
        if src == "c" and port:
            a |= {"port": port, "by": True}
        a |= {"role": max(role, a["role"]), "client": client or a["client"], "src": a["src"] | {"c": 1, "d": 2, "a": 4}[src], "last": ts}
    want = sorted((ih, ip, a["role"], a["port"], a["client"], a["src"], a["first"], a["last"]) for ih, held in kept.items() for ip, a in held.items() if a["src"] != 2 or a["role"] != -1)
    found = run_in_parts(spark, tmp_path, OBSERVED, rows, 3, lambda s: peers.peers(s, most=4, flush_s=-1))
    assert addresses(peers.current(found)) == want


def test_later_sights_wait_an_hour_and_old_addresses_go(spark, tmp_path):
    """A sight within the hour is put out by the timer only; after the time to keep, the address goes."""
    t = 1_000_000
    rows = [(1, 5, t, 7, 1, "x", "c"), (1, 5, t + 60, 7, 1, "x", "c"), (2, 6, t + 8_000, 7, 1, "x", "c"), (2, 6, t + 50_000, 7, 1, "x", "c"), (3, 6, t + 200_000, 7, 1, "x", "c"), (3, 6, t + 200_001, 7, 1, "x", "c")]
    found = run_in_parts(spark, tmp_path, OBSERVED, rows, 6, lambda s: peers.peers(s, late="0 seconds", keep_s=100_000))
    changes = [(r.ih, r.last - t, r.gone) for r in found.orderBy("batch", "ih", "last").collect()]
    assert changes.count((1, 0, False)) == 1 and changes.count((1, 60, False)) == 1 and (1, 60, True) in changes
    assert changes.index((1, 60, False)) > changes.index((2, 8_000, False)) or changes.index((1, 60, False)) > 0
    assert [(r.ih, r.ip) for r in peers.current(found).orderBy("ih").collect()] == [(3, 6)]


def plain_queues(events, most):
    """Queues as lists, one event after another."""
    order = ("peer", "prio", "getpeers", "other")
    out, nodes = [], defaultdict(lambda: ({q: [] for q in order}, {}))
    for node, seq, event, queue, ih in sorted(events, key=lambda e: e[1]):
        lists, status = nodes[node]
        if event == "done":
            status[ih] = False
        elif event == "put":
            status.setdefault(ih, True)
            if ih in lists[queue]:
                continue
            lists[queue].append(ih)
            if len(lists[queue]) > most:
                old = lists[queue].pop(0)
                if status.get(old) and not any(old in x for x in lists.values()):
                    del status[old]
                    out.append((node, seq, "forgotten", queue, old))
        else:
            got = (None, None)
            for q in order:
                while lists[q] and got == (None, None):
                    ih = lists[q].pop()
                    if status.get(ih):
                        status[ih], got = False, (q, ih)
            out.append((node, seq, "taken", *got))
    return out


def test_queues_are_plain_lists(spark, tmp_path):
    rng = random.Random(6)
    events = [(rng.randrange(3), seq, rng.choices(["put", "take", "done"], [8, 3, 1])[0], rng.choice(queues.QUEUES), rng.randrange(90)) for seq in range(900)]
    found = run_in_parts(spark, tmp_path, "node long, seq long, event string, queue string, ih long", events, 3, lambda s: queues.queues(s, 3))
    want = plain_queues(events, 3)
    assert sorted(((r.node, r.seq, r.event, r.queue, r.ih) for r in found.collect()), key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"taken", "forgotten"}


def test_queue_query_is_plain_lists(spark, small):
    from skerry.plans import catalogue

    kinds = {"click": "take", "purchase": "take", "error": "done"}
    rows = spark.read.parquet(f"{small}/events.parquet").select("event_id", "user_id", "event_type").collect()
    events = [(r.user_id % 8, r.event_id, kinds.get(r.event_type, "put"), queues.QUEUES[r.event_id % 4], r.event_id * 7919 % 400) for r in rows]
    got = catalogue.queries()["stream_queues"](spark, small).collect()
    assert sorted(((r.node, r.seq, r.event, r.queue, r.ih) for r in got), key=str) == sorted(plain_queues(events, 20), key=str)


def test_tiers_of_a_stream_are_the_batch_tiers(spark, tmp_path):
    """Closed buckets of both tiers once each, over restarts; points later than the watermark are in none."""
    rng, t, rows = random.Random(7), 7_200_000, []
    for n in range(600):
        t += rng.randrange(1, 60)
        rows.append((t - rng.randrange(300), n, rng.choice([None, 0.05, 1.25, 7.0]), rng.choice([None, n])))
    schema = "t long, event_id long, gauge double, counter long"
    stamped = lambda s: rollup.tiers(s.withColumn("ts", F.timestamp_seconds("t")), "10 minutes")
    found = run_in_parts(spark, tmp_path, schema, rows, 4, stamped, "append")
    until = max(r[0] for r in rows) - 600
    batch = spark.createDataFrame(rows, schema)
    for tier, step in (("m5", 300), ("h1", 3600)):
        want = sorted((r.t - step // 2, r.gauge, r.counter, r.n) for r in T.roll_up(batch, step).collect() if r.t + step // 2 <= until)
        got = sorted((r.start, r.gauge, r.counter, r.n) for r in found.filter(F.col("tier") == tier).collect())
        assert got == want and want


def test_late_points_are_dropped_and_counted(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "t long, event_id long, gauge double, counter long"
    dropped = 0
    for k, rows in enumerate([[(7_200_010, 1, 1.0, 1)], [(7_300_000, 2, 1.0, 2)], [(7_200_020, 3, 9.0, 3), (7_400_000, 4, 1.0, 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = rollup.tiers(spark.readStream.schema(schema).parquet(source).withColumn("ts", F.timestamp_seconds("t")), "1 minute")
        found, late = rollup.drained_with_late(stream, str(tmp_path / "out"), "append")
        dropped += late
    assert {(r.tier, r.start, r.gauge, r.n) for r in found.filter("start < 7300000 - 3600").collect()} == {("m5", 7_200_000, 1.0, 1), ("h1", 7_200_000, 1.0, 1)}
    assert dropped >= 1


def test_a_shard_of_many_keys_is_read_once(spark, tmp_path):
    """Keys share shards and their timers, whatever the number of shards; a call for each key would take the query beyond its time."""
    rows = sights(3, 500, keys=40, step=9_000)
    want = addresses(O.persisted(O.merge(spark.createDataFrame(rows, OBSERVED))))
    for shards in (1, 7):
        found = run_in_parts(spark, tmp_path / str(shards), OBSERVED, rows, 2, lambda s: peers.peers(s, flush_s=-1, shards=shards))
        assert addresses(peers.current(found)) == want


def test_an_entry_goes_to_the_state_once_for_each_batch():
    """However often it is read or changed; one that comes and goes within a batch doesn't at all."""

    class State(dict):
        calls = 0

        def containsKey(self, key):
            self.calls += 1
            return key in self

        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def removeKey(self, key):
            self.calls += 1
            del self[key]

    state = State({("old",): (5,), ("gone",): (6,)})
    held = queues.Held(state)
    for n in range(100):
        held.put((held.get("old") or 0) + 1, "old")
        held.put_new(n, "short", n)
        held.drop("short", n)
    assert set(held.now) == {("old",)}
    held.put(None, "gone")
    held.put_new(False, "new")
    held.flush()
    assert state == {("old",): (105,), ("new",): (False,)} and state.calls == 5
