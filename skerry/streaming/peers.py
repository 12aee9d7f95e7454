"""Merged peer observations as a stream with state: the addresses of the keys of a shard, as columns of one row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skerry.operators.observations import KEY_ROWS, SRC_BIT, UNKNOWN_ROLE
from skerry.streaming.state import with_state_store

#: How often at most a later sight alone is put out, and after how long an address goes, in seconds.
FLUSH_S, KEEP_S = 3600, 30 * 86_400
ADDRESS = "role int, port int, port_ts long, connected boolean, client string, client_ts long, src int, first long, last long, written long, waits boolean"
AFTER_ROWS = 1 << 40  # what falls due in a micro-batch comes after its rows
FIELDS = [f.split()[0] for f in ADDRESS.split(", ")]
STATE = ", ".join(f"{name} array<{kind}>" for name, kind in (f.split() for f in f"ih long, ip long, {ADDRESS}".split(", ")))
OUT = "ih long, ip long, role int, port int, client string, src int, first long, last long, gone boolean, change long"
#: Keys are dealt to so many shards, each with a state and a timer of its own; a checkpoint goes on with the number that it began with.
SHARDS, SHARD_ROWS = 4096, 1000

Keys = dict[int, dict[int, dict]]  # what is known of each address of each key


def folder(most: int, flush_s: int, keep_s: int) -> Callable[[tuple[Any, ...], Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Puts out an address of a key when it is new or changes, a later sight alone at most once in flush_s seconds, and when it goes.

    A key that has `most` addresses loses the one seen least lately for a new one; an address goes when it wasn't seen for keep_s.
    Of addresses that only the node network told, and of unknown role, nothing is put out.
    """

    def fold(shard: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys: Keys = {}
        for ih, ip, *values in zip(*state.get) if state.exists else ():
            keys.setdefault(ih, {})[ip] = dict(zip(FIELDS, values))
        events = [] if state.hasTimedOut else [e for f in frames for e in zip(*(f[c].tolist() for c in ("ts", "port", "ip", "ih", "role", "client", "src")))]
        out = []
        for ts, port, ip, ih, role, client, src in sorted(events, key=lambda e: e[:3]):
            known = keys.setdefault(ih, {})
            if ip not in known and len(known) >= most:
                oldest = min(known, key=lambda i: (known[i]["last"], i))
                out.append((ih, oldest, known.pop(oldest), True))
            known[ip], changed = noted(known.get(ip), ts, port, role, client or "", src, flush_s)
            if changed:
                known[ip]["written"] = known[ip]["last"]
                out.append((ih, ip, dict(known[ip]), False))
        now = state.getCurrentWatermarkMs()
        due = fallen_due(keys, now // 1000, flush_s, keep_s)
        keep(state, keys, now, flush_s, keep_s)
        for rows, start in ((out, 0), (due, AFTER_ROWS)):
            if len(put_out := frame(rows, start)):
                yield put_out

    return fold


def fallen_due(keys: Keys, now: int, flush_s: int, keep_s: int) -> list[tuple[int, int, dict, bool]]:
    """Addresses that are to be put out by now, or go."""
    out = []
    for ih, known in keys.items():
        for ip, a in list(known.items()):
            if a["last"] + keep_s <= now:
                out.append((ih, ip, known.pop(ip), True))
            elif a["waits"] and a["written"] + flush_s <= now:
                a |= {"written": a["last"], "waits": False}
                out.append((ih, ip, dict(a), False))
    return out


def keep(state: GroupState, keys: Keys, now: int, flush_s: int, keep_s: int) -> None:
    """Store the addresses, with one timer for all: when the next one is to be put out, or to go."""
    rows = [(ih, ip, *(a[f] for f in FIELDS)) for ih, known in keys.items() for ip, a in known.items()]
    if not rows:
        state.remove()
        return
    state.update(tuple(map(list, zip(*rows))))
    next_due = min(a["written"] + flush_s if a["waits"] else a["last"] + keep_s for known in keys.values() for a in known.values())
    state.setTimeoutTimestamp(max(1000 * next_due, now + 1))


def noted(a: dict | None, ts: int, port: int, role: int, client: str, src: str, flush_s: int) -> tuple[dict, bool]:
    """An address after one more sight, in whatever order sights come, and whether that is to be put out at once."""
    connected = src == "c" and port > 0
    if a is None:
        new = {"role": role, "port": port, "port_ts": ts, "connected": connected, "client": client, "client_ts": ts, "src": SRC_BIT[src]}
        return new | {"first": ts, "last": ts, "written": ts, "waits": False}, True
    was, a = a, dict(a)
    place = (ts, port)
    if connected and (not a["connected"] or place >= (a["port_ts"], a["port"])):
        a |= {"port": port, "port_ts": ts, "connected": True}
    elif not connected and not a["connected"] and place < (a["port_ts"], a["port"]):
        a |= {"port": port, "port_ts": ts}
    if client and (not a["client"] or (ts, client) >= (a["client_ts"], a["client"])):
        a |= {"client": client, "client_ts": ts}
    a |= {"role": max(a["role"], role), "src": a["src"] | SRC_BIT[src], "first": min(a["first"], ts), "last": max(a["last"], ts)}
    changed = any(a[k] != was[k] for k in ("role", "port", "client", "src", "first")) or a["last"] - a["written"] > flush_s
    a["waits"] = not changed and a["last"] > a["written"]
    return a, changed


def frame(rows: list[tuple[int, int, dict, bool]], start: int) -> pd.DataFrame:
    """Rows of OUT, without those that aren't stored; change is their order within a micro-batch."""
    kept = [(ih, ip, *(a[f] for f in ("role", "port", "client", "src", "first", "last")), gone, start + n) for n, (ih, ip, a, gone) in enumerate(rows) if a["src"] != SRC_BIT["d"] or a["role"] != UNKNOWN_ROLE]
    return pd.DataFrame(kept, columns=[f.split()[0] for f in OUT.split(", ")])


def peers(observed: DataFrame, most: int = KEY_ROWS, late: str = "1 hour", flush_s: int = FLUSH_S, keep_s: int = KEEP_S, shards: int = SHARDS) -> DataFrame:
    """Changes of the merged addresses of a stream of observations (ih, ip, ts, port, role, client, src), ts in seconds.

    A key's observations are folded in the order of their time within a micro-batch; sights of one address may come in any order.
    A state is read and written once for each shard that a micro-batch has rows of: about SHARD_ROWS addresses to a shard are a good measure.
    """
    with_state_store(observed.sparkSession)
    timed = observed.withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", late)
    dealt = timed.withColumn("shard", F.pmod(F.xxhash64("ih"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandasWithState(folder(most, flush_s, keep_s), OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def current(changes: DataFrame) -> DataFrame:
    """The addresses that are there after changes, each with the batch that put it out."""
    named = [c for c in changes.columns if c not in ("ih", "ip", "batch", "change")]
    last = changes.groupBy("ih", "ip").agg(F.max_by(F.struct(*named), F.struct("batch", "change")).alias("r"))
    return last.select("ih", "ip", "r.*").filter(~F.col("gone")).drop("gone")
