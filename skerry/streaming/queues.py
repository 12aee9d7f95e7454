"""Bounded queues of keys to be probed, as a stream with state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skerry.streaming.state import with_state_store

#: The queues in the order that they are asked in, and the most keys of each.
QUEUES, MOST = ("peer", "prio", "getpeers", "other"), 20_000
OUT = "node long, seq long, event string, queue string, ih long"


class Held:
    """A map state whose entries are read at most once for each micro-batch, and written, if they changed, at its end."""

    def __init__(self, state: Any):
        self.state, self.now, self.was = state, {}, {}

    def get(self, *key: Any) -> Any:
        """The one value of an entry, or None."""
        if key not in self.now:
            self.now[key] = self.was[key] = self.state.getValue(key)[0] if self.state.containsKey(key) else None
        return self.now[key]

    def put(self, value: Any, *key: Any) -> None:
        self.get(*key)
        self.now[key] = value

    def put_new(self, value: Any, *key: Any) -> None:
        """An entry that isn't in the state."""
        self.was.setdefault(key, None)
        self.now[key] = value

    def drop(self, *key: Any) -> None:
        """Remove an entry that won't be asked for again; one of this micro-batch alone is forgotten, so that what is held doesn't grow with the events."""
        if self.was.get(key) is None:
            self.now.pop(key, None)
            self.was.pop(key, None)
        else:
            self.now[key] = None

    def flush(self) -> None:
        for key, value in self.now.items():
            if value is None and self.was[key] is not None:
                self.state.removeKey(key)
            elif value != self.was[key]:
                self.state.updateValue(key, (value,))


class Queues(StatefulProcessor):
    """Queues of one node. Events in the order of seq: put (ih, queue), which makes an unknown key pending; take, which gets the newest key of the first
    queue that has a pending one and makes it probing; done (ih), after which the key is known but not pending.

    A key stands in a queue once. A queue that is full drops its oldest; a dropped key that waits in no other queue is
    forgotten, if it is pending. Keys that are no longer pending are passed over when their turn comes. Puts out what was taken and
    what was forgotten.

    A queue is a map from places to keys with the places of its ends, so that an event touches a few entries, however long it is;
    an entry goes to the state store once for each micro-batch, however many events touch it.
    """

    def __init__(self, most: int = MOST):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "queue string, place long", "ih long")
        self.inside = handle.getMapState("inside", "queue string, ih long", "place long")
        self.ends = handle.getMapState("ends", "queue string", "low long, high long")
        self.pending = handle.getMapState("pending", "ih long", "pending boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq")
        out = []
        held = [Held(state) for state in (self.slots, self.inside, self.pending)]
        self.slot, self.place, self.waits = held
        ends = {q: list(self.ends.getValue((q,))) if self.ends.containsKey((q,)) else [0, 0] for q in QUEUES}
        for seq, event, queue, ih in zip(*(events[c].tolist() for c in ("seq", "event", "queue", "ih"))):
            if event == "put":
                out += [(key[0], seq, "forgotten", queue, x) for x in self.put(ends[queue], queue, int(ih))]
            elif event == "done":
                self.waits.put(False, int(ih))
            else:
                out.append((key[0], seq, "taken", *self.take(ends)))
        for entries in held:
            entries.flush()
        for q in QUEUES:
            self.ends.updateValue((q,), tuple(ends[q]))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")]).astype({"ih": "Int64"})

    def put(self, ends: list[int], queue: str, ih: int) -> list[int]:
        """The keys that are forgotten for it."""
        if self.waits.get(ih) is None:
            self.waits.put(True, ih)
        if self.place.get(queue, ih) is not None:
            return []
        self.slot.put_new(ih, queue, ends[1])
        self.place.put(ends[1], queue, ih)
        ends[1] += 1
        forgotten = []
        while ends[1] - ends[0] > self.most:
            old = self.leave(queue, ends[0])
            ends[0] += 1
            if self.waits.get(old) and all(self.place.get(q, old) is None for q in QUEUES):
                self.waits.put(None, old)
                forgotten.append(old)
        return forgotten

    def leave(self, queue: str, place: int) -> int:
        ih = self.slot.get(queue, place)
        self.slot.drop(queue, place)
        self.place.put(None, queue, ih)
        return ih

    def take(self, ends: dict[str, list[int]]) -> tuple[str | None, int | None]:
        for q in QUEUES:
            while ends[q][1] > ends[q][0]:
                ends[q][1] -= 1
                ih = self.leave(q, ends[q][1])
                if self.waits.get(ih):
                    self.waits.put(False, ih)
                    return q, ih
        return None, None

    def close(self) -> None:
        pass


def queues(events: DataFrame, most: int = MOST) -> DataFrame:
    """What is taken and forgotten, of a stream of events (node, seq, event, queue, ih). Nodes have queues of their own."""
    with_state_store(events.sparkSession)
    rows = events.select("node", "seq", "event", F.coalesce("queue", F.lit("")).alias("queue"), F.coalesce("ih", F.lit(0)).cast("long").alias("ih"))
    return rows.groupBy("node").transformWithStateInPandas(Queues(most), T._parse_datatype_string(OUT), "Update", "None")
