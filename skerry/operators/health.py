"""Health measurements of a key: fold into current state, bounded history, verdicts and the next check.

A key's measurements are cut into stretches of time, and a stretch is summed up by itself: what it does to the scrape that
is held when it begins, and, once that is known, its newest applied measurements. Sums of stretches add up in their order
to the sum of a key, and on to a stored state. No window or group holds a key's measurements, so a hot one spreads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds.
KEEP_S, HISTORY, DEAD_RUN, DEAD_SPAN_S, DEAD_TRACKERS = 14 * 86_400, 40, 3, 12 * 3600, 2
INTERVAL_S = {"alive": 6 * 3600, "weak": 12 * 3600, "quiet": 6 * 3600, "dead": 3 * 86_400}
BACKOFF_S, BACKOFF_MAX_S, UNKNOWN_MOST, FORCED = 1800, 259_200, 255, 1000


#: Seconds of a stretch: what one task sees of a key at once. Results are the same for any; shorter ones spread a hot key wider and cost more sums.
STRETCH_S = 7 * 86_400
ENTRY = "struct<mt:bigint,event_id:bigint,seeders:bigint,peers:bigint,src:string,nrep:bigint>"
STATE = f"ih bigint, seeders bigint, peers bigint, src string, health_at bigint, checked_at bigint, seed_ok_at bigint, n_kept bigint, history array<{ENTRY}>"


def cleaned(measured: DataFrame, stretch_s: int = STRETCH_S) -> DataFrame:
    """measured with figures not below 0, an answer of one tracker where that isn't known, and the stretch that it is in.

    measured: ih, mt, event_id, seeders, peers, src, and, if known, nrep (trackers that answered) and cs (seeders connected to).
    """
    extra = {c: F.lit(None) for c in ("nrep", "cs") if c not in measured.columns}
    figure = lambda c, least: F.greatest(F.coalesce(F.col(c), F.lit(least)), F.lit(least)).cast("long").alias(c)
    answers = F.coalesce(F.col("nrep"), F.lit(1)).cast("long").alias("nrep")
    m = measured.withColumns(extra).select("ih", F.col("mt").cast("long").alias("mt"), F.col("event_id").cast("long").alias("event_id"), figure("seeders", 0), figure("peers", 0), "src", answers, figure("cs", 0))
    return m.withColumn("stretch", F.floor(F.col("mt") / stretch_s)).withColumn("scrape", F.col("src").eqNullSafe("scrape"))


def in_order(descending: bool = False) -> list[Column]:
    """Order of a key's measurements."""
    return [F.col(c).desc() if descending else F.col(c) for c in ("mt", "event_id", "seeders", "peers", "src")]


def within(*keys: str) -> Window:
    """A key's measurements of one stretch, up to each one."""
    return Window.partitionBy("ih", "stretch", *keys).orderBy(*in_order()).rowsBetween(Window.unboundedPreceding, 0)


def skipped(hold: Column) -> Column:
    """Whether a measurement only counts as a check: one by another way than a scrape that finds fewer seeders than the scrape that is held."""
    return F.coalesce(~F.col("scrape") & (F.col("mt") - hold.mt < KEEP_S) & (F.col("seeders") < hold.seeders), F.lit(False))


def summaries(m: DataFrame) -> DataFrame:
    """What a stretch does to what is held, in one row (ih, stretch, resets, hold, most, latest).

    A stretch with a scrape (resets) leaves hold, its last scrape, or null if a later measurement has ended that. Any other leaves what was held
    before, unless its most seeders or its latest time end it. Two rows in order make one in the same way, so that rows of
    any stretches of a key add up.
    """
    held = F.when(F.col("seg") > 0, F.col("held"))
    m = m.withColumns({"seg": F.count_if("scrape").over(within()), "held": F.last(F.when(F.col("scrape"), F.struct("seeders", "mt")), ignorenulls=True).over(within())})
    m = m.withColumn("ends", ~F.col("scrape") & ~skipped(F.col("held")))
    ended = F.max(F.when(F.col("seg") > 0, F.struct("seg", F.col("ends").alias("ended"))))  # of the last scrape's measurements, whether any ends it
    by = F.struct("mt", "event_id", "seeders", "peers", "src")
    found = m.withColumn("held", held).groupBy("ih", "stretch").agg(
        F.bool_or("scrape").alias("resets"), ended.alias("last"), F.max_by("held", by).alias("hold"), F.max("seeders").alias("most"), F.max("mt").alias("latest")
    )
    return found.select("ih", "stretch", "resets", F.when(~F.col("last.ended"), F.col("hold")).alias("hold"), "most", "latest")


def holds(stretches: DataFrame) -> DataFrame:
    """(ih, stretch, before): the scrape that is held when a stretch begins, or null. One row for each stretch travels by key."""
    earlier = lambda *keys: Window.partitionBy("ih", *keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    since = F.coalesce(F.count_if("resets").over(earlier()), F.lit(0))
    last = F.last(F.when(F.col("resets"), F.struct("hold")), ignorenulls=True).over(earlier())["hold"]
    s = stretches.withColumns({"since": since, "last": last})
    quiet = {"most": F.max(F.when(~F.col("resets"), F.col("most"))).over(earlier("since")), "latest": F.max(F.when(~F.col("resets"), F.col("latest"))).over(earlier("since"))}
    s = s.select("ih", "stretch", "last", *(c.alias(name) for name, c in quiet.items()))
    ended = F.coalesce((F.col("most") >= F.col("last.seeders")) | (F.col("latest") - F.col("last.mt") >= KEEP_S), F.lit(False))
    return s.select("ih", "stretch", F.when(~ended, F.col("last")).alias("before"))


def applied(m: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """cleaned() measurements with kept: whether each is applied, in the order of (mt, event_id), after the stored states.

    A measurement by another way than a scrape that finds fewer seeders than a scrape of the last 14 days only counts as a
    check. After a scrape, the first other measurement that isn't skipped ends its hold, and all up to the next scrape are kept.
    """
    stretches = summaries(m)
    if stored is not None:
        hold = F.when(F.col("src") == "scrape", F.struct("seeders", F.col("health_at").alias("mt")))
        nothing = F.lit(None).cast("bigint")
        stretches = stretches.unionByName(stored.select("ih", nothing.alias("stretch"), F.lit(True).alias("resets"), hold.alias("hold"), nothing.alias("most"), nothing.alias("latest")))
    before = holds(stretches).filter("stretch is not null").select(F.col("ih").alias("__ih"), F.col("stretch").alias("__stretch"), "before")
    m = m.join(before, (F.col("ih") == F.col("__ih")) & (F.col("stretch") == F.col("__stretch"))).drop("__ih", "__stretch")
    m = m.withColumns({"seg": F.count_if("scrape").over(within()), "held": F.last(F.when(F.col("scrape"), F.struct("seeders", "mt")), ignorenulls=True).over(within())})
    m = m.withColumn("ends", ~F.col("scrape") & ~skipped(F.coalesce("held", "before")))
    ended = F.col("scrape") | F.bool_or("ends").over(within("seg"))
    return m.withColumn("kept", ended | (F.col("held").isNull() & F.col("before").isNull())).drop("seg", "held", "before", "ends")


def states(measured: DataFrame, stored: DataFrame | None = None, stretch_s: int = STRETCH_S) -> DataFrame:
    """STATE of each key after its measurements: the figures of the last one applied, when it was checked and found seeded last (0: never), how many were
    applied, and the history: the newest HISTORY applied ones, newest first, one for each time (the last).

    stored: states so far, whose keys may have no measurements now; measured are all later than what is in them. Rows without a key are left out.
    A stretch of a key is summed up by itself, and only these sums travel by key: at most HISTORY entries for each stretch,
    and none for stretches that are older than HISTORY newer ones.
    """
    m = applied(cleaned(measured.filter("ih is not null"), stretch_s), stored)
    newest = Window.partitionBy("ih", "stretch").orderBy(*in_order(descending=True))
    later = F.last(F.when(F.col("kept"), F.col("mt")), ignorenulls=True).over(newest.rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("one", F.col("kept") & ~F.coalesce(later == F.col("mt"), F.lit(False)))
    m = m.withColumn("n", F.count_if("one").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    entry = F.struct("mt", "event_id", "seeders", "peers", "src", "nrep")
    sums = m.groupBy("ih", "stretch").agg(
        F.max_by(F.struct("seeders", "peers", "src", F.col("mt").alias("health_at")), F.when(F.col("kept"), F.struct("mt", "event_id", "seeders", "peers", "src"))).alias("s"),
        F.max("mt").alias("checked_at"),
        F.max(F.when(F.col("cs") > 0, F.col("mt"))).alias("seed_ok_at"),
        F.count_if("kept").alias("n_kept"),
        F.collect_list(F.when(F.col("one") & (F.col("n") <= HISTORY), entry)).alias("history"),
    )
    if stored is not None:
        now = F.when(F.col("health_at").isNotNull(), F.struct("seeders", "peers", "src", "health_at"))
        sums = sums.unionByName(stored.select("ih", F.lit(None).cast("bigint").alias("stretch"), now.alias("s"), "checked_at", "seed_ok_at", "n_kept", "history"))
    after = Window.partitionBy("ih").orderBy(F.col("stretch").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("newer", F.coalesce(F.sum(F.size("history")).over(after), F.lit(0)))
    # one time may stand in the stored history and in the first stretch, so that one entry more is carried than is kept
    carried = F.when(F.col("newer") <= HISTORY, F.struct(F.coalesce("stretch", F.lit(-(2**62))).alias("stretch"), "history"))
    parts = F.sort_array(F.collect_list(carried), asc=False)
    every = F.flatten(F.transform(parts, lambda p: F.sort_array(p.history, asc=False)))
    found = sums.groupBy("ih").agg(
        F.max_by("s", F.when(F.col("s").isNotNull(), F.coalesce("stretch", F.lit(-(2**62))))).alias("s"), F.max("checked_at").alias("checked_at"), F.coalesce(F.max("seed_ok_at"), F.lit(0)).cast("long").alias("seed_ok_at"),
        F.sum("n_kept").alias("n_kept"), every.alias("every"),
    )
    single = F.filter("every", lambda e, i: (i == 0) | (F.get(F.col("every"), i - 1).mt != e.mt))
    return found.select("ih", "s.*", "checked_at", "seed_ok_at", "n_kept", F.slice(single, 1, HISTORY).alias("history"))


def confirmed_zero(entry: Column) -> Column:
    """A scrape that found nobody, answered by enough trackers."""
    return F.coalesce((entry.src == "scrape") & (entry.seeders == 0) & (entry.peers == 0) & (entry.nrep >= DEAD_TRACKERS), F.lit(False))


def flagged(current: DataFrame) -> DataFrame:
    """States with what the history says: run and span of its newest confirmed zeros, dead, and unk, how many of its newest came without a scrape's answer."""
    first = lambda holds: F.coalesce(F.array_min(F.filter(F.transform("history", lambda e, i: F.when(holds(e), i)), lambda i: i.isNotNull())), F.size("history"))
    run = first(lambda e: ~confirmed_zero(e))
    span = F.when(F.col("run") > 0, F.element_at("history", 1).mt - F.get("history", (F.col("run") - 1).cast("int")).mt).otherwise(0)
    dead = (F.col("run") >= DEAD_RUN) & (F.col("span") >= DEAD_SPAN_S)
    unk = F.least(F.lit(UNKNOWN_MOST), first(lambda e: e.src.eqNullSafe("scrape")))
    return current.withColumn("run", run.cast("long")).withColumn("span", span.cast("long")).withColumn("dead", dead).withColumn("unk", unk.cast("long"))


def summary(measured: DataFrame) -> DataFrame:
    """One row for each key: seeders, peers, src, health_at, checked_at, seed_ok_at, n_kept, run, span, dead, unk, as states() and flagged() have them."""
    return flagged(states(measured)).drop("history")


def fold(measured: DataFrame) -> DataFrame:
    """Current state of each key after its measurements."""
    return states(measured).drop("history")


def fold_into(stored: DataFrame, measured: DataFrame) -> DataFrame:
    """Stored states after later measurements, without those that are in them already: states() of both. Keys without new ones stay as they are."""
    return states(measured, stored)


def entries(current: DataFrame, most: int = HISTORY) -> DataFrame:
    """The histories of states, with their place rn from the newest on."""
    placed = current.select("ih", F.posexplode(F.slice("history", 1, most)).alias("at", "e"))
    return placed.select("ih", "e.*", (F.col("at") + 1).cast("long").alias("rn"))


def history(measured: DataFrame, most: int = HISTORY) -> DataFrame:
    """The last applied measurements of each key, at most HISTORY, one for each time, with their place rn from the newest on."""
    return entries(states(measured), most)


def restored(current: DataFrame) -> DataFrame:
    """Figures of each key from the newest entry of its history, and dead and unk from all of it: what is left when only histories are."""
    newest = F.element_at("history", 1)
    kept = flagged(current.filter(F.size("history") > 0))
    return kept.select("ih", newest.mt.alias("health_at"), newest.seeders.alias("seeders"), newest.peers.alias("peers"), newest.src.alias("src"), "dead", "unk")


def dead_keys(measured: DataFrame) -> DataFrame:
    """(ih, run, span, dead) of the keys whose newest applied measurements are confirmed zeros."""
    return summary(measured).filter("run > 0").select("ih", "run", "span", "dead")


def unknown_run(measured: DataFrame) -> DataFrame:
    """(ih, unk): how many of the newest applied measurements came without a scrape's answer, at most UNKNOWN_MOST."""
    return summary(measured).select("ih", "unk")


def health_state(dead: Column | None = None) -> Column:
    """Five-state verdict of the current figures; dead: the key's flag, by default the column of that name."""
    dead = F.col("dead") if dead is None else dead
    return (
        F.when(F.coalesce(F.col("src"), F.lit("none")) == "none", "unknown")
        .when(F.col("seeders") > 0, "alive")
        .when(F.col("peers") > 0, "weak")
        .when(F.col("src") != "scrape", "unknown")
        .when(dead, "dead")
        .otherwise("quiet")
    )


def backoff(run: Column) -> Column:
    return F.least(F.lit(BACKOFF_MAX_S), BACKOFF_S * F.pow(F.lit(2.0), F.least(run, F.lit(8))).cast("long"))


def due_at(state: Column, run: Column) -> Column:
    """When a key is to be measured next."""
    wait = backoff(run)
    for name, seconds in INTERVAL_S.items():
        wait = F.when(state == name, F.lit(seconds)).otherwise(wait)
    return F.greatest("health_at", "checked_at") + wait


def verdicts(measured: DataFrame) -> DataFrame:
    """summary() with state and due_at."""
    full = summary(measured).withColumn("state", health_state())
    return full.withColumn("due_at", due_at(F.col("state"), F.col("unk")).cast("long"))


def defer(current: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """current (verdicts) with the given keys counted as checked now, and due again from then on."""
    put_off = current.join(keys.select("ih", F.lit(now).cast("long").alias("__now")).distinct(), "ih", "left")
    put_off = put_off.withColumn("checked_at", F.greatest("checked_at", F.coalesce("__now", "checked_at"))).drop("__now")
    return put_off.withColumn("due_at", due_at(F.col("state"), F.col("unk")).cast("long"))


def forced(requests: DataFrame, now: int, most: int = FORCED) -> DataFrame:
    """(ih, checked_at) of the first `most` keys that were asked for (ih, seq), each once, in the order of their first request."""
    first = requests.groupBy("ih").agg(F.min("seq").alias("seq"))
    return first.orderBy("seq", "ih").limit(most).select("ih", F.lit(now).alias("checked_at"))


def latest(changes: DataFrame) -> DataFrame:
    """Live keys of a change log: the last of new and delete events, if it isn't a delete."""
    last = changes.filter("t in ('n', 'd')").groupBy("ih").agg(F.max_by(F.struct("seq", "t", "size", "category"), "seq").alias("r"))
    return last.filter("r.t = 'n'").select("ih", "r.seq", "r.size", "r.category")
