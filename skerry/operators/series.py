"""Time series: roll-ups, gap-aware down-sampling, counter rates, stitching of tiers, retention and sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.window import Window

from skerry.sources.files import stored_once

#: Retention of each tier in seconds, and its step.
TIERS = {"raw": (86_400, 10), "m5": (30 * 86_400, 300), "h1": (730 * 86_400, 3600)}


DAY = 86_400


def to_tenths(value: Column) -> Column:
    """Rounded to one place, halves to the even digit; as a decimal, so that the order of a sum doesn't show."""
    return F.bround(value.cast("decimal(30,12)"), 1).cast("double")


def roll_up(points: DataFrame, step: int) -> DataFrame:
    """One point for each bucket of step seconds: the gauge's sum over all points (also those without it; null if none has it), counters as last seen."""
    start = F.floor(F.col("t") / step) * step
    mean = to_tenths(F.sum("gauge") / F.count("*"))
    last = F.max_by("counter", F.when(F.col("counter").isNotNull(), F.struct("t", "event_id")))
    return points.groupBy(start.alias("start")).agg(mean.alias("gauge"), last.alias("counter"), F.count("*").alias("n")).select((F.col("start") + step // 2).alias("t"), "gauge", "counter", "n")


STRETCH = 50_000  # rows of a stretch on a series' fullest day


def stretch_width(points: DataFrame, by: str, at: str = "t", most: int = STRETCH) -> int:
    """Seconds of a stretch: a day, or as much of it as has about `most` rows on the fullest day of any series; a second at least.

    Counted eagerly, one number; callers that cut the same points several times take it once.
    """
    fullest = points.groupBy(by, F.floor(F.col(at) / DAY)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return max(1, DAY * most // max(most, fullest))


def bucketed(points: DataFrame, at: str = "t", width: int = DAY) -> DataFrame:
    """points with __b, the stretch of the order that a row lies in. A series' windows run within it, and what they
    need of earlier stretches is carried over from one row for each, so that no task holds a series."""
    return points.withColumn("__b", F.floor(F.col(at) / width))


def previous(points: DataFrame, by: str, *columns: str, width: int | None = None) -> DataFrame:
    """points with prev_<column>, the values of the series' point before, in the order of (t, event_id). width: of stretches; else by stretch_width()."""
    width = width or stretch_width(points, by)
    p, row = bucketed(points, width=width), F.struct(*columns)
    edges = p.groupBy(by, "__b").agg(F.max_by(row, F.struct("t", "event_id")).alias("__e"))
    edges = edges.withColumn("__e", F.lag("__e").over(Window.partitionBy(by).orderBy("__b")))
    p = p.withColumn("__p", F.lag(row).over(Window.partitionBy(by, "__b").orderBy("t", "event_id"))).join(edges, [by, "__b"], "left")
    return p.withColumns({f"prev_{c}": F.coalesce(F.col("__p"), F.col("__e"))[c] for c in columns}).drop("__b", "__p", "__e")


def running(points: DataFrame, by: str, order: tuple[str, ...] = ("t", "event_id"), width: int | None = None, **values: tuple[str, Column]) -> DataFrame:
    """points with a running sum or max of each value (name=("sum" or "max", column)) in the series' order, whose first column stretches go by. width: as in previous()."""
    width = width or stretch_width(points, by, order[0])
    agg = {"sum": F.sum, "max": F.max}
    p = bucketed(points, order[0], width).withColumns({f"__v_{k}": v for k, (_, v) in values.items()})
    totals = p.groupBy(by, "__b").agg(*(agg[how](f"__v_{k}").alias(f"__t_{k}") for k, (how, _) in values.items()))
    before = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"__t_{k}": agg[how](f"__t_{k}").over(before) for k, (how, _) in values.items()})
    inside = Window.partitionBy(by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({f"__v_{k}": agg[how](f"__v_{k}").over(inside) for k, (how, _) in values.items()}).join(totals, [by, "__b"], "left")
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest}
    p = p.withColumns({k: both[how](F.col(f"__v_{k}"), F.col(f"__t_{k}")) for k, (how, _) in values.items()})
    return p.drop("__b", *(f"__{x}_{k}" for k in values for x in "vt"))


def segments(points: DataFrame, gap: int, by: str = "event_type") -> DataFrame:
    """points with seg, which grows where more than gap seconds are missing, and rn within it. by: the series."""
    width = stretch_width(points, by)
    steps = previous(points.withColumn("__one", F.lit(1)), by, "t", width=width)
    steps = steps.withColumn("broken", F.when(F.col("t") - F.col("prev_t") > gap, 1).otherwise(0))
    counted = running(steps, by, width=width, seg=("sum", F.col("broken")), number=("sum", F.col("__one")))
    started = running(counted, by, width=width, start=("max", F.when((F.col("broken") == 1) | F.col("prev_t").isNull(), F.col("number"))))
    return started.withColumn("rn", F.col("number") - F.col("start") + 1).drop("broken", "prev_t", "number", "start", "__one")


def down_sample(points: DataFrame, most: int, step: int, by: str = "event_type", rounded: bool = True) -> DataFrame:
    """At most about `most` points for each series, none across a gap: last time, mean of gauges that are there, to one place if rounded, last counter that is there."""
    mean = F.avg(F.col("gauge").cast("decimal(30,12)"))
    sizes = points.groupBy(by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / most)).alias("g"))
    grouped = segments(points, max(4 * step, 60), by).join(sizes, by).withColumn("grp", F.floor((F.col("rn") - 1) / F.col("g")))
    last = F.max_by("counter", F.when(F.col("counter").isNotNull(), F.struct("t", "event_id")))
    return grouped.groupBy(by, "seg", "grp").agg(F.max("t").alias("t"), (to_tenths(mean) if rounded else mean.cast("double")).alias("gauge"), last.alias("counter")).drop("grp")


def typical_step(steps: DataFrame, by: str = "event_type") -> DataFrame:
    """(by, med): the upper median of the steps dt between a series' points."""
    counts = steps.filter("dt is not null").groupBy(by, "dt").agg(F.count("*").alias("n"))  # distinct steps only
    upto, total = F.sum("n").over(Window.partitionBy(by).orderBy("dt")), F.sum("n").over(Window.partitionBy(by))
    return counts.select(by, "dt", upto.alias("upto"), total.alias("total")).filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(by).agg(F.min("dt").alias("med"))


def rates(points: DataFrame, window: int, by: str = "event_type", *counters: str, width: int | None = None) -> DataFrame:
    """(by, t, event_id, rate, ...): growth per second of the counter since the point's anchor, not below zero, so 0 after a reset.

    The anchor is the newest point at least a window back, or, where there is none, the first one since the last gap; the
    window is as long as three of the series' median steps at least. There is no rate where the anchor is less than 0.8 windows
    back, or where it or the point has no counter. A gap is more than four median steps and more than a minute.
    counters: several columns, whose rates are named rate_<column>, instead of the one named counter. width: as in previous().

    The steps are taken once and stored. An anchor is less than a window and a gap back, so that points meet it in
    stretches of a window's or a gap's length, to the one and the next of which it is dealt.
    """
    values = counters or ("counter",)
    width = width or stretch_width(points, by)
    steps = stored_once(previous(points.select(by, "t", "event_id", *values), by, "t", width=width).withColumn("dt", F.col("t") - F.col("prev_t")).drop("prev_t"), "steps")
    typical = stored_once(typical_step(steps, by), "typical")  # a table of its own size: few series are broadcast, and points aren't dealt by series
    known = steps.join(typical, by, "left")
    w, gap = F.greatest(F.lit(window), 3 * F.col("med")), F.greatest(F.lit(60), 4 * F.col("med"))
    row = F.struct("t", "event_id", *values)
    marked = known.withColumns({"w": w, "far": F.greatest(w, gap), "begins": F.when(F.col("dt").isNull() | (F.col("dt") > gap), row)})
    marked = running(marked, by, width=width, start=("max", F.col("begins")))
    part = lambda at, more: (F.floor(at / F.col("far")) + more).alias("part")
    later = F.col("t") + F.col("w")
    roles = [F.struct(part(F.col("t"), 0), F.col("t").alias("at"), F.lit(1).alias("asks"))] + [F.struct(part(later, k), later.alias("at"), F.lit(0).alias("asks")) for k in (0, 1)]
    dealt = marked.select(by, "t", "event_id", *values, "start", "w", F.explode(F.array(*roles)).alias("r"))
    upto = Window.partitionBy(by, "start", "r.part").orderBy("r.at", "r.asks", "t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("anchor", F.last(F.when(F.col("r.asks") == 0, row), ignorenulls=True).over(upto)).filter("r.asks = 1")
    found = found.withColumn("anchor", F.coalesce("anchor", "start"))
    passed = F.col("t") - F.col("anchor.t")
    growth = lambda c: F.when((passed >= 0.8 * F.col("w")) & F.col(c).isNotNull() & F.col(f"anchor.{c}").isNotNull(), F.greatest(F.lit(0.0), (F.col(c) - F.col(f"anchor.{c}")) / passed))
    return found.select(by, "t", "event_id", *(growth(c).alias(f"rate_{c}" if counters else "rate") for c in values))


def share_of_rates(points: DataFrame, window: int, good: str, bad: str, by: str = "event_type", width: int | None = None) -> DataFrame:
    """(by, t, event_id, share): the rate of one counter in percent of the rates of both; null where either is, or both are 0."""
    r = rates(points, window, by, good, bad, width=width)
    both = F.col(f"rate_{good}") + F.col(f"rate_{bad}")
    return r.select(by, "t", "event_id", F.when(both > 0, 100 * F.col(f"rate_{good}") / both).alias("share"))


def deltas(points: DataFrame, by: str = "event_type") -> DataFrame:
    """(by, event_id, rate): growth of the counter since the point before, per second, not below zero."""
    d = previous(points, by, "t", "counter").filter("prev_t is not null")
    grown, passed = F.col("counter") - F.col("prev_counter"), (F.col("t") - F.col("prev_t")).cast("double")
    return d.select(by, "event_id", (F.greatest(grown, F.lit(0)) / F.greatest(passed, F.lit(0.001))).alias("rate"))


def lifetime(points: DataFrame, by: str = "event_type", gap: int = 60) -> DataFrame:
    """(by, seconds, transferred): time between points no further apart than gap seconds, and the gauge summed over it."""
    d = previous(points, by, "t").withColumn("dt", F.col("t") - F.col("prev_t"))
    near = (F.col("dt") > 0) & (F.col("dt") <= gap)
    return d.groupBy(by).agg(F.sum(F.when(near, F.col("dt")).otherwise(0)).alias("seconds"), F.sum(F.when(near, F.coalesce("gauge", F.lit(0.0)) * F.col("dt")).otherwise(0.0)).alias("transferred"))


def moving_average(points: DataFrame, by: str, order: list[str], value: str, gain: float = 0.05) -> DataFrame:
    """(by, average): exponential average of each series' values from 0 on; null with a null value.

    Ranges of the sorted points are streamed, each run of a series into one sum; a run weighs less by
    1 - gain for each point after it. No task holds a series.
    """
    names = [by, *order]
    keys = [F.asc_nulls_last(c) for c in names]
    spread = points.select(*names, F.col(value).cast("double").alias("__v")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = Y.StructType([*spread.select(*names).schema.fields, *Y.StructType.fromDDL("__n long, __s double, __null boolean").fields])
    keep = 1 - gain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for end in pc.run_end_encode(batch.column(0)).run_ends.to_pylist() if batch.num_rows else ():
                v = batch.column(len(names)).slice(start, end - start)
                total = gain * float(np.dot(v.fill_null(0.0).to_numpy(zero_copy_only=False), keep ** np.arange(len(v) - 1, -1, -1.0)))
                head = [batch.column(k).slice(start, 1) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*head, pa.array([len(v)]), pa.array([total]), pa.array([v.null_count > 0])], names=schema.names)
                start = end

    later = Window.partitionBy(by).orderBy(*(F.desc_nulls_first(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    runs = spread.mapInArrow(run, schema).withColumn("__after", F.coalesce(F.sum("__n").over(later), F.lit(0)))
    total = F.sum(F.col("__s") * F.pow(F.lit(keep), F.col("__after")))
    return runs.groupBy(by).agg(F.when(~F.bool_or("__null"), total).alias("average"))


ARRIVALS = 100_000  # events that a stretch of arrivals stands for


def monotonic(points: DataFrame, by: str = "event_type") -> DataFrame:
    """t never goes back in the order of arrival, that of event_id."""
    late = running(points, by, ("event_id",), ARRIVALS, latest=("max", F.col("t")))
    return late.withColumn("t", F.col("latest")).drop("latest")


#: Bounds of a range in seconds, and the most points of an answer.
LEAST_RANGE_S, MOST_RANGE_S, MOST_POINTS = 60, 730 * DAY, 600


def tier_for(seconds: int) -> str:
    return "raw" if seconds <= DAY else "m5" if seconds <= 30 * DAY else "h1"


def history_range(tiers: dict[str, DataFrame], seconds: int, now: int, most: int = MOST_POINTS, rounded: bool = True) -> DataFrame:
    """Points (t, gauge, counter, tier) of the last seconds up to now.

    tiers: raw, m5 and h1 as (t, event_id, gauge, counter). The tier that suits the range comes first, finer ones
    complete it after its last point; then points are grouped down to about `most`, none across a gap, with means to one place if rounded. The last
    time of each tier is one number, read before the next scan, which it prunes.
    """
    seconds = max(LEAST_RANGE_S, min(int(seconds), MOST_RANGE_S))
    names = list(TIERS)
    own, last, found = tier_for(seconds), None, None
    for name in reversed(names[: names.index(own) + 1]):
        after = F.col("t") >= now - seconds if last is None else (F.col("t") >= now - seconds) & (F.col("t") > last)
        part = tiers[name].filter(after).select("t", "event_id", "gauge", "counter", F.lit(name).alias("tier"))
        newest = part.agg(F.max("t")).first()[0]
        if newest is not None:
            last = newest + TIERS[name][1] / 2
            found = part if found is None else found.unionByName(part)
    if found is None:
        return tiers[own].limit(0).select("t", "gauge", "counter", F.lit(own).alias("tier"))
    sizes = found.count()
    if sizes <= most:
        return found.select("t", "gauge", "counter", "tier")
    return down_sample(found.withColumn("series", F.lit("all")), most, TIERS[own][1], "series", rounded).select("t", "gauge", "counter", F.lit(own).alias("tier"))


def stitch(coarse: DataFrame, fine: DataFrame, coarse_step: int) -> DataFrame:
    """Coarse points, and fine ones after the last of them. That time is one number, read first, so that the fine scan is pruned by it."""
    last = coarse.agg(F.max("t")).first()[0]
    return coarse.unionByName(fine if last is None else fine.filter(F.col("t") > last + coarse_step // 2))


def retained(points: DataFrame, tier: str, now: int) -> DataFrame:
    return points.filter(F.col("t") >= now - TIERS[tier][0])


def sketch(rows: DataFrame, by: str, value: str, lg: int = 14) -> DataFrame:
    """A mergeable HyperLogLog sketch of the distinct values of each group."""
    return rows.groupBy(by).agg(F.hll_sketch_agg(value, lg).alias("sketch"))


def estimate(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def uptime(points: DataFrame, by: str = "event_type", most: int = 120) -> DataFrame:
    """Seconds between ticks of each series, without gaps of `most` and more."""
    d = previous(points, by, "t").withColumn("dt", F.col("t") - F.col("prev_t"))
    return d.groupBy(by).agg(F.coalesce(F.sum(F.when((F.col("dt") > 0) & (F.col("dt") < most), F.col("dt"))), F.lit(0)).alias("uptime_s"))


def life_report(days: Column, uptime_s: Column, traffic: Column) -> tuple[Column, Column]:
    """Availability in percent since the first start, and the average traffic per second of uptime."""
    return F.least(F.lit(100.0), uptime_s / 864 / days), traffic / F.greatest(uptime_s, F.lit(1))
