"""Time ranges: filters, overlaps, fixed windows and the band join of events with intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.geometry import top


def in_range(rows: DataFrame, start: float | None = None, end: float | None = None, *, closed: bool = True, time: str = "time") -> DataFrame:
    """Rows with ``start <= time <= end`` (``< end`` unless closed); a bound of None doesn't bind. Null times are never in range."""
    out = rows.where(F.col(time).isNotNull())
    if start is not None:
        out = out.where(F.col(time) >= start)
    if end is not None:
        out = out.where(F.col(time) <= end if closed else F.col(time) < end)
    return out


def on_electrodes(spikes: DataFrame, electrodes: Sequence[int] | None) -> DataFrame:
    """Spikes on the electrodes named; None or an empty list keeps all, null electrodes included."""
    return spikes.where(F.col("electrode").isin(list(electrodes))) if electrodes else spikes


def overlapping(intervals: DataFrame, start: float, end: float) -> DataFrame:
    """Intervals that touch [start, end], ends included, with the part inside it (clip_start, clip_end)."""
    return intervals.where((F.col("Start") <= end) & (F.col("End") >= start)).withColumns({"clip_start": F.greatest("Start", F.lit(start)), "clip_end": F.least("End", F.lit(end))})


def window_summary(spikes: DataFrame, intervals: DataFrame, by: Sequence[str], start: int, end: int, per_second: float) -> DataFrame:
    """(*by, n_spikes, rate, n_electrodes, n_intervals) of the window [start, end], groups without a spike in it left out."""
    s = in_range(spikes, start, end).groupBy(*by).agg(F.count(F.lit(1)).alias("n_spikes"), F.countDistinct("electrode").alias("n_electrodes"))
    i = overlapping(intervals, start, end).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rate = F.col("n_spikes") * float(per_second) / float(end - start)
    return s.join(i, list(by), "left").select(*by, "n_spikes", rate.alias("rate"), "n_electrodes", F.coalesce("n", F.lit(0)).alias("n_intervals"))


def high_activity_windows(spikes: DataFrame, by: Sequence[str], width: int, n: int, per_second: float) -> DataFrame:
    """(*by, rank, start_time, end_time, rate, n_spikes): the ``n`` busiest windows of ``width`` from the first spike on, earliest
    first among equals.

    Windows are [start, min(start + width, last)); the spike at the very end belongs to none; the rate divides by the whole
    width even for a short last window; empty windows count 0. A group whose spikes share one time has no window.
    """
    span = spikes.groupBy(*by).agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    at = F.floor((F.col("time") - F.col("lo")) / width)
    counts = spikes.join(span, list(by)).where("time < hi").groupBy(*by, at.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    last = F.ceil((F.col("hi") - F.col("lo")) / width) - 1
    grid = span.where("hi > lo").select(*by, "lo", "hi", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("w"))
    rows = grid.join(counts, [*by, "w"], "left").select(
        *by, (F.col("lo") + F.col("w") * width).alias("start_time"), F.least(F.col("lo") + (F.col("w") + 1) * width, F.col("hi")).alias("end_time"),
        (F.coalesce("n", F.lit(0)) * float(per_second) / float(width)).alias("rate"), F.coalesce("n", F.lit(0)).alias("n_spikes"),
    )
    return top(rows, by, [F.col("n_spikes").desc(), F.col("start_time")], n)


def band_join(events: DataFrame, intervals: DataFrame, on: Sequence[str], before: int, after: int) -> DataFrame:
    """(*events, interval_id, Start, End, rel): every event with every interval of its ``on`` group for which
    ``Start - before <= time <= Start + after``; ``rel = time - Start``.

    Buckets as wide as the band turn the range into an equi-join: an interval goes into the two buckets at most that its band
    touches, an event into one, so each pair meets once; the exact range is a residual condition. Bands that overlap keep
    their events each; null times or starts join nothing. Skewed buckets of the shuffled form are split by AQE.
    """
    width = before + after + 1
    bucket = lambda c: F.expr(f"({c} - pmod({c}, {width}L)) div {width}L")
    bands = (
        intervals.where("Start IS NOT NULL")
        .withColumn("_lo", bucket(f"(Start - {before}L)"))
        .withColumn("_hi", bucket(f"(Start + {after}L)"))
        .withColumn("_b", F.explode(F.sequence("_lo", "_hi")))
        .select(*(F.col(c).alias(f"_{c}") for c in on), "_b", "interval_id", "Start", "End")
    )
    same = F.col("_e") == F.col("_b")
    for c in on:
        same &= F.col(c) == F.col(f"_{c}")
    rel = F.col("time") - F.col("Start")
    joined = events.withColumn("_e", bucket("time")).join(bands, same & (rel >= -before) & (rel <= after))
    return joined.withColumn("rel", rel).drop("_e", "_b", *(f"_{c}" for c in on))


def overlap_join(events: DataFrame, intervals: DataFrame, on: Sequence[str], width: int) -> DataFrame:
    """(*events, interval_id, Start, End): every event with every interval of its group that holds it, ends included.

    Intervals go into every bucket of ``width`` they touch (choose it near their usual length), events into one.
    """
    bucket = lambda c: F.expr(f"({c} - pmod({c}, {width}L)) div {width}L")
    spans = intervals.where("Start <= End").withColumn("_b", F.explode(F.sequence(bucket("Start"), bucket("End")))).select(*(F.col(c).alias(f"_{c}") for c in on), "_b", "interval_id", "Start", "End")
    same = F.col("_e") == F.col("_b")
    for c in on:
        same &= F.col(c) == F.col(f"_{c}")
    return events.withColumn("_e", bucket("time")).join(spans, same & F.col("time").between(F.col("Start"), F.col("End"))).drop("_e", "_b", *(f"_{c}" for c in on))
