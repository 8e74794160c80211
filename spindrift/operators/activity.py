"""Activity of units in intervals, kept wide (two columns a unit): unpivoted once, then categorised and aggregated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRESENCE, COUNT = "Event Presence", "Event Count"
# Categories of interval length in milliseconds, ends included.
CATEGORIES = {"150ms": (146, 154), "300ms": (296, 304), "750ms": (746, 754)}


def event_columns(rows: DataFrame, what: str) -> dict[int, str]:
    """{unit: column} of the columns whose name holds ``what``; the unit is the second part of the name."""
    return {int(c.split("_")[1]): c for c in rows.columns if what in c}


def categorised(rows: DataFrame, start: str, end: str, per_ms: float) -> DataFrame:
    """``rows`` plus duration_ms and category (``other`` outside all bands, and for null durations)."""
    ms = (F.col(f"`{end}`") - F.col(f"`{start}`")) / float(per_ms)
    category = F.lit("other")
    for name, (lo, hi) in CATEGORIES.items():
        category = F.when(ms.between(lo, hi), name).otherwise(category)
    return rows.withColumns({"duration_ms": ms, "category": category})


def long_activity(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(*ids, unit, presence, count): one row an interval and unit; the columns of a unit are found by name, whatever their number.

    One generator makes all rows in one pass over the wide table. A null stays null.
    """
    presence, count = event_columns(rows, PRESENCE), event_columns(rows, COUNT)
    each = [F.struct(F.lit(u).alias("unit"), (F.col(f"`{presence[u]}`") if u in presence else F.lit(None)).cast("bigint").alias("presence"), (F.col(f"`{count[u]}`") if u in count else F.lit(None)).cast("bigint").alias("count")) for u in sorted({*presence, *count})]
    kept = [F.col(f"`{c}`") for c in ids]
    if not each:
        return rows.select(*kept, F.lit(None).cast("int").alias("unit"), F.lit(None).cast("bigint").alias("presence"), F.lit(None).cast("bigint").alias("count")).limit(0)
    return rows.select(*kept, F.explode(F.array(*each)).alias("x")).select(*kept, "x.*")


def unit_activity(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, unit, active_intervals, total_intervals, rate_percent) of the units present in each ``by`` group."""
    rate = 100.0 * F.coalesce(F.sum("presence"), F.lit(0)) / F.count(F.lit(1))
    return long.groupBy(*by, "unit").agg(F.coalesce(F.sum("presence"), F.lit(0)).alias("active_intervals"), F.count(F.lit(1)).alias("total_intervals"), rate.alias("rate_percent"))


def activity_by_category(long: DataFrame) -> DataFrame:
    """(category, unit, active_intervals, total_intervals, rate_percent): every unit in every category, 0 where it is empty."""
    found = unit_activity(long.where("category <> 'other'"), ["category"])
    every = long.select("unit").distinct().withColumn("category", F.explode(F.array(*map(F.lit, CATEGORIES))))
    return every.join(found, ["category", "unit"], "left").select("category", "unit", *(F.coalesce(c, F.lit(zero)).alias(c) for c, zero in (("active_intervals", 0), ("total_intervals", 0), ("rate_percent", 0.0))))


def spike_count_stats(long: DataFrame) -> DataFrame:
    """(unit, total_spikes, max_spikes, mean_spikes, intervals_with_spikes); nulls are no interval."""
    return long.groupBy("unit").agg(F.sum("count").alias("total_spikes"), F.max("count").alias("max_spikes"), F.avg("count").alias("mean_spikes"), F.count_if(F.col("count") > 0).alias("intervals_with_spikes"))


def category_summary(rows: DataFrame, long: DataFrame) -> DataFrame:
    """(category, n_intervals, total_presence, mean_presence, active_units, total_spikes) of the length categories that occur."""
    n = rows.where("category <> 'other'").groupBy("category").agg(F.count(F.lit(1)).alias("n_intervals"))
    units = long.where("category <> 'other'").groupBy("category", "unit").agg(F.coalesce(F.sum("presence"), F.lit(0)).alias("p"), F.coalesce(F.sum("count"), F.lit(0)).alias("s"))
    total = units.groupBy("category").agg(F.sum("p").alias("total_presence"), F.count_if(F.col("p") > 0).alias("active_units"), F.sum("s").alias("total_spikes"))
    return n.join(total, "category").select("category", "n_intervals", "total_presence", (F.col("total_presence") / F.col("n_intervals")).alias("mean_presence"), "active_units", "total_spikes")


def heatmap(by_category: DataFrame) -> DataFrame:
    """(unit, one column a category): activity rates in percent."""
    return by_category.groupBy("unit").pivot("category", list(CATEGORIES)).agg(F.first("rate_percent"))


def wide_table(pairs: DataFrame, intervals: DataFrame, units: Sequence[int]) -> DataFrame:
    """(interval_id, Start, End, duration, spikes_<u>_Event Presence and _Event Count for each of ``units``), 0 without spikes.

    ``pairs`` holds (interval_id, unit) of every spike inside an interval. The units are a parameter: a wide table of all units
    would grow a column pair with each.
    """
    names = {u: f"spikes_{u}_{COUNT}" for u in units}
    states = pairs.where(F.col("unit").isin(list(units))).groupBy("interval_id", "unit").agg(F.count(F.lit(1)).alias("n"))
    counts = states.groupBy("interval_id").pivot("unit", list(units)).agg(F.sum("n"))
    joined = intervals.join(counts, "interval_id", "left")
    cols = []
    for u, name in names.items():
        n = F.coalesce(F.col(f"`{u}`"), F.lit(0))
        cols += [F.when(n > 0, 1).otherwise(0).alias(f"spikes_{u}_{PRESENCE}"), n.alias(name)]
    return joined.select("interval_id", "Start", "End", (F.col("End") - F.col("Start")).alias("duration"), *cols)


def long_table(pairs: DataFrame, intervals: DataFrame) -> DataFrame:
    """(interval_id, Start, End, duration, unit, presence, count): ``wide_table`` of all units, a row for each unit with spikes in an
    interval; an interval without spikes has one row with a null unit, presence and count 0.
    """
    counts = pairs.groupBy("interval_id", "unit").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return intervals.join(counts, "interval_id", "left").select("interval_id", "Start", "End", (F.col("End") - F.col("Start")).alias("duration"), "unit", F.when(n > 0, 1).otherwise(0).alias("presence"), n.alias("count"))
