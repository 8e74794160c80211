"""Spikes by electrode, depth and unit: counts, rates, summaries and raster points. Times are numeric; rates take the units of
time in a second."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.scale import bounded_broadcast, written


def spike_counts(spikes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, n_spikes). Null keys are groups of their own; no spikes give no rows."""
    return spikes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_spikes"))


def time_range(spikes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, min_time, max_time)."""
    return spikes.groupBy(*by).agg(F.min("time").alias("min_time"), F.max("time").alias("max_time"))


def firing_rates(spikes: DataFrame, key: str, by: Sequence[str], per_second: float) -> DataFrame:
    """(*by, key, n_spikes, firing_rate): spikes of each key over the time range of its whole ``by`` group.

    * A group whose spikes all have one time has a null rate. Null keys are left out of the result, not of the range.
    """
    states = spikes.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n_spikes"), F.min("time").alias("lo"), F.max("time").alias("hi"))
    span = states.groupBy(*by).agg((F.max("hi") - F.min("lo")).alias("span"))
    rate = F.try_divide(F.col("n_spikes") * F.lit(float(per_second)), F.col("span"))
    return states.join(span, list(by)).where(F.col(key).isNotNull()).select(*by, key, "n_spikes", rate.alias("firing_rate"))


def with_geometry(rates: DataFrame, geometry: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, poly, electrode, x, y, firing_rate): every electrode of the geometry in every group, 0 where it has no spikes.

    The geometry is a fixed small table: it is packed into one array that each group explodes, then rates are joined by key.
    """
    probe = geometry.agg(F.array_sort(F.collect_list(F.struct("electrode", "poly", "x", "y"))))
    groups = rates.select(*by).distinct().withColumn("probe", probe.scalar())
    all_ = groups.select(*by, F.explode("probe").alias("e")).select(*by, "e.*")
    return all_.join(rates.select(*by, "electrode", "firing_rate"), [*by, "electrode"], "left").select(*by, "poly", "electrode", "x", "y", F.coalesce("firing_rate", F.lit(0.0)).alias("firing_rate"))


def rate_extremes(rates: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, mean_rate, max_rate, max_electrode, min_rate, min_electrode) over active electrodes; ties take the smallest number."""
    first = lambda sign: F.min_by("electrode", F.struct((F.col("firing_rate") * sign).alias("r"), F.col("electrode").alias("e")))
    return rates.groupBy(*by).agg(F.avg("firing_rate").alias("mean_rate"), F.max("firing_rate").alias("max_rate"), first(-1).alias("max_electrode"), F.min("firing_rate").alias("min_rate"), first(1).alias("min_electrode"))


def located(spikes: DataFrame, geometry: DataFrame) -> DataFrame:
    """Spikes with x and depth (null off the geometry)."""
    return spikes.join(bounded_broadcast(geometry.select("electrode", "x", F.col("y").alias("depth"))), "electrode", "left")


def depth_activity(spikes: DataFrame, geometry: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, depth, n_spikes, n_units, n_electrodes); spikes without a depth are left out."""
    rows = located(spikes, geometry).where("depth IS NOT NULL")
    states = rows.groupBy(*by, "depth", "unit", "electrode").agg(F.count(F.lit(1)).alias("n"))
    return states.groupBy(*by, "depth").agg(F.sum("n").alias("n_spikes"), F.countDistinct("unit").alias("n_units"), F.countDistinct("electrode").alias("n_electrodes"))


def electrode_depth_counts(spikes: DataFrame, geometry: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, electrode, depth, n_spikes); spikes without a depth are left out."""
    return located(spikes, geometry).where("depth IS NOT NULL").groupBy(*by, "electrode", "depth").agg(F.count(F.lit(1)).alias("n_spikes"))


def unit_activity_depth(spikes: DataFrame, geometry: DataFrame, by: Sequence[str], row_id: str) -> DataFrame:
    """(*by, unit, n_spikes, n_electrodes, depth): the depth is that of the unit's first row by ``row_id``, known or not."""
    rows = located(spikes, geometry)
    states = rows.groupBy(*by, "unit", "electrode", "depth").agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first"))
    return states.groupBy(*by, "unit").agg(F.sum("n").alias("n_spikes"), F.countDistinct("electrode").alias("n_electrodes"), F.min_by("depth", "first").alias("depth"))


def top(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each ``by`` group in ``order``, numbered from 1."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def rank_all(rows: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """``rows`` with their number in their ``by`` group in ``order`` (which should leave no ties), from 1; of any size.

    Rows are cut into ranges of the order, each range is ranked by itself, and the ranges' sizes are added up before it. The
    ranges are written, so that they are the same in both uses.
    """
    cut = rows.repartitionByRange(*(F.col(b) for b in by), *order).withColumn("_range", F.spark_partition_id())
    cut = written(cut, "ranges")
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = cut.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*by, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order))
    return cut.withColumn("_k", inside).join(before, [*by, "_range"]).withColumn(rank, (F.col("_k") + F.col("_before")).cast("bigint")).drop("_k", "_before", "_range")


def raster_points(spikes: DataFrame, geometry: DataFrame, by: Sequence[str], start: int, end: int, row_id: str) -> DataFrame:
    """(*by, row_id, time, unit, depth, y): spikes in [start, end] at y = index of their depth + 0.1 x index of their unit among
    the depth's units by first appearance. Depths without a record come last, at a depth of their own (null).

    The indices are found on compact states and joined back, so no window ranks the spikes themselves.
    """
    rows = located(spikes.where(F.col("time").between(start, end)), geometry)
    states = rows.groupBy(*by, "depth", "unit").agg(F.min(row_id).alias("first"))
    level = F.dense_rank().over(W.partitionBy(*by).orderBy(F.col("depth").asc_nulls_last())) - 1
    within = F.row_number().over(W.partitionBy(*by, "depth").orderBy("first")) - 1
    places = states.select(*by, F.col("depth").alias("_d"), F.col("unit").alias("_u"), (level + within * 0.1).alias("y"))
    same = (F.col("unit") == F.col("_u")) & F.col("depth").eqNullSafe(F.col("_d"))
    for b in by:
        places = places.withColumnRenamed(b, f"_{b}")
        same &= F.col(b) == F.col(f"_{b}")
    return rows.join(places, same).select(*by, row_id, "time", "unit", "depth", "y")


def recording_summary(spikes: DataFrame, intervals: DataFrame, by: Sequence[str], per_second: float) -> DataFrame:
    """(*by, duration_s, minutes, n_spikes, n_electrodes, n_units, overall_rate, n_intervals, mean_interval_s, mean_gap_s): the gap
    is that between starts in file order, i.e. (last start - first start) / (n - 1) by interval id. Groups without intervals
    have 0 intervals and null means."""
    s = spikes.groupBy(*by).agg(
        ((F.max("time") - F.min("time")) / float(per_second)).alias("duration_s"), F.count(F.lit(1)).alias("n_spikes"),
        F.countDistinct("electrode").alias("n_electrodes"), F.countDistinct("unit").alias("n_units"),
    )
    i = intervals.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_intervals"), (F.avg(F.col("End") - F.col("Start")) / float(per_second)).alias("mean_interval_s"),
        (F.try_divide((F.max_by("Start", "interval_id") - F.min_by("Start", "interval_id")).cast("double"), F.count(F.lit(1)) - 1) / float(per_second)).alias("mean_gap_s"),
    )
    joined = s.join(i, list(by), "left")
    return joined.select(*by, "duration_s", (F.col("duration_s") / 60).alias("minutes"), "n_spikes", "n_electrodes", "n_units", F.try_divide("n_spikes", "duration_s").alias("overall_rate"), F.coalesce("n_intervals", F.lit(0)).alias("n_intervals"), "mean_interval_s", "mean_gap_s")
