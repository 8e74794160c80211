"""Whole analyses: compositions of the operators that return their results by name, lazily."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import activity, geometry, ranges, spectra, trains
from spindrift.operators.grids import pearson
from spindrift.operators.psth import Psth, modulation_summary
from spindrift.plans.recording import TICKS_PER_SECOND
from spindrift.sources.readers import Bundle
from spindrift.sources.voltage import read_voltage


def _one_recording(df: DataFrame) -> DataFrame:
    """Rows of a single recording, numbered where they have no ids yet."""
    out = df if "recording_id" in df.columns else df.withColumn("recording_id", F.lit(1))
    return out if {"spike_id", "interval_id"} & set(out.columns) else out.withColumn("spike_id", F.monotonically_increasing_id())


def recording_analysis(bundle: Bundle, start: int | None = None, end: int | None = None, electrodes: list[int] | None = None) -> dict[str, DataFrame]:
    """Raster points, overlapping intervals, electrode rates with their extremes, and the summary of a recording in ticks.

    A bound of None is the first or last spike; the raster is limited to ``electrodes`` if given.
    """
    spikes, intervals, by = _one_recording(bundle.spikes), _one_recording(bundle.intervals), ["recording_id"]
    if start is None or end is None:
        first, last = spikes.agg(F.min("time"), F.max("time")).first()
        start, end = first if start is None else start, last if end is None else end
    rates = geometry.firing_rates(spikes, "electrode", by, TICKS_PER_SECOND)
    return {
        "raster": geometry.raster_points(ranges.on_electrodes(spikes, electrodes), bundle.geometry, by, start, end, "spike_id"),
        "intervals": ranges.overlapping(intervals, start, end),
        "rates": geometry.with_geometry(rates, bundle.geometry, by),
        "extremes": geometry.rate_extremes(rates, by),
        "summary": geometry.recording_summary(spikes, intervals, by, TICKS_PER_SECOND),
        "windows": ranges.high_activity_windows(spikes, by, 30 * TICKS_PER_SECOND, 5, TICKS_PER_SECOND),
    }


def psth_analysis(psth: Psth) -> dict[str, DataFrame]:
    """Rates, statistics and classes of units, the population, and the trial raster."""
    stats = psth.stats()
    return {"rates": psth.rates(), "statistics": stats, "classes": psth.response_classes(), "population": psth.population(), "modulation": modulation_summary(stats), "trials": psth.trials()}


def pattern_analysis(spikes: DataFrame, per_second: float, max_isi: int, units: list[int] | None = None, **parameters) -> dict[str, DataFrame]:
    """The analysis of the trains of a recording (of ``units`` if given) and of how many there are of each class."""
    rows = _one_recording(spikes)
    if units:
        rows = rows.where(F.col("unit").isin(units))
    patterns = trains.patterns(rows, ["recording_id", "unit"], per_second, max_isi, **parameters)
    good = patterns.where("error IS NULL")
    return {"patterns": patterns, "classes": good.groupBy("pattern_type").agg(F.count(F.lit(1)).alias("n_trains"), F.avg("confidence").alias("mean_confidence")), "bursts": trains.bursts(rows, ["recording_id", "unit"], max_isi)}


def interval_activity(rows: DataFrame, start: str = "pico_Interval Start", end: str = "pico_Interval End", per_ms: float = 30.0) -> dict[str, DataFrame]:
    """Everything about the activity of units in a wide table of intervals."""
    rows = activity.categorised(rows, start, end, per_ms).withColumn("_row", F.monotonically_increasing_id())
    long = activity.long_activity(rows, ["_row", "category"])
    by = activity.activity_by_category(long)
    busy = activity.unit_activity(long).orderBy(F.col("active_intervals").desc(), "unit").limit(10).select("unit")
    return {
        "intervals": rows.drop("_row"), "activity": activity.unit_activity(long), "by_category": by, "counts": activity.spike_count_stats(long), "heatmap": activity.heatmap(by),
        "categories": activity.category_summary(rows, long), "correlations": pearson(long.join(F.broadcast(busy), "unit", "left_semi"), "unit", "_row", "presence"),
    }


def quick_spectrum(spark: SparkSession, path: str, channel: int = 0, duration: float = 10, channels: int = 64, rate: float = 30_000) -> dict[str, DataFrame]:
    """The Welch spectrum of one channel of a voltage file and what its bands hold."""
    voltage = read_voltage(spark, path, channels, rate, duration=duration).where(F.col("channel") == channel)
    return {"voltage": voltage, "psd": spectra.power_spectrum(voltage, rate), "analysis": spectra.channel_analysis(voltage, rate)}
