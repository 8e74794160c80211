"""Streams of spikes: windowed rates with late data, and bursts as they close. Beyond the batch operators, on the same columns.

A streamed spike has an event time ``ts`` (timestamp) besides unit and electrode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(spikes: DataFrame, key: str = "unit", width: str = "30 seconds", slide: str | None = None, late: str = "1 minute") -> DataFrame:
    """(window_start, window_end, key, n_spikes, rate): spikes of each key in tumbling (or sliding) windows.

    Spikes more than ``late`` behind the latest seen are dropped. Counts are combined before the shuffle and the state is one
    counter a key and open window. Null keys are a group of their own; null times are left out. Works on batches as well.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    seconds = (F.col("w.end").cast("double") - F.col("w.start").cast("double"))
    rows = spikes.where("ts IS NOT NULL").withWatermark("ts", late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n_spikes"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n_spikes", (F.col("n_spikes") / seconds).alias("rate"))


def streamed_bursts(spikes: DataFrame, keys: list[str], max_isi: str = "10 milliseconds", min_spikes: int = 3, late: str = "1 minute") -> DataFrame:
    """(*keys, start_ts, end_ts, spike_count): runs of spikes no more than ``max_isi`` apart, emitted once no late spike can join.

    Session windows of the engine: two spikes exactly ``max_isi`` apart belong together.
    """
    runs = spikes.where("ts IS NOT NULL").withWatermark("ts", late).groupBy(F.session_window("ts", max_isi).alias("w"), *keys)
    found = runs.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("spike_count"))
    return found.where(F.col("spike_count") >= min_spikes).select(*keys, "start_ts", "end_ts", "spike_count")
