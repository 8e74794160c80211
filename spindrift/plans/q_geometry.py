"""Queries over spikes, geometry and time windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import geometry as G
from spindrift.operators import ranges as R
from spindrift.operators.grids import histogram
from spindrift.plans.recording import SQL, TICKS_PER_SECOND, recording
from spindrift.sources.tables import table

PER = TICKS_PER_SECOND
BY = ["recording_id"]
#: The raster and summary windows, in ticks: the first ten seconds, and seconds 20 to 50.
FIRST = (0, 10 * PER)
WINDOW = (20 * PER, 50 * PER)


def electrode_spike_count(spark: SparkSession, d: str) -> DataFrame:
    return G.spike_counts(recording(spark, d).spikes, [*BY, "electrode"])


def _rates(spark: SparkSession, d: str) -> DataFrame:
    return G.firing_rates(recording(spark, d).spikes, "electrode", BY, PER)


def _all_rates(spark: SparkSession, d: str) -> DataFrame:
    return G.with_geometry(_rates(spark, d), recording(spark, d).geometry, BY)


def electrode_firing_rate(spark: SparkSession, d: str) -> DataFrame:
    """The rate of every electrode of the probe in every recording, 0 for silent ones."""
    return _all_rates(spark, d).withColumn("firing_rate", F.round("firing_rate", 6))


def rate_extremes(spark: SparkSession, d: str) -> DataFrame:
    out = G.rate_extremes(_rates(spark, d), BY)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_rate", "max_rate", "min_rate")})


def hemisphere_rates(spark: SparkSession, d: str) -> DataFrame:
    """Mean rate and active electrodes by side of the probe (x > 0 is right)."""
    side = F.when(F.col("x") > 0, "right").otherwise("left").alias("side")
    return _all_rates(spark, d).groupBy(*BY, side).agg(F.count(F.lit(1)).alias("n_electrodes"), F.count_if(F.col("firing_rate") > 0).alias("n_active"), F.round(F.avg("firing_rate"), 6).alias("mean_rate"))


def top_electrodes(spark: SparkSession, d: str) -> DataFrame:
    """The five fastest electrodes of each recording, the smaller number first among equals."""
    out = G.top(_rates(spark, d), BY, [F.col("n_spikes").desc(), F.col("electrode")], 5)
    return out.select(*BY, "rank", "electrode", "n_spikes", F.round("firing_rate", 6).alias("firing_rate"))


def electrode_depth_counts(spark: SparkSession, d: str) -> DataFrame:
    r = recording(spark, d)
    return G.electrode_depth_counts(r.spikes, r.geometry, BY)


def depth_activity(spark: SparkSession, d: str) -> DataFrame:
    r = recording(spark, d)
    return G.depth_activity(r.spikes, r.geometry, BY)


def unit_activity_depth(spark: SparkSession, d: str) -> DataFrame:
    r = recording(spark, d)
    return G.unit_activity_depth(r.spikes, r.geometry, BY, "spike_id")


def raster_points(spark: SparkSession, d: str) -> DataFrame:
    r = recording(spark, d)
    return G.raster_points(r.spikes, r.geometry, BY, *FIRST, "spike_id").withColumn("y", F.round("y", 3))


def global_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per recording: spikes, units, electrodes, range and mean rate (0 for a range of 0)."""
    s = recording(spark, d).spikes.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n_spikes"), F.countDistinct("unit").alias("n_units"), F.countDistinct("electrode").alias("n_electrodes"),
        (F.max("time") - F.min("time")).alias("range_ticks"),
    )
    return s.withColumn("mean_rate", F.round(F.coalesce(F.try_divide(F.col("n_spikes") * float(PER), F.col("range_ticks")), F.lit(0.0)), 6))


def recording_summary(spark: SparkSession, d: str) -> DataFrame:
    r = recording(spark, d)
    out = G.recording_summary(r.spikes, r.intervals, BY, PER)
    return out.withColumns({c: F.round(c, 6) for c in ("duration_s", "minutes", "overall_rate", "mean_interval_s", "mean_gap_s")})


def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row for all recordings."""
    r = recording(spark, d)
    per = r.spikes.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), (F.max("time") - F.min("time")).alias("ticks"))
    total = per.agg(F.count(F.lit(1)).alias("n_recordings"), F.sum("n").alias("n_spikes"), F.round(F.sum("ticks") / float(PER), 4).alias("seconds"))
    kinds = r.spikes.agg(F.countDistinct("unit").alias("n_units"), F.countDistinct("electrode").alias("n_electrodes"))
    probe = r.geometry.agg(F.count(F.lit(1)).alias("n_configured"))
    return total.withColumns({c: df.select(c).scalar() for df in (kinds, probe) for c in df.columns})


def time_range(spark: SparkSession, d: str) -> DataFrame:
    return G.time_range(recording(spark, d).spikes, BY)


def spikes_seconds(spark: SparkSession, d: str) -> DataFrame:
    return recording(spark, d).spikes.select("spike_id", F.round(F.col("time") / float(PER), 6).alias("time_sec"))


def ticks_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Stored times read as seconds on a 60 kHz clock and brought to ticks, halves to even."""
    rows = table(spark, d, "spikes_time_adjusted").where("time IS NOT NULL")
    return rows.select("spike_id", F.rint(F.col("time") / 60000.0 * 30000).cast("bigint").alias("ticks"))


def time_window_summary(spark: SparkSession, d: str) -> DataFrame:
    r = recording(spark, d)
    return R.window_summary(r.spikes, r.intervals, BY, *WINDOW, PER).withColumn("rate", F.round("rate", 6))


def interval_overlap_clip(spark: SparkSession, d: str) -> DataFrame:
    out = R.overlapping(recording(spark, d).intervals, *WINDOW)
    return out.select("recording_id", "interval_id", F.col("Start").alias("start_time"), F.col("End").alias("end_time"), "clip_start", "clip_end")


def electrode_subset(spark: SparkSession, d: str) -> DataFrame:
    """Spikes of a window on electrodes 1 to 8."""
    return R.in_range(R.on_electrodes(recording(spark, d).spikes, range(1, 9)), *WINDOW)


def high_activity_windows(spark: SparkSession, d: str) -> DataFrame:
    out = R.high_activity_windows(recording(spark, d).spikes, BY, 30 * PER, 5, PER)
    return out.select(*BY, "rank", "start_time", "end_time", F.round("rate", 6).alias("rate"), "n_spikes")


def interval_durations(spark: SparkSession, d: str) -> DataFrame:
    return recording(spark, d).intervals.select("interval_id", (F.col("End") - F.col("Start")).alias("duration"))


def interval_duration_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample standard deviation of interval lengths by recording, intervals of length 0 left out."""
    span = F.col("End") - F.col("Start")
    return recording(spark, d).intervals.where("End > Start").groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(span), 6).alias("mean_duration"), F.round(F.stddev_samp(span), 6).alias("std_duration"))


def qc_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Electrodes and units by total spikes and by rate over the recorded time, both ranked."""
    from spindrift.operators.eager import eager_join_aggregate

    s = recording(spark, d).spikes
    span = s.groupBy("recording_id").agg((F.max("time") - F.min("time")).alias("ticks"))
    counts = eager_join_aggregate(s, span, "recording_id", ["unit", "electrode"]).where("key_value IS NOT NULL")
    rows = counts.select("key_column", "key_value", F.col("n_left").alias("n_spikes"), F.round(F.col("n_left") * float(PER) / span.agg(F.sum("ticks")).scalar(), 6).alias("rate"))
    return G.rank_all(rows, ["key_column"], [F.col("n_spikes").desc(), F.col("key_value")])


def units_and_channels(spark: SparkSession, d: str) -> DataFrame:
    """Distinct units and channels of each recording, counted and listed in order."""
    states = recording(spark, d).spikes.groupBy(*BY, "unit", "electrode").agg(F.lit(1))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ",")
    return states.groupBy(*BY).agg(F.countDistinct("unit").alias("n_units"), F.countDistinct("electrode").alias("n_channels"), listed("unit").alias("units"), listed("electrode").alias("channels"))


def units_per_channel(spark: SparkSession, d: str) -> DataFrame:
    states = recording(spark, d).spikes.where("electrode IS NOT NULL").groupBy("electrode", "unit").agg(F.count(F.lit(1)).alias("n"))
    return states.groupBy("electrode").agg(F.count(F.lit(1)).alias("n_units"), F.array_join(F.array_sort(F.collect_set("unit")).cast("array<string>"), ",").alias("units"), F.sum("n").alias("n_spikes"))


def unit_channel_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Spikes of each unit on each channel where it has any, a row each instead of a column a channel; the channel of spikes
    without one is null."""
    return recording(spark, d).spikes.groupBy("unit", "electrode").agg(F.count(F.lit(1)).alias("n_spikes"))


def unit_spike_counts_topn(spark: SparkSession, d: str) -> DataFrame:
    """The twenty units with most spikes over all recordings."""
    counts = recording(spark, d).spikes.groupBy("unit").agg(F.count(F.lit(1)).alias("n_spikes"))
    ranked = counts.orderBy(F.col("n_spikes").desc(), "unit").limit(20)
    from pyspark.sql import Window as W

    return ranked.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("n_spikes").desc(), "unit")))


def electrode_schematic(spark: SparkSession, d: str) -> DataFrame:
    """The probe as it is drawn: each electrode's place and side."""
    return recording(spark, d).geometry.select("poly", "electrode", "x", "y", F.when(F.col("x") > 0, "right").otherwise("left").alias("side"))


def interval_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Display histogram of interval lengths in 50 equal bins by recording."""
    rows = recording(spark, d).intervals.where("End > Start").select(*BY, (F.col("End") - F.col("Start")).alias("span"))
    return histogram(rows, "span", 50, BY).select(*BY, "bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


QUERIES = {f.__name__: f for f in (
    electrode_spike_count, electrode_firing_rate, rate_extremes, hemisphere_rates, top_electrodes, electrode_depth_counts, depth_activity, unit_activity_depth, raster_points,
    global_summary, recording_summary, dataset_summary, time_range, spikes_seconds, ticks_adjusted, time_window_summary, interval_overlap_clip, electrode_subset, high_activity_windows,
    interval_durations, interval_duration_stats, interval_histogram, qc_rankings, units_and_channels, units_per_channel, unit_channel_pivot, unit_spike_counts_topn, electrode_schematic,
)}

_RATES = SQL + f""", span AS (SELECT recording_id, max(time) - min(time) AS span FROM spikes GROUP BY recording_id),
rates AS (SELECT s.recording_id, s.electrode, count(*) AS n_spikes, count(*) * {PER}.0::DOUBLE / max(span) AS firing_rate FROM spikes s JOIN span ON s.recording_id = span.recording_id WHERE electrode IS NOT NULL GROUP BY s.recording_id, s.electrode),
probe_rates AS (SELECT r.recording_id, g.poly, g.electrode, g.x, g.y, coalesce(q.firing_rate, 0) AS firing_rate FROM (SELECT DISTINCT recording_id FROM rates) r CROSS JOIN geometry g LEFT JOIN rates q ON q.recording_id = r.recording_id AND q.electrode = g.electrode)
"""
_PLACED = SQL + ", located AS (SELECT s.*, g.x, g.y AS depth FROM spikes s LEFT JOIN geometry g ON s.electrode = g.electrode)\n"

ORACLES = {
    "electrode_spike_count": SQL + "SELECT recording_id, electrode, count(*) AS n_spikes FROM spikes GROUP BY ALL",
    "electrode_firing_rate": _RATES + "SELECT recording_id, poly, electrode, x, y, round(firing_rate, 6) AS firing_rate FROM probe_rates",
    "rate_extremes": _RATES + """SELECT recording_id, round(avg(firing_rate), 6) AS mean_rate, round(max(firing_rate), 6) AS max_rate, round(min(firing_rate), 6) AS min_rate,
  (SELECT electrode FROM rates b WHERE b.recording_id = a.recording_id ORDER BY firing_rate DESC, electrode LIMIT 1) AS max_electrode,
  (SELECT electrode FROM rates b WHERE b.recording_id = a.recording_id ORDER BY firing_rate, electrode LIMIT 1) AS min_electrode FROM rates a GROUP BY recording_id""",
    "hemisphere_rates": _RATES + "SELECT recording_id, CASE WHEN x > 0 THEN 'right' ELSE 'left' END AS side, count(*) AS n_electrodes, CAST(sum(CASE WHEN firing_rate > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_active, round(avg(firing_rate), 6) AS mean_rate FROM probe_rates GROUP BY 1, 2",
    "top_electrodes": _RATES + "SELECT recording_id, rank, electrode, n_spikes, round(firing_rate, 6) AS firing_rate FROM (SELECT *, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY n_spikes DESC, electrode) AS INT) AS rank FROM rates) WHERE rank <= 5",
    "electrode_depth_counts": _PLACED + "SELECT recording_id, electrode, depth, count(*) AS n_spikes FROM located WHERE depth IS NOT NULL GROUP BY ALL",
    "depth_activity": _PLACED + "SELECT recording_id, depth, count(*) AS n_spikes, count(DISTINCT unit) AS n_units, count(DISTINCT electrode) AS n_electrodes FROM located WHERE depth IS NOT NULL GROUP BY ALL",
    "unit_activity_depth": _PLACED + """SELECT recording_id, unit, max(n) AS n_spikes, max(e) AS n_electrodes, max(CASE WHEN k = 1 THEN depth END) AS depth FROM (
  SELECT l.recording_id, l.unit, l.depth, row_number() OVER (PARTITION BY l.recording_id, l.unit ORDER BY spike_id) AS k, c.n, c.e FROM located l
  JOIN (SELECT recording_id, unit, count(*) AS n, count(DISTINCT electrode) AS e FROM located GROUP BY ALL) c ON l.recording_id = c.recording_id AND l.unit = c.unit) GROUP BY recording_id, unit""",
    "raster_points": _PLACED + f""", w AS (SELECT * FROM located WHERE time BETWEEN {FIRST[0]} AND {FIRST[1]}),
u AS (SELECT recording_id, depth, unit, min(spike_id) AS first FROM w GROUP BY ALL),
p AS (SELECT recording_id, depth, unit, dense_rank() OVER (PARTITION BY recording_id ORDER BY depth NULLS LAST) - 1 AS level, row_number() OVER (PARTITION BY recording_id, depth ORDER BY first) - 1 AS j FROM u)
SELECT w.recording_id, w.spike_id, w.time, w.unit, w.depth, round(CAST(level AS DOUBLE) + CAST(j AS DOUBLE) * CAST(0.1 AS DOUBLE), 3) AS y FROM w JOIN p ON w.recording_id = p.recording_id AND w.unit = p.unit AND w.depth IS NOT DISTINCT FROM p.depth""",
    "global_summary": SQL + f"SELECT recording_id, count(*) AS n_spikes, count(DISTINCT unit) AS n_units, count(DISTINCT electrode) AS n_electrodes, max(time) - min(time) AS range_ticks, round(coalesce(count(*) * {PER}.0::DOUBLE / nullif(max(time) - min(time), 0), 0), 6) AS mean_rate FROM spikes GROUP BY recording_id",
    "recording_summary": SQL + f""", s AS (SELECT recording_id, (max(time) - min(time)) / {PER}.0::DOUBLE AS duration_s, count(*) AS n_spikes, count(DISTINCT electrode) AS n_electrodes, count(DISTINCT unit) AS n_units FROM spikes GROUP BY recording_id),
g AS (SELECT recording_id, interval_id, a, b, a - lag(a) OVER (PARTITION BY recording_id ORDER BY interval_id) AS gap FROM intervals),
i AS (SELECT recording_id, count(*) AS n_intervals, avg(b - a) / {PER}.0::DOUBLE AS mean_interval_s, avg(gap) / {PER}.0::DOUBLE AS mean_gap_s FROM g GROUP BY recording_id)
SELECT s.recording_id, round(duration_s, 6) AS duration_s, round(duration_s / 60, 6) AS minutes, n_spikes, n_electrodes, n_units, round(n_spikes / nullif(duration_s, 0), 6) AS overall_rate, coalesce(n_intervals, 0) AS n_intervals, round(mean_interval_s, 6) AS mean_interval_s, round(mean_gap_s, 6) AS mean_gap_s
FROM s LEFT JOIN i ON s.recording_id = i.recording_id""",
    "dataset_summary": SQL + f"""SELECT count(*) AS n_recordings, CAST(sum(n) AS BIGINT) AS n_spikes, round(sum(ticks) / {PER}.0::DOUBLE, 4) AS seconds, (SELECT count(DISTINCT unit) FROM spikes) AS n_units,
  (SELECT count(DISTINCT electrode) FROM spikes) AS n_electrodes, (SELECT count(*) FROM geometry) AS n_configured FROM (SELECT recording_id, count(*) AS n, max(time) - min(time) AS ticks FROM spikes GROUP BY recording_id)""",
    "time_range": SQL + "SELECT recording_id, min(time) AS min_time, max(time) AS max_time FROM spikes GROUP BY recording_id",
    "spikes_seconds": SQL + f"SELECT spike_id, round(time / {PER}.0::DOUBLE, 6) AS time_sec FROM spikes",
    "ticks_adjusted": "SELECT spike_id, CAST(round_even(time / 60000.0::DOUBLE * 30000, 0) AS BIGINT) AS ticks FROM spikes_time_adjusted WHERE time IS NOT NULL",
    "time_window_summary": SQL + f"""SELECT s.recording_id, count(*) AS n_spikes, round(count(*) * {PER}.0::DOUBLE / {WINDOW[1] - WINDOW[0]}, 6) AS rate, count(DISTINCT electrode) AS n_electrodes,
  coalesce(max(i.n), 0) AS n_intervals FROM spikes s LEFT JOIN (SELECT recording_id, count(*) AS n FROM intervals WHERE a <= {WINDOW[1]} AND b >= {WINDOW[0]} GROUP BY recording_id) i ON s.recording_id = i.recording_id
  WHERE time BETWEEN {WINDOW[0]} AND {WINDOW[1]} GROUP BY s.recording_id""",
    "interval_overlap_clip": SQL + f"SELECT recording_id, interval_id, a AS start_time, b AS end_time, greatest(a, {WINDOW[0]}) AS clip_start, least(b, {WINDOW[1]}) AS clip_end FROM intervals WHERE a <= {WINDOW[1]} AND b >= {WINDOW[0]}",
    "electrode_subset": SQL + f"SELECT spike_id, recording_id, time, unit, electrode FROM spikes WHERE electrode BETWEEN 1 AND 8 AND time BETWEEN {WINDOW[0]} AND {WINDOW[1]}",
    "high_activity_windows": SQL + f""", span AS (SELECT recording_id, min(time) AS lo, max(time) AS hi FROM spikes GROUP BY recording_id),
grid AS (SELECT recording_id, lo, hi, unnest(range(0, CAST(ceil((hi - lo) / {30 * PER}.0::DOUBLE) AS BIGINT))) AS w FROM span),
win AS (SELECT recording_id, lo + w * {30 * PER} AS start_time, least(lo + (w + 1) * {30 * PER}, hi) AS end_time FROM grid),
c AS (SELECT win.recording_id, start_time, end_time, count(s.spike_id) AS n_spikes FROM win LEFT JOIN spikes s ON s.recording_id = win.recording_id AND s.time >= start_time AND s.time < end_time GROUP BY ALL)
SELECT recording_id, rank, start_time, end_time, round(n_spikes / 30.0::DOUBLE, 6) AS rate, n_spikes FROM (SELECT *, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY n_spikes DESC, start_time) AS INT) AS rank FROM c) WHERE rank <= 5""",
    "interval_durations": SQL + "SELECT interval_id, b - a AS duration FROM intervals",
    "interval_duration_stats": SQL + "SELECT recording_id, count(*) AS n, round(avg(b - a), 6) AS mean_duration, round(stddev_samp(b - a), 6) AS std_duration FROM intervals WHERE b > a GROUP BY recording_id",
    "interval_histogram": SQL + """, v AS (SELECT recording_id, CAST(b - a AS DOUBLE) AS v FROM intervals WHERE b > a),
e AS (SELECT recording_id, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v GROUP BY recording_id),
p AS (SELECT v.recording_id, least(floor((v - lo) / ((hi - lo) / 50)), 49) AS bin, count(*) AS n FROM v JOIN e ON v.recording_id = e.recording_id GROUP BY ALL),
g AS (SELECT recording_id, lo, hi, unnest(range(0, 50)) AS bin FROM e)
SELECT g.recording_id, CAST(g.bin AS INT) AS bin, round(lo + g.bin * ((hi - lo) / 50), 6) AS low, round(lo + (g.bin + 1) * ((hi - lo) / 50), 6) AS high, coalesce(n, 0) AS count FROM g LEFT JOIN p ON g.recording_id = p.recording_id AND g.bin = p.bin""",
    "qc_rankings": SQL + f""", k AS (SELECT 'unit' AS key_column, CAST(unit AS BIGINT) AS key_value FROM spikes UNION ALL SELECT 'electrode', CAST(electrode AS BIGINT) FROM spikes WHERE electrode IS NOT NULL),
c AS (SELECT key_column, key_value, count(*) AS n_spikes FROM k GROUP BY ALL), t AS (SELECT sum(x) AS ticks FROM (SELECT max(time) - min(time) AS x FROM spikes GROUP BY recording_id))
SELECT key_column, key_value, n_spikes, round(n_spikes * {PER}.0::DOUBLE / ticks, 6) AS rate, row_number() OVER (PARTITION BY key_column ORDER BY n_spikes DESC, key_value) AS rank FROM c, t""",
    "units_and_channels": SQL + "SELECT recording_id, count(DISTINCT unit) AS n_units, count(DISTINCT electrode) AS n_channels, string_agg(DISTINCT unit, ',' ORDER BY unit) AS units, string_agg(DISTINCT electrode, ',' ORDER BY electrode) AS channels FROM spikes GROUP BY recording_id",
    "units_per_channel": SQL + "SELECT electrode, count(DISTINCT unit) AS n_units, string_agg(DISTINCT unit, ',' ORDER BY unit) AS units, count(*) AS n_spikes FROM spikes WHERE electrode IS NOT NULL GROUP BY electrode",
    "electrode_schematic": SQL + "SELECT poly, electrode, x, y, CASE WHEN x > 0 THEN 'right' ELSE 'left' END AS side FROM geometry",
    "unit_channel_pivot": SQL + "SELECT unit, electrode, count(*) AS n_spikes FROM spikes GROUP BY ALL",
    "unit_spike_counts_topn": SQL + "SELECT unit, n_spikes, CAST(row_number() OVER (ORDER BY n_spikes DESC, unit) AS INT) AS rank FROM (SELECT unit, count(*) AS n_spikes FROM spikes GROUP BY unit ORDER BY 2 DESC, 1 LIMIT 20)",
}
