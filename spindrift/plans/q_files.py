"""Files written and read back: every writer and reader over whole tables, with the SQL of what went in.

Each query writes to a folder of its own in the shared folder and returns what the reader finds there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.scale import shared_path
from spindrift.operators import activity as A
from spindrift.plans import q_activity, q_geometry, q_psth, q_spectra, q_trains
from spindrift.plans.recording import SQL, TICKS_PER_SECOND, recording
from spindrift.sources import readers, sinks
from spindrift.sources.tables import table
from spindrift.sources.voltage import read_voltage

PER = TICKS_PER_SECOND
CHANNELS = 64


def _tick_file(spark: SparkSession, d: str) -> str:
    path = shared_path(spark, "file-spikes")
    sinks.write_spikes(recording(spark, d).spikes, path)
    return path


def _interval_file(spark: SparkSession, d: str) -> str:
    path = shared_path(spark, "file-intervals")
    recording(spark, d).intervals.orderBy("interval_id").select("Start", "End").write.mode("overwrite").csv(path, header=True)
    return path


def _geometry_file(spark: SparkSession, d: str) -> str:
    """Probe lines of four numbers, with a header of one word, a comment and a blank line."""
    path = shared_path(spark, "file-probe")
    lines = recording(spark, d).geometry.select(F.concat_ws("  ", *(F.col(c).cast("string") for c in ("poly", "electrode", "x", "y"))).alias("value"))
    spark.createDataFrame([("poly2",), ("# poly electrode x y",), ("",)], "value string").unionByName(lines).write.mode("overwrite").text(path)
    return path


def file_spike_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Spikes in ticks, the third column read as a channel."""
    return readers.read_spikes(spark, _tick_file(spark, d), ticks=True, third="channel")


def file_spike_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Spikes in seconds with blanks after the commas, brought to ticks."""
    path = shared_path(spark, "file-seconds")
    cell = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lines = recording(spark, d).spikes.select(F.concat_ws(", ", cell(F.col("time") / float(PER)), cell(F.col("unit")), cell(F.col("electrode"))).alias("value"))
    lines.write.mode("overwrite").text(path)
    return readers.adjust_to_ticks(readers.read_spikes(spark, path), PER)


def file_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals numbered by their position in the files."""
    return readers.read_intervals(spark, _interval_file(spark, d))


def file_geometry(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_geometry(spark, _geometry_file(spark, d))


def file_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Rows and seconds of the three parts of a recording read together."""
    b = readers.read_bundle(spark, _tick_file(spark, d), _interval_file(spark, d), _geometry_file(spark, d))
    one = lambda df, name, seconds: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(seconds), 2).alias("seconds"))
    return one(b.spikes, "spikes", "time_sec").unionByName(one(b.intervals, "intervals", F.col("End_sec") - F.col("Start_sec"))).unionByName(one(b.geometry, "geometry", F.lit(None).cast("double")))


def file_wide(spark: SparkSession, d: str) -> DataFrame:
    """Activity of the units of a wide table read from CSV, its columns found in the header and typed by their values."""
    path = shared_path(spark, "file-wide")
    rows = table(spark, d, "semi_from_table_designer")
    rows.write.mode("overwrite").csv(path, header=True)
    return A.unit_activity(A.long_activity(readers.read_wide(spark, path), ["semi_id"])).withColumn("rate_percent", F.round("rate_percent", 6))


def file_rates(spark: SparkSession, d: str) -> DataFrame:
    """Electrode rates, all numbers as doubles."""
    path = shared_path(spark, "file-rates")
    sinks.write_rates(q_geometry.electrode_firing_rate(spark, d), path)
    return spark.read.schema("poly double, electrode double, x double, y double, firing_rate double").csv(path, header=True)


def _again(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = shared_path(spark, "file-tables")
    sinks.write_tables({name: rows}, path)
    return spark.read.schema(rows.schema).csv(f"{path}/{name}", header=True)


def file_unit_activity(spark: SparkSession, d: str) -> DataFrame:
    return _again(spark, q_activity.unit_activity(spark, d), "activity")


def file_spike_counts(spark: SparkSession, d: str) -> DataFrame:
    return _again(spark, q_activity.spike_count_stats(spark, d), "counts")


def file_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return _again(spark, q_activity.activity_heatmap(spark, d), "heatmap")


def file_category_summary(spark: SparkSession, d: str) -> DataFrame:
    return _again(spark, q_activity.category_summary(spark, d), "durations")


def file_unit_stats(spark: SparkSession, d: str) -> DataFrame:
    return _again(spark, q_psth.psth_unit_stats(spark, d), "units")


def file_channel_stats(spark: SparkSession, d: str) -> DataFrame:
    return _again(spark, q_psth.psth_channel_stats(spark, d), "channels")


def file_patterns(spark: SparkSession, d: str) -> DataFrame:
    """What the JSON records of each train hold."""
    path = shared_path(spark, "file-patterns")
    rows = q_trains.pattern_records(spark, d)
    sinks.write_patterns(rows, path)
    sizes = [F.sum(F.size(c)).alias(f"n_{n}") for n, c in (("isi", "isi"), ("rates", "rates.rate"), ("bursts", "bursts"))]
    return readers.read_patterns(spark, path, rows.schema, compact=True).groupBy(*q_trains.TRAIN, "pattern_type").agg(*sizes)


def file_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Spectra by channel from Parquet, with the peak of the channel's JSON summary."""
    path = shared_path(spark, "file-spectrum")
    psd = q_spectra.dft_power(spark, d)
    sinks.write_spectrum(psd, q_spectra.peak_frequency(spark, d), path)
    peaks = spark.read.schema("channel int, peak_frequency double, shifted_frequency double").json(f"{path}/summary")
    return spark.read.parquet(f"{path}/psd").join(F.broadcast(peaks), "channel")  # a row a channel


def file_categories(spark: SparkSession, d: str) -> DataFrame:
    """Intervals from one folder a length category."""
    path = shared_path(spark, "file-categories")
    sinks.write_by_category(q_activity.interval_categories(spark, d), path)
    return spark.read.parquet(path)


def file_voltage(spark: SparkSession, d: str) -> DataFrame:
    """Raw voltage: samples in thousandths as int16, written by several tasks and read by ranges."""
    path = shared_path(spark, "file-voltage")
    v = q_spectra.voltage(spark, d)
    sinks.write_voltage(v.select("sample", "channel", F.floor(F.col("v").cast("double") * 1000).cast("int").alias("v")), path, CHANNELS)
    return read_voltage(spark, path, CHANNELS, q_spectra.RATE).select("sample", "channel", "v", F.round("time", 6).alias("time"))


QUERIES = {f.__name__: f for f in (
    file_spike_ticks, file_spike_seconds, file_intervals, file_geometry, file_bundle, file_wide, file_rates, file_unit_activity, file_spike_counts, file_heatmap, file_category_summary,
    file_unit_stats, file_channel_stats, file_patterns, file_spectrum, file_categories, file_voltage,
)}

ORACLES = {
    "file_spike_ticks": SQL + "SELECT time, unit, electrode AS channel FROM spikes",
    "file_spike_seconds": SQL + "SELECT time, unit, electrode FROM spikes",
    "file_intervals": SQL + 'SELECT row_number() OVER (ORDER BY interval_id) AS interval_id, a AS "Start", b AS "End" FROM intervals',
    "file_geometry": SQL + "SELECT * FROM geometry WHERE poly IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL",
    "file_bundle": SQL + f"""SELECT 'spikes' AS part, count(*) AS n_rows, round(sum(time / {PER}.0::DOUBLE), 2) AS seconds FROM spikes
  UNION ALL SELECT 'intervals', count(*), round(sum(b / {PER}.0::DOUBLE - a / {PER}.0::DOUBLE), 2) FROM intervals UNION ALL SELECT 'geometry', count(*), NULL FROM geometry WHERE poly IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL""",
    "file_wide": q_activity.ORACLES["unit_activity"],
    "file_rates": q_geometry._RATES + "SELECT CAST(poly AS DOUBLE) AS poly, CAST(electrode AS DOUBLE) AS electrode, x, y, round(firing_rate, 6) AS firing_rate FROM probe_rates",
    "file_unit_activity": q_activity.ORACLES["unit_activity"],
    "file_spike_counts": q_activity.ORACLES["spike_count_stats"],
    "file_heatmap": q_activity.ORACLES["activity_heatmap"],
    "file_category_summary": q_activity.ORACLES["category_summary"],
    "file_unit_stats": q_psth.ORACLES["psth_unit_stats"],
    "file_channel_stats": q_psth.ORACLES["psth_channel_stats"],
    "file_patterns": q_trains._FEATURES + """SELECT r.recording_id, r.unit, pattern_type, n_isi, coalesce(n_rates, 0) AS n_rates, n_bursts FROM rounded r
  JOIN (SELECT recording_id, unit, count(DISTINCT time) AS n_isi FROM spikes GROUP BY ALL) i ON i.recording_id = r.recording_id AND i.unit = r.unit
  LEFT JOIN (SELECT recording_id, unit, count(*) AS n_rates FROM grid GROUP BY ALL) g ON g.recording_id = r.recording_id AND g.unit = r.unit""",
    "file_spectrum": q_spectra._PSD + "SELECT psd.channel, psd.k, round(psd.freq, 6) AS freq, round(psd, 6) AS psd, peak_frequency, shifted_frequency FROM psd JOIN peaks ON peaks.channel = psd.channel",
    "file_categories": q_activity.ORACLES["interval_categories"],
    "file_voltage": f"SELECT CAST(vec_id AS BIGINT) AS sample, channel, CAST(floor(CAST(v AS DOUBLE) * 1000) AS SMALLINT) AS v, round(vec_id / {q_spectra.RATE}::DOUBLE, 6) AS time FROM (SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INT) AS channel, unnest(embedding) AS v FROM embeddings)",
}
