"""The recordings on one clock: spikes and intervals of a data folder in 30 kHz ticks, written once a session.

Every recording keeps its times in a unit of its own. The unit is resolved once, the values are converted (half to even, as
when seconds become ticks), and the two tables are kept in the shared folder for all queries that follow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.scale import CODEC, bounded_broadcast, state_of, written
from spindrift.operators.units import recording_units
from spindrift.sources.tables import table

TICKS_PER_SECOND = 30_000
#: Ticks in one unit, as a fraction.
IN_TICKS = {"ticks": (1, 1), "smp20k": (3, 2), "smp25k": (6, 5), "ms": (30, 1), "us": (3, 100)}

#: What was written for a session and folder, and the state of the files it was written from.
_kept: dict[tuple[str, str], tuple[list, Recording]] = {}
SOURCES = ("recordings", "spikes_time_adjusted", "pico", "electrode_cfg")


@dataclass(frozen=True)
class Recording:
    """spikes (spike_id, recording_id, time, unit, electrode), intervals (interval_id, recording_id, Start, End) and geometry
    (poly, electrode, x, y), times in ticks."""

    spikes: DataFrame
    intervals: DataFrame
    geometry: DataFrame


def in_ticks(value: Column, unit: Column) -> Column:
    """``value`` of a unit in ticks, halves to even; null for an unknown unit."""
    out = F.lit(None).cast("bigint")
    for name, (num, den) in IN_TICKS.items():
        out = F.when(unit == name, F.rint(value.cast("double") * num / den).cast("bigint")).otherwise(out)
    return out


def geometry(spark: SparkSession, d: str) -> DataFrame:
    """The last entry of each electrode: (poly, electrode, x, y)."""
    last = W.partitionBy("electrode").orderBy(F.col("loaded_at").desc(), "poly", "x", "y")
    rows = table(spark, d, "electrode_cfg").where("electrode IS NOT NULL").withColumn("k", F.row_number().over(last))
    return rows.where("k = 1").select("poly", "electrode", "x", "y")


def recording(spark: SparkSession, d: str, refresh: bool = False) -> Recording:
    """The recordings of folder ``d``. Spikes without a time, unit or recording are left out, as are intervals without a start
    or end; swapped ends are put in order; an electrode may be null.

    What was written is used again in the session until a file of the folder changes, or ``refresh`` asks for a new copy.
    """
    key = (spark.sparkContext.applicationId, d)
    state = [state_of(spark, f"{d}/{name}.parquet") for name in SOURCES]
    if refresh or key not in _kept or _kept[key][0] != state:
        recordings = table(spark, d, "recordings")
        raw = table(spark, d, "spikes_time_adjusted").select("spike_id", "recording_id", F.col("time").alias("value"), F.col("unit").alias("u"), "electrode").where("value IS NOT NULL AND u IS NOT NULL")
        units = recording_units(recordings, "spikes_time_unit", "spikes", raw.select("recording_id", "value"))
        spikes = raw.join(bounded_broadcast(units), "recording_id").select("spike_id", "recording_id", in_ticks(F.col("value"), F.col("unit")).alias("time"), F.col("u").alias("unit"), "electrode").where("time IS NOT NULL")
        pico = table(spark, d, "pico").select("interval_id", "recording_id", F.least("Start", "End").alias("a"), F.greatest("Start", "End").alias("b")).where("Start IS NOT NULL AND End IS NOT NULL")
        units = recording_units(recordings, "pico_time_unit", "pico", pico.select("recording_id", F.col("b").alias("value")))
        intervals = pico.join(bounded_broadcast(units), "recording_id").select("interval_id", "recording_id", in_ticks(F.col("a"), F.col("unit")).alias("Start"), in_ticks(F.col("b"), F.col("unit")).alias("End")).where("Start IS NOT NULL")
        _kept[key] = state, Recording(written(spikes, "spikes", CODEC), written(intervals, "intervals"), geometry(spark, d))
    return _kept[key][1]


def _unit_sql(rate: str) -> str:
    """The unit whose clock a rate lies nearest to; borders are the geometric means of neighbouring clocks."""
    return f"CASE WHEN {rate} < 4472 THEN 'ms' WHEN {rate} < 22360 THEN 'smp20k' WHEN {rate} < 27386 THEN 'smp25k' WHEN {rate} < 173205 THEN 'ticks' ELSE 'us' END"


def _ticks_sql(value: str) -> str:
    cases = " ".join(f"WHEN '{u}' THEN CAST({value} AS DOUBLE) * {n} / {m}" for u, (n, m) in IN_TICKS.items())
    return f"CAST(round_even(CASE clock {cases} END, 0) AS BIGINT)"


#: The same three relations for the SQL side, where the unit comes from the largest value and the recording's length alone.
SQL = f"""
WITH spike_clock AS (SELECT s.recording_id, {_unit_sql('max(s.time) / max(r.duration_s)')} AS clock FROM spikes_time_adjusted s JOIN recordings r ON s.recording_id = r.recording_id WHERE s.time IS NOT NULL GROUP BY s.recording_id),
pico_clock AS (SELECT p.recording_id, {_unit_sql('max(greatest(p."Start", p."End")) / max(r.duration_s)')} AS clock FROM pico p JOIN recordings r ON p.recording_id = r.recording_id GROUP BY p.recording_id),
spikes AS (SELECT spike_id, s.recording_id AS recording_id, {_ticks_sql('time')} AS time, unit, electrode FROM spikes_time_adjusted s JOIN spike_clock c ON s.recording_id = c.recording_id WHERE time IS NOT NULL AND unit IS NOT NULL),
intervals AS (SELECT interval_id, p.recording_id AS recording_id, {_ticks_sql('least("Start", "End")')} AS a, {_ticks_sql('greatest("Start", "End")')} AS b FROM pico p JOIN pico_clock c ON p.recording_id = c.recording_id WHERE "Start" IS NOT NULL AND "End" IS NOT NULL),
geometry AS (SELECT poly, electrode, x, y FROM (SELECT *, row_number() OVER (PARTITION BY electrode ORDER BY loaded_at DESC, poly, x, y) AS k FROM electrode_cfg WHERE electrode IS NOT NULL) WHERE k = 1)
"""
