"""Queries of the general training-data problems (1, 3, 4 and 5) over the tables of a data folder, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.scale import bounded_broadcast
from spindrift.operators import eager, units
from spindrift.operators.orphans import Child, References
from spindrift.operators.sessions import sessions
from spindrift.plans.recording import SQL, in_ticks
from spindrift.sources.tables import table

GAP = 3_000
#: 30 kHz ticks in a block of interval states: about a minute and a half.
INTERVAL_BLOCK = 2_700_000


def tick_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Spikes of the recordings whose ``spikes_time_unit`` is exactly ``ticks``."""
    plain = table(spark, d, "recordings").where("spikes_time_unit = 'ticks'").select("recording_id").distinct()
    return table(spark, d, "spikes_time_adjusted").join(bounded_broadcast(plain), "recording_id", "left_semi")


def clocked_spikes(spark: SparkSession, d: str) -> DataFrame:
    """(recording_id, unit, electrode, time) of the spikes of all recordings, times in ticks; unit and electrode may be null."""
    spikes = table(spark, d, "spikes_time_adjusted").where("time IS NOT NULL")
    clocks = units.recording_units(table(spark, d, "recordings"), "spikes_time_unit", "spikes", spikes.select("recording_id", F.col("time").alias("value")))
    clocks = bounded_broadcast(clocks.select("recording_id", F.col("unit").alias("clock")))
    return spikes.join(clocks, "recording_id").select("recording_id", "unit", "electrode", in_ticks(F.col("time"), F.col("clock")).alias("time")).where("time IS NOT NULL")


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The sessions of every unit in every recording."""
    return sessions(clocked_spikes(spark, d), ["recording_id", "unit"], "time", GAP)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the plain tick recordings only."""
    plain = sessions(tick_spikes(spark, d), ["recording_id", "unit"], "time", GAP)
    return plain.where("n_events >= 3").select("recording_id", "unit", "start_time", "end_time")


def p1_unit_summary(spark: SparkSession, d: str) -> DataFrame:
    s = p1_sessions(spark, d)
    return s.groupBy("unit").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_events").alias("n_events"), F.max("duration").alias("longest"), F.sum("duration").alias("total_duration"))


def _spike_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spikes_time_adjusted").select("recording_id", F.col("spike_id").alias("row_id"), F.col("time").alias("value"))


def _pico_values(spark: SparkSession, d: str) -> DataFrame:
    both = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("Start", "End"))))
    return table(spark, d, "pico").select("recording_id", F.col("interval_id").alias("row_id"), both.alias("x")).select("recording_id", "row_id", "x.*")


def common_units(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, field_name, row_id, unit, value_us): every value of the four fields in microseconds (double)."""
    recordings = table(spark, d, "recordings")
    spikes, pico = _spike_values(spark, d), _pico_values(spark, d)
    su = units.recording_units(recordings, "spikes_time_unit", "spikes", spikes.select("recording_id", "value"))
    pu = units.recording_units(recordings, "pico_time_unit", "pico", pico.select("recording_id", "value"))
    semi = units.durations_to_microseconds(table(spark, d, "semi_from_table_designer"), "pico_Interval Duration", "pico_Interval Start", "pico_Interval End")
    return (
        units.to_microseconds(spikes, su).select(F.lit("spikes_time_adjusted").alias("table_name"), F.lit("time").alias("field_name"), "row_id", "unit", "value_us")
        .unionByName(units.to_microseconds(pico, pu).select(F.lit("pico").alias("table_name"), "field_name", "row_id", "unit", "value_us"))
        .unionByName(semi.select(F.lit("semi_from_table_designer").alias("table_name"), F.lit("pico_Interval Duration").alias("field_name"), F.col("semi_id").alias("row_id"), "unit", "value_us"))
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return common_units(spark, d).where("unit <> 'ticks' AND value_us IS NOT NULL").select("table_name", "field_name", "row_id", F.round("value_us").cast("bigint").alias("value_us"))


def p3_unit_summary(spark: SparkSession, d: str) -> DataFrame:
    return common_units(spark, d).groupBy("table_name", "field_name", "unit").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value_us").alias("n_values"), F.round(F.max("value_us") / 1e6, 3).alias("max_s"))


def _references(spark: SparkSession, d: str) -> tuple[References, list[Child]]:
    children = [Child("spikes_time_adjusted", table(spark, d, "spikes_time_adjusted"), "spike_id", "electrode", "loaded_at"), Child("electrode_firing_rates", table(spark, d, "electrode_firing_rates"), "rate_id", "electrode", "computed_at")]
    return References(table(spark, d, "electrode_cfg"), "electrode", "loaded_at", "removed_at"), children


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    references, children = _references(spark, d)
    return references.orphan_rows(children)


def p4_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    references, children = _references(spark, d)
    return references.report(children).select("table_name", F.col("period").cast("date").alias("month"), "kind", "n_rows", "n_keys")


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    """(recording_id, duration_s), a row a recording."""
    return table(spark, d, "recordings").groupBy("recording_id").agg(F.max("duration_s").alias("duration_s"))


def key_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per value of unit and electrode: its pairs with recordings (a spike without one makes a pair by itself, so that every spike
    counts once), and their share of all."""
    counts = eager.eager_join_aggregate(table(spark, d, "spikes_time_adjusted"), _lengths(spark, d), "recording_id", ["unit", "electrode"], how="left")
    return eager.shares(counts, "n_pairs")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    hot = key_counts(spark, d).where("key_value IS NOT NULL AND n_pairs * 40 >= n_total")
    return hot.select("key_column", F.col("key_value").cast("int").alias("key_value"))


def p5_key_rates(spark: SparkSession, d: str) -> DataFrame:
    """Spikes and mean rate of each unit and electrode over the recordings it occurs in."""
    out = eager.eager_join_aggregate(table(spark, d, "spikes_time_adjusted"), _lengths(spark, d), "recording_id", ["unit", "electrode"], right_once=["duration_s"])
    return out.where("key_value IS NOT NULL").select("key_column", "key_value", F.col("n_left").alias("n_spikes"), F.col("n_groups").alias("n_recordings"), F.round(F.col("n_left") / F.col("once_duration_s"), 6).alias("rate"))


def p5_unit_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals between the spikes of each unit and of each electrode within recordings, all recordings in ticks."""
    columns = ("unit", "electrode")
    # the key column travels as its number
    keyed = F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("c"), F.col(c).cast("int").alias("key_value")) for i, c in enumerate(columns))))
    rows = clocked_spikes(spark, d).select("recording_id", "time", keyed.alias("x")).select("recording_id", "time", "x.*")
    out = eager.interval_states(rows, ["c", "key_value"], ["recording_id"], "time", INTERVAL_BLOCK)
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("c").cast("int") + 1)
    return out.select(name.alias("key_column"), F.col("key_value").cast("bigint").alias("key_value"), "n_events", "n_trains", "n_intervals", "sum_interval", "min_interval", "max_interval", F.round("mean_interval", 6).alias("mean_interval"))


def p5_stimulus_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Spike-by-interval pairs of each unit and electrode within recordings, counted without building a pair."""
    pico = table(spark, d, "pico").select("recording_id", (F.col("End") - F.col("Start")).alias("span"))
    out = eager.eager_join_aggregate(table(spark, d, "spikes_time_adjusted"), pico, "recording_id", ["unit", "electrode"], left_sums=["time"], right_sums=["span"])
    return out.select("key_column", "key_value", "n_pairs", F.col("sum_time").cast("double").alias("sum_time"), F.col("sum_span").cast("bigint").alias("sum_span"))


QUERIES = {f.__name__: f for f in (p1_found, p1_sessions, p1_unit_summary, p3_found, p3_unit_summary, p4_found, p4_orphans_by_month, p5_found, p5_key_rates, p5_unit_intervals, p5_stimulus_pairs)}

_TICKS = "spikes AS (SELECT s.* FROM spikes_time_adjusted s WHERE s.recording_id IN (SELECT recording_id FROM recordings WHERE spikes_time_unit = 'ticks'))"
_SESSIONS = f"""
WITH {_TICKS},
t AS (SELECT DISTINCT recording_id, unit, time FROM spikes WHERE unit IS NOT NULL AND time IS NOT NULL AND recording_id IS NOT NULL),
g AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY recording_id, unit ORDER BY time) <= {GAP} THEN 0 ELSE 1 END AS first_one FROM t),
i AS (SELECT *, sum(first_one) OVER (PARTITION BY recording_id, unit ORDER BY time) AS session FROM g),
s AS (SELECT recording_id, unit, CAST(min(time) AS BIGINT) AS start_time, CAST(max(time) AS BIGINT) AS end_time, CAST(max(time) - min(time) AS BIGINT) AS duration, count(*) AS n_events
      FROM i GROUP BY recording_id, unit, session)
"""
_CLOCKED = SQL.replace("WHERE time IS NOT NULL AND unit IS NOT NULL)", "WHERE time IS NOT NULL)")
_ALL_SESSIONS = SQL + f""", t AS (SELECT DISTINCT recording_id, unit, time FROM spikes),
g AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY recording_id, unit ORDER BY time) <= {GAP} THEN 0 ELSE 1 END AS first_one FROM t),
i AS (SELECT *, sum(first_one) OVER (PARTITION BY recording_id, unit ORDER BY time) AS session FROM g),
s AS (SELECT recording_id, unit, min(time) AS start_time, max(time) AS end_time, max(time) - min(time) AS duration, count(*) AS n_events FROM i GROUP BY recording_id, unit, session)
"""
_ORPHANS = """
WITH refs AS (
  SELECT 'spikes_time_adjusted' AS table_name, spike_id AS row_id, CAST(electrode AS DOUBLE) AS electrode, loaded_at AS seen FROM spikes_time_adjusted
  UNION ALL SELECT 'electrode_firing_rates', rate_id, CAST(electrode AS DOUBLE), computed_at FROM electrode_firing_rates),
begins AS (SELECT electrode, min(loaded_at) AS begins FROM electrode_cfg GROUP BY electrode),
orphans AS (
  SELECT r.table_name, r.row_id, r.seen, r.electrode, CASE WHEN b.begins IS NULL THEN 'missing' WHEN r.seen < b.begins THEN 'late' ELSE 'removed' END AS kind
  FROM refs r LEFT JOIN begins b ON r.electrode = b.electrode
  WHERE r.electrode IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM electrode_cfg c WHERE c.electrode = r.electrode AND c.loaded_at <= r.seen AND (c.removed_at IS NULL OR r.seen < c.removed_at))
    AND (r.seen IS NOT NULL OR b.begins IS NULL))
"""
_KEYS = """
WITH keys AS (SELECT 'unit' AS key_column, CAST(unit AS BIGINT) AS key_value, recording_id, time FROM spikes_time_adjusted
  UNION ALL SELECT 'electrode', CAST(electrode AS BIGINT), recording_id, time FROM spikes_time_adjusted)
"""

# The SQL side finds a recording's unit from its largest value and its length alone, and reads durations by pattern.
_CLOCK = "CASE WHEN {r} < 4472 THEN 'ms' WHEN {r} < 22360 THEN 'smp20k' WHEN {r} < 27386 THEN 'smp25k' WHEN {r} < 173205 THEN 'ticks' ELSE 'us' END"
_US = "CAST({v} AS DOUBLE) * CASE {u} WHEN 'ms' THEN 1000 WHEN 'smp20k' THEN 50 WHEN 'smp25k' THEN 40 WHEN 'us' THEN 1 WHEN 's' THEN 1000000 WHEN 'ticks' THEN 100 END / CASE {u} WHEN 'ticks' THEN 3 ELSE 1 END"
_UNITS = f"""
WITH spike_clock AS (SELECT s.recording_id, {_CLOCK.format(r='max(time) / max(duration_s)')} AS unit FROM spikes_time_adjusted s JOIN recordings r ON r.recording_id = s.recording_id WHERE time IS NOT NULL GROUP BY s.recording_id),
pico_clock AS (SELECT p.recording_id, {_CLOCK.format(r='max(greatest("Start", "End")) / max(duration_s)')} AS unit FROM pico p JOIN recordings r ON r.recording_id = p.recording_id GROUP BY p.recording_id),
ends AS (SELECT recording_id, interval_id, 'Start' AS field_name, "Start" AS v FROM pico UNION ALL SELECT recording_id, interval_id, 'End', "End" FROM pico),
texts AS (SELECT semi_id, abs("pico_Interval End" - "pico_Interval Start") * 100 / 3.0::DOUBLE AS span, lower("pico_Interval Duration") AS t FROM semi_from_table_designer),
typical AS (SELECT quantile_cont(span, 0.5) AS m FROM texts WHERE span > 0),
parts AS (SELECT semi_id, CASE WHEN span > 0 THEN span ELSE m END AS span, regexp_extract(t, '[0-9][0-9.,]*(e[0-9]+)?') AS n,
  CASE WHEN regexp_matches(t, 'khz|tick|tk') THEN 'ticks' WHEN regexp_matches(t, '(us|µs|μs|usec|microseconds)$') THEN 'us' WHEN regexp_matches(t, '(ms|msec|millisec.*)$') THEN 'ms' WHEN regexp_matches(t, '[0-9 ](s|sec|seconds)$') THEN 's' END AS told FROM texts CROSS JOIN typical),
numbers AS (SELECT semi_id, span, told, CAST(CASE WHEN told = 'us' THEN replace(n, ',', '') ELSE replace(n, ',', '.') END AS DOUBLE) AS v FROM parts WHERE n <> ''),
readings AS (SELECT semi_id, v, span, u.unit FROM numbers JOIN (VALUES ('ticks'), ('ms'), ('us'), ('s')) AS u(unit) ON told IS NULL OR told = u.unit),
durations AS (SELECT semi_id, unit, us FROM (SELECT semi_id, unit, us, row_number() OVER (PARTITION BY semi_id ORDER BY abs(ln(us / span))) AS k FROM (SELECT semi_id, span, unit, {_US.format(v='v', u='unit')} AS us FROM readings) WHERE us > 0) WHERE k = 1),
vals AS (SELECT 'spikes_time_adjusted' AS table_name, 'time' AS field_name, spike_id AS row_id, unit, {_US.format(v='time', u='c.unit')} AS us FROM (SELECT recording_id, spike_id, time FROM spikes_time_adjusted) s LEFT JOIN spike_clock c ON c.recording_id = s.recording_id
  UNION ALL SELECT 'pico', field_name, interval_id, unit, {_US.format(v='v', u='c.unit')} FROM ends e LEFT JOIN pico_clock c ON c.recording_id = e.recording_id
  UNION ALL SELECT 'semi_from_table_designer', 'pico_Interval Duration', t.semi_id, d.unit, d.us FROM texts t LEFT JOIN durations d ON d.semi_id = t.semi_id)
"""

ORACLES = {
    "p3_found": _UNITS + "SELECT table_name, field_name, row_id, CAST(round(us) AS BIGINT) AS value_us FROM vals WHERE unit <> 'ticks' AND us IS NOT NULL",
    "p3_unit_summary": _UNITS + "SELECT table_name, field_name, unit, count(*) AS n_rows, count(us) AS n_values, round(max(us) / 1e6, 3) AS max_s FROM vals GROUP BY ALL",
    "p1_found": _SESSIONS + "SELECT recording_id, unit, start_time, end_time FROM s WHERE n_events >= 3",
    "p1_sessions": _ALL_SESSIONS + "SELECT * FROM s",
    "p1_unit_summary": _ALL_SESSIONS + "SELECT unit, count(*) AS n_sessions, CAST(sum(n_events) AS BIGINT) AS n_events, max(duration) AS longest, CAST(sum(duration) AS BIGINT) AS total_duration FROM s GROUP BY unit",
    "p4_found": _ORPHANS + "SELECT table_name, row_id, kind FROM orphans",
    "p4_orphans_by_month": _ORPHANS + "SELECT table_name, CAST(date_trunc('month', seen) AS DATE) AS month, kind, count(*) AS n_rows, count(DISTINCT electrode) AS n_keys FROM orphans GROUP BY ALL",
    "p5_found": _KEYS + "SELECT key_column, CAST(key_value AS INT) AS key_value FROM keys WHERE key_value IS NOT NULL GROUP BY key_column, key_value HAVING count(*) * 40 >= (SELECT count(*) FROM spikes_time_adjusted)",
    "p5_key_rates": _KEYS + """, n AS (SELECT key_column, key_value, recording_id, count(*) AS n FROM keys WHERE key_value IS NOT NULL GROUP BY ALL)
SELECT key_column, key_value, CAST(sum(n) AS BIGINT) AS n_spikes, count(*) AS n_recordings, round(sum(n) / sum(duration_s), 6) AS rate FROM n JOIN recordings USING (recording_id) GROUP BY key_column, key_value""",
    "p5_unit_intervals": _CLOCKED + """, k AS (SELECT 'unit' AS key_column, CAST(unit AS BIGINT) AS key_value, recording_id, time FROM spikes UNION ALL SELECT 'electrode', CAST(electrode AS BIGINT), recording_id, time FROM spikes),
d AS (SELECT *, time - lag(time) OVER (PARTITION BY key_column, key_value, recording_id ORDER BY time) AS d FROM k WHERE key_value IS NOT NULL)
SELECT key_column, key_value, count(*) AS n_events, count(DISTINCT recording_id) AS n_trains, count(d) AS n_intervals, CAST(coalesce(sum(d), 0) AS BIGINT) AS sum_interval,
  min(d) AS min_interval, max(d) AS max_interval, round(avg(d), 6) AS mean_interval FROM d GROUP BY ALL""",
    "p5_stimulus_pairs": _KEYS + """, p AS (SELECT recording_id, count(*) AS m, sum("End" - "Start") AS span FROM pico GROUP BY recording_id),
k AS (SELECT key_column, key_value, recording_id, count(*) AS n, sum(time) AS t FROM keys GROUP BY ALL)
SELECT key_column, key_value, CAST(sum(n * m) AS BIGINT) AS n_pairs, CAST(sum(t * m) AS DOUBLE) AS sum_time, CAST(sum(span * n) AS BIGINT) AS sum_span FROM k JOIN p USING (recording_id) GROUP BY key_column, key_value""",
}
