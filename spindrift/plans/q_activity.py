"""Queries over the activity of units in intervals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.operators import activity as A
from spindrift.operators.grids import histogram, pearson
from spindrift.operators.ranges import overlap_join
from spindrift.plans.recording import SQL, recording
from spindrift.sources.tables import table

START, END = "pico_Interval Start", "pico_Interval End"
TICKS_PER_MS = 30
#: Ticks in a bucket of the overlap join: about the length of an interval.
SPAN = 15_000


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return A.categorised(table(spark, d, "semi_from_table_designer"), START, END, TICKS_PER_MS)


def _long(spark: SparkSession, d: str) -> DataFrame:
    return A.long_activity(_rows(spark, d), ["semi_id", "category"])


def wide_interval_table(spark: SparkSession, d: str) -> DataFrame:
    """Presence and count of every unit in every interval, from the spikes themselves, in long form: a row an interval and unit
    with spikes in it, and one without a unit and a count of 0 for an interval without any."""
    r = recording(spark, d)
    spans = r.intervals.where("End > Start")
    pairs = overlap_join(r.spikes, spans, ["recording_id"], SPAN)
    return A.long_table(pairs.select("interval_id", "unit"), spans.select("interval_id", "Start", "End")).withColumnsRenamed({"Start": "start_time", "End": "end_time"})


def interval_categories(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("semi_id", F.round("duration_ms", 6).alias("duration_ms"), "category")


def category_share(spark: SparkSession, d: str) -> DataFrame:
    counts = _rows(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("category", "n", F.round(100 * F.col("n") / counts.agg(F.sum("n")).scalar(), 6).alias("percent"))


def duration_counts(spark: SparkSession, d: str) -> DataFrame:
    """The ten shortest lengths that occur, with their number and part of all rows."""
    rows = table(spark, d, "semi_from_table_designer").select((F.col(f"`{END}`") - F.col(f"`{START}`")).alias("duration"))
    ten = rows.where("duration IS NOT NULL").groupBy("duration").agg(F.count(F.lit(1)).alias("n")).orderBy("duration").limit(10)
    return ten.select("duration", "n", F.round(100 * F.col("n") / rows.agg(F.count(F.lit(1))).scalar(), 6).alias("percent"))


def unit_activity(spark: SparkSession, d: str) -> DataFrame:
    return A.unit_activity(_long(spark, d)).withColumn("rate_percent", F.round("rate_percent", 6))


def activity_by_duration(spark: SparkSession, d: str) -> DataFrame:
    return A.activity_by_category(_long(spark, d)).withColumn("rate_percent", F.round("rate_percent", 6))


def spike_count_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.spike_count_stats(_long(spark, d)).withColumn("mean_spikes", F.round("mean_spikes", 6))


def activity_heatmap(spark: SparkSession, d: str) -> DataFrame:
    out = A.heatmap(A.activity_by_category(_long(spark, d)))
    return out.select("unit", *(F.round(c, 6).alias(c) for c in A.CATEGORIES))


def category_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.category_summary(_rows(spark, d), _long(spark, d)).withColumn("mean_presence", F.round("mean_presence", 6))


def presence_corr(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of the presence of the ten most active units over the intervals."""
    long = _long(spark, d)
    busy = A.unit_activity(long).orderBy(F.col("active_intervals").desc(), "unit").limit(10).select("unit")
    out = pearson(long.join(F.broadcast(busy), "unit", "left_semi"), "unit", "semi_id", "presence")
    return out.withColumn("corr", F.round("corr", 6))


def activity_vs_count(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d)
    out = A.unit_activity(long).join(A.spike_count_stats(long), "unit")
    return out.select("unit", "active_intervals", F.round("rate_percent", 6).alias("rate_percent"), "total_spikes", F.round("mean_spikes", 6).alias("mean_spikes"))


def activity_boxplot(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of the units' activity rates in each category."""
    rows = A.activity_by_category(_long(spark, d)).groupBy("category").agg(F.percentile("rate_percent", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("q"))
    return rows.select("category", *(F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(("low", "q1", "median", "q3", "high"))))


def activity_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Display histogram of active intervals per unit in 20 equal bins."""
    out = histogram(A.unit_activity(_long(spark, d)), "active_intervals", 20)
    return out.withColumns({c: F.round(c, 6) for c in ("low", "high")})


def top_bottom_units(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    """The ``n`` most and the ``n`` least active units, ranked from either end."""
    units = A.unit_activity(_long(spark, d)).select("unit", "active_intervals")
    one = W.partitionBy(F.lit(1))
    most = units.orderBy(F.col("active_intervals").desc(), "unit").limit(n).select(F.lit("most").alias("side"), "*", F.row_number().over(one.orderBy(F.col("active_intervals").desc(), "unit")).alias("rank"))
    least = units.orderBy("active_intervals", "unit").limit(n).select(F.lit("least").alias("side"), "*", F.row_number().over(one.orderBy("active_intervals", "unit")).alias("rank"))
    return most.unionByName(least)


def summary_tables(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen most and least active units."""
    return top_bottom_units(spark, d, 15)


def unit_explorer(spark: SparkSession, d: str) -> DataFrame:
    """The four most active units, category by category, with their spike counts."""
    long = _long(spark, d)
    four = A.unit_activity(long).orderBy(F.col("active_intervals").desc(), "unit").limit(4).select("unit")
    by = A.activity_by_category(long).join(F.broadcast(four), "unit", "left_semi").withColumn("rate_percent", F.round("rate_percent", 6))
    return by.join(A.spike_count_stats(long).select("unit", "total_spikes", "max_spikes"), "unit")


def dataset_overview(spark: SparkSession, d: str) -> DataFrame:
    """One row: range of the intervals, their shortest and longest, mean activity rate, mean and total spikes, most and least active unit."""
    long = _long(spark, d)
    rows = _rows(spark, d).agg(F.count(F.lit(1)).alias("n_intervals"), F.min(f"`{START}`").alias("min_start"), F.max(f"`{END}`").alias("max_end"), F.round(F.min("duration_ms"), 6).alias("min_ms"), F.round(F.max("duration_ms"), 6).alias("max_ms"))
    order = lambda sign: F.min_by("unit", F.struct((F.col("active_intervals") * sign).alias("a"), F.col("unit").alias("u")))
    units = A.unit_activity(long).agg(F.count(F.lit(1)).alias("n_units"), F.round(F.avg("rate_percent"), 6).alias("mean_rate_percent"), order(-1).alias("most_active"), order(1).alias("least_active"))
    counts = A.spike_count_stats(long).agg(F.sum("total_spikes").alias("total_spikes"), F.round(F.avg("total_spikes"), 6).alias("mean_unit_spikes"))
    return rows.withColumns({c: df.select(c).scalar() for df in (units, counts) for c in df.columns})


QUERIES = {f.__name__: f for f in (
    wide_interval_table, interval_categories, category_share, duration_counts, unit_activity, activity_by_duration, spike_count_stats, activity_heatmap, category_summary,
    presence_corr, activity_vs_count, activity_boxplot, activity_histogram, top_bottom_units, summary_tables, unit_explorer, dataset_overview,
)}

_CATEGORY = "CASE " + " ".join(f"WHEN ms BETWEEN {lo} AND {hi} THEN '{name}'" for name, (lo, hi) in reversed(A.CATEGORIES.items())) + " ELSE 'other' END"
_NAMES = "(VALUES " + ", ".join(f"('{c}')" for c in A.CATEGORIES) + ") AS n(category)"
_LONG = f"""
WITH wide AS (SELECT *, {_CATEGORY} AS category FROM (SELECT *, ("{END}" - "{START}") / 30.0::DOUBLE AS ms FROM semi_from_table_designer)),
pres AS (SELECT semi_id, category, CAST(split_part(c, '_', 2) AS INT) AS unit, CAST(v AS BIGINT) AS presence FROM wide UNPIVOT INCLUDE NULLS (v FOR c IN (COLUMNS('.*Event Presence')))),
cnt AS (SELECT semi_id, CAST(split_part(c, '_', 2) AS INT) AS unit, CAST(v AS BIGINT) AS count FROM wide UNPIVOT INCLUDE NULLS (v FOR c IN (COLUMNS('.*Event Count')))),
long AS (SELECT p.semi_id, p.category, p.unit, p.presence, c.count FROM pres p JOIN cnt c ON c.semi_id = p.semi_id AND c.unit = p.unit),
act AS (SELECT unit, CAST(coalesce(sum(presence), 0) AS BIGINT) AS active_intervals, count(*) AS total_intervals, 100.0::DOUBLE * coalesce(sum(presence), 0) / count(*) AS rate_percent FROM long GROUP BY unit),
stats AS (SELECT unit, CAST(sum(count) AS BIGINT) AS total_spikes, max(count) AS max_spikes, avg(count) AS mean_spikes, CAST(sum(CASE WHEN count > 0 THEN 1 ELSE 0 END) AS BIGINT) AS intervals_with_spikes FROM long GROUP BY unit),
bycat AS (SELECT n.category, u.unit, coalesce(q.active_intervals, 0) AS active_intervals, coalesce(q.total_intervals, 0) AS total_intervals, coalesce(q.rate_percent, 0) AS rate_percent FROM {_NAMES} CROSS JOIN (SELECT DISTINCT unit FROM long) u
  LEFT JOIN (SELECT category, unit, CAST(coalesce(sum(presence), 0) AS BIGINT) AS active_intervals, count(*) AS total_intervals, 100.0::DOUBLE * coalesce(sum(presence), 0) / count(*) AS rate_percent FROM long GROUP BY ALL) q ON q.category = n.category AND q.unit = u.unit)
"""

_TOP_BOTTOM = _LONG + """, m AS (SELECT unit, active_intervals, CAST(row_number() OVER (ORDER BY active_intervals DESC, unit) AS INT) AS a, CAST(row_number() OVER (ORDER BY active_intervals, unit) AS INT) AS b FROM act)
SELECT 'most' AS side, unit, active_intervals, a AS rank FROM m WHERE a <= {n} UNION ALL SELECT 'least', unit, active_intervals, b FROM m WHERE b <= {n}"""

ORACLES = {
    "wide_interval_table": SQL + """, pairs AS (SELECT i.interval_id, s.unit, count(*) AS n FROM intervals i JOIN spikes s ON s.recording_id = i.recording_id AND s.time BETWEEN i.a AND i.b WHERE i.b > i.a GROUP BY ALL)
SELECT i.interval_id, a AS start_time, b AS end_time, b - a AS duration, p.unit, CASE WHEN p.n > 0 THEN 1 ELSE 0 END AS presence, coalesce(p.n, 0) AS count FROM intervals i LEFT JOIN pairs p ON p.interval_id = i.interval_id WHERE b > a""",
    "interval_categories": _LONG + "SELECT semi_id, round(ms, 6) AS duration_ms, category FROM wide",
    "category_share": _LONG + "SELECT category, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM wide), 6) AS percent FROM wide GROUP BY category",
    "duration_counts": f'SELECT duration, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM semi_from_table_designer), 6) AS percent FROM (SELECT "{END}" - "{START}" AS duration FROM semi_from_table_designer) WHERE duration IS NOT NULL GROUP BY duration ORDER BY duration LIMIT 10',
    "unit_activity": _LONG + "SELECT unit, active_intervals, total_intervals, round(rate_percent, 6) AS rate_percent FROM act",
    "activity_by_duration": _LONG + "SELECT category, unit, active_intervals, total_intervals, round(rate_percent, 6) AS rate_percent FROM bycat",
    "spike_count_stats": _LONG + "SELECT unit, total_spikes, max_spikes, round(mean_spikes, 6) AS mean_spikes, intervals_with_spikes FROM stats",
    "activity_heatmap": _LONG + "SELECT unit, " + ", ".join(f"""round(max(CASE WHEN category = '{c}' THEN rate_percent END), 6) AS "{c}" """ for c in A.CATEGORIES) + " FROM bycat GROUP BY unit",
    "category_summary": _LONG + """, u AS (SELECT category, unit, coalesce(sum(presence), 0) AS p, coalesce(sum(count), 0) AS s FROM long WHERE category <> 'other' GROUP BY ALL), n AS (SELECT category, count(*) AS n_intervals FROM wide WHERE category <> 'other' GROUP BY category)
SELECT u.category, any_value(n_intervals) AS n_intervals, CAST(sum(p) AS BIGINT) AS total_presence, round(CAST(sum(p) AS DOUBLE) / any_value(n_intervals), 6) AS mean_presence, CAST(sum(CASE WHEN p > 0 THEN 1 ELSE 0 END) AS BIGINT) AS active_units, CAST(sum(s) AS BIGINT) AS total_spikes
FROM u JOIN n ON n.category = u.category GROUP BY u.category""",
    "presence_corr": _LONG + """, busy AS (SELECT unit FROM act ORDER BY active_intervals DESC, unit LIMIT 10), l AS (SELECT semi_id, unit, CAST(presence AS DOUBLE) AS v FROM long WHERE presence IS NOT NULL AND unit IN (SELECT unit FROM busy))
SELECT a.unit AS i, b.unit AS j, round(CASE WHEN stddev_pop(a.v) * stddev_pop(b.v) > 1e-12 THEN covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) END, 6) AS corr FROM l a JOIN l b ON a.semi_id = b.semi_id AND a.unit <= b.unit GROUP BY ALL""",
    "activity_vs_count": _LONG + "SELECT act.unit, active_intervals, round(rate_percent, 6) AS rate_percent, total_spikes, round(mean_spikes, 6) AS mean_spikes FROM act JOIN stats ON stats.unit = act.unit",
    "activity_boxplot": _LONG + "SELECT category, " + ", ".join(f"round(quantile_cont(rate_percent, {q}), 6) AS {n}" for q, n in ((0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "high"))) + " FROM bycat GROUP BY category",
    "activity_histogram": _LONG + """, v AS (SELECT CAST(active_intervals AS DOUBLE) AS v FROM act), e AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v),
p AS (SELECT least(floor((v - lo) / ((hi - lo) / 20)), 19) AS bin, count(*) AS n FROM v, e GROUP BY ALL), g AS (SELECT lo, hi, unnest(range(0, 20)) AS bin FROM e)
SELECT CAST(g.bin AS INT) AS bin, round(lo + g.bin * ((hi - lo) / 20), 6) AS low, round(lo + (g.bin + 1) * ((hi - lo) / 20), 6) AS high, coalesce(n, 0) AS count FROM g LEFT JOIN p ON g.bin = p.bin""",
    "top_bottom_units": _TOP_BOTTOM.replace("{n}", "5"),
    "summary_tables": _TOP_BOTTOM.replace("{n}", "15"),
    "unit_explorer": _LONG + "SELECT b.category, b.unit, active_intervals, total_intervals, round(rate_percent, 6) AS rate_percent, total_spikes, max_spikes FROM bycat b JOIN stats s ON s.unit = b.unit WHERE b.unit IN (SELECT unit FROM act ORDER BY active_intervals DESC, unit LIMIT 4)",
    "dataset_overview": _LONG + f"""SELECT (SELECT count(*) FROM wide) AS n_intervals, (SELECT min("{START}") FROM wide) AS min_start, (SELECT max("{END}") FROM wide) AS max_end, (SELECT round(min(ms), 6) FROM wide) AS min_ms, (SELECT round(max(ms), 6) FROM wide) AS max_ms,
  (SELECT count(*) FROM act) AS n_units, (SELECT round(avg(rate_percent), 6) FROM act) AS mean_rate_percent, (SELECT unit FROM act ORDER BY active_intervals DESC, unit LIMIT 1) AS most_active, (SELECT unit FROM act ORDER BY active_intervals, unit LIMIT 1) AS least_active,
  (SELECT CAST(sum(total_spikes) AS BIGINT) FROM stats) AS total_spikes, (SELECT round(avg(total_spikes), 6) FROM stats) AS mean_unit_spikes""",
}
