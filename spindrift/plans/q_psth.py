"""Queries over peri-stimulus time histograms, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.operators.grids import histogram, pearson
from spindrift.operators import psth as P
from spindrift.operators.psth import Psth
from spindrift.plans.recording import SQL, TICKS_PER_SECOND, recording

PER = TICKS_PER_SECOND
#: Half a second before to one second after the start, by 50 ms.
BEFORE, AFTER, WIDTH = PER // 2, PER, PER // 20
BINS = (BEFORE + AFTER) // WIDTH
SMOOTHING = 3
#: Half a minute before and after the start by 3 s: wide enough that few units lack a baseline.
WIDE = {"before": 30 * PER, "after": 30 * PER, "width": 3 * PER}


def psth(spark: SparkSession, d: str, key: str = "unit", before: int = BEFORE, after: int = AFTER, width: int = WIDTH) -> Psth:
    r = recording(spark, d)
    return Psth(r.spikes, r.intervals.where("End > Start"), key, before=before, after=after, width=width, per_second=float(PER))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def psth_hist(spark: SparkSession, d: str) -> DataFrame:
    return psth(spark, d).hist()


def psth_rate(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(psth(spark, d).rates(), "firing_rate")


def psth_rate_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(replace(psth(spark, d), smoothing=SMOOTHING).rates(), "firing_rate")


def psth_unit_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(psth(spark, d).stats().drop("mean_rate"), "baseline_rate", "peak_rate", "modulation_ratio")


def psth_response_class(spark: SparkSession, d: str) -> DataFrame:
    return psth(spark, d).response_classes().select("unit", "response")


def psth_response_counts(spark: SparkSession, d: str) -> DataFrame:
    """Units of each response class and their part of all units in percent."""
    counts = psth(spark, d).response_classes().groupBy("response").agg(F.count(F.lit(1)).alias("n_units"))
    return counts.select("response", "n_units", F.round(100 * F.col("n_units") / counts.agg(F.sum("n_units")).scalar(), 6).alias("percent"))


def psth_population_mean_sem(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(psth(spark, d).population().select("bin", "bin_center", "n_keys", "mean_rate", "sem"), "mean_rate", "sem")


def psth_population_sum(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(psth(spark, d).population().select("bin", "bin_center", "sum_rate"), "sum_rate")


def psth_channel(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(psth(spark, d, "electrode").rates(), "firing_rate")


def psth_channel_stats(spark: SparkSession, d: str) -> DataFrame:
    """Units, aligned spikes, intervals, peak and mean rate of each channel."""
    stats = psth(spark, d, "electrode").stats().select("electrode", "total_spikes", "valid_intervals", "peak_rate", "mean_rate")
    units = recording(spark, d).spikes.where("electrode IS NOT NULL").groupBy("electrode", "unit").agg(F.lit(1)).groupBy("electrode").agg(F.count(F.lit(1)).alias("n_units"))
    return _rounded(stats.join(units, "electrode"), "peak_rate", "mean_rate")


def _channel_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Of all electrodes that occur, null where one has the same rate in every bin. Points are bins, so pairs grow with the electrodes only."""
    return pearson(psth(spark, d, "electrode").rates(), "electrode", "bin", "firing_rate")


def psth_channel_corr(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_channel_correlations(spark, d), "corr")


def psth_best_pair(spark: SparkSession, d: str) -> DataFrame:
    """The pair of different channels with the highest positive correlation, the first among equals."""
    return _rounded(_channel_correlations(spark, d).where("i < j AND corr > 0"), "corr").orderBy(F.col("corr").desc(), "i", "j").limit(1)


def max_offdiagonal_corr(spark: SparkSession, d: str) -> DataFrame:
    return _channel_correlations(spark, d).where("i <> j").agg(F.round(F.max("corr"), 6).alias("max_corr"))


def psth_trial_raster(spark: SparkSession, d: str) -> DataFrame:
    return psth(spark, d).trials()


def modulation_summary(spark: SparkSession, d: str) -> DataFrame:
    out = P.modulation_summary(psth(spark, d).stats())
    return _rounded(out, *out.columns)


def top_modulated_units(spark: SparkSession, d: str) -> DataFrame:
    """The five most modulated units, unbounded modulation first; of these the ones with a finite ratio. Around
    starts of stimuli by half a minute."""
    unbounded = F.col("modulation_ratio").desc_nulls_first()
    five = _rounded(psth(spark, d, **WIDE).stats(), "modulation_ratio").orderBy(unbounded, "unit").limit(5)
    ranked = five.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(unbounded, "unit")))
    return ranked.where("modulation_ratio IS NOT NULL").select("rank", "unit", "modulation_ratio")


def modulation_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Display histogram of finite modulation ratios below 10 in 20 equal bins."""
    rows = psth(spark, d).stats().where("modulation_ratio < 10").select(F.round("modulation_ratio", 6).alias("m"))
    return _rounded(histogram(rows, "m", 20), "low", "high")


QUERIES = {f.__name__: f for f in (
    psth_hist, psth_rate, psth_rate_smoothed, psth_unit_stats, psth_response_class, psth_response_counts, psth_population_mean_sem, psth_population_sum, psth_channel, psth_channel_stats,
    psth_channel_corr, psth_best_pair, max_offdiagonal_corr, psth_trial_raster, modulation_summary, top_modulated_units, modulation_histogram,
)}


def _sql(key: str = "unit", before: int = BEFORE, after: int = AFTER, width: int = WIDTH) -> str:
    bins = (before + after) // width
    return SQL + f""", al AS (SELECT s.{key} AS key, i.interval_id, s.time - i.a AS rel FROM spikes s JOIN intervals i ON s.recording_id = i.recording_id AND i.b > i.a
  AND s.time >= i.a - {before} AND s.time <= i.a + {after} WHERE s.{key} IS NOT NULL),
h AS (SELECT key, CAST(least((rel + {before}) // {width}, {bins - 1}) AS INT) AS bin, count(*) AS hist FROM al GROUP BY ALL),
totals AS (SELECT k.key, count(al.key) AS total_spikes, count(DISTINCT al.interval_id) AS valid_intervals FROM (SELECT DISTINCT {key} AS key FROM spikes WHERE {key} IS NOT NULL) k LEFT JOIN al ON al.key = k.key GROUP BY k.key),
grid AS (SELECT key, valid_intervals, CAST(unnest(range(0, {bins})) AS INT) AS bin FROM totals),
rates AS (SELECT g.key, g.bin, CAST(g.bin * {width} + {width / 2 - before} AS DOUBLE) AS bin_center, coalesce(CAST(coalesce(h.hist, 0) AS DOUBLE) * {PER / width} / nullif(valid_intervals, 0), 0) AS rate FROM grid g LEFT JOIN h ON h.key = g.key AND h.bin = g.bin),
base AS (SELECT key, avg(CASE WHEN bin < {bins // 4} THEN rate END) AS baseline_rate, max(rate) AS peak_rate, avg(rate) AS mean_rate FROM rates GROUP BY key),
stats AS (SELECT t.key, total_spikes, valid_intervals, baseline_rate, peak_rate, mean_rate, CASE WHEN baseline_rate > 0 THEN peak_rate / baseline_rate END AS modulation_ratio FROM totals t JOIN base b ON t.key = b.key),
classes AS (SELECT *, CASE WHEN baseline_rate > 0 THEN CASE WHEN modulation_ratio > 1.5 THEN 'responsive' WHEN modulation_ratio < 0.7 THEN 'suppressed' ELSE 'non_responsive' END WHEN peak_rate > 0 THEN 'responsive' ELSE 'non_responsive' END AS response FROM stats)
"""


_CORR = _sql("electrode") + """, c AS (SELECT a.key AS i, b.key AS j, CASE WHEN stddev_pop(a.rate) * stddev_pop(b.rate) > 1e-12 THEN covar_pop(a.rate, b.rate) / (stddev_pop(a.rate) * stddev_pop(b.rate)) END AS corr
  FROM rates a JOIN rates b ON a.bin = b.bin AND a.key <= b.key GROUP BY ALL)
"""
_FIRST, _LAST = WIDTH // 2 - BEFORE, WIDTH // 2 - BEFORE + (BINS - 1) * WIDTH

ORACLES = {
    "psth_hist": _sql() + f"SELECT key AS unit, bin, CAST(bin * {WIDTH} + {WIDTH / 2 - BEFORE} AS DOUBLE) AS bin_center, hist FROM h",
    "psth_rate": _sql() + "SELECT key AS unit, bin, bin_center, round(rate, 6) AS firing_rate FROM rates",
    "psth_rate_smoothed": _sql() + f""", w AS (SELECT key, bin, bin_center, unnest(range(bin - {SMOOTHING // 2}, bin + {SMOOTHING - SMOOTHING // 2})) AS j FROM rates),
f AS (SELECT key, bin, bin_center, CASE WHEN ((j % {2 * BINS}) + {2 * BINS}) % {2 * BINS} < {BINS} THEN ((j % {2 * BINS}) + {2 * BINS}) % {2 * BINS} ELSE {2 * BINS - 1} - ((j % {2 * BINS}) + {2 * BINS}) % {2 * BINS} END AS m FROM w)
SELECT f.key AS unit, f.bin, f.bin_center, round(avg(r.rate), 6) AS firing_rate FROM f JOIN rates r ON r.key = f.key AND r.bin = f.m GROUP BY ALL""",
    "psth_unit_stats": _sql() + "SELECT key AS unit, total_spikes, valid_intervals, round(baseline_rate, 6) AS baseline_rate, round(peak_rate, 6) AS peak_rate, round(modulation_ratio, 6) AS modulation_ratio FROM stats",
    "psth_response_class": _sql() + "SELECT key AS unit, response FROM classes",
    "psth_response_counts": _sql() + "SELECT response, count(*) AS n_units, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM classes), 6) AS percent FROM classes GROUP BY response",
    "psth_population_mean_sem": _sql() + "SELECT bin, bin_center, count(*) AS n_keys, round(avg(rate), 6) AS mean_rate, round(stddev_samp(rate) / sqrt(count(*)), 6) AS sem FROM rates GROUP BY bin, bin_center",
    "psth_population_sum": _sql() + "SELECT bin, bin_center, round(sum(rate), 6) AS sum_rate FROM rates GROUP BY bin, bin_center",
    "psth_channel": _sql("electrode") + "SELECT key AS electrode, bin, bin_center, round(rate, 6) AS firing_rate FROM rates",
    "psth_channel_stats": _sql("electrode") + """SELECT s.key AS electrode, total_spikes, valid_intervals, round(peak_rate, 6) AS peak_rate, round(mean_rate, 6) AS mean_rate, n_units FROM stats s
  JOIN (SELECT electrode, count(DISTINCT unit) AS n_units FROM spikes WHERE electrode IS NOT NULL GROUP BY electrode) u ON u.electrode = s.key""",
    "psth_channel_corr": _CORR + "SELECT i, j, round(corr, 6) AS corr FROM c",
    "psth_best_pair": _CORR + "SELECT i, j, round(corr, 6) AS corr FROM c WHERE i < j AND corr > 0 ORDER BY 3 DESC, 1, 2 LIMIT 1",
    "max_offdiagonal_corr": _CORR + "SELECT round(max(corr), 6) AS max_corr FROM c WHERE i <> j",
    "psth_trial_raster": _sql() + f""", p AS (SELECT * FROM al WHERE rel BETWEEN {_FIRST} AND {_LAST}), t AS (SELECT *, dense_rank() OVER (PARTITION BY key ORDER BY interval_id) - 1 AS trial FROM p)
SELECT key AS unit, CAST(trial AS INT) AS trial, interval_id, rel FROM t WHERE trial < 50""",
    "modulation_summary": _sql() + """SELECT round(avg(baseline_rate), 6) AS mean_baseline, round(stddev_pop(baseline_rate), 6) AS std_baseline, round(avg(peak_rate), 6) AS mean_peak, round(stddev_pop(peak_rate), 6) AS std_peak,
  round(avg(modulation_ratio), 6) AS mean_modulation, round(stddev_pop(modulation_ratio), 6) AS std_modulation FROM stats""",
    "top_modulated_units": _sql(**WIDE) + """SELECT rank, unit, modulation_ratio FROM (SELECT CAST(row_number() OVER (ORDER BY round(modulation_ratio, 6) DESC NULLS FIRST, key) AS INT) AS rank, key AS unit, round(modulation_ratio, 6) AS modulation_ratio FROM stats) WHERE rank <= 5 AND modulation_ratio IS NOT NULL""",
    "modulation_histogram": _sql() + """, v AS (SELECT round(modulation_ratio, 6) AS v FROM stats WHERE modulation_ratio < 10), e AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v),
p AS (SELECT least(floor((v - lo) / ((hi - lo) / 20)), 19) AS bin, count(*) AS n FROM v, e GROUP BY ALL), g AS (SELECT lo, hi, unnest(range(0, 20)) AS bin FROM e)
SELECT CAST(g.bin AS INT) AS bin, round(lo + g.bin * ((hi - lo) / 20), 6) AS low, round(lo + (g.bin + 1) * ((hi - lo) / 20), 6) AS high, coalesce(n, 0) AS count FROM g LEFT JOIN p ON g.bin = p.bin""",
}
