"""Queries over spike trains, one train a unit and recording, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.operators import trains as T
from spindrift.operators.grids import histogram
from spindrift.plans.recording import SQL, TICKS_PER_SECOND, recording

PER = TICKS_PER_SECOND
TRAIN = ["recording_id", "unit"]
MAX_ISI, MIN_SPIKES = PER // 100, 3
WINDOW, STEP = PER, PER // 10
#: Ticks in a bin of rhythm and correlograms (1 ms), and lags looked at.
BIN, LAGS = PER // 1000, 1000
MAX_LAG = 100
MAX_FREQUENCY = 100.0


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _spikes(spark: SparkSession, d: str) -> DataFrame:
    return recording(spark, d).spikes


def isi(spark: SparkSession, d: str) -> DataFrame:
    return T.intervals(_spikes(spark, d), TRAIN, "spike_id").where("isi IS NOT NULL")


def isi_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(T.interval_stats(_spikes(spark, d), TRAIN), "mean_isi", "std_isi", "cv_isi", "median_isi", "p25_isi", "p75_isi")


def isi_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Display histogram of each unit's intervals in 50 equal bins."""
    rows = T.intervals(_spikes(spark, d), TRAIN, "spike_id").where("isi IS NOT NULL")
    return _rounded(histogram(rows, "isi", 50, ["unit"]), "low", "high")


def bursts(spark: SparkSession, d: str) -> DataFrame:
    return T.bursts(_spikes(spark, d), TRAIN, MAX_ISI, MIN_SPIKES)


def burst_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(T.burst_stats(_spikes(spark, d), TRAIN, MAX_ISI, MIN_SPIKES), "burst_ratio", "mean_duration", "mean_spikes")


def sliding_rate(spark: SparkSession, d: str) -> DataFrame:
    return T.sliding_rate(_spikes(spark, d), TRAIN, WINDOW, STEP, PER)


def sliding_rate_stats(spark: SparkSession, d: str) -> DataFrame:
    return T.sliding_rate_stats(_spikes(spark, d), TRAIN, WINDOW, STEP, PER)


def autocorrelogram(spark: SparkSession, d: str) -> DataFrame:
    """Coincidences within trains by unit, all recordings together."""
    return _rounded(T.autocorrelogram(_spikes(spark, d), TRAIN, BIN, LAGS, roll_up=["unit"]), "value")


def _busiest(spark: SparkSession, d: str) -> tuple[int, int]:
    """The two units with most spikes."""
    rows = _spikes(spark, d).groupBy("unit").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "unit").limit(2).collect()
    return rows[0].unit, rows[1].unit


def cross_correlogram(spark: SparkSession, d: str) -> DataFrame:
    """Coincidences of the two busiest units, all recordings together."""
    return T.cross_correlogram(_spikes(spark, d), ["recording_id"], *_busiest(spark, d), BIN, MAX_LAG, roll_up=[])


def xcorr_peak(spark: SparkSession, d: str) -> DataFrame:
    """The lag with most coincidences of each recording, the lowest among equals."""
    counts = T.cross_correlogram(_spikes(spark, d), ["recording_id"], *_busiest(spark, d), BIN, MAX_LAG)
    first = F.struct((-F.col("n")).alias("n"), F.col("lag").alias("lag"))
    return counts.groupBy("recording_id").agg(F.min_by("lag", first).alias("peak_lag"), F.max("n").alias("peak_correlation"))


def train_dominant_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(T.dominant_frequencies(_spikes(spark, d), TRAIN, BIN, PER, max_frequency=MAX_FREQUENCY), "dominant_frequency")


def pattern_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The analysis of every train, rhythm included."""
    out = T.patterns(_spikes(spark, d), TRAIN, PER, MAX_ISI, MIN_SPIKES, BIN, WINDOW, STEP, MAX_FREQUENCY)
    return _rounded(out, *(f.name for f in out.schema.fields if f.dataType.typeName() == "double"))


def pattern_features(spark: SparkSession, d: str) -> DataFrame:
    """The main features of every train and its class, rhythm included."""
    return pattern_analysis(spark, d).select(*TRAIN, "n_spikes", "cv_isi", "mean_rate", "mean_sliding", "n_bursts", "burst_ratio", "dominant_frequency", "pattern_type", "confidence", "error")


def train_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """The spectrum of every train that has one, a row a frequency, power in thousandths."""
    out = T.train_spectra(_spikes(spark, d), TRAIN, BIN, PER, max_frequency=MAX_FREQUENCY).where("power IS NOT NULL")
    rows = out.select(*TRAIN, F.posexplode(F.arrays_zip("frequencies", "power")).alias("k", "x"))
    return rows.select(*TRAIN, "k", F.round("x.frequencies", 6).alias("frequency"), F.round(F.col("x.power") * 1000, 4).alias("power"))


def pattern_records(spark: SparkSession, d: str) -> DataFrame:
    """The analysis of every train with its intervals, rates and bursts packed for export, in parts."""
    return T.pattern_records(_spikes(spark, d), TRAIN, PER, MAX_ISI, MIN_SPIKES, BIN, WINDOW, STEP, MAX_FREQUENCY)


def pattern_class_counts(spark: SparkSession, d: str) -> DataFrame:
    """Trains of each class, their part in percent, and mean and spread of rate and interval variation, bursts in all."""
    rows = pattern_features(spark, d).where("error IS NULL")
    counts = rows.groupBy("pattern_type").agg(F.count(F.lit(1)).alias("n_trains"), F.avg("mean_rate").alias("mean_rate"), F.stddev_pop("mean_rate").alias("std_rate"), F.avg("cv_isi").alias("mean_cv"), F.stddev_pop("cv_isi").alias("std_cv"), F.sum("n_bursts").alias("n_bursts"))
    out = counts.withColumn("percent", 100 * F.col("n_trains") / F.sum("n_trains").over(W.partitionBy(F.lit(1))))
    return out.withColumns({c: F.round(c, 4) for c in ("mean_rate", "std_rate", "mean_cv", "std_cv", "percent")})


QUERIES = {f.__name__: f for f in (
    isi, isi_stats, isi_histogram, bursts, burst_stats, sliding_rate, sliding_rate_stats, autocorrelogram, cross_correlogram, xcorr_peak, train_dominant_frequency, pattern_features, pattern_analysis, pattern_class_counts, train_spectrum, pattern_records,
)}

_ISI = SQL + ", isi AS (SELECT recording_id, unit, spike_id, time, time - lag(time) OVER (PARTITION BY recording_id, unit ORDER BY time, spike_id) AS isi FROM spikes)\n"
_BURSTS = _ISI + f""", marks AS (SELECT *, sum(CASE WHEN isi <= {MAX_ISI} THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id, unit ORDER BY time, spike_id ROWS UNBOUNDED PRECEDING) AS run,
  row_number() OVER (PARTITION BY recording_id, unit ORDER BY time, spike_id) - 1 AS idx FROM isi),
bursts AS (SELECT recording_id, unit, min(time) AS start_time, max(time) AS end_time, max(time) - min(time) AS duration, count(*) AS spike_count, min(idx) AS start_idx, max(idx) AS end_idx
  FROM marks GROUP BY recording_id, unit, run HAVING count(*) >= {MIN_SPIKES}),
burst_stats AS (SELECT t.recording_id, t.unit, t.n AS n_spikes, count(b.spike_count) AS n_bursts, CAST(coalesce(sum(b.spike_count), 0) AS BIGINT) AS burst_spikes, count(b.spike_count) / CAST(t.n AS DOUBLE) AS burst_ratio, avg(b.duration) AS mean_duration, avg(b.spike_count) AS mean_spikes
  FROM (SELECT recording_id, unit, count(*) AS n FROM spikes GROUP BY ALL) t LEFT JOIN bursts b ON b.recording_id = t.recording_id AND b.unit = t.unit GROUP BY t.recording_id, t.unit, t.n),
isi_stats AS (SELECT recording_id, unit, count(*) AS n_spikes, avg(isi) AS mean_isi, stddev_pop(isi) AS std_isi, CASE WHEN avg(isi) > 0 THEN stddev_pop(isi) / avg(isi) END AS cv_isi,
  quantile_cont(CAST(isi AS DOUBLE), 0.5) AS median_isi, quantile_cont(CAST(isi AS DOUBLE), 0.25) AS p25_isi, quantile_cont(CAST(isi AS DOUBLE), 0.75) AS p75_isi FROM isi GROUP BY recording_id, unit)
"""
_SLIDING = f""", span AS (SELECT recording_id, unit, min(time) AS lo, max(time) AS hi FROM spikes GROUP BY ALL),
grid AS (SELECT recording_id, unit, lo, unnest(range(0, CAST(ceil((hi - lo) / {STEP}.0::DOUBLE) AS BIGINT))) AS k FROM span),
heard AS (SELECT g.recording_id, g.unit, g.k, count(*) AS n FROM grid g JOIN spikes s ON s.recording_id = g.recording_id AND s.unit = g.unit AND s.time BETWEEN g.lo + g.k * {STEP} - {WINDOW // 2} AND g.lo + g.k * {STEP} + {WINDOW // 2} GROUP BY ALL),
sliding AS (SELECT g.recording_id, g.unit, g.k, g.lo + g.k * {STEP} AS time, coalesce(h.n, 0) AS n, coalesce(h.n, 0) * {PER}.0::DOUBLE / {WINDOW}.0::DOUBLE AS rate FROM grid g LEFT JOIN heard h ON h.recording_id = g.recording_id AND h.unit = g.unit AND h.k = g.k)
"""
_BINS = SQL + f""", train AS (SELECT recording_id, unit, min(time) AS lo, max(time) AS hi, count(*) AS n FROM spikes GROUP BY ALL),
bins AS (SELECT DISTINCT s.recording_id, s.unit, (time - lo) // {BIN} AS bin FROM spikes s JOIN train t ON t.recording_id = s.recording_id AND t.unit = s.unit WHERE t.n >= 10 AND (time - lo) // {BIN} < (hi - lo) // {BIN})
"""
_CROSS = SQL + f""", busy AS (SELECT unit, row_number() OVER (ORDER BY count(*) DESC, unit) AS k FROM spikes GROUP BY unit),
pair AS (SELECT s.recording_id, b.k, s.time FROM spikes s JOIN busy b ON b.unit = s.unit WHERE b.k <= 2),
span AS (SELECT recording_id, k, min(time) AS lo, max(time) AS hi FROM pair GROUP BY ALL HAVING count(*) >= 2),
common AS (SELECT recording_id, max(lo) AS lo, min(hi) AS hi FROM span GROUP BY recording_id HAVING count(*) = 2 AND min(hi) > max(lo)),
bins AS (SELECT DISTINCT p.recording_id, k, (time - lo) // {BIN} AS bin FROM pair p JOIN common c ON c.recording_id = p.recording_id WHERE time BETWEEN lo AND hi AND (time - lo) // {BIN} < (hi - lo) // {BIN}),
lags AS (SELECT a.recording_id, a.bin - b.bin AS lag, count(*) AS n FROM bins a JOIN bins b ON a.recording_id = b.recording_id AND a.k = 1 AND b.k = 2 AND a.bin - b.bin BETWEEN {-MAX_LAG} AND {MAX_LAG} GROUP BY ALL)
"""
# Spectra of trains from their occupied bins: the transform of a segment is the sum over these, less the mean's part.
_SPECTRA = f""", lengths AS (SELECT recording_id, unit, lo, (hi - lo) // {BIN} AS n_bins FROM (SELECT recording_id, unit, min(time) AS lo, max(time) AS hi, count(*) AS n FROM spikes GROUP BY ALL) WHERE n >= 10),
sized AS (SELECT *, least(2048, n_bins // 4) AS size, least(2048, n_bins // 4) - least(2048, n_bins // 4) // 2 AS step FROM lengths WHERE n_bins // 4 >= 2),
occupied AS (SELECT DISTINCT s.recording_id, s.unit, size, step, (n_bins - size) // step + 1 AS segments, (time - lo) // {BIN} AS bin FROM spikes s JOIN sized z ON z.recording_id = s.recording_id AND z.unit = s.unit WHERE (time - lo) // {BIN} < n_bins),
cut AS (SELECT *, unnest(range(greatest(0, (bin - size + step) // step), least(bin // step, segments - 1) + 1)) AS segment FROM occupied),
waves AS (SELECT recording_id, unit, size, segments, segment, bin - segment * step AS i, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (bin - segment * step) / size) AS w, unnest(range(0, size // {1000 // int(MAX_FREQUENCY)} + 1)) AS k FROM cut),
parts AS (SELECT recording_id, unit, size, segments, segment, k, sum(w * cos(2 * pi() * ((k * i) % size) / size)) - count(*) / CAST(size AS DOUBLE) * (CASE WHEN k = 0 THEN size / 2.0::DOUBLE ELSE 0 END - size / 4.0::DOUBLE * (CASE WHEN k = 1 THEN 1 ELSE 0 END + CASE WHEN k = size - 1 THEN 1 ELSE 0 END)) AS re,
  sum(w * sin(2 * pi() * ((k * i) % size) / size)) AS im FROM waves GROUP BY recording_id, unit, size, segments, segment, k),
spectrum AS (SELECT recording_id, unit, k, k * {PER // BIN}.0::DOUBLE / size AS frequency, sum(re * re + im * im) * CASE WHEN k = 0 OR 2 * k = size THEN 1 ELSE 2 END / ({PER // BIN}.0::DOUBLE * any_value(h)) / any_value(segments) AS power
  FROM parts JOIN (SELECT size AS s, sum(power(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / size), 2)) AS h FROM (SELECT size, unnest(range(0, size)) AS j FROM (SELECT DISTINCT size FROM sized)) GROUP BY size) ON s = size GROUP BY recording_id, unit, k, size),
dominant AS (SELECT recording_id, unit, min(frequency) AS dominant_frequency FROM (SELECT *, max(power) OVER (PARTITION BY recording_id, unit) AS top FROM spectrum WHERE k > 0) WHERE power >= top * (1 - 1e-9) GROUP BY ALL)
"""
_FEATURES = _BURSTS + _SLIDING + _SPECTRA + f""", f AS (SELECT i.*, i.n_spikes * {PER}.0::DOUBLE / nullif(s.hi - s.lo, 0) AS mean_rate, m.mean_sliding, m.max_sliding, m.min_sliding, b.n_bursts, b.burst_spikes, b.burst_ratio, b.mean_duration, b.mean_spikes, d.dominant_frequency FROM isi_stats i
  JOIN span s ON s.recording_id = i.recording_id AND s.unit = i.unit JOIN burst_stats b ON b.recording_id = i.recording_id AND b.unit = i.unit LEFT JOIN dominant d ON d.recording_id = i.recording_id AND d.unit = i.unit
  LEFT JOIN (SELECT recording_id, unit, sum(n) * {PER}.0::DOUBLE / (count(*) * {WINDOW}) AS mean_sliding, max(rate) AS max_sliding, min(rate) AS min_sliding FROM sliding GROUP BY ALL) m ON m.recording_id = i.recording_id AND m.unit = i.unit),
c AS (SELECT *, coalesce(cv_isi, 'inf'::DOUBLE) AS cv FROM f),
analysis AS (SELECT * EXCLUDE (cv), CASE WHEN n_spikes < 10 THEN 'insufficient_data' WHEN burst_ratio > 0.1 THEN 'bursting' WHEN dominant_frequency > 10 THEN 'rhythmic' WHEN cv < 0.5 THEN 'regular' WHEN cv > 1.5 THEN 'irregular' ELSE 'tonic' END AS pattern_type,
  CASE WHEN n_spikes < 10 THEN 0 WHEN burst_ratio > 0.1 THEN least(1.0::DOUBLE, burst_ratio * 2) WHEN dominant_frequency > 10 THEN 0.8::DOUBLE WHEN cv < 0.5 THEN greatest(0.5::DOUBLE, 1 - cv) WHEN cv > 1.5 THEN least(1.0::DOUBLE, cv / 2) ELSE 0.6::DOUBLE END AS confidence,
  CASE WHEN n_spikes < 2 THEN 'Not enough spikes for analysis' END AS error FROM c),
rounded AS (SELECT recording_id, unit, n_spikes, n_bursts, burst_spikes, pattern_type, error, {", ".join(f"round({c}, 6) AS {c}" for c in ("mean_isi", "std_isi", "cv_isi", "median_isi", "p25_isi", "p75_isi", "mean_rate", "mean_sliding", "max_sliding", "min_sliding", "burst_ratio", "mean_duration", "mean_spikes", "dominant_frequency", "confidence"))} FROM analysis)
"""

ORACLES = {
    "isi": _ISI + "SELECT recording_id, unit, spike_id, time, isi FROM isi WHERE isi IS NOT NULL",
    "isi_stats": _BURSTS + "SELECT recording_id, unit, n_spikes, round(mean_isi, 6) AS mean_isi, round(std_isi, 6) AS std_isi, round(cv_isi, 6) AS cv_isi, round(median_isi, 6) AS median_isi, round(p25_isi, 6) AS p25_isi, round(p75_isi, 6) AS p75_isi FROM isi_stats",
    "isi_histogram": _ISI + """, v AS (SELECT unit, CAST(isi AS DOUBLE) AS v FROM isi WHERE isi IS NOT NULL),
e AS (SELECT unit, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v GROUP BY unit),
p AS (SELECT v.unit, least(floor((v - lo) / ((hi - lo) / 50)), 49) AS bin, count(*) AS n FROM v JOIN e ON v.unit = e.unit GROUP BY ALL), g AS (SELECT unit, lo, hi, unnest(range(0, 50)) AS bin FROM e)
SELECT g.unit, CAST(g.bin AS INT) AS bin, round(lo + g.bin * ((hi - lo) / 50), 6) AS low, round(lo + (g.bin + 1) * ((hi - lo) / 50), 6) AS high, coalesce(n, 0) AS count FROM g LEFT JOIN p ON g.unit = p.unit AND g.bin = p.bin""",
    "bursts": _BURSTS + "SELECT * FROM bursts",
    "burst_stats": _BURSTS + "SELECT recording_id, unit, n_spikes, n_bursts, burst_spikes, round(burst_ratio, 6) AS burst_ratio, round(mean_duration, 6) AS mean_duration, round(mean_spikes, 6) AS mean_spikes FROM burst_stats",
    "sliding_rate": SQL + _SLIDING + "SELECT recording_id, unit, k, time, n, rate FROM sliding",
    "sliding_rate_stats": SQL + _SLIDING + f"SELECT recording_id, unit, sum(n) * {PER}.0::DOUBLE / (count(*) * {WINDOW}) AS mean_rate, max(rate) AS max_rate, min(rate) AS min_rate FROM sliding GROUP BY ALL",
    "autocorrelogram": _BINS + f""", c AS (SELECT a.unit, a.bin - b.bin AS lag, count(*) AS n FROM bins a JOIN bins b ON a.recording_id = b.recording_id AND a.unit = b.unit AND a.bin - b.bin BETWEEN 0 AND {LAGS - 1} GROUP BY ALL),
g AS (SELECT unit, n AS n0, unnest(range(0, {LAGS})) AS lag FROM c WHERE lag = 0)
SELECT g.unit, g.lag, round(coalesce(c.n, 0) / CAST(n0 AS DOUBLE), 6) AS value FROM g LEFT JOIN c ON c.unit = g.unit AND c.lag = g.lag""",
    "cross_correlogram": _CROSS + f", g AS (SELECT unnest(range({-MAX_LAG}, {MAX_LAG + 1})) AS lag) SELECT g.lag, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM g LEFT JOIN lags l ON l.lag = g.lag WHERE (SELECT count(*) FROM common) > 0 GROUP BY g.lag",
    "xcorr_peak": _CROSS + f""", g AS (SELECT recording_id, unnest(range({-MAX_LAG}, {MAX_LAG + 1})) AS lag FROM common), r AS (SELECT g.recording_id, g.lag, coalesce(l.n, 0) AS n FROM g LEFT JOIN lags l ON l.recording_id = g.recording_id AND l.lag = g.lag)
SELECT recording_id, lag AS peak_lag, n AS peak_correlation FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, lag) AS k FROM r) WHERE k = 1""",
    "train_dominant_frequency": SQL + _SPECTRA + "SELECT t.recording_id, t.unit, round(d.dominant_frequency, 6) AS dominant_frequency FROM (SELECT DISTINCT recording_id, unit FROM spikes) t LEFT JOIN dominant d ON d.recording_id = t.recording_id AND d.unit = t.unit",
    "train_spectrum": SQL + _SPECTRA + "SELECT recording_id, unit, CAST(k AS INT) AS k, round(frequency, 6) AS frequency, round(power * 1000, 4) AS power FROM spectrum WHERE (SELECT count(*) FROM dominant d WHERE d.recording_id = spectrum.recording_id AND d.unit = spectrum.unit) > 0",
    "pattern_analysis": _FEATURES + "SELECT * FROM rounded",
    "pattern_features": _FEATURES + "SELECT recording_id, unit, n_spikes, cv_isi, mean_rate, mean_sliding, n_bursts, burst_ratio, dominant_frequency, pattern_type, confidence, error FROM rounded",
    "pattern_class_counts": _FEATURES + """SELECT pattern_type, count(*) AS n_trains, round(avg(mean_rate), 4) AS mean_rate, round(stddev_pop(mean_rate), 4) AS std_rate, round(avg(cv_isi), 4) AS mean_cv, round(stddev_pop(cv_isi), 4) AS std_cv,
  CAST(sum(n_bursts) AS BIGINT) AS n_bursts, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM rounded WHERE error IS NULL), 4) AS percent FROM rounded WHERE error IS NULL GROUP BY pattern_type""",
}
