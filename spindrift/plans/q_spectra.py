"""Queries over sampled voltage (one row of 64 channel values a sample), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import spectra as S
from spindrift.operators.grids import histogram, pearson_wide
from spindrift.sources.tables import table

#: Samples a second the table is read as, and the length of Welch segments.
RATE, SEGMENT = 500.0, 128


def voltage(spark: SparkSession, d: str) -> DataFrame:
    return S.long_voltage(table(spark, d, "embeddings"), "vec_id", "embedding")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _dft(spark: SparkSession, d: str) -> DataFrame:
    return S.power_spectrum(voltage(spark, d), RATE, "fft")


def dft_power(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_dft(spark, d), "freq", "psd")


def band_power(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.band_power(_dft(spark, d), S.bands_table(spark)), "power")


def total_power(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.total_power(_dft(spark, d)), "total_power")


def peak_frequency(spark: SparkSession, d: str) -> DataFrame:
    """The strongest frequency above 1 Hz of each channel, and what a masked index on unmasked frequencies would give."""
    psd = _dft(spark, d)
    both = S.peak_frequency(psd).join(S.peak_frequency(psd, "shifted").withColumnRenamed("peak_frequency", "shifted_frequency"), "channel")
    return _rounded(both, "peak_frequency", "shifted_frequency")


def mean_std_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.mean_std_spectrum(_dft(spark, d)), "freq", "mean_psd", "std_psd")


def channel_band_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.channel_band_matrix(S.band_power(_dft(spark, d), S.bands_table(spark))), *S.BANDS)


def channel_voltage_corr(spark: SparkSession, d: str) -> DataFrame:
    """Of all pairs of channels."""
    return _rounded(pearson_wide(table(spark, d, "embeddings"), "embedding"), "corr")


def max_voltage_corr(spark: SparkSession, d: str) -> DataFrame:
    """The highest correlation of two different channels."""
    return pearson_wide(table(spark, d, "embeddings"), "embedding").where("i <> j").agg(F.round(F.max("corr"), 6).alias("max_corr"))


def first_second(spark: SparkSession, d: str) -> DataFrame:
    """The first second of every channel."""
    return voltage(spark, d).where(F.col("sample") < RATE).select("sample", "channel", F.round(F.col("v").cast("double"), 6).alias("v"))


def welch_psd(spark: SparkSession, d: str) -> DataFrame:
    """Welch spectra in millionths, to four decimals."""
    out = S.welch_psd(voltage(spark, d), RATE, SEGMENT)
    return out.select("channel", "k", "freq", F.round(F.col("psd") * 1e6, 4).alias("psd"))


def channel_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Welch bands, peak and total power of every channel in one row each, powers in millionths."""
    out = S.channel_analysis(voltage(spark, d), RATE, segment=SEGMENT)
    millionths = lambda c: F.round(c * 1e6, 4)
    return out.select("channel", F.round("peak_frequency", 6).alias("peak_frequency"), millionths(F.col("total_power")).alias("total_power"), *(millionths(F.col("band_powers")[b]).alias(b) for b in S.BANDS))


def voltage_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Display histogram of each channel's values in 50 equal bins."""
    return _rounded(histogram(voltage(spark, d), "v", 50, ["channel"]), "low", "high")


QUERIES = {f.__name__: f for f in (dft_power, band_power, total_power, peak_frequency, mean_std_spectrum, channel_band_matrix, channel_voltage_corr, max_voltage_corr, first_second, welch_psd, channel_analysis, voltage_histogram)}

_V = "WITH v AS (SELECT vec_id AS sample, CAST(unnest(range(0, len(embedding))) AS INT) AS channel, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
#: Powers of bands, from a relation ``psd`` before it.
_BANDS = f""",
bands AS (SELECT * FROM (VALUES {", ".join(f"('{b}', {lo}::DOUBLE, {hi}::DOUBLE)" for b, (lo, hi) in S.BANDS.items())}) AS b(band, low, high)),
inside AS (SELECT channel, band, freq, psd, lead(freq) OVER w AS f2, lead(psd) OVER w AS p2 FROM psd JOIN bands ON freq BETWEEN low AND high WINDOW w AS (PARTITION BY channel, band ORDER BY freq)),
power AS (SELECT c.channel, b.band, coalesce(sum((f2 - freq) * (p2 + psd) / 2), 0) AS power FROM (SELECT DISTINCT channel FROM psd) c CROSS JOIN bands b LEFT JOIN inside i ON i.channel = c.channel AND i.band = b.band GROUP BY c.channel, b.band),
total AS (SELECT channel, sum((f2 - freq) * (p2 + psd) / 2) AS total_power FROM (SELECT channel, freq, psd, lead(freq) OVER w AS f2, lead(psd) OVER w AS p2 FROM psd WINDOW w AS (PARTITION BY channel ORDER BY freq)) GROUP BY channel),
peak AS (SELECT channel, k, freq FROM (SELECT channel, k, freq, row_number() OVER (PARTITION BY channel ORDER BY psd DESC, k) AS r FROM psd WHERE freq > 1) WHERE r = 1),
peaks AS (SELECT p.channel, round(p.freq, 6) AS peak_frequency, round(q.freq, 6) AS shifted_frequency FROM peak p JOIN psd q ON q.channel = p.channel AND q.k = p.k - (SELECT count(*) FROM psd x WHERE x.channel = p.channel AND x.freq <= 1))
"""
_PSD = f"""{_V},
n AS (SELECT count(*) AS n FROM embeddings), k AS (SELECT n, CAST(unnest(range(0, (n + 1) // 2)) AS INT) AS k FROM n),
psd AS (SELECT channel, k.k, k.k * {RATE}::DOUBLE / any_value(n) AS freq, (power(sum(v * cos(2 * pi() * ((k.k * sample) % n) / n)), 2) + power(sum(v * sin(2 * pi() * ((k.k * sample) % n) / n)), 2)) / any_value(n) AS psd FROM v CROSS JOIN k GROUP BY channel, k.k)
""" + _BANDS
_WELCH = f"""{_V},
s AS (SELECT v.*, g.segment, sample - segment * {SEGMENT // 2} AS i FROM v JOIN (SELECT unnest(range(0, (count(*) - {SEGMENT}) // {SEGMENT // 2} + 1)) AS segment FROM embeddings) g ON sample BETWEEN segment * {SEGMENT // 2} AND segment * {SEGMENT // 2} + {SEGMENT - 1}),
w AS (SELECT channel, segment, i, (v - avg(v) OVER (PARTITION BY channel, segment)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / {SEGMENT})) AS x FROM s),
k AS (SELECT CAST(unnest(range(0, {SEGMENT // 2 + 1})) AS INT) AS k), hann AS (SELECT sum(power(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / {SEGMENT}), 2)) AS h FROM (SELECT unnest(range(0, {SEGMENT})) AS i)),
p AS (SELECT channel, segment, k, power(sum(x * cos(2 * pi() * ((k * i) % {SEGMENT}) / {SEGMENT})), 2) + power(sum(x * sin(2 * pi() * ((k * i) % {SEGMENT}) / {SEGMENT})), 2) AS p FROM w CROSS JOIN k GROUP BY channel, segment, k),
psd AS (SELECT channel, k, k * {RATE}::DOUBLE / {SEGMENT} AS freq, avg(p) * CASE WHEN k IN (0, {SEGMENT // 2}) THEN 1 ELSE 2 END / ({RATE}::DOUBLE * any_value(h)) AS psd FROM p CROSS JOIN hann GROUP BY channel, k)
""" + _BANDS
_CORR = _V + ", c AS (SELECT a.channel AS i, b.channel AS j, CASE WHEN stddev_pop(a.v) * stddev_pop(b.v) > 1e-12 THEN covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) END AS corr FROM v a JOIN v b ON a.sample = b.sample AND a.channel <= b.channel GROUP BY ALL)\n"

ORACLES = {
    "welch_psd": _WELCH + "SELECT channel, k, freq, round(psd * 1e6, 4) AS psd FROM psd",
    "channel_analysis": _WELCH + "SELECT t.channel, any_value(peak_frequency) AS peak_frequency, any_value(round(total_power * 1e6, 4)) AS total_power, " + ", ".join(f"round(max(CASE WHEN band = '{b}' THEN power END) * 1e6, 4) AS {b}" for b in S.BANDS) + " FROM total t LEFT JOIN (SELECT channel, round(freq, 6) AS peak_frequency FROM peak) k ON k.channel = t.channel JOIN power p ON p.channel = t.channel GROUP BY t.channel",
    "first_second": _V + f" SELECT sample, channel, round(v, 6) AS v FROM v WHERE sample < {RATE}",
    "voltage_histogram": """
WITH v AS (SELECT CAST(unnest(range(0, len(embedding))) AS INT) AS channel, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
e AS (SELECT channel, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v GROUP BY channel),
p AS (SELECT v.channel, least(floor((v - lo) / ((hi - lo) / 50)), 49) AS bin, count(*) AS n FROM v JOIN e ON v.channel = e.channel GROUP BY ALL), g AS (SELECT channel, lo, hi, unnest(range(0, 50)) AS bin FROM e)
SELECT g.channel, CAST(g.bin AS INT) AS bin, round(lo + g.bin * ((hi - lo) / 50), 6) AS low, round(lo + (g.bin + 1) * ((hi - lo) / 50), 6) AS high, coalesce(n, 0) AS count FROM g LEFT JOIN p ON g.channel = p.channel AND g.bin = p.bin""",
    "dft_power": _PSD + "SELECT channel, k, round(freq, 6) AS freq, round(psd, 6) AS psd FROM psd",
    "band_power": _PSD + "SELECT channel, band, round(power, 6) AS power FROM power",
    "total_power": _PSD + "SELECT channel, round(total_power, 6) AS total_power FROM total",
    "peak_frequency": _PSD + "SELECT channel, peak_frequency, shifted_frequency FROM peaks",
    "mean_std_spectrum": _PSD + "SELECT k, round(freq, 6) AS freq, round(avg(psd), 6) AS mean_psd, round(stddev_pop(psd), 6) AS std_psd FROM psd GROUP BY k, freq",
    "channel_band_matrix": _PSD + "SELECT channel, " + ", ".join(f"round(max(CASE WHEN band = '{b}' THEN power END), 6) AS {b}" for b in S.BANDS) + " FROM power GROUP BY channel",
    "channel_voltage_corr": _CORR + "SELECT i, j, round(corr, 6) AS corr FROM c",
    "max_voltage_corr": _CORR + "SELECT round(max(corr), 6) AS max_corr FROM c WHERE i <> j",
}
