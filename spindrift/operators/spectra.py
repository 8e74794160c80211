"""Power spectra of sampled channels: Welch and plain Fourier power, bands, integrals and peaks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.grids import trapezoid

# Default frequency bands in Hz, ends included; they overlap and share ends.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 100.0), "high_gamma": (100.0, 300.0), "ripples": (150.0, 250.0)}


def hann(n: int) -> np.ndarray:
    """The periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def segment_power(segments: np.ndarray, rate: float) -> np.ndarray:
    """One-sided power density of each row: mean removed, Hann window, doubled but for 0 and, with an even length, the last."""
    n = segments.shape[1]
    w = hann(n)
    spectrum = np.fft.rfft((segments - segments.mean(axis=1, keepdims=True)) * w)
    power = (spectrum.real**2 + spectrum.imag**2) / (rate * (w * w).sum())
    power[:, 1 : power.shape[1] - (n % 2 == 0)] *= 2
    return power


def welch(values: np.ndarray, rate: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power density): the mean over segments that overlap by half; what is left at the end is not used."""
    step = segment - segment // 2
    windows = np.lib.stride_tricks.sliding_window_view(np.asarray(values, float), segment)[::step]
    return np.fft.rfftfreq(segment, 1 / rate), segment_power(windows, rate).mean(axis=0)


def segment_length(n: int) -> int:
    """The default length of Welch segments of a channel of n samples."""
    return max(1, min(n // 8, 2**14))


def welch_psd(voltage: DataFrame, rate: float, segment: int) -> DataFrame:
    """(channel, k, freq, psd): Welch spectra of channels kept as (sample, channel, v), samples numbered from 0 without gaps.

    A sample goes into the two segments at most that hold it, every segment is transformed by itself, and the spectra are
    averaged: no task holds a channel. Segments that the data don't fill are not used.
    """
    step = segment - segment // 2
    last = F.expr(f"sample div {step}L")
    first = F.greatest(F.expr(f"(sample - {segment}L + {step}L) div {step}L"), F.lit(0))
    placed = voltage.where("v IS NOT NULL").select("channel", "sample", F.col("v").cast("double").alias("v"), F.explode(F.sequence(first, last)).alias("segment")).where(F.col("sample") - F.col("segment") * step < segment)
    packed = placed.groupBy("channel", "segment").agg(F.array_sort(F.collect_list(F.struct("sample", "v"))).alias("s")).where(F.size("s") == segment).select("channel", F.transform("s", lambda x: x["v"]).alias("values"))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = np.arange(segment // 2 + 1)
        for f in frames:
            if len(f):
                power = segment_power(np.stack(f["values"].to_numpy()), rate)
                channel = f["channel"].to_numpy()
                # sums by channel before the shuffle
                for c in np.unique(channel):
                    mine = power[channel == c]
                    yield pd.DataFrame({"channel": c, "k": k, "p": mine.sum(axis=0), "n": len(mine)})

    sums = packed.mapInPandas(task, "channel int, k int, p double, n bigint")
    return sums.groupBy("channel", "k").agg((F.sum("p") / F.sum("n")).alias("psd")).select("channel", "k", (F.col("k") * (rate / segment)).alias("freq"), "psd")


def fourier_power(voltage: DataFrame, rate: float) -> DataFrame:
    """(channel, k, freq, psd): |FFT|^2 / n of whole channels at the frequencies at or above 0; with an even n the Nyquist
    frequency counts as negative and is left out. The transform needs a whole channel at once in one task."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c, values in zip(f["channel"], f["values"], strict=True):
                n = len(values)
                x = np.fft.fft(np.asarray(values, float))
                keep = np.fft.fftfreq(n) >= 0
                yield pd.DataFrame({"channel": c, "k": np.arange(n)[keep], "freq": np.fft.fftfreq(n, 1 / rate)[keep], "psd": (x.real**2 + x.imag**2)[keep] / n})

    packed = voltage.where("v IS NOT NULL").groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("sample", "v"))).alias("s")).select("channel", F.transform("s", lambda x: x["v"].cast("double")).alias("values"))
    return packed.mapInPandas(task, "channel int, k int, freq double, psd double")


def power_spectrum(voltage: DataFrame, rate: float, method: str = "welch", segment: int | None = None) -> DataFrame:
    """Spectra by ``method`` (``welch`` or ``fft``); any other is a ValueError."""
    if method == "fft":
        return fourier_power(voltage, rate)
    if method != "welch":
        raise ValueError("method must be 'welch' or 'fft'")
    if segment is None:
        segment = segment_length(voltage.agg(F.max("sample")).first()[0] + 1)
    return welch_psd(voltage, rate, segment)


def bands_table(spark: SparkSession, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    return spark.createDataFrame([(name, float(lo), float(hi)) for name, (lo, hi) in bands.items()], "band string, low double, high double")


def band_power(psd: DataFrame, bands: DataFrame) -> DataFrame:
    """(channel, band, power): the trapezoid integral over each band's bins, ends included; 0 where a band has no two bins, for
    every channel and band. The bands are a parameter, a handful of rows."""
    every_band = bands.agg(F.collect_list(F.struct("band", "low", "high"))).scalar()
    each = psd.select("channel", "freq", "psd", F.explode(every_band).alias("b"))
    inside = each.where(F.col("freq").between(F.col("b.low"), F.col("b.high"))).select("channel", "b.band", "freq", "psd")
    found = trapezoid(inside, "freq", "psd", ["channel", "band"], "power")
    every = psd.select("channel").distinct().withColumn("all", bands.agg(F.collect_list("band")).scalar()).select("channel", F.explode("all").alias("band"))
    return every.join(found, ["channel", "band"], "left").select("channel", "band", F.coalesce("power", F.lit(0.0)).alias("power"))


def total_power(psd: DataFrame) -> DataFrame:
    """(channel, total_power): the trapezoid integral over all frequencies."""
    return trapezoid(psd, "freq", "psd", ["channel"], "total_power")


def peak_frequency(psd: DataFrame, mode: str = "correct", above: float = 1.0) -> DataFrame:
    """(channel, peak_frequency): the frequency above ``above`` with the most power, the lowest among equals.

    ``mode='shifted'`` returns the frequency at the peak's position among the masked bins instead, i.e. too low by the number
    of bins up to ``above``: what indexing unmasked frequencies by a masked argmax gives.
    """
    if mode not in ("correct", "shifted"):
        raise ValueError("mode must be 'correct' or 'shifted'")
    first = F.struct((-F.col("psd")).alias("p"), F.col("k").alias("k"))
    found = psd.where(F.col("freq") > above).groupBy("channel").agg(F.min_by(F.struct("k", "freq"), first).alias("peak"))
    if mode == "correct":
        return found.select("channel", F.col("peak.freq").alias("peak_frequency"))
    below = psd.where(F.col("freq") <= above).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    moved = found.join(below, "channel", "left").select("channel", (F.col("peak.k") - F.coalesce("n", F.lit(0))).alias("k"))
    return moved.join(psd.select("channel", "k", "freq"), ["channel", "k"]).select("channel", F.col("freq").alias("peak_frequency"))


def mean_std_spectrum(psd: DataFrame) -> DataFrame:
    """(k, freq, mean_psd, std_psd) across channels; population standard deviation."""
    return psd.groupBy("k", "freq").agg(F.avg("psd").alias("mean_psd"), F.stddev_pop("psd").alias("std_psd"))


def channel_band_matrix(powers: DataFrame, bands: Sequence[str] = tuple(BANDS)) -> DataFrame:
    """(channel, one column a band)."""
    return powers.groupBy("channel").pivot("band", list(bands)).agg(F.first("power"))


def long_voltage(rows: DataFrame, sample: str, values: str) -> DataFrame:
    """(sample, channel, v): rows of an array of channel values, channels from 0."""
    return rows.select(F.col(sample).alias("sample"), F.posexplode(values).alias("channel", "v"))


def channel_analysis(voltage: DataFrame, rate: float, bands: dict[str, tuple[float, float]] = BANDS, method: str = "welch", segment: int | None = None, max_channels: int | None = None, mode: str = "correct") -> DataFrame:
    """(channel, band_powers, peak_frequency, total_power): one row a channel, band powers as a map.

    ``max_channels`` keeps the first so many channels (None or 0: all). A channel without a bin above 1 Hz has no peak.
    """
    if max_channels:
        voltage = voltage.where(F.col("channel") < max_channels)
    psd = power_spectrum(voltage, rate, method, segment)
    spark = voltage.sparkSession
    powers = band_power(psd, bands_table(spark, bands)).groupBy("channel").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("band", "power")))).alias("band_powers"))
    return powers.join(peak_frequency(psd, mode), "channel", "left").join(total_power(psd), "channel").select("channel", "band_powers", "peak_frequency", "total_power")
