"""Spectra against NumPy."""

import numpy as np
import pytest

from spindrift.operators import spectra as S


def long(spark, channels):
    return spark.createDataFrame([(i, c, float(v)) for c, values in enumerate(channels) for i, v in enumerate(values)], "sample bigint, channel int, v double")


def plain_welch(x, rate, n):
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    out = []
    for a in range(0, len(x) - n + 1, n - n // 2):
        s = x[a : a + n] - np.mean(x[a : a + n])
        p = np.abs(np.fft.rfft(s * w)) ** 2 / (rate * np.sum(w**2))
        p[1 : -1 if n % 2 == 0 else None] *= 2
        out.append(p)
    return np.mean(out, axis=0)


@pytest.mark.parametrize("n", [16, 15])
def test_welch(spark, n):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(2, 100))
    got = S.welch_psd(long(spark, data), 64.0, n).orderBy("channel", "k").toPandas()
    for c in range(2):
        mine = got[got.channel == c]
        assert np.allclose(mine.psd, plain_welch(data[c], 64.0, n)) and np.allclose(mine.freq, np.fft.rfftfreq(n, 1 / 64))
        assert np.allclose(S.welch(data[c], 64.0, n)[1], mine.psd)


def test_fourier_power_bands_and_peaks(spark):
    t = np.arange(64) / 64
    tone = np.sin(2 * np.pi * 6 * t)
    psd = S.power_spectrum(long(spark, [tone, np.zeros(64)]), 64.0, "fft")
    rows = psd.where("channel = 0").orderBy("k").toPandas()
    assert len(rows) == 32 and np.allclose(rows.psd, (np.abs(np.fft.fft(tone)) ** 2 / 64)[:32], atol=1e-9)
    peak = {r.channel: r.peak_frequency for r in S.peak_frequency(psd).collect()}
    assert peak == {0: 6.0, 1: 2.0}
    assert {r.channel: r.peak_frequency for r in S.peak_frequency(psd, "shifted").collect()}[0] == 4.0
    power = {(r.channel, r.band): r.power for r in S.band_power(psd, S.bands_table(spark)).collect()}
    assert power[0, "theta"] == pytest.approx(16.0) and power[1, "theta"] == 0 and power[0, "ripples"] == 0 and len(power) == 14
    assert {r.channel: r.total_power for r in S.total_power(psd).collect()} == pytest.approx({0: 16.0, 1: 0.0})
    matrix = S.channel_band_matrix(S.band_power(psd, S.bands_table(spark))).collect()
    assert len(matrix) == 2 and set(S.BANDS) < set(matrix[0].asDict())
    with pytest.raises(ValueError):
        S.power_spectrum(psd, 1.0, "other")
    with pytest.raises(ValueError):
        S.peak_frequency(psd, "other")


def test_default_segments(spark):
    assert S.segment_length(8 * 2**14 + 800) == 2**14 and S.segment_length(800) == 100
    data = np.random.default_rng(2).normal(size=(1, 160))
    got = S.power_spectrum(long(spark, data), 10.0).orderBy("k").toPandas()
    assert np.allclose(got.psd, plain_welch(data[0], 10.0, 20))
