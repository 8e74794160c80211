"""Queries do the whole job: every electrode, unit, recording and class."""

from collections import Counter

import numpy as np
import pytest

from spindrift.plans import problems, q_activity, q_geometry, q_psth, q_trains


def test_all_electrodes_units_and_recordings_come_out(spark, small):
    """The SQL of these queries (test_oracles) has no cut either; here, that there is something beyond the old cuts."""
    assert q_psth.psth_channel_corr(spark, small).select("i").distinct().count() > 16
    assert q_activity.wide_interval_table(spark, small).where("unit > 15").count() > 0
    assert q_geometry.unit_channel_pivot(spark, small).where("electrode NOT BETWEEN 1 AND 16").count() > 0
    plain = {r.recording_id for r in spark.read.parquet(f"{small}/recordings.parquet").where("spikes_time_unit = 'ticks'").collect()}
    assert {r.recording_id for r in problems.p1_sessions(spark, small).select("recording_id").distinct().collect()} > plain
    assert {r.key_column for r in problems.p5_unit_intervals(spark, small).select("key_column").distinct().collect()} == {"unit", "electrode"}
    folder = small.replace("sf0.001", "sf0.01")
    assert q_psth.top_modulated_units(spark, folder).count() > 0
    assert q_trains.pattern_features(spark, folder).where("pattern_type = 'rhythmic'").count() > 0


def _class(times, width=q_trains.BIN, per=q_trains.PER):
    """The class of a train in a plain loop."""
    n = len(times)
    if n < 10:
        return "insufficient_data"
    runs = np.split(times, np.flatnonzero(np.diff(times) > q_trains.MAX_ISI) + 1)
    if sum(len(r) >= q_trains.MIN_SPIKES for r in runs) / n > 0.1:
        return "bursting"
    bins = (times[-1] - times[0]) // width
    train = np.zeros(bins)
    at = (times - times[0]) // width
    train[at[at < bins]] = 1
    size = min(2048, bins // 4)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.mean([np.abs(np.fft.rfft((x - x.mean()) * window)) ** 2 for x in (train[i : i + size] for i in range(0, bins - size + 1, size - size // 2))], axis=0)
    power[1 : None if size % 2 else -1] *= 2
    frequencies = np.fft.rfftfreq(size, width / per)
    power = power[frequencies <= 100]
    if frequencies[np.argmax(power[1:]) + 1] > 10:
        return "rhythmic"
    cv = np.std(np.diff(times)) / np.mean(np.diff(times))
    return "regular" if cv < 0.5 else "irregular" if cv > 1.5 else "tonic"


def test_classes_with_rhythm(spark, monkeypatch):
    rng = np.random.default_rng(5)
    trains = {1: np.arange(400) * 1200, 2: np.cumsum(rng.integers(30_000, 36_000, 60)), 3: np.array([5, 900]), 4: (np.arange(40)[:, None] * 30_000 + np.arange(4) * 90).ravel(), 5: np.sort(rng.choice(3_000_000, 120, False))}
    df = spark.createDataFrame([(u * 1000 + i, 1, int(t), u, None) for u, ts in trains.items() for i, t in enumerate(ts)], "spike_id bigint, recording_id int, time bigint, unit int, electrode int")
    monkeypatch.setattr(q_trains, "_spikes", lambda spark, d: df)
    want = {u: _class(ts) for u, ts in trains.items()}
    assert want[1] == "rhythmic" and want[4] == "bursting"
    for query in (q_trains.pattern_features, q_trains.pattern_records, q_trains.pattern_analysis):
        assert {r.unit: r.pattern_type for r in query(spark, "").collect()} == want
    counts = {r.pattern_type: (r.n_trains, r.percent) for r in q_trains.pattern_class_counts(spark, "").collect()}
    assert counts == {c: (n, 20.0 * n) for c, n in Counter(want.values()).items()}


def test_sliding_rates_of_a_second_by_tenths(spark, monkeypatch):
    rng = np.random.default_rng(6)
    trains = {1: np.sort(rng.integers(0, 900_000, 80)), 2: np.cumsum(rng.integers(1, 9_000, 150)), 3: np.array([7, 3_007]), 4: np.array([5, 5])}
    df = spark.createDataFrame([(u * 1000 + i, 1, int(t), u, None) for u, ts in trains.items() for i, t in enumerate(ts)], "spike_id bigint, recording_id int, time bigint, unit int, electrode int")
    monkeypatch.setattr(q_trains, "_spikes", lambda spark, d: df)
    want = {u: [int(((g - 15_000 <= ts) & (ts <= g + 15_000)).sum()) for g in range(int(ts[0]), int(ts[-1]), 3_000)] for u, ts in trains.items()}
    got = {}
    for r in q_trains.sliding_rate(spark, "").orderBy("unit", "k").collect():
        got.setdefault(r.unit, []).append(r.n)
    assert got == {u: n for u, n in want.items() if n}
    stats = {r.unit: (r.mean_rate, r.max_rate, r.min_rate) for r in q_trains.sliding_rate_stats(spark, "").collect()}
    assert stats == {u: (pytest.approx(np.mean(n)), max(n), min(n)) for u, n in want.items() if n} and stats[1][2] == 0 < stats[2][2]


def test_fast_rhythms_and_lags_of_a_millisecond(spark, monkeypatch):
    rng = np.random.default_rng(7)
    fast = np.arange(4000) * 375  # 80 spikes a second
    jitter = np.sort(rng.choice(fast[-1], 1000, False))
    trains = {1: fast, 2: fast + 130, 3: jitter}
    df = spark.createDataFrame([(u * 10_000 + i, 1, int(t), u, None) for u, ts in trains.items() for i, t in enumerate(ts)], "spike_id bigint, recording_id int, time bigint, unit int, electrode int")
    monkeypatch.setattr(q_trains, "_spikes", lambda spark, d: df)
    found = {r.unit: r.dominant_frequency for r in q_trains.train_dominant_frequency(spark, "").collect()}
    assert found[1] == pytest.approx(80, abs=0.3)
    spectrum = {r.frequency: r.power for r in q_trains.train_spectrum(spark, "").where("unit = 1").collect()}
    assert 99 < max(spectrum) <= 100 and max(spectrum, key=lambda f: spectrum[f] * (f > 0)) == found[1]
    lags = {r.lag: r.value for r in q_trains.autocorrelogram(spark, "").where("unit = 3").collect()}
    at = np.unique((jitter - jitter[0]) // 30)
    at = at[at < (jitter[-1] - jitter[0]) // 30]
    assert lags == {k: pytest.approx(np.isin(at + k, at).sum() / len(at), abs=1e-6) for k in range(1000)}
    assert {r.lag for r in q_trains.cross_correlogram(spark, "").collect()} == set(range(-100, 101))
    lo, hi = fast[0] + 130, fast[-1]
    x, y = ({int(t - lo) // 30 for t in trains[u] if lo <= t <= hi and (t - lo) // 30 < (hi - lo) // 30} for u in (1, 2))
    counts = {lag: sum(b + lag in x for b in y) for lag in range(-100, 101)}
    peak = q_trains.xcorr_peak(spark, "").first()
    assert (peak.peak_lag, peak.peak_correlation) == (min(counts, key=lambda k: (-counts[k], k)), max(counts.values()))
