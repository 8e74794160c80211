"""Trains, histograms around stimuli and grids against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from spindrift.operators import trains as T
from spindrift.operators.geometry import rank_all
from spindrift.operators.grids import histogram, n_bins, pearson, pearson_wide, smooth, trapezoid
from spindrift.operators.psth import Psth
from spindrift.operators.ranges import band_join, high_activity_windows, in_range, on_electrodes, overlap_join

SCHEMA = "spike_id bigint, recording_id int, time bigint, unit int, electrode int"


def spikes(spark, rows):
    return spark.createDataFrame([(i, r, t, u, e) for i, (r, t, u, e) in enumerate(rows)], SCHEMA)


def random_rows(seed, n=300, span=2000):
    rng = random.Random(seed)
    return [(rng.choice([1, 2]), rng.randrange(span), rng.choice([1, 1, 2, 3]), rng.choice([5, 6, None])) for _ in range(n)]


def trains(rows):
    out = {}
    for r, t, u, _ in rows:
        out.setdefault((r, u), []).append(t)
    return {k: sorted(v) for k, v in out.items()}


def burst_loop(times, max_isi, least):
    """The state machine: runs of intervals at most max_isi."""
    out, start = [], 0
    for i in range(1, len(times) + 1):
        if i == len(times) or times[i] - times[i - 1] > max_isi:
            if i - start >= least:
                out.append((times[start], times[i - 1], i - start, start, i - 1))
            start = i
    return out


@pytest.mark.parametrize("seed", range(4))
def test_bursts_and_intervals(spark, seed):
    rows = random_rows(seed)
    df = spikes(spark, rows)
    got = sorted((r.recording_id, r.unit, r.start_time, r.end_time, r.spike_count, r.start_idx, r.end_idx) for r in T.bursts(df, ["recording_id", "unit"], 9, 3).collect())
    want = sorted((*k, *b) for k, v in trains(rows).items() for b in burst_loop(v, 9, 3))
    assert got == want
    isi = {}
    for r in T.intervals(df, ["recording_id", "unit"], "spike_id", block=50).collect():
        isi.setdefault((r.recording_id, r.unit), []).append((r.time, r.isi))
    for k, v in trains(rows).items():
        assert sorted(x for x in isi[k] if x[1] is not None) == sorted(zip(v[1:], np.diff(v), strict=True))


def test_interval_edge_cases(spark):
    df = spikes(spark, [(1, 5, 1, None), (1, 5, 2, None), (1, 5, 2, None)])
    got = {r.unit: r for r in T.interval_stats(df, ["recording_id", "unit"], "spike_id").collect()}
    assert (got[1].n_spikes, got[1].mean_isi, got[1].cv_isi) == (1, None, None)
    assert (got[2].n_spikes, got[2].mean_isi, got[2].std_isi, got[2].cv_isi) == (2, 0.0, 0.0, None)
    assert T.sliding_rate(df, ["recording_id", "unit"], 10, 5, 1).collect() == []
    assert T.bursts(df.limit(0), ["recording_id", "unit"], 9).collect() == []


def test_burst_boundaries(spark):
    rows = [(1, t, 1, None) for t in (0, 10, 20, 31, 100, 110, 120)]  # intervals of exactly 10, then 11; ends inside a burst
    got = sorted((r.start_time, r.end_time, r.spike_count) for r in T.bursts(spikes(spark, rows), ["unit"], 10).collect())
    assert got == [(0, 20, 3), (100, 120, 3)]


def test_sliding_rate(spark):
    rows = random_rows(7)
    got = {}
    for r in T.sliding_rate(spikes(spark, rows), ["recording_id", "unit"], 100, 30, 1000).collect():
        got.setdefault((r.recording_id, r.unit), []).append((r.k, r.time, r.rate))
    for k, v in trains(rows).items():
        grid = range(v[0], v[-1], 30)
        assert sorted(got[k]) == [(i, g, sum(g - 50 <= t <= g + 50 for t in v) * 10.0) for i, g in enumerate(grid)]


def dense_bins(v, width):
    n = (v[-1] - v[0]) // width
    out = np.zeros(n)
    for t in v:
        i = (t - v[0]) // width
        if i < n:
            out[i] = 1
    return out


def test_autocorrelogram(spark):
    rows = random_rows(8)
    got = {}
    for r in T.autocorrelogram(spikes(spark, rows), ["recording_id", "unit"], 3, 20).collect():
        got.setdefault((r.recording_id, r.unit), {})[r.lag] = r.value
    for k, v in trains(rows).items():
        b = dense_bins(v, 3)
        full = np.correlate(b, b, "full")[len(b) - 1 :]
        assert [got[k][i] for i in range(20)] == pytest.approx(list(full[:20] / full[0]))


def test_cross_correlogram(spark):
    rows = random_rows(9)
    got = {}
    for r in T.cross_correlogram(spikes(spark, rows), ["recording_id"], 1, 2, 3, 8).collect():
        got.setdefault(r.recording_id, {})[r.lag] = r.n
    for rec in (1, 2):
        a, b = trains(rows)[rec, 1], trains(rows)[rec, 2]
        lo, hi = max(a[0], b[0]), min(a[-1], b[-1])
        n = (hi - lo) // 3
        x, y = np.zeros(n), np.zeros(n)
        for times, out in ((a, x), (b, y)):
            for t in times:
                if lo <= t <= hi and (t - lo) // 3 < n:
                    out[(t - lo) // 3] = 1
        full = np.correlate(x, y, "full")
        assert [got[rec][lag] for lag in range(-8, 9)] == list(full[n - 1 - 8 : n + 8])
    alone = spikes(spark, [(1, 5, 1, None), (1, 9, 1, None), (1, 7, 2, None)])
    assert T.cross_correlogram(alone, ["recording_id"], 1, 2, 3, 8).collect() == []


def test_dominant_frequency(spark):
    rows = [(1, 40 * i, 1, None) for i in range(400)] + [(1, i, 2, None) for i in range(5)]
    got = {r.unit: r.dominant_frequency for r in T.dominant_frequencies(spikes(spark, rows), ["recording_id", "unit"], 1, 1000.0).collect()}
    assert got[1] == pytest.approx(25, abs=0.6) and got[2] is None


def test_spectra_and_records(spark):
    rows = [(1, 40 * i, 1, None) for i in range(400)] + [(1, 5, 2, None)]
    got = {r.unit: r for r in T.train_spectra(spikes(spark, rows), ["recording_id", "unit"], 1, 1000.0, max_frequency=60).collect()}
    assert got[2].frequencies is None and max(got[1].frequencies) <= 60 and len(got[1].power) == len(got[1].frequencies)
    assert got[1].frequencies[int(np.argmax(got[1].power[1:])) + 1] == got[1].dominant_frequency
    rows = random_rows(3) + [(7, 5, 1, None)]
    records = {(r.recording_id, r.unit): r for r in T.pattern_records(spikes(spark, rows), ["recording_id", "unit"], 1000, 9, window=100, step=30).collect()}
    for k, v in trains(rows).items():
        r = records[k]
        assert [(x.time, x.n) for x in r.isi] == sorted(Counter(v).items()) and [x.isi for x in r.isi] == [None, *np.diff(sorted(set(v))).tolist()] and [(b.start_time, b.end_time, b.spike_count) for b in r.bursts] == [b[:3] for b in burst_loop(v, 9, 3)]
        assert [x.time for x in r.rates] == list(range(v[0], v[-1], 30)) and r.n_bursts == len(r.bursts)
    assert records[7, 1].error and len(records[7, 1].isi) == 1 and records[7, 1].rates == [] and records[7, 1].bursts == [] and records[7, 1].pattern_type == "insufficient_data"


def test_records_are_cut_into_parts(spark):
    rows = random_rows(5)
    got = {}
    for r in T.pattern_records(spikes(spark, rows), ["recording_id", "unit"], 1000, 9, window=100, step=30, block=500).collect():
        got.setdefault((r.recording_id, r.unit), []).append(r)
    for k, v in trains(rows).items():
        parts = sorted(got[k], key=lambda r: r.part)
        assert [r.part for r in parts] == sorted({(t - v[0]) // 500 for t in [*v, *range(v[0], v[-1], 30)]}) and len({r.pattern_type for r in parts}) == 1
        assert [x.time for r in parts for x in r.isi] == sorted(set(v)) and [x.time for r in parts for x in r.rates] == list(range(v[0], v[-1], 30))
        assert [b[:3] for r in parts for b in r.bursts] == [(b[0], b[1], b[1] - b[0]) for b in burst_loop(v, 9, 3)]


@pytest.mark.parametrize("block", [7, 50, 10**6])
def test_blocks_of_a_train_go_on(spark, block):
    rows = random_rows(21, 400)
    got = {}
    for r in T.laid_out(spikes(spark, rows), ["recording_id", "unit"], 9, block).collect():
        got.setdefault((r.recording_id, r.unit), []).append((r.time, r.n, r.lo, r.hi, r.total, r.isi, r.run_start, r.idx))
    for k, v in trains(rows).items():
        want, run = [], None
        for i, t in enumerate(sorted(set(v))):
            isi = t - want[-1][0] if i else None
            run = t if isi is None or isi > 9 else run
            want.append((t, v.count(t), v[0], v[-1], len(v), isi, run, sum(x < t for x in v)))
        assert sorted(got[k]) == want


def dense_spectrum(v, width, rate, top):
    train = dense_bins(v, width)
    size = min(2048, len(train) // 4)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.mean([np.abs(np.fft.rfft((x - x.mean()) * window)) ** 2 for x in (train[i : i + size] for i in range(0, len(train) - size + 1, size - size // 2))], axis=0) / (rate * (window**2).sum())
    power[1 : None if size % 2 else -1] *= 2
    frequencies = np.fft.rfftfreq(size, 1 / rate)
    return frequencies[frequencies <= top], power[frequencies <= top]


@pytest.mark.parametrize(("span", "top"), [(200, 500.0), (311, 100.0), (30_000, 100.0), (2_000, 500.0)])
def test_spectra_of_segments_equal_those_of_whole_trains(spark, span, top, monkeypatch):
    monkeypatch.setattr(T, "OCCUPIED", 50)
    rng = random.Random(span)
    rows = [(1, rng.randrange(span), u, None) for u in range(4) for _ in range(10 + 40 * u)]
    got = {r.unit: r for r in T.train_spectra(spikes(spark, rows), ["recording_id", "unit"], 2, 2000.0, max_frequency=top).collect()}
    for (_, u), v in trains(rows).items():
        frequencies, power = dense_spectrum(v, 2, 1000.0, top)
        assert got[u].frequencies == pytest.approx(list(frequencies)) and got[u].power == pytest.approx(list(power), abs=1e-12)
        assert power[1:].max() == pytest.approx(got[u].power[got[u].frequencies.index(got[u].dominant_frequency)])


def test_classes(spark):
    rows = [(9, 0.9, 50.0, 0.1), (20, 0.2, 50.0, 0.1), (20, 0.05, 11.0, 0.1), (20, 0.05, 10.0, 0.1), (20, 0.05, None, 2.5), (20, 0.05, None, 1.0), (20, 0.0, None, None)]
    df = spark.createDataFrame(rows, "n_spikes bigint, burst_ratio double, dominant_frequency double, cv_isi double")
    assert [(r.pattern_type, round(r.confidence, 3)) for r in T.classes(df).collect()] == [("insufficient_data", 0.0), ("bursting", 0.4), ("rhythmic", 0.8), ("regular", 0.9), ("irregular", 1.0), ("tonic", 0.6), ("irregular", 1.0)]


def psth_loop(rows, starts, before, after, width, key):
    edges = np.arange(-before, after + width, width)
    out = {}
    for u in {r[key] for r in rows if r[key] is not None}:
        rel, valid = [], 0
        for rec, s in starts:
            mine = [t - s for r, t, *_rest in rows if r == rec and (_rest[key - 2] == u) and s - before <= t <= s + after]
            rel += mine
            valid += bool(mine)
        hist = np.histogram(rel, edges)[0]
        out[u] = (len(rel), valid, hist / (width / 1000) / valid if valid else np.zeros(len(edges) - 1))
    return out


@pytest.mark.parametrize(("before", "after", "width", "key"), [(100, 200, 50, 2), (100, 500, 70, 2), (30, 60, 10, 3)])
def test_psth(spark, before, after, width, key):
    rows = random_rows(11)
    rows += [(1, 400 - before, 1, 5), (1, 400 + after, 1, 5)]  # on both edges of a window
    starts = [(1, 400), (1, 450), (2, 900), (2, 1500), (9, 3)]
    intervals = spark.createDataFrame([(i, r, s, s + 10) for i, (r, s) in enumerate(starts)], "interval_id bigint, recording_id int, Start bigint, End bigint")
    p = Psth(spikes(spark, rows), intervals, "unit" if key == 2 else "electrode", before=before, after=after, width=width)
    assert p.bins == n_bins(before, after, width)
    want = psth_loop(rows, starts, before, after, width, key)
    name = p.key
    assert {r[name]: (r.total_spikes, r.valid_intervals) for r in p.totals().collect()} == {u: w[:2] for u, w in want.items()}
    got = {}
    for r in p.rates().collect():
        got.setdefault(r[name], {})[r.bin] = r.firing_rate
    for u, (_, _, rate) in want.items():
        assert [got[u][b] for b in range(len(rate))] == pytest.approx(list(rate))


def test_psth_of_silent_units_and_no_intervals(spark):
    intervals = spark.createDataFrame([(0, 1, 10_000, 10_010)], "interval_id bigint, recording_id int, Start bigint, End bigint")
    df = spikes(spark, [(1, 5, 1, None), (1, 10_005, 2, None)])
    got = {r.unit: r for r in Psth(df, intervals, before=100, after=100, width=50).response_classes().collect()}
    assert (got[1].total_spikes, got[1].peak_rate, got[1].modulation_ratio, got[1].response) == (0, 0.0, None, "non_responsive")
    assert (got[2].valid_intervals, got[2].modulation_ratio, got[2].response) == (1, None, "responsive")
    none = Psth(df, intervals.limit(0), before=100, after=100, width=50)
    assert {r.firing_rate for r in none.rates().collect()} == {0.0}
    assert none.trials().collect() == []


def test_joins_keep_every_pair(spark):
    rows = random_rows(12)
    rng = random.Random(4)
    spans = [(i, rng.choice([1, 2]), s := rng.randrange(2000), s + rng.choice([0, 3, 40, 900])) for i in range(40)]
    intervals = spark.createDataFrame(spans, "interval_id bigint, recording_id int, Start bigint, End bigint")
    df = spikes(spark, rows)
    got = sorted((r.spike_id, r.interval_id) for r in overlap_join(df, intervals, ["recording_id"], 37).collect())
    assert got == sorted((i, k) for i, (r, t, *_) in enumerate(rows) for k, q, a, b in spans if q == r and a <= t <= b)
    got = sorted((r.spike_id, r.interval_id) for r in band_join(df, intervals, ["recording_id"], 20, 33).collect())
    assert got == sorted((i, k) for i, (r, t, *_) in enumerate(rows) for k, q, a, b in spans if q == r and a - 20 <= t <= a + 33)


def test_ranges(spark):
    df = spikes(spark, [(1, 1, 1, 4), (1, 2, 1, None), (1, 3, 1, 5), (1, None, 1, 4)])
    assert in_range(df, 1, 3).count() == 3 and in_range(df, 1, 3, closed=False).count() == 2 and in_range(df).count() == 3
    assert on_electrodes(df, [4]).count() == 2 and on_electrodes(df, []).count() == 4
    busy = high_activity_windows(spikes(spark, [(1, t, 1, None) for t in (0, 1, 2, 25, 29, 30)]), ["recording_id"], 10, 5, 1)
    # the spike at the very end belongs to no window, the empty one counts
    assert [(r.start_time, r.end_time, r.n_spikes) for r in sorted(busy.collect(), key=lambda r: r.rank)] == [(0, 10, 3), (20, 30, 2), (10, 20, 0)]


def test_grids(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (0, 1, 2, 2, 10)] + [(2, 5.0), (3, None)], "g int, v double")
    got = {}
    for r in histogram(df, "v", 5, ["g"]).collect():
        got.setdefault(r.g, []).append((r.bin, r["count"]))
    assert sorted(got[1]) == list(enumerate(np.histogram([0, 1, 2, 2, 10], 5)[0])) and sorted(got[2]) == list(enumerate(np.histogram([5.0], 5)[0])) and 3 not in got
    assert histogram(df.limit(0), "v", 5).collect() == []
    series = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(series)], "g int, bin int, v double")
    for size in (1, 2, 3, 5):
        padded = np.pad(series, size, mode="symmetric")
        want = [padded[size + i - size // 2 : size + i - size // 2 + size].mean() for i in range(6)]
        assert [r.v for r in smooth(rows, "v", size, ["g"]).orderBy("bin").collect()] == pytest.approx(want)
    assert trapezoid(rows, "bin", "v", ["g"], "a").first().a == pytest.approx(np.trapezoid(series))
    m = spark.createDataFrame([(k, i, v) for k, vs in ((1, (1, 2, 4)), (2, (2, 3, 9)), (3, (5, 5, 5))) for i, v in enumerate(vs)], "k int, i int, v int")
    corr = {(r.i, r.j): r["corr"] for r in pearson(m, "k", "i", "v").collect()}
    assert corr[1, 2] == pytest.approx(np.corrcoef([1, 2, 4], [2, 3, 9])[0, 1]) and corr[1, 3] is None and corr[3, 3] is None and math.isclose(corr[1, 1], 1)


def test_correlations_of_arrays(spark):
    rng = random.Random(31)
    rows = [[rng.choice([None, *[rng.random()] * 6]), rng.random(), 5.0, rng.random()][: rng.choice([2, 4, 4, 4])] for _ in range(60)] + [None, []]
    got = {(r.i, r.j): r.corr for r in pearson_wide(spark.createDataFrame([(x,) for x in rows], "v array<double>").repartition(5), "v").collect()}
    assert set(got) == {(i, j) for i in range(4) for j in range(i, 4)}
    for (i, j), corr in got.items():
        both = [(x[i], x[j]) for x in rows if x and len(x) > max(i, j) and None not in (x[i], x[j])]
        assert corr is None if 2 in (i, j) else corr == pytest.approx(np.corrcoef(np.array(both).T)[0, 1])
    assert pearson_wide(spark.createDataFrame([], "v array<double>"), "v").collect() == []


def test_ranks_of_whole_groups(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b"]), i, rng.randrange(20)) for i in range(500)]
    got = {(r.k, r.i): r.rank for r in rank_all(spark.createDataFrame(rows, "k string, i int, n int"), ["k"], [F.col("n").desc(), F.col("i")]).collect()}
    for k in "ab":
        assert [got[k, i] for _, i in sorted((-n, i) for g, i, n in rows if g == k)] == list(range(1, sum(g == k for g, _, _ in rows) + 1))
    assert rank_all(spark.createDataFrame([], "k string, i int, n int"), ["k"], [F.col("i")]).collect() == []
