"""Trains packed in pieces and stretches: equal to analyses of whole trains, with little shuffled."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_trains import burst_loop, random_rows, spikes, trains

from spindrift.functions import scale
from spindrift.operators import packed as P
from spindrift.operators import trains as T
from spindrift.plans import q_trains

KEYS = ["recording_id", "unit"]


def shuffled(spark, run):
    """Bytes written to shuffles while ``run`` runs."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def sparse_rows(n_trains=300, n=100, span=8_500_000):
    rng = np.random.default_rng(3)
    return [(1 + u % 3, int(t), u, None) for u in range(n_trains) for t in rng.integers(0, span, n)]


def test_little_is_shuffled_for_patterns(spark, monkeypatch):
    df = spikes(spark, sparse_rows())
    monkeypatch.setattr(q_trains, "_spikes", lambda spark, d: df)
    # a spike is heard at eleven points of the grid and lies in two segments; none of these rows may be shuffled
    assert shuffled(spark, lambda: q_trains.pattern_analysis(spark, "").collect()) < 60 * 30_000


@pytest.mark.parametrize(("block", "stretch", "piece", "dense"), [(50, 400, 3, 64), (10**6, 10**8, 1024, 64), (300, 700, 7, 0)])
def test_patterns_of_pieces_equal_those_of_whole_trains(spark, monkeypatch, block, stretch, piece, dense):
    monkeypatch.setattr(P, "PIECE", piece)
    monkeypatch.setattr(P, "DENSE", dense)
    monkeypatch.setattr(T, "SEGMENT", 64)
    far = [(9, t, 1, None) for t in (-700, -690, -685, 3, 3, 3, 1900, 1905, 1909, 1912, 5000, 5003)]
    run = [(8, int(t), 1, None) for t in 1000 + np.cumsum(np.random.default_rng(4).integers(2, 9, 400))] + [(8, 9, 2, None), (8, 9, 2, None), (8, 5, 3, None)]
    df = spikes(spark, random_rows(41, 500) + far + run)
    got = {(r.recording_id, r.unit): r for r in T.patterns(df, KEYS, 1000.0, 9, 3, 2, 100, 30, 100.0, block, stretch).collect()}
    parts = [T.interval_stats(df, KEYS), T.burst_stats(df, KEYS, 9, 3).drop("n_spikes"), T.sliding_rate_stats(df, KEYS, 100, 30, 1000.0).withColumnsRenamed({f"{c}_rate": f"{c}_sliding" for c in ("mean", "max", "min")}), T.dominant_frequencies(df, KEYS, 2, 1000.0)]
    want = {}
    for part in parts:
        for r in part.collect():
            want.setdefault((r.recording_id, r.unit), {}).update(r.asDict())
    assert set(got) == set(want)
    for k, row in want.items():
        assert {c: got[k][c] for c in row} == {c: pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for c, v in row.items()}
        if "mean_sliding" not in row:
            assert (got[k].mean_sliding, got[k].max_sliding, got[k].min_sliding) == (None, None, None)


@pytest.mark.parametrize(("block", "stretch", "piece"), [(50, 400, 3), (500, 700, 7)])
def test_records_of_pieces_are_whole(spark, monkeypatch, block, stretch, piece):
    monkeypatch.setattr(P, "PIECE", piece)
    monkeypatch.setattr(P, "POINTS", 40)
    rows = random_rows(42, 400) + [(9, t, 1, None) for t in (-700, 3, 3, 1900, 1905, 1909, 5000)] + [(8, 1000 + 4 * i, 1, None) for i in range(400)]
    got = {}
    for r in T.pattern_records(spikes(spark, rows), KEYS, 1000, 9, window=100, step=30, block=block, stretch=stretch).collect():
        got.setdefault((r.recording_id, r.unit), []).append(r)
    for k, v in trains(rows).items():
        parts, grid, times = sorted(got[k], key=lambda r: r.part), range(v[0], v[-1], 30), sorted(set(v))
        assert [r.part for r in parts] == sorted({(t - v[0]) // block for t in [*v, *grid]})
        assert [tuple(x) for r in parts for x in r.isi] == [(t, t - times[i - 1] if i else None, v.count(t)) for i, t in enumerate(times)]
        assert [tuple(x) for r in parts for x in r.rates] == [(g, sum(g - 50 <= t <= g + 50 for t in v) * 10.0) for g in grid]
        assert [(b[0], b[1], b[3], b[4], b[5]) for r in parts for b in r.bursts] == burst_loop(v, 9, 3)


def test_little_is_shuffled_for_records(spark, monkeypatch):
    df = spikes(spark, sparse_rows())
    monkeypatch.setattr(q_trains, "_spikes", lambda spark, d: df)
    assert shuffled(spark, lambda: q_trains.pattern_records(spark, "").write.format("noop").mode("overwrite").save()) < 120 * 30_000


def test_records_come_back_from_small_files(spark, tmp_path):
    from spindrift.sources import readers, sinks

    rows = [(1, t, 1, None) for t in (3, 3, 50, 55, 2000, 2500)] + [(1, 5, 2, None), (1, 7, 3, None), (1, 20, 3, None)]
    records = T.pattern_records(spikes(spark, rows), KEYS, 1000, 9, window=100, step=1, block=700)
    sinks.write_patterns(records, str(tmp_path / "json"))
    back = readers.read_patterns(spark, str(tmp_path / "json"), records.schema)
    assert back.schema["rates"].dataType.simpleString() == records.schema["rates"].dataType.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, records.collect()))
    # 2,510 rates: 24 bytes each as plain text of time and rate
    assert sum(p.stat().st_size for p in (tmp_path / "json").glob("part*")) < 4 * 2_510


def test_little_is_shuffled_for_features(spark, monkeypatch):
    df = spikes(spark, sparse_rows())
    monkeypatch.setattr(q_trains, "_spikes", lambda spark, d: df)
    assert shuffled(spark, lambda: q_trains.pattern_features(spark, "").collect()) < 60 * 30_000


def test_little_is_written_for_features(spark, monkeypatch, tmp_path):
    df = spikes(spark, sparse_rows())
    monkeypatch.setattr(q_trains, "_spikes", lambda spark, d: df)
    monkeypatch.setattr(scale, "shared_dir", lambda spark: f"file:{tmp_path}")
    q_trains.pattern_features(spark, "").collect()
    # the packed trains and a row a train; 8 bytes a time as they are
    assert 0 < sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 5 * 30_000


def test_spikes_on_the_common_clock_are_written_densely(spark, small):
    from spindrift.plans.recording import recording

    files = [f.removeprefix("file:") for f in recording(spark, small, refresh=True).spikes.inputFiles()]
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in files]
    assert {g.column(i).compression for g in groups for i in range(g.num_columns)} == {"ZSTD"}
