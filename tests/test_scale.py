"""Checked broadcasts, written tables and the plans they lead to."""

import pytest

from spindrift.functions import scale
from spindrift.functions.scale import bounded_broadcast, shared_dir, written
from spindrift.operators.ranges import band_join


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bounded_broadcast(spark):
    a, b = spark.range(100), spark.range(10)
    assert "strategy=broadcast" in plan(a.join(bounded_broadcast(b, 10), "id"))
    assert "strategy=broadcast" not in plan(a.join(bounded_broadcast(b, 9), "id"))


def test_written_tables_lie_in_the_folder_the_session_names(spark):
    df = spark.createDataFrame([(1, None), (2, [1, 2])], "a int, b array<int>")
    out = written(df, "x")
    assert sorted(map(tuple, out.collect())) == [(1, None), (2, [1, 2])]
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert all(shared_dir(spark) in f for f in out.inputFiles()) and out.inputFiles()


def test_band_join_is_an_equi_join(spark):
    events = spark.range(100).selectExpr("1 AS recording_id", "id AS time")
    intervals = spark.range(5).selectExpr("id AS interval_id", "1 AS recording_id", "id * 10 AS Start", "id * 10 + 3 AS End")
    text = band_join(events, intervals, ["recording_id"], 5, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_scans_are_pruned_and_filtered(spark, small):
    from spindrift.plans.problems import p1_found, p5_found

    text = p1_found(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "loaded_at" not in text and "spike_id" not in text and "EqualTo(spikes_time_unit,ticks)" in text
    assert "loaded_at" not in p5_found(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_broadcasts_are_bounded_in_bytes(spark):
    wide = spark.range(100).selectExpr("id", "repeat('x', 1000) AS s", "array_repeat('abc', 10) AS a", "map('k', id) AS m", "struct(id, 'y' AS z) AS t", "CAST(NULL AS string) AS n")
    a = spark.range(100)
    assert "strategy=broadcast" in plan(a.join(bounded_broadcast(wide, 1000, 200_000), "id"))
    assert "strategy=broadcast" not in plan(a.join(bounded_broadcast(wide, 1000, 100_000), "id"))


class FakeCluster:
    """A session on a cluster that names no shared folder."""

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_dir(FakeCluster)


def test_rows_that_are_lost_are_noticed(spark, tmp_path):
    empty = spark.createDataFrame([], "a int")
    assert written(empty, "none").count() == 0
    with pytest.raises(RuntimeError, match="3 rows were written"):
        scale.check_rows(empty, 3, str(tmp_path))


def test_recordings_are_read_again_once_files_change(spark, small, tmp_path):
    import shutil

    from spindrift.plans.recording import SOURCES, recording

    for name in SOURCES:
        shutil.copy(f"{small}/{name}.parquet", tmp_path / f"{name}.parquet")
    one = recording(spark, str(tmp_path))
    assert recording(spark, str(tmp_path)) is one
    n = one.spikes.count()
    spark.read.parquet(f"{small}/spikes_time_adjusted.parquet").limit(50).toPandas().to_parquet(tmp_path / "spikes_time_adjusted.parquet", coerce_timestamps="us")
    two = recording(spark, str(tmp_path))
    assert 0 < two.spikes.count() < n and recording(spark, str(tmp_path), refresh=True) is not two


def test_hot_keys_need_both_tables(spark, small):
    from spindrift.plans.problems import p5_found

    text = p5_found(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "recordings.parquet" in text and "spikes_time_adjusted.parquet" in text and "Join" in text
