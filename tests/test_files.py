"""Readers, writers, the voltage source, streams and the golden rates of a whole recording."""

import json

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spindrift.operators import geometry as G
from spindrift.sources import readers, sinks
from spindrift.sources.voltage import read_voltage
from spindrift.streaming.rates import streamed_bursts, windowed_rates

PROBE = "poly2\n# a comment\n1 1 21.65 25\n2  2 -21.65 25\n\n3 3 0\n4 4 10 50\n   \n"
# Spikes of each electrode in a recording of 26,918,083 ticks, and rates they come to.
COUNTS = {4: 1424, 5: 3678, 6: 4948, 8: 10813, 9: 5066, 11: 2234, 12: 6371, 13: 26274, 15: 16664, 18: 41040, 20: 17012, 21: 57619, 22: 25719, 23: 24640, 24: 3677, 26: 11665, 27: 4390, 28: 2903, 30: 3855, 31: 18401}


def test_spike_files_round_trip(spark, tmp_path):
    (tmp_path / "s.csv").write_text("0.5, 1, 7\n1.25, 2, 8\n0.00005, 3, 9\nbad, 4, 9\n")
    seconds = readers.read_spikes(spark, str(tmp_path / "s.csv"))
    ticks = readers.adjust_to_ticks(seconds)
    assert [(r.time, r.unit) for r in ticks.orderBy("unit").collect()] == [(15000, 1), (37500, 2), (2, 3), (None, 4)]  # 1.5 goes to 2
    sinks.write_spikes(ticks, str(tmp_path / "out"))
    again = readers.read_spikes(spark, str(tmp_path / "out"), ticks=True, third="channel")
    assert again.columns == ["time", "unit", "channel"] and sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, ticks.collect()), key=str)
    with pytest.raises(AnalysisException):
        readers.read_spikes(spark, str(tmp_path / "none.csv"))


def test_local_paths():
    assert readers.local_path("C:\\data\\a b\\x.dat") == "/mnt/c/data/a b/x.dat" and readers.local_path("d:/x") == "/mnt/d/x" and readers.local_path("/data/x") == "/data/x"


def test_half_even_ticks(spark):
    got = readers.adjust_to_ticks(spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "time double"), per_second=1)
    assert [r.time for r in got.collect()] == [0, 2, 2, 0]


def test_intervals_geometry_and_bundle(spark, tmp_path):
    (tmp_path / "pico.csv").write_text("Start,End\n0,0\n300,600\n30,90\n9000,9000\n")
    (tmp_path / "probe.cfg").write_text(PROBE)
    (tmp_path / "s.csv").write_text("30,1,1\n60,1,2\n")
    got = readers.read_intervals(spark, str(tmp_path / "pico.csv"))
    assert [tuple(r) for r in got.orderBy("interval_id").collect()] == [(1, 0, 0), (2, 300, 600), (3, 30, 90), (4, 9000, 9000)]
    assert readers.read_intervals(spark, str(tmp_path / "pico.csv"), keep_empty=False).count() == 2
    assert sorted(map(tuple, readers.read_geometry(spark, str(tmp_path / "probe.cfg")).collect())) == [(1, 1, 21.65, 25.0), (2, 2, -21.65, 25.0), (4, 4, 10.0, 50.0)]
    bundle = readers.read_bundle(spark, *(str(tmp_path / n) for n in ("s.csv", "pico.csv", "probe.cfg")))
    assert [r.time_sec for r in bundle.spikes.orderBy("time").collect()] == [0.001, 0.002] and {r.End_sec for r in bundle.intervals.collect()} == {0.0, 0.02, 0.003, 0.3}


def test_wide_and_other_sinks(spark, tmp_path):
    (tmp_path / "w.csv").write_text("pico_Interval Start,spikes_3_Event Presence,spikes_3_Event Count\n5,1,4\n")
    wide = readers.read_wide(spark, str(tmp_path / "w.csv"))
    assert tuple(wide.first()) == (5, 1, 4)
    rates = spark.createDataFrame([(1, 1, 0.5, 2.0, 3.5)], "poly int, electrode int, x double, y double, firing_rate double")
    sinks.write_rates(rates.coalesce(1), str(tmp_path / "rates"))
    assert next((tmp_path / "rates").glob("*.csv")).read_text() == "poly,electrode,x,y,firing_rate\n1.0,1.0,0.5,2.0,3.5\n"
    sinks.write_tables({"a": rates, "b": rates}, str(tmp_path / "tables"))
    assert spark.read.csv(str(tmp_path / "tables" / "b"), header=True).count() == 1
    nested = spark.createDataFrame([(1, [1.0, 2.0])], "unit int, isi array<double>")
    sinks.write_patterns(nested.coalesce(1), str(tmp_path / "json"))
    assert json.loads(next((tmp_path / "json").glob("*.json")).read_text()) == {"unit": 1, "isi": [1.0, 2.0]}
    assert json.loads(sinks.as_json(nested, "unit").first().json) == {"unit": 1, "isi": [1.0, 2.0]}
    psd = spark.createDataFrame([(0, 0, 0.0, 1.0), (1, 0, 0.0, 2.0)], "channel int, k int, freq double, psd double")
    sinks.write_spectrum(psd, psd.groupBy("channel").agg(F.max("psd").alias("peak")), str(tmp_path / "spectrum"))
    assert spark.read.parquet(str(tmp_path / "spectrum" / "psd")).where("channel = 1").count() == 1
    sinks.write_by_category(spark.createDataFrame([(1, "150ms"), (2, "other")], "id int, category string"), str(tmp_path / "cat"))
    assert {p.name for p in (tmp_path / "cat").glob("category=*")} == {"category=150ms", "category=other"}


def test_voltage_source(spark, tmp_path):
    data = np.arange(-500, 500, dtype="<i2").reshape(250, 4)
    path = tmp_path / "amplifier.dat"
    path.write_bytes(data.tobytes() + b"\1\2\3")  # a partial sample at the end
    rows = read_voltage(spark, str(path), 4, 100)
    assert rows.count() == 1000
    assert [tuple(r) for r in rows.where("sample = 3").orderBy("channel").collect()] == [(3, 0.03, c, int(data[3, c])) for c in range(4)]
    assert rows.where("channel = 2 AND time >= 1.0").count() == 150
    assert rows.where("channel IN (1, 3) AND sample < 10").agg(F.sum("v")).first()[0] == int(data[:10, [1, 3]].sum())
    part = read_voltage(spark, str(path), 4, 100, start=0.5, duration=1.0)
    assert part.agg(F.min("sample"), F.max("sample"), F.count("v")).first()[:] == (50, 149, 400)
    assert read_voltage(spark, str(path), 4, 100, start=9).count() == 0
    with pytest.raises(Exception, match="no such file"):
        read_voltage(spark, str(tmp_path / "none.dat")).count()


def test_golden_rates(spark):
    """The rates of a known recording come out of its counts and length."""
    span = 26_918_083
    sizes = spark.createDataFrame(sorted(COUNTS.items()), "electrode int, n int")
    spikes = sizes.select("electrode", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select(F.lit(1).alias("recording_id"), F.when((F.col("electrode") == 4) & (F.col("i") == 1), 0).when((F.col("electrode") == 31) & (F.col("i") == 1), span).otherwise(F.col("i")).cast("bigint").alias("time"), "electrode")
    probe = spark.createDataFrame([(e, e, 0.0, 0.0) for e in range(1, 33)], "poly int, electrode int, x double, y double")
    got = {r.electrode: r.firing_rate for r in G.with_geometry(G.firing_rates(spikes, "electrode", ["recording_id"], 30_000), probe, ["recording_id"]).collect()}
    assert len(got) == 32 and got[1] == 0 and sum(v > 0 for v in got.values()) == 20
    assert all(abs(got[e] - n * 30_000 / span) < 1e-9 for e, n in COUNTS.items()) and abs(got[21] - 64.216) < 1e-3
    extremes = G.rate_extremes(G.firing_rates(spikes, "electrode", ["recording_id"], 30_000), ["recording_id"]).first()
    assert (extremes.max_electrode, extremes.min_electrode) == (21, 4)


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00.000", 1), ("2024-01-01 00:00:00.005", 1), ("2024-01-01 00:00:00.015", 1), ("2024-01-01 00:00:40", 1), ("2024-01-01 00:00:41", 2), (None, 2)]
    df = spark.createDataFrame(rows, "t string, unit int").select(F.to_timestamp("t").alias("ts"), "unit")
    df.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("2024-01-01 01:00:00", 9)], "t string, unit int").select(F.to_timestamp("t").alias("ts"), "unit").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("rates", windowed_rates(stream)), ("bursts", streamed_bursts(stream, ["unit"]))):
        q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    got = {(str(r.window_start), r.unit): (r.n_spikes, r.rate) for r in spark.table("rates").collect()}
    assert got == {("2024-01-01 00:00:00", 1): (3, 0.1), ("2024-01-01 00:00:30", 1): (1, 1 / 30), ("2024-01-01 00:00:30", 2): (1, 1 / 30)}
    assert [(r.unit, r.spike_count) for r in spark.table("bursts").collect()] == [(1, 3)]
    assert windowed_rates(df, slide="10 seconds").count() > 3
