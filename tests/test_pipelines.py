"""The composed analyses run end to end on small files."""

import numpy as np

from spindrift.operators.psth import Psth
from spindrift.plans import pipelines
from spindrift.sources import readers


def test_recording_from_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("".join(f"{t},{1 + t // 450 % 2},{1 + t // 450 % 3}\n" for t in range(0, 90_000, 450)))
    (tmp_path / "pico.csv").write_text("Start,End\n0,0\n30000,34500\n60000,69000\n90000,90000\n")
    (tmp_path / "probe.cfg").write_text("poly2\n1 1 21.65 25\n2 2 -21.65 25\n3 3 0 75\n")
    bundle = readers.read_bundle(spark, *(str(tmp_path / n) for n in ("s.csv", "pico.csv", "probe.cfg")))
    out = {k: v.collect() for k, v in pipelines.recording_analysis(bundle, end=45_000, electrodes=[1, 2]).items()}
    assert out["summary"][0].n_spikes == 200 and out["summary"][0].n_intervals == 4 and len(out["rates"]) == 3
    assert [r.interval_id for r in sorted(out["intervals"], key=lambda r: r.interval_id)] == [1, 2]
    assert 0 < len(out["raster"]) < 101
    p = Psth(pipelines._one_recording(bundle.spikes), pipelines._one_recording(bundle.intervals), before=1000, after=2000, width=500)
    frames = {k: v.count() for k, v in pipelines.psth_analysis(p).items()}
    assert frames["rates"] == 2 * 6 and frames["population"] == 6 and frames["modulation"] == 1
    found = pipelines.pattern_analysis(bundle.spikes, 30_000, 300, units=[1], width=300)
    row = found["patterns"].collect()[0]
    assert (row.unit, row.n_spikes, row.n_bursts, row.pattern_type, row.error) == (1, 100, 0, "rhythmic", None)
    assert found["classes"].count() == 1 and found["bursts"].count() == 0


def test_interval_activity(spark):
    rows = spark.createDataFrame(
        [(0, 4500, 1, 3, 0, 0), (10, 9010, 1, 1, 1, 2), (20, 22520, 0, 0, 1, 1), (30, 100, None, None, 0, 0)],
        "`pico_Interval Start` bigint, `pico_Interval End` bigint, `spikes_3_Event Presence` int, `spikes_3_Event Count` int, `spikes_12_Event Presence` int, `spikes_12_Event Count` int",
    )
    out = {k: v.collect() for k, v in pipelines.interval_activity(rows).items()}
    assert [r.category for r in out["intervals"]] == ["150ms", "300ms", "750ms", "other"]
    assert {r.unit: (r.active_intervals, r.total_intervals) for r in out["activity"]} == {3: (2, 4), 12: (2, 4)}
    assert {r.unit: (r.total_spikes, r.max_spikes, r.intervals_with_spikes) for r in out["counts"]} == {3: (4, 3, 2), 12: (3, 2, 2)}
    assert {r.unit: tuple(r)[1:] for r in out["heatmap"]} == {3: (100.0, 100.0, 0.0), 12: (0.0, 100.0, 100.0)}
    assert {r.category: (r.n_intervals, r.active_units) for r in out["categories"]} == {"150ms": (1, 1), "300ms": (1, 2), "750ms": (1, 1)}
    assert pipelines.interval_activity(rows.limit(0))["activity"].collect() == []


def test_quick_spectrum(spark, tmp_path):
    t = np.arange(4000) / 400
    data = np.zeros((4000, 4), "<i2")
    data[:, 2] = (1000 * np.sin(2 * np.pi * 20 * t)).astype("<i2")
    (tmp_path / "a.dat").write_bytes(data.tobytes())
    out = pipelines.quick_spectrum(spark, str(tmp_path / "a.dat"), channel=2, duration=8, channels=4, rate=400)
    row = out["analysis"].collect()
    assert len(row) == 1 and row[0].peak_frequency == 20.0 and max(row[0].band_powers, key=row[0].band_powers.get) == "beta"
    assert out["voltage"].count() == 3200
