"""Units of time in text and in values."""

import pytest

from spindrift.functions import time_units as U
from spindrift.operators.units import durations_to_microseconds, recording_units, to_microseconds


@pytest.mark.parametrize(
    ("entry", "unit"),
    [
        ("ticks", "ticks"), ("samples @30000Hz", "ticks"), ("1/30000 s", "ticks"), ("Ticks (30k)", "ticks"), ("20k samples", "smp20k"), ("samples@25kHz", "smp25k"), ("1/20000 s", "smp20k"),
        ("μs", "us"), ("µs", "us"), ("MS", "ms"), ("millisec.", "ms"), ("Microseconds", "us"), ("sec", "s"), ("", None), (None, None), ("?", None), ("see note", None), ("samples", None), ("rooms", None), ("thus", None),
    ],
)
def test_entries(entry, unit):
    assert U.unit_of_entry(entry) == unit


@pytest.mark.parametrize(
    ("note", "spikes", "pico"),
    [
        ("SPK FILE IN THOUSANDTHS OF A SECOND, STIMULUS INTERVALS AS SAMPLES, 20 000 PER SECOND", "ms", "smp20k"),
        ("spikes clocked at twenty kilohertz, sample counts, screen refresh 16.7 ms, pico Start/End: time col = msec", "smp20k", "ms"),
        ("unit times already multiplied by thirty thousand, piezo driven at 20 Hz", "ticks", None),
        ("camera at 500 fps, 2 ms exposure. unit times: one step = 0.04 ms", "smp25k", None),
        ("pico Start/End: usec, not ticks; screen refresh 16.7 ms", None, "us"),
        ("spikes not ticks but usec", "us", None),
        ("pico file in samples of the twenty-five kilohertz system", None, "smp25k"),
        ("filters 300 Hz to 6 kHz", None, None),
        ("spike times: screen refresh 16.7 ms", None, None),
        ("", None, None), (None, None, None),
    ],
)
def test_notes(note, spikes, pico):
    assert (U.unit_of_field(note, "spikes"), U.unit_of_field(note, "pico")) == (spikes, pico)


@pytest.mark.parametrize(
    ("text", "values", "unit"),
    [
        ("dur=148.0ms", (148.0,), "ms"), ("296,000 us", (296000.0, 296.0), "us"), ("0,2990 s", (0.299,), "s"), ("301.0e3 us", (301000.0,), "us"), ("9003 @30kHz", (9003.0,), "ticks"),
        ("4410 samples", (4410.0,), None), ("748000µs", (748000.0,), "us"), ("4575", (4575.0,), None), ("1.234.567 us", (1234567.0,), "us"), ("1,234.5 ms", (1234.5,), "ms"),
    ],
)
def test_amounts(text, values, unit):
    assert U.read_amount(text) == U.Reading(values, unit)


def test_amounts_without_a_number():
    assert U.read_amount("") is None and U.read_amount(None) is None and U.read_amount("ms") is None
    assert U.read_amount("x" * 100_000) is None


def test_recordings_by_text_and_by_value(spark):
    recordings = spark.createDataFrame(
        [(1, 10.0, "ticks", None), (2, 10.0, None, "spikes in µs"), (3, 10.0, "?", "lights off"), (4, None, None, None), (5, 10.0, "", ""), (None, 10.0, "ms", None), (6, 10.0, None, None), (6, 10.0, "ms", None)],
        "recording_id int, duration_s double, u string, note string",
    )
    values = spark.createDataFrame([(3, 199_000), (3, None), (4, 5), (7, 1)], "recording_id int, value bigint")
    got = {r.recording_id: r.unit for r in recording_units(recordings, "u", "spikes", values).collect()}
    assert got == {1: "ticks", 2: "us", 3: "smp20k", 4: None, 5: None, 6: "ms"}


def test_conversion_keeps_rows_and_clashing_columns(spark):
    units = spark.createDataFrame([(1, "smp20k", 50, 1), (2, None, None, None)], "recording_id int, unit string, num bigint, den bigint")
    values = spark.createDataFrame([(1, 2, 7, "a"), (1, None, 7, "b"), (2, 5, 7, "c"), (9, 5, 7, "d"), (None, 5, 7, "e")], "recording_id int, value bigint, num int, unit string")
    rows = to_microseconds(values, units).collect()
    assert sorted((r.recording_id or 0, r.num, r.unit, r.value_us) for r in rows if r.value_us is not None) == [(1, 7, "smp20k", 100.0)]
    assert len(rows) == 5
    assert to_microseconds(values.limit(0), units).collect() == []


def test_durations(spark):
    rows = spark.createDataFrame(
        [
            (1, 0, 4500, "150"), (2, 0, 4500, "150000"), (3, 0, 4500, "0.15"), (4, 4500, 0, "4500"), (5, 0, 9000, "300,000 us"), (6, None, 9000, "300.5"), (7, 0, 0, "0.75"), (8, 0, 4500, None), (9, 0, 4500, ""),
            (10, 0, 4500, "4500 samples"), (11, 0, 4500, "0 ms"),
        ],
        "unit int, `a b` bigint, e bigint, `the text` string",
    )
    # the clashing column is replaced, so rows are told apart by their text
    got = {(r["the text"], r.a): (r.unit, r.value_us) for r in durations_to_microseconds(rows, "the text", "a b", "e").withColumnRenamed("a b", "a").collect()}
    assert got[("150", 0)] == ("ms", 150000.0) and got[("150000", 0)] == ("us", 150000.0) and got[("0.15", 0)] == ("s", 150000.0)
    assert got[("4500", 4500)] == ("ticks", 150000.0) and got[("300,000 us", 0)] == ("us", 300000.0) and got[("300.5", None)] == ("ms", 300500.0)
    assert got[("0.75", 0)] == ("s", 750000.0) and got[("4500 samples", 0)] == ("ticks", 150000.0) and got[("0 ms", 0)] == ("ms", 0.0)
    assert got[(None, 0)] == (None, None) and got[("", 0)] == (None, None)
    assert durations_to_microseconds(rows.limit(0), "the text", "a b", "e").collect() == []
