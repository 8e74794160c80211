"""Sessions and interval states against plain loops."""

import random
import statistics

import pytest

from spindrift.operators.eager import eager_join_aggregate, interval_states, shares
from spindrift.operators.sessions import sessions


def brute(rows, gap, distinct):
    trains = {}
    for key, t in rows:
        if key is not None and t is not None:
            trains.setdefault(key, []).append(t)
    out = []
    for key, times in trains.items():
        times = sorted(set(times)) if distinct else sorted(times)
        run = [times[0]]
        for t in times[1:]:
            if t - run[-1] > gap:
                out.append((key, run[0], run[-1], run[-1] - run[0], len(run)))
                run = []
            run.append(t)
        out.append((key, run[0], run[-1], run[-1] - run[0], len(run)))
    return sorted(out)


@pytest.mark.parametrize(("gap", "blocks", "distinct"), [(1, 1, True), (3, 1, False), (10, 2, True), (10, 1, False), (7, 1024, True)])
def test_random_trains(spark, gap, blocks, distinct):
    rng = random.Random(gap * 31 + blocks)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *[rng.randrange(-200, 400)] * 9])) for _ in range(600)]
    rows += [(9, t) for t in range(0, 200, gap)]  # one session over many blocks
    df = spark.createDataFrame(rows, "k int, time bigint")
    got = sorted(tuple(r) for r in sessions(df, ["k"], "time", gap, distinct_times=distinct, block_gaps=blocks).collect())
    assert got == brute(rows, gap, distinct)


def test_gap_exactly_met_and_exceeded(spark):
    df = spark.createDataFrame([(1, 0), (1, 10), (1, 21)], "k int, time bigint")
    got = sorted(tuple(r) for r in sessions(df, ["k"], "time", 10).collect())
    assert got == [(1, 0, 10, 10, 2), (1, 21, 21, 0, 1)]


def test_empty_nulls_and_clashing_columns(spark):
    schema = "k int, time bigint, t string, n string, b string, pos string, kind string, _k0 string"
    assert sessions(spark.createDataFrame([], schema), ["k"], "time", 5).collect() == []
    df = spark.createDataFrame([(1, 4, *"xxxxxx"), (None, 4, *"xxxxxx"), (1, None, *"xxxxxx")], schema)
    assert [tuple(r) for r in sessions(df, ["k"], "time", 5).collect()] == [(1, 4, 4, 0, 1)]
    with pytest.raises(ValueError):
        sessions(df, ["k"], "time", 0)


def test_interval_states(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2, None]), rng.choice([7, 8]), rng.choice([None, *[rng.randrange(0, 3000)] * 9])) for _ in range(400)] + [(5, 7, 3)]
    got = {r.unit: r for r in interval_states(spark.createDataFrame(rows, "unit int, rec int, time bigint"), ["unit"], ["rec"], "time", 100).collect()}
    for unit in {r[0] for r in rows if r[0] is not None}:
        gaps, n, trains = [], 0, 0
        for rec in (7, 8):
            times = sorted(r[2] for r in rows if r[0] == unit and r[1] == rec and r[2] is not None)
            n += len(times)
            trains += bool(times)
            gaps += [b - a for a, b in zip(times, times[1:], strict=False)]
        r = got[unit]
        assert (r.n_events, r.n_trains, r.n_intervals, r.sum_interval) == (n, trains, len(gaps), sum(gaps))
        assert (r.min_interval, r.max_interval) == ((min(gaps), max(gaps)) if gaps else (None, None))
        if len(gaps) > 1:
            assert r.std_interval == pytest.approx(statistics.stdev(gaps))
    empty = spark.createDataFrame([], "unit int, rec int, time bigint")
    assert interval_states(empty, ["unit"], ["rec"], "time", 100).collect() == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_eager_join_equals_the_join(spark, how):
    rng = random.Random(2)
    left = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([4, 4, 5, None]), rng.choice([6, 7]), rng.choice([None, 10, 20])) for _ in range(200)]
    right = [(rng.choice([1, 2, 9, None]), rng.choice([None, 100, 200])) for _ in range(30)]
    a = spark.createDataFrame(left, "j int, u int, e int, x bigint")
    b = spark.createDataFrame(right, "j int, y bigint")
    got = {(r.key_column, r.key_value): (r.n_pairs, r.n_left, r.sum_x, r.sum_y) for r in eager_join_aggregate(a, b, "j", ["u", "e"], ["x"], ["y"], how).collect()}
    want = {}
    for j, u, e, x in left:
        partners = [y for k, y in right if k == j and j is not None]
        if how == "left" and not partners:
            partners = [None]
        for name, key in (("u", u), ("e", e)):
            if partners:
                w = want.setdefault((name, key), [0, 0, None, None])
                w[0] += len(partners)
                w[1] += 1
                for y in partners:
                    w[2] = w[2] if x is None else (w[2] or 0) + x
                    w[3] = w[3] if y is None else (w[3] or 0) + y
    assert got == {k: tuple(v) for k, v in want.items()}


def test_shares(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, None)], "j int, u int")
    b = spark.createDataFrame([], "j int, y bigint")
    got = {r.key_value: (r.n_total, r.share) for r in shares(eager_join_aggregate(a, b, "j", ["u"], how="left")).collect()}
    assert got == {1: (4, 0.5), 2: (4, 0.25), None: (4, 0.25)}
    assert shares(eager_join_aggregate(a, b, "j", ["u"])).collect() == []


def test_sums_once_for_each_join_key_and_keys_of_any_type(spark):
    a = spark.createDataFrame([(1, "u", 7), (1, "u", 7), (2, "u", None), (2, "v", 7), (3, "v", 7), (None, "u", 7)], "j int, u string, e int")
    b = spark.createDataFrame([(1, 10.0), (2, 5.0), (None, 1.0)], "j int, s double")
    got = {(r.key_column, r.key_value): (r.n_left, r.n_groups, r.once_s) for r in eager_join_aggregate(a, b, "j", ["u", "e"], right_once=["s"]).collect()}
    assert got == {("u", "u"): (3, 2, 15.0), ("u", "v"): (1, 1, 5.0), ("e", "7"): (3, 2, 15.0), ("e", None): (1, 1, 5.0)}
