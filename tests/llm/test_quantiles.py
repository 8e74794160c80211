"""Percentiles from collapsing buffers: exact for small groups, within the bound for large ones, mergeable."""

import math
import random

import numpy as np
import pytest

from spindrift.llm import quantiles as Q


def rank_error(values, q, got):
    s, r = np.sort(values), max(1, math.ceil(q * len(values)))
    lo, hi = np.searchsorted(s, got, "left") + 1, np.searchsorted(s, got, "right")
    return max(0, lo - r, r - hi)


@pytest.mark.parametrize(("n", "size", "fan_in", "kind"), [(50_000, 64, 16, "random"), (30_000, 16, 4, "sorted"), (30_000, 16, 3, "ties"), (100, 128, 16, "random"), (128, 128, 16, "random"), (4096, 16, 16, "reversed")])
def test_reduce_group_keeps_its_bound(n, size, fan_in, kind):
    rng = np.random.default_rng(n)
    values = {"random": rng.integers(0, 10**9, n), "sorted": np.arange(n), "reversed": np.arange(n)[::-1].copy(), "ties": rng.integers(0, 50, n)}[kind]
    out = []
    for i in range(0, n, 777):
        out = Q.reduce_group([*out, (0, 0, np.sort(values[i : i + 777]))], size, fan_in)
    weight = np.concatenate([np.full(len(b), int(Q.weights(level, fan_in))) for level, _, b in out])
    held = np.concatenate([b for _, _, b in out])
    assert weight.sum() == n
    per_level = [sum(1 for level, _, b in out if level == lv and len(b) == size) for lv in {level for level, _, _ in out}]
    assert max(per_level) < fan_in
    order = np.argsort(held, kind="stable")
    cum, bound = np.cumsum(weight[order]), sum(e for _, e, _ in out)
    for q in np.linspace(0.001, 1, 99):
        got = held[order][np.searchsorted(cum, max(1, math.ceil(q * n)))]
        assert rank_error(values, q, got) <= bound
    assert bound == 0 if n < 2 * size else bound <= n * (2 + math.log(n / size, fan_in)) / (2 * size) * fan_in / (fan_in - 1) + fan_in


def test_small_groups_are_exact(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *[rng.randrange(-50, 50)] * 8]), "x") for _ in range(500)] + [("one", 7, "x")]
    df = spark.createDataFrame(rows, "k string, v bigint, level string").repartition(5)
    got = {r.k: r for r in Q.percentiles(df, ["k"], "v", {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p100": 1.0}).collect()}
    for k in ("a", "b", "one"):
        s = sorted(r[1] for r in rows if r[0] == k and r[1] is not None)
        at = lambda q: s[max(1, math.ceil(q * len(s))) - 1]  # noqa: B023, E731
        assert tuple(got[k]) == (k, len(s), 0, at(0), at(0.05), at(0.5), at(1))
    assert set(got) == {"a", "b", "one"}
    assert Q.percentiles(df.limit(0), ["k"], "v", {"p50": 0.5}).collect() == []
    assert Q.percentiles(df.where("v IS NULL"), ["k"], "v", {"p50": 0.5}).collect() == []
    with pytest.raises(ValueError):
        Q.percentiles(df, ["k"], "v", {"p": 1.5})


def test_a_hot_group_and_merging_of_days(spark):
    n = 200_000
    df = spark.range(n).selectExpr("IF(id % 3 = 0, id % 1000, 7) AS k", "(id * 7919) % 200003 AS v", "id % 5 AS day").repartition(6)
    qs = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    whole = {r.k: r for r in Q.percentiles(df, ["k"], "v", qs).collect()}
    days = Q.merge(Q.summarise(df, ["k", "day"], "v"), ["k", "day"])
    merged = {r.k: r for r in Q.read_percentiles(Q.merge(days, ["k"]), ["k"], qs).collect()}
    hot = np.array([(i * 7919) % 200003 for i in range(n) if i % 3 or i % 1000 == 7])
    for got in (whole[7], merged[7]):
        assert got.n == len(hot) and 0 < got.rank_error < 0.01 * len(hot)
        for name, q in qs.items():
            assert rank_error(hot, q, got[name]) <= got.rank_error
    for k in (0, 999):
        own = np.sort([(i * 7919) % 200003 for i in range(k, n, 1000) if i % 3 == 0])
        assert whole[k].rank_error == 0 and (whole[k].n, whole[k].p50) == (len(own), own[math.ceil(0.5 * len(own)) - 1])


def test_doubles_and_decimals(spark):
    rng = random.Random(9)
    rows = [(i % 3, rng.random() * 10 - 5, f"{rng.randrange(-9999, 9999) / 100:.2f}") for i in range(3000)] + [(0, float("nan"), None), (0, None, None)]
    df = spark.createDataFrame(rows, "k int, x double, s string").selectExpr("k", "x", "CAST(s AS decimal(6,2)) AS d", "CAST(s AS decimal(30,2)) AS wide", "CAST(x AS float) AS f").repartition(4)
    for name, kind in (("x", "double"), ("d", "decimal(6,2)"), ("wide", "decimal(30,2)"), ("f", "float")):
        found = Q.percentiles(df, ["k"], name, {"p0": 0.0, "p50": 0.5, "p90": 0.9})
        assert found.schema["p50"].dataType.simpleString() == kind
        checked = Q.rank_bounds(df, found, ["k"], name, {"p0": 0.0, "p50": 0.5, "p90": 0.9}).collect()
        assert len(checked) == 9 and all(r.off <= r.rank_error for r in checked) and any(r.rank_error for r in checked)
    small = spark.createDataFrame([(0.25,), (0.75,), (0.5,), (float("nan"),)], "x double").selectExpr("1 AS k", "x")
    r = Q.percentiles(small, ["k"], "x", {"p50": 0.5, "p75": 0.75, "p100": 1.0}).first()
    assert (r.p50, r.p75) == (0.5, 0.75) and math.isnan(r.p100)


def test_groups_that_collapse_stay_within_one_percent(spark):
    df = spark.range(60_000).selectExpr("pmod(hash(id), 20) AS k", "pmod(xxhash64(id), 1000000) AS v").repartition(12)
    found = Q.percentiles(df, ["k"], "v", {"p05": 0.05, "p95": 0.95})
    rows = Q.rank_bounds(df, found, ["k"], "v", {"p05": 0.05, "p95": 0.95}).collect()
    assert len(rows) == 40 and all(r.off <= r.rank_error and 0 < r.rank_error <= 0.01 * r.n for r in rows)
