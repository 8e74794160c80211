"""Orphan references against a plain loop, and their edge cases."""

import random
from datetime import datetime, timedelta

from spindrift.operators.orphans import Child, References

DAY0 = datetime(2024, 1, 1)


def day(n):
    return None if n is None else DAY0 + timedelta(days=n)


def brute(parents, rows):
    out = set()
    for i, key, at in rows:
        own = [(a, b) for k, a, b in parents if k == key and k is not None and a is not None]
        if key is None:
            continue
        if not own:
            out.add((i, "missing"))
        elif at is not None and not any(a <= at and (b is None or at < b) for a, b in own):
            out.add((i, "late" if all(a > at for a, _ in own) else "removed"))
    return out


def test_random_references(spark):
    rng = random.Random(3)
    parents = [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, *[rng.randrange(0, 40)] * 6]), rng.choice([None, rng.randrange(0, 60)])) for _ in range(14)]
    rows = [(i, rng.choice([1, 2, 3, 4, 5, None]), rng.choice([None, *[rng.randrange(-5, 70)] * 9])) for i in range(500)]
    p = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in parents], "e int, f timestamp, t timestamp")
    c = spark.createDataFrame([(i, None if k is None else float(k), day(a)) for i, k, a in rows], "id bigint, e double, at timestamp")
    got = {(r.row_id, r.kind) for r in References(p, "e", "f", "t").orphan_rows([Child("c", c, "id", "e", "at")]).collect()}
    assert got == brute(parents, rows)


def test_report_edges_and_clashing_columns(spark):
    p = spark.createDataFrame([(1, day(0), day(10)), (1, day(0), day(10)), (2, day(30), None)], "e int, f timestamp, t timestamp")
    schema = "id bigint, e double, at timestamp, k string, epoch string, kind string, table_name string, borders string"
    rows = [(1, 1.0, day(5)), (2, 1.0, day(10)), (3, 2.0, day(5)), (4, 7.0, day(5)), (5, 7.0, day(40)), (6, None, day(5)), (7, 1.5, day(5)), (8, 1.0, None), (9, 7.0, None), (10, 1.0, day(0))]
    c = Child("c", spark.createDataFrame([(*r, *"abcde") for r in rows], schema), "id", "e", "at")
    refs = References(p, "e", "f", "t")
    assert {(r.row_id, r.kind) for r in refs.orphan_rows([c]).collect()} == {(2, "removed"), (3, "late"), (4, "missing"), (5, "missing"), (7, "missing"), (9, "missing")}
    report = {(r.table_name, r.period and r.period.month, r.kind): (r.n_rows, r.n_keys) for r in refs.report([c]).collect()}
    assert report == {("c", 1, "removed"): (1, 1), ("c", 1, "late"): (1, 1), ("c", 1, "missing"): (2, 2), ("c", 2, "missing"): (1, 1), ("c", None, "missing"): (1, 1)}


def test_empty_tables(spark):
    p = spark.createDataFrame([], "e int, f timestamp, t timestamp")
    c = spark.createDataFrame([(1, 3.0, day(1))], "id bigint, e double, at timestamp")
    assert [tuple(r) for r in References(p, "e", "f", "t").orphan_rows([Child("c", c, "id", "e", "at")]).collect()] == [("c", 1, "missing")]
    full = spark.createDataFrame([(3, day(0), None)], "e int, f timestamp, t timestamp")
    assert References(full, "e", "f", "t").orphan_rows([Child("c", c.limit(0), "id", "e", "at")]).collect() == []


def test_keys_of_any_type(spark):
    def found(parent_keys, parent_type, child_keys, child_type, id_type="bigint"):
        p = spark.createDataFrame([(k, day(0)) for k in parent_keys], "e string, f timestamp").selectExpr(f"CAST(e AS {parent_type}) AS e", "f", "CAST(NULL AS timestamp) AS t")
        c = spark.createDataFrame([(i, k, day(1)) for i, k in enumerate(child_keys)], "id bigint, e string, at timestamp").selectExpr(f"CAST(id AS {id_type}) AS id", f"CAST(e AS {child_type}) AS e", "at")
        return {r.row_id for r in References(p, "e", "f", "t").orphan_rows([Child("c", c, "id", "e", "at")]).collect()}

    assert found(["a", "B", None], "string", ["a", "b", "B", "", None, " a"], "string") == {1, 3, 5}
    assert found(["05"], "string", ["5", "05"], "string") == {0}
    assert found(["5", "6"], "int", ["5", "05", " 6", "7", "x", "5.5", None], "string") == {3, 4, 5}
    assert found(["5", "x", "2.50"], "string", ["5", "6", "2.5"], "double") == {1}
    assert found(["5"], "int", ["5", "5.5", "NaN", None, "-5"], "double") == {1, 4}
    assert found(["5.5", "0"], "double", ["5.5", "5", "-0.0"], "float") == {1}
    assert found(["5.50", "7"], "decimal(9,2)", ["5.5", "7", "7.125"], "decimal(12,3)") == {2}
    assert found(["5.50"], "decimal(9,2)", ["5", "6"], "bigint", "string") == {"0", "1"}
    assert found(["9007199254740993"], "bigint", ["9007199254740992", "9007199254740993"], "bigint") == {0}
