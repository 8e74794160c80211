"""Comparison of Spark results with DuckDB's, by column name and value, in any order."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings spikes_time_adjusted pico semi_from_table_designer recordings electrode_cfg electrode_firing_rates test_items subject_areas doc_labels".split()


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def duck(folder: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    result = con.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


def compare(df, folder: str, sql: str) -> str:
    """Empty if equal, else what differs."""
    names, rows = duck(folder, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in rows)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.select(*(df[c] for c in order)).collect())
    if want != got:
        return f"{sum(got.values())} and {sum(want.values())} rows, {order}; only here {list((got - want).items())[:4]}; only there {list((want - got).items())[:4]}"
    return ""
