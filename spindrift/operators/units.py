"""Quantities recorded in different units, brought to whole or fractional microseconds.

The unit of a recording's column is read from its entry, else from the recording's note, by the automaton of
``functions.time_units``; where neither tells, from the largest value against the recording's length. Amounts kept as text
are read by the same automaton; what the text leaves open is settled by the row's own start and end. Conversion factors are
then joined to the values, broadcast while they are few.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import time_units as U
from spindrift.functions.scale import bounded_broadcast, written


@lru_cache(maxsize=100_000)
def _read(text: str) -> U.Reading | None:
    return U.read_amount(text)



def _entry_unit(entry: pd.Series) -> pd.Series:
    known = {e: U.unit_of_entry(e) for e in entry.dropna().unique()}
    return entry.map(known).astype(object).where(entry.notna(), None)


def _note_unit(field: str):
    def unit(note: pd.Series) -> pd.Series:
        return pd.Series([U.unit_of_field(n, field) if isinstance(n, str) else None for n in note], dtype=object)

    return unit


def _amount(text: pd.Series) -> pd.DataFrame:
    read = [_read(t) if isinstance(t, str) else None for t in text]
    return pd.DataFrame({"numbers": [list(r.values) if r else [] for r in read], "unit": pd.Series([r.unit if r else None for r in read], dtype=object)})


def _factor(unit: Column, part: int) -> Column:
    out = F.lit(None).cast("bigint")
    for name, ratio in U.MICROSECONDS.items():
        out = F.when(unit == name, F.lit(ratio[part]).cast("bigint")).otherwise(out)
    return out


def recording_units(recordings: DataFrame, entry: str, field: str, values: DataFrame) -> DataFrame:
    """(recording_id, unit, num, den): the unit of ``field`` in each recording and its factor to microseconds, ``num / den``.

    ``recordings`` has recording_id, duration_s, note and the column ``entry``; ``values`` (recording_id, value) is only read for
    recordings whose text tells nothing, which take the unit whose clock comes nearest to largest value / duration_s.

    * A recording without any hint (no values, or no duration) has a null unit. A null recording_id is left out.
    * A repeated recording_id keeps one row, the one whose unit is known (then the smallest unit name).
    """
    entry_unit, note_unit = F.pandas_udf(_entry_unit, "string"), F.pandas_udf(_note_unit(field), "string")
    told = recordings.where("recording_id IS NOT NULL").select(
        "recording_id", "duration_s", F.coalesce(entry_unit(F.col(entry)), note_unit(F.col("note"))).alias("unit")
    ).groupBy("recording_id").agg(F.max("duration_s").alias("duration_s"), F.min("unit").alias("unit"))
    told = written(told, "units-told")
    open_ = bounded_broadcast(told.where("unit IS NULL").select("recording_id", "duration_s"))
    largest = values.join(open_, "recording_id").groupBy("recording_id").agg(F.max(F.abs("value")).alias("top"), F.max("duration_s").alias("duration_s"))
    rate = F.when((F.col("duration_s") > 0) & (F.col("top") > 0), F.col("top") / F.col("duration_s"))
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.log(rate / per)).alias("far"), F.lit(unit).alias("unit")) for unit, per in sorted(U.PER_SECOND.items()) if unit != "s")))
    guessed = largest.select("recording_id", F.when(rate.isNotNull(), nearest["unit"]).alias("guess"))
    unit = F.coalesce("unit", "guess")
    out = told.join(guessed, "recording_id", "left").select("recording_id", unit.alias("unit"), _factor(unit, 0).alias("num"), _factor(unit, 1).alias("den"))
    return written(out, "units")  # a row a recording; the values aren't read again to count it or to join it


def to_microseconds(values: DataFrame, units: DataFrame) -> DataFrame:
    """``values`` (with recording_id and value) plus unit and ``value_us`` (double): the factors of ``recording_units`` joined.

    * A null value, or a recording that is unknown or has no known unit, gives a null ``value_us``; no row is lost.
    * Columns of ``values`` named unit or value_us are replaced; all others are kept.
    """
    factors = bounded_broadcast(units).select(F.col("recording_id").alias("_rid"), F.struct("unit", "num", "den").alias("_factor"))
    joined = values.join(factors, values["recording_id"] == F.col("_rid"), "left")
    us = F.col("value").cast("double") * F.col("_factor.num") / F.col("_factor.den")
    return joined.withColumns({"unit": F.col("_factor.unit"), "value_us": us}).drop("_rid", "_factor")


def durations_to_microseconds(rows: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """``rows`` plus unit and ``value_us`` (double) of the amounts in the text column ``text``.

    ``start`` and ``end`` are in 30 kHz ticks. An amount without a unit (or in bare samples) takes the unit, and a comma that may
    divide thousands or decimals the reading, that comes nearest to the span between them. A row without a span is compared with
    the median span of all rows.

    * Null, empty or numberless texts give null unit and value. Swapped ends count by their distance; a span of 0 is no span.
    * Columns of ``rows`` named unit or value_us are replaced; all others are kept.
    """
    spans = F.abs(F.col(f"`{end}`").cast("double") - F.col(f"`{start}`").cast("double")) * 100 / 3
    typical = rows.select(spans.alias("s")).where("s > 0").agg(F.percentile_approx("s", 0.5)).first()[0] or 300_000.0
    span = F.when(spans > 0, spans).otherwise(F.lit(typical))
    factor = {unit: num / den for unit, (num, den) in U.MICROSECONDS.items()}
    bare = F.array(*(F.struct(F.lit(u).alias("unit"), F.lit(factor[u]).alias("factor")) for u in ("ticks", "ms", "us", "s")))
    told = F.array(F.struct(F.col("_amount.unit").alias("unit"), (_factor(F.col("_amount.unit"), 0) / _factor(F.col("_amount.unit"), 1)).alias("factor")))
    options = F.when(F.col("_amount.unit").isNull(), bare).otherwise(told)
    # nearest first; of equally near ones the earlier unit and reading
    far = lambda us: F.when((us > 0), F.abs(F.log(F.when(us > 0, us).otherwise(1.0) / span))).otherwise(F.lit(1e9))
    scored = F.flatten(F.transform("_amount.numbers", lambda v, i: F.transform(options, lambda o, j: F.struct(far(v * o["factor"]).alias("far"), i.alias("i"), j.alias("j"), (v * o["factor"]).alias("us"), o["unit"].alias("unit")))))
    best = F.array_min(scored)
    amount = F.pandas_udf(_amount, "numbers array<double>, unit string")
    return rows.withColumn("_amount", amount(F.col(f"`{text}`").cast("string"))).withColumn("_best", best).withColumns({"unit": F.col("_best.unit"), "value_us": F.col("_best.us")}).drop("_amount", "_best")
