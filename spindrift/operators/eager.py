"""Per-key results when a few keys hold most rows: eager aggregation through joins.

Both inputs are pre-aggregated by join key (and result key) on the map side, only the compact states are shuffled and joined,
counts are multiplied and sums combined algebraically, and the states are rolled up to the result keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


WHOLE = ("byte", "short", "integer", "long")


def eager_join_aggregate(left: DataFrame, right: DataFrame, on: str, keys: Sequence[str], left_sums: Sequence[str] = (), right_sums: Sequence[str] = (), how: str = "inner", right_once: Sequence[str] = ()) -> DataFrame:
    """(key_column, key_value, n_pairs, n_left, n_groups, sum_<c>..., once_<c>...): for each value of each of ``keys`` (columns of
    ``left``), what ``left JOIN right USING (on)`` aggregates to, without building the join.

    ``n_pairs`` counts joined pairs, ``n_left`` the left rows, ``n_groups`` the values of ``on`` they have, ``sum_<c>`` sums ``c`` over
    the pairs, and ``once_<c>`` sums the right ``c`` once for each of these values of ``on``. ``how`` is ``inner`` or ``left``; with
    ``left`` a left row without a partner makes one pair whose right sums are null.

    * A null key value is a group of its own; a null ``on`` joins nothing. Whole-number keys come out as bigint; if a key
      column is of another type, all come out as strings.
    * Sums skip nulls and are null where all values are; sums of whole numbers are decimals of 38 digits. Empty inputs give no rows.
    * Other columns may clash: only the named ones are read.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    kind = "bigint" if all(left.schema[c].dataType.typeName() in WHOLE for c in keys) else "string"
    k = [f"_k{i}" for i in range(len(keys))]
    ls, rs, once = ([f"_{side}{i}" for i in range(len(cols))] for side, cols in (("l", left_sums), ("r", right_sums), ("o", right_once)))
    add = lambda names: [F.sum(c).alias(c) for c in names]
    a = left.select(left[on].alias("j"), *(left[c].cast(kind).alias(x) for c, x in zip(keys, k, strict=True)), *(_summable(left, c).alias(x) for c, x in zip(left_sums, ls, strict=True)))
    a = a.groupBy("j", *k).agg(F.count(F.lit(1)).alias("n"), *add(ls))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("key_column"), F.col(x).alias("key_value")) for c, x in zip(keys, k, strict=True))))
    a = a.select("j", "n", *ls, each.alias("x")).select("j", "n", *ls, "x.*").groupBy("j", "key_column", "key_value").agg(F.sum("n").alias("n"), *add(ls))
    b = right.select(right[on].alias("j"), *(_summable(right, c).alias(x) for c, x in zip((*right_sums, *right_once), (*rs, *once), strict=True)))
    b = b.where("j IS NOT NULL").groupBy("j").agg(F.count(F.lit(1)).alias("m"), *add([*rs, *once]))
    m = F.coalesce("m", F.lit(1))
    return (
        a.join(b, "j", how)
        .select("key_column", "key_value", "n", (F.col("n") * m).alias("pairs"), *((F.col(c) * m).alias(c) for c in ls), *((F.col(c) * F.col("n")).alias(c) for c in rs), *once)
        .groupBy("key_column", "key_value")
        .agg(
            F.sum("pairs").alias("n_pairs"), F.sum("n").alias("n_left"), F.count(F.lit(1)).alias("n_groups"),
            *(F.sum(x).alias(f"sum_{c}") for c, x in zip((*left_sums, *right_sums), (*ls, *rs), strict=True)),
            *(F.sum(x).alias(f"once_{c}") for c, x in zip(right_once, once, strict=True)),
        )
    )


def _summable(df: DataFrame, name: str) -> Column:
    """The column, whole numbers as decimals, so that sums times counts don't overflow."""
    whole = df.schema[name].dataType.typeName() in WHOLE
    return df[name].cast("decimal(20,0)") if whole else df[name]


def shares(counts: DataFrame, count: str = "n_left") -> DataFrame:
    """``counts`` with ``n_total`` and ``share`` of all rows of its key column (null keys count in the total)."""
    totals = counts.groupBy("key_column").agg(F.sum(count).alias("n_total"))
    return counts.join(totals, "key_column").withColumn("share", F.col(count) / F.col("n_total"))


def interval_states(events: DataFrame, keys: Sequence[str], within: Sequence[str], time: str, block: int) -> DataFrame:
    """(*keys, n_events, n_trains, n_intervals, sum_interval, mean_interval, min_interval, max_interval, std_interval): the
    intervals between neighbouring events of a train (``keys`` + ``within``), rolled up to ``keys``.

    Events are grouped by train and block of ``block`` time units; a block's state is its first and last time, count, and the
    sum, sum of squares, minimum and maximum of its own intervals. States of a train are chained by the interval between one's
    last and the next one's first event. No task holds more than one block of a train, or one state per block.

    * Rows without a time or a key are left out; repeated times are intervals of 0; a train of one event has no interval.
    * ``std_interval`` is of the sample, null below two intervals.
    """
    cols = [*keys, *within]
    k = [f"_k{i}" for i in range(len(cols))]
    rows = events.select(*(events[c].alias(x) for c, x in zip(cols, k, strict=True)), events[time].cast("bigint").alias("t")).dropna()
    # equal times are one state with a multiplicity: they add intervals of 0 only
    times = rows.groupBy(*k, "t").agg(F.count(F.lit(1)).alias("c")).withColumn("b", F.expr(f"(t - pmod(t, {block}L)) div {block}L"))
    inside = W.partitionBy(*k, "b").orderBy("t")
    d = F.col("t") - F.lag("t").over(inside)
    states = (
        times.repartition(*k, "b")
        .withColumn("d", d.cast("double"))
        .groupBy(*k, "b")
        .agg(
            F.min("t").alias("first"), F.max("t").alias("last"), F.sum("c").alias("n"), (F.sum("c") - F.count(F.lit(1))).alias("zeros"),
            F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0)).alias("sq"), F.min("d").alias("lo"), F.max("d").alias("hi"),
        )
    )
    chain = W.partitionBy(*k).orderBy("b")
    states = states.withColumn("gap", (F.col("first") - F.lag("last").over(chain)).cast("double"))
    trains = states.groupBy(*k).agg(
        F.sum("n").alias("n"), (F.max("last") - F.min("first")).alias("total"),
        (F.sum("sq") + F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0.0))).alias("sq"),
        F.min(F.least(F.when(F.col("zeros") > 0, 0.0), "lo", "gap")).alias("lo"), F.max(F.greatest(F.when(F.col("zeros") > 0, 0.0), "hi", "gap")).alias("hi"),
    )
    n = F.sum(F.col("n") - 1)
    total = F.sum("total")
    mean: Column = F.try_divide(total.cast("double"), n)
    spread = F.try_divide(F.sum("sq") - mean * total, n - 1)
    return trains.groupBy(*k[: len(keys)]).agg(
        F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_trains"), n.alias("n_intervals"), total.alias("sum_interval"), mean.alias("mean_interval"),
        F.min("lo").cast("bigint").alias("min_interval"), F.max("hi").cast("bigint").alias("max_interval"), F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("std_interval"),
    ).withColumnsRenamed(dict(zip(k, keys)))
