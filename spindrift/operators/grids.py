"""Bins, histograms, smoothing, integration and correlation over dense grids."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def n_bins(before: float, after: float, width: float) -> int:
    """How many bins the edges -before, -before + width, ... make up to the first at or beyond ``after``."""
    return math.ceil((before + after) / width)


def bin_of(rel: Column, before: float, after: float, width: float) -> Column:
    """Bin of a relative time in [-before, after]: half-open bins, the last closed where its edge is ``after``."""
    return F.least(F.floor((rel + before) / width), F.lit(n_bins(before, after, width) - 1)).cast("int")


def dense(keys: DataFrame, n: int, name: str = "bin") -> DataFrame:
    """``keys`` x 0..n-1 as column ``name``; n is a parameter, so rows grow with the keys only."""
    return keys.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def histogram(rows: DataFrame, value: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """(*by, bin, low, high, count): ``n`` equal bins from the least to the greatest value of each group, the last closed.

    * Nulls are left out; empty bins count 0; a group with a single value has it in bins from value - 0.5 to value + 0.5.
    """
    by = list(by)
    rows = rows.where(F.col(value).isNotNull())
    one = [F.lit(1).alias("_one")] if not by else []
    keys = by or ["_one"]
    rows = rows.select(*by, *one, F.col(value).cast("double").alias("_v"))
    # values are few compared with rows: pre-aggregate, then place
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    lo, hi = F.min("_v"), F.max("_v")
    span = counts.groupBy(*keys).agg(F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"), F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n
    place = F.least(F.floor((F.col("_v") - F.col("lo")) / width), F.lit(n - 1)).cast("int")
    binned = counts.join(span, keys).groupBy(*keys, place.alias("bin")).agg(F.sum("_c").alias("count"))
    return dense(span, n).join(binned, [*keys, "bin"], "left").select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def smoothed(series: Column, size: int) -> Column:
    """An array with each value replaced by the mean over a boxcar of ``size``, the edges reflected (d c b a | a b c d | d c b a).

    The window of value i is [i - size // 2, i + size - size // 2 - 1]. A size of 1 or less changes nothing.
    """
    if size <= 1:
        return series
    n = F.size(series)

    def fold(i: Column) -> Column:
        m = F.pmod(i, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)

    window = lambda i: F.transform(F.sequence(i - size // 2, i + size - size // 2 - 1), lambda j: F.get(series, fold(j)))
    mean = lambda x, i: F.aggregate(window(i), F.lit(0.0), lambda a, y: a + y) / size
    return F.transform(series, mean)


def smooth(rows: DataFrame, value: str, size: int, by: Sequence[str], index: str = "bin") -> DataFrame:
    """(*by, index, value) with ``value`` ``smoothed`` along ``index``, in which each series is dense from 0."""
    if size <= 1:
        return rows
    at = F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("v"))
    series = rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["v"]).alias("_a"))
    return series.select(*by, F.posexplode(smoothed(F.col("_a"), size)).alias(index, value))


def trapezoid(rows: DataFrame, x: str, y: str, by: Sequence[str], name: str) -> DataFrame:
    """(*by, name): the trapezoid integral of y over x within each group; 0 for one point."""
    w = W.partitionBy(*by).orderBy(x)
    area = (F.lead(x).over(w) - F.col(x)) * (F.lead(y).over(w) + F.col(y)) / 2
    return rows.select(*by, area.alias("_area")).groupBy(*by).agg(F.coalesce(F.sum("_area"), F.lit(0.0)).alias(name))


def pearson(rows: DataFrame, item: str, at: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, i, j, corr) for items i <= j: Pearson correlation of their values over ``at``, null where one is constant.

    Each (item, at) holds one value; items are few (channels, selected units), points may be many: pairs are formed point by
    point from one packed row a point, so the join is a hash aggregate on ``at`` and sums are combined before the shuffle.
    """
    by = list(by)
    packed = rows.where(F.col(value).isNotNull()).groupBy(*by, at).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("k"), F.col(value).cast("double").alias("v")))).alias("_p"))
    left = packed.select(*by, "_p", F.explode("_p").alias("a"))
    pairs = left.select(*by, "a", F.explode(F.filter("_p", lambda b: b["k"] >= F.col("a")["k"])).alias("b"))
    x, y = F.col("a.v"), F.col("b.v")
    sums = pairs.select(*by, F.col("a.k").alias("i"), F.col("b.k").alias("j"), x.alias("x"), y.alias("y")).groupBy(*by, "i", "j")
    cov = F.covar_pop("x", "y")
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    return sums.agg(F.when(spread > 1e-12, F.try_divide(cov, spread)).alias("corr"))


def pearson_wide(rows: DataFrame, values: str) -> DataFrame:
    """(i, j, corr) for positions i <= j of the arrays in column ``values``: Pearson correlation over the rows, null where one is constant.

    Arrays may differ in length; a null, or a position beyond an array's end, leaves the row out of its pairs only. Each batch
    adds its products of all pairs as one matrix product, and a task passes on the sums, a row a pair.
    """
    names = ["n", "x", "y", "xx", "yy", "xy"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            lists = batch.column(0)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.cast(pa.float64())
            lengths = np.diff(offsets)
            width = int(lengths.max(initial=0))
            v, there = np.zeros((len(lengths), width)), np.zeros((len(lengths), width))
            at = np.repeat(np.arange(len(lengths)), lengths), np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], lengths)
            held = flat.slice(offsets[0], offsets[-1] - offsets[0])
            there[at] = held.is_valid().to_numpy(zero_copy_only=False)
            v[at] = held.fill_null(0.0).to_numpy(zero_copy_only=False)
            sums = np.stack([there.T @ there, v.T @ there, there.T @ v, (v * v).T @ there, there.T @ (v * v), v.T @ v])
            if total is None or width > total.shape[1]:
                old, total = total, np.zeros((6, width, width))
                if old is not None:
                    total[:, : old.shape[1], : old.shape[1]] = old
            total[:, :width, :width] += sums
        if total is not None:
            i, j = np.triu_indices(total.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(s[i, j]) for s in total)], names=["i", "j", *names])

    parts = rows.select(values).where(F.col(values).isNotNull()).mapInArrow(task, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    s = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names)).where("n > 0")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.expr("xx / n - (x / n) * (x / n)"))) * F.sqrt(F.greatest(F.lit(0.0), F.expr("yy / n - (y / n) * (y / n)")))
    return s.withColumn("_s", spread).select("i", "j", F.when(F.col("_s") > 1e-12, F.try_divide(F.expr("xy / n - (x / n) * (y / n)"), F.col("_s"))).alias("corr"))
