"""Spike trains (the spikes of ``keys`` in order of time): intervals, bursts, sliding rates, rhythm, correlograms and classes.

Times and widths are integers in the same unit. Trains may be of any length: where the order of a whole train matters, it is
cut into blocks of time, and only the blocks' borders are looked at together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.operators import packed as P
from spindrift.operators.spectra import hann

#: Time units of a block: a minute and a half of 30 kHz ticks.
BLOCK = 2_700_000


def _block(block: int):
    return F.expr(f"(time - pmod(time, {block}L)) div {block}L")


def intervals(spikes: DataFrame, keys: Sequence[str], row_id: str, block: int = BLOCK) -> DataFrame:
    """(*keys, row_id, time, isi): each spike with the time since the train's previous one, null for the first. Ties are in order
    of ``row_id`` and 0 apart. Rows without a time or a key are left out.
    """
    keys = list(keys)
    rows = spikes.select(*keys, row_id, "time").dropna().withColumn("_b", _block(block)).repartition(*keys, "_b")
    inside = W.partitionBy(*keys, "_b").orderBy("time", row_id)
    lasts = rows.groupBy(*keys, "_b").agg(F.max("time").alias("_last"))
    before = lasts.select(*keys, "_b", F.lag("_last").over(W.partitionBy(*keys).orderBy("_b")).alias("_before"))
    joined = rows.withColumn("_prev", F.lag("time").over(inside)).join(before, [*keys, "_b"])
    return joined.select(*keys, row_id, "time", (F.col("time") - F.coalesce("_prev", "_before")).alias("isi"))


def times(spikes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, time, n): the distinct times of each train and how many spikes they have. Rows without a time or a key are left out."""
    return spikes.select(*keys, "time").dropna().groupBy(*keys, "time").agg(F.count(F.lit(1)).alias("n"))


def timed(spikes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``times`` plus lo, hi and total: the first and last time and the number of spikes of the train."""
    rows = times(spikes, keys)
    return rows.join(rows.groupBy(*keys).agg(F.min("time").alias("lo"), F.max("time").alias("hi"), F.sum("n").alias("total")), list(keys))


def laid_out(spikes: DataFrame, keys: Sequence[str], max_isi: int, block: int = BLOCK) -> DataFrame:
    """``timed`` plus isi (the time since the train's previous one, null for the first), run_start (the first time of the run of
    intervals of at most ``max_isi`` it lies in) and idx (spikes of the train before it).

    One row a time is ordered within blocks; what goes on from block to block (last time, open run, number of spikes) is a state
    of the block, and only these states of a train are ordered together.
    """
    keys = list(keys)
    rows = times(spikes, keys).withColumn("_b", _block(block)).repartition(*keys, "_b")
    inside = W.partitionBy(*keys, "_b").orderBy("time")
    d = F.col("time") - F.lag("time").over(inside)
    breaks = F.when(F.col("_d") > max_isi, F.col("time"))
    rows = rows.withColumn("_d", d).withColumns({
        "_run": F.max(breaks).over(inside.rowsBetween(W.unboundedPreceding, 0)),
        "_n": F.coalesce(F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    })
    states = rows.groupBy(*keys, "_b").agg(F.min("time").alias("_first"), F.max("time").alias("_last"), F.sum("n").alias("_sum"), F.max("_run").alias("_break"))
    chain, whole = W.partitionBy(*keys).orderBy("_b"), W.partitionBy(*keys)
    earlier = chain.rowsBetween(W.unboundedPreceding, -1)
    states = states.withColumn("_before", F.lag("_last").over(chain))
    begins = F.when(F.col("_before").isNull() | (F.col("_first") - F.col("_before") > max_isi), F.col("_first"))
    states = states.withColumn("_begins", begins).withColumn("_open", F.coalesce("_break", "_begins"))
    borders = states.select(
        *keys, "_b", "_before", F.coalesce("_begins", F.max("_open").over(earlier)).alias("_goes_on"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_idx"),
        F.min("_first").over(whole).alias("lo"), F.max("_last").over(whole).alias("hi"), F.sum("_sum").over(whole).alias("total"),
    )
    isi = F.coalesce("_d", F.col("time") - F.col("_before"))
    return rows.join(borders, [*keys, "_b"]).select(*keys, "time", "n", "lo", "hi", "total", isi.alias("isi"), F.coalesce("_run", "_goes_on").alias("run_start"), (F.col("_n") + F.col("_idx")).alias("idx"))


def interval_stats(spikes: DataFrame, keys: Sequence[str], row_id: str | None = None, block: int = BLOCK) -> DataFrame:
    """(*keys, n_spikes, mean_isi, std_isi, cv_isi, median_isi, p25_isi, p75_isi): population standard deviation, linear
    interpolation between ranks; all null but the count for a train of one spike, cv null at a mean of 0."""
    return _interval_stats(laid_out(spikes, keys, 0, block), keys).drop("lo", "hi")


def _interval_stats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``interval_stats`` plus lo and hi from ``laid_out`` trains: the mean is known beforehand, repeated times are intervals of 0."""
    mean = F.try_divide((F.col("hi") - F.col("lo")).cast("double"), F.col("total") - 1)
    each = F.filter(F.array(F.struct(F.col("isi").alias("d"), F.lit(1).cast("bigint").alias("f")), F.struct(F.lit(0).cast("bigint").alias("d"), (F.col("n") - 1).alias("f"))), lambda x: x["d"].isNotNull() & (x["f"] > 0))
    weighed = rows.select(*keys, "lo", "hi", "total", F.explode_outer(each).alias("x")).select(*keys, "lo", "hi", "total", "x.*")
    q = F.percentile("d", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.coalesce("f", F.lit(0).cast("bigint")))
    squares = F.sum(F.col("f") * (F.col("d") - mean) * (F.col("d") - mean))
    out = weighed.groupBy(*keys).agg(F.max("total").alias("n_spikes"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max(mean).alias("mean_isi"), squares.alias("_sq"), q.alias("_q"))
    out = out.withColumn("std_isi", F.sqrt(F.try_divide("_sq", F.col("n_spikes") - 1)))
    cv = F.when(F.col("mean_isi") > 0, F.col("std_isi") / F.col("mean_isi"))
    return out.select(*keys, "n_spikes", "lo", "hi", "mean_isi", "std_isi", cv.alias("cv_isi"), F.col("_q")[1].alias("median_isi"), F.col("_q")[0].alias("p25_isi"), F.col("_q")[2].alias("p75_isi"))


def bursts(spikes: DataFrame, keys: Sequence[str], max_isi: int, min_spikes: int = 3, block: int = BLOCK) -> DataFrame:
    """(*keys, start_time, end_time, duration, spike_count, start_idx, end_idx): runs of at least ``min_spikes`` spikes no more than
    ``max_isi`` apart; indices count from 0 in the train."""
    return _bursts(laid_out(spikes, keys, max_isi, block), keys, min_spikes)


def _bursts(rows: DataFrame, keys: Sequence[str], min_spikes: int) -> DataFrame:
    runs = rows.groupBy(*keys, "run_start").agg(F.max("time").alias("end_time"), F.sum("n").alias("spike_count"), F.min("idx").alias("start_idx"))
    end = F.col("start_idx") + F.col("spike_count") - 1
    return runs.where(F.col("spike_count") >= min_spikes).select(*keys, F.col("run_start").alias("start_time"), "end_time", (F.col("end_time") - F.col("run_start")).alias("duration"), "spike_count", "start_idx", end.alias("end_idx"))


def burst_stats(spikes: DataFrame, keys: Sequence[str], max_isi: int, min_spikes: int = 3) -> DataFrame:
    """(*keys, n_spikes, n_bursts, burst_spikes, burst_ratio, mean_duration, mean_spikes): the ratio is bursts per spike; the means
    are null for a train without bursts."""
    return _burst_stats(laid_out(spikes, keys, max_isi), keys, min_spikes)


def _burst_stats(rows: DataFrame, keys: Sequence[str], min_spikes: int) -> DataFrame:
    runs = rows.groupBy(*keys, "run_start").agg((F.max("time") - F.min("time")).alias("d"), F.sum("n").alias("n"))
    long = F.col("n") >= min_spikes
    out = runs.groupBy(*keys).agg(
        F.sum("n").alias("n_spikes"), F.count_if(long).alias("n_bursts"), F.coalesce(F.sum(F.when(long, F.col("n"))), F.lit(0)).alias("burst_spikes"),
        F.avg(F.when(long, F.col("d"))).alias("mean_duration"), F.avg(F.when(long, F.col("n"))).alias("mean_spikes"),
    )
    return out.select(*keys, "n_spikes", "n_bursts", "burst_spikes", (F.col("n_bursts") / F.col("n_spikes")).alias("burst_ratio"), "mean_duration", "mean_spikes")


def sliding_rate(spikes: DataFrame, keys: Sequence[str], width: int, step: int, per_second: float) -> DataFrame:
    """(*keys, k, time, n, rate): on the grid first, first + step, ... below the last spike, the spikes in [t - width/2, t + width/2]
    and their number per second. A train whose spikes share one time has no grid.

    A spike is counted where it is heard, at the at most width / step + 1 grid points around it: no order, no wide frame.
    """
    keys = list(keys)
    rows = timed(spikes, keys)
    heard = _heard(rows, keys, width, step).select(*keys, "k", F.col("n").alias("_n"))
    span = rows.where("hi > lo").groupBy(*keys).agg(F.max("lo").alias("lo"), F.max(_last(step)).alias("last"))
    grid = span.select(*keys, "lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("k"))
    n = F.coalesce("_n", F.lit(0))
    return grid.join(heard, [*keys, "k"], "left").select(*keys, "k", (F.col("lo") + F.col("k") * step).alias("time"), n.alias("n"), (n * float(per_second) / float(width)).alias("rate"))


def _last(step: int):
    """The last grid point of a ``timed`` train, -1 where there is none."""
    return F.ceil((F.col("hi") - F.col("lo")) / step) - 1


def _heard(rows: DataFrame, keys: list[str], width: int, step: int) -> DataFrame:
    """(*keys, k, n, last): the grid points at which spikes of ``timed`` trains are heard, and the train's last point."""
    half, rel, last = width / 2, F.col("time") - F.col("lo"), _last(step)
    points = F.sequence(F.greatest(F.ceil((rel - half) / step), F.lit(0)), F.least(F.floor((rel + half) / step), F.col("last")))
    near = rows.withColumn("last", last).where(F.greatest(F.ceil((rel - half) / step), F.lit(0)) <= F.least(F.floor((rel + half) / step), F.col("last")))
    return near.select(*keys, "n", "last", F.explode(points).alias("k")).groupBy(*keys, "k").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def sliding_rate_stats(spikes: DataFrame, keys: Sequence[str], width: int, step: int, per_second: float) -> DataFrame:
    """``sliding_stats`` of ``sliding_rate`` over the whole grid, without laying out the points at which nothing is heard."""
    return _rate_stats(timed(spikes, keys), list(keys), width, step, per_second)


def _rate_stats(rows: DataFrame, keys: list[str], width: int, step: int, per_second: float) -> DataFrame:
    found = _heard(rows, keys, width, step).groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("heard"), F.min("n").alias("least"), F.max("n").alias("most"), (F.max("last") + 1).alias("points"))
    least = F.when(F.col("heard") < F.col("points"), F.lit(0)).otherwise(F.col("least"))
    rate = lambda n: n * float(per_second) / float(width)
    return found.select(*keys, (F.col("n") * float(per_second) / (F.col("points") * float(width))).alias("mean_rate"), rate(F.col("most")).alias("max_rate"), rate(least).alias("min_rate"))


def sliding_stats(rates: DataFrame, keys: Sequence[str], width: int, per_second: float) -> DataFrame:
    """(*keys, mean_rate, max_rate, min_rate) of ``sliding_rate``; the mean comes from the whole counts."""
    mean = F.sum("n") * float(per_second) / (F.count(F.lit(1)) * float(width))
    return rates.groupBy(*keys).agg(mean.alias("mean_rate"), F.max("rate").alias("max_rate"), F.min("rate").alias("min_rate"))


def binned(spikes: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """(*keys, bin, n_bins): the distinct bins of a train from its first spike on; the partial bin at its end, and with it the last
    spike, is left out."""
    keys = list(keys)
    rows = spikes.where("time IS NOT NULL").groupBy(*keys, "time").agg(F.lit(1))
    span = rows.groupBy(*keys).agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    joined = rows.join(span, keys).select(*keys, F.expr(f"(time - lo) div {width}L").alias("bin"), F.expr(f"(hi - lo) div {width}L").alias("n_bins"))
    return joined.where("bin < n_bins").distinct()


def lag_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], low: int, high: int) -> DataFrame:
    """(*keys, lag, n): pairs of a bin of ``a`` and one of ``b`` with low <= a.bin - b.bin <= high, within the same keys.

    Bins go into buckets as wide as the range of lags, a's into one and b's into the two that can hold partners.
    """
    width = high - low + 1
    bucket = lambda c: F.expr(f"({c} - pmod({c}, {width}L)) div {width}L")
    left = a.select(*keys, F.col("bin").alias("x")).withColumn("_b", bucket("x"))
    reach = F.array_distinct(F.array(bucket(f"(y + {low}L)"), bucket(f"(y + {high}L)")))
    right = b.select(*keys, F.col("bin").alias("y")).withColumn("_b", F.explode(reach))
    lag = F.col("x") - F.col("y")
    return left.join(right, [*keys, "_b"]).where(lag.between(low, high)).groupBy(*keys, lag.alias("lag")).agg(F.count(F.lit(1)).alias("n"))


def autocorrelogram(spikes: DataFrame, keys: Sequence[str], width: int, lags: int, least: int = 10, roll_up: Sequence[str] | None = None) -> DataFrame:
    """(*roll_up, lag, value): coincidences of a train's bins ``lag`` bins apart over those at lag 0, lags 0..lags-1, dense.

    Trains of fewer than ``least`` spikes are left out; ``roll_up`` (default: keys) sums the coincidences of several trains.
    """
    keys, to = list(keys), list(roll_up if roll_up is not None else keys)
    enough = spikes.where("time IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    bins = binned(spikes.join(enough, keys, "left_semi"), keys, width)
    counts = lag_counts(bins, bins, keys, 0, lags - 1).groupBy(*to, "lag").agg(F.sum("n").alias("n"))
    zero = counts.where("lag = 0").select(*to, F.col("n").alias("n0"))
    grid = zero.withColumn("lag", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lags - 1).cast("bigint"))))
    return grid.join(counts, [*to, "lag"], "left").select(*to, "lag", (F.coalesce("n", F.lit(0)) / F.col("n0")).alias("value"))


def cross_correlogram(spikes: DataFrame, by: Sequence[str], first: int, second: int, width: int, max_lag: int, roll_up: Sequence[str] | None = None) -> DataFrame:
    """(*roll_up, lag, n): coincidences of units ``first`` and ``second`` in each ``by`` group, lags -max_lag..max_lag in bins; a positive
    lag means the first unit fires later. Bins run over the time both units are active, its partial last bin left out.

    Groups in which a unit has under two spikes, or the units share no time, are left out. Lags beyond the number of bins
    can't occur and count 0. ``roll_up`` (default: by) sums groups.
    """
    by, to = list(by), list(roll_up if roll_up is not None else by)
    mine = spikes.where(F.col("unit").isin(first, second) & F.col("time").isNotNull())
    spans = mine.groupBy(*by, "unit").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("lo"), F.max("time").alias("hi"))
    common = spans.where("n >= 2").groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.max("lo").alias("lo"), F.min("hi").alias("hi")).where("units = 2 AND hi > lo").drop("units")
    bins = mine.join(common, by).where("time BETWEEN lo AND hi").select(*by, "unit", F.expr(f"(time - lo) div {width}L").alias("bin"), F.expr(f"(hi - lo) div {width}L").alias("n_bins")).where("bin < n_bins").distinct()
    counts = lag_counts(bins.where(F.col("unit") == first), bins.where(F.col("unit") == second), by, -max_lag, max_lag).groupBy(*to, "lag").agg(F.sum("n").alias("n"))
    groups = common.select(*to).distinct() if to else common.agg(F.count(F.lit(1)).alias("_g")).where("_g > 0").drop("_g")
    grid = groups.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag).cast("bigint"), F.lit(max_lag).cast("bigint"))))
    return grid.join(counts, [*to, "lag"], "left").select(*to, "lag", F.coalesce("n", F.lit(0)).alias("n"))


#: The longest segment of a train's spectrum, in bins, and the occupied bins transformed at once.
SEGMENT, OCCUPIED = 2048, 4096


def train_spectra(spikes: DataFrame, keys: Sequence[str], width: int, per_second: float, max_frequency: float = 100.0, least: int = 10, *, whole: bool = True) -> DataFrame:
    """(*keys, dominant_frequency, frequencies, power): the Welch spectrum of a train's bins up to ``max_frequency`` as two arrays, and
    the frequency above 0 with the most power, the lowest among equals (up to 1e-9 of the power: a train whose segments hold
    one spike each has the same power everywhere). ``whole=False`` leaves the arrays out.

    All null for trains of fewer than ``least`` spikes or too short for a spectrum. An occupied bin goes into the two segments at
    most that hold it, each segment is transformed by itself from its occupied bins, and the spectra are summed: no task holds
    a train. Segments without a spike have no power.
    """
    keys = list(keys)
    rows = timed(spikes, keys)
    found = _spectra(rows, keys, width, per_second, max_frequency, least, whole)
    return rows.select(*keys).distinct().join(found, keys, "left")


def _spectra(rows: DataFrame, keys: list[str], width: int, per_second: float, max_frequency: float, least: int, whole: bool) -> DataFrame:
    rate = per_second / width
    bins = rows.where(F.col("total") >= least).select(*keys, F.expr(f"(time - lo) div {width}L").alias("bin"), F.expr(f"(hi - lo) div {width}L").alias("n_bins")).where("bin < n_bins")
    sized = bins.withColumn("size", F.expr(f"least({SEGMENT}L, n_bins div 4)")).where("size >= 2").withColumn("step", F.expr("size - size div 2")).withColumn("segments", F.expr("(n_bins - size) div step + 1"))
    first, last = F.expr("greatest(0L, (bin - size + step) div step)"), F.expr("least(bin div step, segments - 1)")
    placed = sized.where(first <= last).select(*keys, "size", "segments", "step", "bin", F.explode(F.sequence(first, last)).alias("segment"))
    # a number of partitions by name: the work in Python is more than the bytes suggest by which partitions are put together
    spread = placed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "segment")
    packed = spread.groupBy(*keys, "size", "segments", "segment").agg(F.array_sort(F.collect_set(F.col("bin") - F.col("segment") * F.col("step"))).alias("bins"))
    fields = [packed.schema[k] for k in keys]
    partial = T.StructType([*fields, T.StructField("size", T.LongType()), T.StructField("segments", T.LongType()), T.StructField("power", T.ArrayType(T.DoubleType()))])

    def transform(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for size, mine in f.groupby("size", sort=False):
                yield _summed(mine.assign(power=list(_segment_powers(mine["bins"].to_list(), int(size), rate, max_frequency))), keys)[[*keys, "size", "segments", "power"]]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for f in frames:
            if len(f):
                f = _summed(f if carry is None else pd.concat([carry, f]), keys)
                carry = f.iloc[-1:]
                if len(f) > 1:
                    yield done(f.iloc[:-1])
        if carry is not None:
            yield done(carry)

    def done(f: pd.DataFrame) -> pd.DataFrame:
        peak = [int(np.argmax(p[1:] >= p[1:].max() * (1 - 1e-9))) + 1 if len(p) > 1 else 0 for p in f["power"]]
        power = [p / n for p, n in zip(f["power"], f["segments"], strict=True)] if whole else [p[:0] for p in f["power"]]
        return f.assign(peak=peak, power=power)[[*keys, "size", "peak", "power"]]

    total = T.StructType([*fields, T.StructField("size", T.LongType()), T.StructField("peak", T.LongType()), T.StructField("power", T.ArrayType(T.DoubleType()))])
    sums = packed.mapInPandas(transform, partial).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(add, total).where("peak > 0")
    hertz = lambda k: k * F.lit(float(rate)) / F.col("size")
    arrays = [F.transform(F.sequence(F.lit(0), F.size("power") - 1), hertz).alias("frequencies"), "power"] if whole else []
    return sums.select(*keys, hertz(F.col("peak")).alias("dominant_frequency"), *arrays)


def _summed(f: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """One row for each run of rows with equal keys (rows of equal keys put together), their powers added up."""
    f = f.sort_values(keys, kind="stable")
    starts = np.flatnonzero((f[keys] != f[keys].shift()).any(axis=1).to_numpy())
    powers = f["power"].to_list()
    same = len({len(p) for p in powers}) == 1
    sums = list(np.add.reduceat(np.array(powers), starts, axis=0)) if same else [np.sum(powers[a:b], axis=0) for a, b in zip(starts, [*starts[1:], len(f)], strict=True)]
    return f.iloc[starts].assign(power=sums)


def _segment_powers(segments: list[np.ndarray], size: int, rate: float, max_frequency: float) -> Iterator[np.ndarray]:
    """The one-sided power density up to ``max_frequency`` of each segment of ``size`` bins, from its occupied bins: mean removed, Hann
    window. The mean's part of the transform is known, the window has three frequencies."""
    window = hann(size)
    k = np.arange(int((np.fft.rfftfreq(size, 1 / rate) <= max_frequency).sum()))
    flat = -size / 4 * ((k == 1).astype(float) + ((k + 1) % size == 0)) + size / 2 * (k == 0)
    scale = np.where((k == 0) | (2 * k == size), 1.0, 2.0) / (rate * (window * window).sum())
    table = window[:, None] * np.exp(-2j * np.pi * (np.outer(np.arange(size), k) % size) / size) if sum(map(len, segments)) > size else None
    begin = 0
    while begin < len(segments):
        end, held = begin, 0
        while end < len(segments) and (end == begin or held + len(segments[end]) <= OCCUPIED):
            held += len(segments[end])
            end += 1
        lengths = np.array([len(s) for s in segments[begin:end]])
        at = np.concatenate(segments[begin:end]).astype(np.int64)
        waves = table[at] if table is not None else window[at][:, None] * np.exp(-2j * np.pi * (np.outer(at, k) % size) / size)
        found = np.add.reduceat(waves, np.cumsum(lengths) - lengths, axis=0) - (lengths / size)[:, None] * flat
        yield from (found.real**2 + found.imag**2) * scale
        begin = end


def dominant_frequencies(spikes: DataFrame, keys: Sequence[str], width: int, per_second: float, max_frequency: float = 100.0, least: int = 10) -> DataFrame:
    """(*keys, dominant_frequency) of ``train_spectra``."""
    return train_spectra(spikes, keys, width, per_second, max_frequency, least, whole=False)


# Thresholds of the classes.
LEAST_SPIKES, BURSTING, RHYTHMIC_HZ, REGULAR_CV, IRREGULAR_CV = 10, 0.1, 10, 0.5, 1.5


def classes(features: DataFrame) -> DataFrame:
    """``features`` (n_spikes, burst_ratio, dominant_frequency, cv_isi) plus pattern_type and confidence: the first that holds of too
    few spikes, bursting, rhythmic, regular, irregular; else tonic. A null cv (mean interval 0) counts as infinite."""
    f = F.col
    few, burst = f("n_spikes") < LEAST_SPIKES, f("burst_ratio") > BURSTING
    rhythmic = f("dominant_frequency") > RHYTHMIC_HZ
    cv = F.coalesce("cv_isi", F.lit(float("inf")))
    kind = F.when(few, "insufficient_data").when(burst, "bursting").when(rhythmic, "rhythmic").when(cv < REGULAR_CV, "regular").when(cv > IRREGULAR_CV, "irregular").otherwise("tonic")
    sure = F.when(few, 0.0).when(burst, F.least(F.lit(1.0), f("burst_ratio") * 2)).when(rhythmic, 0.8).when(cv < REGULAR_CV, F.greatest(F.lit(0.5), 1 - cv)).when(cv > IRREGULAR_CV, F.least(F.lit(1.0), cv / 2)).otherwise(0.6)
    return features.withColumn("pattern_type", kind).withColumn("confidence", sure)


#: Time units of a stretch: the part of a train a task holds, an hour and a half; a quarter of an hour with its records.
STRETCH, RECORDED = 64 * BLOCK, 10 * BLOCK


def patterns(spikes: DataFrame, keys: Sequence[str], per_second: float, max_isi: int, min_spikes: int = 3, width: int = 30, window: int = 30_000, step: int = 3_000, max_frequency: float = 100.0, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """One row a train: interval, sliding-rate and burst statistics, dominant frequency, class and confidence, and ``error`` (null,
    or why there is no analysis: fewer than two spikes).

    The trains are packed and written once; all parts come from one pass over them.
    """
    return _patterns(P.pieces(spikes, keys, max_isi, block), list(keys), per_second, max_isi, min_spikes, width, window, step, max_frequency, stretch)


def _patterns(packed: DataFrame, keys: list[str], per_second: float, max_isi: int, min_spikes: int, width: int, window: int, step: int, max_frequency: float, stretch: int) -> DataFrame:
    found = P.features(packed, keys, per_second, max_isi, min_spikes, width, window, step, max_frequency, LEAST_SPIKES, SEGMENT, stretch)
    rate = F.try_divide(F.col("n_spikes") * float(per_second), F.col("hi") - F.col("lo"))
    out = classes(found.withColumn("mean_rate", rate)).drop("lo", "hi")
    return out.withColumn("error", F.when(F.col("n_spikes") < 2, "Not enough spikes for analysis"))


def pattern_records(spikes: DataFrame, keys: Sequence[str], per_second: float, max_isi: int, min_spikes: int = 3, width: int = 30, window: int = 30_000, step: int = 3_000, max_frequency: float = 100.0, block: int = BLOCK, stretch: int = RECORDED) -> DataFrame:
    """``patterns`` with what they were found in, for export: part (block of time, counted from the train's first spike), isi (array of
    time, isi and n), rates (array of time and rate) and bursts (array of start, end, count and indices; a burst belongs to the part it
    starts in), each in order of time. A train has a record for every part of it, and a record holds one part's content only.
    """
    keys = list(keys)
    packed = P.pieces(spikes, keys, max_isi, block)
    found = _patterns(packed, keys, per_second, max_isi, min_spikes, width, window, step, max_frequency, max(stretch, STRETCH))
    return P.records(packed, found, keys, per_second, max_isi, min_spikes, window, step, block, stretch)
