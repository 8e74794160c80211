"""Trains as packed arrays of times: analyses and records of trains from one shuffle of the spikes and one of the arrays.

Spikes are brought together by train and block of time and packed into pieces, one row for up to ``PIECE`` times. What a piece must
know of the rest of its train (spikes before it, the end of the run it leaves open, first and last time) comes from the pieces'
borders alone. Pieces then go to stretches of a train; a stretch also gets the pieces around it that its windows and segments
reach into, so no task holds more of a train than a stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions.scale import CODEC, written
from spindrift.operators.spectra import hann

#: Times of a piece at most; grid points laid out at once; trains whose lags are transformed at once; bins a segment from which it is transformed whole.
PIECE, POINTS, TRAINS, DENSE = 1024, 1_000_000, 256, 64
#: Stands for no time.
NONE = np.iinfo(np.int64).min


def _changes(rows: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    """Where a row differs from the one before it in ``names``; true for the first."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for name in names:
        values = rows.column(name).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(name).to_numpy()
        out[1:] |= values[1:] != values[:-1]
    return out


def _whole(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.Table]:
    """Sorted rows in tables that hold all rows of equal ``names``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(np.flatnonzero(_changes(batch, names))[-1])
        goes_on = held and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in names)
        if last or not goes_on:
            if held or last:
                yield pa.Table.from_batches([*held, *([batch.slice(0, last)] if last else [])]).combine_chunks()
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _ints(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().fill_null(NONE).to_numpy(zero_copy_only=False)


def pieces(spikes: DataFrame, keys: Sequence[str], max_isi: int, block: int) -> DataFrame:
    """(*keys, first, last, size, head_last, head_size, broken, times, counts): the distinct times of each train in order, cut into pieces; size
    is the number of spikes, head_* end the piece's first run of intervals of at most ``max_isi``, broken tells if it has another;
    counts (spikes a time) is null where all are 1. Rows without a time or a key are left out.

    Equal times are combined within batches before they are shuffled.
    """
    keys = list(keys)
    rows = spikes.select(*keys, F.col("time").cast("bigint").alias("time")).dropna()
    names = [*keys, "_b"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = pa.Table.from_batches([batch]).group_by([*keys, "time"], use_threads=False).aggregate([([], "count_all")])
                yield from found.select([*keys, "time", "count_all"]).rename_columns([*keys, "time", "n"]).to_batches()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, names):
            at = np.flatnonzero(_changes(rows, [*names, "time"]))
            n = np.add.reduceat(_ints(rows, "n"), at)
            fresh = _changes(rows, names)[at]
            rows = rows.take(pa.array(at))
            time = _ints(rows, "time")
            starts = np.flatnonzero(fresh)
            inside = np.arange(len(at)) - np.repeat(starts, np.diff([*starts, len(at)]))
            begin = np.flatnonzero(inside % PIECE == 0)
            end = np.append(begin[1:], len(at))
            breaks = np.append(False, np.diff(time) > max_isi)
            breaks[begin] = False
            breaks = np.append(np.flatnonzero(breaks), len(at))
            head = np.minimum(breaks[np.searchsorted(breaks, begin)], end)
            total = np.append(0, np.cumsum(n))
            plain = np.maximum.reduceat(n, begin) == 1
            counts = np.where(np.repeat(plain, end - begin), 0, 1).astype(bool)
            lengths = np.where(plain, 0, end - begin)
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(n[counts]), mask=pa.array(plain))
            keep = rows.select(keys).take(pa.array(begin))
            columns = {"first": time[begin], "last": time[end - 1], "size": total[end] - total[begin], "head_last": time[head - 1], "head_size": total[head] - total[begin], "broken": head < end}
            out = pa.table([*keep.columns, *(pa.array(x) for x in columns.values()), _lists(pa.array(time), np.append(begin, len(at))), listed], names=[*keys, *columns, "times", "counts"])
            yield from out.to_batches(max_chunksize=2_000)

    combined = rows.mapInArrow(combine, f"{fields}, n bigint").withColumn("_b", F.expr(f"(time - pmod(time, {block}L)) div {block}L"))
    sorted_rows = combined.repartition(*names).sortWithinPartitions(*names, "time")
    packed = sorted_rows.mapInArrow(pack, f"{kinds}, first bigint, last bigint, size bigint, head_last bigint, head_size bigint, broken boolean, times array<bigint>, counts array<bigint>")
    return written(packed, "trains", CODEC)


def stretches(packed: DataFrame, keys: list[str], max_isi: int, length: int, align: int, reach: int, facts: DataFrame | None = None) -> DataFrame:
    """The pieces of every stretch of each train with what the stretch must know: lo, hi, total; _from and _to (the times it owns, cut at
    lo plus whole multiples of ``align``); _before, _idx (the last time and number of spikes before its first piece); _end and _end_idx
    (end of the run its last piece leaves open, spikes up to it); alone (it is the whole train). In order of stretch and time.

    Stretches are ``length`` long; a silent one has a row without times. ``facts`` of trains are joined to their stretches.
    """
    at = lambda x: F.floor((x + length // 2 - F.pmod(x + length // 2, F.lit(length))) / length).cast("bigint")
    chain, whole = W.partitionBy(*keys).orderBy("first"), W.partitionBy(*keys)
    back = W.partitionBy(*keys).orderBy(F.col("first").desc()).rowsBetween(W.unboundedPreceding, -1)
    states = packed.select(*keys, "first", "last", "size", "head_last", "head_size", "broken").withColumns({
        "_before": F.lag("last").over(chain), "_next": F.lead("first").over(chain), "_idx": F.coalesce(F.sum("size").over(chain.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "lo": F.min("first").over(whole), "hi": F.max("last").over(whole), "total": F.sum("size").over(whole),
    })
    ends = F.col("_next").isNull() | (F.col("_next") - F.col("last") > max_isi)
    stop = F.when(F.col("broken"), F.struct(F.col("head_last").alias("t"), (F.col("_idx") + F.col("head_size")).alias("i"))).when(ends, F.struct(F.col("last").alias("t"), (F.col("_idx") + F.col("size")).alias("i")))
    here = F.struct(F.col("last").alias("t"), (F.col("_idx") + F.col("size")).alias("i"))
    states = states.withColumn("_stop", stop).withColumn("_tail", F.when(ends, here).otherwise(F.last("_stop", ignorenulls=True).over(back)))
    low, high = F.greatest(at(F.col("first") - reach), at(F.col("lo"))), F.least(at(F.col("last") + (reach + align)), at(F.col("hi")))
    near = F.col("stretch").between(low, high)
    # the first piece also goes to the stretches far from it, so that silent ones exist
    placed = states.withColumn("stretch", F.explode(F.when(F.col("_idx") == 0, F.sequence(at(F.col("lo")), at(F.col("hi")))).otherwise(F.sequence(low, high))))
    first = F.when(near, F.col("first"))
    units = placed.groupBy(*keys, "stretch").agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("total").alias("total"), F.min_by("_before", first).alias("_before"), F.min(F.when(near, F.col("_idx"))).alias("_idx"), F.max_by("_tail", first).alias("_tail"),
    )
    begin = F.col("stretch") * length - length // 2
    cut = lambda x: F.col("lo") + (x - F.col("lo") - F.pmod(x - F.col("lo"), F.lit(align)))
    units = units.select(
        *keys, "stretch", "lo", "hi", "total", "_before", "_idx", F.col("_tail.t").alias("_end"), F.col("_tail.i").alias("_end_idx"), (at(F.col("lo")) == at(F.col("hi"))).alias("alone"),
        F.when(F.col("stretch") == at(F.col("lo")), F.col("lo")).otherwise(cut(begin)).alias("_from"), F.when(F.col("stretch") == at(F.col("hi")), F.col("hi") + 1).otherwise(cut(begin + length)).alias("_to"),
    )
    if facts is not None:
        units = units.join(facts, keys)
    near = F.sequence(at(F.col("first") - reach), at(F.col("last") + (reach + align)))
    rows = packed.select(*keys, "first", "times", "counts", F.explode(near).alias("stretch"))
    return units.join(rows, [*keys, "stretch"], "left").repartition(*keys, "stretch").sortWithinPartitions(*keys, "stretch", "first")


class Stretch:
    """The spikes of some stretches as arrays: u (the stretch), time, n, isi (NONE for none), idx and own (lies in the stretch itself) of each
    time; rows of the stretches' first pieces, and lo, hi, total, begin and end (the times owned) of each stretch."""

    def __init__(self, rows: pa.Table, keys: Sequence[str]):
        fresh = _changes(rows, [*keys, "stretch"])
        at = np.flatnonzero(fresh)
        self.rows, self.size = rows.take(pa.array(at)), len(at)
        self.lo, self.hi, self.total, self.begin, self.end, before, idx = (_ints(self.rows, c) for c in ("lo", "hi", "total", "_from", "_to", "_before", "_idx"))
        self.tail, self.tail_idx = _ints(self.rows, "_end"), _ints(self.rows, "_end_idx")
        lists, counts = rows.column("times").combine_chunks(), rows.column("counts").combine_chunks()
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.time = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.u = np.repeat(np.cumsum(fresh) - 1, lengths)
        self.n = np.ones(len(self.time), np.int64)
        if counts.null_count < len(counts):
            self.n[np.repeat(counts.is_valid().to_numpy(zero_copy_only=False), lengths)] = counts.flatten().to_numpy(zero_copy_only=False)
        self.count = np.bincount(self.u, minlength=self.size)
        self.first = np.cumsum(self.count) - self.count
        opens = self.first[self.count > 0]
        before_of = np.append(NONE, self.time[:-1])[: len(self.time)]
        before_of[opens] = before[self.count > 0]
        self.isi = np.where(before_of == NONE, NONE, self.time - np.where(before_of == NONE, 0, before_of))
        ahead = np.append(0, np.cumsum(self.n))
        self.idx = idx[self.u] + ahead[:-1] - ahead[self.first[self.u]]
        self.own = (self.time >= self.begin[self.u]) & (self.time < self.end[self.u])

    def bursts(self, max_isi: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, end times, spikes) of the runs of at least ``least`` spikes that start in their stretch."""
        fresh = (self.isi == NONE) | (self.isi > max_isi)
        heads = fresh.copy()
        heads[self.first[self.count > 0]] = True
        at = np.flatnonzero(heads)
        last = np.append(at[1:], len(heads))[: len(at)] - 1
        u = self.u[at]
        open_ = last == (self.first + self.count - 1)[u]
        end, end_idx = np.where(open_, self.tail[u], self.time[last]), np.where(open_, self.tail_idx[u], self.idx[last] + self.n[last])
        spikes = end_idx - self.idx[at]
        keep = fresh[at] & self.own[at] & (spikes >= least)
        return at[keep], end[keep], spikes[keep]

    def points(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The first grid point that each stretch owns and the one after its last."""
        last = -((self.lo - self.hi) // step)
        k = lambda t: np.clip(-((self.lo - t) // step), 0, last)
        return k(self.begin), k(self.end)

    def heard(self, window: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, a, b): the times heard at grid points a..b of those that the stretch owns."""
        rel, (low, high) = self.time - self.lo[self.u], self.points(step)
        a, b = np.maximum(-((window - 2 * rel) // (2 * step)), low[self.u]), np.minimum((2 * rel + window) // (2 * step), high[self.u] - 1)
        keep = a <= b
        return np.flatnonzero(keep), a[keep], b[keep]


def _rates(s: Stretch, window: int, step: int) -> dict[str, np.ndarray]:
    """Of each stretch: s_n (spikes over all grid points), heard (points with any), least and most of these. Counts change where a time begins or
    ceases to be heard, so only these points are looked at."""
    at, a, b = s.heard(window, step)
    u, n = s.u[at], s.n[at]
    low, high = s.points(step)
    out = {"s_n": np.bincount(u, n * (b - a + 1), s.size).astype(np.int64), "heard": np.zeros(s.size, np.int64), "least": np.full(s.size, np.iinfo(np.int64).max), "most": np.zeros(s.size, np.int64)}
    if not len(at):
        return out
    fresh = np.append(True, u[1:] != u[:-1])
    seen = np.where(fresh, a - 1, np.append(0, b[:-1]))
    np.add.at(out["heard"], u, np.maximum(b - np.maximum(a, seen + 1) + 1, 0))
    # one line for the grids of all stretches; the offsets only have to keep them apart
    shift = np.append(0, np.cumsum(high - low + 2))[:-1] - low
    x, y, total = a + shift[u], b + shift[u], np.append(0, np.cumsum(n))
    counted = lambda k: total[np.searchsorted(x, k, "right")] - total[np.searchsorted(y, k, "left")]
    np.maximum.at(out["most"], u, counted(x))
    after = b + 1 < high[u]
    np.minimum.at(out["least"], u[after], counted(y[after] + 1))
    has = np.flatnonzero(high > low)
    out["least"][has] = np.minimum(out["least"][has], counted(low[has] + shift[has]))
    return out


def _lag_powers(s: Stretch, width: int, rate: float, max_frequency: float, least: int, segment: int) -> tuple[np.ndarray, list]:
    """(size, powers) of each stretch: the bins of its segments (0 for none) and the summed power of the segments it owns at the
    frequencies above 0, None without a spectrum.

    Power is the transform of the bins' products over lags, which are summed over all segments first: one transform a train. What
    the removed mean takes away lies at the frequencies 0 and 1 alone. Segments of many bins are transformed by themselves.
    """
    bins = (s.hi - s.lo) // width
    size = np.where((s.total >= least) & (bins // 4 >= 2), np.minimum(segment, bins // 4), 0)
    step = np.maximum(size - size // 2, 1)
    last_segment = (bins - size) // step
    # segments that begin in the times owned
    near = lambda t: np.clip(-((s.lo - t) // (step * width)), 0, last_segment + 1)
    low, high = near(s.begin), near(s.end) - 1
    powers: list = [None] * s.size
    x = (s.time - s.lo[s.u]) // width
    keep = (size[s.u] > 0) & (x < bins[s.u])
    keep[1:] &= (x[1:] != x[:-1]) | (s.u[1:] != s.u[:-1])
    u, x = s.u[keep], x[keep]
    for z in np.unique(size[size > 0]).tolist():
        k = np.arange(int((np.fft.rfftfreq(z, 1 / rate) <= max_frequency).sum()))[1:]
        if not len(k):
            continue
        w, half, mine = hann(z), z - z // 2, np.flatnonzero(size == z)
        scale = np.where(2 * k == z, 1.0, 2.0) / (rate * (w * w).sum())
        flat = -z / 4 * (1 + (z == 2))
        for part in np.array_split(mine, -(-len(mine) // TRAINS)):
            row = np.full(s.size, -1)
            row[part] = np.arange(len(part))
            here = np.flatnonzero(row[u] >= 0)
            r, b, v = row[u[here]], x[here], u[here]
            first, last = np.maximum(np.maximum((b - z + half) // half, 0), low[v]), np.minimum(b // half, high[v])
            lags = np.zeros(len(part) * z)
            dense = np.bincount(r, minlength=len(part)) > DENSE * np.maximum(np.minimum(high, last_segment)[part] - low[part] + 1, 1)
            i = np.flatnonzero(~dense[r])
            j = i
            while len(i):
                for m in (0, 1):
                    g = np.maximum(first[i], first[j]) + m
                    ok = g <= np.minimum(last[i], last[j])
                    g, p, q = g[ok], i[ok], j[ok]
                    lags += np.bincount(r[p] * z + b[q] - b[p], w[b[p] - g * half] * w[b[q] - g * half], len(lags))
                j = j + 1
                ok = j < len(b)
                i, j = i[ok], j[ok]
                ok = (r[i] == r[j]) & (b[j] - b[i] < z)
                i, j = i[ok], j[ok]
            lags = lags.reshape(len(part), z)
            power = 2 * np.fft.rfft(lags).real[:, k] - lags[:, :1]
            # the lowest frequency, segment by segment, its part of the mean removed
            g = np.concatenate([first, first + 1])
            both = np.tile(np.arange(len(b)), 2)
            ok = g <= last[both]
            g, both = g[ok], both[ok]
            order = np.lexsort((g, r[both]))
            g, both = g[order], both[order]
            power[:, 0] = 0
            if len(g):
                to = b[both] - g * half
                cut = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (r[both][1:] != r[both][:-1])))
                held = np.diff(np.append(cut, len(g)))
                wave = np.add.reduceat(w[to] * np.exp(-2j * np.pi * to / z), cut) - held / z * flat
                power[:, 0] = np.bincount(r[both[cut]], wave.real**2 + wave.imag**2, len(part))
                for d in np.flatnonzero(dense).tolist():
                    mine_ = np.flatnonzero(r[both[cut]] == d)
                    total = np.zeros(len(k))
                    for group in np.array_split(mine_, -(-len(mine_) // TRAINS)) if len(mine_) else []:
                        train = np.zeros((len(group), z))
                        spots = [to[cut[c] : cut[c] + held[c]] for c in group.tolist()]
                        train[np.repeat(np.arange(len(group)), held[group]), np.concatenate(spots)] = 1
                        found = np.fft.rfft((train - train.mean(axis=1, keepdims=True)) * w)[:, k]
                        total += (found.real**2 + found.imag**2).sum(axis=0)
                    power[d] = total
            for p, values in zip(part.tolist(), power * scale, strict=True):
                powers[p] = values
    return size, powers


def peak(power: np.ndarray) -> int:
    """The lowest of the frequencies (counted from 1) with the most power, up to 1e-9 of it."""
    return int(np.argmax(power >= power.max() * (1 - 1e-9))) + 1


def _percentiles(s: Stretch, alone: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Quartiles of the intervals of stretches that are whole trains (NaN for none), and repeated times, i.e. intervals of 0, of all."""
    zeros = np.bincount(s.u[s.own], (s.n - 1)[s.own], s.size).astype(np.int64)
    keep = s.own & (s.isi != NONE)
    u, d = s.u[keep], s.isi[keep]
    order = np.lexsort((d, u))
    d, count = d[order], np.bincount(u, minlength=s.size)
    first, total = np.cumsum(count) - count, count + zeros
    d = np.append(d, 0)
    out = []
    for q in (0.25, 0.5, 0.75):
        spot = (total - 1) * q
        low, high = np.floor(spot).astype(np.int64), np.ceil(spot).astype(np.int64)
        value = lambda k: np.where(k < zeros, 0, d[np.clip(first + k - zeros, 0, len(d) - 1)]).astype(float)
        found = np.where(low == high, value(low), (high - spot) * value(low) + (spot - low) * value(high))
        out.append(np.where(alone & (total > 0), found, np.nan))
    return out, zeros


def features(packed: DataFrame, keys: list[str], per_second: float, max_isi: int, min_spikes: int, width: int, window: int, step: int, max_frequency: float, least: int, segment: int, length: int) -> DataFrame:
    """One row a train: the statistics of ``trains.patterns`` without the class, and lo and hi."""
    rate = per_second / width
    rows = stretches(packed, keys, max_isi, length, 1, max(window // 2 + step, segment * width) + 1)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, [*keys, "stretch"]):
            s = Stretch(table, keys)
            alone = s.rows.column("alone").to_numpy()
            mean = (s.hi - s.lo) / np.maximum(s.total - 1, 1)
            quartiles, zeros = _percentiles(s, alone)
            keep = s.own & (s.isi != NONE)
            squares = np.bincount(s.u[keep], (s.isi[keep] - mean[s.u[keep]]) ** 2, s.size) + zeros * mean * mean
            at, end, spikes = s.bursts(max_isi, min_spikes)
            size, powers = _lag_powers(s, width, rate, max_frequency, least, segment)
            top = [peak(p) * rate / z if p is not None and a else None for p, z, a in zip(powers, size.tolist(), alone.tolist(), strict=True)]
            parts = [np.append(s.isi[f : f + c][keep[f : f + c]], np.zeros(z, np.int64)) if not a else None for f, c, z, a in zip(s.first.tolist(), s.count.tolist(), zeros.tolist(), alone.tolist(), strict=True)]
            values, found = [], [None if x is None else np.unique(x, return_counts=True) for x in parts]
            columns = {
                "alone": alone, "lo": s.lo, "hi": s.hi, "n_spikes": s.total, "squares": squares, **{c: pa.array(q, from_pandas=True) for c, q in zip(("p25", "p50", "p75"), quartiles, strict=True)},
                "n_bursts": np.bincount(s.u[at], minlength=s.size), "burst_spikes": np.bincount(s.u[at], spikes, s.size).astype(np.int64), "burst_time": np.bincount(s.u[at], end - s.time[at], s.size).astype(np.int64),
                **_rates(s, window, step), "top": pa.array(top, pa.float64()), "bins": size,
                "power": pa.array([None if a else p for p, a in zip(powers, alone.tolist(), strict=True)], pa.list_(pa.float64())),
                "d": pa.array([None if x is None else x[0] for x in found], pa.list_(pa.int64())), "f": pa.array([None if x is None else x[1] for x in found], pa.list_(pa.int64())),
            }
            values = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in columns.values()]
            yield from pa.table([*s.rows.select(keys).columns, *values], names=[*keys, *columns]).to_batches(max_chunksize=2_000)

    numbers = "alone boolean, lo bigint, hi bigint, n_spikes bigint, squares double, p25 double, p50 double, p75 double, n_bursts bigint, burst_spikes bigint, burst_time bigint, s_n bigint, heard bigint, least bigint, most bigint, top double, bins bigint, power array<double>, d array<bigint>, f array<bigint>"
    units = written(rows.mapInArrow(task, f"{kinds}, {numbers}"), "patterns", CODEC)
    total = lambda *names: [F.sum(c).alias(c) for c in names]
    most = lambda *names: [F.max(c).alias(c) for c in names]
    out = units.groupBy(*keys).agg(*most("alone", "lo", "hi", "n_spikes", "p25", "p50", "p75", "most", "top"), *total("squares", "n_bursts", "burst_spikes", "burst_time", "s_n", "heard"), F.min("least").alias("least"))
    several = units.where("NOT alone")
    each = several.select(*keys, F.explode(F.arrays_zip("d", "f")).alias("x"))
    quartiles = each.groupBy(*keys).agg(F.percentile("x.d", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("x.f")).alias("q"))
    spectra = several.where("power IS NOT NULL").select(*keys, "bins", F.posexplode("power").alias("k", "p")).groupBy(*keys, "bins", "k").agg(F.sum("p").alias("p"))
    spectra = spectra.withColumn("m", F.max("p").over(W.partitionBy(*keys))).where(F.col("p") >= F.col("m") * (1 - 1e-9)).groupBy(*keys).agg(F.min((F.col("k") + 1) * float(rate) / F.col("bins")).alias("_top"))
    out = out.join(quartiles, keys, "left").join(spectra, keys, "left")
    f = F.col
    mean = F.try_divide((f("hi") - f("lo")).cast("double"), f("n_spikes") - 1)
    quartile = lambda c, i: F.coalesce(c, f("q")[i])
    points = F.ceil((f("hi") - f("lo")) / step)
    sliding = lambda n: F.when(f("hi") > f("lo"), n * float(per_second) / float(window))
    std = F.sqrt(F.try_divide("squares", f("n_spikes") - 1))
    return out.select(
        *keys, "n_spikes", "lo", "hi", mean.alias("mean_isi"), std.alias("std_isi"), F.when(mean > 0, std / mean).alias("cv_isi"), quartile("p50", 1).alias("median_isi"), quartile("p25", 0).alias("p25_isi"), quartile("p75", 2).alias("p75_isi"),
        "n_bursts", "burst_spikes", (f("n_bursts") / f("n_spikes")).alias("burst_ratio"), F.try_divide("burst_time", "n_bursts").alias("mean_duration"), F.try_divide("burst_spikes", "n_bursts").alias("mean_spikes"),
        F.when(f("hi") > f("lo"), f("s_n") * float(per_second) / (points * float(window))).alias("mean_sliding"), sliding(f("most")).alias("max_sliding"), sliding(F.when(f("heard") < points, F.lit(0)).otherwise(f("least"))).alias("min_sliding"),
        F.coalesce("top", "_top").alias("dominant_frequency"),
    )


def records(packed: DataFrame, found: DataFrame, keys: list[str], per_second: float, max_isi: int, min_spikes: int, window: int, step: int, block: int, length: int) -> DataFrame:
    """``found`` (a row a train) with part, isi, rates and bursts of ``trains.pattern_records``, a row a part. The content of a part is
    made where its spikes lie; only the packed spikes are shuffled."""
    names = [c for c in found.columns if c not in keys]
    rows = stretches(packed, keys, max_isi, length, block, window // 2 + step + 1, found)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keys, *names])
    bigint = lambda *columns: ", ".join(f"{c}: bigint" for c in columns)
    burst = ("start_time", "end_time", "duration", "spike_count", "start_idx", "end_idx")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, [*keys, "stretch"]):
            at = np.flatnonzero(_changes(table, [*keys, "stretch"]))
            ends = np.append(at[1:], table.num_rows)
            points = (_ints(table, "_to")[at] - _ints(table, "_from")[at]) // step + 1
            groups = np.cumsum(points) // POINTS
            cuts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(at)).tolist(), strict=True):
                yield from parts(Stretch(table.slice(at[a], ends[b - 1] - at[a]), keys))

    def parts(s: Stretch) -> Iterator[pa.RecordBatch]:
        low, high = s.points(step)
        at, a, b = s.heard(window, step)
        length_ = high - low
        offset = np.cumsum(length_) - length_
        n = int(length_.sum())
        u = s.u[at]
        change = np.bincount(offset[u] + a - low[u], s.n[at], n + 1) - np.bincount(offset[u] + b + 1 - low[u], s.n[at], n + 1)
        counts = np.cumsum(change)[:n]
        unit = np.repeat(np.arange(s.size), length_)
        rel = (np.arange(n) - offset[unit] + low[unit]) * step
        own = np.flatnonzero(s.own)
        first = (s.begin - s.lo) // block
        last = np.maximum((s.end - 1 - s.lo) // block, first - 1)
        spread = last - first + 1
        row = np.cumsum(spread) - spread - first
        place = lambda v, since: row[v] + since // block
        total = int(spread.sum())
        starts, end, spikes = s.bursts(max_isi, min_spikes)
        spots = place(s.u[own], s.time[own] - s.lo[s.u[own]]), place(unit, rel), place(s.u[starts], s.time[starts] - s.lo[s.u[starts]])
        sizes = [np.bincount(x, minlength=total) for x in spots]
        keep = (sizes[0] > 0) | (sizes[1] > 0)
        owner = np.repeat(np.arange(s.size), spread)[keep]
        part = (np.arange(total) - np.repeat(row, spread))[keep]

        def lists(k: int, **columns: np.ndarray) -> pa.ListArray:
            values = pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
            return _lists(values, np.append(0, np.cumsum(sizes[k][keep])))

        isi = s.isi[own]
        time, idx = s.time[starts], s.idx[starts]
        content = [
            lists(0, time=s.time[own], isi=pa.array(isi, mask=isi == NONE), n=s.n[own]),
            lists(1, time=s.lo[unit] + rel, rate=counts * float(per_second) / float(window)),
            lists(2, **dict(zip(burst, (time, end, end - time, spikes, idx, idx + spikes - 1), strict=True))),
        ]
        out = pa.table([*s.rows.select([*keys, *names]).take(pa.array(owner)).columns, pa.array(part), *content], names=[*keys, *names, "part", "isi", "rates", "bursts"])
        yield from out.to_batches(max_chunksize=500)

    return rows.mapInArrow(task, f"{schema}, part bigint, isi array<struct<{bigint('time', 'isi', 'n')}>>, rates array<struct<time: bigint, rate: double>>, bursts array<struct<{bigint(*burst)}>>")
