"""Percentiles per group with bounded rank error, from mergeable summaries (deterministic buffer collapsing).

A summary is a set of rows (*keys, _level, _err, _vals): buffers of ``SIZE`` sorted values that each stand for the level's weight in
rows, plus one shorter buffer of level 0 that holds the rest as it is. Two full buffers of rows collapse into one of level 1,
and ``FAN_IN`` full buffers of a higher level into one of the next: of their merged values every second (every ``FAN_IN``-th) is
kept, starting in the middle, one position apart from call to call where there are two middles. A collapse moves no rank by
more than half the new weight; ``_err`` adds these halves up, so the sum of ``_err`` over a group's buffers bounds the rank error
of every percentile. It is at most about n / (2 * SIZE) a level: under 1 % of a group's rows up to 10**9 of them, 1.3 % up to
10**12. Groups of under ``2 * SIZE`` rows in all stay exact.

The tree is built where the data lie: tasks summarise their own rows, only summaries are shuffled, and a task that merges
a group reads its buffers as a stream and never holds more than about ``SIZE * FAN_IN`` values of a level. Summaries are always
merged in two rounds, ``SALTS`` parts of a group first, so that no task reads a summary from every task of the first stage.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 256
#: Full buffers of rows, and of higher levels, that collapse into one.
FIRST, FAN_IN = 2, 64
#: Rows a task sorts at once.
RUN = 1_000_000
#: Parts of a group that are merged by themselves first.
SALTS = 64

Buffer = tuple[int, int, np.ndarray]


def collapse(buffers: list[np.ndarray], odd: bool) -> np.ndarray:
    """Equal-size sorted buffers of equal weight, merged: every len(buffers)-th value from the middle on."""
    step = len(buffers)
    merged = np.sort(np.concatenate(buffers), kind="stable")
    return merged[(step - 1 + (odd and step % 2 == 0)) // 2 :: step]


def weights(levels: np.ndarray, fan_in: int = FAN_IN) -> np.ndarray:
    """Rows that a value of each level stands for."""
    levels = np.asarray(levels, np.int64)
    return np.where(levels == 0, 1, FIRST * np.power(np.int64(fan_in), np.maximum(levels - 1, 0)))


def reduce_group(buffers: list[Buffer], size: int = SIZE, fan_in: int = FAN_IN) -> list[Buffer]:
    """The buffers of one group as a summary: fewer full buffers a level than collapse, and one partial buffer at most."""
    levels: dict[int, list[tuple[int, np.ndarray]]] = {}
    loose = [b for level, _, b in buffers if level == 0 and len(b) != size]
    for level, err, b in buffers:
        if level or len(b) == size:
            levels.setdefault(level, []).append((err, b))
    rest = np.sort(np.concatenate(loose)) if loose else np.empty(0, buffers[0][2].dtype)
    full = len(rest) // size
    levels.setdefault(0, []).extend((0, rest[i * size : (i + 1) * size]) for i in range(full))
    rest = rest[full * size :]
    level = 0
    while level <= max(levels):
        have = levels.get(level, [])
        done, fan = 0, fan_in if level else FIRST
        half = (int(weights(level + 1, fan_in)) + 1) // 2
        while len(have) - done >= fan:
            take = have[done : done + fan]
            done += fan
            above = levels.setdefault(level + 1, [])
            above.append((sum(e for e, _ in take) + half, collapse([b for _, b in take], len(above) % 2 == 1)))
        levels[level] = have[done:]
        level += 1
    out = [(lv, err, b) for lv, held in sorted(levels.items()) for err, b in held]
    return [*out, (0, 0, rest)] if len(rest) else out


def _starts(columns: list[pa.Array | pa.ChunkedArray], n: int) -> np.ndarray:
    """Where runs of equal keys (nulls equal) begin in sorted columns of n rows, and n."""
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        a, b = c.slice(0, n - 1), c.slice(1)
        differ = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b))
        new[1:] |= differ.to_numpy(zero_copy_only=False).astype(bool)
    return np.append(np.flatnonzero(new), n)


class _Out:
    """Collects summary rows; key rows are taken from ``keys`` by position."""

    def __init__(self) -> None:
        self.at: list[np.ndarray] = []
        self.level: list[np.ndarray] = []
        self.err: list[np.ndarray] = []
        self.length: list[np.ndarray] = []
        self.values: list[np.ndarray] = []

    def many(self, at: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> None:
        zeros = np.zeros(len(at), np.int64)
        for held, x in ((self.at, at), (self.level, zeros), (self.err, zeros), (self.length, lengths), (self.values, values)):
            held.append(x)

    def group(self, at: int, buffers: list[Buffer]) -> None:
        self.at.append(np.full(len(buffers), at))
        self.level.append(np.array([b[0] for b in buffers], np.int64))
        self.err.append(np.array([b[1] for b in buffers], np.int64))
        self.length.append(np.array([len(b[2]) for b in buffers], np.int64))
        self.values.extend(b[2] for b in buffers)

    def batch(self, keys: list, names: list[str]) -> pa.RecordBatch | None:
        if not self.at:
            return None
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(self.length))]).astype(np.int32)
        take = pa.array(np.concatenate(self.at))
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(self.values)))
        cols = [k.take(take) for k in keys]
        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(self.level).astype(np.int32)), pa.array(np.concatenate(self.err)), lists], names=[*names, "_level", "_err", "_vals"])


def _summarise(names: list[str], size: int, fan_in: int, run: int):
    def one(batches: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(batches)
        t = t.sort_by([(c, "ascending") for c in [*names, "_v"]]).combine_chunks()
        keys = [t.column(c).combine_chunks() for c in names]
        values = t.column("_v").to_numpy()
        starts = _starts(keys, len(values))
        n = np.diff(starts)
        out = _Out()
        small = np.flatnonzero(n <= size)
        if len(small):
            inside = np.repeat(n <= size, n)
            out.many(starts[small], n[small], values[inside])
        for g in np.flatnonzero(n > size):
            out.group(starts[g], reduce_group([(0, 0, values[starts[g] : starts[g + 1]])], size, fan_in))
        return out.batch(keys, names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= run:
                yield one(held)
                held, rows = [], 0
        if rows:
            yield one(held)

    return task


def _merge(names: list[str], size: int, fan_in: int):
    def buffers(levels: np.ndarray, errs: np.ndarray, offsets: np.ndarray, values: np.ndarray, a: int, b: int) -> list[Buffer]:
        return [(int(levels[i]), int(errs[i]), values[offsets[i] : offsets[i + 1]]) for i in range(a, b)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        schema = None
        for b in batches:
            if not b.num_rows:
                continue
            schema = b.schema
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([carry, t]).combine_chunks() if carry is not None else t
            done, carry = split(t)
            if done is not None:
                yield done
        if carry is not None and schema is not None:
            yield from carry.combine_chunks().to_batches(max_chunksize=1 << 30)

    def split(t: pa.Table) -> tuple[pa.RecordBatch | None, pa.Table]:
        """Every group of ``t`` reduced; the last, which may go on in the next batch, apart."""
        keys = [t.column(c).combine_chunks() for c in names]
        lists = t.column("_vals").combine_chunks()
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy()
        levels, errs = t.column("_level").to_numpy(), t.column("_err").to_numpy()
        starts = _starts(keys, t.num_rows)
        sizes = np.diff(offsets[starts])
        raw = np.maximum.reduceat(levels, starts[:-1]) == 0
        easy = raw & (sizes <= size)
        easy[-1] = False
        out = _Out()
        if easy.any():
            per_row = np.repeat(easy, np.diff(starts))
            per_value = np.repeat(per_row, np.diff(offsets))
            group = np.repeat(np.flatnonzero(easy), sizes[easy])
            mine = values[offsets[0] : offsets[-1]][per_value]
            many = np.repeat(np.diff(starts)[easy] > 1, sizes[easy])
            if many.any():  # single rows are sorted already
                order = np.lexsort((mine[many], group[many]))
                mine = mine.copy()
                mine[many] = mine[many][order]
            out.many(starts[:-1][easy], sizes[easy], mine)
        for g in np.flatnonzero(~easy)[:-1]:
            out.group(starts[g], reduce_group(buffers(levels, errs, offsets, values, starts[g], starts[g + 1]), size, fan_in))
        last = _Out()
        last.group(starts[-2], reduce_group(buffers(levels, errs, offsets, values, starts[-2], starts[-1]), size, fan_in))
        return out.batch(keys, names), pa.Table.from_batches([last.batch(keys, names)])

    return task


def _read(names: list[str], qs: Sequence[float], fan_in: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([carry, t]).combine_chunks() if carry is not None else t
            if not t.num_rows:
                continue
            keys = [t.column(c).combine_chunks() for c in names]
            starts = _starts(keys, t.num_rows)
            carry = t.slice(int(starts[-2]))
            if len(starts) > 2:
                yield percentiles(t.slice(0, int(starts[-2])).combine_chunks())
        if carry is not None and carry.num_rows:
            yield percentiles(carry.combine_chunks())

    def percentiles(t: pa.Table) -> pa.RecordBatch:
        keys = [t.column(c).combine_chunks() for c in names]
        lists = t.column("_vals").combine_chunks()
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        weight = weights(t.column("_level").to_numpy(), fan_in)
        starts = _starts(keys, t.num_rows)
        n = np.add.reduceat(np.diff(offsets) * weight, starts[:-1])
        err = np.add.reduceat(t.column("_err").to_numpy(), starts[:-1])
        rank = np.maximum(1, np.ceil(np.outer(n, qs) - 1e-9)).astype(np.int64)
        found = np.empty(rank.shape, values.dtype)
        single = np.diff(starts) == 1
        one = single & (weight[starts[:-1]] == 1)
        found[one] = values[offsets[starts[:-1][one]][:, None] + rank[one] - 1]
        for g in np.flatnonzero(~one):
            a, b = starts[g], starts[g + 1]
            v = values[offsets[a] : offsets[b]]
            w = np.repeat(weight[a:b], np.diff(offsets[a : b + 1]))
            order = np.argsort(v, kind="stable")
            found[g] = v[order][np.searchsorted(np.cumsum(w[order]), rank[g])]
        take = pa.array(starts[:-1])
        return pa.RecordBatch.from_arrays([*(k.take(take) for k in keys), pa.array(n), pa.array(err), *(pa.array(found[:, i]) for i in range(len(qs)))], names=[*names, "n", "rank_error", *(f"q{i}" for i in range(len(qs)))])

    return task


def _kept(kind: T.DataType) -> T.DataType:
    """How values of a column are kept in buffers: as bigint, or as double where they may have fractions."""
    if isinstance(kind, (T.FloatType, T.DoubleType)) or isinstance(kind, T.DecimalType) and kind.precision > 18:
        return T.DoubleType()
    return T.LongType()


def _state_schema(df: DataFrame, keys: Sequence[str], values: T.DataType) -> T.StructType:
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    return T.StructType([*fields, T.StructField("_level", T.IntegerType()), T.StructField("_err", T.LongType()), T.StructField("_vals", T.ArrayType(values))])


def summarise(df: DataFrame, keys: Sequence[str], value: str, size: int = SIZE, fan_in: int = FAN_IN) -> DataFrame:
    """Summary rows of ``value`` by ``keys``; a group has rows from several tasks until it is merged.

    * Rows with a null value or a null key are left out; no rows, no summary. Repeated rows all count; ties are kept.
    * Whole numbers, floats and doubles are kept as they are (NaN is the greatest value), decimals of up to 18 digits as
      multiples of their last digit, longer ones as doubles; see ``percentiles``, which gives decimals back as decimals.
    """
    keys = list(keys)
    kind = df.schema[value].dataType
    v = df[value]
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        v = v.cast("decimal(38,18)") * F.lit(10**kind.scale) if kind.scale else v
    plain = df.select(*(df[k] for k in keys), v.cast(_kept(kind)).alias("_v")).dropna(subset=keys).where("_v IS NOT NULL")
    return plain.mapInArrow(_summarise(keys, size, fan_in, RUN), _state_schema(df, keys, _kept(kind)))


def merge(summaries: DataFrame, keys: Sequence[str], size: int = SIZE, fan_in: int = FAN_IN) -> DataFrame:
    """Summaries (of tasks, files or days, put together by union) merged to one a group, each in one partition and in order."""
    keys = list(keys)
    schema = _state_schema(summaries, keys, summaries.schema["_vals"].dataType.elementType)
    salted = T.StructType([*schema.fields[: len(keys)], T.StructField("_salt", T.IntegerType()), *schema.fields[len(keys) :]])
    by = [*keys, "_salt"]
    spread = summaries.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).select(*by, "_level", "_err", "_vals")
    parts = spread.repartition(*by).sortWithinPartitions(*by).mapInArrow(_merge(by, size, fan_in), salted)
    placed = parts.drop("_salt").repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(_merge(keys, size, fan_in), schema)


def read_percentiles(merged: DataFrame, keys: Sequence[str], qs: dict[str, float], fan_in: int = FAN_IN) -> DataFrame:
    """(*keys, n, rank_error, one column for each of ``qs``): the value of rank ceil(q * n), off by ``rank_error`` ranks at most.

    ``merged`` must come straight from ``merge`` (or be sorted by its keys within partitions that hold whole groups).
    """
    keys = list(keys)
    if any(not 0 <= q <= 1 for q in qs.values()):
        raise ValueError("percentiles lie between 0 and 1")
    fields = [T.StructField(k, merged.schema[k].dataType) for k in keys]
    names = [*keys, "n", "rank_error", *qs]
    values = merged.schema["_vals"].dataType.elementType
    plain = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in ("n", "rank_error")), *(T.StructField(f"q{i}", values) for i in range(len(qs)))])
    return merged.mapInArrow(_read(keys, list(qs.values()), fan_in), plain).toDF(*names)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], size: int = SIZE, fan_in: int = FAN_IN) -> DataFrame:
    """Percentiles of ``value`` by ``keys`` in one go: ``summarise``, ``merge`` and ``read_percentiles``, in the column's own type."""
    found = read_percentiles(merge(summarise(df, keys, value, size, fan_in), keys, size, fan_in), keys, qs, fan_in)
    kind = df.schema[value].dataType
    if isinstance(kind, T.DecimalType) and kind.precision <= 18 and kind.scale:
        return found.withColumns({q: (F.col(f"`{q}`").cast("decimal(20,0)") / F.lit(10**kind.scale)).cast(kind) for q in qs})
    return found.withColumns({q: F.col(f"`{q}`").cast(kind) for q in qs}) if not isinstance(kind, (T.LongType, T.DoubleType)) else found


def rank_bounds(df: DataFrame, found: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(*keys, n, q, off, rank_error) for each of ``qs`` in ``found`` (of ``percentiles``): how many ranks the value found is off, by counting
    the rows of ``df`` below it and up to it. What ``found`` proves is ``off <= rank_error``."""
    keys = list(keys)
    each = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"`{name}`").alias("p")) for name, q in qs.items())))
    points = found.select(*keys, "n", "rank_error", each.alias("x")).select(*keys, "n", "rank_error", "x.q", "x.p")
    joined = df.select(*keys, F.col(value).alias("_v")).where("_v IS NOT NULL").join(points, keys)
    counted = joined.groupBy(*keys, "q").agg(F.max("n").alias("n"), F.max("rank_error").alias("rank_error"), F.count_if(F.col("_v") < F.col("p")).alias("below"), F.count_if(F.col("_v") <= F.col("p")).alias("upto"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n") - 1e-9))
    off = F.greatest(F.lit(0), F.col("below") + 1 - rank, rank - F.col("upto"))
    return counted.select(*keys, "n", "q", off.alias("off"), "rank_error")
