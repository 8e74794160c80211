"""Sessions: events of a key divided by silence.

Sweep-line: each event adds one at its time and takes one away ``gap`` later; a session lasts while the running sum is
above zero. The time axis is cut into blocks, so that no task ever sorts a whole key: an event whose ``-1`` falls into the
next block is carried there, each block closes what it can, and only the fragments that touch a block border are stitched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A block spans this many gaps.
BLOCK_GAPS = 1024

CARRY, OPEN, CLOSE = 0, 1, 2


def sessions(events: DataFrame, keys: Sequence[str], time: str, gap: int, *, distinct_times: bool = True, block_gaps: int = BLOCK_GAPS) -> DataFrame:
    """(*keys, start_time, end_time, duration, n_events): one row per session.

    A session ends where the key's next event comes more than ``gap`` later; an event exactly ``gap`` later still belongs to it.
    ``time`` is integral (cast timestamps to microseconds first); ``gap`` >= 1.

    * Rows without a time or without one of the keys belong to no session and are left out.
    * Equal times of a key count once, with ``distinct_times=False`` as often as they occur; they never split a session.
    * No rows give no sessions; other columns of ``events`` are ignored, whatever their names.

    Skew: equal times are pre-aggregated before the first shuffle; the window groups are (keys, block), each holding at most
    ``block`` distinct times, two deltas each. Stitching gets at most two fragments of a key a block.
    """
    if gap < 1 or block_gaps < 1:
        raise ValueError("gap and block_gaps must be at least 1")
    key = [f"_k{i}" for i in range(len(keys))]
    block = gap * block_gaps
    events = events.select(*(events[k].alias(a) for k, a in zip(keys, key, strict=True)), events[time].cast("bigint").alias("t")).dropna()
    times = events.groupBy(*key, "t").agg(F.lit(1).cast("bigint").alias("n") if distinct_times else F.count(F.lit(1)).alias("n"))

    # an event also goes to the next block if it is still active there
    floor_block = lambda t: F.expr(f"({t} - pmod({t}, {block}L)) div {block}L")
    b, b_end = floor_block("t"), floor_block(f"(t + {gap}L)")
    placed = (
        times.select(*key, "t", "n", F.explode(F.when(b_end > b, F.array(b, b_end)).otherwise(F.array(b))).alias("b"))
        .withColumn("own", F.col("b") == b)
        .repartition(*key, "b")
    )

    def delta(kind: int, position):
        return F.struct(F.lit(kind).alias("kind"), position.alias("pos"), F.lit(-1 if kind == CLOSE else 1).alias("d"))

    opening, closing = delta(OPEN, F.col("t")), delta(CLOSE, F.col("t") + F.lit(gap).cast("bigint"))
    carried = F.array(delta(CARRY, F.col("b") * F.lit(block).cast("bigint")), closing)
    mine = F.when(b_end > b, F.array(opening)).otherwise(F.array(opening, closing))
    deltas = placed.select(*key, "b", "t", "n", F.explode(F.when(F.col("own"), mine).otherwise(carried)).alias("x")).select(*key, "b", "t", "n", "x.*")

    # at equal positions what opens comes before what closes: a gap of exactly `gap` joins
    sweep = W.partitionBy(*key, "b").orderBy("pos", "kind").rowsBetween(W.unboundedPreceding, 0)
    opened = F.col("kind") == OPEN
    fragments = (
        deltas.withColumn("level", F.sum("d").over(sweep))
        .withColumn("part", F.sum(F.when((F.col("level") == 1) & (F.col("d") == 1), 1).otherwise(0)).over(sweep))
        .groupBy(*key, "b", "part")
        .agg(
            F.min(F.when(opened, F.col("t"))).alias("start_time"),
            F.max(F.when(opened, F.col("t"))).alias("end_time"),
            F.sum(F.when(opened, F.col("n")).otherwise(0)).alias("n"),
            F.max(F.col("kind") == CARRY).alias("goes_on"),
            (F.sum("d") > 0).alias("stays_open"),
        )
        # a fragment that touches no border is a session by itself; the null group holds those to stitch
        .withColumn("whole", F.when(~F.col("goes_on") & ~F.col("stays_open"), F.col("b")))
    )
    chain = W.partitionBy(*key, "whole").orderBy("b", "part").rowsBetween(W.unboundedPreceding, 0)
    return (
        fragments.withColumn("chain", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(chain))
        .groupBy(*key, "whole", "chain")
        .agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("n").alias("n_events"))
        .select(*(F.col(a).alias(k) for a, k in zip(key, keys, strict=True)), "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"), "n_events")
    )
