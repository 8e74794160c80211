"""Writers of results: CSV with and without a header, JSON, Parquet and one folder a category."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.sources.voltage import place


def write_spikes(spikes: DataFrame, path: str) -> None:
    """Spikes as CSV without a header: time, unit and electrode in this order."""
    spikes.select("time", "unit", "electrode").write.mode("overwrite").csv(path, header=False)


def write_rates(rates: DataFrame, path: str) -> None:
    """Electrode rates as CSV with a header, every number a double."""
    rates.select(*(F.col(c).cast("double").alias(c) for c in ("poly", "electrode", "x", "y", "firing_rate"))).write.mode("overwrite").csv(path, header=True)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Several results as CSV with a header, one folder each (activity, counts, heatmap; unit or channel statistics)."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def write_patterns(patterns: DataFrame, path: str) -> None:
    """One JSON object a record, nested values included; nulls are left out. ``rates`` (array of time and rate on an even grid), if there, become
    start, step and rate (array), and the files are compressed; ``readers.read_patterns`` gives the rows back."""
    out = patterns
    if "rates" in patterns.columns:
        start = F.get("rates", F.lit(0))["time"]
        step = F.get("rates", F.lit(1))["time"] - start
        out = patterns.withColumn("rates", F.struct(start.alias("start"), step.alias("step"), F.col("rates.rate").alias("rate")))
    out.write.mode("overwrite").option("compression", "gzip" if "rates" in patterns.columns else "none").json(path)


def as_json(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, json): each row as one JSON text."""
    return rows.select(*keys, F.to_json(F.struct("*")).alias("json"))


def write_spectrum(psd: DataFrame, summary: DataFrame, folder: str) -> None:
    """Whole spectra as Parquet by channel, and a JSON summary."""
    psd.write.mode("overwrite").partitionBy("channel").parquet(f"{folder}/psd")
    summary.write.mode("overwrite").json(f"{folder}/summary")


def write_by_category(intervals: DataFrame, path: str, category: str = "category") -> None:
    """Intervals with one folder a length category."""
    intervals.write.mode("overwrite").partitionBy(category).parquet(path)


def write_voltage(voltage: DataFrame, path: str, channels: int) -> int:
    """Voltage (sample, channel, v) as a folder of raw files, int16, little endian, channels interleaved; the number of samples written.

    Samples are in order through the files in order of their names; each task writes one file, moved to its name when whole. A
    channel a sample lacks is 0. Channels lie in 0..channels-1; other ones and nulls are left out.
    """
    rows = voltage.where(F.col("channel").between(0, channels - 1) & F.col("v").isNotNull() & F.col("sample").isNotNull())
    packed = rows.groupBy("sample").agg(F.collect_list(F.struct(F.col("channel").cast("int"), F.col("v").cast("int"))).alias("x"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = place(path)
        name, first, n, out = f"{folder}/_{uuid.uuid4().hex}", None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                files.create_dir(folder)
                first, out = batch.column(0)[0].as_py(), files.open_output_stream(name)
            lists = batch.column(1)
            offsets, fields = lists.offsets.to_numpy(), lists.values
            block = np.zeros((batch.num_rows, channels), "<i2")
            at = slice(offsets[0], offsets[-1])
            block[np.repeat(np.arange(batch.num_rows), np.diff(offsets)), fields.field(0).to_numpy()[at]] = fields.field(1).to_numpy()[at]
            out.write(block.tobytes())
            n += batch.num_rows
        if out is not None:
            out.close()
            files.move(name, f"{folder}/part-{first:020d}.dat")
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    ordered = packed.repartitionByRange("sample").sortWithinPartitions("sample")
    return ordered.mapInArrow(task, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
