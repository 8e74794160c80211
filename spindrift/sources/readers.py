"""Readers of recording files: spike CSVs, interval CSVs, probe geometry, wide interval tables and raw voltage."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from spindrift.functions.scale import bounded_broadcast, written
from spindrift.plans.recording import TICKS_PER_SECOND

SECONDS = "time double, unit int, electrode int"
TICKS = "time bigint, unit int, electrode int"


def local_path(path: str) -> str:
    """A path with a drive letter as the place where a Linux subsystem mounts the drive; any other path as it is."""
    drive = re.match(r"([A-Za-z]):[\\/]*", path)
    return f"/mnt/{drive[1].lower()}/" + path[drive.end() :].replace("\\", "/") if drive else path


def read_spikes(spark: SparkSession, path: str, *, ticks: bool = False, third: str = "electrode") -> DataFrame:
    """(time, unit, <third>) of a CSV without a header; blanks after commas are ignored. ``ticks``: whole 30 kHz ticks instead of
    seconds. A missing file is an AnalysisException; a line that doesn't parse gives nulls."""
    rows = spark.read.schema(TICKS if ticks else SECONDS).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path, header=False)
    return rows.withColumnRenamed("electrode", third)


def read_intervals(spark: SparkSession, path: str, *, keep_empty: bool = True) -> DataFrame:
    """(interval_id, Start, End, and what else the file has): CSV with a header; interval_id is the row's position, counted from 1
    through the files in order of their names.

    Splits are numbered one after the other from their sizes, rows within a split by their place in it; only one small row a split
    is ordered. ``keep_empty=False`` drops rows of length 0, which stand for the start and the end of the recording.
    """
    rows = spark.read.csv(path, header=True, inferSchema=False)
    typed = [F.col(f"`{c}`").cast("bigint").alias(c) if c in ("Start", "End") else F.col(f"`{c}`") for c in rows.columns]
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_m")]
    placed = written(rows.select(*typed, *place), "intervals-read")
    order = W.partitionBy(F.lit(1)).orderBy("_file", "_split").rowsBetween(W.unboundedPreceding, -1)
    splits = placed.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    splits = splits.select("_file", "_split", "_first", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    out = placed.join(bounded_broadcast(splits), ["_file", "_split"]).select((F.col("_before") + F.col("_m") - F.col("_first") + 1).alias("interval_id"), *(f"`{c}`" for c in rows.columns))
    return out if keep_empty else out.where("Start <> End")


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """(poly, electrode, x, y) of a whitespace-separated probe file: lines with at least four parts that aren't comments. A
    header of one word, blank lines and lines that start with # are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.trim("value").startswith("#")).select(parts.alias("p")).where(F.size("p") >= 4)
    number = lambda i, kind: F.col("p")[i].try_cast(kind)
    return lines.select(number(0, "int").alias("poly"), number(1, "int").alias("electrode"), number(2, "double").alias("x"), number(3, "double").alias("y")).dropna()


def read_wide(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A wide interval table, columns as the header names them, typed by ``schema`` or, which takes another pass over the file, by
    their values."""
    return spark.read.csv(path, header=True, inferSchema=True) if schema is None else spark.read.schema(schema).csv(path, header=True)


@dataclass(frozen=True)
class Bundle:
    """Spikes (plus time_sec), intervals (plus Start_sec, End_sec) and geometry of one recording, read from files in ticks."""

    spikes: DataFrame
    intervals: DataFrame
    geometry: DataFrame


def read_bundle(spark: SparkSession, spikes: str, intervals: str, geometry: str) -> Bundle:
    s = read_spikes(spark, spikes, ticks=True).withColumn("time_sec", F.col("time") / float(TICKS_PER_SECOND))
    i = read_intervals(spark, intervals).withColumns({f"{c}_sec": F.col(c) / float(TICKS_PER_SECOND) for c in ("Start", "End")})
    return Bundle(s, i, read_geometry(spark, geometry))


def adjust_to_ticks(spikes: DataFrame, per_second: int = TICKS_PER_SECOND) -> DataFrame:
    """``spikes`` with times in seconds brought to whole ticks, halves to even; null times stay null."""
    return spikes.withColumn("time", F.rint(F.col("time") * per_second).cast("bigint"))


def read_patterns(spark: SparkSession, path: str, schema: StructType, compact: bool = False) -> DataFrame:
    """Records of trains that ``sinks.write_patterns`` wrote, as rows of ``schema`` (that of what was written); ``compact`` leaves rates as they
    are in the files: start, step and rate (array)."""
    if "rates" not in schema.names:
        return spark.read.schema(schema).json(path)
    grid = StructType([StructField("start", LongType()), StructField("step", LongType()), StructField("rate", ArrayType(DoubleType()))])
    fields = [StructField(f.name, grid if f.name == "rates" else f.dataType) for f in schema.fields]
    point = lambda x, i: F.struct((F.col("rates.start") + i * F.coalesce("rates.step", F.lit(0))).alias("time"), x.alias("rate"))
    rows = spark.read.schema(StructType(fields)).json(path)
    return rows if compact else rows.withColumn("rates", F.transform("rates.rate", point))
