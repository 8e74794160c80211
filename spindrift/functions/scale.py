"""Helpers that keep plans safe at scale: checked broadcasts and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side is broadcast; both are counted.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 32 * 2**20
#: Codec of written tables with a row or a number a spike: about half the bytes of the default.
CODEC = "zstd"


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes a value takes in a row; 8 for a null."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(value, F.lit(8), lambda total, x: total + _bytes(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        size = F.lit(8)
        for field in kind.fields:
            size = size + _bytes(value[field.name], field.dataType)
    elif isinstance(kind, T.MapType):
        size = _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(F.map_values(value), T.ArrayType(kind.valueType))
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(0)) + 8


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``max_rows`` rows and about ``max_bytes`` bytes, else as it is.

    Without the hint Spark plans a shuffled join, whose skewed partitions AQE splits. The count stops at ``max_rows + 1``
    rows; the side should be narrow and cheap to compute, as it is computed once more for the join.
    """
    size = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        size = size + _bytes(F.col(f"`{field.name}`"), field.dataType)
    counted = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if counted.n <= max_rows and counted.b <= max_bytes else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder of this
    machine on a local master; on a cluster, whose executors would each write to a disk of their own, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage and survives the loss of executors.
    ``codec`` compresses it, None is the session's.

    The rows written are counted and compared with the rows that can be read; a difference (a folder that isn't shared) is an
    error. The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    check_rows(out, seen.get["n"], path)
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, which is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def check_rows(table: DataFrame, n: int, path: str) -> None:
    """An error unless ``table`` has ``n`` rows (Parquet files tell theirs without being read)."""
    found = table.count()
    if found != n:
        raise RuntimeError(f"{n} rows were written to {path}, {found} are read from it: spark.checkpoint.dir must be a folder that all executors share")


def state_of(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(bytes, files, time of the last change) of a file or folder; differs once something was written to it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    total = files.getContentSummary(place)
    return total.getLength(), total.getFileCount(), files.getFileStatus(place).getModificationTime()
