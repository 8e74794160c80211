"""A data source for raw voltage files: int16 samples, little endian, channels interleaved.

    spark.dataSource.register(VoltageSource)
    spark.read.format("voltage").option("channels", 64).option("rate", 30000).load(path)

The path is a file, or a folder whose files (but for those that begin with _ or .) follow each other in order of their names, each of
whole samples; local, or a URI of a store that Arrow reads (hdfs, s3, gs).

Rows are (sample bigint, time double, channel int, v smallint). The file is cut into ranges of whole samples, one a partition,
and each task seeks to its own; a time range (options ``start`` and ``duration``, in seconds) and filters on ``sample`` and
``time`` narrow the ranges before anything is read, filters on ``channel`` the columns that are unpacked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "sample bigint, time double, channel int, v smallint"
#: Samples of all channels that one partition and one batch hold.
PARTITION, BATCH = 2_000_000, 20_000


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system a path lies on, and its name there."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    """Samples first..last-1 of the recording, which begin at sample ``begin`` of the file."""

    def __init__(self, path: str, first: int, last: int, begin: int) -> None:
        self.path, self.first, self.last, self.begin = path, first, last, begin


class VoltageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voltage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VoltageReader(self.options)


class VoltageReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.n = int(options.get("channels", 64))
        self.rate = float(options.get("rate", 30_000))
        start, duration = float(options.get("start", 0)), options.get("duration")
        if self.n < 1 or self.rate <= 0:
            raise ValueError("channels and rate must be positive")
        self.files = self._files()
        total = sum(n for _, n in self.files)
        self.first = min(int(start * self.rate), total)
        self.last = total if duration is None else min(self.first + int(float(duration) * self.rate), total)
        self.channels = list(range(self.n))

    def _files(self) -> list[tuple[str, int]]:
        """The files in order, with their whole samples; a partial sample at an end isn't read."""
        store, path = place(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such file: {self.path}")
        found = [info] if info.is_file else sorted((f for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "_."), key=lambda f: f.base_name)
        return [(f.path, f.size // (2 * self.n)) for f in found]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows samples and channels; every filter is kept, too, and applied to what is read."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if name in ("sample", "time") and isinstance(value, (int, float)):
                at = value if name == "sample" else value * self.rate
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, int(at) - 1)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, int(at) + 2)
            elif name == "channel" and isinstance(f, EqualTo):
                self.channels = [c for c in self.channels if c == f.value]
            elif name == "channel" and isinstance(f, In):
                self.channels = [c for c in self.channels if c in f.value]
            yield f

    def partitions(self) -> list[Range]:
        step = max(1, PARTITION // self.n)
        out, begin = [], 0
        for path, n in self.files:
            low, high = max(self.first, begin), min(self.last, begin + n)
            out += [Range(path, a, min(a + step, high), a - begin) for a in range(low, high, step)]
            begin += n
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no range is left
            return
        step = max(1, BATCH // self.n)
        channels = np.array(self.channels, np.int32)
        with place(self.path)[0].open_input_file(part.path) as file:
            file.seek(part.begin * 2 * self.n)
            for at in range(part.first, part.last, step):
                rows = min(step, part.last - at)
                block = np.frombuffer(file.read(rows * 2 * self.n), "<i2").reshape(-1, self.n)[:, channels]
                sample = np.repeat(np.arange(at, at + len(block)), len(channels))
                yield pa.RecordBatch.from_arrays([pa.array(sample), pa.array(sample / self.rate), pa.array(np.tile(channels, len(block))), pa.array(block.reshape(-1))], names=["sample", "time", "channel", "v"])


def read_voltage(spark, path: str, channels: int = 64, rate: float = 30_000, start: float = 0, duration: float | None = None):
    """(sample, time, channel, v) of a raw voltage file."""
    spark.dataSource.register(VoltageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("voltage").option("channels", channels).option("rate", rate).option("start", start)
    return (reader if duration is None else reader.option("duration", duration)).load(path)
