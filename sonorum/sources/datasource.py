"""Recordings as a Spark source, and as columns: a row a channel.

    register(spark)
    spark.read.format("recordings").load("file:///music/*.wav")

`read` goes by way of Spark's own binary files, so it takes any path that Spark
can open; both give recording_id, sample_rate, format, channel, frames, samples.
"""

from __future__ import annotations

import glob
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import EngineError
from . import audio as codec

SCHEMA = "recording_id string, sample_rate int, format string, channel int, frames long, samples array<double>"


def decode(files: DataFrame, permissive: bool = False) -> DataFrame:
    """Rows of a table (path, content); permissive: files that cannot be read give one row with _error."""
    schema = SCHEMA + ", _error string" * permissive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for path, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
                try:
                    a, error = codec.decode(content), None
                except EngineError as e:
                    if not permissive:
                        raise
                    a, error = None, str(e)
                n = len(a.channels) if a else 1
                columns = [[path] * n, [a and a.sample_rate] * n, [a and a.format] * n, list(range(n)) if a else [None], [a and a.frames] * n, [x.tolist() for x in a.channels] if a else [None], [error] * n]
                kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[: len(names)], kinds, strict=False)], names)

    return files.select("path", "content").mapInArrow(run, schema)


def read(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """[S1]"""
    return decode(spark.read.format("binaryFile").load(path), permissive)


def encode(signals: DataFrame, container: str = "wav") -> DataFrame:
    """recording_id, content: each recording's bytes in a container [S4]."""
    import pandas as pd

    from ..operators.pursuit import recording_of

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"recording_id": [pdf["recording_id"].iloc[0]], "content": [codec.encode(recording_of(pdf), container)]})

    return signals.groupBy("recording_id").applyInPandas(run, "recording_id string, content binary")


class Recordings(DataSource):
    """The "recordings" format."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RecordingsReader(self.options.get("path", ""))


class RecordingsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(self.path.removeprefix("file://")))]

    def read(self, partition: InputPartition):
        with open(partition.value, "rb") as f:
            a = codec.decode(f.read())
        for c, x in enumerate(a.channels):
            yield (partition.value, a.sample_rate, a.format, c, a.frames, x.tolist())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Recordings)


def durations(signals: DataFrame) -> DataFrame:
    """recording_id, channels, frames, seconds"""
    return signals.groupBy("recording_id").agg(F.count(F.lit(1)).alias("channels"), F.max("frames").alias("frames"), F.max(F.col("frames") / F.col("sample_rate")).alias("seconds"))
