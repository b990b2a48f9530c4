"""What the corpus operators share: shipping code, shared scratch tables, document views."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one step of an Arrow function handles at a time.
SLICE_CHARS = 1_000_000
#: Bytes of an Arrow batch on its way to or from Python: whole texts may be long, so batches are cut by bytes as well as by rows.
BATCH_BYTES = 4_000_000
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that they need no copy of it installed, and bound Arrow batches."""
    context = spark.sparkContext
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(prefix="sonorum-"), "sonorum.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(path)
    _shipped.add(context.applicationId)


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one is set only where none is and Spark runs on this machine alone (as in tests)."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            top = held.get()
        elif not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            top = "file://" + tempfile.mkdtemp(prefix="sonorum-shared-")
            context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/sonorum-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def released(spark: SparkSession) -> None:
    """Let Spark remove shuffle files of finished steps now; it does so when its driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(docs: DataFrame) -> DataFrame:
    """doc_id long and text (null: empty), under names that nothing else has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as keep it apart from the columns (whatever their case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give the memory of finished batches back to the system: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut so that each holds about SLICE_CHARS of text, with the texts as a list."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes):
            held += int(size)
            if held >= SLICE_CHARS or i == len(sizes) - 1:
                part = batch.slice(start, i + 1 - start)
                yield part, part.column(column).to_pylist()
                start, held = i + 1, 0
        trim()
