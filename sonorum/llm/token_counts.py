"""Token counts of documents from flat, unindexed token files by a separator scan.

A token file is a run of little-endian 16-bit ids, an end-of-document id behind
every document and nothing else: no lengths, no index.  `write` makes such files
from documents (one a task, under a temporary name until whole) and `count`
reads any.  Files are cut into blocks of BLOCK_BYTES; each block is searched for
the end id as a whole array.  A document that ends in a block may have begun in
any block before it: a prefix scan over the blocks of a file (the last separator
before the block, and the separators so far), in two levels, gives every
document's start and number.

Defined results: null or empty text has 0 tokens; ids behind a file's last end
id are a document without an end and are counted under it; repeated rows are
counted each; a null doc_id is kept; an empty table gives no files and an empty
result; a file whose size is odd raises; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, scratch, ship, text_slices, written
from .sharedfs import opened, read_range, temporary
from .tokens import byte_encoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 50256
BLOCK_BYTES = 4 << 20
#: Blocks of a file that one task scans.
GROUP_BLOCKS = 1024


def write(docs: DataFrame, folder: str, name: str = VOCABULARY, end: int = END_ID) -> DataFrame:
    """Token files of all documents; a table (file, ordinal, doc_id) of the order they were written in, and their sizes."""
    spark = docs.sparkSession
    ship(spark)
    jvm = spark.sparkContext._jvm
    jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jvm.org.apache.hadoop.fs.Path(folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = f"tokens-{TaskContext.get().partitionId():06d}.bin"
        system, top = opened(folder)
        path = f"{top}/{file}"
        draft, out, n, size = temporary(path), None, 0, 0
        last = np.array([end], "<u2").tobytes()
        for part, texts in text_slices(batches):
            out = out or system.open_output_stream(draft, compression=None)
            for ids in byte_encoder(name)(texts):
                size += out.write(np.frombuffer(ids, "<u4").astype("<u2").tobytes() + last) or 0
            k = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([file] * k), pa.array(np.arange(n, n + k)), part.column("doc_id")], ["file", "ordinal", "doc_id"])
            n += k
        if out:
            out.close()
            system.move(draft, path)

    return written(documents(docs).mapInArrow(run, "file string, ordinal long, doc_id long"), f"{folder}/order")


def blocks(spark, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, start, size, total (of the file) of all token files in a folder; the driver sees names and sizes only."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [(s.getPath().getName(), s.getLen()) for s in system.listStatus(path) if s.getPath().getName().endswith(".bin")]
    if odd := [f for f, size in files if size % 2]:
        raise ValueError(f"token files of odd size: {odd[:3]}")
    made = spark.createDataFrame(files, "file string, total long")
    cut = made.where("total > 0").withColumn("block", F.explode(F.expr(f"sequence(0L, (total - 1) div {block_bytes})")))
    return cut.select("file", "block", (F.col("block") * block_bytes).alias("start"), F.least(F.lit(block_bytes).cast("long"), F.col("total") - F.col("block") * block_bytes).alias("size"), "total")


def before(found: DataFrame, group: int = GROUP_BLOCKS) -> DataFrame:
    """file, block, begun, so_far: the last end before each block and the ends before it.

    A prefix scan in two levels: the blocks of a group among themselves, then the
    groups of a file, so that no task sees more than `group` blocks, or one row
    for each group of a file.
    """
    blocks_ = found.select("file", "block", "n", "last", F.expr(f"block div {group}").alias("g"))
    inside = Window.partitionBy("file", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    own = blocks_.select("file", "block", "g", F.max("last").over(inside).alias("own_last"), F.sum("n").over(inside).alias("own_n"))
    groups = blocks_.groupBy("file", "g").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    carried = groups.select("file", "g", F.max("last").over(across).alias("carried_last"), F.sum("n").over(across).alias("carried_n"))
    none = F.lit(0).cast("long")
    return own.join(carried, ["file", "g"]).select(
        "file", "block",
        F.coalesce("own_last", "carried_last", F.lit(-1).cast("long")).alias("begun"),
        (F.coalesce("own_n", none) + F.coalesce("carried_n", none)).alias("so_far"),
    )


def count(spark, folder: str, end: int = END_ID, block_bytes: int = BLOCK_BYTES, group: int = GROUP_BLOCKS) -> DataFrame:
    """file, ordinal, n_tokens of every document in the token files of a folder.

    Files are read once; of each block a table in the shared folder keeps the
    lengths between its ends, and only their number and the last end go through
    the scan.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, start, size, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(read_range(f"{folder}/{file}", start, size), "<u2")
                at = np.flatnonzero(ids == end).astype(np.int64)
                if start + size == total and ids[-1] != end:  # a document without an end
                    at = np.append(at, len(ids))
                begin, lengths = start // 2, np.diff(at, prepend=-1) - 1
                last = begin + int(at[-1]) if len(at) else None
                yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "begin": [begin], "n": [len(at)], "last": [last], "lengths": pa.array([lengths], pa.list_(pa.int64()))}, kinds)

    kinds = pa.schema([("file", pa.string()), *((x, pa.int64()) for x in ("block", "begin", "n", "last")), ("lengths", pa.list_(pa.int64()))])
    cut = blocks(spark, folder, block_bytes)
    n = max(1, min(10_000, cut.count()))
    found = cut.repartition(n, "file", "block").mapInArrow(run, "file string, block long, begin long, n long, last long, lengths array<long>")
    found = written(found, f"{scratch(spark)}/lengths")
    tall = found.join(before(found, group), ["file", "block"]).select("file", "begin", "begun", "so_far", F.posexplode("lengths").alias("pos", "length"))
    # the first document of a block may have begun in any block before it
    n_tokens = F.col("length") + F.when(F.col("pos") == 0, F.col("begin") - F.col("begun") - 1).otherwise(0)
    return tall.select("file", (F.col("so_far") + F.col("pos")).alias("ordinal"), n_tokens.alias("n_tokens"))


def counts_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens of every document, by way of token files in the shared folder."""
    spark = docs.sparkSession
    folder = f"{scratch(spark)}/tokens"
    order = write(docs, folder)
    return order.hint("merge").join(count(spark, folder).hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
