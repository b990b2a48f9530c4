"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space, in ASCII lower case.  A
batch of documents becomes one sorted run: key hash (128 bits) and the number of
its documents that hold the key.  Runs lie in levels; when a level holds FANOUT
runs they are merged into one run of the next level, so a key is rewritten once
a level.  Each batch is merge-anti-joined with the runs before it is added
(`fresh`), which leaves the keys that the batches before do not hold yet, or in
fewer than MIN_DOCS documents; over all runs, the summed counts give the keys that
at least MIN_DOCS documents hold (`frequent`).

`drop_lines` takes all lines of frequent keys out of every document.  Frequent
keys are handed to all tasks only while they are at most BROADCAST_KEYS (16
bytes each); beyond that they are joined with the documents' lines.

Defined results: null or empty text is one empty line, whose key is empty and
never dropped; every row is a document of its own, repeated rows too; an empty
table gives an empty table; a null doc_id is kept; other columns are carried on
unchanged with keep_columns, else left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, dropped, released, scratch, ship, text_slices, unused, written

MIN_DOCS = 10
FANOUT = 4
BATCHES = 4
BROADCAST_KEYS = 500_000
BLANK = b" \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
RUN = "h1 long, h2 long, docs long"


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def key_hash(line: bytes) -> bytes:
    """16 bytes; none for an empty key (bytes.lower and strip know ASCII only, as wanted)."""
    key = line.strip(BLANK).lower()
    return xxhash.xxh3_128_digest(key) if key else b""


def as_longs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype("<i8")


def line_counts(docs: DataFrame, batches: int = 1) -> DataFrame:
    """batch int, h1, h2, docs: documents that hold a key, summed in every batch."""
    ship(docs.sparkSession)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(arrow):
            own = [Counter() for _ in range(batches)]
            for b, text in zip(part.column("batch").to_pylist(), texts, strict=True):
                own[b].update({key_hash(x) for x in lines_of(text)} - {b""})
            for b, counts in enumerate(own):
                if counts:
                    longs = as_longs(list(counts))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(longs), b, np.int32)), pa.array(longs[:, 0].copy()), pa.array(longs[:, 1].copy()), pa.array(list(counts.values()), pa.int64())], ["batch", "h1", "h2", "docs"])

    dealt = documents(docs).select("text", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    return dealt.mapInArrow(run, "batch int, " + RUN).groupBy("batch", "h1", "h2").agg(F.sum("docs").alias("docs"))


class LineRuns:
    """Levelled sorted runs under a folder."""

    def __init__(self, spark, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.folder}/level-{level}-run-{self.made}"
        self.made += 1
        run.select("h1", "h2", "docs").sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def rows(self, paths: list[str] | None = None) -> DataFrame:
        paths = [p for level in self.levels for p in level] if paths is None else paths
        if not paths:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(*paths)

    def fresh(self, batch: DataFrame, min_docs: int = 1) -> DataFrame:
        """The batch's keys that the runs do not hold in min_docs documents yet (by default: that no run holds)."""
        if not any(self.levels):
            return batch
        return batch.join(self.frequent(min_docs).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")

    def add(self, batch: DataFrame) -> None:
        """Add a batch's counts as a run of level 0 and compact what is full."""
        self._write(batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self.rows(full).groupBy("h1", "h2").agg(F.sum("docs").alias("docs")), level + 1)
            dropped(self.spark, *full)
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        return self.rows().groupBy("h1", "h2").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS, keep_columns: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, text without the lines of frequent keys; with keep_columns the input's columns, text replaced."""
    spark = docs.sparkSession
    ship(spark)
    top = scratch(spark)
    counted = written(line_counts(docs, batches), f"{top}/batches")
    runs = LineRuns(spark, f"{top}/runs")
    for b in range(batches):
        runs.add(runs.fresh(counted.where(F.col("batch") == b), min_docs))
    heavy = written(runs.frequent(min_docs).select("h1", "h2"), f"{top}/frequent")
    dropped(spark, f"{top}/batches", f"{top}/runs")
    released(spark)
    source = docs if keep_columns else documents(docs)
    if heavy.count() <= broadcast_keys:
        return _by_keys(source, heavy, keep_columns)
    return _by_join(source, heavy, keep_columns)


def _kept(texts: list, gone) -> tuple[list[int], list[int], list[str]]:
    """Of each text: lines, dropped lines, what is left; gone(i, lines) tells which lines go."""
    n, n_dropped, kept = [], [], []
    for i, text in enumerate(texts):
        lines = lines_of(text)
        out = gone(i, lines)
        left = [x for x, g in zip(lines, out, strict=True) if not g]
        n.append(len(lines))
        n_dropped.append(len(lines) - len(left))
        kept.append(b"\n".join(left).decode("utf-8", "surrogatepass"))
    return n, n_dropped, kept


def _result(part: pa.RecordBatch, found: tuple, names: list[str] | None) -> pa.RecordBatch:
    n, n_dropped, kept = found
    if names:
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if x == "text" else part.column(x) for x in names], names)
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


def _schema(source: DataFrame, keep_columns: bool):
    return source.schema if keep_columns else "doc_id long, n_lines long, n_dropped long, text string"


def _by_keys(source: DataFrame, heavy: DataFrame, keep_columns: bool) -> DataFrame:
    keys = source.sparkSession.sparkContext.broadcast(frozenset(np.array([h1, h2], ">i8").tobytes() for h1, h2 in heavy.collect()))

    names = source.columns if keep_columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = keys.value
        for part, texts in text_slices(batches):
            yield _result(part, _kept(texts, lambda i, lines: [key_hash(x) in held for x in lines]), names)

    return source.mapInArrow(run, _schema(source, keep_columns))


def _by_join(source: DataFrame, heavy: DataFrame, keep_columns: bool) -> DataFrame:
    names = source.columns if keep_columns else None
    gone_at, own_id, own_mark = unused(source, "_gone", "_doc_id", "_mark")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            ids, marks, places, digests = [], [], [], []
            for doc_id, mark, text in zip(part.column("doc_id").to_pylist(), part.column("mark").to_pylist(), texts, strict=True):
                for k, digest in enumerate(map(key_hash, lines_of(text))):
                    if digest:
                        ids.append(doc_id), marks.append(mark), places.append(k), digests.append(digest)
            if ids:
                longs = as_longs(digests)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(places, pa.int32()), pa.array(longs[:, 0].copy()), pa.array(longs[:, 1].copy())], ["doc_id", "mark", "place", "h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            places = [set(x or ()) for x in part.column(gone_at).to_pylist()]
            yield _result(part, _kept(texts, lambda i, lines: [k in places[i] for k in range(len(lines))]), names)

    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    lines = documents(source).withColumn("mark", mark).mapInArrow(explode, "doc_id long, mark long, place int, h1 long, h2 long")
    gone = lines.join(heavy, ["h1", "h2"]).groupBy(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark)).agg(F.collect_set("place").alias(gone_at))
    joined = source.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (mark == F.col(own_mark)), "left").select(*(source[c] for c in source.columns), gone_at)
    return joined.mapInArrow(run, _schema(source, keep_columns))
