"""Best-fit packing of documents into token sequences, bulk-synchronously.

A document's ids, an end id behind them, are cut into pieces only where they
exceed a sequence.  Pieces are range-sorted by length; equal lengths form one
run, and a piece's place in its run is its rank.  Open sequences' gaps form runs
as well, sorted by size.  One superstep matches the longest run of pieces that
is left with the gaps: every piece's successor is the smallest gap that holds
it, runs that want the same gaps are split by rank, the filled gaps shrink to
new gap runs, and what found no gap opens sequences.  This is best fit
decreasing, carried out on whole runs: there are at most as many piece lengths
and gap sizes as a sequence has tokens, so the state of the sweep is bounded by
that, not by the number of documents.  Each superstep yields rows (length, rank
interval, first sequence, offset), and a piece finds its sequence by its rank.

Defined results: null or empty text is the one end id; repeated rows are packed
each on its own; a null doc_id is kept and sorts first; an empty table packs
into nothing; other columns are not carried on.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, dropped, partitions, released, scratch, ship, text_slices, written
from .tokens import word_encoder

VOCABULARY = "word_bpe_49k.json"
WIDTH = 2048
END_ID = 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, name: str = VOCABULARY, width: int = WIDTH, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, with their ids on demand."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        step = 4 * width
        for part, texts in text_slices(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), word_encoder(name)(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), own))
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            if with_ids:
                from .byte_bpe import packed_lists

                arrays.append(packed_lists(list(columns[5])))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return documents(docs).mapInArrow(run, PIECE + ", ids array<int>" * with_ids)


def sweep(counts: dict[int, int], width: int) -> list[tuple[int, int, int, int, int]]:
    """Supersteps over runs: (length, first rank, end rank, first sequence, offset) of each matched interval.

    counts: pieces of each length.  Gap runs are intervals of sequences with the
    same gap; of equal gaps the sequences opened first are filled first.
    """
    sizes: list[int] = []  # of gaps that are there, ascending
    gaps: dict[int, list[tuple[int, int]]] = {}
    opened, out = 0, []

    def free(size: int, first: int, end: int) -> None:
        if size and first < end:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append((first, end))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):  # no successor: open sequences, each filled with as many of the run as it holds
                each = min(width // length, left)
                n = left // each
                for i in range(each):
                    out.append((length, rank + i * n, rank + (i + 1) * n, opened, i * length))
                free(width - each * length, opened, opened + n)
                rank, left, opened = rank + n * each, left - n * each, opened + n
                continue
            size = sizes[k]
            first, end = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], sizes[k]
            n = min(left, end - first)
            out.append((length, rank, rank + n, first, width - size))
            free(size, first + n, end)
            free(size - length, first, first + n)
            rank, left = rank + n, left - n
    return out


def pack(docs: DataFrame, name: str = VOCABULARY, width: int = WIDTH) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    n = partitions(spark)
    top = scratch(spark)
    cut = written(pieces(docs, name, width), f"{top}/pieces")  # a range exchange reads its input twice: not the texts

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width + 1, np.int64)
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            own = np.empty(len(lengths), np.int64)
            edges = np.flatnonzero(np.diff(lengths, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own[a:b] = seen[lengths[a]] + np.arange(b - a)
                seen[lengths[a]] += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), TaskContext.get().partitionId(), np.int32)), pa.array(own)], [*batch.schema.names, "part", "own"])

    by = ["length", "doc_id", "piece", "ids_crc32"]
    runs = written(cut.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(ranked, PIECE + ", part int, own long"), f"{top}/runs")
    dropped(spark, f"{top}/pieces")
    released(spark)
    # a partition holds neighbouring lengths: partitions + width rows at most
    held = runs.groupBy("part", "length").agg(F.max("own").alias("last")).collect()
    total: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for part, length, last in sorted(held):
        before[part, length] = total.get(length, 0)
        total[length] = before[part, length] + last + 1
    steps = sweep(total, width)
    by_length: dict[int, np.ndarray] = {}
    table = np.array(steps, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    for length in np.unique(table[:, 0]):
        by_length[int(length)] = table[table[:, 0] == length]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, part, own = (batch.column(c).to_numpy() for c in ("length", "part", "own"))
            sequence, offset = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
            key = part.astype(np.int64) * (width + 1) + lengths
            for value in np.unique(key):
                at = np.flatnonzero(key == value)
                p, length = divmod(int(value), width + 1)
                mine = by_length[length]
                rank = own[at] + before[p, length]
                row = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
                sequence[at], offset[at] = row[:, 3] + rank - row[:, 1], row[:, 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return runs.mapInArrow(placed, PIECE + ", sequence_id long, offset long")
