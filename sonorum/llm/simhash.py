"""SimHash fingerprints of whole texts and search within a Hamming radius.

Terms are the words of a text (ASCII lower case) and its pairs of neighbouring
words, weighted by 1 + ln(occurrences) in whole sixteenths, so that sums are
exact and equal texts get equal fingerprints on every machine.  Every term's hash
votes with its weight for or against each of BITS bits; the sign of the sum is
the bit, 0 at a tie.

`near_pairs` finds all fingerprints within a radius: bits are permuted, cut into
radius + 1 blocks, and one table a block holds the fingerprints under that
block's value.  Two fingerprints within the radius agree in at least one block.
Equal fingerprints are one class and are compared once.

Defined results: null or empty text has no terms and the fingerprint of zeros;
the successor of a document is the next one by descending doc_id (equal ids by
ascending text, null ids last), that of the last is the first, that of a single
document itself; repeated rows are documents of their own; an empty table gives
an empty table; other columns are not carried on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, partitions, ship
from .hashing import LOWER, mix, prefix, spans, words

BITS = 256
_LANES = (np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def fingerprint(text: str) -> bytes:
    raw = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    first, end = words(raw)
    if not len(first):
        return bytes(BITS // 8)
    own = spans(prefix(raw), first, end)
    pairs = mix(own[:-1] * np.uint64(3) + own[1:] * np.uint64(7))
    terms, counts = np.unique(np.concatenate([own, pairs]), return_counts=True)
    weights = np.round(16 * (1 + np.log(counts))).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for at in range(0, len(terms), 4096):  # so few whole weights add up exactly in single precision
        lanes = mix(terms[at : at + 4096, None] ^ _LANES)
        bits = np.unpackbits(lanes.view(np.uint8), axis=1)
        votes += weights[at : at + 4096] @ bits.astype(np.float32)
    return np.packbits(votes * 2 > weights.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import text_slices

        for part, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([fingerprint(x).hex() for x in texts])], ["doc_id", "fingerprint"])

    return documents(docs).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last floor(n/2) characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_successors(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (p, copy, doc_id, text) of partitions by descending doc_id, each ended by a copy of the next partition's first row.

    Quantiles of doc_id bound the partitions, a count of partitions long; the
    first ids of the partitions are as many.
    """
    spark = docs.sparkSession
    n = parts or 2 * partitions(spark)
    source = documents(docs)
    bounds = sorted({int(x) for x in source.select(F.col("doc_id").cast("double").alias("doc_id")).dropna().approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []
    cuts = np.array(bounds, np.int64)
    last = len(cuts)

    def place(ids: pa.Array) -> np.ndarray:
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), last, last - np.searchsorted(cuts, known, "right")).astype(np.int32)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(batch.column("doc_id"))), batch.column("doc_id")], ["p", "doc_id"])

    heads = {r["p"]: r["head"] for r in source.select("doc_id").mapInArrow(placed, "p int, doc_id long").groupBy("p").agg(F.max("doc_id").alias("head")).collect()}
    filled = sorted(heads)
    before = {p: filled[k - 1] for k, p in enumerate(filled)}  # the first one's copy ends the last partition

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["p", "copy", "doc_id", "text"]
        for batch in batches:
            p = place(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.zeros(len(p), np.int32)), batch.column("doc_id"), batch.column("text")], names)
            at = [i for i, (q, d) in enumerate(zip(p.tolist(), batch.column("doc_id").to_pylist(), strict=True)) if heads[q] == d]
            if at:
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([before[int(p[i])] for i in at], pa.int32()), pa.array(np.ones(len(at), np.int32)), part.column("doc_id"), part.column("text")], names)

    return source.mapInArrow(dealt, "p int, copy int, doc_id long, text string").repartition(n, "p").sortWithinPartitions("p", "copy", F.desc_nulls_last("doc_id"), "text")


def compare_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        held = None  # partition, doc_id, text, fingerprint of the row that waits for its successor
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for p, copy, doc_id, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if copy and (held is None or held[0] != p):
                        continue  # the partition has its successor already
                    own = fingerprint(text)
                    if held is not None and held[0] == p:
                        other = edited(held[2], text)
                        changed = fingerprint(other)
                        rows.append((held[1], len(held[2]), other, held[3].hex(), changed.hex(), likeness(held[3], changed), likeness(held[3], own)))
                        size += len(other)
                    held = None if copy else (p, doc_id, text, own)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), kinds)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), kinds)

    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return with_successors(docs, parts).mapInArrow(run, schema)


def _permuted(value: bytes) -> np.ndarray:
    """Bits of a fingerprint in a fixed pseudo-random order, so that neighbouring bits lie in different blocks."""
    return np.unpackbits(np.frombuffer(value, np.uint8))[np.argsort(mix(np.arange(BITS, dtype=np.uint64)))]


def block_keys(value: str, radius: int) -> list[str]:
    """The keys of a fingerprint in the radius + 1 block tables."""
    bits = "".join(map(str, _permuted(bytes.fromhex(value))))
    edges = [round(k * BITS / (radius + 1)) for k in range(radius + 2)]
    return [f"{k}:{int(bits[a:b], 2):x}" for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def near_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """a, b, distance of all different fingerprints (column fingerprint) that differ in at most radius bits, a < b.

    Documents with one fingerprint are one class; join the classes back for
    members.
    """
    ship(prints.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints_, keys = [], []
            for value in batch.column("fingerprint").to_pylist():
                own = block_keys(value, radius)
                prints_ += [value] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(prints_, pa.string()), pa.array(keys, pa.string())], ["fingerprint", "key"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            distance = [(int(x, 16) ^ int(y, 16)).bit_count() for x, y in zip(a, b, strict=True)]
            at = [i for i, d in enumerate(distance) if d <= radius]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in at], pa.string()), pa.array([b[i] for i in at], pa.string()), pa.array([distance[i] for i in at], pa.int32())], ["a", "b", "distance"])

    classes = prints.select("fingerprint").dropna().distinct()
    tables = classes.mapInArrow(keyed, "fingerprint string, key string")
    left, right = (tables.select(F.col("fingerprint").alias(x), "key") for x in "ab")
    return left.join(right, "key").where(F.col("a") < F.col("b")).select("a", "b").distinct().mapInArrow(measured, "a string, b string, distance int")


def digests(compared: DataFrame) -> DataFrame:
    return compared.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
