"""Removal of repeated byte strings by longest-previous-factor tests, across all documents.

A byte goes if a string of WINDOW bytes that covers it also starts earlier
(smaller doc_id, or same document, smaller start); strings are judged on the
input.  In suffix order, the suffixes that share their first WINDOW bytes with
the suffix at a position are its neighbours, and the position has a longest
previous factor of WINDOW or more exactly if one of them, its nearest smaller
position before or behind it, starts earlier.  So all that must be known of
suffix order is which windows are equal and who is first among equals.

Not every window is moved.  In each window the GRAM-byte string of smallest hash
is its anchor; equal windows have equal anchors at equal offsets.  Windows of one
anchor are a run of neighbouring starts.

Step one sends a record a run: gram hash, hash of all bytes the run covers,
position.  Of runs that agree in all their bytes, all but the first are repeated
as a whole.  Each task drops its own repeats first, so that a passage which a
third of all documents hold is one record a task.  What is left of one gram are
runs that differ: passages' ends, and passages that begin or end differently.
Step two takes the bytes of those runs only, sorts their windows in suffix order
by their bytes and makes the array of longest previous factors from the previous
and the next smaller positions: a window whose factor has WINDOW bytes is a later
copy, the first one has none and stays.  Windows of a gram that very
many runs share are dealt by their hash instead of their gram.  Step three joins
the intervals with the documents and cuts.

Defined results: null or empty text has no bytes; rows equal in doc_id and text
are one document (none repeats the other); rows equal in doc_id only are ordered
by the hash of their text; null ids come before all others; an empty table gives an
empty table; other columns are carried on with keep_columns, else left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, released, scratch, ship, trim, unused, written
from .hashing import mix, powers, prefix, spans

WINDOW = 100
GRAM = 32
#: Runs that one task of step one compares at a time, on average.
BUCKET_RUNS = 200_000
#: Windows that one task of step two compares at a time, on average.
BUCKET_WINDOWS = 200_000
#: Runs that a task holds before it sends them, and windows that are put in suffix order at a time.
HELD_RUNS, SORTED_WINDOWS = 150_000, 100_000
#: Differing runs of one gram from which its windows are dealt by hash.
HOT_RUNS = 2_000
SLICE_BYTES = 750_000
NULL_ID = -(2**63)
#: Low bits of a window's key that hold a position; the others hold the gram's hash.
PLACE_BITS = 24

U = np.uint64


def runs(raw: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, first start, last start, hash of all bytes of each run of windows in one text."""
    n = len(raw) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, U), empty, empty, np.zeros(0, U)
    sums = prefix(raw)
    back = powers(len(sums))[1]
    size = len(raw) - gram + 1
    grams = mix((sums[gram:] - sums[:-gram]) * back[:size])
    place = max(PLACE_BITS, (size - 1).bit_length())
    key = (grams >> U(place) << U(place)) | np.arange(size, dtype=U)  # of equal hashes the leftmost
    width = window - gram + 1
    low, done = key, 1
    while done * 2 <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < width:
        low = np.minimum(low[: n], low[width - done : width - done + n])
    low = low[:n]
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    last = np.append(first[1:], n) - 1
    anchor = (low[first] & U((1 << place) - 1)).astype(np.int64)
    # the anchor's place in the run is part of what must agree
    whole = spans(sums, first, last + window) ^ mix((anchor - first).astype(U))
    return grams[anchor], first, last, whole


def sorted_rows(docs: DataFrame) -> DataFrame:
    """Documents with the mark that orders and joins rows of equal id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.hash(text).alias("mark"), text.alias("text"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes):
            held += int(size)
            if held >= SLICE_BYTES or i == len(sizes) - 1:
                part = batch.slice(start, i + 1 - start)
                yield part, [(x or "").encode("utf-8", "surrogatepass") for x in part.column("text").to_pylist()]
                start, held = i + 1, 0
        trim()


def _earlier(position: tuple[np.ndarray, ...], classes: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by class, then position; which in that order begin a class, and which come behind its first position."""
    order = np.lexsort((*reversed(position), *reversed(classes)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in classes:
        own = c[order]
        new[1:] |= own[1:] != own[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    behind = np.zeros(len(order), bool)
    for c in position:
        own = c[order]
        behind |= own != own[first]
    return order, new, behind


def smaller_neighbours(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of each suffix, in suffix order: what it has in common with the nearest one before it of smaller place (0 if there is none).

    common: what each has in common with the one before it.  Every suffix looks
    at the one before; while that is not smaller it jumps to where that one
    points, and keeps the least that the way had in common.
    """
    at, held = np.arange(len(place)) - 1, common.copy()
    while True:
        jump = np.flatnonzero((at >= 0) & (place[np.maximum(at, 0)] >= place))
        if not len(jump):
            return np.where(at >= 0, held, 0)
        over = at[jump]
        at[jump], held[jump] = at[over], np.minimum(held[jump], held[over])


def longest_previous(suffixes: np.ndarray, position: tuple[np.ndarray, ...]) -> np.ndarray:
    """Longest previous factors, up to the width of the suffixes (one a row): the longest beginning that a suffix of smaller position shares.

    In suffix order it is shared with the previous or the next smaller position;
    suffixes of equal position are the same one.
    """
    n, width = suffixes.shape
    by_place = np.lexsort(tuple(reversed(position)))
    new = np.zeros(n, bool)
    for c in position:
        own = c[by_place]
        new[1:] |= own[1:] != own[:-1]
    place = np.empty(n, np.int64)
    place[by_place] = np.cumsum(new)
    order = np.lexsort((place, suffixes.view(f"S{width}").ravel())) if not (suffixes == 0).any() else np.lexsort((place, np.unique(suffixes.view(f"V{width}").ravel(), return_inverse=True)[1]))
    rows, place = suffixes[order], place[order]
    common = np.zeros(n, np.int64)
    unlike = rows[1:] != rows[:-1]
    common[1:] = np.where(unlike.any(1), unlike.argmax(1), width)
    behind = np.zeros(n, np.int64)
    behind[:-1] = common[1:]
    factors = np.maximum(smaller_neighbours(place, common), smaller_neighbours(place[::-1], behind[::-1])[::-1])
    out = np.empty(n, np.int64)
    out[order] = factors
    return out


def _pack(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _found(docs: DataFrame, n_buckets: int, window: int, gram: int, hot: int) -> DataFrame:
    """Step one: doc_id, mark, start, stop, kind: 0 bytes [start, stop) go; 1 windows of [start, stop) are open, 2 of a hot gram."""
    def send(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        grams, whole, ids, marks, first, more = (np.concatenate(c) for c in zip(*held, strict=True))
        order, new, behind = _earlier((ids, marks, first), (grams, whole))
        bucket = mix(grams) % U(n_buckets)
        rows = []
        again = order[behind]
        if len(again):  # repeats within this task need no one's word; they pass through the exchange as they are
            spread = mix(ids[again].astype(U)) % U(n_buckets)
            for b in np.unique(spread):
                at = again[spread == b]
                rows.append((int(b), 0, b"", b"", *(x[at].tobytes() for x in (ids, marks, first, more))))
        kept = order[new]
        kept = kept[np.argsort(bucket[kept], kind="stable")]
        own = bucket[kept].astype(np.int64)
        edges = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = kept[a:b]
            rows.append((int(own[a]), 1, *(x[at].tobytes() for x in (grams, whole, ids, marks, first, more))))
        yield _pack(rows, ["bucket", "kind", "grams", "whole", "ids", "marks", "first", "more"], [pa.int32(), pa.int32(), *[pa.binary()] * 6])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for part, texts in _slices(batches):
            ids, marks = part.column("doc_id").to_numpy(), part.column("mark").to_numpy()
            for i, text in enumerate(texts):
                grams, first, last, whole = runs(np.frombuffer(text, np.uint8), window, gram)
                if len(grams):
                    held.append((grams, whole, np.full(len(grams), ids[i]), np.full(len(grams), marks[i]), first.astype(np.int32), (last - first).astype(np.uint8)))
                    count += len(grams)
            if count >= HELD_RUNS:
                yield from send(held)
                held, count = [], 0
        if count:
            yield from send(held)

    kinds = {"grams": "<u8", "whole": "<u8", "ids": "<i8", "marks": "<i4", "first": "<i4", "more": "u1"}

    def out(ids, marks, first, more, kind) -> pa.Table:
        return pa.table({"doc_id": ids, "mark": marks, "start": first, "stop": first + more + np.int32(window), "kind": kind.astype(np.int32)})

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        trim()
        done = table.filter(pc.equal(table.column("kind"), 0))
        made = []
        if done.num_rows:
            x = {c: np.concatenate([np.frombuffer(v, kinds[c]) for v in done.column(c).to_pylist()]) for c in ("ids", "marks", "first", "more")}
            made.append(out(x["ids"], x["marks"], x["first"], x["more"], np.zeros(len(x["ids"]))))
        table = table.filter(pc.equal(table.column("kind"), 1))
        if table.num_rows:
            x = {c: np.concatenate([np.frombuffer(v, t) for v in table.column(c).to_pylist()]) for c, t in kinds.items()}
            order, new, behind = _earlier((x["ids"], x["marks"], x["first"]), (x["grams"], x["whole"]))
            x = {c: v[order] for c, v in x.items()}
            made.append(out(*(x[c][behind] for c in ("ids", "marks", "first", "more")), np.zeros(int(behind.sum()))))
            x = {c: v[new] for c, v in x.items()}
            edge = np.flatnonzero(np.concatenate([[True], x["grams"][1:] != x["grams"][:-1], [True]]))
            size = np.repeat(np.diff(edge), np.diff(edge))
            at = size > 1
            made.append(out(*(x[c][at] for c in ("ids", "marks", "first", "more")), np.where(size[at] > hot, 2, 1)))
        return pa.concat_tables(made)

    packed = docs.mapInArrow(run, "bucket int, kind int, " + ", ".join(f"{c} binary" for c in kinds))
    return packed.groupBy("bucket").applyInArrow(compare, "doc_id long, mark int, start int, stop int, kind int")


def lists_of(found: DataFrame) -> DataFrame:
    """Intervals of each document, packed: d_id, d_mark, starts, stops, kinds."""
    return found.groupBy(F.col("doc_id").alias("d_id"), F.col("mark").alias("d_mark")).agg(F.collect_list(F.struct("start", "stop", "kind")).alias("cuts"))


def _windows(docs: DataFrame, open_runs: DataFrame, n_buckets: int, window: int, gram: int) -> DataFrame:
    """Step two: doc_id, mark, start, stop: windows among the open runs that start earlier elsewhere."""
    joined = docs.join(lists_of(open_runs), (F.col("doc_id") == F.col("d_id")) & (F.col("mark") == F.col("d_mark"))).select("doc_id", "mark", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["bucket", "doc_id", "mark", "start", "data"], [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        rows = []
        for part, texts in _slices(batches):
            for doc_id, mark, text, cuts in zip(part.column("doc_id").to_pylist(), part.column("mark").to_pylist(), texts, part.column("cuts").to_pylist(), strict=True):
                raw = np.frombuffer(text, np.uint8)
                grams, first, last, _ = runs(raw, window, gram)
                by_start = dict(zip(first.tolist(), (mix(grams) % U(n_buckets)).tolist(), strict=True))
                sums = None
                for cut in cuts:
                    start, stop = cut["start"], cut["stop"]
                    if cut["kind"] == 1:
                        rows.append((by_start[start], doc_id, mark, start, text[start:stop]))
                    else:
                        sums = prefix(raw) if sums is None else sums
                        at = np.arange(start, stop - window + 1)
                        own = (spans(sums, at, at + window) % U(n_buckets)).astype(np.int64)
                        rows += [(int(b), doc_id, mark, int(a), text[a : a + window]) for a, b in zip(at, own, strict=True)]
                if len(rows) > 5_000:
                    yield _pack(rows, names, types)
                    rows = []
        if rows:
            yield _pack(rows, names, types)

    def order(key: tuple, table: pa.Table) -> pa.Table:
        trim()
        data = table.column("data").combine_chunks()
        sizes = pc.binary_length(data).to_numpy().astype(np.int64)
        raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        count = sizes - window + 1
        row = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        at = begin[row] + inside
        ids, marks = table.column("doc_id").to_numpy()[row], table.column("mark").to_numpy()[row]
        start = table.column("start").to_numpy()[row] + inside
        hashes = spans(prefix(raw), at, at + window)
        # only windows whose fingerprint occurs again are put in suffix order, by their bytes
        _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[back] > 1)
        if not len(again):
            return pa.table({"doc_id": ids[:0], "mark": marks[:0], "start": start[:0].astype(np.int32), "stop": start[:0].astype(np.int32)})
        gone = []
        parts = max(1, len(again) // SORTED_WINDOWS)
        for part in range(parts):  # classes stay together: by fingerprint
            own = again[hashes[again] % U(parts) == part]
            if len(own):
                suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, window)[at[own]])
                gone.append(own[longest_previous(suffixes, (ids[own], marks[own], start[own])) >= window])
        gone = np.concatenate(gone) if gone else np.zeros(0, np.int64)
        if not len(gone):
            return pa.table({"doc_id": ids[:0], "mark": marks[:0], "start": start[:0].astype(np.int32), "stop": start[:0].astype(np.int32)})
        o = np.lexsort((start[gone], marks[gone], ids[gone]))
        ids, marks, start = ids[gone][o], marks[gone][o], start[gone][o]
        # neighbouring windows of a document are one interval
        edge = np.ones(len(ids), bool)
        edge[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]) | (start[1:] > start[:-1] + 1)
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(ids)) - 1
        return pa.table({"doc_id": ids[first], "mark": marks[first], "start": start[first].astype(np.int32), "stop": (start[last] + window).astype(np.int32)})

    moved = joined.mapInArrow(run, "bucket int, doc_id long, mark int, start int, data binary")
    return moved.groupBy("bucket").applyInArrow(order, "doc_id long, mark int, start int, stop int")


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals that the given ones cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT_RUNS, bucket_runs: int = BUCKET_RUNS, keep_columns: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans array<struct<start, stop>>, kept binary; with keep_columns the input's columns, text replaced.

    A text that is replaced loses the bytes of characters that were cut apart.
    """
    spark = docs.sparkSession
    ship(spark)
    top = scratch(spark)
    rows = sorted_rows(docs)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(64, -(-size // (35 * bucket_runs)))
    found = written(_found(rows, n_buckets, window, gram, hot), f"{top}/found")
    released(spark)
    n_open = found.where("kind > 0").agg(F.coalesce(F.sum(F.col("stop") - F.col("start") - (window - 1)), F.lit(0))).first()[0]
    more = written(_windows(rows, found.where("kind > 0"), max(64, -(-n_open // BUCKET_WINDOWS)), window, gram), f"{top}/windows")
    released(spark)
    cuts = found.where("kind = 0").select("doc_id", "mark", "start", "stop").unionByName(more)
    source = docs if keep_columns else rows
    cut_at, d_id, d_mark = unused(source, "_cuts", "_d_id", "_d_mark")
    lists = cuts.groupBy(F.col("doc_id").alias(d_id), F.col("mark").alias(d_mark)).agg(F.collect_list(F.struct("start", "stop")).alias(cut_at))
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    own_mark = F.hash(F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = source.join(lists, (own_id == F.col(d_id)) & (own_mark == F.col(d_mark)), "left").select(*(source[c] for c in source.columns), cut_at)

    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches):
            n, removed, spans_, kept = [], [], [], []
            for text, cuts in zip(texts, part.column(cut_at).to_pylist(), strict=True):
                own = merged([c["start"] for c in cuts], [c["stop"] for c in cuts]) if cuts else []
                at, left = 0, []
                for a, b in own:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                n.append(len(text)), removed.append(sum(b - a for a, b in own)), spans_.append([{"start": a, "stop": b} for a, b in own]), kept.append(b"".join(left))
            if keep_columns:
                yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if c == "text" else part.column(c) for c in names], names)
            else:
                ids = pa.array([None if x == NULL_ID else x for x in part.column("doc_id").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    schema = docs.schema if keep_columns else "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"
    return joined.mapInArrow(cut, schema)
