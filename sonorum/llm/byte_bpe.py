"""Byte-level BPE encoding and decoding over Arrow batches.

Encoding goes through the tokenizers library (see :mod:`tokens`).  A byte-level
vocabulary spells every byte as one printable character; the byte table maps
those back, so a token's bytes, and with them byte and character offsets, follow
from its id alone.  A character may be split between tokens: its offsets then
are those of the one character for each of them, and decoding joins bytes before
it reads characters.

Defined results: null text is empty text; empty text has no ids and decodes to
no bytes; a null list of ids decodes as an empty one; null ids in a list and ids
outside the vocabulary raise; repeated rows give repeated results; columns other
than doc_id and text are not carried on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ship, text_slices
from .tokens import byte_characters, byte_encoder, vocabulary

VOCABULARY = "byte_bpe_50k.json"

_tables: dict[str, list[bytes]] = {}


def byte_table(name: str = VOCABULARY) -> list[bytes]:
    """The bytes of each id."""
    if name not in _tables:
        with open(vocabulary(name), encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: bytes([b]) for b, c in byte_characters().items()}
        vocab = dict(spec["model"]["vocab"])
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        table = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            table[i] = token.encode() if token in special else b"".join(map(back.__getitem__, token))
        for token, i in special.items():
            table[i] = token.encode()
        _tables[name] = table
    return _tables[name]


def char_offsets(text: str, ids: np.ndarray, name: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """First character and end character (exclusive) that each token's bytes belong to."""
    sizes = np.fromiter(map(len, map(byte_table(name).__getitem__, ids)), np.int64, len(ids))
    ends = np.cumsum(sizes)
    raw = np.frombuffer(text.encode(), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
    return (char_of[ends - sizes], char_of[ends - 1] + 1) if len(ids) else (ends, ends)


def packed_lists(parts: list[bytes], kind=pa.int32()) -> pa.Array:
    """Lists of 4-byte integers from their packed bytes."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(kind, int(ends[-1]), [None, pa.py_buffer(b"".join(parts))]))


def encode(docs: DataFrame, name: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int>; with offsets also char_start and char_end array<int>."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            packed = byte_encoder(name)(texts)
            columns = [part.column("doc_id"), packed_lists(packed)]
            if offsets:
                both = [char_offsets(x, np.frombuffer(p, "<u4"), name) for x, p in zip(texts, packed, strict=True)]
                columns += [packed_lists([x[k].astype("<i4").tobytes() for x in both]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "char_start", "char_end"][: len(columns)])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", char_start array<int>, char_end array<int>" * offsets)


def decode(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, decoded binary, text string (bytes that are no UTF-8 become U+FFFD)."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [b"".join(map(table.__getitem__, x or ())) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], ["doc_id", "ids", "decoded", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
