"""Functions for SQL, where columns of built-in functions cannot say it: Arrow batches of arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


PITCH = _struct(frequency=T.DoubleType(), confidence=T.DoubleType())
ALIGNMENT = _struct(start=T.LongType(), gain_num=T.LongType(), remainder=T.DoubleType())
LINK_ROW = _struct(pos=T.IntegerType(), id=T.StringType(), value=T.StringType())
NOTE_ROW = _struct(channel=T.IntegerType(), start=T.LongType(), length=T.LongType(), note=T.IntegerType(), velocity=T.IntegerType())
REGION_ROW = _struct(sample=T.StringType(), low=T.IntegerType(), high=T.IntegerType(), center=T.IntegerType(), low_channel=T.IntegerType(), high_channel=T.IntegerType())


def fingerprint_of(x) -> int:
    """[P12] Multiply-and-xor over the length and the bits of every value; equal for 0.0 and -0.0."""
    return int(fingerprints_of([x])[0])


def fingerprints_of(waveforms: list) -> np.ndarray:
    """[P12] Of many waveforms: one step for each place, over all waveforms that reach it."""
    arrays = [np.asarray(x, np.float64) + 0.0 for x in waveforms]
    sizes = np.array([len(x) for x in arrays], np.int64)
    order = np.argsort(-sizes, kind="stable")
    value, prime = np.full(len(arrays), 0xCBF29CE484222325, np.uint64), np.uint64(0x100000001B3)
    value = (value ^ sizes[order].astype(np.uint64)) * prime
    longest = int(sizes.max(initial=0))
    words = np.zeros((longest, len(arrays)), np.uint64)
    for k, i in enumerate(order):
        words[: sizes[i], k] = arrays[i].view(np.uint64)
    reach = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), "right")
    for place in range(longest):
        n = reach[place]
        value[:n] = (value[:n] ^ words[place, :n]) * prime
    out = np.empty(len(arrays), np.int64)
    out[order] = value.view(np.int64)
    return out


@F.pandas_udf(T.LongType())
def waveform_fingerprint(column: pd.Series) -> pd.Series:
    known = column.notna().to_numpy()
    out = pd.Series([None] * len(column), dtype="Int64")
    at = np.flatnonzero(known)
    for start in range(0, len(at), 512):  # so many at once
        some = at[start : start + 512]
        out.iloc[some] = fingerprints_of([column.iloc[i] for i in some])
    return out


@F.pandas_udf(DOUBLES)
def magnitude_spectrum(column: pd.Series) -> pd.Series:
    """[D2]"""
    from ..operators import dsp

    return column.map(lambda x: None if x is None else dsp.magnitude_spectrum(np.asarray(x, float)))


@F.pandas_udf(DOUBLES)
def cross_correlate(region: pd.Series, pattern: pd.Series) -> pd.Series:
    """[D3]"""
    from ..operators import dsp

    return pd.Series([dsp.cross_correlate(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(region, pattern, strict=True)])


@F.pandas_udf(PITCH)
def estimate_pitch(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
    """[D9]"""
    from ..operators import dsp

    found = [dsp.yin(np.asarray(x, float), int(r)) or (None, None) for x, r in zip(samples, rate, strict=True)]
    return pd.DataFrame(found, columns=["frequency", "confidence"], dtype=float)


@F.pandas_udf(ALIGNMENT)
def align(signal: pd.Series, anchor: pd.Series, pattern: pd.Series, radius: pd.Series) -> pd.DataFrame:
    """[D16] Nulls where nothing fits."""
    from ..model import MatchOptions
    from ..operators.pursuit import best_alignment

    rows = []
    for s, a, p, r in zip(signal, anchor, pattern, radius, strict=True):
        found = best_alignment(np.asarray(s, float), int(a), np.asarray(p, float), MatchOptions(radius=int(r)))
        rows.append((found.start, found.gain, found.remainder) if found else (None, None, None))
    out = pd.DataFrame(rows, columns=["start", "gain_num", "remainder"])
    return out.astype({"start": "Int64", "gain_num": "Int64", "remainder": float})


@F.pandas_udf(T.StringType())
def links_encode(column: pd.Series) -> pd.Series:
    """[P31]"""
    from ..sources.lino import encode

    return column.map(lambda x: None if x is None else encode(x))


FUNCTIONS = {"waveform_fingerprint": waveform_fingerprint, "magnitude_spectrum": magnitude_spectrum, "cross_correlate": cross_correlate, "estimate_pitch": estimate_pitch, "align": align, "links_encode": links_encode}


@F.udtf(returnType=LINK_ROW)
class LinksRows:
    """[S20] A links document as rows: a link's values by position, or one row without."""

    def eval(self, text: str):
        from ..sources.lino import Link, parse

        for node in parse(text or ""):
            if isinstance(node, Link):
                for k, v in enumerate(node.values):
                    yield k, node.id, str(v)
            else:
                yield 0, None, node


@F.udtf(returnType=NOTE_ROW)
class MidiNotes:
    """[D25] The notes of a MIDI file at a sample rate."""

    def eval(self, content: bytes, rate: int):
        from ..formats import midi

        for n in midi.to_notes(midi.decode(bytes(content)), rate):
            yield n.channel, n.start, n.length, n.note, n.velocity


@F.udtf(returnType=REGION_ROW)
class SfzRegions:
    """[S31]"""

    def eval(self, text: str):
        from ..formats import sfz

        for r in sfz.parse(text or ""):
            yield r.sample, r.low, r.high, r.center, r.low_channel, r.high_channel


TABLES = {"links_rows": LinksRows, "midi_notes": MidiNotes, "sfz_regions": SfzRegions}


def register(spark: SparkSession) -> None:
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    for name, f in TABLES.items():
        spark.udtf.register(name, f)
