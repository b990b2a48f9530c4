"""Archives: a manifest as links text, waveforms as WAV files beside it; and as tables."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FormatError, InputOutputError, MismatchError
from ..operators.pursuit import Decomposition, Sample
from . import wav
from .audio import Audio
from .lino import Manifest, ensure

MANIFEST_FILE = "decomposition.lino"


def resolve(folder: str, file: str) -> str:
    """[S17] Files lie within the archive."""
    parts = file.split("/")
    if not file or file.startswith("/") or "\\" in file or any(p in ("", ".", "..") for p in parts):
        raise FormatError(f"a file outside the archive: {file}")
    return os.path.join(folder, *parts)


def _write(path: str, audio: Audio) -> None:
    """[S19] In the narrowest format that keeps every sample."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(wav.encode(Audio(audio.sample_rate, audio.narrowest(), audio.channels)))


def _read(path: str) -> Audio:
    try:
        with open(path, "rb") as f:
            return wav.decode(f.read())
    except OSError as e:
        raise InputOutputError(f"{path}: {e.strerror}") from e


def write(folder: str, d: Decomposition) -> Manifest:
    """[S12] Files that are there already and not of this archive stay."""
    m = Manifest.of(d)
    os.makedirs(folder, exist_ok=True)
    for (_, file), (_, stem) in zip(m.stems, d.stems, strict=True):
        _write(resolve(folder, file), stem)
    for entry, s in zip(m.samples, d.samples, strict=True):
        _write(resolve(folder, entry.file), Audio(d.sample_rate, d.format, s.waveform))
    for file, audio in ((m.residual, d.residual), (m.correction, d.correction)):
        if file and audio is not None:
            _write(resolve(folder, file), audio)
    with open(os.path.join(folder, MANIFEST_FILE), "w", encoding="utf-8") as f:
        f.write(m.text())
    return m


def read_manifest(folder: str) -> Manifest:
    """[S13] No audio is touched."""
    try:
        with open(os.path.join(folder, MANIFEST_FILE), encoding="utf-8") as f:
            return Manifest.of_text(f.read())
    except OSError as e:
        raise InputOutputError(f"{folder}: {e.strerror}") from e


def read(folder: str) -> Decomposition:
    """[S14 S15 S16]"""
    m = read_manifest(folder)
    d = Decomposition(m.name, m.sample_rate, m.format, m.channels, m.frames, placements=m.placements, notes=m.notes)

    def full(file: str) -> Audio:
        a = _read(resolve(folder, file))
        ensure((a.sample_rate, len(a.channels), a.frames), (m.sample_rate, m.channels, m.frames), file)
        return Audio(a.sample_rate, m.format, a.channels)

    d.stems = [(name, full(file)) for name, file in m.stems]
    for k, e in enumerate(m.samples):
        ensure(e.id, k, f"the id of {e.name}")
        a = _read(resolve(folder, e.file))
        ensure(len(a.channels), 1, f"channels of {e.file}")
        ensure(a.frames, e.frames, f"frames of {e.file}")
        s = Sample(e.id, e.name, a.channels[0], e.note, e.frequency)
        ensure(s.peak, e.peak, f"the peak of {e.file}")
        d.samples.append(s)
    if bad := [p for p in m.placements if not 0 <= p.sample < len(m.samples)]:
        raise MismatchError(f"a placement of sample {bad[0].sample}, which the bank does not hold")
    d.residual = full(m.residual)
    d.correction = full(m.correction) if m.correction else None
    return d


def check_tables(placements: DataFrame, bank: DataFrame, signals: DataFrame) -> DataFrame:
    """what, n: placements without a sample, and signals whose lengths differ within a recording; no rows if all is well [S15 J14]."""
    dangling = placements.join(bank, ["recording_id", "sample_id"], "left_anti").agg(F.lit("dangling placements").alias("what"), F.count(F.lit(1)).alias("n"))
    uneven = signals.groupBy("recording_id").agg(F.count_distinct(F.size("samples")).alias("sizes")).where("sizes > 1").agg(F.lit("uneven recordings").alias("what"), F.count(F.lit(1)).alias("n"))
    return dangling.unionByName(uneven).where("n > 0")


def same_audio(a: Audio, b: Audio) -> bool:
    return (a.sample_rate, a.channels.shape) == (b.sample_rate, b.channels.shape) and np.array_equal(a.channels, b.channels)
