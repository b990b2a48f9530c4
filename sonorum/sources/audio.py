"""Dense recordings in memory and their containers, as NumPy; what the functions of the executors work on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..errors import FormatError, InvalidArgumentError, MismatchError, UnsupportedError
from ..model import FORMATS


@dataclass
class Audio:
    """channels: float64, one row a channel."""

    sample_rate: int
    format: str
    channels: np.ndarray

    def __post_init__(self) -> None:
        self.channels = np.atleast_2d(np.asarray(self.channels, np.float64))
        if self.sample_rate <= 0:
            raise InvalidArgumentError("the sample rate must be positive")
        if not self.channels.shape[0]:
            raise InvalidArgumentError("a recording needs a channel")

    @classmethod
    def silence(cls, rate: int, format_: str, channels: int, frames: int) -> Audio:
        return cls(rate, format_, np.zeros((channels, frames)))

    @classmethod
    def from_codes(cls, rate: int, format_: str, codes: np.ndarray) -> Audio:
        quantum = FORMATS[format_][2]
        if quantum is None:
            raise InvalidArgumentError("floating formats have no codes")
        return cls(rate, format_, np.atleast_2d(codes) * quantum)

    @property
    def frames(self) -> int:
        return self.channels.shape[1]

    def codes(self) -> np.ndarray | None:
        quantum = FORMATS[self.format][2]
        return None if quantum is None else half_away(self.channels / quantum).astype(np.int64)

    def quantized(self) -> Audio:
        return Audio(self.sample_rate, self.format, quantize(self.channels, self.format))

    def exact_in(self, format_: str) -> bool:
        return exact_in(self.channels, format_)

    def narrowest(self, floor: str = "pcm_u8") -> str:
        """The narrowest format, not narrower than the floor and floating if it is, that keeps every sample."""
        bits, is_float = FORMATS[floor][:2]
        return next((k for k, v in FORMATS.items() if v[0] >= bits and (v[1] or not is_float) and exact_in(self.channels, k)), "f64")

    def ensure_like(self, other: Audio) -> None:
        for what, a, b in (("rates", self.sample_rate, other.sample_rate), ("channels", len(self.channels), len(other.channels)), ("frames", self.frames, other.frames)):
            if a != b:
                raise MismatchError(f"{what} differ: {a} and {b}")

    def difference(self, other: Audio) -> Audio:
        self.ensure_like(other)
        return Audio(self.sample_rate, self.format, self.channels - other.channels)

    def segment(self, start: int, length: int) -> np.ndarray:
        """Slice, filled up with zeros behind the end."""
        out = np.zeros((len(self.channels), length))
        own = self.channels[:, start : start + length]
        out[:, : own.shape[1]] = own
        return out

    def mono(self) -> np.ndarray:
        total = np.zeros(self.frames)
        for channel in self.channels:
            total = total + channel
        return total / len(self.channels)


def half_away(x: np.ndarray) -> np.ndarray:
    """Nearest integer, halves away from zero."""
    whole = np.trunc(x)
    return whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0.0)


def quantize(x: np.ndarray, format_: str) -> np.ndarray:
    _, is_float, quantum, low, high = FORMATS[format_]
    return x if is_float else np.clip(half_away(x / quantum), low, high) * quantum


def exact_in(x: np.ndarray, format_: str) -> bool:
    _, is_float, quantum, low, high = FORMATS[format_]
    if format_ == "f64":
        return True
    if is_float:
        return bool((x.astype(np.float32).astype(np.float64) == x).all())
    code = half_away(x / quantum)
    return bool(((code >= low) & (code <= high) & (code * quantum == x)).all())


def to_planar(data: bytes, kind: str, channels: int, big: bool = False, signed_8: bool = False) -> np.ndarray:
    """Interleaved sample bytes of a format as float64 rows."""
    order = ">" if big else "<"
    width = FORMATS[kind][0] // 8
    data = data[: len(data) // (width * channels) * width * channels]
    if kind == "pcm_u8":
        codes = np.frombuffer(data, np.int8).astype(np.int64) if signed_8 else np.frombuffer(data, np.uint8).astype(np.int64) - 128
    elif kind == "pcm_i24":
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
        raw = raw[:, ::-1] if big else raw
        codes = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
        codes -= (codes >> 23) << 24
    elif kind in ("f32", "f64"):
        return np.frombuffer(data, f"{order}f{width}").astype(np.float64).reshape(-1, channels).T.copy()
    else:
        codes = np.frombuffer(data, f"{order}i{width}").astype(np.int64)
    return (codes * FORMATS[kind][2]).reshape(-1, channels).T.copy()


def from_planar(audio: Audio, big: bool = False, signed_8: bool = False) -> bytes:
    order, kind = (">" if big else "<"), audio.format
    width = FORMATS[kind][0] // 8
    flat = audio.channels.T.ravel()
    if kind in ("f32", "f64"):
        return flat.astype(f"{order}f{width}").tobytes()
    _, _, quantum, low, high = FORMATS[kind]
    codes = np.clip(half_away(flat / quantum), low, high).astype(np.int64)
    if kind == "pcm_u8":
        return codes.astype(np.int8).tobytes() if signed_8 else (codes + 128).astype(np.uint8).tobytes()
    if kind == "pcm_i24":
        parts = [(codes >> s & 0xFF).astype(np.uint8) for s in (0, 8, 16)]
        return np.stack(parts[::-1] if big else parts, 1).tobytes()
    return codes.astype(f"{order}i{width}").tobytes()


def container_of(data: bytes) -> str | None:
    """By leading bytes."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return "wav"
    if data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC"):
        return "aiff"
    return "flac" if data[:4] == b"fLaC" else None


def decode(data: bytes) -> Audio:
    """Any container."""
    from . import aiff, flac, wav

    kind = container_of(data)
    if kind is None:
        raise FormatError("neither WAV nor AIFF nor FLAC")
    return {"wav": wav, "aiff": aiff, "flac": flac}[kind].decode(data)


def encode(audio: Audio, container: str) -> bytes:
    from . import aiff, flac, wav

    if container not in ("wav", "aiff", "flac"):
        raise UnsupportedError(f"unknown container: {container}")
    return {"wav": wav, "aiff": aiff, "flac": flac}[container].encode(audio)
