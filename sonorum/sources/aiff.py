"""AIFF and uncompressed AIFF-C: big-endian integers of 8 to 32 bits."""

from __future__ import annotations

import math
import struct

from ..errors import FormatError, UnsupportedError
from .audio import Audio, from_planar, to_planar
from .wav import chunks

KINDS = {8: "pcm_u8", 16: "pcm_i16", 24: "pcm_i24", 32: "pcm_i32"}


def read_extended(raw: bytes) -> float:
    """An 80-bit float: sign and exponent, then an explicit 64-bit mantissa."""
    head, mantissa = struct.unpack(">HQ", raw)
    value = math.ldexp(mantissa, (head & 0x7FFF) - 16383 - 63)
    return -value if head >> 15 else value


def write_extended(value: float) -> bytes:
    if value <= 0:
        return bytes(10)
    fraction, exponent = math.frexp(value)
    return struct.pack(">HQ", exponent - 1 + 16383, int(math.ldexp(fraction, 64)))


def decode(data: bytes) -> Audio:
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise FormatError("not an AIFF file")
    common = body = None
    for name, content in chunks(data, 12, ">"):
        if name == b"COMM" and common is None:
            if len(content) < 18:
                raise FormatError("the COMM chunk is too short")
            common = (*struct.unpack_from(">hIh", content), read_extended(content[8:18]))
            if data[8:12] == b"AIFC" and content[18:22] != b"NONE":
                raise UnsupportedError("compressed AIFF-C")
        elif name == b"SSND" and body is None:
            if len(content) < 8:
                raise FormatError("the SSND chunk is too short")
            body = content[8 + struct.unpack_from(">I", content)[0] :]
    if common is None or body is None:
        raise FormatError("an AIFF file needs COMM and SSND chunks")
    channels, frames, bits, rate = common
    if bits not in KINDS:
        raise UnsupportedError(f"AIFF of {bits} bits")
    need = frames * channels * bits // 8
    if len(body) < need:
        raise FormatError("the SSND chunk ends early")
    return Audio(round(rate), KINDS[bits], to_planar(body[:need], KINDS[bits], channels, big=True, signed_8=True))


def encode(audio: Audio) -> bytes:
    bits = next((k for k, v in KINDS.items() if v == audio.format), None)
    if bits is None:
        raise UnsupportedError("AIFF keeps integer samples only")
    common = struct.pack(">hIh", len(audio.channels), audio.frames, bits) + write_extended(float(audio.sample_rate))
    sound = bytes(8) + from_planar(audio, big=True, signed_8=True)
    out = b"".join(n + struct.pack(">I", len(c)) + c + b"\0" * (len(c) & 1) for n, c in ((b"COMM", common), (b"SSND", sound)))
    return b"FORM" + struct.pack(">I", len(out) + 4) + b"AIFF" + out
