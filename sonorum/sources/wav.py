"""WAV: PCM of 8 to 32 bits and floats of 32 and 64, plain and extensible."""

from __future__ import annotations

import struct

from ..errors import FormatError, UnsupportedError
from .audio import Audio, from_planar, to_planar

#: Format tags of the container.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
KINDS = {(PCM, 8): "pcm_u8", (PCM, 16): "pcm_i16", (PCM, 24): "pcm_i24", (PCM, 32): "pcm_i32", (FLOAT, 32): "f32", (FLOAT, 64): "f64"}


def chunks(data: bytes, at: int, order: str):
    """Name and body of each chunk; chunks begin at even places."""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from(f"{order}I", data, at + 4)[0]
        yield name, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def decode(data: bytes) -> Audio:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise FormatError("not a WAV file")
    form = body = None
    for name, content in chunks(data, 12, "<"):
        if name == b"fmt " and form is None:
            if len(content) < 16:
                raise FormatError("the fmt chunk is too short")
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content)
            if tag == EXTENSIBLE:
                if len(content) < 26:
                    raise FormatError("the extensible fmt chunk is too short")
                tag = struct.unpack_from("<H", content, 24)[0]
            form = tag, channels, rate, bits
        elif name == b"data" and body is None:
            body = content
    if form is None or body is None:
        raise FormatError("a WAV file needs fmt and data chunks")
    tag, channels, rate, bits = form
    if (tag, bits) not in KINDS:
        raise UnsupportedError(f"WAV format {tag} of {bits} bits")
    if not channels:
        raise FormatError("a WAV file needs a channel")
    kind = KINDS[tag, bits]
    return Audio(rate, kind, to_planar(body, kind, channels))


def encode(audio: Audio) -> bytes:
    tag, bits = next(k for k, v in KINDS.items() if v == audio.format)
    channels, width = len(audio.channels), bits // 8
    form = struct.pack("<HHIIHH", tag, channels, audio.sample_rate, audio.sample_rate * channels * width, channels * width, bits)
    body = from_planar(audio)
    parts = [(b"fmt ", form + (b"\0\0" if tag == FLOAT else b""))]
    if tag == FLOAT:
        parts.append((b"fact", struct.pack("<I", audio.frames)))
    parts.append((b"data", body))
    out = b"".join(n + struct.pack("<I", len(c)) + c + b"\0" * (len(c) & 1) for n, c in parts)
    return b"RIFF" + struct.pack("<I", len(out) + 4) + b"WAVE" + out
