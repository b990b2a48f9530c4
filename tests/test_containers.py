import numpy as np
import pytest

from sonorum.errors import FormatError, UnsupportedError
from sonorum.sources import aiff, audio, flac, wav
from sonorum.sources.audio import Audio

RNG = np.random.default_rng(1)


def recording(format_, channels=2, frames=5000):
    t = np.arange(frames) / 8000
    x = np.stack([0.4 * np.sin(2 * np.pi * (220 + 110 * c) * t) + 0.05 * RNG.standard_normal(frames) for c in range(channels)])
    return Audio(8000, format_, x).quantized() if not format_.startswith("f") else Audio(8000, format_, x.astype(np.float32))


@pytest.mark.parametrize("format_", ["pcm_u8", "pcm_i16", "pcm_i24", "pcm_i32", "f32", "f64"])
@pytest.mark.parametrize("container", ["wav", "aiff", "flac"])
@pytest.mark.parametrize("channels", [1, 2, 3])
def test_round_trip(format_, container, channels):
    own = recording(format_, channels)
    if container != "wav" and format_.startswith("f"):
        with pytest.raises(UnsupportedError):
            audio.encode(own, container)
        return
    data = audio.encode(own, container)
    assert audio.container_of(data) == container
    back = audio.decode(data)
    assert (back.sample_rate, back.format) == (8000, format_)
    assert np.array_equal(back.channels, own.channels)
    assert audio.encode(back, container) == data


def test_flac_is_small():
    t = np.arange(20000) / 44100
    sine = Audio(44100, "pcm_i16", np.stack([0.5 * np.sin(2 * np.pi * 440 * t)] * 2)).quantized()
    assert len(flac.encode(sine)) < 0.5 * 20000 * 2 * 2
    assert len(flac.encode(Audio.silence(44100, "pcm_i16", 2, 100000))) < 2000


def test_checksums():
    assert flac.crc8(b"123456789") == 0xF4
    assert flac.crc16(b"123456789") == 0xFEE8


def test_damage_is_found():
    data = bytearray(flac.encode(recording("pcm_i16")))
    data[-100] ^= 1
    with pytest.raises(FormatError):
        flac.decode(bytes(data))
    for bad in (b"", b"RIFF1234WAVE", b"FORM1234AIFF", b"fLaC"):
        with pytest.raises(FormatError):
            audio.decode(bad)


def test_extended_floats():
    for value in (8000.0, 44100.0, 192000.0, 1.0):
        assert aiff.read_extended(aiff.write_extended(value)) == value


def test_wav_extensible_and_odd_chunks():
    data = wav.encode(recording("pcm_i16", 1, 7))
    form = data[20:36]
    extensible = b"\xfe\xff" + form[2:] + b"\x16\x00\x10\x00\x04\x00\x00\x00" + b"\x01\x00" + bytes(14)
    body = data[44:]
    made = b"RIFF\0\0\0\0WAVE" + b"LIST\x03\0\0\0abc\0" + b"fmt " + len(extensible).to_bytes(4, "little") + extensible + b"data" + len(body).to_bytes(4, "little") + body
    assert np.array_equal(wav.decode(made).channels, wav.decode(data).channels)


def test_narrowest():
    assert Audio(8000, "f64", [[0.5, -1.0]]).narrowest() == "pcm_u8"
    assert Audio(8000, "f64", [[0.5, 2**-15]]).narrowest() == "pcm_i16"
    assert Audio(8000, "f64", [[0.5, 2**-15]]).narrowest("pcm_i24") == "pcm_i24"
    assert Audio(8000, "f64", [[1.0]]).narrowest() == "f32"
    assert Audio(8000, "f64", [[0.1]]).narrowest() == "f64"


def kinds_of(samples, bits):
    _, kind, _, spare = flac._plan(np.asarray(samples, np.int64), bits)
    return kind, spare


def test_flac_takes_the_cheapest_subframe(monkeypatch):
    rng = np.random.default_rng(6)
    ring = np.zeros(9001)
    for t in range(2, len(ring)):  # a resonance that no fixed predictor follows
        ring[t] = 1.2 * ring[t - 1] - 0.95 * ring[t - 2] + rng.standard_normal()
    codes = np.round(ring / np.abs(ring).max() * 30000).astype(np.int64)
    assert kinds_of(codes[:4096], 16) == ("fitted", 0)
    assert kinds_of(np.arange(500) ** 2 // 16, 16)[0] == "fixed"
    assert kinds_of(rng.integers(-32768, 32768, 400), 16) == ("verbatim", 0)
    assert kinds_of(np.full(50, -3), 16) == ("constant", 0)
    own = Audio.from_codes(8000, "pcm_i16", np.stack([codes, -codes[::-1]]))
    data = flac.encode(own)
    assert np.array_equal(flac.decode(data).codes(), own.codes())
    monkeypatch.setattr(flac, "ORDERS", 0)
    assert len(data) < 0.9 * len(flac.encode(own))


@pytest.mark.parametrize("format_", ["pcm_i16", "pcm_i24", "pcm_i32"])
def test_flac_leaves_unused_bits_out(format_):
    fine = np.random.default_rng(8).integers(-128, 128, (1, 5000))
    wide = Audio.from_codes(8000, format_, fine << 8)
    assert kinds_of(fine[0] << 8, 32)[1] == 8
    data = flac.encode(wide)
    assert np.array_equal(flac.decode(data).codes(), wide.codes())
    assert len(data) < 1.1 * 5000
    for frames in (1, 2, 3, 13, 4097):  # blocks shorter than the orders, a last block of one sample
        edge = Audio.from_codes(8000, format_, np.where(np.arange(frames) % 3, 0, -(1 << (int(format_[5:]) - 1)))[None])
        assert np.array_equal(flac.decode(flac.encode(edge)).codes(), edge.codes())
