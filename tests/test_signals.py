from dataclasses import replace

import numpy as np
import pytest
from fixtures import chord_progression, clicks, pluck, repeated, repetitive_loop, wide_stereo

from sonorum.errors import InvalidArgumentError
from sonorum.model import DecomposeOptions, MatchOptions, PitchOptions, StftOptions
from sonorum.operators import dsp, pursuit
from sonorum.sources.audio import Audio

PLAIN = DecomposeOptions().without_analysis()


@pytest.mark.parametrize("kind", ["rectangular", "hann", "hamming", "blackman"])
@pytest.mark.parametrize("hop", [16, 32, 64])
def test_stft_round_trip(kind, hop):
    x = np.sin(np.arange(1000) * 0.1) + 0.3 * np.cos(np.arange(1000) * 0.37)
    s = dsp.stft(x, 8000, StftOptions(128, hop, kind))
    assert np.abs(dsp.istft(s) - x).max() < 1e-10


def test_hpss_sums():
    x = np.sin(np.arange(4000) * 0.2)
    x[2000:2010] += 0.8
    s = dsp.stft(x, 16000, StftOptions(512, 128))
    a, b = dsp.hpss(s)
    assert np.abs(dsp.istft(a) + dsp.istft(b) - x).max() < 1e-10


def test_transforms_agree():
    x = np.random.default_rng(0).standard_normal(64)
    naive = np.array([(x * np.exp(-2j * np.pi * k * np.arange(64) / 64)).sum() for k in range(64)])
    assert np.allclose(dsp.fft(x), naive)
    assert np.allclose(dsp.fft(dsp.fft(x), inverse=True), x)
    with pytest.raises(InvalidArgumentError):
        dsp.fft(x[:63])
    long, short = np.random.default_rng(1).standard_normal(3000), np.random.default_rng(2).standard_normal(700)
    assert np.allclose(dsp.cross_correlate(long, short), np.correlate(long, short, "valid"))


@pytest.mark.parametrize("note", [40, 52, 60, 69, 81])
def test_yin(note):
    f = 440 * 2 ** ((note - 69) / 12)
    t = np.arange(4096) / 44100
    found = dsp.yin(np.sin(2 * np.pi * f * t) + 0.3 * np.sin(4 * np.pi * f * t), 44100, PitchOptions())
    assert found and abs(found[0] / f - 1) < 0.01 and found[1] > 0.7
    assert pursuit.identify(np.sin(2 * np.pi * f * t), 44100, PitchOptions())[0] == note


def test_yin_has_limits():
    assert dsp.yin(np.zeros(10), 44100) is None
    assert dsp.yin(np.zeros(4096), 0) is None


@pytest.mark.parametrize(("bpm", "off"), [(75, 2), (90, 2), (100, 2), (120, 1), (140, 2), (160, 2)])
def test_tempo(bpm, off):
    found = dsp.tempo_of_flux(clicks(bpm, 20, 0.01), 0.01)
    assert abs(found.bpm - bpm) <= off


def test_tempo_of_onsets():
    assert abs(dsp.tempo_of_onsets(np.arange(0, 20, 0.5)).bpm - 120) <= 1
    assert dsp.tempo_of_onsets([]) is None


def test_triad():
    rate = 44100
    t = np.arange(rate) / rate
    x = sum(np.sin(2 * np.pi * 440 * 2 ** ((n - 69) / 12) * t) for n in (60, 64, 67)) / 3
    notes = {n for _, _, n, _ in dsp.tracked(dsp.stft(x, rate, StftOptions(4096, 1024)))}
    assert {60, 64, 67} <= notes


def test_alignment():
    rng = np.random.default_rng(4)
    pattern = rng.standard_normal(200)
    signal = np.zeros(2000)
    signal[517:717] = 0.5 * pattern
    found = pursuit.best_alignment(signal, 500, pattern, MatchOptions(radius=40))
    assert (found.start, found.gain / 65536) == (517, 0.5) and found.remainder < 1e-6
    assert pursuit.best_alignment(signal, 500, -pattern, MatchOptions(radius=40, inversion=False)) is None
    assert pursuit.best_alignment(signal, 500, np.zeros(200), MatchOptions(radius=40)) is None


def test_realign():
    found = [pursuit.Event(0, 0, 100), pursuit.Event(0, 100, 100), pursuit.Event(0, 200, 100)]
    moved = pursuit.realign(found, [0, 96, None])
    assert [(e.start, e.length) for e in moved] == [(0, 96), (96, 104), (200, 100)]


def test_identical_hits():
    audio = Audio(22050, "pcm_i16", repeated(22050, 4, 5512)).quantized()
    d = pursuit.decompose_audio("hits", audio, PLAIN)
    stored, covered = d.bank_frames()
    assert len(d.samples) == 1 and len(d.placements) == 4
    assert np.abs(d.residual.channels).max() == 0 and covered == 4 * stored


def test_quieter_repeat():
    x = repeated(22050, 2, 4096)[:8192]
    x[4096:] *= 0.5
    audio = Audio(22050, "pcm_i16", x).quantized()
    d = pursuit.decompose_audio("quiet", audio, PLAIN)
    assert len(d.samples) == 1
    assert d.placements[0].gain == 65536 and abs(d.placements[1].gain / 65536 - 0.5) < 0.01
    assert len(pursuit.decompose_audio("exact", audio, PLAIN.exact_only()).samples) == 2


def test_identical_channels_share_the_bank():
    x = repeated(22050, 2, 5512)
    d = pursuit.decompose_audio("stereo", Audio(22050, "pcm_i16", np.stack([x, x])).quantized(), PLAIN)
    assert len(d.samples) == 1 and len(d.placements) == 4


@pytest.mark.parametrize("format_", ["pcm_u8", "pcm_i16", "pcm_i24", "pcm_i32", "f32", "f64"])
def test_reconstruction_is_exact(format_):
    for make in (lambda: repetitive_loop(8000, "pcm_i16", 1), lambda: wide_stereo(8000, "pcm_i16"), lambda: chord_progression(8000, "pcm_i16")):
        own = make()
        audio = Audio(8000, format_, own.channels).quantized()
        d = pursuit.decompose_audio("x", audio)
        report = pursuit.verify(d, audio)
        assert report.exact and report.stem_deviation <= (0 if not format_.startswith("f") else 1e-12)


def test_loop_is_reused():
    audio = repetitive_loop(8000, "pcm_i16", 4)
    d = pursuit.decompose_audio("loop", audio, replace(PLAIN, candidates=8))
    report = pursuit.verify(d, audio)
    assert report.exact and report.reuse >= 4 and report.placements >= 4 * report.samples


def test_tampering_is_seen():
    audio = wide_stereo(8000, "pcm_i16")
    d = pursuit.decompose_audio("x", audio, PLAIN)
    d.residual.channels[0, 10] += 0.25
    assert pursuit.verify(d, audio).deviation == 0.25


def test_silence():
    d = pursuit.decompose_audio("s", Audio.silence(8000, "pcm_i16", 1, 8000))
    assert not d.samples and not d.placements and not d.notes


def test_over_tables(spark):
    rows = []
    for name, audio in (("loop", repetitive_loop(8000, "pcm_i16", 1)), ("wide", wide_stereo(8000, "pcm_u8"))):
        rows += [(name, audio.sample_rate, audio.format, c, audio.frames, x.tolist()) for c, x in enumerate(audio.channels)]
    df = spark.createDataFrame(rows, "recording_id string, sample_rate int, format string, channel int, frames long, samples array<double>")
    parts = pursuit.decompose(df, PLAIN).cache()
    assert pursuit.part(parts, "placement").count() > 8
    back = pursuit.reconstruct(parts, df.select("recording_id", "format", "channel", "frames"))
    joined = df.select("recording_id", "channel", "samples").join(back.withColumnRenamed("samples", "again"), ["recording_id", "channel"]).collect()
    assert len(joined) == 3
    for r in joined:
        assert r["samples"] == r["again"]
    parts.unpersist()


def test_pluck_is_labelled():
    audio = Audio(44100, "pcm_i16", pluck(44100, 440, 22050, 3, 0.5)).quantized()
    d = pursuit.decompose_audio("a4", audio)
    assert any(s.note == 69 and s.name.endswith("-A4") for s in d.samples)
    assert any(n.note == 69 for n in d.notes)
