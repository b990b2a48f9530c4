import io
import os

import numpy as np
import pytest
from fixtures import repetitive_loop, wide_stereo

from sonorum import cli
from sonorum.errors import FormatError, InvalidArgumentError, MismatchError, ParseError, UnsupportedError
from sonorum.formats import daw, midi, musicxml, project, sfz
from sonorum.formats.session_model import Session, SessionOptions, Track, session_of
from sonorum.operators import arrange
from sonorum.operators.pursuit import Decomposition, Note, Placement, Sample, decompose_audio, verify
from sonorum.sources import archive, lino
from sonorum.sources.audio import Audio
from sonorum.sources.lino import Link, Manifest, Store


@pytest.fixture(scope="module")
def loop():
    audio = wide_stereo(8000, "pcm_i16")
    return audio, decompose_audio("my loop", audio)


@pytest.fixture(scope="module")
def session(loop):
    return session_of(loop[1], SessionOptions(estimate=False))


def note(channel, start, length, key, velocity=90):
    return Note(channel, start, length, key, velocity, 440 * 2 ** ((key - 69) / 12), 1.0)


NOTES = [note(0, 0, 4000, 60, 100), note(0, 4000, 2000, 64, 1), note(0, 4000, 2000, 67, 127), note(1, 8000, 1000, 36)]


def test_midi_round_trip():
    m = midi.from_notes(NOTES, 8000, "x")
    assert len(m.tracks) == 3 and m.tempo() == 500000 and m.division == 4000
    back = midi.to_notes(midi.decode(midi.encode(m)), 8000)
    assert [(n.channel, n.start, n.length, n.note, n.velocity) for n in back] == sorted((n.channel, n.start, n.length, n.note, n.velocity) for n in NOTES)
    assert midi.encode(midi.decode(midi.encode(m))) == midi.encode(m)


def test_midi_reads_running_status_and_refuses_damage():
    track = bytes([0, 0x90, 60, 100, 10, 60, 0, 0, 0xFF, 0x2F, 0])
    data = b"MThd\0\0\0\6\0\0\0\1\0\x60" + b"XXXX\0\0\0\1z" + b"MTrk" + len(track).to_bytes(4) + track
    assert [(n.note, n.velocity) for n in midi.to_notes(midi.decode(data), 44100)] == [(60, 100)]
    with pytest.raises(FormatError):
        midi.decode(b"nothing")
    with pytest.raises(FormatError):
        midi.decode(data[:-6])
    with pytest.raises(UnsupportedError):
        midi.timing(44101)


@pytest.mark.parametrize("value", [0, 127, 128, 16383, 16384, 2**28 - 1])
def test_vlq(value):
    assert midi.Reader(midi.vlq(value)).vlq() == value


def close(a, b, off):
    return [(t.name, t.kind, len(t.clips), len(t.notes)) for t in a.tracks] == [(t.name, t.kind, len(t.clips), len(t.notes)) for t in b.tracks] and all(
        abs(x.start - y.start) <= off and abs(x.length - y.length) <= off and abs(x.offset - y.offset) <= off and x.file == y.file for s, t in zip(a.tracks, b.tracks, strict=True) for x, y in zip(s.clips, t.clips, strict=True)
    )


@pytest.mark.parametrize(("write", "read", "off"), [
    (daw.write_dawproject, daw.read_dawproject, 0), (daw.write_ableton, daw.read_ableton, 0), (daw.write_reaper, daw.read_reaper, 0),
    (lambda s: daw.write_ardour(s)[0], lambda t: daw.read_ardour(t), 0),
])
def test_projects_read_back(session, write, read, off):
    own = read(write(session))
    if write.__name__ == "<lambda>":
        own.tracks = [t for t in own.tracks if t.kind == "audio"]
        reference = Session(session.name, session.sample_rate, session.channels, session.frames, session.tempo, session.audio_tracks())
    else:
        reference = session
    assert own.sample_rate == session.sample_rate and abs(own.tempo - session.tempo) < 1e-5
    assert close(own, reference, off)
    for s, t in zip(own.tracks, reference.tracks, strict=True):
        assert [c.gain for c in s.clips] == pytest.approx([c.gain for c in t.clips])
        ticks = 5 if write is daw.write_reaper else 0  # its notes lie on 960 ticks a beat
        for m, n in zip(*(sorted(x.notes, key=lambda n: (n.note, n.start)) for x in (s, t)), strict=True):
            assert (m.note, m.velocity) == (n.note, n.velocity) and abs(m.start - n.start) <= ticks and abs(m.length - n.length) <= ticks


def test_ardour_keeps_notes_beside(session):
    text, files = daw.write_ardour(session)
    assert daw.read_ardour(text, files.get).notes() and len(daw.read_ardour(text, files.get).notes()) == len(session.notes())
    with pytest.raises(FormatError):
        daw.read_ardour(text.replace("sample-rate", "rate"))


def test_lmms_loses_ticks_and_rate(session):
    own = daw.read_lmms(daw.write_lmms(session), session.name)
    assert own.sample_rate == 48000 and len(own.notes()) == len(session.notes())
    assert [t.name for t in own.tracks] == [t.name for t in session.tracks]


def test_flstudio_keeps_instruments(session):
    own = daw.read_flstudio(daw.write_flstudio(session))
    assert [i.file for i in own.instruments] == [i.file for i in session.instruments]
    assert len(own.notes()) == len(session.notes()) and own.sample_rate == session.sample_rate
    with pytest.raises(ParseError):
        daw.fl_events(b"\xc0\x05ab")
    with pytest.raises(FormatError):
        daw.read_flstudio(b"no")


def test_musicxml():
    s = Session("score", 8000, 2, 40000, 120.0, [Track("a", "instrument", notes=[note(0, 0, 4000, 60), note(0, 4000, 20000, 64), note(0, 4000, 20000, 67), note(0, 32000, 4000, 61)])])
    text = musicxml.write(s)
    back = musicxml.read(text, 8000)
    assert [(n.start, n.length, n.note) for n in back] == [(0, 4000, 60), (4000, 20000, 64), (4000, 20000, 67), (32000, 4000, 61)]
    assert all(n.velocity == 90 for n in back)
    assert "<rest" in text and 'type="start"' in text


def test_sfz(session):
    s = Session("bank", 8000, 1, 0)
    from sonorum.formats.session_model import Instrument

    s.instruments = [Instrument("a", "samples/a b.wav", 1, 60), Instrument("b", "samples/b.wav", 1, 65), Instrument("c", "samples/c.wav", 1, None), Instrument("d", "samples/d.wav", 1, 60)]
    own = sfz.regions(s)
    assert [(r.low, r.high, r.center) for r in own] == [(0, 62, 60), (63, 127, 65), (36, 36, 36)]
    assert sfz.parse(sfz.write(s)) == own
    with pytest.raises(ParseError):
        sfz.parse("<region> lokey=x")


def test_formats_of():
    assert project.formats_of(["midi, RPP", "als,mid"]) == ["midi", "reaper", "ableton"]
    assert len(project.formats_of(["all"])) == 9 and project.formats_of(["midi", "none", "all"]) == []
    with pytest.raises(InvalidArgumentError):
        project.formats_of(["what"])


def test_links_text_and_store():
    text = "(a: b (c d) (e: f))\n(g)\nh\n"
    assert lino.format_(lino.parse(text)) == "(a: b (c d) (e: f))\n(g)\nh\n"
    for bad in ("(a", "a)"):
        with pytest.raises(ParseError):
            lino.parse(bad)
    store = Store()
    a, b = store.symbol("a"), store.symbol("b")
    assert store.create(a, b) == store.create(a, b) and len(store) == 3 and store.create(a, a) == a
    assert store.by_source(a) == [3] and store.by_target(b) == [3] and store.describe(3) == "(a b)"
    assert store.sequence([a, b, a]) == store.create(store.create(a, b), a)
    document = [Link("x", ("1", Link(None, ("k", "v")))), Link("x", ("1", Link(None, ("k", "v"))))]
    root = store.store(document)
    size = len(store)
    assert store.read(root) == document and store.store(document) == root and len(store) == size
    with pytest.raises(FormatError):
        store.read(a)


def test_percent():
    assert lino.encode("a (b) c: d\té%") == "a%20%28b%29%20c%3A%20d%09%C3%A9%25"
    assert lino.decode(lino.encode("a (b) c: d\té%")) == "a (b) c: d\té%" and lino.decode(lino.encode("")) == ""
    for bad in ("%4", "%zz", "%FF"):
        with pytest.raises(FormatError):
            lino.decode(bad)


def test_manifest(loop):
    m = Manifest.of(loop[1])
    again = Manifest.of_text(m.text())
    assert again == m and again.text() == m.text()
    store = Store()
    assert Manifest.of_document(store.read(store.store(m.document()))) == m
    for bad in (m.text().replace("version 1", "version 2"), m.text() + "(what: 1)\n", "(placement: a)\n"):
        with pytest.raises(FormatError):
            Manifest.of_text(bad)


def test_archive(loop, tmp_path):
    audio, d = loop
    folder = str(tmp_path / "a")
    m = archive.write(folder, d)
    back = archive.read(folder)
    assert archive.read_manifest(folder) == m and np.array_equal(back.reconstruct().channels, audio.channels)
    assert verify(back, audio).exact
    for bad in ("../x", "/x", "a//b", ""):
        with pytest.raises(FormatError):
            archive.resolve(folder, bad)
    path = os.path.join(folder, archive.MANIFEST_FILE)
    text = open(path).read()
    open(path, "w").write(text + "(placement: 9999 0 0 65536)\n")
    with pytest.raises(MismatchError):
        archive.read(folder)


def test_unique_names():
    taken = set()
    assert [lino.unique("a.wav", taken) for _ in range(3)] == ["a.wav", "a-2.wav", "a-3.wav"]


def test_resample_and_voices():
    assert arrange.resample(np.arange(4.0), 2).tolist() == [0, 2] and arrange.resample(np.array([0.0, 1]), 0.5).tolist() == [0, 0.5, 1, 0.5]
    assert not len(arrange.resample(np.arange(4.0), 0))
    bank = [Sample(0, "a", np.ones(4), 60), Sample(1, "b", np.ones(4), 69)]
    assert arrange.voice_for(bank, 72) == (1, 2 ** 0.25) and arrange.voice_for(bank, 48) == (0, 0.5) and arrange.voice_for([], 60) is None
    d = Decomposition("x", 8000, "pcm_i16", 1, 100, samples=bank)
    audio = arrange.arrange(d, [note(0, 10, 50, 60, 127), note(1, 0, 50, 69, 127)])
    assert len(audio.channels) == 2 and audio.frames == 10 + 4 + 8000 and audio.channels[0, 10] == 1 - 2**-15


def test_session_tempo():
    d = Decomposition("t", 8000, "pcm_i16", 1, 80000, samples=[Sample(0, "s", np.ones(10))], placements=[Placement(0, 0, k * 4000, 65536) for k in range(16)])
    assert abs(session_of(d).tempo - 120) < 2
    assert session_of(d, SessionOptions(tempo=90, estimate=False)).tempo == 90
    d.placements = d.placements[:4]
    assert session_of(d, SessionOptions(tempo=77)).tempo == 77
    d.placements = [Placement(0, 0, -4, 65536), Placement(0, 0, -10, 65536)]
    assert [(c.start, c.offset, c.length) for t in session_of(d).tracks for c in t.clips] == [(0, 4, 6)]


def test_commands(tmp_path, capsys):
    audio = repetitive_loop(8000, "pcm_i16", 1)
    path = str(tmp_path / "song.wav")
    cli.save(path, audio)
    out = io.StringIO()
    assert cli.main(["decompose", path, "--formats", "all"], out) == 0
    folder = str(tmp_path / "song.decomposition")
    assert "exact: yes" in out.getvalue() and {f"song.{e}" for e in ("mid", "musicxml", "dawproject", "als", "flp", "rpp", "ardour", "mmp", "sfz")} <= set(os.listdir(folder))
    for ext in ("dawproject", "als", "flp", "rpp", "ardour", "mmp"):
        s = project.read(os.path.join(folder, f"song.{ext}"))
        assert all(os.path.isfile(os.path.join(folder, f)) for f in s.files() if not f.endswith(".mid"))
    with pytest.raises(UnsupportedError):
        project.read(os.path.join(folder, "song.mid"))
    assert cli.main(["verify", folder, path, "--strict"], out) == 0
    again = str(tmp_path / "again.flac")
    assert cli.main(["compose", folder, "-o", again], out) == 0 and np.array_equal(cli.load(again).channels, audio.channels)
    assert cli.main(["inspect", folder], out) == 0 and cli.main(["inspect", path], out) == 0
    assert cli.main(["export", folder, "--formats", "reaper", "--tempo", "100"], out) == 0
    assert abs(project.read(os.path.join(folder, "song.rpp")).tempo - 100) < 1e-6
    assert cli.main(["render", folder, os.path.join(folder, "song.mid"), str(tmp_path / "r.wav")], out) == 0
    assert cli.main(["decompose", path, "--formats", "nothing"], out) == 1 and "nothing" in capsys.readouterr().err
    other = str(tmp_path / "other.wav")
    cli.save(other, Audio(8000, "pcm_i16", audio.channels * 0.5).quantized())
    assert cli.main(["verify", folder, other, "--strict"], out) == 1
