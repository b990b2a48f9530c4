"""The arrangement that project formats share: tracks of clips and notes, and instruments."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..model import GAIN_ONE, SessionOptions
from ..operators import dsp
from ..operators.pursuit import Decomposition, Note

#: Fixed value: distinct times below which a tempo is not measured.
LEAST_TIMES = 8


@dataclass
class Clip:
    name: str
    file: str
    start: int
    offset: int
    length: int
    gain: float = 1.0
    channel: int = 0


@dataclass
class Track:
    name: str
    kind: str = "audio"  # or "instrument"
    clips: list[Clip] = field(default_factory=list)
    notes: list[Note] = field(default_factory=list)

    @property
    def end(self) -> int:
        return max([0, *(c.start + c.length for c in self.clips), *(n.start + n.length for n in self.notes)])


@dataclass
class Instrument:
    name: str
    file: str
    frames: int
    note: int | None = None


@dataclass
class Session:
    name: str
    sample_rate: int
    channels: int
    frames: int
    tempo: float = 120.0
    tracks: list[Track] = field(default_factory=list)
    instruments: list[Instrument] = field(default_factory=list)

    @property
    def end(self) -> int:
        """[A18]"""
        return max([self.frames, *(t.end for t in self.tracks)])

    def seconds(self, frames: int) -> float:
        """[P30]"""
        return frames / self.sample_rate if self.sample_rate else 0.0

    def beats(self, frames: int) -> float:
        return self.seconds(frames) * self.tempo / 60

    def frames_of_beats(self, beats: float) -> int:
        return round(beats * 60 / self.tempo * self.sample_rate)

    def audio_tracks(self) -> list[Track]:
        return [t for t in self.tracks if t.kind == "audio"]

    def instrument_tracks(self) -> list[Track]:
        return [t for t in self.tracks if t.kind == "instrument"]

    def notes(self) -> list[Note]:
        return [n for t in self.tracks for n in t.notes]

    def files(self) -> list[str]:
        """[S36] Each file once, in the order of first use."""
        return list(dict.fromkeys([c.file for t in self.tracks for c in t.clips] + [i.file for i in self.instruments]))


def lane_name(name: str, channel: int, channels: int) -> str:
    """[P34]"""
    if channels == 1:
        return name
    return f"{name} {'LR'[channel]}" if channels == 2 and channel < 2 else f"{name} {channel + 1}"


def clip_of(name: str, file: str, start: int, frames: int, gain: float, channel: int) -> Clip | None:
    """[P37] Cut at the beginning of the timeline only."""
    offset = max(0, -start)
    return Clip(name, file, max(0, start), offset, frames - offset, gain, channel) if frames > offset else None


def measured_tempo(rate: int, starts: list[int], options: SessionOptions) -> float:
    """[D27] The tempo of placements and notes, where it is certain enough; else the one asked for."""
    if not options.estimate or not rate:
        return options.tempo
    times: list[float] = []
    for t in sorted(s / rate for s in starts if s >= 0):
        if not times or t - times[-1] > 1e-9:
            times.append(t)
    found = dsp.tempo_of_onsets(times) if len(times) >= LEAST_TIMES else None
    return found.bpm if found and found.confidence >= options.confidence else options.tempo


def session_of(d: Decomposition, options: SessionOptions = SessionOptions(), files: dict[str, str] | None = None) -> Session:
    """[D26 U3] Stems, a lane for each sample and channel, the residual, notes; in this order.

    files: names of audio files by "stem/<name>", "sample/<id>" and "residual".
    """
    files = files or {}
    out = Session(d.name, d.sample_rate, d.channels, d.frames)
    out.tempo = measured_tempo(d.sample_rate, [p.start for p in d.placements] + [n.start for n in d.notes], options)
    if options.stems:
        for name, _ in d.stems:
            out.tracks.append(Track(name, "audio", [Clip(name, files.get(f"stem/{name}", f"stems/{name}.wav"), 0, 0, d.frames)]))
    if options.bank:
        for s in d.samples:
            for c in range(d.channels):
                made = (clip_of(s.name, files.get(f"sample/{s.id}", f"samples/{s.name}.wav"), p.start, len(s.waveform), p.gain / GAIN_ONE, c) for p in d.placements if p.sample == s.id and p.channel == c)
                if clips := [x for x in made if x]:
                    out.tracks.append(Track(lane_name(s.name, c, d.channels), "audio", clips))
        out.instruments = [Instrument(s.name, files.get(f"sample/{s.id}", f"samples/{s.name}.wav"), len(s.waveform), s.note) for s in d.samples]
    if options.residual and d.residual is not None:
        out.tracks.append(Track("residual", "audio", [Clip("residual", files.get("residual", "residual.wav"), 0, 0, d.frames)]))
    if options.notes and d.notes:
        for c in sorted({n.channel for n in d.notes}):
            out.tracks.append(Track(lane_name("notes", c, d.channels), "instrument", notes=[n for n in d.notes if n.channel == c]))
    return out
