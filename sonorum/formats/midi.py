"""Standard MIDI files: events, codec, and notes on a tick that is one frame."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from ..errors import FormatError, UnsupportedError
from ..functions.scalar import TEMPI
from ..operators.pursuit import Note

#: Data bytes that follow each channel status, and the events' names.
CHANNEL = {0x8: ("note_off", 2), 0x9: ("note_on", 2), 0xA: ("pressure", 2), 0xB: ("control", 2), 0xC: ("program", 1), 0xD: ("channel_pressure", 1), 0xE: ("bend", 2)}
META = {0x01: "text", 0x02: "copyright", 0x03: "track_name", 0x04: "instrument_name", 0x05: "lyric", 0x06: "marker", 0x07: "cue"}
END, TEMPO, SIGNATURE = 0x2F, 0x51, 0x58
DEFAULT_TEMPO = 500000


@dataclass(frozen=True)
class Event:
    delta: int
    kind: str
    channel: int = 0
    a: int = 0
    b: int = 0
    data: bytes = b""


@dataclass
class Track:
    events: list[Event] = field(default_factory=list)

    @property
    def name(self) -> str | None:
        return next((e.data.decode("utf-8", "replace") for e in self.events if e.kind == "track_name"), None)


@dataclass
class MidiFile:
    division: int
    tracks: list[Track]
    kind: int = 1

    def tempo(self) -> int | None:
        return next((e.a for t in self.tracks for e in t.events if e.kind == "tempo"), None)


def vlq(value: int) -> bytes:
    """Seven bits a byte, all but the last marked."""
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(0x80 | value & 0x7F)
    return bytes(reversed(out))


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FormatError("MIDI data end early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def vlq(self) -> int:
        value = 0
        for _ in range(4):
            b = self.byte()
            value = value << 7 | b & 0x7F
            if b < 0x80:
                return value
        raise FormatError("a MIDI number is too long")


def _message(e: Event) -> bytes:
    for status, (kind, n) in CHANNEL.items():
        if e.kind == kind:
            return bytes([status << 4 | e.channel & 15, e.a & 127, e.b & 127][: n + 1])
    if e.kind == "sysex":
        return b"\xf0" + vlq(len(e.data)) + e.data
    if e.kind == "tempo":
        return b"\xff\x51\x03" + e.a.to_bytes(3)
    if e.kind == "time_signature":
        return b"\xff\x58\x04" + bytes([e.a, max(0, e.b.bit_length() - 1), 24, 8])
    if e.kind == "end":
        return b"\xff\x2f\x00"
    code = next((k for k, v in META.items() if v == e.kind), e.a)
    return bytes([0xFF, code]) + vlq(len(e.data)) + e.data


def encode(m: MidiFile) -> bytes:
    """[S22]"""
    out = [b"MThd", struct.pack(">IHHH", 6, m.kind, len(m.tracks), m.division)]
    for t in m.tracks:
        body = b"".join(vlq(e.delta) + _message(e) for e in t.events)
        if not t.events or t.events[-1].kind != "end":
            body += b"\0\xff\x2f\x00"
        out += [b"MTrk", struct.pack(">I", len(body)), body]
    return b"".join(out)


def _track(data: bytes) -> Track:
    r, out, running = Reader(data), [], None
    while r.at < len(data):
        delta, status = r.vlq(), r.byte()
        if status < 0x80:
            if running is None:
                raise FormatError("a MIDI track begins with running status")
            r.at -= 1
            status = running
        if status == 0xFF:
            code = r.byte()
            body = r.take(r.vlq())
            if code == END:
                out.append(Event(delta, "end"))
                break
            if code == TEMPO and len(body) == 3:
                out.append(Event(delta, "tempo", a=int.from_bytes(body)))
            elif code == SIGNATURE and len(body) >= 2:
                out.append(Event(delta, "time_signature", a=body[0], b=1 << body[1]))
            else:
                out.append(Event(delta, META.get(code, "meta"), a=code, data=body))
        elif status in (0xF0, 0xF7):
            out.append(Event(delta, "sysex", data=r.take(r.vlq())))
            running = None
        elif status >> 4 in CHANNEL:
            running = status
            kind, n = CHANNEL[status >> 4]
            body = r.take(n)
            out.append(Event(delta, kind, status & 15, body[0], body[1] if n > 1 else 0))
        else:
            raise FormatError(f"an unknown MIDI status {status:#x}")
    return Track(out)


def decode(data: bytes) -> MidiFile:
    """[S22] Chunks of other names are skipped."""
    r = Reader(data)
    if r.take(4) != b"MThd":
        raise FormatError("not a MIDI file")
    head = r.take(int.from_bytes(r.take(4)))
    if len(head) < 6:
        raise FormatError("the MIDI header is too short")
    kind, count, division = struct.unpack_from(">HHH", head)
    if division >> 15:
        raise UnsupportedError("MIDI time in frames a second")
    tracks = []
    while r.at + 8 <= len(data) and len(tracks) < count:
        name, size = r.take(4), int.from_bytes(r.take(4))
        body = r.take(size)
        if name == b"MTrk":
            tracks.append(_track(body))
    return MidiFile(division, tracks, kind)


def timing(rate: int) -> tuple[int, int]:
    """[P28] Tempo and division with one tick a frame."""
    for tempo in TEMPI:
        if rate * tempo % 1_000_000 == 0 and 1 <= rate * tempo // 1_000_000 <= 32767:
            return tempo, rate * tempo // 1_000_000
    raise UnsupportedError(f"no MIDI timing fits a sample rate of {rate}")


def from_notes(notes: list[Note], rate: int, name: str) -> MidiFile:
    """[D24 W17] A tempo track, then a track for every channel up to the last; ends go before starts of their tick."""
    tempo, division = timing(rate)
    tracks = [Track([Event(0, "track_name", data=name.encode()), Event(0, "tempo", a=tempo), Event(0, "end")])]
    for c in range(max((n.channel for n in notes), default=-1) + 1):
        ticks = sorted((t, on, n.note, n.velocity) for n in notes if n.channel == c for t, on in ((n.start, 1), (n.start + n.length, 0)))
        events, last = [Event(0, "track_name", data=f"channel {c + 1}".encode())], 0
        for tick, on, note, velocity in ticks:
            events.append(Event(tick - last, "note_on" if on else "note_off", c % 16, note, velocity if on else 0))
            last = tick
        tracks.append(Track([*events, Event(0, "end")]))
    return MidiFile(division, tracks)


def to_notes(m: MidiFile, rate: int) -> list[Note]:
    """[D25 W18 J10 O3] Starts meet the ends that follow, latest start first; channels are the tracks that hold notes."""
    tempo, out, channel = m.tempo() or DEFAULT_TEMPO, [], 0
    frames = lambda ticks: ticks * tempo * rate // (m.division * 1_000_000) if m.division else 0
    for t in m.tracks:
        tick, open_, own = 0, {}, []
        for e in t.events:
            tick += e.delta
            if e.kind == "note_on" and e.b:
                open_.setdefault(e.a, []).append((tick, e.b))
            elif e.kind in ("note_on", "note_off") and open_.get(e.a):
                start, velocity = open_[e.a].pop()
                own.append(Note(channel, frames(start), frames(tick) - frames(start), e.a, velocity, 440 * 2.0 ** ((e.a - 69) / 12), 1.0))
        if own:
            out += own
            channel += 1
    return sorted(out, key=lambda n: (n.channel, n.start, n.note))
