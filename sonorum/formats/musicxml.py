"""MusicXML scores: notes on a grid of eighths of a beat, chords, ties and rests."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.pursuit import Note
from .daw import note
from .session_model import Session
from .xmltree import Tree, document, number, parse, tag

#: Lengths in eighths of a beat with their names and dots, longest first; steps of the twelve notes.
VALUES = ((32, "whole", 0), (24, "half", 1), (16, "half", 0), (12, "quarter", 1), (8, "quarter", 0), (6, "eighth", 1), (4, "eighth", 0), (3, "16th", 1), (2, "16th", 0), (1, "32nd", 0))
STEPS = (("C", 0), ("C", 1), ("D", 0), ("D", 1), ("E", 0), ("F", 0), ("F", 1), ("G", 0), ("G", 1), ("A", 0), ("A", 1), ("B", 0))
SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


@dataclass(frozen=True)
class ScoreOptions:
    divisions: int = 8
    beats: int = 4
    beat_type: int = 4

    @property
    def bar(self) -> int:
        return self.divisions * 4 * self.beats // self.beat_type


def split(length: int) -> list[tuple[int, str, int]]:
    """[P41] Greedy parts of a length."""
    out = []
    for v in VALUES:
        while length >= v[0]:
            out.append(v)
            length -= v[0]
    return out


def chords(notes: list[Note], s: Session, o: ScoreOptions) -> list[tuple[int, int, list[Note]]]:
    """[D28 A21] Start and length on the grid, and the notes, each held until the next chord at most."""
    grid = lambda frames: round(s.beats(frames) * o.divisions)
    groups: dict[int, list[Note]] = {}
    for n in notes:
        groups.setdefault(grid(n.start), []).append(n)
    starts = sorted(groups)
    out = []
    for k, at in enumerate(starts):
        length = min(max(1, grid(n.length)) for n in groups[at])
        if k + 1 < len(starts):
            length = min(length, starts[k + 1] - at)
        out.append((at, max(1, length), sorted({n.note: n for n in groups[at]}.values(), key=lambda n: n.note)))
    return out


def _note(n: Note | None, value: tuple, chord: bool, tied: tuple[bool, bool], voice: int = 1) -> Tree:
    length, kind, dots = value
    out = tag("note", {} if n is None else {"dynamics": f"{n.velocity * 100 / 90:.6f}"})
    if chord:
        out.append(tag("chord"))
    if n is None:
        out.append(tag("rest"))
    else:
        step, alter = STEPS[n.note % 12]
        out.append(tag("pitch", {}, tag("step", text=step), *([tag("alter", text="1")] if alter else []), tag("octave", text=str(n.note // 12 - 1))))
    out.append(tag("duration", text=str(length)))
    ties = [t for t, there in zip(("stop", "start"), tied, strict=True) if there and n is not None]
    out.extend(tag("tie", {"type": t}) for t in ties)
    out.extend([tag("voice", text=str(voice)), tag("type", text=kind), *(tag("dot") for _ in range(dots))])
    if ties:
        out.append(tag("notations", {}, *(tag("tied", {"type": t}) for t in ties)))
    return out


def _part(id_: str, found: list, s: Session, o: ScoreOptions) -> Tree:
    """[J8 W21] Chords are cut at bar lines; rests fill the gaps."""
    bars = max(1, -(-max((a + n for a, n, _ in found), default=0) // o.bar))
    pieces: dict[int, list] = {b: [] for b in range(bars)}
    for at, length, notes in found:
        first, end = at, at + length
        while at < end:
            to = min(end, (at // o.bar + 1) * o.bar)
            pieces[at // o.bar].append((at % o.bar, to - at, notes, at > first, to < end))
            at = to
    part = tag("part", {"id": id_})
    for b in range(bars):
        measure, cursor = tag("measure", {"number": b + 1}), 0
        if b == 0:
            time = tag("time", {}, tag("beats", text=str(o.beats)), tag("beat-type", text=str(o.beat_type)))
            measure.append(tag("attributes", {}, tag("divisions", text=str(o.divisions)), tag("key", {}, tag("fifths", text="0")), time, tag("clef", {}, tag("sign", text="G"), tag("line", text="2"))))
            measure.append(tag("sound", {"tempo": f"{s.tempo:.6f}"}))
        for at, length, notes, before, after in [*pieces[b], (o.bar, 0, [], False, False)]:
            measure.extend(_note(None, v, False, (False, False)) for v in split(at - cursor))
            parts = split(length)
            for k, v in enumerate(parts):
                tied = (before or k > 0, after or k + 1 < len(parts))
                measure.extend(_note(n, v, j > 0, tied) for j, n in enumerate(notes))
            cursor = at + length
        part.append(measure)
    return part


def write(s: Session, o: ScoreOptions = ScoreOptions()) -> str:
    """[S24]"""
    tracks = [t for t in s.instrument_tracks() if t.notes] or []
    names = [(f"P{k + 1}", t.name) for k, t in enumerate(tracks)] or [("P1", s.name)]
    listed = tag("part-list", {}, *(tag("score-part", {"id": i}, tag("part-name", text=n)) for i, n in names))
    parts = [_part(f"P{k + 1}", chords(t.notes, s, o), s, o) for k, t in enumerate(tracks)] or [_part("P1", [], s, o)]
    return document(tag("score-partwise", {"version": "4.0"}, tag("work", {}, tag("work-title", text=s.name)), listed, *parts))


def read(text: str, rate: int, tempo: float | None = None) -> list[Note]:
    """[J16] Notes of all parts; a part is a channel; ties go on where the note before of the pitch ends."""
    root = parse(text, "score-partwise")
    sound = next((x.get("tempo") for x in root.iter("sound") if x.get("tempo")), None)
    bpm = tempo or (number(sound, "the tempo") if sound else 120.0)
    out = []
    for channel, part in enumerate(root.findall("part")):
        divisions, cursor, last, held = 8, 0, 0, []
        for measure in part.findall("measure"):
            for e in measure:
                if e.tag == "attributes" and e.findtext("divisions"):
                    divisions = int(e.findtext("divisions"))
                elif e.tag in ("backup", "forward"):
                    cursor += (1 if e.tag == "forward" else -1) * int(e.findtext("duration", "0"))
                elif e.tag == "note" and e.find("grace") is None:
                    length = int(e.findtext("duration", "0"))
                    start = last if e.find("chord") is not None else cursor
                    if e.find("chord") is None:
                        last, cursor = cursor, cursor + length
                    pitch = e.find("pitch")
                    if pitch is None:
                        continue
                    key = SEMITONES[pitch.findtext("step", "C")] + round(float(pitch.findtext("alter", "0"))) + 12 * (int(pitch.findtext("octave", "4")) + 1)
                    beat = start / divisions, length / divisions
                    if any(t.get("type") == "stop" for t in e.findall("tie")):
                        before = next((h for h in reversed(held) if h[2] == key and abs(h[0] + h[1] - beat[0]) < 1e-9), None)
                        if before:
                            before[1] += beat[1]
                            continue
                    velocity = min(127, max(1, round(number(e.get("dynamics", "100"), "dynamics") * 0.9)))
                    held.append([*beat, key, velocity])
        frames = lambda b: round(b * 60 / bpm * rate)  # noqa: B023, E731
        out += [note(channel, frames(b), frames(n), key, v) for b, n, key, v in held]
    return sorted(out, key=lambda n: (n.channel, n.start, n.note))
