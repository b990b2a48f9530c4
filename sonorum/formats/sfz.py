"""SFZ instruments: the bank across the keyboard."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParseError
from .session_model import Session

DRUM_CHANNEL, FIRST_DRUM = 10, 36


@dataclass(frozen=True)
class Region:
    sample: str
    low: int
    high: int
    center: int
    low_channel: int = 1
    high_channel: int = 9


def regions(s: Session) -> list[Region]:
    """[W19 W20] Zones of pitched instruments meet half-way; the others take a drum key each."""
    pitched: dict[int, str] = {}
    for i in s.instruments:
        if i.note is not None:
            pitched.setdefault(i.note, i.file)
    notes = sorted(pitched)
    out = []
    for k, n in enumerate(notes):
        low = notes[k - 1] + -(-(n - notes[k - 1]) // 2) if k else 0
        high = n + -(-(notes[k + 1] - n) // 2) - 1 if k + 1 < len(notes) else 127
        out.append(Region(pitched[n], low, high, n))
    drums = [i.file for i in s.instruments if i.note is None][: 128 - FIRST_DRUM]
    return out + [Region(f, FIRST_DRUM + k, FIRST_DRUM + k, FIRST_DRUM + k, DRUM_CHANNEL, DRUM_CHANNEL) for k, f in enumerate(drums)]


def write(s: Session) -> str:
    """[S31]"""
    out = [f"// {s.name}: {len(s.instruments)} samples, {s.sample_rate} Hz", "<global> ampeg_attack=0 ampeg_release=0.05"]
    for title, own in (("pitched", [r for r in regions(s) if r.low_channel < DRUM_CHANNEL]), ("unpitched", [r for r in regions(s) if r.low_channel >= DRUM_CHANNEL])):
        if own:
            out.append(f"<group> // {title}")
            out += [f"<region> lokey={r.low} hikey={r.high} pitch_keycenter={r.center} lochan={r.low_channel} hichan={r.high_channel} sample={r.sample}" for r in own]
    return "\n".join(out) + "\n"


def parse(text: str) -> list[Region]:
    """Opcodes of groups hold for the regions below them; a sample's name may hold spaces."""
    text = re.sub(r"//[^\n]*", "", text)
    out, shared = [], {}
    for header, body in re.findall(r"<(\w+)>([^<]*)", text):
        own = {k: v.strip() for k, v in re.findall(r"(\w+)=(.*?)(?=\s+\w+=|\s*$|\n)", body, re.S)}
        if header == "region":
            o = shared | own
            try:
                out.append(Region(o["sample"], *(int(o.get(k, d)) for k, d in (("lokey", 0), ("hikey", 127), ("pitch_keycenter", 60), ("lochan", 1), ("hichan", 16)))))
            except (KeyError, ValueError) as e:
                raise ParseError(f"a region that cannot be read: {e}") from e
        elif header in ("group", "global"):
            shared = own if header == "global" else shared | own
    return out
