"""Writing and reading projects by format name or extension."""

from __future__ import annotations

import os
import re

from ..errors import InvalidArgumentError, UnsupportedError
from . import daw, midi, musicxml, sfz
from .session_model import Session

#: Formats in the order they are written, their extensions, titles and other names.
FORMATS = {
    "midi": ("mid", "MIDI", ("mid", "smf")),
    "musicxml": ("musicxml", "MusicXML", ("xml", "score")),
    "dawproject": ("dawproject", "DAWproject", ("bitwig", "daw")),
    "ableton": ("als", "Ableton Live", ("als", "live")),
    "flstudio": ("flp", "FL Studio", ("flp", "fl", "fl-studio")),
    "reaper": ("rpp", "REAPER", ("rpp",)),
    "ardour": ("ardour", "Ardour", ()),
    "lmms": ("mmp", "LMMS", ("mmp",)),
    "sfz": ("sfz", "SFZ", ()),
}


def format_of(text: str) -> str:
    key = text.strip().lower()
    found = next((k for k, (ext, _, more) in FORMATS.items() if key in (k, ext, *more)), None)
    if not found:
        raise InvalidArgumentError(f"unknown project format: {text}")
    return found


def formats_of(texts: list[str]) -> list[str]:
    """Lists with commas; all; none, which ends it."""
    out: list[str] = []
    for word in (w.strip().lower() for t in texts for w in t.split(",")):
        if word == "none":
            return []
        for name in FORMATS if word == "all" else [format_of(word)] if word else []:
            if name not in out:
                out.append(name)
    return out


def stem(s: Session) -> str:
    """[P33]"""
    name = re.sub(r'[/\\:*?"<>|]', "-", s.name).strip(" ").strip(".")
    return name or "project"


def files_of(s: Session, format_: str, audio=None) -> dict[str, bytes]:
    """The files of one format by relative path, the project first; audio: gives the bytes of a clip's file or nothing."""
    name = f"{stem(s)}.{FORMATS[format_][0]}"
    if format_ == "ardour":
        text, more = daw.write_ardour(s)
        return {name: text.encode(), **more}
    if format_ == "dawproject":
        held = {f: data for f in s.files() if audio and (data := audio(f)) is not None}
        return {name: daw.write_dawproject(s, held)}
    made = {
        "midi": lambda: midi.encode(midi.from_notes(s.notes(), s.sample_rate, s.name)), "musicxml": lambda: musicxml.write(s), "ableton": lambda: daw.write_ableton(s), "flstudio": lambda: daw.write_flstudio(s),
        "reaper": lambda: daw.write_reaper(s), "lmms": lambda: daw.write_lmms(s), "sfz": lambda: sfz.write(s),
    }[format_]()
    return {name: made if isinstance(made, bytes) else made.encode()}


def write_these(folder: str, s: Session, formats: list[str] | None = None) -> list[str]:
    """[S35] Paths of the files written under a folder."""
    out = []

    def beside(f: str) -> bytes | None:
        path = os.path.join(folder, f)
        return open(path, "rb").read() if os.path.isfile(path) else None

    for format_ in FORMATS if formats is None else formats:
        for name, data in files_of(s, format_, beside).items():
            path = os.path.join(folder, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(data)
            out.append(path)
    return out


def read(path: str) -> Session:
    """By extension; MIDI, MusicXML and SFZ are no sessions."""
    ext = os.path.splitext(path)[1].lstrip(".").lower()
    with open(path, "rb") as f:
        data = f.read()
    name = os.path.splitext(os.path.basename(path))[0]

    def beside(file: str) -> bytes | None:
        full = os.path.join(os.path.dirname(path), file)
        return open(full, "rb").read() if os.path.isfile(full) else None

    readers = {
        "dawproject": lambda: daw.read_dawproject(data), "als": lambda: daw.read_ableton(data), "flp": lambda: daw.read_flstudio(data), "rpp": lambda: daw.read_reaper(data.decode()),
        "ardour": lambda: daw.read_ardour(data.decode(), beside), "mmp": lambda: daw.read_lmms(data.decode(), name),
    }
    if ext not in readers:
        raise UnsupportedError(f"a session cannot be read from .{ext}")
    return readers[ext]()
