"""Project formats of sequencers: each a writer and a reader of sessions.

All of them place the same clips and notes; they differ in containers and time
units, which is what each section below says.
"""

from __future__ import annotations

import gzip
import io
import re
import shlex
import struct
import zipfile
from itertools import groupby

from ..errors import FormatError, ParseError
from ..operators.pursuit import Note
from . import midi
from .session_model import Clip, Instrument, Session, Track
from .xmltree import Ids, Tree, document, number, of, parse, tag, value

APP = "sonorum"
#: Fixed value: how a clip's gain is noted where a format has no place for it.
GAIN = "gain="


def decimals(x: float) -> str:
    return f"{x:.9f}"


def note(channel: int, start: int, length: int, key: int, velocity: int) -> Note:
    return Note(channel, start, length, key, velocity, 440 * 2.0 ** ((key - 69) / 12), 1.0)


def span(notes: list[Note]) -> tuple[int, int]:
    """First start and last end."""
    return min((n.start for n in notes), default=0), max((n.start + n.length for n in notes), default=0)


def noted_gain(text: str | None) -> float:
    found = re.search(rf"{GAIN}([-+0-9.eE]+)", text or "")
    return float(found[1]) if found else 1.0


def stretched(s: Session) -> Session:
    s.frames = max(s.frames, s.end)
    return s


# --- DAWproject: a zip of XML and audio; beats, offsets in seconds -------------


def dawproject_xml(s: Session) -> str:
    ids = Ids("id")
    tracks = [(ids(), t) for t in s.tracks]

    def audio(c: Clip) -> Tree:
        inner = tag("Audio", {"algorithm": "raw", "channels": 1, "duration": decimals(s.seconds(c.offset + c.length)), "sampleRate": s.sample_rate, "id": ids()}, tag("File", {"path": c.file}))
        return tag("Clip", {"name": c.name, "time": decimals(s.beats(c.start)), "duration": decimals(s.beats(c.length)), "contentTimeUnit": "seconds", "playStart": decimals(s.seconds(c.offset)), "comment": f"{GAIN}{decimals(c.gain)}"}, inner)

    def played(notes: list[Note]) -> Tree:
        a, b = span(notes)
        rows = [tag("Note", {"time": decimals(s.beats(n.start - a)), "duration": decimals(s.beats(n.length)), "channel": n.channel, "key": n.note, "vel": decimals(n.velocity / 127), "rel": "0.5"}) for n in notes]
        return tag("Clip", {"name": "notes", "time": decimals(s.beats(a)), "duration": decimals(s.beats(b - a)), "playStart": "0.0"}, tag("Notes", {"id": ids()}, *rows))

    structure = [
        tag("Track", {"contentType": "notes" if t.kind == "instrument" else "audio", "loaded": "true", "id": i, "name": t.name}, tag("Channel", {"audioChannels": s.channels, "role": "regular", "id": ids()}))
        for i, t in tracks
    ]
    lanes = [tag("Lanes", {"track": i, "id": ids()}, tag("Clips", {"id": ids()}, *map(audio, t.clips), *([played(t.notes)] if t.notes else []))) for i, t in tracks]
    transport = tag("Transport", {}, tag("Tempo", {"unit": "bpm", "value": f"{s.tempo:.6f}", "min": "20.0", "max": "999.0", "id": ids()}), tag("TimeSignature", {"numerator": 4, "denominator": 4, "id": ids()}))
    return document(tag("Project", {"version": "1.0"}, tag("Application", {"name": APP, "version": "1"}), transport, tag("Structure", {}, *structure), tag("Arrangement", {"id": ids()}, tag("Lanes", {"timeUnit": "beats", "id": ids()}, *lanes))))


def write_dawproject(s: Session, audio: dict[str, bytes] | None = None) -> bytes:
    """[S25 S33] Entries stored, not deflated."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in {"project.xml": dawproject_xml(s), "metadata.xml": document(tag("MetaData", {}, tag("Title", text=s.name), tag("Producer", text=APP))), **(audio or {})}.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def read_dawproject(data: bytes, rate: int | None = None) -> Session:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = parse(z.read("project.xml"), "Project")
            name = parse(z.read("metadata.xml")).findtext("Title") or "" if "metadata.xml" in z.namelist() else ""
    except (zipfile.BadZipFile, KeyError) as e:
        raise FormatError(f"not a DAWproject archive: {e}") from e
    lanes = root.find("Arrangement/Lanes")
    if root.find("Structure") is None or lanes is None:
        raise FormatError("a project needs a structure and an arrangement")
    found = rate or next((int(a.get("sampleRate")) for a in lanes.iter("Audio") if a.get("sampleRate")), None)
    if not found:
        raise FormatError("a project without audio has no sample rate")
    s = Session(name, found, 1, 0, number(of(root, "Transport/Tempo", "value", "120"), "the tempo"))
    beat = lambda x: s.frames_of_beats(number(x, "a time"))
    for t in root.findall("Structure/Track"):
        s.channels = max(s.channels, int(of(t, "Channel", "audioChannels", "1")))
        own = Track(t.get("name", ""), "instrument" if t.get("contentType") == "notes" else "audio")
        for lane in lanes.findall("Lanes"):
            for c in lane.findall("Clips/Clip") if lane.get("track") == t.get("id") else ():
                start = beat(c.get("time"))
                if c.find("Audio") is not None:
                    offset = round(number(c.get("playStart", "0"), "an offset") * found)
                    own.clips.append(Clip(c.get("name", ""), of(c, "Audio/File", "path", ""), start, offset, beat(c.get("duration")), noted_gain(c.get("comment"))))
                for n in c.findall("Notes/Note"):
                    own.notes.append(note(int(n.get("channel", 0)), start + beat(n.get("time")), beat(n.get("duration")), int(n.get("key")), round(number(n.get("vel", "1"), "a velocity") * 127)))
        s.tracks.append(own)
    return stretched(s)


# --- Ableton Live: gzipped XML; beats, notes by key -----------------------------


def ableton_xml(s: Session) -> str:
    ids = Ids()

    def audio(c: Clip) -> Tree:
        a, b = decimals(s.beats(c.start)), decimals(s.beats(c.start + c.length))
        loop = tag("Loop", {}, value("LoopStart", decimals(s.seconds(c.offset))), value("LoopEnd", decimals(s.seconds(c.offset + c.length))), value("StartRelative", 0), value("LoopOn", "false"))
        ref = tag("SampleRef", {}, tag("FileRef", {}, value("RelativePathType", 3), value("RelativePath", c.file), value("Path", c.file)), value("DefaultDuration", c.offset + c.length), value("DefaultSampleRate", s.sample_rate))
        return tag("AudioClip", {"Id": ids(), "Time": a}, value("CurrentStart", a), value("CurrentEnd", b), value("Name", c.name), value("Annotation", f"{GAIN}{decimals(c.gain)}"), loop, ref, value("IsWarped", "false"))

    def played(notes: list[Note]) -> Tree:
        a, b = span(notes)
        keys = []
        for key, own in groupby(sorted(notes, key=lambda n: n.note), lambda n: n.note):
            rows = [tag("MidiNoteEvent", {"Time": decimals(s.beats(n.start - a)), "Duration": decimals(s.beats(n.length)), "Velocity": decimals(n.velocity), "OffVelocity": 64, "IsEnabled": "true"}) for n in own]
            keys.append(tag("KeyTrack", {"Id": ids()}, tag("Notes", {}, *rows), value("MidiKey", key)))
        return tag("MidiClip", {"Id": ids(), "Time": decimals(s.beats(a))}, value("CurrentStart", decimals(s.beats(a))), value("CurrentEnd", decimals(s.beats(b))), value("Name", "notes"), tag("Notes", {}, tag("KeyTracks", {}, *keys)))

    def track(t: Track) -> Tree:
        midi_track = t.kind == "instrument"
        events = tag("Events", {}, *map(audio, t.clips), *([played(t.notes)] if t.notes else []))
        holder = tag("ClipTimeable" if midi_track else "Sample", {}, tag("ArrangerAutomation", {}, events))
        return tag("MidiTrack" if midi_track else "AudioTrack", {"Id": ids()}, tag("Name", {}, value("EffectiveName", t.name), value("UserName", t.name)), tag("DeviceChain", {}, tag("MainSequencer", {}, holder)))

    main = tag("MainTrack", {}, tag("DeviceChain", {}, tag("Mixer", {}, tag("Tempo", {}, value("Manual", f"{s.tempo:.6f}")))))
    return document(tag("Ableton", {"MajorVersion": 5, "MinorVersion": "11.0_433", "SchemaChangeCount": 3, "Creator": APP}, tag("LiveSet", {}, value("Name", s.name), tag("Tracks", {}, *map(track, s.tracks)), main)))


def write_ableton(s: Session) -> bytes:
    """[S26 S34]"""
    return gzip.compress(ableton_xml(s).encode(), 6, mtime=0)


def read_ableton(data: bytes) -> Session:
    try:
        root = parse(gzip.decompress(data), "Ableton")
    except (OSError, EOFError) as e:
        raise FormatError(f"not a Live set: {e}") from e
    rate = next((int(x.get("Value")) for x in root.iter("DefaultSampleRate")), 48000)
    s = Session(of(root, "LiveSet/Name", default=""), rate, 1, 0, number(of(root, ".//MainTrack//Tempo/Manual", default="120"), "the tempo"))
    beat = lambda x: s.frames_of_beats(number(x, "a time"))
    for t in root.find("LiveSet/Tracks") if root.find("LiveSet/Tracks") is not None else ():
        own = Track(of(t, "Name/EffectiveName", default=""), "instrument" if t.tag == "MidiTrack" else "audio")
        for c in t.iter("AudioClip"):
            start, offset = beat(of(c, "CurrentStart")), number(of(c, "Loop/LoopStart", default="0"), "an offset")
            length = round((number(of(c, "Loop/LoopEnd"), "an end") - offset) * rate)
            own.clips.append(Clip(of(c, "Name", default=""), of(c, "SampleRef/FileRef/RelativePath", default=""), start, round(offset * rate), length, noted_gain(of(c, "Annotation"))))
        for c in t.iter("MidiClip"):
            start = beat(of(c, "CurrentStart"))
            for k in c.iter("KeyTrack"):
                own.notes += [note(0, start + beat(n.get("Time")), beat(n.get("Duration")), int(of(k, "MidiKey")), round(number(n.get("Velocity"), "a velocity"))) for n in k.iter("MidiNoteEvent")]
        own.notes.sort(key=lambda n: (n.start, n.note))
        s.tracks.append(own)
    return stretched(s)


# --- FL Studio: typed events; 96 ticks a beat -----------------------------------

#: Fixed values of the event stream: ids, sizes of records, and bases of numbering.
FL = {"kind": 21, "channel": 64, "pattern": 65, "current": 67, "rate": 153, "tempo": 156, "channel_name": 192, "pattern_name": 193, "title": 194, "path": 196, "version": 199, "notes": 224, "playlist": 233, "track_name": 239}
PPQ, PATTERN_BASE, LANE_BASE, NOTE_BYTES, ITEM_BYTES = 96, 0x5000, 500, 24, 32


def fl_event(id_: int, v) -> bytes:
    """The id tells the width: one, two or four bytes, or a length and data."""
    if id_ < 192:
        return bytes([id_]) + int(v).to_bytes(1 << (id_ >> 6), "little")
    body = (v + "\0").encode("utf-16-le") if isinstance(v, str) else v
    size, out = len(body), b""
    while size > 127:
        out, size = out + bytes([0x80 | size & 127]), size >> 7
    return bytes([id_]) + out + bytes([size]) + body


def fl_events(data: bytes) -> list[tuple[int, object]]:
    out, at = [], 0
    try:
        while at < len(data):
            id_, at = data[at], at + 1
            if id_ < 192:
                n = 1 << (id_ >> 6)
                body = data[at : at + n]
                out.append((id_, int.from_bytes(body, "little")))
            else:
                n = shift = 0
                while True:
                    b, at = data[at], at + 1
                    n |= (b & 127) << shift
                    shift += 7
                    if b < 128:
                        break
                body = data[at : at + n]
                out.append((id_, body))
            if len(body) < n:
                raise IndexError
            at += n
    except IndexError:
        raise ParseError("the last event is longer than what is left of the file") from None
    return out


def write_flstudio(s: Session) -> bytes:
    """[S27] Clip gains and channels are lost; clips of no instrument belong to the first."""
    ticks = lambda frames: max(0, round(s.beats(frames) * PPQ))
    where = {i.file: k for k, i in reversed(list(enumerate(s.instruments)))}
    out = [(FL["version"], "20.8.3.2304"), (FL["title"], s.name), (FL["rate"], s.sample_rate), (FL["tempo"], round(s.tempo * 1000))]
    for k, i in enumerate(s.instruments):
        out += [(FL["channel"], k), (FL["kind"], 0), (FL["channel_name"], i.name), (FL["path"], i.file)]
    for k, t in enumerate(s.instrument_tracks()):
        rows = b"".join(struct.pack("<IHHIBBBBBBBBBBBB", ticks(n.start), 0, 0, ticks(n.length), n.note, 0, 120, 0, 128, 0, 128, n.velocity, 128, 128, 0, 0) for n in t.notes)
        out += [(FL["pattern"], k), (FL["current"], k), (FL["pattern_name"], t.name), (FL["notes"], rows)]
    out += [(FL["track_name"], t.name) for t in s.tracks]
    items, pattern = b"", 0
    for k, t in enumerate(s.tracks):
        placed = [(ticks(c.start), where.get(c.file, 0), ticks(c.length), ticks(c.offset)) for c in t.clips]
        if t.kind == "instrument":
            a, b = span(t.notes)
            placed, pattern = [(ticks(a), PATTERN_BASE + pattern, ticks(b - a), 0)], pattern + 1
        for start, source, length, offset in placed:
            items += struct.pack("<IHIHHIfIfH", start, source, length, LANE_BASE - k, 0, 0, float(offset), 0, float(offset + length), 0)
    body = b"".join(fl_event(*e) for e in [*out, (FL["playlist"], items)])
    return b"FLhd" + struct.pack("<IhHH", 6, 0, len(s.instruments), PPQ) + b"FLdt" + struct.pack("<I", len(body)) + body


def read_flstudio(data: bytes) -> Session:
    if data[:4] != b"FLhd" or data[14:18] != b"FLdt":
        raise FormatError("the file lacks the two chunk marks of an FL project")
    ppq = struct.unpack_from("<H", data, 12)[0] or PPQ
    found = fl_events(data[22 : 22 + struct.unpack_from("<I", data, 18)[0]])
    text = lambda v: v.decode("utf-16-le").rstrip("\0")
    first = lambda k, default: next((v for i, v in found if i == FL[k]), default)
    s = Session(text(first("title", b"")), first("rate", 44100), 1, 0, first("tempo", 120000) / 1000)
    frames = lambda t: round(t / ppq * 60 / s.tempo * s.sample_rate)
    names, patterns, current = [], {}, 0
    for i, v in found:
        if i == FL["channel"]:
            s.instruments.append(Instrument("", "", 0))
        elif i == FL["channel_name"] and s.instruments:
            s.instruments[-1].name = text(v)
        elif i == FL["path"] and s.instruments:
            s.instruments[-1].file = text(v)
        elif i == FL["current"]:
            current = v
        elif i == FL["notes"]:
            rows = (struct.unpack_from("<IHHIBBBBBBBB", v, at) for at in range(0, len(v) - NOTE_BYTES + 1, NOTE_BYTES))
            patterns[current] = [note(0, frames(r[0]), frames(r[3]), r[4], r[11]) for r in rows]
        elif i == FL["track_name"]:
            names.append(text(v))
    s.tracks = [Track(n) for n in names]
    items = first("playlist", b"")
    for at in range(0, len(items) - ITEM_BYTES + 1, ITEM_BYTES):
        start, source, length, lane, _, _, offset = struct.unpack_from("<IHIHHIf", items, at)
        k = LANE_BASE - lane
        if not 0 <= k < len(s.tracks):
            raise FormatError("a playlist item lies on no track")
        if source >= PATTERN_BASE:
            s.tracks[k].kind, s.tracks[k].notes = "instrument", patterns.get(source - PATTERN_BASE, [])
        elif source < len(s.instruments):
            i = s.instruments[source]
            s.tracks[k].clips.append(Clip(i.name, i.file, frames(start), frames(offset), frames(length)))
    return stretched(s)


# --- REAPER: a tree of tokens; seconds, notes as hexadecimal events --------------

REAPER_PPQ = 960


def quoted(x) -> str:
    x = str(x)
    if x and not re.search(r"[\s\"'`<>]", x):
        return x
    mark = next((m for m in "\"'`" if m not in x), None)
    return f"{mark}{x}{mark}" if mark else "`" + x.replace("`", "'") + "`"


def write_reaper(s: Session) -> str:
    """[S28]"""
    lines: list[str] = []

    def line(depth: int, *parts) -> None:
        lines.append("  " * depth + " ".join(quoted(p) if k else str(p) for k, p in enumerate(parts)))

    line(0, "<REAPER_PROJECT", "0.1", f"7.0/{APP}", 0)
    for parts in (("RIPPLE", 0), ("SAMPLERATE", s.sample_rate), ("TEMPO", f"{s.tempo:.6f}", 4, 4), ("TITLE", s.name)):
        line(1, *parts)
    for t in s.tracks:
        line(1, "<TRACK")
        line(2, "NAME", t.name)
        for c in t.clips:
            line(2, "<ITEM")
            for parts in (("POSITION", decimals(s.seconds(c.start))), ("LENGTH", decimals(s.seconds(c.length))), ("SOFFS", decimals(s.seconds(c.offset))), ("VOLPAN", decimals(c.gain), 0, 1, -1), ("NAME", c.name)):
                line(3, *parts)
            line(3, "<SOURCE", "WAVE"), line(4, "FILE", c.file), line(3, ">"), line(2, ">")
        if t.notes:
            a, b = span(t.notes)
            line(2, "<ITEM"), line(3, "POSITION", decimals(s.seconds(a))), line(3, "LENGTH", decimals(s.seconds(b - a))), line(3, "NAME", "notes")
            line(3, "<SOURCE", "MIDI"), line(4, "HASDATA", 1, REAPER_PPQ, "QN")
            tick = lambda f: round(s.beats(f - a) * REAPER_PPQ)
            rows = sorted((tick(f), on, n.note, n.channel & 15, max(1, n.velocity) if on else 0) for n in t.notes for f, on in ((n.start, 1), (n.start + n.length, 0)))
            last = 0
            for at, on, key, channel, velocity in rows:
                line(4, "E", at - last, f"{0x90 | channel if on else 0x80 | channel:02x}", f"{key:02x}", f"{velocity:02x}")
                last = at
            line(3, ">"), line(2, ">")
        line(1, ">")
    line(0, ">")
    return "\n".join(lines) + "\n"


def reaper_tree(text: str) -> tuple[list[str], list]:
    """Nodes: (tokens, children)."""
    stack: list[tuple[list[str], list]] = []
    for raw in text.splitlines():
        raw = raw.strip()
        if not raw:
            continue
        if raw == ">":
            if not stack:
                raise ParseError("a block ends that did not begin")
            done = stack.pop()
            if not stack:
                return done
            continue
        lexer = shlex.shlex(raw.removeprefix("<"), posix=True, punctuation_chars=False)
        lexer.whitespace_split, lexer.quotes, lexer.commenters, lexer.escape = True, "\"'`", "", ""
        node = (list(lexer), [])
        if stack:
            stack[-1][1].append(node)
        if raw.startswith("<"):
            stack.append(node)
        elif not stack:
            raise ParseError("a project begins with a block")
    raise ParseError("a block does not end")


def read_reaper(text: str) -> Session:
    root = reaper_tree(text)
    if root[0][:1] != ["REAPER_PROJECT"]:
        raise FormatError("not a REAPER project")
    get = lambda node, key, k=1, default=None: next((c[0][k] for c in node[1] if c[0] and c[0][0] == key and len(c[0]) > k), default)
    rate = get(root, "SAMPLERATE")
    if rate is None:
        raise FormatError("a REAPER project needs its sample rate")
    s = Session(get(root, "TITLE", default=""), int(number(rate, "the rate")), 1, 0, number(get(root, "TEMPO", default="120"), "the tempo"))
    frames = lambda x: round(number(x, "a time") * s.sample_rate)
    for t in (c for c in root[1] if c[0][:1] == ["TRACK"]):
        own = Track(get(t, "NAME", default=""))
        for item in (c for c in t[1] if c[0][:1] == ["ITEM"]):
            start = frames(get(item, "POSITION", default="0"))
            source = next((c for c in item[1] if c[0][:1] == ["SOURCE"]), None)
            if source and source[0][1:2] == ["MIDI"]:
                ppq, tick, open_ = int(get(source, "HASDATA", 2, str(REAPER_PPQ))), 0, {}
                at = lambda t_: start + s.frames_of_beats(t_ / ppq)  # noqa: B023, E731
                for tokens, _ in source[1]:
                    if tokens and tokens[0].upper() == "E" and len(tokens) >= 5:
                        tick += int(tokens[1])
                        status, key, velocity = (int(x, 16) for x in tokens[2:5])
                        pair = status & 15, key
                        if status >> 4 == 9 and velocity:
                            open_.setdefault(pair, []).append((tick, velocity))
                        elif status >> 4 in (8, 9) and open_.get(pair):
                            begun, v = open_[pair].pop(0)
                            own.notes.append(note(status & 15, at(begun), at(tick) - at(begun), key, v))
            elif source:
                own.clips.append(Clip(get(item, "NAME", default=""), get(source, "FILE", default=""), start, frames(get(item, "SOFFS", default="0")), frames(get(item, "LENGTH", default="0")), number(get(item, "VOLPAN", default="1"), "a gain")))
        own.kind = "instrument" if own.notes else "audio"
        own.notes.sort(key=lambda n: (n.start, n.note))
        s.tracks.append(own)
    return stretched(s)


# --- Ardour: XML in frames; notes in MIDI files beside it ------------------------


def ardour_midi_path(session: str, track: str) -> str:
    clean = lambda x: re.sub(r"[^A-Za-z0-9_.-]", "_", x) or "_"
    return f"interchange/{clean(session)}/midifiles/{clean(track)}.mid"


def write_ardour(s: Session) -> tuple[str, dict[str, bytes]]:
    """[S29] The session, and the MIDI files it refers to."""
    ids, sources, regions, playlists, routes, files = Ids(), [], [], [], [], {}
    for t in s.tracks:
        kind, route, lane = ("midi" if t.kind == "instrument" else "audio"), ids(), []
        clips = list(t.clips)
        if not clips and t.notes:
            a, b = span(t.notes)
            path = ardour_midi_path(s.name, t.name)
            clips = [Clip(t.name, path, a, 0, b - a)]
            files[path] = midi.encode(midi.from_notes(t.notes, s.sample_rate, t.name))
        for c in clips:
            source, own = ids(), {"name": c.name, "position": c.start, "length": c.length, "start": c.offset, "scale-amplitude": decimals(c.gain), "id": ids(), "type": kind}
            sources.append(tag("Source", {"name": c.file.rsplit("/", 1)[-1], "type": kind, "id": source, "origin": c.file, "channel": c.channel}))
            regions.append(tag("Region", own | {"source-0": source, "master-source-0": source, "channels": 1, "whole-file": 0}))
            lane.append(tag("Region", own | {"source-0": source, "master-source-0": source, "channels": 1}))
        playlists.append(tag("Playlist", {"id": ids(), "name": t.name, "type": kind, "orig-track-id": route}, *lane))
        routes.append(tag("Route", {"id": route, "name": t.name, "default-type": kind, "active": "yes"}))
    tempo = tag("TempoMap", {}, tag("Tempo", {"frame": 0, "beats-per-minute": f"{s.tempo:.6f}", "note-type": 4}), tag("Meter", {"frame": 0, "note-type": 4, "divisions-per-bar": 4}))
    root = tag("Session", {"version": 3002, "name": s.name, "sample-rate": s.sample_rate}, tempo, *(tag(n, {}, *c) for n, c in (("Sources", sources), ("Regions", regions), ("Playlists", playlists), ("Routes", routes))))
    return document(root), files


def read_ardour(text: str, beside=None) -> Session:
    """beside: gives the bytes of a MIDI file by its path, or nothing."""
    root = parse(text, "Session")
    if root.get("sample-rate") is None:
        raise FormatError("an Ardour session needs its sample rate")
    place = lambda x: int(str(x or "0").lstrip("a"))
    s = Session(root.get("name", ""), int(root.get("sample-rate")), 1, 0, number(of(root, "TempoMap/Tempo", "beats-per-minute", "120"), "the tempo"))
    sources = {x.get("id"): x for x in root.findall("Sources/Source")}
    names = {x.get("id"): x.get("name") for x in root.findall("Routes/Route")}
    for p in root.findall("Playlists/Playlist"):
        own = Track(names.get(p.get("orig-track-id")) or p.get("name", ""), "instrument" if p.get("type") == "midi" else "audio")
        for r in p.findall("Region"):
            source = sources.get(r.get("source-0"))
            if source is None:
                raise FormatError(f"region {r.get('name')} has no source")
            own.clips.append(Clip(r.get("name", ""), source.get("origin", ""), place(r.get("position")), place(r.get("start")), place(r.get("length")), number(r.get("scale-amplitude", "1"), "a gain"), int(source.get("channel", 0))))
        if own.kind == "instrument":
            for c in own.clips:
                data = beside(c.file) if beside else None
                own.notes += midi.to_notes(midi.decode(data), s.sample_rate) if data else []
            own.clips = [] if own.notes else own.clips
        s.tracks.append(own)
    return stretched(s)


# --- LMMS: XML; 192 ticks a bar ---------------------------------------------------

LMMS_BAR, LMMS_RATE = 192, 48000
LMMS_INSTRUMENT, LMMS_SAMPLE = 0, 2


def write_lmms(s: Session) -> str:
    """[S30]"""
    ticks = lambda f: max(0, round(s.beats(f) / 4 * LMMS_BAR))

    def track(t: Track) -> Tree:
        if t.kind == "audio":
            clips = [tag("sampletco", {"name": c.name, "src": c.file, "pos": ticks(c.start), "len": max(1, ticks(c.length)), "off": ticks(c.offset), "muted": 0, "gain": decimals(c.gain)}) for c in t.clips]
            return tag("track", {"name": t.name, "type": LMMS_SAMPLE, "muted": 0}, tag("sampletrack", {"vol": 100, "pan": 0}), *clips)
        first = s.instruments[0] if s.instruments else None
        player = tag("instrument", {"name": "audiofileprocessor"}, tag("audiofileprocessor", {"src": first.file if first else "", "amp": 100}))
        a, b = span(t.notes)
        rows = [tag("note", {"key": n.note, "pos": ticks(n.start - a), "len": max(1, ticks(n.length)), "vol": decimals(n.velocity * 100 / 127), "pan": 0}) for n in t.notes]
        pattern = tag("pattern", {"name": "notes", "pos": ticks(a), "len": max(1, ticks(b - a)), "type": 1, "steps": 16}, *rows)
        return tag("track", {"name": t.name, "type": LMMS_INSTRUMENT, "muted": 0}, tag("instrumenttrack", {"vol": 100, "basenote": first.note if first and first.note is not None else 60}, player), pattern)

    head = tag("head", {"bpm": f"{s.tempo:.6f}", "mastervol": 100, "timesig_numerator": 4, "timesig_denominator": 4})
    return document(tag("lmms-project", {"type": "song", "creator": APP, "version": "1.0"}, head, tag("song", {}, tag("trackcontainer", {"type": "song"}, *map(track, s.tracks)))))


def read_lmms(text: str, name: str = "") -> Session:
    root = parse(text, "lmms-project")
    s = Session(name, LMMS_RATE, 1, 0, number(of(root, "head", "bpm", "120"), "the tempo"))
    frames = lambda t: s.frames_of_beats(number(t, "a time") / LMMS_BAR * 4)
    for t in root.findall("song/trackcontainer/track"):
        own = Track(t.get("name", ""), "instrument" if t.get("type") == str(LMMS_INSTRUMENT) else "audio")
        own.clips = [Clip(c.get("name", ""), c.get("src", ""), frames(c.get("pos", "0")), frames(c.get("off", "0")), frames(c.get("len", "0")), number(c.get("gain", "1"), "a gain")) for c in t.findall("sampletco")]
        for p in t.findall("pattern"):
            start = frames(p.get("pos", "0"))
            own.notes += [note(0, start + frames(n.get("pos")), frames(n.get("len")), int(n.get("key")), min(127, max(0, round(number(n.get("vol", "100"), "a volume") * 1.27)))) for n in p.findall("note")]
        s.tracks.append(own)
    return stretched(s)
