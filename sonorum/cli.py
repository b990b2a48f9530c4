"""Six commands: decompose, compose, verify, inspect, export, render.

    python -m sonorum.cli decompose song.wav --formats reaper,midi
"""

from __future__ import annotations

import argparse
import os
import sys

from .errors import EngineError, InvalidArgumentError, MismatchError
from .formats import midi, project
from .formats.session_model import session_of
from .model import ArrangeOptions, DecomposeOptions, SessionOptions
from .operators import arrange
from .operators.pursuit import Decomposition, Report, decompose_audio, verify
from .sources import archive
from .sources.audio import Audio, decode, encode
from .sources.lino import Manifest

CONTAINERS = {"wav": "wav", "wave": "wav", "aif": "aiff", "aiff": "aiff", "flac": "flac"}


def load(path: str) -> Audio:
    with open(path, "rb") as f:
        return decode(f.read())


def save(path: str, audio: Audio) -> None:
    ext = os.path.splitext(path)[1].lstrip(".").lower()
    if ext not in CONTAINERS:
        raise InvalidArgumentError(f"no container for {path}")
    with open(path, "wb") as f:
        f.write(encode(audio, CONTAINERS[ext]))


def transport(seconds: float) -> str:
    """[P35]"""
    ms = round(max(0.0, seconds) * 1000)
    return f"{ms // 60000}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def say_report(r: Report, out) -> None:
    print(f"exact: {'yes' if r.exact else f'no, off by {r.deviation}'}", file=out)
    print(f"stems: {'exact' if r.stem_deviation == 0 else f'off by {r.stem_deviation}'}", file=out)
    print(f"bank: {r.samples} samples, {r.placements} placements, reuse {r.reuse:.2f}x", file=out)
    print(f"residual: peak {r.residual_peak:.6f}, {100 * r.residual_share:.2f} % of the energy", file=out)


def say_manifest(m: Manifest, out) -> None:
    seconds = m.frames / m.sample_rate if m.sample_rate else 0
    print(f"{m.name}: {transport(seconds)}, {m.sample_rate} Hz, {m.format}, {m.channels} channels, {m.frames} frames", file=out)
    pitched = sum(s.note is not None for s in m.samples)
    print(f"{len(m.stems)} stems, {len(m.samples)} samples ({pitched} pitched), {len(m.placements)} placements, {len(m.notes)} notes", file=out)


def session_for(d: Decomposition, tempo: float | None, arrangement: bool = False):
    files = {}
    m = Manifest.of(d)
    files |= {f"stem/{n}": f for n, f in m.stems} | {f"sample/{s.id}": s.file for s in m.samples} | {"residual": m.residual}
    options = SessionOptions(tempo=tempo or 120.0, estimate=tempo is None, stems=not arrangement, residual=not arrangement)
    return session_of(d, options, files)


def written(folder: str, paths: list[str], out) -> None:
    for p in paths:
        print(f"wrote {os.path.relpath(p, folder)}", file=out)


def run_decompose(a, out) -> None:
    formats = project.formats_of(a.formats)
    audio = load(a.input)
    name = os.path.splitext(os.path.basename(a.input))[0]
    options = DecomposeOptions(search=a.search, candidates=a.candidates, stems=not a.no_stems, notes=not a.no_notes)
    d = decompose_audio(name, audio, options.exact_only() if a.exact else options)
    folder = a.output or f"{os.path.splitext(a.input)[0]}.decomposition"
    say_manifest(archive.write(folder, d), out)
    say_report(verify(d, audio), out)
    written(folder, project.write_these(folder, session_for(d, a.tempo), formats), out)


def run_compose(a, out) -> None:
    audio = archive.read(a.archive).reconstruct()
    path = a.output or f"{a.archive.rstrip('/').removesuffix('.decomposition')}.composed.wav"
    save(path, audio)
    print(f"wrote {path}", file=out)


def run_verify(a, out) -> None:
    r = verify(archive.read(a.archive), load(a.original))
    say_report(r, out)
    if a.strict and not r.exact:
        raise MismatchError("the archive does not reproduce the recording exactly")


def run_inspect(a, out) -> None:
    if os.path.isdir(a.path):
        say_manifest(archive.read_manifest(a.path), out)
        return
    x = load(a.path)
    print(f"{os.path.basename(a.path)}: {transport(x.frames / x.sample_rate)}, {x.sample_rate} Hz, {x.format}, {len(x.channels)} channels, {x.frames} frames", file=out)


def run_export(a, out) -> None:
    formats = project.formats_of(a.formats)
    written(a.archive, project.write_these(a.archive, session_for(archive.read(a.archive), a.tempo, a.arrangement_only), formats), out)


def run_render(a, out) -> None:
    d = archive.read(a.archive)
    with open(a.midi, "rb") as f:
        notes = midi.to_notes(midi.decode(f.read()), d.sample_rate)
    audio = arrange.arrange(d, notes, ArrangeOptions(sine=not a.bank_only, velocity=not a.flat, trim=a.trim, tail=a.tail, normalize=not a.no_normalize))
    save(a.output, audio)
    print(f"wrote {a.output}: {len(notes)} notes, {transport(audio.frames / audio.sample_rate)}", file=out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sonorum")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, run, *arguments):
        p = commands.add_parser(name)
        for flags, kw in arguments:
            p.add_argument(*flags, **kw)
        p.set_defaults(run=run)

    flag, tempo = {"action": "store_true"}, (("--tempo",), {"type": float})
    formats = lambda default: (("--formats",), {"action": "append", "default": None, "dest": "formats", "metavar": f"LIST (default {default})"})
    command("decompose", run_decompose, (("input",), {}), (("-o", "--output"), {}), formats("all"), tempo, (("--search",), {"type": float, "default": 0.01}), (("--candidates",), {"type": int, "default": 24}), (("--exact",), flag), (("--no-stems",), flag), (("--no-notes",), flag))
    command("compose", run_compose, (("archive",), {}), (("-o", "--output"), {}))
    command("verify", run_verify, (("archive",), {}), (("original",), {}), (("--strict",), flag))
    command("inspect", run_inspect, (("path",), {}))
    command("export", run_export, (("archive",), {}), formats("all"), tempo, (("--arrangement-only",), flag))
    command("render", run_render, (("archive",), {}), (("midi",), {}), (("output",), {}), (("--bank-only",), flag), (("--flat",), flag), (("--trim",), flag), (("--tail",), {"type": float, "default": 1.0}), (("--no-normalize",), flag))
    return top


def main(arguments: list[str] | None = None, out=None) -> int:
    a = parser().parse_args(arguments)
    if hasattr(a, "formats") and a.formats is None:
        a.formats = ["all"]
    try:
        a.run(a, out or sys.stdout)
    except (EngineError, OSError) as e:
        print(f"sonorum: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
