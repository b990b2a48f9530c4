"""Taking recordings apart: events, matching pursuit, notes, stems, and what is left.

Pursuit is sequential within a recording, because every placement changes the
signal that the next event sees; recordings are independent.  `decompose` runs
it over a table of recordings, one group a recording.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MismatchError
from ..functions.scalar import NOTE_NAMES
from ..model import BANK, FORMATS, GAIN_ONE, NOTE, PLACEMENT, STEM, DecomposeOptions, EventOptions, MatchOptions, NoteOptions, PitchOptions
from ..sources.audio import Audio, half_away, quantize
from . import dsp


@dataclass
class Sample:
    id: int
    name: str
    waveform: np.ndarray
    note: int | None = None
    frequency: float | None = None

    @property
    def peak(self) -> float:
        return float(np.abs(self.waveform).max(initial=0.0))


@dataclass(frozen=True)
class Placement:
    sample: int
    channel: int
    start: int
    gain: int  # over 2^16


@dataclass(frozen=True)
class Event:
    channel: int
    start: int
    length: int

    @property
    def end(self) -> int:
        return self.start + self.length


@dataclass(frozen=True)
class Note:
    channel: int
    start: int
    length: int
    note: int
    velocity: int
    frequency: float
    confidence: float


@dataclass
class Decomposition:
    name: str
    sample_rate: int
    format: str
    channels: int
    frames: int
    stems: list[tuple[str, Audio]] = field(default_factory=list)
    samples: list[Sample] = field(default_factory=list)
    placements: list[Placement] = field(default_factory=list)
    notes: list[Note] = field(default_factory=list)
    residual: Audio | None = None
    correction: Audio | None = None

    def render(self) -> Audio:
        """[A9] Placements summed in order, quantised once; unknown samples and channels and silent gains fall out."""
        out = np.zeros((self.channels, self.frames))
        for p in self.placements:
            if p.gain and 0 <= p.sample < len(self.samples) and 0 <= p.channel < self.channels:
                add(out[p.channel], p.start, self.samples[p.sample].waveform, p.gain / GAIN_ONE)
        return Audio(self.sample_rate, self.format, quantize(out, self.format))

    def reconstruct(self) -> Audio:
        """[D22]"""
        total = self.render().channels
        for part in (self.residual, self.correction):
            if part is not None:
                total = total + part.channels
        return Audio(self.sample_rate, self.format, total)

    def stem_sum(self) -> np.ndarray:
        """[A10]"""
        total = np.zeros((self.channels, self.frames))
        for _, stem in self.stems:
            total = total + stem.channels
        return total

    def bank_frames(self) -> tuple[int, int]:
        """[A5] Frames stored, frames covered."""
        sizes = [len(s.waveform) for s in self.samples]
        return sum(sizes), sum(sizes[p.sample] for p in self.placements if 0 <= p.sample < len(sizes))

    def residual_share(self) -> float:
        """[A7]"""
        rest = float((self.residual.channels**2).sum()) if self.residual else 0.0
        total = rest + float((self.render().channels ** 2).sum())
        return rest / total if total > 0 else 0.0


def add(signal: np.ndarray, start: int, pattern: np.ndarray, factor: float) -> None:
    """[D17] In place; what lies outside the signal is left out."""
    a, b = max(0, -start), min(len(pattern), len(signal) - start)
    if a < b:
        signal[start + a : start + b] += factor * pattern[a:b]


def seconds_to_frames(seconds: float, rate: int) -> int:
    return int(max(0, half_away(np.array(seconds * rate))))


# --- events ------------------------------------------------------------------


def boundaries(x: np.ndarray, rate: int, options: EventOptions) -> list[int]:
    """[D13 W8] Where the events of a signal begin."""
    if not len(x):
        return []
    places = [p for _, p, _ in dsp.onsets(dsp.stft(x, rate, options.stft), options.onset)]
    if options.refine:
        places = dsp.refined(places, x, options.stft.size + options.stft.hop, max(8, options.stft.size // 32))
    least, most = max(1, seconds_to_frames(options.least, rate)), seconds_to_frames(options.most, rate)
    cuts = [0]
    for p in sorted({p for p in places if 0 < p < len(x)}):
        if p - cuts[-1] >= least:
            cuts.append(p)
    if not most:
        return cuts
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True):
        out.append(a)
        if b - a > most:
            each = -(-(b - a) // -(-(b - a) // most))
            out += [p for p in range(a + each, b, each) if b - p >= least]
    return out


def events(audio: Audio, options: EventOptions) -> list[Event]:
    """[D13 O1] Events that tile every channel, by start and channel."""
    if not audio.frames:
        return []
    shared = None if options.per_channel else boundaries(audio.mono(), audio.sample_rate, options)
    out = []
    for c, x in enumerate(audio.channels):
        cuts = boundaries(x, audio.sample_rate, options) if shared is None else shared
        out += [Event(c, a, b - a) for a, b in zip(cuts, [*cuts[1:], audio.frames], strict=True) if b > a]
    return sorted(out, key=lambda e: (e.start, e.channel))


# --- matching ----------------------------------------------------------------


@dataclass(frozen=True)
class Alignment:
    start: int
    gain: int
    remainder: float

    @property
    def similarity(self) -> float:
        return min(1.0, max(0.0, 1 - self.remainder))


def best_alignment(signal: np.ndarray, anchor: int, pattern: np.ndarray, options: MatchOptions) -> Alignment | None:
    """[D16] The shift and gain that leave least of the window; gains are rounded before they are judged."""
    n, radius = len(pattern), options.radius
    energy = float((pattern * pattern).sum())
    if not n or energy <= 0:
        return None
    first = anchor - radius
    region = np.zeros(n + 2 * radius)
    a, b = max(0, -first), min(len(region), len(signal) - first)
    if a < b:
        region[a:b] = signal[first + a : first + b]
    dots = dsp.cross_correlate(region, pattern)
    sums = np.concatenate([[0.0], np.cumsum(region * region)])
    shifts = np.arange(2 * radius + 1)
    held = sums[shifts + n] - sums[shifts]
    gains = half_away(dots / energy * GAIN_ONE).astype(np.int64)
    factor = gains / GAIN_ONE
    fits = (held > 0) & (np.abs(factor) >= options.least_gain) & (np.abs(factor) <= options.greatest_gain)
    if not options.inversion:
        fits &= factor >= 0
    if not fits.any():
        return None
    shifts, held, dots, factor, gains = (v[fits] for v in (shifts, held, dots, factor, gains))
    rest = np.sqrt(np.maximum(held - 2 * factor * dots + factor * factor * energy, 0) / held)
    close = np.flatnonzero(rest <= rest.min() + 1e-15)
    k = int(close[np.abs(shifts[close] - radius).argmin()])
    return Alignment(first + int(shifts[k]), int(gains[k]), float(rest[k])) if rest[k] <= options.tolerance else None


class Bank:
    """[D18 J4 J5 O4] Waveforms so far, found again by their bytes or by how close their lengths are."""

    def __init__(self):
        self.samples: list[Sample] = []
        self.known: dict[bytes, int] = {}
        self.sizes: list[int] = []

    @staticmethod
    def key(x: np.ndarray) -> bytes:
        return (x + 0.0).tobytes()  # -0.0 + 0.0 is 0.0

    def store(self, x: np.ndarray) -> int:
        k = len(self.samples)
        self.known.setdefault(self.key(x), k)
        self.samples.append(Sample(k, f"sample-{k + 1:04d}", x))
        self.sizes.append(len(x))
        return k

    def near(self, n: int, limit: int) -> list[int]:
        """Within an octave of the length, the closest first, of equals the latest first."""
        if not self.sizes or not n:
            return []
        sizes = np.array(self.sizes, float)
        distance = np.abs(np.log2(np.maximum(sizes, 1e-300) / n))
        ids = np.flatnonzero((distance <= 1) & (sizes > 0))
        return ids[np.lexsort((-ids, distance[ids]))][:limit].tolist()

    def match(self, window: np.ndarray, event: Event, signal: np.ndarray, match: MatchOptions, limit: int) -> Placement | None:
        same = self.known.get(self.key(window))
        if same is not None:
            return Placement(same, event.channel, event.start, GAIN_ONE)
        tried = ((k, best_alignment(signal, event.start, self.samples[k].waveform, match)) for k in self.near(len(window), limit))
        found = [(k, a) for k, a in tried if a is not None]
        if not found:
            return None
        k, best = min(found, key=lambda f: f[1].remainder)  # the first of equals
        return Placement(k, event.channel, best.start, best.gain)


def pursue(audio: Audio, found: list[Event], match: MatchOptions, candidates: int, floor: float) -> tuple[Bank, list[Placement], list[int | None]]:
    """[D18 F1] One pass: the bank, the placements, and where each event turned out to begin."""
    left, bank, placements, starts = audio.channels.copy(), Bank(), [], []
    for event in found:
        window = left[event.channel, event.start : event.end].copy()
        if dsp.rms(window) <= floor:
            starts.append(None)
            continue
        placement = bank.match(window, event, left[event.channel], match, candidates)
        if placement is None:
            placement = Placement(bank.store(window), event.channel, event.start, GAIN_ONE)
        add(left[placement.channel], placement.start, bank.samples[placement.sample].waveform, -placement.gain / GAIN_ONE)
        starts.append(placement.start)
        placements.append(placement)
    return bank, placements, starts


def realign(found: list[Event], starts: list[int | None]) -> list[Event]:
    """[W16] Boundaries move to where their events begin, if that keeps their order; the tiling stays."""
    out = list(found)
    for channel in {e.channel for e in found}:
        before = None
        own = [i for i, e in enumerate(found) if e.channel == channel]
        for i in own:
            e, s = found[i], starts[i]
            place = s if s is not None and 0 <= s < e.end else e.start
            if before is not None:
                if place <= out[before].start:
                    place = max(e.start, out[before].start + 1)
                out[before] = replace(out[before], length=place - out[before].start)
            out[i] = replace(e, start=place)
            before = i
        out[before] = replace(out[before], length=max(0, found[before].end - out[before].start))
    return out


def build_bank(audio: Audio, options: DecomposeOptions) -> tuple[Bank, list[Placement]]:
    """[D18] A second pass only where the first one moved boundaries."""
    match = replace(options.match, radius=seconds_to_frames(options.search, audio.sample_rate))
    quantum = FORMATS[audio.format][2]
    floor = max(options.silence, quantum / 2 if quantum else 0.0)
    found = events(audio, options.events)
    bank, placements, starts = pursue(audio, found, match, options.candidates, floor)
    moved = realign(found, starts) if match.radius else found
    if moved != found:
        bank, placements, _ = pursue(audio, moved, match, options.candidates, floor)
    return bank, placements


# --- notes and stems ---------------------------------------------------------


def note_name(n: int) -> str:
    n = min(127, max(0, n))
    return f"{NOTE_NAMES[n % 12]}{n // 12 - 1}"


def velocity_of(amplitude: float) -> int:
    return 1 if amplitude <= 0 else int(min(127, max(1, half_away(np.array(np.cbrt(amplitude) * 126)) + 1)))


def identify(x: np.ndarray, rate: int, options: PitchOptions) -> tuple[int, float, float] | None:
    """[D14 F7] Note, frequency, confidence of a waveform that has a pitch."""
    found = dsp.yin(x, rate, options)
    if found is None or found[1] < 0.5:
        return None
    note = int(np.clip(half_away(np.array(69 + 12 * np.log2(found[0] / 440))), 0, 127))
    return note, found[0], found[1]


def labelled(samples: list[Sample], rate: int, options: PitchOptions) -> None:
    """[D19]"""
    for s in samples:
        found = identify(s.waveform, rate, options)
        if found:
            s.note, s.frequency = found[0], found[1]
            s.name = f"{s.name}-{note_name(found[0])}"


def detect_notes(audio: Audio, options: NoteOptions) -> list[Note]:
    """[D14 A15 O2]"""
    out, rate = [], audio.sample_rate
    least = seconds_to_frames(options.least, rate)
    for c, x in enumerate(audio.channels):
        if not len(x):
            continue
        s = dsp.stft(x, rate, options.stft)
        found = dsp.tracked(s, options.polyphonic)
        top = max((f[3] for f in found), default=0.0)
        for first, last, note, salience in found:
            a, b = (int(np.clip(half_away(np.array(s.frame_time(f) * rate)), 0, len(x))) for f in (first, last))
            if b - a < max(1, least):
                continue
            peak = float(np.abs(x[a:b]).max(initial=0.0))
            out.append(Note(c, a, b - a, note, velocity_of(peak), 440 * 2.0 ** ((note - 69) / 12), salience / top if top > 0 else 0.0))
    return sorted(out, key=lambda n: (n.start, n.channel, n.note))


def separate(audio: Audio, options: DecomposeOptions) -> list[tuple[str, Audio]]:
    """[D12] Harmonic, percussive and correction stems, which sum to the recording exactly."""
    if not options.stems or not audio.frames:
        return [("full", audio)]
    parts = [[], []]
    for x in audio.channels:
        for k, s in enumerate(dsp.hpss(dsp.stft(x, audio.sample_rate, options.stft), options.hpss)):
            parts[k].append(dsp.istft(s))
    harmonic, percussive = (Audio(audio.sample_rate, audio.format, quantize(np.stack(p), audio.format)) for p in parts)
    correction = Audio(audio.sample_rate, audio.format, audio.channels - (harmonic.channels + percussive.channels))
    correction.format = correction.narrowest(audio.format)
    return [("harmonic", harmonic), ("percussive", percussive), ("correction", correction)]


def decompose_audio(name: str, audio: Audio, options: DecomposeOptions = DecomposeOptions()) -> Decomposition:
    """[D21]"""
    bank, placements = build_bank(audio, options)
    out = Decomposition(name, audio.sample_rate, audio.format, len(audio.channels), audio.frames, separate(audio, options), bank.samples, placements)
    if options.notes:
        out.notes = detect_notes(audio, options.note)
        labelled(out.samples, audio.sample_rate, options.pitch)
    out.residual = audio.difference(out.render())
    out.residual.format = out.residual.narrowest(audio.format)
    left = audio.difference(out.reconstruct())
    if np.abs(left.channels).max(initial=0.0) > 0:
        left.format = left.narrowest(audio.format)
        out.correction = left
    return out


@dataclass(frozen=True)
class Report:
    """[A11]"""

    frames: int
    channels: int
    sample_rate: int
    deviation: float
    stem_deviation: float
    samples: int
    placements: int
    notes: int
    stored: int
    covered: int
    residual_peak: float
    residual_share: float

    @property
    def exact(self) -> bool:
        return self.deviation == 0

    @property
    def reuse(self) -> float:
        return self.covered / self.stored if self.stored else 0.0


def verify(d: Decomposition, audio: Audio) -> Report:
    """[D22 A11]"""
    if (d.sample_rate, d.channels, d.frames) != (audio.sample_rate, len(audio.channels), audio.frames):
        raise MismatchError("the recording does not have the shape of its decomposition")
    off = lambda x: float(np.abs(x - audio.channels).max(initial=0.0))
    stored, covered = d.bank_frames()
    return Report(
        audio.frames, d.channels, d.sample_rate, off(d.reconstruct().channels), off(d.stem_sum()) if d.stems else 0.0, len(d.samples), len(d.placements), len(d.notes),
        stored, covered, float(np.abs(d.residual.channels).max(initial=0.0)) if d.residual else 0.0, d.residual_share(),
    )


# --- over tables -------------------------------------------------------------

#: One table holds all parts of a decomposition, so that each recording is taken apart once.
PARTS = "recording_id string, part string, ord long, name string, channel int, start long, length long, value long, note int, velocity int, frequency double, confidence double, samples array<double>"


def _part_rows(rid: str, d: Decomposition) -> list[tuple]:
    rows = []

    def put(part, ord_, name=None, channel=None, start=None, length=None, value=None, note=None, velocity=None, frequency=None, confidence=None, samples=None):
        rows.append((rid, part, ord_, name, channel, start, length, value, note, velocity, frequency, confidence, samples))

    for s in d.samples:
        put("bank", s.id, s.name, length=len(s.waveform), note=s.note, frequency=s.frequency, confidence=s.peak, samples=s.waveform.tolist())
    for k, p in enumerate(d.placements):
        put("placement", k, channel=p.channel, start=p.start, length=p.sample, value=p.gain)
    for k, n in enumerate(d.notes):
        put("note", k, None, n.channel, n.start, n.length, None, n.note, n.velocity, n.frequency, n.confidence)
    for k, (name, stem) in enumerate(d.stems):
        for c, x in enumerate(stem.channels):
            put("stem", k, name, c, samples=x.tolist())
    for part, audio in (("residual", d.residual), ("correction", d.correction)):
        if audio is not None:
            for c, x in enumerate(audio.channels):
                put(part, c, audio.format, c, samples=x.tolist())
    return rows


def recording_of(pdf) -> Audio:
    pdf = pdf.sort_values("channel")
    return Audio(int(pdf["sample_rate"].iloc[0]), str(pdf["format"].iloc[0]), np.stack([np.asarray(x, float) for x in pdf["samples"]]))


def decompose(signals: DataFrame, options: DecomposeOptions = DecomposeOptions()) -> DataFrame:
    """The parts of every recording of a table (recording_id, sample_rate, format, channel, samples).

    A recording is one task's work, as its events depend on each other;
    recordings go in parallel.
    """
    import pandas as pd

    columns = [x.split()[0] for x in PARTS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rid = str(pdf["recording_id"].iloc[0])
        return pd.DataFrame(_part_rows(rid, decompose_audio(rid, recording_of(pdf), options)), columns=columns).astype(object)

    return signals.groupBy("recording_id").applyInPandas(run, PARTS)


def part(parts: DataFrame, name: str) -> DataFrame:
    """bank, placement, note, stem, residual or correction, in the model's columns."""
    own = parts.where(F.col("part") == name)
    if name == "bank":
        return own.select("recording_id", F.col("ord").alias("sample_id"), "name", F.col("samples").alias("waveform"), "note", "frequency", F.col("confidence").alias("peak"))
    if name == "placement":
        return own.select("recording_id", "ord", F.col("length").alias("sample_id"), "channel", "start", F.col("value").alias("gain_num"))
    if name == "note":
        return own.select("recording_id", "channel", "start", "length", "note", "velocity", "frequency", "confidence")
    return own.select("recording_id", "name", "channel", "samples")


MODEL = {"bank": BANK, "placement": PLACEMENT, "note": NOTE, "stem": STEM}


def reconstruct(parts: DataFrame, sources: DataFrame) -> DataFrame:
    """recording_id, channel, samples: renders summed per frame in placement order, quantised, plus residual and correction.

    sources: recording_id, format, channel, frames.  Frames are summed where
    their placements fall, in tall form beside the residual's and the
    correction's; an array is put together per channel at the end.
    """
    placed = part(parts, "placement").join(part(parts, "bank").select("recording_id", "sample_id", "waveform"), ["recording_id", "sample_id"]).where("gain_num <> 0")
    tall = placed.select("recording_id", "channel", "ord", "start", "gain_num", F.posexplode("waveform").alias("pos", "v")).withColumn("frame", F.col("start") + F.col("pos"))
    values = tall.groupBy("recording_id", "channel", "frame").agg(F.array_sort(F.collect_list(F.struct("ord", (F.col("gain_num") / float(GAIN_ONE) * F.col("v")).alias("v")))).alias("vs"))
    render = values.select("recording_id", "channel", "frame", F.aggregate("vs", F.lit(0.0), lambda acc, x: acc + x["v"]).alias("render"))
    grid = {k: (v[2], float(v[3]), float(v[4])) for k, v in FORMATS.items() if not v[1]}

    def on_grid(x):
        out = x
        for k, (q, low, high) in grid.items():
            out = F.when(F.col("format") == k, F.least(F.greatest(F.round(x / q), F.lit(low)), F.lit(high)) * q).otherwise(out)
        return out

    at = sources.select("recording_id", "channel", "format", "frames")
    frames = at.where("frames > 0").select("recording_id", "channel", "format", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)).alias("frame"))
    both = frames.join(render, ["recording_id", "channel", "frame"], "left")
    for name in ("residual", "correction"):
        own = part(parts, name).select("recording_id", "channel", F.posexplode("samples").alias("frame", name)).withColumn("frame", F.col("frame").cast("long"))
        both = both.join(own, ["recording_id", "channel", "frame"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    value = on_grid(zero("render")) + zero("residual") + zero("correction")
    whole = both.groupBy("recording_id", "channel").agg(F.array_sort(F.collect_list(F.struct("frame", value.alias("v")))).alias("x"))
    joined = at.join(whole, ["recording_id", "channel"], "left")
    return joined.select("recording_id", "channel", F.coalesce(F.transform("x", lambda s: s["v"]), F.array().cast("array<double>")).alias("samples"))
