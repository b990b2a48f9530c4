"""Scalar functions of the model as Spark columns: no Python runs on the executors.

Names in brackets are those of the operator inventory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import FORMATS, GAIN_ONE

ColumnOr = Column | str


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _case(pairs: list[tuple[Column, object]], other=None) -> Column:
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if other is None else out.otherwise(other if isinstance(other, Column) else F.lit(other))


# --- grids and formats -------------------------------------------------------


def round_half_away(x) -> Column:
    """[P1]"""
    return F.round(_c(x)).cast("long")


def quantize(x, format_: str) -> Column:
    """[P2] Nearest value of the format's grid; as it is for floats."""
    _, is_float, q, low, high = FORMATS[format_]
    return _c(x) if is_float else F.least(F.greatest(F.round(_c(x) / q), F.lit(float(low))), F.lit(float(high))) * q


def to_code(x, format_: str) -> Column:
    """[P3]"""
    return F.round(_c(x) / FORMATS[format_][2]).cast("long")


def from_code(code, format_: str) -> Column:
    """[P3]"""
    return _c(code) * F.lit(FORMATS[format_][2])


def exact_in(x, format_: str) -> Column:
    """[P4] Whether a value is kept by the format."""
    x = _c(x)
    _, is_float, q, low, high = FORMATS[format_]
    if is_float:
        return F.lit(True) if format_ == "f64" else x.cast("float").cast("double") == x
    code = F.round(x / q)
    return (code >= low) & (code <= high) & (code * q == x)


def array_exact_in(samples, format_: str) -> Column:
    """[P5]"""
    return F.forall(_c(samples), lambda x: exact_in(x, format_))


def narrowest_exact(samples, floor: str = "pcm_u8") -> Column:
    """[P7] The first format, narrow to wide, that keeps all samples; never narrower than the floor, float if that is."""
    bits, is_float = FORMATS[floor][:2]
    fit = [name for name, (b, f, *_) in FORMATS.items() if b >= bits and (f or not is_float)]
    return _case([(array_exact_in(samples, name), name) for name in fit if name != "f64"], "f64") if fit != ["f64"] else F.lit("f64")


def format_bits(name) -> Column:
    """[P6]"""
    return _case([(_c(name) == k, v[0]) for k, v in FORMATS.items()])


def format_bytes(name) -> Column:
    """[P6]"""
    return (format_bits(name) / 8).cast("int")


def format_is_float(name) -> Column:
    """[P6]"""
    return _c(name).isin("f32", "f64")


def duration_seconds(frames, rate) -> Column:
    """[P8] 0 for rate 0."""
    rate = _c(rate)
    return F.when(rate == 0, F.lit(0.0)).otherwise(_c(frames).cast("double") / F.nullif(rate, F.lit(0)))


# --- gains, notes, levels ----------------------------------------------------


def gain_of(factor) -> Column:
    """[P9] Numerator over 2^16."""
    return F.round(_c(factor) * float(GAIN_ONE)).cast("long")


def gain_factor(numerator) -> Column:
    """[P9]"""
    return _c(numerator).cast("double") / float(GAIN_ONE)


def note_end(start, length) -> Column:
    """[P10]"""
    return _c(start) + _c(length)


def sample_at(samples, position) -> Column:
    """[P11] 0 outside the array."""
    position = _c(position)
    return F.when(position < 0, F.lit(0.0)).otherwise(F.coalesce(F.get(_c(samples), F.greatest(position, F.lit(0)).cast("int")), F.lit(0.0)))


def frequency_to_midi(frequency) -> Column:
    """[P13] 0 for what is not positive."""
    f = _c(frequency).cast("double")
    return F.when(f > 0, 69 + 12 * F.log2(f / 440)).otherwise(F.lit(0.0))


def midi_to_frequency(note) -> Column:
    """[P13]"""
    return 440 * F.pow(F.lit(2.0), (_c(note) - 69) / 12)


def nearest_midi(frequency) -> Column:
    """[P13] Clamped to 0..127."""
    return F.least(F.greatest(F.round(frequency_to_midi(frequency)), F.lit(0.0)), F.lit(127.0)).cast("int")


def cents_off(frequency) -> Column:
    """[P13] Cents from the nearest note."""
    x = frequency_to_midi(frequency)
    return (x - F.round(x)) * 100


NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def note_name(note) -> Column:
    """[P14]"""
    n = F.least(F.greatest(_c(note).cast("int"), F.lit(0)), F.lit(127))
    return F.concat(F.element_at(F.array(*map(F.lit, NOTE_NAMES)), (n % 12 + 1).cast("int")), (F.floor(n / 12) - 1).cast("string"))


def parse_note(name) -> Column:
    """[P14] MIDI number of a name such as C#4 or Bb-1; null if it is none or out of range."""
    pattern = r"^([A-Ga-g])([#b]?)(-?\d{1,2})$"
    part = lambda k: F.regexp_extract(F.trim(_c(name)), pattern, k)
    step = F.element_at(F.create_map(*(F.lit(x) for pair in zip("CDEFGAB", (0, 2, 4, 5, 7, 9, 11), strict=True) for x in pair)), F.upper(part(1)))
    number = F.when(F.rlike(F.trim(_c(name)), F.lit(pattern)), (part(3).try_cast("int") + 1) * 12 + F.when(part(1) != "", step) + _case([(part(2) == "#", 1), (part(2) == "b", -1)], 0))
    return F.when(number.between(0, 127), number)


def velocity_of(amplitude) -> Column:
    """[P15] Cube root law, 1..127."""
    a = _c(amplitude).cast("double")
    return F.when(a <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(F.round(F.cbrt(a) * 126) + 1, F.lit(1.0)), F.lit(127.0))).cast("int")


def amplitude_of(velocity) -> Column:
    """[P15]"""
    return F.pow((_c(velocity) - 1) / 126, F.lit(3.0))


# --- arrays ------------------------------------------------------------------


def apply_fades(samples, n: int) -> Column:
    """[P16] Linear fades of n samples (half of them at most) at both ends."""
    a = _c(samples)
    size = F.size(a)
    k = F.least(F.lit(n), F.floor(size / 2).cast("int"))
    def one(x: Column, i: Column) -> Column:
        edge = F.least(i, size - 1 - i)
        return F.when(edge < k, x * ((edge + 1) / (k + 1))).otherwise(x)
    return F.transform(a, one)


def fade_out(samples, n: int) -> Column:
    """[P17] The tail falls to 0."""
    a = _c(samples)
    size = F.size(a)
    k = F.least(F.lit(n), size)
    return F.transform(a, lambda x, i: F.when(i >= size - k, x * ((size - 1 - i) / k)).otherwise(x))


WINDOWS = ("rectangular", "hann", "hamming", "blackman")


def window_shape(kind: str, n) -> Column:
    """[P18] Periodic window of n points."""
    n = _c(n)
    phase = lambda i: i.cast("double") * (2 * 3.141592653589793) / n
    shapes = {
        "rectangular": lambda i: F.lit(1.0),
        "hann": lambda i: 0.5 - 0.5 * F.cos(phase(i)),
        "hamming": lambda i: 0.54 - 0.46 * F.cos(phase(i)),
        "blackman": lambda i: 0.42 - 0.5 * F.cos(phase(i)) + 0.08 * F.cos(2 * phase(i)),
    }
    return F.when(n <= 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), shapes[kind]))


def overlap_add_gain(window, hop) -> Column:
    """[P19] Least sum of squares over positions of one hop."""
    w, hop = _c(window), _c(hop)
    return F.array_min(F.transform(F.sequence(F.lit(0), hop - 1), lambda k: F.aggregate(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / hop).cast("int")), F.lit(0.0), lambda acc, j: acc + F.coalesce(F.pow(F.get(w, (k + j * hop).cast("int")), F.lit(2.0)), F.lit(0.0)))))


def satisfies_overlap_add(window, hop) -> Column:
    """[P19]"""
    return overlap_add_gain(window, hop) > 1e-9


def magnitude(re, im) -> Column:
    """[P20]"""
    return F.hypot(_c(re), _c(im))


def power(re, im) -> Column:
    """[P20]"""
    return _c(re) * _c(re) + _c(im) * _c(im)


def phase(re, im) -> Column:
    """[P20]"""
    return F.atan2(_c(im), _c(re))


def complex_multiply(a_re, a_im, b_re, b_im) -> Column:
    """[P20]"""
    a, b, c, d = map(_c, (a_re, a_im, b_re, b_im))
    return F.struct((a * c - b * d).alias("re"), (a * d + b * c).alias("im"))


def frame_time(frame, hop: int, size: int, rate: int) -> Column:
    """[P21] Middle of a padded transform frame in seconds."""
    return (_c(frame) * hop - size + size / 2) / rate


def bin_frequency(k, rate: int, size: int) -> Column:
    """[P21]"""
    return _c(k) * float(rate) / size


def magnitude_at(mags, frequency, rate: int, size: int) -> Column:
    """[P22] Between bins, linearly; 0 at and behind the last bin."""
    m, at = _c(mags), _c(frequency) * size / float(rate)
    k = F.floor(at).cast("int")
    return F.when((at < 0) | (k + 1 >= F.size(m)), F.lit(0.0)).otherwise(F.get(m, F.greatest(k, F.lit(0))) * (1 - (at - k)) + F.get(m, F.greatest(k + 1, F.lit(0))) * (at - k))


def salience(mags, note, rate: int, size: int, harmonics: int = 8) -> Column:
    """[P23] Magnitudes at the harmonics of a note, each divided by its number."""
    f0 = midi_to_frequency(note)
    return F.aggregate(F.sequence(F.lit(1), F.lit(harmonics)), F.lit(0.0), lambda acc, h: acc + magnitude_at(mags, f0 * h, rate, size) / h)


def parabolic_vertex(left, middle, right) -> Column:
    """[P24] Shift of the vertex from the middle point; 0 if flat or farther than 1."""
    a, b, c = map(_c, (left, middle, right))
    curve = a - 2 * b + c
    shift = F.when(F.abs(curve) > 2.220446049250313e-16, 0.5 * (a - c) / F.when(F.abs(curve) > 2.220446049250313e-16, curve))
    return F.when(shift.isNull() | (F.abs(shift) > 1), F.lit(0.0)).otherwise(shift)


def tempo_prior(bpm, prefer: float = 120.0, spread: float = 0.9) -> Column:
    """[P25]"""
    return F.exp(-0.5 * F.pow(F.log2(_c(bpm) / prefer) / spread, F.lit(2.0)))


def beats(seconds, bpm, offset=0.0) -> Column:
    """[P26]"""
    return (_c(seconds) - _c(offset)) * _c(bpm) / 60


def beat_time(beat, bpm, offset=0.0) -> Column:
    """[P26]"""
    return _c(beat) * 60 / _c(bpm) + _c(offset)


# --- time units --------------------------------------------------------------


def ticks_to_frames(ticks, tempo, division, rate) -> Column:
    """[P27] Floor of ticks * tempo * rate / (division * 10^6), without overflow."""
    d = lambda x: _c(x).cast("decimal(12,0)")
    return F.when(_c(division) == 0, F.lit(0).cast("long")).otherwise(_floor_div(d(ticks) * d(tempo) * d(rate), F.nullif(d(division), F.lit(0)) * F.lit(1000000).cast("decimal(8,0)")))


def frames_to_ticks(frames, tempo, division, rate) -> Column:
    """[P27]"""
    d = lambda x: _c(x).cast("decimal(12,0)")
    bottom = d(tempo) * d(rate)
    return F.when(bottom == 0, F.lit(0).cast("long")).otherwise(_floor_div(d(frames) * d(division) * F.lit(1000000).cast("decimal(8,0)"), F.nullif(bottom, F.lit(0))))


def _floor_div(a: Column, b: Column) -> Column:
    return ((a - F.pmod(a, b)) / b).cast("decimal(38,0)").cast("long")


#: Tempi in microseconds a beat that are tried in this order.
TEMPI = (500000, 1000000, 250000, 125000, 200000, 400000, 600000, 750000)


def midi_timing(rate) -> Column:
    """[P28] tempo and division that make one tick one frame; null if none of the tempi does."""
    rate = _c(rate).cast("long")
    fits = [F.when((rate * t % 1000000 == 0) & ((rate * t / 1000000).cast("long").between(1, 32767)), F.struct(F.lit(t).alias("tempo"), (rate * t / 1000000).cast("int").alias("division"))) for t in TEMPI]
    return F.coalesce(*fits)


def seconds_to_frames(seconds, rate) -> Column:
    """[P29]"""
    return F.greatest(F.round(_c(seconds) * _c(rate)), F.lit(0.0)).cast("long")


def frames_to_beats(frames, rate, tempo) -> Column:
    """[P30]"""
    return duration_seconds(frames, rate) * _c(tempo) / 60


# --- text --------------------------------------------------------------------


def percent_encode(text) -> Column:
    """[P31] Plain ASCII letters, digits and -_./# stay; all other bytes become %XX; empty text becomes %."""
    t = _c(text)
    char = lambda c: F.when(F.rlike(c, F.lit("^[A-Za-z0-9_./#-]$")), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    return F.when(t == "", F.lit("%")).otherwise(F.array_join(F.transform(chars, char), ""))


def percent_decode(text) -> Column:
    """[P31] Null for what is not well-formed."""
    t = _c(text)
    well = F.rlike(t, F.lit("^(?:[A-Za-z0-9_./#-]|%[0-9A-F]{2})+$"))
    hexed = F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(%[0-9A-F]{2}|.)"), F.lit(1)), lambda x: F.when(F.length(x) == 3, F.substring(x, 2, 2)).otherwise(F.hex(F.encode(x, "UTF-8")))), "")
    return F.when(t == "%", F.lit("")).when(well, F.try_validate_utf8(F.unhex(hexed).cast("string")))


def slug(text) -> Column:
    """[P32] Characters that file names may not hold become _; empty text is _."""
    s = F.regexp_replace(_c(text), "[^A-Za-z0-9_.-]", "_")
    return F.when(s == "", F.lit("_")).otherwise(s)


def stem_file(name) -> Column:
    """[P32]"""
    return F.concat(F.lit("stems/"), slug(name), F.lit(".wav"))


def sample_file(name) -> Column:
    """[P32]"""
    return F.concat(F.lit("samples/"), slug(name), F.lit(".wav"))


def project_stem(name, fallback: str = "project") -> Column:
    """[P33] A file stem without path characters."""
    s = F.translate(_c(name), '/\\:*?"<>|', "-" * 9)
    s = F.regexp_replace(F.trim(s), r"^\.+|\.+$", "")
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def track_name(name, channel, channels) -> Column:
    """[P34]"""
    name, channel, channels = map(_c, (name, channel, channels))
    side = _case([(channels == 1, F.lit("")), ((channels == 2) & (channel == 0), F.lit(" L")), ((channels == 2) & (channel == 1), F.lit(" R"))], F.concat(F.lit(" "), (channel + 1).cast("string")))
    return F.concat(name, side)


def transport(seconds) -> Column:
    """[P35] m:ss.mmm"""
    ms = F.round(F.greatest(_c(seconds), F.lit(0.0)) * 1000).cast("long")
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(F.floor(ms / 60000).cast("string"), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit("."), part(ms % 1000, 3))


def dynamics_of(velocity) -> Column:
    """[P36] Percent of the default forte velocity 90."""
    return _c(velocity) * 100 / 90


def velocity_of_dynamics(dynamics) -> Column:
    """[P36]"""
    return F.least(F.greatest(F.round(_c(dynamics) * 90 / 100), F.lit(1.0)), F.lit(127.0)).cast("int")


def lmms_volume(velocity) -> Column:
    """[P36]"""
    return F.round(_c(velocity) * 100 / 127).cast("int")


def velocity_of_lmms(volume) -> Column:
    """[P36]"""
    return F.least(F.greatest(F.round(_c(volume) * 127 / 100), F.lit(1.0)), F.lit(127.0)).cast("int")


def clip_of(start, frames) -> Column:
    """[P37] start, offset, length of a clip that may begin before the timeline; null if nothing is left."""
    start, frames = _c(start), _c(frames)
    offset = F.greatest(-start, F.lit(0).cast("long"))
    return F.when(frames - offset > 0, F.struct(F.greatest(start, F.lit(0).cast("long")).alias("start"), offset.alias("offset"), (frames - offset).alias("length")))


def resample(samples, speed) -> Column:
    """[P38] Linear interpolation; empty for a speed that is not positive and finite."""
    a, s = _c(samples), _c(speed).cast("double")
    size = F.size(a)
    n = F.when((s > 0) & (s < float("inf")) & ~F.isnan(s), F.floor(size / s)).otherwise(F.lit(0)).cast("int")
    def at(i: Column) -> Column:
        x = i * s
        k = F.floor(x).cast("int")
        low, high = F.coalesce(F.get(a, k), F.lit(0.0)), F.coalesce(F.get(a, k + 1), F.lit(0.0))
        return low + (high - low) * (x - k)
    return F.when(n <= 0, F.array().cast("array<double>")).when(s == 1, a).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at))


def tone(amplitude, frequency, n, rate, fade: int = 64) -> Column:
    """[P39] A decaying sine that fades out."""
    n, t = _c(n), lambda i: i.cast("double") / _c(rate)
    wave = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")), lambda i: _c(amplitude) * F.exp(-3 * t(i)) * F.sin(2 * 3.141592653589793 * _c(frequency) * t(i)))
    return F.when(n <= 0, F.array().cast("array<double>")).otherwise(fade_out(wave, fade))


#: Ticks a beat of FL Studio and REAPER, ticks a bar of LMMS.
FL_PPQ, REAPER_PPQ, LMMS_BAR = 96, 960, 192


def frames_to_units(frames, rate, tempo, units_a_beat: int) -> Column:
    """[P40] Frames as ticks of a project format."""
    return F.round(frames_to_beats(frames, rate, tempo) * units_a_beat).cast("long")


def units_to_frames(units, rate, tempo, units_a_beat: int) -> Column:
    """[P40]"""
    return F.round(_c(units) / units_a_beat * 60 / _c(tempo) * _c(rate)).cast("long")


#: Note values in eighths of a beat, whole to thirty-second, dotted ones beside them.
NOTE_VALUES = (32, 24, 16, 12, 8, 6, 4, 3, 2, 1)


def split_duration(length) -> Column:
    """[P41] Greedy parts of a length, as a list of note values."""
    step = F.struct(_c(length).cast("int").alias("left"), F.array().cast("array<int>").alias("parts"))
    def take(acc: Column, v: Column) -> Column:
        k = F.floor(acc["left"] / v).cast("int")
        return F.struct((acc["left"] - k * v).cast("int").alias("left"), F.concat(acc["parts"], F.array_repeat(v, k)).alias("parts"))
    return F.aggregate(F.array(*map(F.lit, NOTE_VALUES)), step, take, lambda acc: acc["parts"])


def segment(samples, start, length) -> Column:
    """[P43] Slice that is filled up with zeros."""
    a, start, length = _c(samples), _c(start).cast("int"), _c(length).cast("int")
    own = F.slice(a, start + 1, length)
    return F.concat(own, F.array_repeat(F.lit(0.0), length - F.size(own)))


def silence(frames) -> Column:
    """[P44]"""
    return F.array_repeat(F.lit(0.0), _c(frames).cast("int"))


#: Containers by extension and by leading bytes.
EXTENSIONS = {"wav": "wav", "wave": "wav", "aif": "aiff", "aiff": "aiff", "aifc": "aiff", "flac": "flac"}


def container_of_path(path) -> Column:
    """[P45]"""
    ext = F.lower(F.regexp_extract(_c(path), r"\.([^./\\]+)$", 1))
    return _case([(ext.isin([k for k, v in EXTENSIONS.items() if v == name]), name) for name in ("wav", "aiff", "flac")])


def container_of_bytes(content) -> Column:
    """[P45]"""
    head = lambda a, n: F.hex(F.substring(_c(content), a, n))
    return _case([((head(1, 4) == "52494646") & (head(9, 4) == "57415645"), "wav"), ((head(1, 4) == "464F524D") & head(9, 4).isin("41494646", "41494643"), "aiff"), (head(1, 4) == "664C6143", "flac")])


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
