"""Tables, sample formats and options of the signal model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import InvalidArgumentError

#: Name, bits, float?, quantum, least code, greatest code.
FORMATS: dict[str, tuple[int, bool, float | None, int | None, int | None]] = {
    "pcm_u8": (8, False, 2.0**-7, -(2**7), 2**7 - 1),
    "pcm_i16": (16, False, 2.0**-15, -(2**15), 2**15 - 1),
    "pcm_i24": (24, False, 2.0**-23, -(2**23), 2**23 - 1),
    "pcm_i32": (32, False, 2.0**-31, -(2**31), 2**31 - 1),
    "f32": (32, True, None, None, None),
    "f64": (64, True, None, None, None),
}
ALIASES = {"u8": "pcm_u8", "i16": "pcm_i16", "s16": "pcm_i16", "i24": "pcm_i24", "s24": "pcm_i24", "i32": "pcm_i32", "s32": "pcm_i32", "float32": "f32", "float": "f32", "float64": "f64", "double": "f64"}

GAIN_ONE = 65536

SIGNAL = T.StructType([T.StructField("recording_id", T.StringType()), T.StructField("sample_rate", T.IntegerType()), T.StructField("format", T.StringType()), T.StructField("channel", T.IntegerType()), T.StructField("frames", T.LongType()), T.StructField("samples", T.ArrayType(T.DoubleType()))])
SOURCE = "recording_id string, name string, sample_rate int, format string, channels int, frames long"
EVENT = "recording_id string, ord long, channel int, start long, length long"
BANK = "recording_id string, sample_id long, name string, waveform array<double>, note int, frequency double, peak double"
PLACEMENT = "recording_id string, ord long, sample_id long, channel int, start long, gain_num long"
NOTE = "recording_id string, channel int, start long, length long, note int, velocity int, frequency double, confidence double"
STEM = "recording_id string, name string, channel int, samples array<double>"


def format_name(text: str) -> str:
    """The name of a sample format, from it or an alias."""
    key = text.strip().lower()
    key = ALIASES.get(key, key)
    if key not in FORMATS:
        raise InvalidArgumentError(f"unknown sample format: {text}")
    return key


@dataclass(frozen=True)
class MatchOptions:
    tolerance: float = 0.12
    radius: int = 0
    least_gain: float = 0.05
    greatest_gain: float = 8.0
    inversion: bool = True


@dataclass(frozen=True)
class StftOptions:
    size: int = 2048
    hop: int = 512
    window: str = "hann"

    def __post_init__(self) -> None:
        if self.size < 2 or self.size & (self.size - 1):
            raise InvalidArgumentError("the transform size must be a power of two")
        if not 0 < self.hop <= self.size:
            raise InvalidArgumentError("the hop must lie between 1 and the transform size")

    @classmethod
    def of_size(cls, size: int) -> StftOptions:
        return cls(size, size // 4)


@dataclass(frozen=True)
class OnsetOptions:
    span: int = 15
    sensitivity: float = 1.5
    gap: float = 0.03
    floor: float = 0.02


@dataclass(frozen=True)
class HpssOptions:
    time_span: int = 17
    frequency_span: int = 17
    power: float = 2.0

    def odd(self) -> tuple[int, int]:
        return max(1, self.time_span) | 1, max(1, self.frequency_span) | 1


@dataclass(frozen=True)
class PitchOptions:
    low: float = 27.5
    high: float = 4186.0
    threshold: float = 0.15


@dataclass(frozen=True)
class PolyphonicOptions:
    low: int = 21
    high: int = 108
    harmonics: int = 8
    voices: int = 6
    ratio: float = 0.45
    silence: float = 0.01
    least_frames: int = 2


@dataclass(frozen=True)
class TempoOptions:
    low: float = 60.0
    high: float = 200.0
    prefer: float = 120.0
    spread: float = 0.9
    harmonics: int = 4
    octave: float = 0.7


@dataclass(frozen=True)
class EventOptions:
    least: float = 0.01
    most: float = 2.0
    per_channel: bool = False
    refine: bool = True
    stft: StftOptions = field(default_factory=StftOptions)
    onset: OnsetOptions = field(default_factory=OnsetOptions)


@dataclass(frozen=True)
class NoteOptions:
    least: float = 0.03
    stft: StftOptions = field(default_factory=StftOptions)
    polyphonic: PolyphonicOptions = field(default_factory=PolyphonicOptions)


@dataclass(frozen=True)
class DecomposeOptions:
    search: float = 0.01
    candidates: int = 24
    silence: float = 1e-6
    notes: bool = True
    stems: bool = True
    match: MatchOptions = field(default_factory=MatchOptions)
    events: EventOptions = field(default_factory=EventOptions)
    note: NoteOptions = field(default_factory=NoteOptions)
    hpss: HpssOptions = field(default_factory=HpssOptions)
    stft: StftOptions = field(default_factory=StftOptions)
    pitch: PitchOptions = field(default_factory=PitchOptions)

    def exact_only(self) -> DecomposeOptions:
        """Only exact repeats: no tolerance, no search, so no second pass."""
        from dataclasses import replace

        return replace(self, search=0.0, match=replace(self.match, tolerance=0.0))

    def without_analysis(self) -> DecomposeOptions:
        from dataclasses import replace

        return replace(self, notes=False, stems=False)


@dataclass(frozen=True)
class SessionOptions:
    tempo: float = 120.0
    stems: bool = True
    bank: bool = True
    residual: bool = True
    notes: bool = True
    estimate: bool = True
    confidence: float = 0.5


@dataclass(frozen=True)
class ArrangeOptions:
    sine: bool = True
    velocity: bool = True
    trim: bool = False
    fade: int = 64
    tail: float = 1.0
    normalize: bool = True
    format: str | None = None
