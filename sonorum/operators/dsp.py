"""Numeric kernels over whole arrays, and their Arrow-backed columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..errors import InvalidArgumentError, MismatchError
from ..model import HpssOptions, OnsetOptions, PitchOptions, PolyphonicOptions, StftOptions, TempoOptions

#: The grid of onset times and the half-width of their peaks, in seconds.
ONSET_GRID = 0.01
SMOOTHING = 0.04


def window(kind: str, n: int) -> np.ndarray:
    """Periodic windows."""
    p = 2 * np.pi * np.arange(n) / max(n, 1)
    shapes = {"rectangular": lambda: np.ones(n), "hann": lambda: 0.5 - 0.5 * np.cos(p), "hamming": lambda: 0.54 - 0.46 * np.cos(p), "blackman": lambda: 0.42 - 0.5 * np.cos(p) + 0.08 * np.cos(2 * p)}
    if kind not in shapes:
        raise InvalidArgumentError(f"unknown window: {kind}")
    return shapes[kind]()


def overlap_gain(w: np.ndarray, hop: int) -> float:
    """The least sum of squared weights over the positions of a hop."""
    folded = np.zeros(-(-len(w) // hop) * hop)
    folded[: len(w)] = w**2
    return float(folded.reshape(-1, hop).sum(0).min())


def fft(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """[D1] Of a power of two points."""
    n = len(x)
    if n & (n - 1) or not n:
        raise InvalidArgumentError("a transform needs a power of two points")
    return np.fft.ifft(x) if inverse else np.fft.fft(x)


def forward_real(x: np.ndarray) -> np.ndarray:
    """[D2] Zero-padded to a power of two."""
    return np.fft.fft(x, 1 << max(0, len(x) - 1).bit_length())


def magnitude_spectrum(x: np.ndarray) -> np.ndarray:
    s = np.abs(forward_real(x))
    return s[: len(s) // 2 + 1]


def cross_correlate(region: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    """[D3 D15] Dot products of the pattern at every shift at which it lies within the region."""
    shifts = len(region) - len(pattern) + 1
    if shifts <= 0 or not len(pattern):
        return np.zeros(0)
    if shifts * len(pattern) <= 4096:
        return np.correlate(region, pattern, "valid")
    n = 1 << (len(region) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(region, n) * np.conj(np.fft.rfft(pattern, n)), n)[:shifts]


@dataclass
class Spectrogram:
    """frames x bins, complex"""

    bins: np.ndarray
    rate: int
    length: int
    options: StftOptions

    def frame_time(self, frame) -> np.ndarray:
        return (np.asarray(frame) * float(self.options.hop) - self.options.size + self.options.size / 2) / self.rate

    def magnitudes(self) -> np.ndarray:
        return np.abs(self.bins)

    def masked(self, mask: np.ndarray) -> Spectrogram:
        if mask.shape != self.bins.shape:
            raise MismatchError(f"a mask of {mask.shape} for a spectrogram of {self.bins.shape}")
        return Spectrogram(self.bins * mask, self.rate, self.length, self.options)


def stft(x: np.ndarray, rate: int, options: StftOptions = StftOptions()) -> Spectrogram:
    """[D4]"""
    size, hop = options.size, options.hop
    w = window(options.window, size)
    if overlap_gain(w, hop) <= 1e-9:
        raise InvalidArgumentError("the windows do not cover every sample")
    total = len(x) + 2 * size
    total += (size - total) % hop if total > size else 0
    padded = np.zeros(total)
    padded[size : size + len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    return Spectrogram(np.fft.rfft(frames * w, axis=1), rate, len(x), options)


def istft(s: Spectrogram) -> np.ndarray:
    """[D5] Weighted overlap-add."""
    size, hop = s.options.size, s.options.hop
    w = window(s.options.window, size)
    frames = np.fft.irfft(s.bins, size, axis=1) * w
    total = (len(frames) - 1) * hop + size
    out, weight = np.zeros(total), np.zeros(total)
    steps = -(-size // hop)
    for k in range(steps):  # frames a window apart do not overlap: they go in at once
        part = frames[k::steps]
        if len(part):
            at = (np.arange(len(part)) * steps + k)[:, None] * hop + np.arange(size)
            out[at] += part
            weight[at] += w**2
    out = np.where(weight > 1e-12, out / np.where(weight > 1e-12, weight, 1), 0.0)
    return out[size : size + s.length]


def moving_median(x: np.ndarray, span: int, axis: int) -> np.ndarray:
    """[W11] Cut at the edges; the middle of two for even counts."""
    x = np.moveaxis(x, axis, -1)
    half, n = span // 2, x.shape[-1]
    out = np.empty_like(x)
    for i in range(min(half, n)):
        out[..., i] = np.median(x[..., : i + half + 1], -1)
        out[..., n - 1 - i] = np.median(x[..., max(0, n - 1 - i - half) :], -1)
    if n > 2 * half:
        out[..., half : n - half] = np.median(np.lib.stride_tricks.sliding_window_view(x, 2 * half + 1, -1), -1)
    return np.moveaxis(out, -1, axis)


def hpss(s: Spectrogram, options: HpssOptions = HpssOptions()) -> tuple[Spectrogram, Spectrogram]:
    """[D7] Harmonic and percussive parts, which sum to the whole."""
    time, frequency = options.odd()
    m = s.magnitudes()
    h, q = moving_median(m, time, 0) ** options.power, moving_median(m, frequency, 1) ** options.power
    both = h + q
    mask = np.where(both > 0, h / np.where(both > 0, both, 1), 0.5)
    return s.masked(mask), s.masked(1 - mask)


def flux(m: np.ndarray) -> np.ndarray:
    """[W1]"""
    out = np.zeros(len(m))
    if len(m) > 1:
        out[1:] = np.maximum(np.diff(m, axis=0), 0).sum(1)
    return out


def above_baseline(x: np.ndarray, span: int) -> np.ndarray:
    """[W2]"""
    half, at = max(span, 1) // 2, np.arange(len(x))
    sums = np.concatenate([[0.0], np.cumsum(x)])
    low, high = np.maximum(at - half, 0), np.minimum(at + half + 1, len(x))
    return np.maximum(0.0, x - (sums[high] - sums[low]) / np.maximum(high - low, 1))


def onsets(s: Spectrogram, options: OnsetOptions = OnsetOptions()) -> list[tuple[int, int, float]]:
    """[D8 W3 W4] frame, sample, strength of each onset."""
    d = above_baseline(flux(s.magnitudes()), options.span)
    if not len(d) or d.max() <= 0:
        return []
    threshold = max(d.mean() * options.sensitivity, d.max() * options.floor)
    inner = d[1:-1]
    peaks = 1 + np.flatnonzero((inner >= threshold) & (inner >= d[:-2]) & (inner >= d[2:]))
    gap = int(options.gap * s.rate)
    begins = s.frame_time(peaks) * s.rate - s.options.size / 2
    places = np.minimum(np.maximum(begins, 0).astype(np.int64), s.length)
    kept: list[tuple[int, int, float]] = []
    for frame, place in zip(peaks.tolist(), places.tolist(), strict=True):
        own = (frame, place, float(d[frame]))
        if kept and place < kept[-1][1] + gap:
            if own[2] <= kept[-1][2]:
                continue
            kept.pop()
        kept.append(own)
    return kept


def refined(places: list[int], x: np.ndarray, span: int, block: int) -> list[int]:
    """[W6] Each onset moves to the sharpest rise of energy behind it, before the next onset."""
    if not len(x) or not block or not span:
        return places
    sums = np.concatenate([[0.0], np.cumsum(x * x)])
    n, out = len(x), []
    for k, place in enumerate(places):
        limit = places[k + 1] if k + 1 < len(places) else n
        first = min(place, n)
        at = np.arange(first, min(first + span, max(limit, first + 1), n))
        if len(at):
            rise = sums[np.minimum(at + block, n)] - sums[at] - (sums[at] - sums[np.maximum(at - block, 0)])
            first = int(at[rise.argmax()])
        out.append(first)
    return out


def yin(x: np.ndarray, rate: int, options: PitchOptions = PitchOptions()) -> tuple[float, float] | None:
    """[D9] Frequency and confidence, or nothing."""
    if rate <= 0 or options.low <= 0 or options.high <= options.low:
        return None
    low = max(2, int(rate / options.high))
    high = min(int(np.ceil(rate / options.low)), len(x) // 2)
    if high <= low:
        return None
    span = len(x) - high
    n = 1 << (len(x) + span).bit_length()
    dot = np.fft.irfft(np.conj(np.fft.rfft(x[:span], n)) * np.fft.rfft(x, n), n)[: high + 1]
    sums = np.concatenate([[0.0], np.cumsum(x * x)])
    lags = np.arange(high + 1)
    d = np.maximum(sums[span] + sums[lags + span] - sums[lags] - 2 * dot, 0.0)
    d[0] = 0.0
    running = np.cumsum(d)
    norm = np.ones(high + 1)
    norm[1:] = np.where(running[1:] > 0, d[1:] * lags[1:] / np.where(running[1:] > 0, running[1:], 1), 1.0)
    inner = norm[low:high]
    under = np.flatnonzero(inner < options.threshold)
    if len(under):
        at = int(under[0])
        rising = np.flatnonzero(inner[at + 1 :] >= inner[at:-1])
        lag = low + at + (int(rising[0]) if len(rising) else len(inner) - 1 - at)
    else:
        lag = low + int(inner.argmin())
        if norm[lag] >= 1:
            return None
    period = lag + vertex(norm, lag)
    return (rate / period, float(np.clip(1 - norm[lag], 0, 1))) if period > 0 else None


def vertex(x: np.ndarray, k: int) -> float:
    """[P24] Shift of the parabola's vertex through three neighbours."""
    if k < 1 or k + 1 >= len(x):
        return 0.0
    a, b, c = x[k - 1 : k + 2]
    curve = a - 2 * b + c
    shift = 0.5 * (a - c) / curve if abs(curve) >= np.finfo(float).eps else 0.0
    return float(shift) if abs(shift) <= 1 else 0.0


class Pitches:
    """[O5 D10] Greedy voices of a magnitude spectrum: the strongest note goes first and takes its harmonics along."""

    def __init__(self, rate: int, size: int, options: PolyphonicOptions = PolyphonicOptions()):
        self.options, bins = options, size // 2 + 1
        self.notes = np.arange(options.low, options.high + 1)
        f0 = 440 * 2.0 ** ((self.notes - 69) / 12)
        h = np.arange(1, max(1, options.harmonics) + 1)
        at = f0[:, None] * h * size / rate
        k = np.floor(at).astype(np.int64)
        inside = k + 1 < bins
        self.k, self.part = np.where(inside, k, 0), at - k
        self.weight = np.where(inside, 1 / h, 0.0)
        half = np.maximum(at * 0.06, 1.5)
        self.from_ = np.minimum(np.maximum(at - half, 0).astype(np.int64), bins)
        self.to = np.minimum(np.ceil(at + half).astype(np.int64) + 1, bins)

    def saliences(self, m: np.ndarray) -> np.ndarray:
        return ((m[self.k] * (1 - self.part) + m[np.minimum(self.k + 1, len(m) - 1)] * self.part) * self.weight).sum(1)

    def __call__(self, m: np.ndarray) -> list[tuple[int, float]]:
        m, found, taken = m.copy(), [], np.zeros(len(self.notes), bool)
        for _ in range(max(1, self.options.voices)):
            s = np.where(taken, -np.inf, self.saliences(m))
            best = len(s) - 1 - int(s[::-1].argmax())  # of equals the highest note
            if s[best] <= 0 or found and s[best] < found[0][1] * self.options.ratio:
                break
            found.append((int(self.notes[best]), float(s[best])))
            taken[best] = True
            for a, b in zip(self.from_[best], self.to[best], strict=True):
                if a >= b:
                    break
                m[a:b] = 0
        return found


def tracked(s: Spectrogram, options: PolyphonicOptions = PolyphonicOptions()) -> list[tuple[int, int, int, float]]:
    """[D10 W10] start frame, end frame, note, mean salience: runs of frames that hold a note."""
    m = s.magnitudes()
    energy = m.sum(1)
    loud = energy > (energy.max() if len(energy) else 0.0) * options.silence
    pitches = Pitches(s.rate, s.options.size, options)
    rows = [(note, frame, value) for frame in np.flatnonzero(loud).tolist() for note, value in pitches(m[frame])]
    if not rows:
        return []
    note, frame, value = (np.array(c) for c in zip(*sorted(rows), strict=True))
    new = np.concatenate([[True], (np.diff(note) != 0) | (np.diff(frame) != 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(note)))
    mean = np.add.reduceat(value, first) / count
    keep = count >= max(1, options.least_frames)
    return sorted((int(frame[f]), int(frame[f] + c), int(note[f]), float(v)) for f, c, v in zip(first[keep], count[keep], mean[keep], strict=True))


# --- tempo -------------------------------------------------------------------


@dataclass(frozen=True)
class Tempo:
    bpm: float
    period: float
    offset: float
    confidence: float


def _between(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Linear interpolation; 0 behind the end."""
    padded = np.append(x, [0.0, 0.0])
    k = np.minimum(np.floor(at).astype(np.int64), len(x))
    return padded[k] + (padded[np.minimum(k + 1, len(x) + 1)] - padded[k]) * (at - np.floor(at))


def _emphasised(x: np.ndarray, hop: float, o: TempoOptions) -> np.ndarray:
    lifted = above_baseline(x, max(3, int(np.ceil(60 / max(o.low, 1.0) / hop))))
    half = round(SMOOTHING / hop)
    if half and len(lifted):
        kernel = half + 1.0 - np.abs(np.arange(-half, half + 1))
        lifted = np.convolve(lifted, kernel / kernel.sum(), "full")[half : half + len(lifted)]
    return lifted - lifted.mean() if len(lifted) else lifted


def _correlation(x: np.ndarray, most: int) -> np.ndarray:
    """Mean products by lag."""
    n = len(x)
    most = min(most, max(0, n - 1))
    size = 1 << (2 * n).bit_length()
    f = np.fft.rfft(x, size)
    return np.fft.irfft(f * np.conj(f), size)[: most + 1] / (n - np.arange(most + 1))


def _support(c: np.ndarray, lag: float, harmonics: int) -> float:
    if lag < 1:
        return 0.0
    h = np.arange(1, max(1, harmonics) + 1)
    h = h[lag * h + 1 < len(c)]
    return float((np.maximum(_between(c, lag * h), 0) / h).sum()) if len(h) else 0.0


def tempo_candidates(x: np.ndarray, hop: float, o: TempoOptions = TempoOptions()) -> list[tuple[float, int, float, float]]:
    """[D11] bpm, lag, support, score, the fastest first."""
    if not hop > 0 or not np.isfinite(hop):
        return []
    e = _emphasised(np.asarray(x, float), hop, o)
    slow, fast = max(min(o.low, o.high), 1.0), max(o.low, o.high)
    low, high = max(1, round(60 / fast / hop)), min(max(1, round(60 / slow / hop)), len(e) // 2)
    if low > high:
        return []
    c = _correlation(e, high * max(1, o.harmonics))
    out = []
    for lag in range(low, high + 1):
        bpm = 60 / (lag * hop)
        support = _support(c, lag, o.harmonics)
        out.append((bpm, lag, support, support * float(np.exp(-0.5 * (np.log2(bpm / o.prefer) / max(o.spread, 1e-6)) ** 2))))
    return out


def tempo_of_flux(x: np.ndarray, hop: float, o: TempoOptions = TempoOptions()) -> Tempo | None:
    """[D11 W22 W23 O7]"""
    found = tempo_candidates(x, hop, o)
    if not found:
        return None
    _, best, _, score = max(found, key=lambda f: (f[3], -f[1]))
    if score <= 0:
        return None
    e = _emphasised(np.asarray(x, float), hop, o)
    c = _correlation(e, best * max(1, o.harmonics))
    lag, shortest = float(best), 60 / max(o.low, o.high) / hop
    while lag / 2 >= max(shortest - 0.5, 1.0) and _support(c, lag / 2, o.harmonics) >= _support(c, lag, o.harmonics) * o.octave:
        lag /= 2
    k = int(np.floor(lag + 0.5))
    frames = k + vertex(c, k)
    sums = [float(_between(e, np.arange(s, len(e), frames)).sum()) for s in range(max(1, int(np.ceil(frames))))]
    mean = sum(f[3] for f in found) / len(found)
    return Tempo(60 / (frames * hop), frames * hop, int(np.argmax(sums)) * hop, float(np.clip(1 - mean / score, 0, 1)))


def tempo_of_onsets(times, o: TempoOptions = TempoOptions()) -> Tempo | None:
    """[D11] From onset times in seconds, each shared out between the two grid points around it."""
    times = np.asarray([t for t in times if np.isfinite(t)], float)
    if not len(times):
        return None
    x = np.zeros(max(0, int(np.ceil(times.max() / ONSET_GRID))) + 2)
    at = times[times >= 0] / ONSET_GRID
    k = at.astype(np.int64)
    np.add.at(x, k, 1 - (at - k))
    np.add.at(x, k + 1, at - k)
    return tempo_of_flux(x, ONSET_GRID, o)


def tempo(s: Spectrogram, o: TempoOptions = TempoOptions()) -> Tempo | None:
    return tempo_of_flux(flux(s.magnitudes()), s.options.hop / s.rate, o)


# --- envelopes ---------------------------------------------------------------


def envelope(x: np.ndarray, block: int, hop: int, kind: str = "rms") -> np.ndarray:
    """[A13] Blocks every hop; the last ones are short."""
    if not block or not hop:
        return np.zeros(0)
    parts = (x[a : a + block] for a in range(0, len(x), hop))
    return np.array([np.sqrt(np.mean(p * p)) if kind == "rms" else np.abs(p).max() for p in parts])


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(x * x))) if len(x) else 0.0
