"""FLAC, reader and writer, on bit strings held as Python integers and NumPy arrays.

The writer knows constant, verbatim, fixed-predictor and fitted-predictor
subframes with Rice partitions and the four stereo pairings, and takes the
cheapest of each; low bits that no sample of a subframe uses are left out.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

from ..errors import FormatError, UnsupportedError
from ..model import FORMATS
from .audio import Audio

BLOCK = 4096
#: Highest order of fitted predictors, bits of their coefficients.
ORDERS, PRECISION = 12, 14
KINDS = {8: "pcm_u8", 16: "pcm_i16", 24: "pcm_i24", 32: "pcm_i32"}
#: Coefficients of the fixed predictors, latest sample first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Block sizes and rates by their codes in a frame header.
BLOCK_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _crc_table(width: int, polynomial: int) -> list[int]:
    out, top, mask = [], 1 << (width - 1), (1 << width) - 1
    for value in range(256):
        value <<= width - 8
        for _ in range(8):
            value = ((value << 1) ^ polynomial if value & top else value << 1) & mask
        out.append(value)
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def crc8(data: bytes) -> int:
    value = 0
    for b in data:
        value = _CRC8[value ^ b]
    return value


def crc16(data: bytes) -> int:
    value = 0
    for b in data:
        value = (value << 8 & 0xFFFF) ^ _CRC16[value >> 8 ^ b]
    return value


class BitReader:
    """Bits of a byte string from the most significant down."""

    def __init__(self, data: bytes, start: int = 0):
        self.data, self.at = data, start * 8
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.ones = np.flatnonzero(self.bits)

    def unsigned(self, n: int) -> int:
        if not n:
            return 0
        end = self.at + n
        if end > len(self.bits):
            raise FormatError("FLAC data end early")
        first, last = self.at // 8, (end + 7) // 8
        value = int.from_bytes(self.data[first:last]) >> (last * 8 - end) & ((1 << n) - 1)
        self.at = end
        return value

    def signed(self, n: int) -> int:
        value = self.unsigned(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        """Zeros before the next one."""
        k = np.searchsorted(self.ones, self.at)
        if k == len(self.ones):
            raise FormatError("FLAC data end early")
        count = int(self.ones[k]) - self.at
        self.at += count + 1
        return count

    def number(self) -> int:
        """A number coded as UTF-8 codes characters."""
        first = self.unsigned(8)
        if first < 0x80:
            return first
        length = 8 - (first ^ 0xFF).bit_length()
        if not 2 <= length <= 7:
            raise FormatError("a FLAC frame number is damaged")
        value = first & ((1 << (7 - length)) - 1)
        for _ in range(length - 1):
            following = self.unsigned(8)
            if following >> 6 != 2:
                raise FormatError("a FLAC frame number is damaged")
            value = value << 6 | following & 0x3F
        return value

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


class BitWriter:
    """Bits as arrays, one for every run of values that are written alike."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def unsigned(self, value: int, n: int) -> None:
        self.values(np.array([value], np.int64), n)

    def values(self, values: np.ndarray, n: int) -> None:
        """The lowest n bits of each value."""
        self.parts.append((values[:, None] >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8).ravel())

    def rice(self, folded: np.ndarray, k: int) -> None:
        """Of each value: what is above k bits in unary, then the k bits."""
        ends = np.cumsum((folded >> k) + 1 + k)
        bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        bits[ends - k - 1] = 1
        for j in range(k):
            bits[ends - 1 - j] = folded >> j & 1
        self.parts.append(bits)

    def number(self, value: int) -> None:
        if value < 0x80:
            return self.unsigned(value, 8)
        length = next(k for k in range(2, 8) if value < 1 << (5 * k + 1))
        self.unsigned((0xFF00 >> length & 0xFF) | value >> (6 * (length - 1)), 8)
        for k in range(length - 2, -1, -1):
            self.unsigned(0x80 | value >> (6 * k) & 0x3F, 8)

    def finish(self) -> bytes:
        return np.packbits(np.concatenate(self.parts)).tobytes() if self.parts else b""


def md5_of(codes: np.ndarray, bits: int) -> bytes:
    """Digest of interleaved little-endian samples."""
    width = -(-bits // 8)
    raw = codes.T.ravel().astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]
    return hashlib.md5(raw.tobytes()).digest()


# --- reading -----------------------------------------------------------------


def _residual(r: BitReader, block: int, order: int) -> np.ndarray:
    method = r.unsigned(2)
    if method > 1:
        raise FormatError("an unknown FLAC residual coding")
    width, partitions = (5 if method else 4), 1 << r.unsigned(4)
    if block % partitions or block // partitions < order:
        raise FormatError("FLAC partitions do not fit")
    out = np.empty(block - order, np.int64)
    at = 0
    for k in range(partitions):
        n = block // partitions - (order if k == 0 else 0)
        rice = r.unsigned(width)
        if rice == (1 << width) - 1:
            size = r.unsigned(5)
            out[at : at + n] = [r.signed(size) for _ in range(n)]
        else:
            for i in range(at, at + n):
                folded = r.unary() << rice | r.unsigned(rice)
                out[i] = folded >> 1 ^ -(folded & 1)
        at += n
    return out


def _predicted(warm: list[int], residual: np.ndarray, coefficients: tuple[int, ...], shift: int) -> list[int]:
    out = list(warm)
    order = len(coefficients)
    for e in residual.tolist():
        total = 0
        for k in range(order):
            total += coefficients[k] * out[-1 - k]
        out.append(e + (total >> shift))
    return out


def _subframe(r: BitReader, block: int, bits: int) -> np.ndarray:
    if r.unsigned(1):
        raise FormatError("a FLAC subframe is damaged")
    kind = r.unsigned(6)
    wasted = r.unary() + 1 if r.unsigned(1) else 0
    bits -= wasted
    if kind == 0:
        out = np.full(block, r.signed(bits), np.int64)
    elif kind == 1:
        out = np.array([r.signed(bits) for _ in range(block)], np.int64)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = [r.signed(bits) for _ in range(order)]
        out = np.array(_predicted(warm, _residual(r, block, order), FIXED[order], 0), np.int64)
    elif kind >= 32:
        order = kind - 31
        warm = [r.signed(bits) for _ in range(order)]
        precision = r.unsigned(4) + 1
        shift = r.signed(5)
        if precision == 16 or shift < 0:
            raise FormatError("a FLAC predictor is damaged")
        coefficients = tuple(r.signed(precision) for _ in range(order))
        out = np.array(_predicted(warm, _residual(r, block, order), coefficients, shift), np.int64)
    else:
        raise FormatError("an unknown FLAC subframe")
    return out << wasted


def _frame(r: BitReader, info: tuple) -> np.ndarray:
    rate, channels, bits = info
    start = r.at // 8
    if r.unsigned(15) != 0x7FFC:
        raise FormatError("a FLAC frame does not begin where it should")
    r.unsigned(1)
    size_code, rate_code, layout, bits_code = r.unsigned(4), r.unsigned(4), r.unsigned(4), r.unsigned(3)
    r.unsigned(1)
    r.number()
    block = r.unsigned(8) + 1 if size_code == 6 else r.unsigned(16) + 1 if size_code == 7 else BLOCK_SIZES.get(size_code)
    if block is None:
        raise FormatError("an unknown FLAC block size")
    r.unsigned({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    own_bits = BITS.get(bits_code, bits)
    if crc8(r.data[start : r.at // 8]) != r.unsigned(8):
        raise FormatError("a FLAC frame header is damaged")
    if layout > 10:
        raise FormatError("an unknown FLAC channel layout")
    wide = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(layout)
    n = 2 if wide else layout + 1
    parts = [_subframe(r, block, own_bits + (wide[k] if wide else 0)) for k in range(n)]
    r.align()
    if crc16(r.data[start : r.at // 8]) != r.unsigned(16):
        raise FormatError("a FLAC frame is damaged")
    if layout == 8:
        parts[1] = parts[0] - parts[1]
    elif layout == 9:
        parts[0] = parts[0] + parts[1]
    elif layout == 10:
        middle, side = parts
        middle = middle << 1 | side & 1
        parts = [(middle + side) >> 1, (middle - side) >> 1]
    if n != channels:
        raise FormatError("FLAC frames differ in channels")
    return np.stack(parts)


def decode(data: bytes) -> Audio:
    if data[:4] != b"fLaC":
        raise FormatError("not a FLAC file")
    at, info = 4, None
    while True:
        if at + 4 > len(data):
            raise FormatError("FLAC metadata end early")
        head, size = data[at], int.from_bytes(data[at + 1 : at + 4])
        body = data[at + 4 : at + 4 + size]
        if head & 0x7F == 0:
            packed = int.from_bytes(body[10:18])
            info = (packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1), packed & ((1 << 36) - 1), body[18:34]
        at += 4 + size
        if head >> 7:
            break
    if info is None:
        raise FormatError("a FLAC file needs its stream information")
    (rate, channels, bits), total, digest = info
    if bits not in KINDS:
        raise UnsupportedError(f"FLAC of {bits} bits")
    r, frames, got = BitReader(data, at), [], 0
    while (got < total) if total else (r.at + 16 <= len(r.bits)):
        frames.append(_frame(r, info[0]))
        got += frames[-1].shape[1]
    codes = np.concatenate(frames, 1) if frames else np.zeros((channels, 0), np.int64)
    if total and codes.shape[1] != total:
        raise FormatError("FLAC frames do not add up")
    if digest != bytes(16) and md5_of(codes, bits) != digest:
        raise FormatError("FLAC samples differ from their digest")
    return Audio.from_codes(rate, KINDS[bits], codes)


# --- writing -----------------------------------------------------------------


def _rice_cost(folded: np.ndarray, k: int) -> int:
    return int((folded >> k).sum()) + len(folded) * (k + 1)


def _best_rice(folded: np.ndarray) -> tuple[int, int]:
    """Cost and parameter."""
    mean = float(folded.mean()) if len(folded) else 0.0
    guess = min(29, int(np.log2(mean + 1)))
    return min((_rice_cost(folded, k), k) for k in range(max(0, guess - 1), guess + 2))


def _coded(residual: np.ndarray, block: int, order: int) -> tuple[int, int, list[int]]:
    """Cost, partition order and parameters of the cheapest Rice coding."""
    folded = residual << 1 ^ residual >> 63
    best = None
    for p in range(9):
        if block % (1 << p) or block >> p <= order:
            break
        edges = [max(0, k * (block >> p) - order) for k in range((1 << p) + 1)]
        parts = [_best_rice(folded[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        cost = sum(c for c, _ in parts) + 5 * len(parts)
        if best is None or cost < best[0]:
            best = cost, p, [k for _, k in parts]
    return best


def _predictors(samples: np.ndarray, limit: int):
    """Coefficients and shift of the predictors of order 1 to limit that fit the samples best.

    Normal equations of the samples under a parabolic window, solved order by order.
    """
    n = len(samples)
    shaped = samples * (1 - ((2 * np.arange(n) + 1) / n - 1) ** 2)
    lags = np.array([shaped[k:] @ shaped[: n - k] for k in range(limit + 1)])
    fit, error = np.zeros(0), lags[0]
    for order in range(1, limit + 1):
        if error <= 0:
            return
        reflected = (lags[order] - fit @ lags[order - 1 : 0 : -1]) / error
        fit = np.append(fit - reflected * fit[::-1], reflected)
        error *= 1 - reflected * reflected
        shift = min(15, PRECISION - 1 - int(np.frexp(np.abs(fit).max())[1]))
        if shift >= 0:
            top = 1 << (PRECISION - 1)
            yield np.clip(np.round(fit * (1 << shift)), -top, top - 1).astype(np.int64), shift


def _left_over(samples: np.ndarray, coefficients: np.ndarray, shift: int) -> np.ndarray:
    order, n = len(coefficients), len(samples)
    total = sum(c * samples[order - 1 - k : n - 1 - k] for k, c in enumerate(coefficients))
    return samples[order:] - (total >> shift)


def _fitted(samples: np.ndarray, bits: int) -> tuple | None:
    """Coefficients, shift and residual of the fitted predictor that should cost least, by its mean residual."""
    best = None
    for coefficients, shift in _predictors(samples, min(ORDERS, len(samples) - 1)):
        residual = _left_over(samples, coefficients, shift)
        if np.abs(residual).max(initial=0) < 1 << 31:
            cost = len(residual) * np.log2(np.abs(residual).mean() + 0.5) + len(coefficients) * (bits + PRECISION)
            if best is None or cost < best[0]:
                best = cost, (coefficients, shift, residual)
    return best and best[1]


def _plan(samples: np.ndarray, bits: int) -> tuple:
    """Cost, kind and details of the cheapest subframe, and the low bits that are zero in all its samples."""
    n = len(samples)
    if (samples == samples[0]).all():
        return bits + 8, "constant", None, 0
    used = int(np.bitwise_or.reduce(samples))
    spare = (used & -used).bit_length() - 1
    samples, bits = samples >> spare, bits - spare
    best = (n * bits + 8, "verbatim", None)
    residual = samples
    for order in range(min(5, n)):
        if order:
            residual = np.diff(residual)
        if np.abs(residual).max(initial=0) >= 1 << 31:
            continue
        cost, p, rice = _coded(residual, n, order)
        cost += 8 + order * bits + 6
        if cost < best[0]:
            best = cost, "fixed", (order, residual, p, rice)
    fitted = _fitted(samples, bits)
    if fitted:
        coefficients, shift, residual = fitted
        order = len(coefficients)
        cost, p, rice = _coded(residual, n, order)
        cost += 8 + order * (bits + PRECISION) + 4 + 5 + 6
        if cost < best[0]:
            best = cost, "fitted", (order, residual, p, rice, coefficients, shift)
    cost, kind, details = best
    return cost + spare, kind, details, spare


def _write_subframe(w: BitWriter, samples: np.ndarray, bits: int, plan: tuple) -> None:
    _, kind, details, spare = plan
    code = {"constant": 0, "verbatim": 1, "fixed": 8, "fitted": 31}[kind] + (details[0] if details else 0)
    w.unsigned(code << 1 | (spare > 0), 8)
    if spare:
        w.unsigned(1, spare)
    samples, bits = samples >> spare, bits - spare
    if kind in ("constant", "verbatim"):
        w.values(samples[:1] if kind == "constant" else samples, bits)
        return
    order, residual, p, rice, *fitted = details
    w.values(samples[:order], bits)
    if fitted:
        coefficients, shift = fitted
        w.unsigned(PRECISION - 1, 4)
        w.unsigned(shift, 5)
        w.values(coefficients, PRECISION)
    w.unsigned(1, 2)
    w.unsigned(p, 4)
    folded = residual << 1 ^ residual >> 63
    edges = [max(0, k * (len(samples) >> p) - order) for k in range((1 << p) + 1)]
    for a, b, k in zip(edges, edges[1:], rice, strict=False):
        w.unsigned(k, 5)
        w.rice(folded[a:b], k)


def encode(audio: Audio) -> bytes:
    bits = next((k for k, v in KINDS.items() if v == audio.format), None)
    if bits is None:
        raise UnsupportedError("FLAC keeps integer samples only")
    if len(audio.channels) > 8:
        raise UnsupportedError("FLAC keeps eight channels at most")
    codes = audio.codes()
    packed = audio.sample_rate << 44 | (len(codes) - 1) << 41 | (bits - 1) << 36 | audio.frames
    info = struct.pack(">HH", BLOCK, BLOCK) + bytes(6) + packed.to_bytes(8) + md5_of(codes, bits)
    out = [b"fLaC", bytes([0x80]), len(info).to_bytes(3), info]
    bits_code = next(k for k, v in BITS.items() if v == bits)
    for number, at in enumerate(range(0, audio.frames, BLOCK)):
        block = codes[:, at : at + BLOCK]
        n = block.shape[1]
        layout, parts, widths = len(block) - 1, list(block), [bits] * len(block)
        plans = [_plan(p, w) for p, w in zip(parts, widths, strict=True)]
        if len(block) == 2:
            left, right = block
            middle, side = (left + right) >> 1, left - right
            own = {"l": plans[0], "r": plans[1], "m": _plan(middle, bits), "s": _plan(side, bits + 1)}
            cost, layout, names = min(((own[a][0] + own[b][0], code, (a, b)) for code, (a, b) in {1: "lr", 8: "ls", 9: "sr", 10: "ms"}.items()), key=lambda x: x[0])
            series = {"l": left, "r": right, "m": middle, "s": side}
            parts, widths, plans = [series[k] for k in names], [bits + (k == "s") for k in names], [own[k] for k in names]
        w = BitWriter()
        w.unsigned(0x7FFC << 1, 16)
        w.unsigned(7, 4)
        w.unsigned(0, 4)
        w.unsigned(layout, 4)
        w.unsigned(bits_code, 3)
        w.unsigned(0, 1)
        w.number(number)
        w.unsigned(n - 1, 16)
        head = w.finish()
        w = BitWriter()
        for p, width, plan in zip(parts, widths, plans, strict=True):
            _write_subframe(w, p, width, plan)
        frame = head + bytes([crc8(head)]) + w.finish()
        out += [frame, crc16(frame).to_bytes(2)]
    return b"".join(out)
