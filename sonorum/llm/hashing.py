"""Vectorised hashes of byte spans: a prefix sum of weighted bytes gives the hash of any span in constant time."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2^64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            _powers[k] = out
    return _powers[0], _powers[1]


def prefix(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of weighted bytes; one longer than raw."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, wherever it lies."""
    back = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = BLANK[raw]
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return turns[::2], turns[1::2]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes with a space behind each, and where each starts (one more than there are texts)."""
    parts = [x.encode("utf-8", "surrogatepass") for x in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=starts[1:])
    return np.frombuffer(b" ".join(parts) + b" ", np.uint8), starts


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each text, ascending, one text behind the other; where each text's begin.

    Words are runs of bytes other than ASCII white space, A-Z in lower case.  A
    text of fewer than k words has its whole sequence as its one shingle, a text
    without words none.
    """
    raw, starts = joined(texts)
    raw = LOWER[raw]
    first, end = words(raw)
    hashes = spans(prefix(raw), first, end)
    doc = np.searchsorted(starts, first, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    step = np.uint64(0xA0761D6478BD642F)
    total = len(hashes)
    if total >= k:
        at = np.zeros(total - k + 1, np.uint64)
        for j in range(k):
            at = at * step + hashes[j : total - k + 1 + j]
        same = doc[: total - k + 1] == doc[k - 1 :]
        out, owner = mix(at[same] ^ np.uint64(k)), doc[: total - k + 1][same]
    else:
        out, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(n_words, out=begin[1:])
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        extra = []
        for d in short:
            h = np.zeros(1, np.uint64)
            for w in hashes[begin[d] : begin[d + 1]]:
                h = h * step + w
            extra.append(mix(h ^ np.uint64(n_words[d]))[0])
        out, owner = np.concatenate([out, np.array(extra, np.uint64)]), np.concatenate([owner, short])
    bits = len(texts).bit_length()
    key = owner.astype(np.uint64) << np.uint64(64 - bits) | out >> np.uint64(bits)
    order = np.argsort(key)
    key = key[order]
    if ((key[1:] == key[:-1]) & (out[order[1:]] != out[order[:-1]])).any():  # leading bits alone do not tell
        order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[new], owner[new]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(texts)), out=offsets[1:])
    return out, offsets


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
