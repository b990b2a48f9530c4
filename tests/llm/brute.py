"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

BLANK = " \t\n\x0b\x0c\r"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def components(rows, k=5, percent=75):
    """doc_id, n_shingles, component_id of (doc_id, text) rows."""
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        label = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), label) for i in members]
    return sorted(out, key=str)


def repeats(rows, window=100):
    """doc_id, n_bytes, n_removed, n_spans, sha256 of what is kept."""
    seen, out = set(), {}
    low = lambda d: -(2**63) if d is None else d
    for d, t in sorted({(low(d), t or "") for d, t in rows}):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if b[i : i + window] in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(b[i : i + window])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d, t] = len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()
    return sorted(((d, *out[low(d), t or ""]) for d, t in rows), key=str)


def lines(rows, least=10):
    """doc_id, n_lines, n_dropped, kept text."""
    key = lambda x: lower(x.strip(BLANK))
    split = [(d, (t or "").split("\n")) for d, t in rows]
    held = Counter(k for _, ls in split for k in {key(x) for x in ls} if k)
    out = []
    for d, ls in split:
        kept = [x for x in ls if held[key(x)] < least or not key(x)]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


WORD = (1 << 64) - 1


def scramble(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & WORD
    x = (x ^ x >> 27) * 0x94D049BB133111EB & WORD
    return x ^ x >> 31


def word_hash(word):
    """A polynomial of scrambled bytes, modulo 2^64, and the length."""
    total = sum(scramble((b + 1) * 0xD1342543DE82EF95 & WORD) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word))
    return scramble((total + len(word) * 0x2545F4914F6CDD1D) & WORD)


def simhash(text, lanes=4):
    """The fingerprint as a number of 64 * lanes bits, one bit and one term at a time."""
    own = [word_hash(w.encode()) for w in re.findall("[^\x20\x09-\x0d]+", lower(text))]
    pairs = [scramble((a * 3 + b * 7) & WORD) for a, b in zip(own, own[1:])]
    weights = {t: round(16 * (1 + math.log(n))) for t, n in Counter(own + pairs).items()}
    out = 0
    for lane in range(1, lanes + 1):
        hashes = {t: int.from_bytes(scramble(t ^ (lane * 0x9E3779B97F4A7C15 & WORD)).to_bytes(8, "little")) for t in weights}
        for bit in reversed(range(64)):
            out = out << 1 | (sum(w if hashes[t] >> bit & 1 else -w for t, w in weights.items()) > 0)
    return out
