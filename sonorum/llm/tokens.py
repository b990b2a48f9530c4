"""Exact, memoised tokenisation shared by the token operators.

The tokenizers library spends most of its time merging words it has merged
before.  A byte-level vocabulary never merges across a chunk border that one
regular expression finds, so a text is cut into chunks, each chunk is looked up
in a bounded per-process table, and only unseen chunks go to the library, in
batches.  Ids are packed little-endian ``uint32`` bytes, so that a document's
ids are one ``bytes.join``.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Unicode White_Space, which both tokenizers' ``\s`` stands for (fixed values).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters, digits and white space of Latin texts.
LETTER, NUMBER, SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u0233", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: Chunks of a byte-level vocabulary: a run of non-spaces with the one space
#: before it, or the white space that is left; for Latin texts, its pieces.
BYTE_CHUNK = rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
BYTE_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces of a word vocabulary that drops white space, in lower-cased Latin texts.
WORD_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"
#: Anything else than the Latin letters, digits and signs whose lower case and
#: normal form Python and the library are known to share.
NOT_LATIN = re.compile("[^\x01-\u0233]|\u0130")
#: Where an apostrophe and letters may be a piece of their own.
CONTRACTION = re.compile("'(?:[stmd]|re|ve|ll)")
CACHE_ENTRIES = 500_000
LONGEST_CACHED = 64

_loaded: dict = {}


def vocabulary(name: str) -> str:
    """Path of a vocabulary file: an absolute path as it is, a bare name from the installed vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The library's tokenizer; special tokens' strings in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class ByteEncoder:
    """Texts to packed ids by the tokenizers library, chunk by chunk."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.cut, self.cut_latin = re.compile(BYTE_CHUNK).findall, re.compile(BYTE_LATIN).findall
        self.seen: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Packed ``uint32`` ids of each text; empty text, no ids."""
        cut = [(self.cut if NOT_LATIN.search(x) else self.cut_latin)(x) for x in texts]
        seen = self.seen
        if len(seen) > CACHE_ENTRIES:
            seen.clear()
        new = list(set().union(*cut).difference(seen))
        rare: dict[str, bytes] = {}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for key, enc in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                (seen if len(key) <= LONGEST_CACHED else rare)[key] = array("I", enc.ids).tobytes()
        if rare:
            return [b"".join([seen[x] if x in seen else rare[x] for x in c]) for c in cut]
        get = seen.__getitem__
        return [b"".join(map(get, c)) for c in cut]


class WordEncoder:
    """Texts to packed ids as the tokenizers library gives them for a vocabulary with word ends.

    The library needs a microsecond a character.  Latin texts are therefore cut
    into the vocabulary's pieces here and merged by tiktoken: a word's end is a
    NUL byte, whose merge with the letter before it ranks above all others, and
    the merges rank as in the file.  Other texts go to the library.
    """

    def __init__(self, path: str):
        import tiktoken

        self.tokenizer = load(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        to_byte = {c: bytes([b]) for b, c in byte_characters().items()}

        def raw(token: str) -> bytes:
            body = token.removesuffix(end)
            return b"".join(map(to_byte.__getitem__, body)) + b"\0" * (body != token)

        ranks = {bytes([b]): b for b in range(256)}
        names = {b: vocab.get(c, 0) for b, c in byte_characters().items()}
        for b, c in byte_characters().items():
            if b:
                names[len(ranks)] = vocab[c + end]
                ranks[bytes([b, 0])] = len(ranks)
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            joined = raw(left) + raw(right)
            if joined not in ranks:
                names[len(ranks)] = vocab[left + right]
                ranks[joined] = len(ranks)
        self.names = np.array([names[i] for i in range(len(ranks))], "<u4")
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x00]++\x00", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.cut = re.compile(WORD_LATIN).findall

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Packed ``uint32`` ids of each text; empty text, no ids."""
        out = []
        for x in texts:
            if NOT_LATIN.search(x):
                out.append(array("I", self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes())
            else:
                x = x.lower()
                marked = "".join([c + "\0" for c in self.cut(x)]) if CONTRACTION.search(x) else ended(x)
                out.append(self.names[self.merge(marked, disallowed_special=())].tobytes() if marked else b"")
        return out


def _classes() -> np.ndarray:
    """Of each byte pair (the byte before, the byte): what the character is that ends here: 0 space, 1 letter, 2 number, 3 other; 4 if the character goes on."""
    out = np.full((256, 256), 3, np.uint8)
    for b in range(128):
        c = chr(b)
        out[:, b] = 0 if c in "\t\n\x0b\x0c\r " else 1 if c.isalpha() else 2 if c.isdigit() else 3
    out[:, 0xC2:0xC9] = 4
    for code in range(0x80, 0x234):
        lead, last = chr(code).encode()
        c = chr(code)
        out[lead, last] = 0 if c in "\x85\xa0" else 1 if c.isalpha() else 2 if c.isnumeric() else 3
    return out.ravel()


_CLASS = _classes()


def ended(text: str) -> str:
    """A Latin text's pieces, each with a NUL behind it, without white space (the rule of WORD_LATIN where no contraction occurs)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    before = np.zeros(len(raw), np.uint16)
    before[1:] = raw[:-1]
    kind = _CLASS[(before << 8) | raw]
    whole = np.flatnonzero(kind != 4)
    kind = kind[whole]
    last = np.ones(len(kind), bool)
    last[:-1] = (kind[:-1] != kind[1:]) | (kind[:-1] == 2)
    keep = kind != 0
    ends = whole[last & keep]
    kept = np.ones(len(raw), bool)
    kept[whole[~keep]] = False
    two = whole[~keep & (raw[whole] > 127)]
    kept[two - 1] = False
    place = np.cumsum(kept)
    out = np.zeros(int(kept.sum()) + len(ends), np.uint8)
    shift = np.zeros(len(raw) + 1, np.int64)
    shift[ends + 1] = 1
    out[(place - 1 + np.cumsum(shift)[:-1])[kept]] = raw[kept]
    return out.tobytes().decode()


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_encoder(name: str = "byte_bpe_50k.json") -> ByteEncoder:
    """One per process."""
    if ("byte", name) not in _loaded:
        _loaded["byte", name] = ByteEncoder(vocabulary(name))
    return _loaded["byte", name]


def word_encoder(name: str = "word_bpe_49k.json") -> WordEncoder:
    """One per process."""
    if ("word", name) not in _loaded:
        _loaded["word", name] = WordEncoder(vocabulary(name))
    return _loaded["word", name]


def slices(texts: list, size: int = 2_000_000):
    """Index ranges of about ``size`` characters, so that no step holds a whole Arrow batch of long texts."""
    start = held = 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
