"""Toxicity scores: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features are densities of lexicon words (a short fixed list, and words and word
beginnings that training documents marked toxic hold far more often than
others), their nearness to the second person, and rates of capitals,
punctuation, obfuscated spelling and symbols.  Trees are fitted by histogram
boosting on the logistic loss, scores are calibrated by pool-adjacent-violators.

Training takes at most SAMPLE labelled rows, those of the smallest hash of
doc_id among the rows offered, in three disjoint folds: lexicon, trees,
calibration.  Everything else covers all rows.

Defined results: null or empty text gets the score of its (zero) features;
repeated rows get equal scores; without labels of both kinds only the fixed
lexicon scores; several labels of one doc_id count as toxic if one is; null
labels are ignored; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, released, ship, text_slices

SAMPLE = 40_000
THRESHOLD = 0.3
LEXICON_UNITS = 3_000
TREES, DEPTH, RATE, BINS, LEAST = 120, 3, 0.1, 48, 10

# Insults and words of the second person.
INSULTS = frozenset("idiot idiots moron morons stupid loser losers pathetic worthless disgusting trash scum clown clowns dumb fool jerk ugly garbage filth vermin imbecile cretin coward bastard bitch asshole".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch usted ustedes vosotros".split())
SPELLED = str.maketrans("013457@$!|", "oieastasii")

WORDS = re.compile(r"[^\s.,;:?()\[\]{}<>\"“”«»¡¿/\\]+").findall
ODD = re.compile(r"[^\W\d_][@$*#%&!|0-9]+[^\W\d_]")
STRETCHED = re.compile(r"(.)\1{2,}")
SYMBOLS = re.compile(r"[%$#&*@^~=+|]")
EDGES = "'’`*#%&!$@^~=+|_-"
FEATURES = 18


def plain(word: str) -> str:
    """A word as the lexicon spells it."""
    word = word.strip(EDGES).lower()
    if ODD.search(word):
        word = word.translate(SPELLED)
        word = "".join(c for c in word if c.isalpha())
    return STRETCHED.sub(r"\1", word) if STRETCHED.search(word) else word


def units(word: str) -> list[str]:
    """What the learned lexicon may hold of a word: itself and its beginnings."""
    return [word, *(f"{word[:k]}*" for k in range(4, min(8, len(word))))]


class Reader:
    """Texts to features; keeps what it knows of a word."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def word(self, raw: str) -> tuple[float, int]:
        """The weight of the word in the learned lexicon; 1 insult, 2 second person, 4 obfuscated, as bits."""
        if raw not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            word = plain(raw)
            weight = max((self.lexicon.get(x, 0.0) for x in units(word)), default=0.0)
            self.known[raw] = (weight, (word in INSULTS) + 2 * (word in SECOND_PERSON) + 4 * bool(ODD.search(raw.strip(EDGES))))
        return self.known[raw]

    def __call__(self, text: str) -> list[float]:
        words = WORDS(text)
        n = max(1, len(words))
        counts = Counter(words)
        told = {w: self.word(w) for w in counts}
        heavy = [(told[w][0], c) for w, c in counts.items() if told[w][0] > 0]
        weights = sorted((v for v, c in heavy for _ in range(min(c, 3))), reverse=True)[:3]
        learned = sum(c for w, c in counts.items() if told[w][0] > 0)
        insults = sum(c for w, c in counts.items() if told[w][1] & 1)
        second = sum(c for w, c in counts.items() if told[w][1] & 2)
        near = 0
        if second and (learned or insults):
            bits = [told[w] for w in words]
            near = sum(1 for i, x in enumerate(bits) if (x[0] > 0 or x[1] & 1) and any(y[1] & 2 for y in bits[max(0, i - 3) : i + 4]))
        chars = max(1, len(text))
        letters = max(1, sum(map(len, words)))
        upper = sum(c * sum(map(str.isupper, w)) for w, c in counts.items() if not w.islower())
        shout = sum(c for w, c in counts.items() if len(w) > 2 and w.isupper())
        return [
            math.log1p(len(words)), insults / n, math.log1p(insults), learned / n, math.log1p(learned), math.fsum(v * c for v, c in heavy) / n,
            weights[0] if weights else 0.0, sum(weights), near / n, math.log1p(near), second / n, upper / letters, shout / n,
            text.count("!") / chars, text.count("?") / chars, sum(c for w, c in counts.items() if told[w][1] & 4) / n,
            len(SYMBOLS.findall(text)) / chars, len(counts) / n,
        ]


class Trees:
    """Boosted regression trees of fixed depth on binned features, logistic loss."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.trees: list[list[tuple]] = []
        binned, score = self._bins(x), np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            self.trees.append(self._grow(binned, y - p, p * (1 - p)))
            score += RATE * self._leaf(self.trees[-1], binned)
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.int32)

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple]:
        """Levels of (feature, cut) by node, then the leaves' values; feature -1: all go left."""
        node, levels = np.zeros(len(g), np.int64), []
        for depth in range(DEPTH):
            width = 1 << depth
            best = [(1e-9, -1, 0)] * width
            for f in range(binned.shape[1]):
                at = node * (BINS + 1) + binned[:, f]
                gs, hs, cs = (np.bincount(at, w, width * (BINS + 1)).reshape(width, -1) for w in (g, h, None))
                gl, hl, cl = (np.cumsum(v, 1) for v in (gs, hs, cs))
                gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(cl < LEAST) | (ct - cl < LEAST)] = 0
                for k, cut in enumerate(gain.argmax(1)):
                    if gain[k, cut] > best[k][0]:
                        best[k] = (float(gain[k, cut]), f, int(cut))
            levels.append(([b[1] for b in best], [b[2] for b in best]))
            node = self._down(levels[-1], node, binned)
        leaves = np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
        return [*levels, leaves]

    @staticmethod
    def _down(level: tuple, node: np.ndarray, binned: np.ndarray) -> np.ndarray:
        feature, cut = np.array(level[0])[node], np.array(level[1])[node]
        return node * 2 + ((feature >= 0) & (binned[np.arange(len(node)), feature] > cut))

    def _leaf(self, tree: list, binned: np.ndarray) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)
        for level in tree[:-1]:
            node = self._down(level, node, binned)
        return tree[-1][node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = self._bins(x)
        return self.base + RATE * sum(self._leaf(t, binned) for t in self.trees)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending raw scores and the share of ones, one point a pool (with half a row of either label to start)."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, sum of raw
    for r, v in zip(raw[order], y[order], strict=True):
        pools.append([float(v), 1.0, float(r)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.02) / (p[1] + 0.04 / max(0.05, float(y.mean()))) for p in pools])


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees | None, points: tuple[np.ndarray, np.ndarray] | None):
        self.lexicon, self.trees, self.points = lexicon, trees, points

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.minimum(1.0, 1 - np.exp(-20 * x[:, 1]))
        raw = self.trees.raw(x)
        own = 1 / (1 + np.exp(-raw))
        calibrated = np.interp(raw, *self.points) if self.points is not None else own
        return np.clip(0.99 * calibrated + 0.01 * own, 0.0, 1.0)


def _features(docs: DataFrame, chosen, lexicon: dict[str, float]) -> DataFrame:
    """doc_id and features of the chosen documents (None: all)."""
    held = docs.sparkSession.sparkContext.broadcast((chosen, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, known = held.value
        reader = Reader(known)
        for part, texts in text_slices(batches):
            ids = part.column("doc_id").to_pylist()
            at = [i for i, d in enumerate(ids) if only is None or d in only]
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), pa.array([reader(texts[i]) for i in at], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def _lexicon(docs: DataFrame, marks: dict[int, int]) -> dict[str, float]:
    """Weights (log odds) of the units that toxic documents hold far more often; counted over all chosen documents."""
    toxic = sum(marks.values())
    others = len(marks) - toxic
    if not toxic or not others:
        return {}
    held = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for part, texts in text_slices(batches):
            for d, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                if d in held.value:
                    for u in {u for w in {plain(x) for x in WORDS(text)} for u in units(w) if 1 < len(u) <= 24}:
                        counts[u][held.value[d]] += 1
            if len(counts) > 100_000:
                yield _counted(counts)
                counts.clear()
        if counts:
            yield _counted(counts)

    least = max(3, round(0.004 * toxic))
    t, f = F.sum("t"), F.sum("f")
    weight = F.log(((t + 0.5) / toxic) / ((f + 0.5) / others))
    found = docs.mapInArrow(run, "unit string, t long, f long").groupBy("unit").agg(t.alias("t"), weight.alias("w")).where((F.col("t") >= least) & (F.col("w") >= 1.8))
    return {r["unit"]: r["w"] for r in found.orderBy(F.desc(F.col("w") * F.sqrt("t")), "unit").limit(LEXICON_UNITS).collect()}


def _counted(counts: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["unit", "t", "f"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: doc_id, toxic of the rows that may be learned from."""
    ship(docs.sparkSession)
    offered = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = offered.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(sample).collect()
    folds: list[dict[int, int]] = [{}, {}, {}]
    for k, r in enumerate(rows):
        folds[(0, 1, 0, 1, 2)[k % 5]][r["doc_id"]] = int(r["toxic"] > 0)
    lexicon = _lexicon(docs, folds[0])
    fitted = _features(docs, folds[1] | folds[2], lexicon).collect()
    x, y = {}, {}
    for k in (1, 2):
        own = [(r["x"], folds[k][r["doc_id"]]) for r in fitted if r["doc_id"] in folds[k]]
        x[k], y[k] = np.array([v for v, _ in own], float).reshape(-1, FEATURES), np.array([v for _, v in own], float)
    released(docs.sparkSession)
    if not 0 < y[1].sum() < len(y[1]):
        return Model(lexicon, None, None)
    trees = Trees().fit(x[1], y[1])
    return Model(lexicon, trees, isotonic(trees.raw(x[2]), y[2]) if 5 <= y[2].sum() < len(y[2]) else None)


def score(docs: DataFrame, model: Model, keep_columns: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row; with keep_columns the input's rows that are not predicted toxic, as they are."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value.lexicon)
        for part, texts in text_slices(batches):
            scores = held.value.scores(np.array([reader(x or "") for x in texts], float).reshape(-1, FEATURES))
            if keep_columns:
                yield part.filter(pa.array(scores < threshold))
            else:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    source = docs if keep_columns else documents(docs)
    return source.mapInArrow(run, docs.schema if keep_columns else "doc_id long, score double, predicted int")


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, mod 4, is 2 (a null id: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))
