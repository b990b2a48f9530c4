"""Exact top-k inner products with a bit-sliced index.

Vectors are quantised to integers.  The index holds, for blocks of BLOCK
vectors, every attribute's coarse value (the integer shifted right) as bit
slices: one bitmap a bit, one machine word for 64 vectors.  A query's
coarse weights are small signed digits; the coarse scores of a whole block are
the sum of shifted slices, added by ripple carry on bitmaps.  From the most
significant slice of the sum downward, a bitmap of rows that lead is refined
until about k are left.  Rows that could still reach the top k under the error
bound of the coarse sum are the boundary; they, and only they, get exact
scores.  Ties go to smaller ids.

Queries come in blocks as well: every block of queries meets every block of
vectors, once each, and a pair of blocks yields at most k rows a query.

Defined results: vectors that are null, empty of numbers, or hold null or
non-finite components take no part, as query or candidate; rows with a null
vec_id neither; vectors of unlike length are compared over the components both
have (missing ones count 0); of repeated vec_ids every row is a candidate, and
a query's own row is each with its id, and of a query id on several rows every
row asks; vectors so large that a score may exceed 64 bits raise OverflowError;
an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, ship, written

SCALE = 1024
K = 10
EVERY = 100
BLOCK = 8192
QUERIES = 512
#: Bits of an attribute below the index, and of a query's weights below its digits.
SHIFT, WEIGHT_SHIFT = 6, 5
WORD = np.uint64


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, q array<long>: floor(scale * component), of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
        .where(F.coalesce(finite, F.lit(False)))
        .select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("q"))
    )


def matrix(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def slices_of(values: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (attribute, bit, word) of non-negative integers (row, attribute)."""
    n = -(-len(values) // 64) * 64
    out = np.zeros((values.shape[1], bits, n // 64), WORD)
    for b in range(bits):
        plane = np.zeros((values.shape[1], n), np.uint8)
        plane[:, : len(values)] = ((values >> b) & 1).T
        out[:, b] = np.packbits(plane, axis=1, bitorder="little").view(WORD)
    return out


class Index:
    """The bit-sliced index of one block of vectors."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, shift: int = SHIFT):
        self.ids, self.values, self.shift = ids, values, shift
        coarse = values >> shift
        self.low = coarse.min(0) if len(values) else np.zeros(values.shape[1], np.int64)
        top = int((coarse - self.low).max()) if values.size else 0
        self.bits = max(1, top.bit_length())
        self.slices = slices_of(coarse - self.low, self.bits)
        self.words = self.slices.shape[2]
        self.valid = np.packbits(np.arange(self.words * 64) < len(values), bitorder="little").view(WORD)
        # |v - (coarse + half) * 2^shift| <= half a step: its norm over the attributes bounds the error of a sum
        self.rest = values - (coarse << shift) - ((1 << shift) >> 1)
        self.rest_norm = float(np.sqrt((self.rest.astype(float) ** 2).sum(1).max())) if len(values) else 0.0
        self.norm = float(np.sqrt((values.astype(float) ** 2).sum(1).max())) if len(values) else 0.0

    def coarse_sums(self, weights: np.ndarray) -> np.ndarray:
        """Bit slices of sum(weight * (coarse - low)), offset so that it is not negative.

        Negative weights count the complement: w * c = |w| * (top - c) - |w| * top.
        """
        top = (1 << self.bits) - 1
        width = int(np.abs(weights).sum() * top).bit_length() + 1
        total = np.zeros((width, self.words), WORD)
        for slices, weight in zip(self.slices, weights.tolist(), strict=True):
            own = slices if weight > 0 else ~slices
            weight = abs(weight)
            for place in range(weight.bit_length()):
                if weight >> place & 1:
                    carry = None
                    for b in range(width - place):
                        into = total[place + b]
                        if b < self.bits:
                            add = own[b]
                            half = into ^ add
                            out = into & add
                            if carry is not None:
                                out |= half & carry
                                half ^= carry
                            total[place + b] = half
                            carry = out
                        else:
                            out = into & carry
                            into ^= carry
                            carry = out
                            if b > self.bits + 1 and not carry.any():
                                break
        return total

    def offset(self, weights: np.ndarray) -> int:
        top = (1 << self.bits) - 1
        return int((weights * self.low).sum()) - int(np.abs(weights[weights < 0]).sum()) * top

    def leaders(self, total: np.ndarray, k: int) -> int:
        """The largest coarse sum that at least k rows reach: slices from the most significant down."""
        held, threshold, need = self.valid.copy(), 0, min(k, len(self.ids))
        for b in range(len(total) - 1, -1, -1):
            ones = held & total[b]
            count = int(np.bitwise_count(ones).sum())
            if count >= need:
                held, threshold = ones, threshold | 1 << b
            else:
                need -= count
                held = held & ~total[b]
        return threshold

    def at_least(self, total: np.ndarray, threshold: int) -> np.ndarray:
        """Row numbers whose coarse sum is at least the threshold."""
        if threshold <= 0:
            return np.arange(len(self.ids))
        if threshold >> len(total):
            return np.zeros(0, np.int64)
        above, equal = np.zeros(self.words, WORD), self.valid.copy()
        for b in range(len(total) - 1, -1, -1):
            if threshold >> b & 1:
                equal &= total[b]
            else:
                above |= equal & total[b]
                equal &= ~total[b]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little")[: len(self.ids)])

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows other than the query's own."""
        if float(np.sqrt((query.astype(float) ** 2).sum())) * self.norm >= 2.0**62:
            raise OverflowError(f"scores of vec_id {query_id} may exceed 64 bits")
        weights = np.round(query / (1 << WEIGHT_SHIFT)).astype(np.int64)
        total = self.coarse_sums(weights)
        threshold = self.leaders(total, k + int((self.ids == query_id).sum()))
        # a score is 2^(shift + weight shift) * coarse sum + terms that the norms bound
        unit = 1 << (self.shift + WEIGHT_SHIFT)
        lost = query - (weights << WEIGHT_SHIFT)
        error = float(np.sqrt((lost.astype(float) ** 2).sum())) * self.norm + float(np.sqrt(((weights << WEIGHT_SHIFT).astype(float) ** 2).sum())) * self.rest_norm
        rows = self.at_least(total, threshold - int(np.ceil(2 * error / unit)) - 1)
        rows = rows[self.ids[rows] != query_id]
        scores = self.values[rows] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every vector whose id is divisible by every."""
    spark = vectors.sparkSession
    ship(spark)
    base = written(quantised(vectors, scale), f"{scratch(spark)}/quantised")
    n_rows, n_queries = base.count(), base.where(F.pmod("vec_id", F.lit(every)) == 0).count()
    n_blocks, n_groups = max(1, -(-n_rows // block)), max(1, -(-n_queries // queries))

    def dealt(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(n)), F.lit(n)).cast("int"))

    rows = dealt(base, n_blocks).withColumnRenamed("part", "block").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).withColumn("kind", F.lit(1))
    asked = dealt(base.where(F.pmod("vec_id", F.lit(every)) == 0), n_groups).withColumnRenamed("part", "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("kind", F.lit(0))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, q, kind = table.column("vec_id").to_numpy(), table.column("q").to_pylist(), table.column("kind").to_numpy()
        values = matrix(q, max(map(len, q)))
        own = kind == 1
        out = []
        if own.any():
            index = Index(ids[own], values[own])
            for i in np.flatnonzero(~own):
                found, scores = index.top(int(ids[i]), values[i], k)
                out.append((np.full(len(found), ids[i]), found, scores))
        columns = [np.concatenate([x[j] for x in out]) if out else np.zeros(0, np.int64) for j in range(3)]
        return pa.table({"query_id": columns[0].astype(np.int64), "vec_id": columns[1].astype(np.int64), "score": columns[2].astype(np.int64)})

    names = ["block", "group", "kind", "vec_id", "q"]
    best = rows.select(*names).unionByName(asked.select(*names)).groupBy("block", "group").applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
