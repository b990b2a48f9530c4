"""The doublet store as tables: links (idx, source, target) with equal pairs stored once, and symbols.

Indices follow first appearance.  Ids are dense; they are made from per-range
counts (`relational.dense_number`), never by one task that sees all rows.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import dense_number

NULL = 0
LINKS = "idx long, source long, target long"
SYMBOLS = "name string, idx long"


def intern(names: DataFrame, name: str, order: str, first: int = 1) -> DataFrame:
    """name, idx: each name once, numbered by first appearance [G3]."""
    seen = names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(order).alias("_first"))
    return dense_number(seen, ["_first", "name"], "idx", first).select("name", "idx")


def create(pairs: DataFrame, order: str, first: int = 1) -> DataFrame:
    """idx, source, target: each pair once, numbered by first appearance [G1]."""
    seen = pairs.groupBy("source", "target").agg(F.min(order).alias("_first"))
    return dense_number(seen, ["_first", "source", "target"], "idx", first).select("idx", "source", "target")


def points(symbols: DataFrame) -> DataFrame:
    """A self-link for each symbol [G2]."""
    return symbols.select("idx", F.col("idx").alias("source"), F.col("idx").alias("target"))


def find(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """source, target, idx (null if there is no such link) [G4 J15]."""
    return pairs.join(links, ["source", "target"], "left")


def by_source(links: DataFrame, source) -> DataFrame:
    """Without the point itself."""
    return links.where((F.col("source") == source) & ~((F.col("idx") == source) & (F.col("target") == source)))


def by_target(links: DataFrame, target) -> DataFrame:
    """[F10]"""
    return links.where((F.col("target") == target) & ~((F.col("idx") == target) & (F.col("source") == target)))


def shared_prefixes(items: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """prefix, length, uses: distinct prefixes of each key's sequence; a left fold of pairs makes one link for each of two items or more [G5]."""
    seq = items.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("seq"))
    tall = seq.select(key, F.explode(F.sequence(F.lit(1), F.size("seq"))).alias("length"), "seq")
    return tall.groupBy(F.slice("seq", F.lit(1), F.col("length")).alias("prefix"), "length").agg(F.count(F.lit(1)).alias("uses"))


def shared_suffixes(items: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """suffix, length, uses: a right fold of cons cells shares suffixes [G6]."""
    seq = items.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("seq"))
    tall = seq.select(key, F.explode(F.sequence(F.lit(1), F.size("seq"))).alias("length"), "seq")
    return tall.groupBy(F.slice("seq", F.size("seq") - F.col("length") + 1, F.col("length")).alias("suffix"), "length").agg(F.count(F.lit(1)).alias("uses"))


def _cut(df: DataFrame) -> DataFrame:
    """The rows as written under ``spark.checkpoint.dir`` (a local folder only where none is), without their lineage."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sonorum-shared-"))
    return df.checkpoint()


def _gathered(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    return _cut(reduce(DataFrame.unionByName, parts).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def sequences(spark: SparkSession, items: DataFrame, key: str, order: str, value: str, first: int, levels: int = 64) -> tuple[DataFrame, DataFrame]:
    """The links of a left fold and each key's last link [G5].

    One join a level, up to the longest sequence.  Each level is written, so
    plans do not grow; what `levels` levels made is gathered into one table.
    """
    seq = items.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("seq"))
    state = _cut(seq.select(key, "seq", F.get("seq", F.lit(0)).alias("idx")))
    longest = state.agg(F.max(F.size("seq"))).first()[0] or 0
    made, ends, following = [], [state.where(F.size("seq") <= 1).select(key, "idx")], first
    for k in range(1, longest):
        going = state.where(F.size("seq") > k).select(key, "seq", F.col("idx").alias("source"), F.get("seq", F.lit(k)).alias("target"))
        own = _cut(create(going, key, following))
        following += own.count()
        state = _cut(going.join(own, ["source", "target"]).select(key, "seq", "idx"))
        made.append(own)
        ends.append(state.where(F.size("seq") == k + 1).select(key, "idx"))
        if len(made) >= levels:
            made, ends = [_gathered(spark, made)], [_gathered(spark, ends)]
    return _gathered(spark, made) if made else spark.createDataFrame([], LINKS), _gathered(spark, ends)
