"""The signal model's tables as views over the provided tables, in Spark and in SQL.

events are signals (a channel a user, values in hundredths as integer codes),
part is a bank of waveforms, lineitem places them, and the texts and vectors
stand for what their names say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, frame, code, value"""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("channel"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.round(F.col("value") * 100).cast("long").alias("code"), "value"
    )


SIGNAL = """signal AS (
  SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
         CAST(round(value * 100) AS BIGINT) AS code, value FROM events)"""


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, length, codes array<long>: a short waveform of integer codes for every part."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), (F.col("p_size") % 8 + 1).cast("int").alias("length"))
    return part.withColumn("codes", F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (F.col("sample_id") * 31 + i.cast("long") * 17) % 201 - 100))


WAVEFORMS = """bank AS (
  SELECT p_partkey AS sample_id, p_size % 8 + 1 AS length,
         list_transform(range(0, p_size % 8 + 1), lambda i: (p_partkey * 31 + i * 17) % 201 - 100) AS codes FROM part)"""


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord keys, sample_id, channel, start (may be negative), gain_num"""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("sample_id"), (F.col("l_linenumber") % 2).cast("int").alias("channel"),
        ((F.col("l_orderkey") * 13 + F.col("l_linenumber")) % 4000 - 4).alias("start"), F.round(F.col("l_discount") * 65536).cast("long").alias("gain_num"),
    )


PLACEMENTS = """placement AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS sample_id, CAST(l_linenumber % 2 AS INTEGER) AS channel,
         (l_orderkey * 13 + l_linenumber) % 4000 - 4 AS start, CAST(round(l_discount * 65536) AS BIGINT) AS gain_num FROM lineitem)"""

TIMELINE = 4000


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, start, length, note, velocity"""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 4).cast("int").alias("channel"), ((F.col("l_orderkey") * 97 + F.col("l_linenumber") * 11) % 100000).alias("start"),
        F.col("l_quantity").cast("long").alias("length"), (21 + F.col("l_partkey") % 88).cast("int").alias("note"), (1 + F.col("l_orderkey") % 127).cast("int").alias("velocity"),
    )


NOTES = """note AS (
  SELECT CAST(l_suppkey % 4 AS INTEGER) AS channel, (l_orderkey * 97 + l_linenumber * 11) % 100000 AS start,
         CAST(l_quantity AS BIGINT) AS length, CAST(21 + l_partkey % 88 AS INTEGER) AS note, CAST(1 + l_orderkey % 127 AS INTEGER) AS velocity FROM lineitem)"""
