"""Render, difference and verification over tables: exact integer codes in, exact sums out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rendered(placements: DataFrame, bank: DataFrame, frames: int) -> DataFrame:
    """channel, frame, num: sums of gain * code (over 65536) on the timeline [0, frames).

    The bank is joined by sample id (Spark picks the side to send by its size),
    waveforms unfold to frames, and frames are summed before they move.
    Unknown samples and silent placements fall out; what lies off the timeline is
    clipped.
    """
    placed = placements.where("gain_num <> 0").join(bank.select("sample_id", "codes"), "sample_id")
    tall = placed.select("channel", "start", "gain_num", F.posexplode("codes").alias("pos", "code"))
    at = F.col("start") + F.col("pos")
    return tall.where((at >= 0) & (at < frames)).groupBy("channel", at.alias("frame")).agg(F.sum(F.col("gain_num") * F.col("code")).alias("num"))


def residual(original: DataFrame, render: DataFrame) -> DataFrame:
    """channel, frame, code, rendered, residual: original minus the render, rounded to codes (halves away from zero)."""
    own = F.round(F.coalesce("num", F.lit(0)).cast("double") / 65536.0).cast("long")
    joined = original.join(render, ["channel", "frame"], "left")
    return joined.select("channel", "frame", "code", own.alias("rendered"), (F.col("code") - own).alias("residual"))


def joined(original: DataFrame, render: DataFrame, rest: DataFrame) -> DataFrame:
    """channel, frame, code, rendered, residual: a recording beside a render and a residual that are tables of their own; a missing frame counts 0."""
    own = F.round(F.coalesce("num", F.lit(0)).cast("double") / 65536.0).cast("long")
    both = original.join(render, ["channel", "frame"], "left").join(rest, ["channel", "frame"], "left")
    return both.select("channel", "frame", "code", own.alias("rendered"), F.coalesce("residual", F.lit(0)).cast("long").alias("residual"))


def report(original: DataFrame, render: DataFrame, rest: DataFrame) -> DataFrame:
    """Of each channel: frames, peaks, energies, the residual's share of all energy, and how far rendered + residual is off the original."""
    made, left = F.sum(F.col("rendered") * F.col("rendered")), F.sum(F.col("residual") * F.col("residual"))
    share = F.when(made + left == 0, 0.0).otherwise(F.round(left.cast("double") / (made + left).cast("double"), 9))
    return joined(original, render, rest).groupBy("channel").agg(
        F.count(F.lit(1)).alias("frames"), F.max(F.abs("code")).alias("peak"), F.max(F.abs("residual")).alias("residual_peak"),
        made.alias("rendered_energy"), left.alias("residual_energy"), share.alias("residual_share"),
        F.max(F.abs(F.col("code") - F.col("rendered") - F.col("residual"))).alias("deviation"),
    )


def coverage(placements: DataFrame, bank: DataFrame) -> DataFrame:
    """stored, covered, reuse: frames of the bank, frames that placements cover, their ratio (0 for an empty bank)."""
    stored = bank.agg(F.coalesce(F.sum(F.size("codes").cast("long")), F.lit(0)).alias("stored"))
    covered = placements.join(bank.select("sample_id", F.size("codes").cast("long").alias("n")), "sample_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("covered"))
    return stored.join(covered, F.lit(True)).withColumn("reuse", F.when(F.col("stored") == 0, 0.0).otherwise(F.col("covered") / F.col("stored")))
