"""Joins, groupings and numbering of the model, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chords(notes: DataFrame) -> DataFrame:
    """channel, start, voices, chord, duration [A21]"""
    own = notes.groupBy("channel", "start").agg(F.min("length").alias("shortest"), F.count(F.lit(1)).alias("voices"), F.array_join(F.array_sort(F.collect_set("note")).cast("array<string>"), " ").alias("chord"))
    gap = F.lead("start").over(Window.partitionBy("channel").orderBy("start")) - F.col("start")
    return own.select("channel", "start", "voices", "chord", F.greatest(F.lit(1).cast("long"), F.least("shortest", F.coalesce(gap, "shortest"))).alias("duration"))


def length_candidates(events: DataFrame, bank: DataFrame, event_keys: list[str], on: str, length: str, size: str, limit: int) -> DataFrame:
    """Bank entries within an octave of the event's length, the nearest first, larger sample ids first among equals [F2 J5 O4].

    A distance depends on the two lengths only, so of entries of one size at
    most `limit` can be chosen, and each distinct length is matched once;
    events take the list of their length, repeated rows sharing their places.
    """
    distance = F.abs(F.log2(F.col(size) / F.col(length)))
    best = bank.withColumn("_of_size", F.row_number().over(Window.partitionBy(on, size).orderBy(F.desc("sample_id")))).where(F.col("_of_size") <= limit)
    lengths = events.select(on, length).distinct().join(best.select(on, size, "sample_id"), on).where(distance <= 1)
    order = Window.partitionBy(on, length).orderBy(distance, F.desc("sample_id"))
    listed = lengths.withColumn("_rank", F.row_number().over(order).cast("long")).where(F.col("_rank") <= limit)
    repeated = events.groupBy(*event_keys).agg(F.count(F.lit(1)).alias("_n"))
    first, last = (F.col("_rank") - 1) * F.col("_n") + 1, F.least(F.col("_rank") * F.col("_n"), F.lit(limit).cast("long"))
    return repeated.join(listed, [on, length]).where(first <= last).withColumn("place", F.explode(F.sequence(first, last))).drop("_n", "_rank")


def exact_repeats(df: DataFrame, key: str, waveform: str, group: list[str]) -> DataFrame:
    """key, first_id, n: the first row of an equal waveform in its group, and how many are equal [J4].

    Rows meet by a 64-bit hash, which is cheap to move and sort; the values
    confirm it.
    """
    first = df.groupBy(*group, waveform).agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("n"))
    a, b = df.withColumn("_h", F.xxhash64(waveform)), first.withColumn("_h", F.xxhash64(waveform))
    condition = (a["_h"] == b["_h"]) & (a[waveform] == b[waveform])
    for g in group:
        condition = condition & a[g].eqNullSafe(b[g])
    return a.join(b, condition).select(a[key], "first_id", "n")


def nearest_voice(pitches: DataFrame, voices: DataFrame) -> DataFrame:
    """note, voice, speed: each pitch with the nearest voice, the lower one among equals [J7].

    Pitches and voices are counted once each; the voices become one sorted array
    (of distinct pitches), and a pitch looks among them.
    """
    known = voices.where("voice is not null").agg(F.array_sort(F.collect_set("voice")).alias("_voices")).where(F.size("_voices") > 0)
    nearest = F.reduce("_voices", F.get("_voices", F.lit(0)), lambda best, v: F.when(F.abs(v - F.col("note")) < F.abs(best - F.col("note")), v).otherwise(best))
    found = pitches.select("note").where("note is not null").distinct().join(known, F.lit(True)).select("note", nearest.alias("voice"))
    return found.select("note", "voice", F.round(F.pow(F.lit(2.0), (F.col("note") - F.col("voice")) / 12), 9).alias("speed"))


def by_measure(notes: DataFrame, bar: int) -> DataFrame:
    """channel, measure, events, covered [J8]"""
    tall = notes.where("length > 0").withColumn("measure", F.explode(F.sequence(F.expr(f"start div {bar}"), F.expr(f"(start + length - 1) div {bar}"))))
    end = F.least(F.col("start") + F.col("length"), (F.col("measure") + 1) * bar)
    return tall.groupBy("channel", "measure").agg(F.count(F.lit(1)).alias("events"), F.sum(end - F.greatest("start", F.col("measure") * bar)).alias("covered"))


def pair_turns(df: DataFrame, key: str, order: str, kind: str, opening: str, closing: str) -> DataFrame:
    """key, on_turn, off_turn: an opening and the first closing before the next opening [J10]."""
    upward = Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    following = F.min(F.when(F.col(kind) == opening, F.col(order))).over(upward)
    end = F.min(F.when(F.col(kind) == closing, F.col(order))).over(upward)
    rows = df.where(F.col(key).isNotNull()).select(key, order, kind, following.alias("_next"), end.alias("_end")).where(F.col(kind) == opening)
    return rows.groupBy(key, F.col(order).alias("on_turn")).agg(F.min(F.when(F.col("_next").isNull() | (F.col("_end") < F.col("_next")), F.col("_end"))).alias("off_turn"))


def pair_lifo(events: DataFrame, keys: list[str], order: list[str], on: str) -> DataFrame:
    """keys, on_*, off_* (the order columns): each end with the latest start of its keys that is still open [J10].

    on: a boolean column, true for starts.  The number of starts left open is a
    running sum that ends without a start do not lower below 0; a start that
    makes it n meets the first end behind it that lowers it to n - 1, so the
    stack is two windows and an equal level.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    run = events.withColumn("_run", F.sum(F.when(F.col(on), 1).otherwise(-1)).over(so_far))
    open_ = run.withColumn("_low", F.least(F.lit(0), F.min("_run").over(so_far))).withColumn("_depth", F.col("_run") - F.col("_low"))
    open_ = open_.withColumn("_before_low", F.coalesce(F.lag("_low").over(w), F.lit(0)))
    # ends that meet no start lower the floor; the others close the level above
    kept = open_.where(F.col(on) | (F.col("_low") == F.col("_before_low"))).withColumn("_level", F.when(F.col(on), F.col("_depth")).otherwise(F.col("_depth") + 1))
    level = Window.partitionBy(*keys, "_level").orderBy(*order)
    place = F.struct(*order)
    met = kept.withColumn("_on", F.lag(place).over(level)).withColumn("_opened", F.lag(on).over(level))
    done = met.where(~F.col(on) & F.col("_opened"))
    return done.select(*keys, *(F.col(f"_on.{c}").alias(f"on_{c}") for c in order), *(F.col(c).alias(f"off_{c}") for c in order))


def tie(notes: DataFrame) -> DataFrame:
    """channel, note, start, length, tied [J16]"""
    w = Window.partitionBy("channel", "note").orderBy("start", "length", "velocity")
    fresh = F.when(F.lag(F.col("start") + F.col("length")).over(w) == F.col("start"), 0).otherwise(1)
    chain = notes.withColumn("_new", fresh).withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return chain.groupBy("channel", "note", "_chain").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("tied")).drop("_chain")


def dense_number(df: DataFrame, order: list[str], name: str = "ord", first: int = 1, buckets: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """Numbers rows in a global order of their first column (in each group of `by` anew), without one task that sees them all.

    Rows are dealt to ranges by quantiles of the first ordering column; numbers
    within a range come from a window by range, the ranges' offsets from their
    counts, a table of at most `buckets` rows (a group).
    """
    cuts = sorted(set(df.where(F.col(order[0]).isNotNull()).approxQuantile(order[0], [k / buckets for k in range(1, buckets)], 0.005)))
    key = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order[0]))) if cuts else F.lit(0)
    dealt = df.withColumn("_part", F.when(F.col(order[0]).isNull(), -1).otherwise(key))
    groups = [F.col(c).alias(f"_by_{c}") for c in by]
    counts = dealt.groupBy(*groups, F.col("_part").alias("_at")).count()
    offsets = counts.withColumn("_offset", F.sum("count").over(Window.partitionBy(*(f"_by_{c}" for c in by)).orderBy("_at")) - F.col("count")).drop("count")
    numbered = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    same = F.col("_part") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return numbered.join(F.broadcast(offsets), same).withColumn(name, (F.col("_own") + F.col("_offset") + (first - 1)).cast("long")).drop("_part", "_own", "_offset", "_at", *(f"_by_{c}" for c in by))
