"""Window and sequence operators over tall signals (channel, frame, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(key="channel", order="frame"):
    return Window.partitionBy(key).orderBy(order)


def moving_mean(value: str, span: int, key="channel", order="frame") -> Column:
    """Mean over ± half a span, cut at the edges [W2]."""
    half = max(span, 1) // 2
    return F.avg(value).over(over(key, order).rowsBetween(-half, half))


def subtract_baseline(value: str, span: int, **keys) -> Column:
    """[W2]"""
    return F.greatest(F.lit(0.0), F.col(value) - moving_mean(value, span, **keys))


def running_energy(value: str, key="channel", order="frame") -> Column:
    """[W5]"""
    return F.sum(F.col(value) * F.col(value)).over(over(key, order).rowsBetween(Window.unboundedPreceding, 0))


def is_peak(value: str, threshold: Column, key="channel", order="frame") -> Column:
    """At least the threshold and both neighbours; first and last frames are none [F5]."""
    w = over(key, order)
    return (F.col(value) >= threshold) & (F.col(value) >= F.lag(value).over(w)) & (F.col(value) >= F.lead(value).over(w))


def moving_median(value: str, span: int, key="channel", order="frame") -> Column:
    """Median over ± half a span, cut at the edges; the middle of two for even counts [W11]."""
    half = max(span, 1) // 2
    held = F.sort_array(F.collect_list(value).over(over(key, order).rowsBetween(-half, half)))
    n = F.size(held)
    return (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2


def triangular(value: str, half: int, key="channel", order="frame") -> Column:
    """Weights 1..half+1..1 with a fixed divisor, zero outside [W12]."""
    w = over(key, order)
    total = (half + 1) ** 2
    terms = [F.coalesce((F.lag(value, -k) if k < 0 else F.lead(value, k)).over(w) if k else F.col(value), F.lit(0)) * (half + 1 - abs(k)) for k in range(-half, half + 1)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out / total


def islands(df: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """Runs of consecutive frames of each key: keys, start_frame, frames [W10]."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(frame))
    return df.select(*keys, frame, (F.col(frame) - rank).alias("_run")).groupBy(*keys, "_run").agg(F.min(frame).alias("start_frame"), F.count(F.lit(1)).alias("frames")).drop("_run")


def segments(cuts: DataFrame, lengths: DataFrame, key: str = "channel") -> DataFrame:
    """key, start, length: 0, all cuts and the length, in order and once, as pairs [W7, W9]."""
    ends = lengths.select(key, F.explode(F.array(F.lit(0).cast("long"), F.col("length").cast("long"))).alias("cut"))
    joined = cuts.select(key, F.col("cut").cast("long").alias("cut")).unionByName(ends).distinct()
    following = F.lead("cut").over(Window.partitionBy(key).orderBy("cut"))
    return joined.select(key, F.col("cut").alias("start"), (following - F.col("cut")).alias("length")).where("length is not null")


def autocorrelation(df: DataFrame, lags: int, value: str = "code", key: str = "channel") -> DataFrame:
    """key, lag, overlap, total: sums of products of frames a lag apart, for lags 1..lags [W13].

    Every frame meets only the lags behind it: the equi-join is on (key, frame).
    """
    left = df.select(key, "frame", F.col(value).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag")).withColumn("frame", F.col("frame") + F.col("lag"))
    right = df.select(key, "frame", F.col(value).alias("y"))
    return left.join(right, [key, "frame"]).groupBy(key, F.col("lag").cast("long").alias("lag")).agg(F.count(F.lit(1)).alias("overlap"), F.sum(F.col("x") * F.col("y")).alias("total"))


def pick_peaks(peaks: Column, gap: int) -> Column:
    """Array of (frame, code) in order, where a peak closer than gap to the last one kept takes its place if it is stronger, and goes if not [W4]."""
    empty = F.slice(peaks, 1, 0)

    def step(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        close = (F.size(acc) > 0) & (x["frame"] < last["frame"] + gap)
        without = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(close & (x["code"] > last["code"]), F.concat(without, F.array(x))).when(close, acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(peaks, empty, step)


def shape(cuts: Column, length: Column, least: int, most: int) -> Column:
    """Where events begin: 0, the ascending cuts at least `least` behind the last one kept, and long spans in even pieces whose last one is not short [W8]."""
    start = F.array(F.lit(0).cast("long"))
    kept = F.aggregate(cuts, start, lambda acc, x: F.when((x > 0) & (x < length) & (x - F.element_at(acc, -1) >= least), F.concat(acc, F.array(x))).otherwise(acc))
    ends = F.concat(F.slice(kept, F.lit(2), F.size(kept)), F.array(length))

    def pieces(a, b):
        span = b - a
        n = F.ceil(span / F.lit(float(most))).cast("long")
        each = F.ceil(span / n).cast("long")
        more = F.filter(F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: a + k * each), lambda p: (p < b) & (b - p >= least))
        return F.when(span > most, F.concat(F.array(a), more)).otherwise(F.array(a))

    return F.when(length > 0, F.flatten(F.zip_with(kept, ends, pieces))).otherwise(F.slice(start, 1, 0))


def fold_gap(cuts: Column, least: int) -> Column:
    """Ascending cuts, without those closer than least to the last one kept [W8]."""
    return F.aggregate(cuts, F.array().cast("array<long>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) >= least), F.concat(acc, F.array(x))).otherwise(acc))


def split_long(start: Column, length: Column, most: int) -> Column:
    """Array of (start, length) pieces of at most `most` frames, as even as integer division allows [W8]."""
    n = F.ceil(length / F.lit(float(most))).cast("int")
    each = F.ceil(length / n).cast("long")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((start + i * each).alias("start"), F.least(each, length - i * each).alias("length")))


def delta_encode(tick: str, keys: list[str], order: list[str]) -> Column:
    """[W17]"""
    return F.col(tick) - F.coalesce(F.lag(tick).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0))


def delta_decode(delta: str, keys: list[str], order: list[str]) -> Column:
    """[W18]"""
    return F.sum(delta).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def key_zones(pitches: DataFrame, group: str = "instrument") -> DataFrame:
    """group, note, low, high: zones that meet half-way between neighbouring pitches [W19]."""
    w = Window.partitionBy(group).orderBy("note")
    one = pitches.select(group, "note").distinct()
    before, after = F.lag("note").over(w), F.lead("note").over(w)
    low = F.when(before.isNull(), 0).otherwise(before + F.ceil((F.col("note") - before) / 2))
    high = F.when(after.isNull(), 127).otherwise(F.col("note") + F.ceil((after - F.col("note")) / 2) - 1)
    return one.select(group, "note", low.cast("int").alias("low"), high.cast("int").alias("high"))


def cumulative_mean_normalised(df: DataFrame, key: str = "channel", lag: str = "lag", d: str = "d") -> DataFrame:
    """d * lag / running sum of d; 1 at lag 0 [W15]."""
    running = F.sum(d).over(Window.partitionBy(key).orderBy(lag).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("cmnd", F.when(F.col(lag) == 0, 1.0).otherwise(F.col(d) * F.col(lag) / F.nullif(running, F.lit(0))))
