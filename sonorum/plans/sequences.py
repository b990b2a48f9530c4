"""Window and sequence queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import windows as W
from .base import NOTES, SIGNAL, notes, query, signal, table


def _spectra(spark, sf):
    """frame, bins of integer magnitudes: vectors stand for spectra, in blocks of 100 frames."""
    mags = F.transform("embedding", lambda x: F.abs(F.round(x.cast("double") * 32768)).cast("long"))
    return table(spark, sf, "embeddings").select(F.expr("vec_id div 100").alias("channel"), F.col("vec_id").alias("frame"), mags.alias("mags"))


SPECTRA = "spectra AS (SELECT vec_id // 100 AS channel, vec_id AS frame, list_transform(embedding, lambda x: CAST(abs(round(CAST(x AS DOUBLE) * 32768)) AS BIGINT)) AS mags FROM embeddings)"


@query(f"""WITH {SPECTRA}, p AS (SELECT *, lag(mags) OVER (PARTITION BY channel ORDER BY frame) AS prior FROM spectra)
SELECT channel, frame, CASE WHEN prior IS NULL THEN 0 ELSE CAST(list_sum(list_transform(list_zip(mags, prior), lambda t: greatest(0, t[1] - t[2]))) AS BIGINT) END AS flux FROM p""")
def spectral_flux(spark, sf):
    """[W1]"""
    prior = F.lag("mags").over(W.over())
    rise = F.aggregate(F.zip_with("mags", prior, lambda a, b: F.greatest(F.lit(0).cast("long"), a - b)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return _spectra(spark, sf).select("channel", "frame", F.when(prior.isNull(), F.lit(0).cast("long")).otherwise(rise).alias("flux"))


@query(f"""WITH {SPECTRA} SELECT channel, max(e) AS loudest, CAST(sum(e) AS BIGINT) AS total, count(*) AS frames
FROM (SELECT channel, CAST(list_sum(mags) AS BIGINT) AS e FROM spectra) GROUP BY channel""")
def frame_energy(spark, sf):
    """[A14]"""
    e = F.aggregate("mags", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return _spectra(spark, sf).groupBy("channel").agg(F.max(e).alias("loudest"), F.sum(e).alias("total"), F.count(F.lit(1)).alias("frames"))


@query(f"WITH {SIGNAL} SELECT channel, frame, greatest(0.0, code - CAST(sum(code) OVER w AS DOUBLE) / count(*) OVER w) AS above FROM signal WINDOW w AS (PARTITION BY channel ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)")
def baseline_removed(spark, sf):
    """[W2]"""
    w = W.over().rowsBetween(-7, 7)
    return signal(spark, sf).select("channel", "frame", F.greatest(F.lit(0.0), F.col("code") - F.sum("code").over(w).cast("double") / F.count(F.lit(1)).over(w)).alias("above"))


PEAKS = f"""peaks AS (
  SELECT channel, frame, code FROM (SELECT *, lag(code) OVER w AS before, lead(code) OVER w AS after, max(code) OVER (PARTITION BY channel) AS top,
      CAST(sum(code) OVER (PARTITION BY channel) AS DOUBLE) / count(*) OVER (PARTITION BY channel) AS mean FROM signal WINDOW w AS (PARTITION BY channel ORDER BY frame))
  WHERE code >= greatest(mean * 1.5, top * 0.02) AND code >= before AND code >= after)"""


def _peaks(spark, sf):
    whole = Window.partitionBy("channel")
    s = signal(spark, sf).withColumn("threshold", F.greatest(F.sum("code").over(whole).cast("double") / F.count(F.lit(1)).over(whole) * 1.5, F.max("code").over(whole) * 0.02))
    return s.withColumn("peak", W.is_peak("code", F.col("threshold"))).where("peak").select("channel", "frame", "code")


@query(f"WITH {SIGNAL}, {PEAKS} SELECT * FROM peaks")
def onset_peaks(spark, sf):
    """[W3 F5]"""
    return _peaks(spark, sf)


@query(f"WITH {SIGNAL} SELECT channel, frame, CAST(sum(code * code) OVER (PARTITION BY channel ORDER BY frame) AS BIGINT) AS energy FROM signal")
def energy_so_far(spark, sf):
    """[W5]"""
    return signal(spark, sf).select("channel", "frame", W.running_energy("code").alias("energy"))


@query(f"""WITH {SIGNAL}, e AS (SELECT channel, frame, CAST(sum(code * code) OVER (PARTITION BY channel ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS BIGINT) AS after,
  CAST(sum(code * code) OVER (PARTITION BY channel ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS BIGINT) AS before FROM signal)
SELECT channel, min(frame) AS frame FROM e JOIN (SELECT channel, max(coalesce(after, 0) - coalesce(before, 0)) AS best FROM e GROUP BY channel) USING (channel) WHERE coalesce(after, 0) - coalesce(before, 0) = best GROUP BY channel""")
def sharpest_rise(spark, sf):
    """[W6] The first frame where the energy behind exceeds that before the most."""
    sq = F.col("code") * F.col("code")
    rise = F.coalesce(F.sum(sq).over(W.over().rowsBetween(1, 4)), F.lit(0)) - F.coalesce(F.sum(sq).over(W.over().rowsBetween(-4, -1)), F.lit(0))
    return signal(spark, sf).withColumn("rise", rise).groupBy("channel").agg(F.min_by("frame", F.struct(-F.col("rise"), "frame")).alias("frame"))


SEGMENTS = f"""cuts AS (SELECT channel, frame AS cut FROM peaks UNION SELECT channel, 0 FROM signal UNION SELECT channel, max(frame) + 1 FROM signal GROUP BY channel),
segments AS (SELECT channel, cut AS start, lead(cut) OVER (PARTITION BY channel ORDER BY cut) - cut AS length FROM cuts QUALIFY length IS NOT NULL)"""


def _segments(spark, sf):
    lengths = signal(spark, sf).groupBy("channel").agg((F.max("frame") + 1).alias("length"))
    return W.segments(_peaks(spark, sf).select("channel", F.col("frame").alias("cut")), lengths)


@query(f"WITH {SIGNAL}, {PEAKS}, {SEGMENTS} SELECT * FROM segments")
def event_segments(spark, sf):
    """[W7 W9]"""
    return _segments(spark, sf)


@query(f"""WITH {SIGNAL}, {PEAKS}, {SEGMENTS}, n AS (SELECT *, CAST(ceil(length / 40.0) AS BIGINT) AS k FROM segments), e AS (SELECT *, CAST(ceil(length / k) AS BIGINT) AS each FROM n)
SELECT channel, start + i * each AS start, least(each, length - i * each) AS length FROM (SELECT *, unnest(range(0, k)) AS i FROM e)""")
def events_split(spark, sf):
    """[W8] Long segments in even pieces."""
    s = _segments(spark, sf).select("channel", F.explode(W.split_long(F.col("start"), F.col("length"), 40)).alias("x"))
    return s.select("channel", "x.start", "x.length")


@query(f"""WITH RECURSIVE {SIGNAL}, {PEAKS}, o AS (SELECT channel, frame, code, row_number() OVER (PARTITION BY channel ORDER BY frame) AS i FROM peaks),
k AS (SELECT channel, i, [frame] AS frames, [code] AS codes FROM o WHERE i = 1 UNION ALL
  SELECT k.channel, o.i, CASE WHEN o.frame >= frames[len(frames)] + 6 THEN list_append(frames, o.frame) WHEN o.code > codes[len(codes)] THEN list_append(frames[1:len(frames) - 1], o.frame) ELSE frames END,
         CASE WHEN o.frame >= frames[len(frames)] + 6 THEN list_append(codes, o.code) WHEN o.code > codes[len(codes)] THEN list_append(codes[1:len(codes) - 1], o.code) ELSE codes END
  FROM k JOIN o ON o.channel = k.channel AND o.i = k.i + 1),
l AS (SELECT channel, arg_max(frames, i) AS frames, arg_max(codes, i) AS codes FROM k GROUP BY channel)
SELECT channel, unnest(frames) AS frame, unnest(codes) AS code FROM l""")
def picked_onsets(spark, sf):
    """[W4 D8] Peaks at least six frames apart; a stronger one takes the place of the one before."""
    own = _peaks(spark, sf).groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("frame", "code"))).alias("peaks"))
    return own.select("channel", F.explode(W.pick_peaks(F.col("peaks"), 6)).alias("p")).select("channel", "p.frame", "p.code")


@query(f"""WITH RECURSIVE {SIGNAL}, {PEAKS}, n AS (SELECT channel, max(frame) + 1 AS length FROM signal GROUP BY channel),
o AS (SELECT channel, frame, row_number() OVER (PARTITION BY channel ORDER BY frame) AS i FROM peaks WHERE frame > 0),
k AS (SELECT channel, 0 AS i, [0::BIGINT] AS cuts FROM n UNION ALL
  SELECT k.channel, k.i + 1, CASE WHEN o.frame - cuts[len(cuts)] >= 8 THEN list_append(cuts, o.frame) ELSE cuts END FROM k JOIN o ON o.channel = k.channel AND o.i = k.i + 1),
l AS (SELECT channel, arg_max(cuts, i) AS cuts FROM k GROUP BY channel), c AS (SELECT channel, unnest(cuts) AS cut FROM l),
s AS (SELECT channel, cut, coalesce(lead(cut) OVER (PARTITION BY channel ORDER BY cut), length) AS stop FROM c JOIN n USING (channel)),
e AS (SELECT *, CAST(ceil((stop - cut) / ceil((stop - cut) / 20.0)) AS BIGINT) AS each FROM s),
p AS (SELECT channel, cut AS start FROM e UNION ALL SELECT channel, p FROM (SELECT channel, cut, stop, unnest(range(cut + each, stop, each)) AS p FROM e WHERE stop - cut > 20) WHERE stop - p >= 8)
SELECT channel, start FROM p""")
def shaped_events(spark, sf):
    """[W8 D13] Where events begin: at 0 and at cuts eight frames apart at least, spans over 20 frames in even pieces."""
    cuts = _peaks(spark, sf).groupBy("channel").agg(F.array_sort(F.collect_list(F.col("frame"))).alias("cuts"))
    lengths = signal(spark, sf).groupBy("channel").agg((F.max("frame") + 1).alias("length"))
    both = lengths.join(cuts, "channel", "left").select("channel", F.coalesce("cuts", F.array().cast("array<long>")).alias("cuts"), "length")
    return both.select("channel", F.explode(W.shape(F.col("cuts"), F.col("length"), 8, 20)).alias("start"))


@query(f"""WITH RECURSIVE {SIGNAL}, {PEAKS}, a AS (SELECT channel, list(frame ORDER BY frame) AS cuts FROM peaks GROUP BY channel),
k AS (SELECT channel, cuts, 1 AS i, [cuts[1]] AS kept FROM a UNION ALL
      SELECT channel, cuts, i + 1, CASE WHEN cuts[i + 1] - kept[len(kept)] >= 10 THEN list_append(kept, cuts[i + 1]) ELSE kept END FROM k WHERE i < len(cuts))
SELECT channel, len(kept) AS n, kept[len(kept)] AS last_cut, CAST(list_sum(kept) AS BIGINT) AS total FROM k WHERE i = len(cuts)""")
def minimum_gap(spark, sf):
    """[W4 W8] Cuts at least 10 frames behind the last one kept."""
    out = _peaks(spark, sf).groupBy("channel").agg(F.array_sort(F.collect_list("frame")).alias("cuts")).select("channel", W.fold_gap(F.col("cuts"), 10).alias("kept"))
    return out.select("channel", F.size("kept").alias("n"), F.element_at("kept", -1).alias("last_cut"), F.aggregate("kept", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("total"))


@query(f"""WITH {NOTES}, f AS (SELECT DISTINCT channel, note, unnest(range(start // 10, (start + length) // 10 + 1)) AS frame FROM note WHERE length > 0),
g AS (SELECT *, frame - row_number() OVER (PARTITION BY channel, note ORDER BY frame) AS run FROM f)
SELECT channel, note, min(frame) AS start_frame, count(*) AS frames FROM g GROUP BY channel, note, run HAVING count(*) >= 2""")
def note_islands(spark, sf):
    """[W10 F6] Notes tracked through frames: runs without a gap, of two frames at least."""
    tall = notes(spark, sf).where("length > 0").select("channel", "note", F.explode(F.sequence(F.expr("start div 10"), F.expr("(start + length) div 10"))).alias("frame")).distinct()
    return W.islands(tall, ["channel", "note"]).where("frames >= 2")


@query(f"""WITH {SIGNAL}, h AS (SELECT channel, frame, list_sort(list(code) OVER (PARTITION BY channel ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)) AS l FROM signal)
SELECT channel, frame, (l[(len(l) - 1) // 2 + 1] + l[len(l) // 2 + 1]) / 2 AS median FROM h""")
def moving_median(spark, sf):
    """[W11]"""
    return signal(spark, sf).select("channel", "frame", W.moving_median("code", 17).alias("median"))


@query(f"""WITH {SIGNAL} SELECT channel, frame, (3 * code + 2 * (coalesce(lag(code) OVER w, 0) + coalesce(lead(code) OVER w, 0)) + coalesce(lag(code, 2) OVER w, 0) + coalesce(lead(code, 2) OVER w, 0)) / 9 AS smooth
FROM signal WINDOW w AS (PARTITION BY channel ORDER BY frame)""")
def triangular_smoothing(spark, sf):
    """[W12]"""
    return signal(spark, sf).select("channel", "frame", W.triangular("code", 2).alias("smooth"))


@query(f"""WITH {SIGNAL}, l AS (SELECT channel, frame, code, unnest(range(1, 9)) AS lag FROM signal)
SELECT l.channel, l.lag, count(*) AS overlap, CAST(sum(l.code * s.code) AS BIGINT) AS total FROM l JOIN signal s ON s.channel = l.channel AND s.frame = l.frame + l.lag GROUP BY l.channel, l.lag""")
def autocorrelation(spark, sf):
    """[W13]"""
    return W.autocorrelation(signal(spark, sf), 8)


DIFFERENCE = f"""d AS (SELECT l.channel, l.lag, CAST(sum((l.code - s.code) * (l.code - s.code)) AS BIGINT) AS d
  FROM (SELECT channel, frame, code, unnest(range(0, 9)) AS lag FROM signal) l JOIN signal s ON s.channel = l.channel AND s.frame = l.frame + l.lag GROUP BY l.channel, l.lag)"""


@query(f"""WITH {SIGNAL}, {DIFFERENCE}
SELECT channel, lag, d, CASE WHEN lag = 0 THEN 1.0 ELSE d * lag / nullif(CAST(sum(d) OVER (PARTITION BY channel ORDER BY lag) AS BIGINT), 0) END AS cmnd FROM d""")
def cumulative_difference(spark, sf):
    """[W15 D9] The difference function by lag and its normalised form."""
    s = signal(spark, sf)
    left = s.select("channel", "code", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("lag"), "frame").withColumn("at", F.col("frame") + F.col("lag"))
    right = s.select("channel", F.col("frame").alias("at"), F.col("code").alias("y"))
    d = left.join(right, ["channel", "at"]).groupBy("channel", "lag").agg(F.sum((F.col("code") - F.col("y")) * (F.col("code") - F.col("y"))).alias("d"))
    return W.cumulative_mean_normalised(d)


TICKS = f"""ticks AS (SELECT channel, tick, kind, note FROM (SELECT channel, start AS tick, 1 AS kind, note FROM note UNION ALL SELECT channel, start + length, 0, note FROM note))"""


@query(f"WITH {NOTES}, {TICKS} SELECT channel, tick, kind, note, tick - coalesce(lag(tick) OVER (PARTITION BY channel ORDER BY tick, kind, note), 0) AS delta FROM ticks")
def midi_deltas(spark, sf):
    """[W17] Delta ticks, ends before starts of the same tick."""
    return _ticks(spark, sf).withColumn("delta", W.delta_encode("tick", ["channel"], ["tick", "kind", "note"]))


def _ticks(spark, sf):
    n = notes(spark, sf)
    on = n.select("channel", F.col("start").alias("tick"), F.lit(1).alias("kind"), "note")
    return on.unionByName(n.select("channel", (F.col("start") + F.col("length")).alias("tick"), F.lit(0).alias("kind"), "note"))


@query(f"WITH {NOTES}, {TICKS} SELECT channel, tick, kind, note, tick AS decoded FROM ticks")
def midi_absolute(spark, sf):
    """[W18] Deltas summed up again give the ticks."""
    d = _ticks(spark, sf).withColumn("delta", W.delta_encode("tick", ["channel"], ["tick", "kind", "note"]))
    return d.withColumn("decoded", W.delta_decode("delta", ["channel"], ["tick", "kind", "note"])).drop("delta")


@query("""WITH p AS (SELECT DISTINCT p_size % 5 AS instrument, CAST(21 + p_partkey % 88 AS INTEGER) AS note FROM part),
n AS (SELECT *, lag(note) OVER w AS before, lead(note) OVER w AS after FROM p WINDOW w AS (PARTITION BY instrument ORDER BY note))
SELECT instrument, note, CAST(coalesce(before + ceil((note - before) / 2), 0) AS INTEGER) AS low, CAST(coalesce(note + ceil((after - note) / 2) - 1, 127) AS INTEGER) AS high FROM n""")
def key_zones(spark, sf):
    """[W19]"""
    p = table(spark, sf, "part").select((F.col("p_size") % 5).alias("instrument"), (21 + F.col("p_partkey") % 88).cast("int").alias("note"))
    return W.key_zones(p)


@query("SELECT p_partkey, 35 + row_number() OVER (ORDER BY p_partkey) AS key FROM part WHERE p_type = 'ECONOMY' QUALIFY key <= 127")
def unpitched_keys(spark, sf):
    """[W20] At most 92 samples without a pitch get the keys from 36 on: a top-k, not a sort of all."""
    first = table(spark, sf, "part").where("p_type = 'ECONOMY'").select("p_partkey").orderBy("p_partkey").limit(92)
    return first.withColumn("key", (35 + F.row_number().over(Window.orderBy("p_partkey"))).cast("long"))


@query(f"""WITH {NOTES}, d AS (SELECT channel, start, max(start + length) AS stop FROM note GROUP BY channel, start),
r AS (SELECT channel, start, max(stop) OVER (PARTITION BY channel ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM d)
SELECT channel, coalesce(covered, 0) AS rest_start, start - coalesce(covered, 0) AS rest FROM r WHERE start > coalesce(covered, 0)""")
def rests(spark, sf):
    """[W21] Gaps that no note covers."""
    d = notes(spark, sf).groupBy("channel", "start").agg(F.max(F.col("start") + F.col("length")).alias("stop"))
    covered = F.coalesce(F.max("stop").over(Window.partitionBy("channel").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return d.select("channel", covered.alias("rest_start"), (F.col("start") - covered).alias("rest")).where("rest > 0")


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM s GROUP BY user_id, session""")
def sessions(spark, sf):
    """Sessions of events with gaps of ten minutes at most (the gap rule of segments, over time)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros("ts")
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("fresh", F.when(us - F.lag(us).over(w) <= 600_000_000, 0).otherwise(1)).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), (F.max(us) - F.min(us)).alias("micros"))


@query("""WITH t AS (SELECT user_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us FROM events)
SELECT user_id, round(min(us / 1e6), 6) AS first_onset, round(max(us / 1e6) * 120 / 60, 6) AS last_beat, count(*) AS onsets FROM t WHERE us >= 0 GROUP BY user_id""")
def onset_times(spark, sf):
    """[F8 P26] Onset times from a user's first event, in beats at 120 a minute."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = table(spark, sf, "events").select("user_id", (us - F.min(us).over(Window.partitionBy("user_id"))).alias("us")).where("us >= 0")
    return t.groupBy("user_id").agg(F.round(F.min(F.col("us") / 1e6), 6).alias("first_onset"), F.round(S.beats(F.max(F.col("us") / 1e6), 120.0), 6).alias("last_beat"), F.count(F.lit(1)).alias("onsets"))
