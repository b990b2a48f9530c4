"""Render, joins, aggregates, sorting and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as R
from ..operators import render as V
from .base import NOTES, PLACEMENTS, SIGNAL, TIMELINE, WAVEFORMS, notes, placements, query, signal, table, waveforms

RENDER = f"""render AS (
  SELECT channel, frame, CAST(sum(num) AS BIGINT) AS num FROM (
    SELECT p.channel, p.start + i AS frame, p.gain_num * b.codes[i + 1] AS num
    FROM (SELECT *, unnest(range(0, length)) AS i FROM placement JOIN bank USING (sample_id) WHERE gain_num <> 0) p
    JOIN bank b USING (sample_id))
  WHERE frame >= 0 AND frame < {TIMELINE} GROUP BY channel, frame)"""


@query(f"WITH {WAVEFORMS}, {PLACEMENTS}, {RENDER} SELECT * FROM render")
def render_placements(spark, sf):
    """[J1 J3 A9]"""
    return V.rendered(placements(spark, sf), waveforms(spark, sf), TIMELINE)


def _parts(spark, sf):
    own = signal(spark, sf).select("channel", "frame", "code")
    return V.residual(own, V.rendered(placements(spark, sf), waveforms(spark, sf), TIMELINE))


PARTS = f"""parts AS (
  SELECT s.channel, s.frame, s.code, CAST(round(coalesce(num, 0)::DOUBLE / 65536.0) AS BIGINT) AS rendered,
         s.code - CAST(round(coalesce(num, 0)::DOUBLE / 65536.0) AS BIGINT) AS residual
  FROM signal s LEFT JOIN render r ON s.channel = r.channel AND s.frame = r.frame)"""


@query(f"WITH {SIGNAL}, {WAVEFORMS}, {PLACEMENTS}, {RENDER}, {PARTS} SELECT * FROM parts")
def residual_of_render(spark, sf):
    """[J6 D20]"""
    return _parts(spark, sf)


def REPORT(residual):
    return f"""SELECT channel, count(*) AS frames, max(abs(code)) AS peak, max(abs({residual})) AS residual_peak,
       CAST(sum(rendered * rendered) AS BIGINT) AS rendered_energy, CAST(sum({residual} * {residual}) AS BIGINT) AS residual_energy,
       CASE WHEN sum(rendered * rendered) + sum({residual} * {residual}) = 0 THEN 0.0
            ELSE round(CAST(sum({residual} * {residual}) AS DOUBLE) / CAST(sum(rendered * rendered) + sum({residual} * {residual}) AS DOUBLE), 9) END AS residual_share,
       max(abs(code - rendered - {residual})) AS deviation FROM parts GROUP BY channel"""


@query(f"WITH {SIGNAL}, {WAVEFORMS}, {PLACEMENTS}, {RENDER}, {PARTS} {REPORT('residual')}")
def render_and_verify(spark, sf):
    """[A7 A8 A11 D22] The report of every channel: its residual table is read beside a render of its own."""
    own = signal(spark, sf).select("channel", "frame", "code")
    render = V.rendered(placements(spark, sf), waveforms(spark, sf), TIMELINE)
    return V.report(own, render, V.residual(own, render).select("channel", "frame", "residual"))


#: What a damaged residual holds: frames whose number leaves 7 over 50 are off by their number, as are two of channel 1.
DAMAGE = "CASE WHEN frame % 50 = 7 THEN residual + frame WHEN channel = 1 AND frame < 2 THEN -residual ELSE residual END"


@query(f"WITH {SIGNAL}, {WAVEFORMS}, {PLACEMENTS}, {RENDER}, {PARTS} {REPORT('(' + DAMAGE + ')')}")
def verify_damaged(spark, sf):
    """[A8 A11 D22 S15] The report finds how far a damaged residual is off."""
    own = signal(spark, sf).select("channel", "frame", "code")
    render = V.rendered(placements(spark, sf), waveforms(spark, sf), TIMELINE)
    return V.report(own, render, V.residual(own, render).select("channel", "frame", F.expr(DAMAGE).alias("residual")))


@query(f"""WITH {SIGNAL}, {WAVEFORMS}, {PLACEMENTS}, {RENDER}, {PARTS},
p AS (SELECT count(*) AS frames, count(DISTINCT channel) AS channels, max(abs(residual)) AS residual_peak, max(abs(code - rendered - residual)) AS deviation,
        round(CAST(sum(residual * residual) AS DOUBLE) / CAST(sum(residual * residual) + sum(rendered * rendered) AS DOUBLE), 9) AS residual_share FROM parts),
b AS (SELECT count(*) AS samples, CAST(sum(length) AS BIGINT) AS stored FROM bank),
c AS (SELECT count(*) AS placements, CAST(sum(length) AS BIGINT) AS covered FROM placement JOIN bank USING (sample_id)), {NOTES}, n AS (SELECT count(*) AS notes FROM note)
SELECT frames, channels, residual_peak, deviation, residual_share, samples, stored, placements, covered, covered / stored AS reuse, notes FROM p, b, c, n""")
def whole_report(spark, sf):
    """[A5 A6 A7 A8 A11 A19] One row: all metrics of the verification, over all channels."""
    own = signal(spark, sf).select("channel", "frame", "code")
    bank, placed = waveforms(spark, sf), placements(spark, sf)
    render = V.rendered(placed, bank, TIMELINE)
    parts = V.joined(own, render, V.residual(own, render).select("channel", "frame", "residual"))
    rest, made = F.sum(F.col("residual") * F.col("residual")).cast("double"), F.sum(F.col("rendered") * F.col("rendered")).cast("double")
    p = parts.agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("channel").alias("channels"), F.max(F.abs("residual")).alias("residual_peak"), F.max(F.abs(F.col("code") - F.col("rendered") - F.col("residual"))).alias("deviation"), F.round(rest / (rest + made), 9).alias("residual_share"))
    b = bank.agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col("length").cast("long")).alias("stored"))
    c = placed.join(bank.drop("codes"), "sample_id").agg(F.count(F.lit(1)).alias("placements"), F.sum(F.col("length").cast("long")).alias("covered"))
    n = notes(spark, sf).agg(F.count(F.lit(1)).alias("notes"))
    one = p.join(b, F.lit(True)).join(c, F.lit(True)).join(n, F.lit(True))  # one row each
    return one.select("frames", "channels", "residual_peak", "deviation", "residual_share", "samples", "stored", "placements", "covered", (F.col("covered") / F.col("stored")).alias("reuse"), "notes")


@query(f"""WITH {WAVEFORMS}, {PLACEMENTS}
SELECT stored, covered, covered / stored AS reuse
FROM (SELECT CAST(sum(length) AS BIGINT) AS stored FROM bank), (SELECT CAST(sum(length) AS BIGINT) AS covered FROM placement JOIN bank USING (sample_id))""")
def bank_coverage(spark, sf):
    """[A5 A6]"""
    return V.coverage(placements(spark, sf), waveforms(spark, sf))


@query(f"WITH {SIGNAL} SELECT channel, max(abs(code)) AS peak, CAST(sum(code * code) AS BIGINT) AS energy, count(*) AS frames, round(sqrt(CAST(sum(code * code) AS DOUBLE) / count(*)), 6) AS rms FROM signal GROUP BY channel")
def levels(spark, sf):
    """[A1 A2 A3]"""
    s = signal(spark, sf)
    energy = F.sum(F.col("code") * F.col("code"))
    return s.groupBy("channel").agg(F.max(F.abs("code")).alias("peak"), energy.alias("energy"), F.count(F.lit(1)).alias("frames"), F.round(F.sqrt(energy.cast("double") / F.count(F.lit(1))), 6).alias("rms"))


@query(f"WITH {SIGNAL} SELECT frame, round(CAST(sum(code) AS DOUBLE) / count(*), 6) AS mono, count(*) AS channels FROM signal GROUP BY frame")
def mono_mix(spark, sf):
    """[A4]"""
    return signal(spark, sf).groupBy("frame").agg(F.round(F.sum("code").cast("double") / F.count(F.lit(1)), 6).alias("mono"), F.count(F.lit(1)).alias("channels"))


@query(f"WITH {SIGNAL} SELECT channel, min(frame) AS attack FROM signal JOIN (SELECT channel, max(abs(code)) AS peak FROM signal GROUP BY channel) USING (channel) WHERE abs(code) = peak GROUP BY channel")
def attack(spark, sf):
    """[A12] First frame of the greatest absolute value."""
    return signal(spark, sf).groupBy("channel").agg(F.min_by("frame", F.struct(-F.abs("code"), "frame")).alias("attack"))


@query(f"WITH {SIGNAL} SELECT channel, frame // 32 AS block, max(abs(code)) AS peak, round(sqrt(CAST(sum(code * code) AS DOUBLE) / count(*)), 6) AS rms FROM signal GROUP BY channel, frame // 32")
def envelope_tumbling(spark, sf):
    """[A13]"""
    return signal(spark, sf).groupBy("channel", F.expr("frame div 32").alias("block")).agg(F.max(F.abs("code")).alias("peak"), F.round(F.sqrt(F.sum(F.col("code") * F.col("code")).cast("double") / F.count(F.lit(1))), 6).alias("rms"))


@query(f"""WITH {SIGNAL} SELECT channel, block, max(abs(code)) AS peak, count(*) AS n
FROM (SELECT channel, code, unnest(range(greatest(0, (frame - 31 + 15) // 16), frame // 16 + 1)) AS block FROM signal) GROUP BY channel, block""")
def envelope_hopping(spark, sf):
    """[A13] Blocks of 32 frames every 16: every frame unfolds to the blocks that hold it."""
    blocks = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.expr("(frame - 16) div 16")), F.expr("frame div 16"))).alias("block")
    return signal(spark, sf).select("channel", "code", blocks).groupBy("channel", "block").agg(F.max(F.abs("code")).alias("peak"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SIGNAL}, m AS (SELECT channel, max(abs(code)) AS top FROM signal GROUP BY channel)
SELECT channel, frame, code, abs(code) * 1.0 / top AS confidence FROM signal JOIN m USING (channel)""")
def confidence_by_channel(spark, sf):
    """[A15] Share of the channel's greatest value."""
    w = Window.partitionBy("channel")
    return signal(spark, sf).select("channel", "frame", "code", (F.abs("code") * 1.0 / F.max(F.abs("code")).over(w)).alias("confidence"))


@query(f"WITH {SIGNAL} SELECT channel, median(code) AS median, round(avg(code), 6) AS mean, count(DISTINCT code) AS codes FROM signal GROUP BY channel")
def channel_median(spark, sf):
    """[A17]"""
    return signal(spark, sf).groupBy("channel").agg(F.median("code").alias("median"), F.round(F.avg("code"), 6).alias("mean"), F.count_distinct("code").alias("codes"))


@query(f"WITH {NOTES} SELECT channel, max(start + length) AS end_frame, count(*) AS notes, count(*) FILTER (note >= 60) AS high_notes, count(DISTINCT note) AS pitches FROM note GROUP BY channel")
def session_end(spark, sf):
    """[A18 A19 A22]"""
    return notes(spark, sf).groupBy("channel").agg(F.max(S.note_end("start", "length")).alias("end_frame"), F.count(F.lit(1)).alias("notes"), F.count_if(F.col("note") >= 60).alias("high_notes"), F.count_distinct("note").alias("pitches"))


@query(f"""WITH {NOTES}, c AS (SELECT channel, start, min(length) AS shortest, count(*) AS voices, array_to_string(list_sort(list(DISTINCT note)), ' ') AS chord FROM note GROUP BY channel, start)
SELECT channel, start, voices, chord, greatest(1, least(shortest, coalesce(lead(start) OVER (PARTITION BY channel ORDER BY start) - start, shortest))) AS duration FROM c""")
def chords(spark, sf):
    """[A21] Notes that start together, held until the next chord at most."""
    return R.chords(notes(spark, sf))


@query(f"WITH {WAVEFORMS}, {PLACEMENTS} SELECT sample_id, channel, count(*) AS clips, min(start) AS first_start, max(start + length) AS end_frame FROM placement JOIN bank USING (sample_id) GROUP BY sample_id, channel")
def lanes(spark, sf):
    """[J2 A20] One lane a sample and channel; lanes without clips do not appear."""
    clips = placements(spark, sf).join(waveforms(spark, sf).drop("codes"), "sample_id")
    return clips.groupBy("sample_id", "channel").agg(F.count(F.lit(1)).alias("clips"), F.min("start").alias("first_start"), F.max(F.col("start") + F.col("length")).alias("end_frame"))


@query(f"""WITH {WAVEFORMS}, {PLACEMENTS} SELECT l_orderkey, l_linenumber, greatest(start, 0) AS clip_start, greatest(-start, 0) AS clip_offset, length - greatest(-start, 0) AS clip_length
FROM placement JOIN bank USING (sample_id) WHERE length - greatest(-start, 0) > 0""")
def clips(spark, sf):
    """[P37]"""
    joined = placements(spark, sf).join(waveforms(spark, sf).drop("codes"), "sample_id").withColumn("c", S.clip_of("start", F.col("length").cast("long"))).where("c is not null")
    return joined.select("l_orderkey", "l_linenumber", F.col("c.start").alias("clip_start"), F.col("c.offset").alias("clip_offset"), F.col("c.length").alias("clip_length"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS k, l_quantity AS len FROM lineitem),
b AS (SELECT p_partkey AS sample_id, p_partkey % 50 AS k, p_size AS size FROM part),
r AS (SELECT e.l_orderkey, e.l_linenumber, b.sample_id, row_number() OVER (PARTITION BY e.l_orderkey, e.l_linenumber, e.k, e.len ORDER BY abs(log2(size / len)), sample_id DESC) AS place
  FROM e JOIN b USING (k) WHERE abs(log2(size / len)) <= 1)
SELECT l_orderkey, l_linenumber, sample_id, place FROM r WHERE place <= 3""")
def candidates(spark, sf):
    """[F2 J5 O4] Bank entries within an octave of an event's length, the nearest three, later ids first among equals."""
    e = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("k"), F.col("l_quantity").alias("len"))
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), (F.col("p_partkey") % 50).alias("k"), F.col("p_size").alias("size"))
    return R.length_candidates(e, b, ["l_orderkey", "l_linenumber", "k", "len"], "k", "len", "size", 3).select("l_orderkey", "l_linenumber", "sample_id", "place")


@query(f"""WITH v AS (SELECT vec_id, label, embedding FROM embeddings), f AS (SELECT label, embedding, min(vec_id) AS first_id, count(*) AS n FROM v GROUP BY label, embedding)
SELECT v.vec_id, f.first_id, f.n FROM v JOIN f ON v.label IS NOT DISTINCT FROM f.label AND v.embedding = f.embedding""")
def exact_repeats(spark, sf):
    """[J4 P12] Equal waveforms meet by their hash and are confirmed by their values."""
    return R.exact_repeats(table(spark, sf, "embeddings"), "vec_id", "embedding", ["label"])


@query(f"""WITH {NOTES}, p AS (SELECT DISTINCT 24 + n_nationkey * 17 % 90 AS voice FROM nation), n AS (SELECT DISTINCT note FROM note),
r AS (SELECT note, voice, row_number() OVER (PARTITION BY note ORDER BY abs(note - voice), voice) AS place FROM n, p)
SELECT note, voice, round(pow(2, (note - voice) / 12), 9) AS speed FROM r WHERE place = 1""")
def nearest_voice(spark, sf):
    """[J7] The bank voice of nearest pitch, the first one among equals, and the speed that carries it there."""
    voices = table(spark, sf, "nation").select((24 + F.col("n_nationkey") * 17 % 90).cast("int").alias("voice"))
    return R.nearest_voice(notes(spark, sf).select("note"), voices)


@query(f"""WITH {NOTES} SELECT channel, measure, count(*) AS events, CAST(sum(least(start + length, (measure + 1) * 64) - greatest(start, measure * 64)) AS BIGINT) AS covered
FROM (SELECT channel, start, length, unnest(range(start // 64, (start + length - 1) // 64 + 1)) AS measure FROM note WHERE length > 0) GROUP BY channel, measure""")
def measures(spark, sf):
    """[J8] Notes over measures of 64 frames: each note unfolds to the measures it covers, so the interval join is an equi-join."""
    return R.by_measure(notes(spark, sf), 64)


@query("""WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
r AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t WHERE conv_id IS NOT NULL)
SELECT a.conv_id, a.turn AS on_turn, min(b.turn) AS off_turn FROM (SELECT * FROM r WHERE role = 'user') a LEFT JOIN (SELECT * FROM r WHERE role = 'assistant') b USING (conv_id, k) GROUP BY a.conv_id, a.turn""")
def on_off_pairs(spark, sf):
    """[J10] Each opening turn with the first closing turn before the next opening."""
    return R.pair_turns(table(spark, sf, "conversations"), "conv_id", "turn", "role", "user", "assistant")


@query("""SELECT l_orderkey, l_linenumber, coalesce(p_name, 'none') AS name, coalesce(p_partkey, 0) AS instrument
FROM lineitem LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_size > 25) ON l_partkey = p_partkey""")
def route_names(spark, sf):
    """[J11 J13] Left join with a default."""
    known = table(spark, sf, "part").where("p_size > 25").select("p_partkey", "p_name")
    joined = table(spark, sf, "lineitem").join(known, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("none")).alias("name"), F.coalesce("p_partkey", F.lit(0)).alias("instrument"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def dangling_placements(spark, sf):
    """[J14 J12 S15] Placements whose sample is missing."""
    return table(spark, sf, "lineitem").join(table(spark, sf, "part").where("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT DISTINCT o.o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)")
def used_sources(spark, sf):
    """Semi join: sources that some long placement refers to."""
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_custkey").distinct()


@query(f"""WITH {NOTES}, o AS (SELECT *, lag(start + length) OVER (PARTITION BY channel, note ORDER BY start, length, velocity) AS before_end FROM note),
g AS (SELECT *, sum(CASE WHEN before_end IS NOT NULL AND before_end = start THEN 0 ELSE 1 END) OVER (PARTITION BY channel, note ORDER BY start, length, velocity ROWS UNBOUNDED PRECEDING) AS chain FROM o)
SELECT channel, note, min(start) AS start, CAST(sum(length) AS BIGINT) AS length, count(*) AS tied FROM g GROUP BY channel, note, chain""")
def tied_notes(spark, sf):
    """[J16] A note that starts where the one before of its pitch ends goes on with it."""
    return R.tie(notes(spark, sf))


@query(f"WITH {NOTES}, {SIGNAL} SELECT coalesce(n.channel, s.channel) AS channel, coalesce(n.note, s.note) AS note, n.note IS NOT NULL AS active, s.n_signal FROM (SELECT DISTINCT channel, note FROM note) n FULL JOIN (SELECT channel, code % 128 AS note, count(*) AS n_signal FROM signal GROUP BY ALL) s ON n.channel = s.channel AND n.note = s.note")
def notes_and_frames(spark, sf):
    """[J9] Active notes against frame pitches: an outer join on (channel, note)."""
    n = notes(spark, sf).select(F.col("channel").cast("long").alias("channel"), F.col("note").cast("long").alias("note")).distinct().withColumn("active", F.lit(True))
    s = signal(spark, sf).groupBy("channel", (F.col("code") % 128).alias("note")).agg(F.count(F.lit(1)).alias("n_signal"))
    return n.join(s, ["channel", "note"], "full").select("channel", "note", F.coalesce("active", F.lit(False)).alias("active"), "n_signal")


@query(f"""WITH {NOTES}, u AS (SELECT DISTINCT start FROM note UNION SELECT DISTINCT start FROM placement WHERE start >= 0), {PLACEMENTS}
SELECT start, row_number() OVER (ORDER BY start) AS place FROM u""".replace(f"WITH {NOTES}, u AS", f"WITH {NOTES}, {PLACEMENTS}, u AS").replace(f"), {PLACEMENTS}\nSELECT start", ")\nSELECT start"))
def distinct_times(spark, sf):
    """[U2 U4] Onset times of placements and notes, once each, numbered without gathering them in one task."""
    times = notes(spark, sf).select("start").union(placements(spark, sf).where("start >= 0").select("start")).distinct()
    return R.dense_number(times, ["start"], "place")


@query("""WITH t AS (SELECT 0 AS section, p_partkey AS k, p_name AS name FROM part UNION ALL SELECT 1, s_suppkey, s_name FROM supplier UNION ALL SELECT 2, c_custkey, c_name FROM customer)
SELECT section, k, name, row_number() OVER (PARTITION BY section ORDER BY k) AS place FROM t""")
def session_tracks(spark, sf):
    """[U1 U3] Sections of tracks under each other, in order."""
    sections = [("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name")]
    union = None
    for i, (name, key, label) in enumerate(sections):
        own = table(spark, sf, name).select(F.lit(i).alias("section"), F.col(key).alias("k"), F.col(label).alias("name"))
        union = own if union is None else union.unionByName(own)
    return union.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("k")).cast("long"))


@query("SELECT event_type AS file, min(event_id) AS first_seen, count(*) AS uses FROM events GROUP BY event_type")
def files_first_seen(spark, sf):
    """[S36 U5]"""
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("file")).agg(F.min("event_id").alias("first_seen"), F.count(F.lit(1)).alias("uses"))


@query(f"WITH {NOTES} SELECT *, row_number() OVER (PARTITION BY channel ORDER BY start, note, length, velocity) AS place FROM note")
def first_notes(spark, sf):
    """[O1 O2 O3 O9] The place of every note in its channel in (start, note) order."""
    return R.dense_number(notes(spark, sf), ["start", "note", "length", "velocity"], "place", by=("channel",))


@query("SELECT p_partkey, note FROM (SELECT p_partkey, 21 + p_partkey % 88 AS note, row_number() OVER (PARTITION BY 21 + p_partkey % 88 ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def first_per_note(spark, sf):
    """[O10] Of the instruments of one pitch the first."""
    return table(spark, sf, "part").groupBy((21 + F.col("p_partkey") % 88).alias("note")).agg(F.min("p_partkey").alias("p_partkey"))


@query("SELECT l_partkey AS sample_id, count(*) AS placements, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_partkey")
def placements_of(spark, sf):
    """[F9]"""
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("sample_id")).agg(F.count(F.lit(1)).alias("placements"), F.min("l_orderkey").alias("first_order"))


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_by_region(spark, sf):
    """Grouping sets over dimension joins (a built-in beside the model's own aggregates)."""
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""WITH v AS (SELECT label, abs(CAST(round(CAST(x AS DOUBLE) * 32768) AS BIGINT)) AS v FROM (SELECT label, unnest(embedding) AS x FROM embeddings))
SELECT label, count(*) FILTER (v <= 3276) AS le_10, count(*) FILTER (v <= 6553) AS le_20, median(v) AS median, min(v) AS best, max(least(v % 160, 160 - v % 160)) AS worst_off_grid FROM v GROUP BY label""")
def remainder_distribution(spark, sf):
    """[A23 A24] Counts under cut points, best, median, and the worst distance from a grid of 160."""
    tall = table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("x")).select("label", F.abs(F.round(F.col("x").cast("double") * 32768).cast("long")).alias("v"))
    v = F.col("v")
    return tall.groupBy("label").agg(F.count_if(v <= 3276).alias("le_10"), F.count_if(v <= 6553).alias("le_20"), F.median(v).alias("median"), F.min(v).alias("best"), F.max(F.least(v % 160, 160 - v % 160)).alias("worst_off_grid"))
