"""Scalar functions, link stores and texts over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..model import FORMATS
from ..operators import links as L
from ..operators import relational as R
from .base import NOTES, PLACEMENTS, notes, placements, query, signal, SIGNAL, table


@query("SELECT event_id, CAST(round(value) AS BIGINT) AS whole, CAST(round(-value / 2) AS BIGINT) AS half FROM events")
def rounding(spark, sf):
    """[P1] Halves away from zero."""
    return table(spark, sf, "events").select("event_id", S.round_half_away("value").alias("whole"), S.round_half_away(-F.col("value") / 2).alias("half"))


_Q = {k: v for k, v in FORMATS.items() if not v[1]}


@query("SELECT vec_id, " + ", ".join(f"least(greatest(round(x / {v[2]!r}), {v[3]}), {v[4]}) * {v[2]!r} AS {k}, CAST(round(x / {v[2]!r}) AS BIGINT) AS code_{k}" for k, v in _Q.items()) + " FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 4 AS x FROM embeddings)")
def quantized(spark, sf):
    """[P2 P3] Nearest grid values and codes of every integer format."""
    x = (F.get("embedding", F.lit(0)).cast("double") * 4).alias("x")
    return table(spark, sf, "embeddings").select("vec_id", x).select("vec_id", *(c for k in _Q for c in (S.quantize("x", k).alias(k), S.to_code("x", k).alias(f"code_{k}"))))


def _exact_sql(name: str) -> str:
    bits, is_float, q, low, high = FORMATS[name]
    if name == "f64":
        return "true"
    if is_float:
        return "len(list_filter(a, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE) <> x)) = 0"
    return f"len(list_filter(a, lambda x: NOT (round(x / {q!r}) >= {low} AND round(x / {q!r}) <= {high} AND round(x / {q!r}) * {q!r} = x))) = 0"


ARRAYS = "arrays AS (SELECT p_partkey, [p_size / 128.0::DOUBLE - 0.25, CASE WHEN p_partkey % 3 = 0 THEN p_partkey / 32768.0::DOUBLE ELSE 0 END, CASE WHEN p_partkey % 5 = 0 THEN 0.1::DOUBLE ELSE 0 END] AS a FROM part)"


def _arrays(spark, sf):
    third = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") / 32768.0).otherwise(0.0)
    return table(spark, sf, "part").select("p_partkey", F.array(F.col("p_size") / 128.0 - 0.25, third, F.when(F.col("p_partkey") % 5 == 0, 0.1).otherwise(0.0)).alias("a"))


@query(f"WITH {ARRAYS} SELECT p_partkey, " + ", ".join(f"{_exact_sql(k)} AS {k}" for k in FORMATS) + ", CASE " + " ".join(f"WHEN {_exact_sql(k)} THEN '{k}'" for k in FORMATS) + " END AS narrowest FROM arrays")
def exactness(spark, sf):
    """[P4 P5 P7 S19]"""
    return _arrays(spark, sf).select("p_partkey", *(S.array_exact_in("a", k).alias(k) for k in FORMATS), S.narrowest_exact("a").alias("narrowest"))


@query("SELECT p_partkey, " + "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {v[0]}" for i, v in enumerate(FORMATS.values())) + " END AS bits, CASE WHEN p_partkey % 6 >= 4 THEN true ELSE false END AS is_float FROM part")
def format_lookup(spark, sf):
    """[P6]"""
    name = F.element_at(F.array(*map(F.lit, FORMATS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", S.format_bits(name).alias("bits"), S.format_is_float(name).alias("is_float"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 65536) AS BIGINT) AS gain_num, CAST(round(l_discount * 65536) AS BIGINT) / 65536.0::DOUBLE AS factor, CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE l_quantity / (l_linenumber % 3) END AS seconds FROM lineitem")
def gains(spark, sf):
    """[P8 P9]"""
    t = table(spark, sf, "lineitem").withColumn("gain_num", S.gain_of("l_discount"))
    return t.select("l_orderkey", "l_linenumber", "gain_num", S.gain_factor("gain_num").alias("factor"), S.duration_seconds("l_quantity", F.col("l_linenumber") % 3).alias("seconds"))


@query("SELECT vec_id, k, CASE WHEN k < 0 THEN 0.0 ELSE coalesce(CAST(embedding[k + 1] AS DOUBLE), 0.0) END AS v FROM (SELECT vec_id, embedding, vec_id % 80 - 8 AS k FROM embeddings)")
def samples_at(spark, sf):
    """[P11]"""
    t = table(spark, sf, "embeddings").withColumn("k", F.col("vec_id") % 80 - 8)
    return t.select("vec_id", "k", S.sample_at(F.col("embedding").cast("array<double>"), "k").alias("v"))


_NAMES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"


@query(f"""WITH n AS (SELECT DISTINCT p_partkey % 128 AS note FROM part)
SELECT note, round(440 * pow(2, (note - 69) / 12), 6) AS frequency, {_NAMES}[note % 12 + 1] || CAST(note // 12 - 1 AS VARCHAR) AS name, CAST(note AS INTEGER) AS parsed,
       CAST(note AS INTEGER) AS back, CAST(round(0.0, 3) AS DOUBLE) AS cents FROM n""")
def pitches(spark, sf):
    """[P13 P14] Names and frequencies of notes, and back."""
    n = table(spark, sf, "part").select((F.col("p_partkey") % 128).alias("note")).distinct().withColumn("f", S.midi_to_frequency("note"))
    return n.select("note", F.round("f", 6).alias("frequency"), S.note_name("note").alias("name"), S.parse_note(S.note_name("note")).alias("parsed"), S.nearest_midi("f").alias("back"), F.abs(F.round(S.cents_off("f"), 3)).alias("cents"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <= 0 THEN 1 ELSE CAST(least(greatest(round(cbrt(l_discount) * 126) + 1, 1), 127) AS INTEGER) END AS velocity,
       round(pow((l_orderkey % 127) / 126.0, 3), 9) AS amplitude, CAST(round((l_orderkey % 127 + 1) * 100 / 127.0) AS INTEGER) AS volume, round((l_orderkey % 127 + 1) * 100 / 90.0, 6) AS dynamics FROM lineitem""")
def velocities(spark, sf):
    """[P15 P36]"""
    v = F.col("l_orderkey") % 127 + 1
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.velocity_of("l_discount").alias("velocity"), F.round(S.amplitude_of(v), 9).alias("amplitude"), S.lmms_volume(v).alias("volume"), F.round(S.dynamics_of(v), 6).alias("dynamics"))


@query("""WITH t AS (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(0, len(embedding))) AS i FROM embeddings),
x AS (SELECT vec_id, i, n, least(i, n - 1 - i) AS edge, CAST(embedding[i + 1] AS DOUBLE) AS x FROM t)
SELECT vec_id, i, round(CASE WHEN edge < 3 THEN x * ((edge + 1) / 4.0::DOUBLE) ELSE x END, 9) AS faded, round(CASE WHEN i >= n - 4 THEN x * ((n - 1 - i) / 4.0::DOUBLE) ELSE x END, 9) AS tail FROM x""")
def fades(spark, sf):
    """[P16 P17] Every value of every vector with both fades, and with the tail's."""
    a = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    tall = a.select("vec_id", F.posexplode(F.arrays_zip(S.apply_fades("a", 3).alias("faded"), S.fade_out("a", 4).alias("tail"))).alias("i", "x"))
    return tall.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x.faded", 9).alias("faded"), F.round("x.tail", 9).alias("tail"))


@query("""WITH n AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS n FROM part), w AS (SELECT n, unnest(range(0, n)) AS i FROM n)
SELECT n, i, round(0.5 - 0.5 * cos(2 * pi() * i / n), 9) AS hann, round(0.54 - 0.46 * cos(2 * pi() * i / n), 9) AS hamming, round(0.42 - 0.5 * cos(2 * pi() * i / n) + 0.08 * cos(4 * pi() * i / n), 9) AS blackman FROM w""")
def window_shapes(spark, sf):
    """[P18]"""
    n = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    own = {k: S.window_shape(k, "n") for k in ("hann", "hamming", "blackman")}
    tall = n.select("n", F.posexplode(F.arrays_zip(*(c.alias(k) for k, c in own.items()))).alias("i", "x"))
    return tall.select("n", F.col("i").cast("long").alias("i"), *(F.round(F.col(f"x.{k}"), 9).alias(k) for k in own))


@query("SELECT vec_id, k, round(sqrt(re * re + im * im), 9) AS magnitude, round(re * re + im * im, 9) AS power, round(atan2(im, re), 9) AS phase FROM (SELECT vec_id, k, CAST(embedding[2 * k + 1] AS DOUBLE) AS re, CAST(embedding[2 * k + 2] AS DOUBLE) AS im FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 2)) AS k FROM embeddings))")
def complex_parts(spark, sf):
    """[P20]"""
    x = lambda k: F.get("embedding", k.cast("int")).cast("double")
    tall = table(spark, sf, "embeddings").where("size(embedding) > 1").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.size("embedding") / 2) - 1)).alias("k"))
    t = tall.select("vec_id", "k", x(F.col("k") * 2).alias("re"), x(F.col("k") * 2 + 1).alias("im"))
    return t.select("vec_id", "k", F.round(S.magnitude("re", "im"), 9).alias("magnitude"), F.round(S.power("re", "im"), 9).alias("power"), F.round(S.phase("re", "im"), 9).alias("phase"))


@query("""WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS m, 40 + vec_id % 30 AS note FROM embeddings),
h AS (SELECT vec_id, m, h, 440 * pow(2, (note - 69) / 12) * h * 128 / 8000.0 AS pos FROM (SELECT *, unnest(range(1, 9)) AS h FROM m))
SELECT vec_id, round(sum(CASE WHEN floor(pos) + 1 >= 64 THEN 0 ELSE (m[CAST(floor(pos) AS INTEGER) + 1] * (1 - (pos - floor(pos))) + m[CAST(floor(pos) AS INTEGER) + 2] * (pos - floor(pos))) / h END), 6) AS salience FROM h GROUP BY vec_id""")
def note_salience(spark, sf):
    """[P21 P22 P23]"""
    m = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("m"), (40 + F.col("vec_id") % 30).alias("note"))
    return m.select("vec_id", F.round(S.salience("m", "note", 8000, 128), 6).alias("salience"))


@query("""WITH t AS (SELECT vec_id, k, CAST(embedding[k] AS DOUBLE) AS a, CAST(embedding[k + 1] AS DOUBLE) AS b, CAST(embedding[k + 2] AS DOUBLE) AS c FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) - 1)) AS k FROM embeddings)),
s AS (SELECT *, CASE WHEN abs(a - 2 * b + c) > 2.220446049250313e-16 THEN 0.5 * (a - c) / (a - 2 * b + c) END AS s FROM t)
SELECT vec_id, k, CASE WHEN s IS NULL OR abs(s) > 1 THEN 0.0 ELSE round(s, 6) END AS shift, round(exp(-0.5 * pow(log2((60 + vec_id % 140) / 120.0) / 0.9, 2)), 9) AS prior FROM s""")
def vertices_and_priors(spark, sf):
    """[P24 P25]"""
    x = lambda k: F.get("embedding", (F.col("k") + (k - 1)).cast("int")).cast("double")
    tall = table(spark, sf, "embeddings").where("size(embedding) > 2").select("vec_id", "embedding", F.explode(F.sequence(F.lit(1).cast("long"), F.size("embedding").cast("long") - 2)).alias("k"))
    return tall.select("vec_id", "k", F.round(S.parabolic_vertex(x(0), x(1), x(2)), 6).alias("shift"), F.round(S.tempo_prior(60 + F.col("vec_id") % 140), 9).alias("prior"))


@query("""SELECT l_orderkey, l_linenumber, CAST((CAST(round(l_extendedprice) AS BIGINT) * 500000::HUGEINT * 44100) // (22050::HUGEINT * 1000000) AS BIGINT) AS frames,
       CAST((CAST(round(l_extendedprice) AS BIGINT) * 960::HUGEINT * 1000000) // (500000::HUGEINT * 44100) AS BIGINT) AS ticks,
       CAST(greatest(round(l_quantity * 0.25 * 8000), 0) AS BIGINT) AS from_seconds, round(l_quantity / 44100.0 * 120 / 60, 9) AS beats,
       CAST(round(l_quantity * 1000 / 44100.0 * 120 / 60 * 96) AS BIGINT) AS fl FROM lineitem""")
def time_units(spark, sf):
    """[P27 P29 P30 P40]"""
    n = F.round("l_extendedprice").cast("long")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", S.ticks_to_frames(n, F.lit(500000), F.lit(22050), F.lit(44100)).alias("frames"), S.frames_to_ticks(n, F.lit(500000), F.lit(960), F.lit(44100)).alias("ticks"),
        S.seconds_to_frames(F.col("l_quantity") * 0.25, F.lit(8000)).alias("from_seconds"), F.round(S.frames_to_beats("l_quantity", F.lit(44100), F.lit(120.0)), 9).alias("beats"),
        S.frames_to_units(F.col("l_quantity") * 1000, F.lit(44100), F.lit(120.0), S.FL_PPQ).alias("fl"),
    )


@query("""WITH r AS (SELECT DISTINCT (p_partkey % 24 + 1) * 2000 AS rate FROM part), t AS (SELECT rate, tempo, p, rate * tempo // 1000000 AS division FROM r,
  (SELECT unnest([500000, 1000000, 250000, 125000, 200000, 400000, 600000, 750000]) AS tempo, unnest(range(8)) AS p) WHERE rate * tempo % 1000000 = 0 AND rate * tempo // 1000000 BETWEEN 1 AND 32767)
SELECT rate, arg_min(tempo, p) AS tempo, CAST(arg_min(division, p) AS INTEGER) AS division FROM t GROUP BY rate""")
def midi_timing(spark, sf):
    """[P28]"""
    r = table(spark, sf, "part").select(((F.col("p_partkey") % 24 + 1) * 2000).alias("rate")).distinct().withColumn("t", S.midi_timing("rate"))
    return r.where("t is not null").select("rate", "t.tempo", "t.division")


@query("""WITH u AS (SELECT page_id, url FROM pages)
SELECT page_id, array_to_string(list_transform(list_filter(string_split(url, ''), lambda c: c <> ''), lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z0-9_./#-]') THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END), '') AS encoded, url AS decoded,
       regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS slug FROM u WHERE url IS NOT NULL AND url <> ''""")
def percent_and_slug(spark, sf):
    """[P31 P32]"""
    u = table(spark, sf, "pages").where("url is not null and url <> ''").select("page_id", "url").withColumn("encoded", S.percent_encode("url"))
    return u.select("page_id", "encoded", S.percent_decode("encoded").alias("decoded"), S.slug("url").alias("slug"))


@query("""SELECT p_partkey, regexp_replace(trim(translate('. ' || p_name || '/' || p_brand || '. ', '/\\:*?"<>|', '---------')), '^\\.+|\\.+$', '', 'g') AS stem,
       p_name || CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN CASE p_partkey % 2 WHEN 0 THEN ' L' ELSE ' R' END ELSE ' ' || CAST(p_partkey % 2 + 1 AS VARCHAR) END AS track,
       CAST(p_partkey * 777 // 60000 AS VARCHAR) || ':' || lpad(CAST(p_partkey * 777 // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(p_partkey * 777 % 1000 AS VARCHAR), 3, '0') AS transport FROM part""")
def display_names(spark, sf):
    """[P33 P34 P35]"""
    t = table(spark, sf, "part")
    return t.select("p_partkey", S.project_stem(F.concat(F.lit(". "), "p_name", F.lit("/"), "p_brand", F.lit(". "))).alias("stem"), S.track_name("p_name", F.col("p_partkey") % 2, F.col("p_size") % 3 + 1).alias("track"), S.transport(F.col("p_partkey") * 0.777).alias("transport"))


@query("""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, 0.5 + (vec_id % 7) / 4.0 AS s FROM embeddings),
t AS (SELECT vec_id, a, s, unnest(range(0, CAST(floor(64 / s) AS BIGINT))) AS i FROM a), u AS (SELECT vec_id, s, i, a, i * s - floor(i * s) AS f, CAST(floor(i * s) AS BIGINT) AS k FROM t)
SELECT vec_id, count(*) AS n, round(sum(coalesce(a[k + 1], 0) + (coalesce(a[k + 2], 0) - coalesce(a[k + 1], 0)) * f), 6) AS total FROM u GROUP BY vec_id""")
def resampled(spark, sf):
    """[P38]"""
    a = table(spark, sf, "embeddings").select("vec_id", S.resample(F.col("embedding").cast("array<double>"), 0.5 + (F.col("vec_id") % 7) / 4.0).alias("r"))
    return a.select("vec_id", F.size("r").cast("long").alias("n"), F.round(F.aggregate("r", F.lit(0.0), lambda acc, x: acc + x), 6).alias("total"))


@query("""WITH t AS (SELECT p_partkey, unnest(range(0, p_size)) AS i, p_size AS n, 100 + p_partkey % 400 AS f FROM part)
SELECT p_partkey, round(sum(0.5 * exp(-3 * i / 8000.0) * sin(2 * pi() * f * i / 8000.0) * CASE WHEN i >= n - least(16, n) THEN (n - 1 - i) / CAST(least(16, n) AS DOUBLE) ELSE 1 END), 6) AS total FROM t GROUP BY p_partkey""")
def tones(spark, sf):
    """[P39]"""
    t = table(spark, sf, "part").select("p_partkey", S.tone(F.lit(0.5), 100 + F.col("p_partkey") % 400, "p_size", F.lit(8000), 16).alias("w"))
    return t.select("p_partkey", F.round(F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x), 6).alias("total"))


@query("""WITH RECURSIVE v AS (SELECT [32, 24, 16, 12, 8, 6, 4, 3, 2, 1] AS v), s AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS length FROM lineitem),
r AS (SELECT length, length AS rest, 1 AS i, []::INTEGER[] AS parts FROM s UNION ALL
  SELECT length, CASE WHEN rest >= v[i] THEN rest - v[i] ELSE rest END, CASE WHEN rest >= v[i] THEN i ELSE i + 1 END, CASE WHEN rest >= v[i] THEN list_append(parts, v[i]) ELSE parts END FROM r, v WHERE rest > 0 AND i <= 10)
SELECT length, array_to_string(parts, '+') AS parts FROM r WHERE rest = 0""")
def note_values(spark, sf):
    """[P41] Lengths in (dotted) note values, greedily."""
    s = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("length")).distinct()
    return s.select("length", F.array_join(S.split_duration("length").cast("array<string>"), "+").alias("parts"))


@query("SELECT vec_id, len(embedding) + 10 - 3 AS n, round(list_sum(list_transform(embedding[4:], lambda x: CAST(x AS DOUBLE))), 9) AS total FROM embeddings")
def padded_segments(spark, sf):
    """[P43 P44] All samples from place 3 on, filled up with ten of silence."""
    a = table(spark, sf, "embeddings").select("vec_id", S.segment(F.col("embedding").cast("array<double>"), F.lit(3), F.size("embedding") + 7).alias("a"))
    return a.select("vec_id", F.size("a").cast("long").alias("n"), F.round(F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x), 9).alias("total"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'wav' WHEN 1 THEN 'aiff' WHEN 2 THEN 'flac' WHEN 3 THEN 'wav' END AS by_path, CASE p_partkey % 4 WHEN 0 THEN 'wav' WHEN 1 THEN 'aiff' WHEN 2 THEN 'flac' END AS by_bytes FROM part""")
def containers(spark, sf):
    """[P45 S3] By extension and by leading bytes."""
    path = F.concat(F.lit("x."), F.element_at(F.array(*map(F.lit, ("wav", "AIF", "flac", "Wave", "mp3"))), (F.col("p_partkey") % 5 + 1).cast("int")))
    head = F.unhex(F.element_at(F.array(*map(F.lit, ("524946460000000057415645", "464F524D0000000041494643", "664C614300000000", "4944330000000000"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", S.container_of_path(path).alias("by_path"), S.container_of_bytes(head).alias("by_bytes"))


PAIRS = "pairs AS (SELECT user_id AS source, ascii(event_type) AS target, min(event_id) AS f FROM events GROUP BY ALL), store AS (SELECT row_number() OVER (ORDER BY f, source, target) AS idx, source, target FROM pairs)"


def _store(spark, sf):
    pairs = table(spark, sf, "events").select(F.col("user_id").alias("source"), F.ascii("event_type").cast("long").alias("target"), "event_id")
    return L.create(pairs, "event_id")


@query(f"WITH {PAIRS} SELECT idx, source, CAST(target AS BIGINT) AS target FROM store")
def link_store(spark, sf):
    """[G1] Equal pairs are one link, numbered by first appearance."""
    return _store(spark, sf)


@query("SELECT name, row_number() OVER (ORDER BY f, name) AS idx FROM (SELECT event_type AS name, min(event_id) AS f FROM events GROUP BY event_type)")
def symbols(spark, sf):
    """[G2 G3]"""
    return L.intern(table(spark, sf, "events"), "event_type", "event_id")


@query(f"WITH {PAIRS}, q AS (SELECT DISTINCT user_id AS source, 97 + user_id % 20 AS target FROM events) SELECT q.source, q.target, idx FROM q LEFT JOIN store USING (source, target)")
def link_lookup(spark, sf):
    """[G4 J15]"""
    wanted = table(spark, sf, "events").select(F.col("user_id").alias("source"), (97 + F.col("user_id") % 20).alias("target")).distinct()
    return L.find(_store(spark, sf), wanted)


@query(f"WITH {PAIRS} SELECT 'source' AS side, idx FROM store WHERE source = 3 AND NOT (idx = 3 AND target = 3) UNION ALL SELECT 'target', idx FROM store WHERE target = 115 AND NOT (idx = 115 AND source = 115)")
def link_neighbours(spark, sf):
    """[F10]"""
    s = _store(spark, sf)
    return L.by_source(s, 3).select(F.lit("source").alias("side"), "idx").unionByName(L.by_target(s, 115).select(F.lit("target").alias("side"), "idx"))


SEQ = "seq AS (SELECT conv_id, list(role ORDER BY turn, role) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)"


@query(f"WITH {SEQ}, p AS (SELECT s[1:k] AS x, k FROM (SELECT s, unnest(range(1, len(s) + 1)) AS k FROM seq)) SELECT array_to_string(x, ',') AS prefix, CAST(k AS INTEGER) AS length, count(*) AS uses FROM p GROUP BY x, k")
def shared_prefixes(spark, sf):
    """[G5] Prefixes of turn sequences; each distinct one is a node."""
    c = table(spark, sf, "conversations").where("conv_id is not null")
    return L.shared_prefixes(c, "conv_id", "turn", "role").select(F.array_join("prefix", ",").alias("prefix"), "length", "uses")


@query(f"WITH {SEQ}, p AS (SELECT s[len(s) - k + 1:len(s)] AS x, k FROM (SELECT s, unnest(range(1, len(s) + 1)) AS k FROM seq)) SELECT array_to_string(x, ',') AS suffix, CAST(k AS INTEGER) AS length, count(*) AS uses FROM p GROUP BY x, k")
def shared_suffixes(spark, sf):
    """[G6] Suffixes are shared by the cons encoding."""
    c = table(spark, sf, "conversations").where("conv_id is not null")
    return L.shared_suffixes(c, "conv_id", "turn", "role").select(F.array_join("suffix", ",").alias("suffix"), "length", "uses")
