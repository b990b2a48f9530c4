"""Whole recordings: events as signals of a channel, taken apart and put together again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..model import DecomposeOptions, EventOptions, StftOptions
from ..operators import dsp, pursuit
from ..sources import audio as codec
from ..sources.audio import Audio
from .base import SIGNAL, query, signal

RATE = 1000
SMALL = StftOptions(64, 16)
OPTIONS = DecomposeOptions(events=EventOptions(stft=SMALL), stft=SMALL)


def _recordings(spark, sf):
    """A recording a user: 16-bit codes of the values in order."""
    rows = signal(spark, sf).groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("frame", "code"))).alias("x"))
    samples = F.transform("x", lambda s: (s["code"] % 65536 - 32768) / 32768.0)
    return rows.select(F.col("channel").cast("string").alias("recording_id"), F.lit(RATE).alias("sample_rate"), F.lit("pcm_i16").alias("format"), F.lit(0).alias("channel"), F.size("x").cast("long").alias("frames"), samples.alias("samples"))


def _taken_apart(spark, sf):
    return pursuit.decompose(_recordings(spark, sf), OPTIONS)


@query(f"""WITH {SIGNAL}, r AS (SELECT channel, frame, (code % 65536 - 32768) / 32768.0::DOUBLE AS x FROM signal)
SELECT CAST(channel AS VARCHAR) AS recording_id, CAST(channel AS BIGINT) AS channel, frame, round(x, 9) AS x FROM r""")
def decompose_recordings(spark, sf):
    """[D13 D16 D17 D18 D20 D21 D22 W16 A9] Recordings taken apart (stems and notes too) and put together from the tables of parts: every frame."""
    sources = _recordings(spark, sf)
    whole = pursuit.reconstruct(_taken_apart(spark, sf), sources.select("recording_id", "format", "channel", "frames"))
    tall = whole.select("recording_id", F.col("recording_id").cast("long").alias("channel"), F.posexplode("samples").alias("frame", "x"))
    return tall.select("recording_id", "channel", F.col("frame").cast("long").alias("frame"), F.round("x", 9).alias("x"))


@query()
def bank_of_recordings(spark, sf):
    """[D13 D18 A5 A6 A11 D12 D14 D19] Of every recording: samples, frames they store, placements, frames they cover, reuse, notes, stems."""
    p = _taken_apart(spark, sf)
    size = F.size("samples").cast("long")
    sizes = p.where("part = 'bank'").select("recording_id", F.col("ord").alias("sample_id"), size.alias("n"))
    covered = p.where("part = 'placement'").select("recording_id", F.col("length").alias("sample_id")).join(sizes, ["recording_id", "sample_id"]).groupBy("recording_id").agg(F.sum("n").alias("covered"))
    rows = p.groupBy("recording_id").agg(
        F.count_if(F.col("part") == "bank").alias("samples"), F.sum(F.when(F.col("part") == "bank", size).otherwise(0)).alias("stored"), F.count_if(F.col("part") == "placement").alias("placements"),
        F.count_if(F.col("part") == "note").alias("notes"), F.count_if(F.col("part") == "stem").alias("stems"),
    )
    return rows.join(covered, "recording_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long"))).withColumn("reuse", F.when(F.col("stored") == 0, 0.0).otherwise(F.col("covered") / F.col("stored")))


@query(f"""WITH {SIGNAL} SELECT CAST(channel AS VARCHAR) AS recording_id, frame, round((code % 65536 - 32768) / 32768.0::DOUBLE, 9) AS total FROM signal""")
def stem_sums(spark, sf):
    """[A10 D12 U1] The stems, correction among them, summed by frame: the recording."""
    stems = pursuit.part(_taken_apart(spark, sf), "stem")
    tall = stems.select("recording_id", "name", F.posexplode("samples").alias("frame", "x"))
    return tall.groupBy("recording_id", F.col("frame").cast("long").alias("frame")).agg(F.round(F.sum("x"), 9).alias("total"))


#: A repetitive recording: hits of three lengths and four loudnesses on a beat, which a bank of few waveforms covers.
LOOP = dict(rate=2000, beat=500, beats=24)


@query("""WITH b AS (SELECT unnest(range(0, 24)) AS b), f AS (SELECT b, unnest(range(0, 500)) AS i FROM b)
SELECT 'loop' AS recording_id, CAST(b * 500 + i AS BIGINT) AS frame, round(CASE WHEN i >= 240 THEN 0 ELSE (1 + b % 4) * CAST(240 - i AS DOUBLE) * CASE WHEN i // 4 % 2 = 0 THEN 16 ELSE -16 END / 32768.0::DOUBLE END, 9) AS x FROM f""")
def loop_from_bank(spark, sf):
    """[D18 A9 D22 J3 J4 J5] A repetitive recording, rendered from bank and placements alone plus residual; `loop_bank` shows that few samples do it."""
    sources = _loop(spark)
    whole = pursuit.reconstruct(pursuit.decompose(sources, LOOP_OPTIONS), sources.select("recording_id", "format", "channel", "frames"))
    return whole.select("recording_id", F.posexplode("samples").alias("frame", "x")).select("recording_id", F.col("frame").cast("long").alias("frame"), F.round("x", 9).alias("x"))


@query("SELECT 'loop' AS recording_id, true AS reused, true AS covers_most, true AS residual_small")
def loop_bank(spark, sf):
    """[A5 A6 A7 D18] The loop's bank holds at most a quarter of what its placements cover, and little is left over."""
    p = pursuit.decompose(_loop(spark), LOOP_OPTIONS)
    sizes = p.where("part = 'bank'").select("recording_id", F.col("ord").alias("sample_id"), F.size("samples").alias("n"))
    placed = p.where("part = 'placement'").select("recording_id", F.col("length").alias("sample_id"))
    stored = sizes.groupBy("recording_id").agg(F.sum("n").alias("stored"))
    covered = placed.join(sizes, ["recording_id", "sample_id"]).groupBy("recording_id").agg(F.sum("n").alias("covered"))
    left = p.where("part = 'residual'").select("recording_id", F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x * x).alias("left"))
    whole = _loop(spark).select("recording_id", "frames", F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x * x).alias("energy"))
    one = stored.join(covered, "recording_id").join(left, "recording_id").join(whole, "recording_id")
    return one.select("recording_id", (F.col("covered") >= 4 * F.col("stored")).alias("reused"), (F.col("covered") * 2 >= F.col("frames")).alias("covers_most"), (F.col("left") <= F.col("energy") * 0.05).alias("residual_small"))


def _loop(spark):
    rate, beat, beats = LOOP["rate"], LOOP["beat"], LOOP["beats"]
    frames = F.sequence(F.lit(0).cast("long"), F.lit(beat * beats - 1).cast("long"))
    i, b = lambda f: f % beat, lambda f: F.floor(f / beat)
    hit = lambda f: F.when(i(f) >= 240, F.lit(0.0)).otherwise((1 + b(f) % 4) * (240 - i(f)) * F.when(F.floor(i(f) / 4) % 2 == 0, 16.0).otherwise(-16.0) / 32768.0)
    return spark.range(1).select(F.lit("loop").alias("recording_id"), F.lit(rate).alias("sample_rate"), F.lit("pcm_i16").alias("format"), F.lit(0).alias("channel"), F.lit(beat * beats).cast("long").alias("frames"), F.transform(frames, hit).alias("samples"))


LOOP_OPTIONS = DecomposeOptions(events=EventOptions(stft=SMALL), stft=SMALL).without_analysis()


CASES = [(c, f) for c in ("wav", "aiff", "flac") for f in ("pcm_u8", "pcm_i16", "pcm_i24", "pcm_i32")] + [("wav", "f32"), ("wav", "f64")]
#: Low and high code of each format, and the step between codes.
GRID = {"pcm_u8": (-128, 127, 128), "pcm_i16": (-32768, 32767, 32768), "pcm_i24": (-(2**23), 2**23 - 1, 2**23), "pcm_i32": (-(2**31), 2**31 - 1, 2**31), "f32": (-(2**20), 2**20, 2**20), "f64": (-(2**20), 2**20, 2**20)}
_CASES = ", ".join(f"('{c}', '{f}', {low}, {high}, {step})" for c, f in CASES for low, high, step in [GRID[f]])


@query(f"""WITH {SIGNAL}, c(container, format, low, high, step) AS (VALUES {_CASES}),
v AS (SELECT channel, frame, container, format, step, least(greatest((code * 7919 + frame) % (2 * step) - step, low), high) AS one, least(greatest((code * 104729 + 3 * frame) % (2 * step) - step, low), high) AS two FROM signal, c)
SELECT CAST(channel AS VARCHAR) AS recording_id, container, format, 2 AS channels, count(*) AS frames, CAST(sum(one) AS BIGINT) AS left_sum, CAST(sum(two) AS BIGINT) AS right_sum,
       CAST(sum(one * (frame % 1000 + 1)) AS BIGINT) AS left_order, CAST(sum(two * (frame % 1000 + 1)) AS BIGINT) AS right_order FROM v GROUP BY ALL""")
def container_round_trip(spark, sf):
    """[S1 to S11 S3 S4] Stereo recordings in every container and format: sums of the codes that were decoded from the bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rid, codes in zip(pdf["recording_id"], pdf["codes"], strict=True):
                code, frame = np.asarray(codes, np.int64), np.arange(len(codes), dtype=np.int64)
                place = frame % 1000 + 1
                for container, kind in CASES:
                    low, high, step = GRID[kind]
                    one, two = (np.clip(x % (2 * step) - step, low, high) for x in (code * 7919 + frame, code * 104729 + 3 * frame))
                    back = codec.decode(codec.encode(Audio(RATE, kind, np.stack([one, two]) / step), container))
                    if back.format != kind or back.sample_rate != RATE:
                        raise ValueError(f"{container} gave {back.format} at {back.sample_rate} for {kind} at {RATE}")
                    got = [np.rint(x * step).astype(np.int64) for x in back.channels]
                    rows.append((rid, container, kind, len(got), back.frames, int(got[0].sum()), int(got[1].sum()), int((got[0] * place).sum()), int((got[1] * place).sum())))
            yield pd.DataFrame(rows, columns=["recording_id", "container", "format", "channels", "frames", "left_sum", "right_sum", "left_order", "right_order"])

    rows = signal(spark, sf).groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("frame", "code"))).alias("x"))
    own = rows.select(F.col("channel").cast("string").alias("recording_id"), F.transform("x", lambda s: s["code"]).alias("codes"))
    return own.mapInPandas(run, "recording_id string, container string, format string, channels int, frames long, left_sum long, right_sum long, left_order long, right_order long")


@query(f"""WITH {SIGNAL}, r AS (SELECT channel, frame, (code % 65536 - 32768) / 32768.0::DOUBLE AS x FROM signal)
SELECT CAST(channel AS VARCHAR) AS recording_id, frame, x * 32768 AS inverse, x * 32768 AS parts FROM r""")
def spectral_round_trip(spark, sf):
    """[D4 D5 D6 D7] Every frame as the inverse transform gives it, and as harmonic and percussive parts sum to it, in codes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rid, x in zip(pdf["recording_id"], pdf["samples"], strict=True):
                s = dsp.stft(np.asarray(x, float), RATE, SMALL)
                h, q = dsp.hpss(s)
                yield pd.DataFrame({"recording_id": rid, "frame": np.arange(len(x)), "inverse": dsp.istft(s), "parts": dsp.istft(h) + dsp.istft(q)})

    out = _recordings(spark, sf).mapInPandas(run, "recording_id string, frame long, inverse double, parts double")
    return out.select("recording_id", "frame", F.round(F.col("inverse") * 32768, 4).alias("inverse"), F.round(F.col("parts") * 32768, 4).alias("parts"))


@query(f"""WITH {SIGNAL}, w AS (SELECT channel, frame // 64 AS block, frame % 64 AS i, (code % 65536 - 32768) / 32768.0::DOUBLE AS x FROM signal),
k AS (SELECT channel, block, i, x, unnest(range(0, 33)) AS k FROM w),
c AS (SELECT channel, block, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, -sum(x * sin(2 * pi() * k * i / 64)) AS im FROM k GROUP BY channel, block, k)
SELECT CAST(channel AS VARCHAR) AS recording_id, block, k, round(sqrt(re * re + im * im), 6) AS magnitude FROM c""")
def block_spectra(spark, sf):
    """[D1 D2 P20] Magnitude spectra of blocks of 64 frames, the last one filled up with silence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rid, x in zip(pdf["recording_id"], pdf["samples"], strict=True):
                x = np.asarray(x, float)
                for block, at in enumerate(range(0, len(x), 64)):
                    m = dsp.magnitude_spectrum(np.pad(x[at : at + 64], (0, max(0, 64 - len(x[at : at + 64])))))
                    yield pd.DataFrame({"recording_id": rid, "block": block, "k": np.arange(len(m)), "magnitude": m})

    out = _recordings(spark, sf).mapInPandas(run, "recording_id string, block long, k long, magnitude double")
    return out.withColumn("magnitude", F.round("magnitude", 6))


@query(f"""WITH {SIGNAL}, w AS (SELECT channel, frame, (code % 65536 - 32768) / 32768.0::DOUBLE AS x FROM signal), p AS (SELECT channel, frame, x FROM w WHERE frame < 16),
s AS (SELECT channel, max(frame) - 15 AS last FROM w GROUP BY channel)
SELECT CAST(w.channel AS VARCHAR) AS recording_id, w.frame - p.frame AS shift, round(sum(w.x * p.x), 6) AS product
FROM w JOIN p ON w.channel = p.channel JOIN s ON s.channel = w.channel WHERE w.frame - p.frame BETWEEN 0 AND last GROUP BY w.channel, w.frame - p.frame, last HAVING last >= 0""")
def correlations(spark, sf):
    """[D3 D15] Each recording against its first 16 frames at every shift."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rid, x in zip(pdf["recording_id"], pdf["samples"], strict=True):
                x = np.asarray(x, float)
                if len(x) >= 16:
                    c = dsp.cross_correlate(x, x[:16])
                    yield pd.DataFrame({"recording_id": rid, "shift": np.arange(len(c)), "product": c})

    out = _recordings(spark, sf).mapInPandas(run, "recording_id string, shift long, product double")
    return out.withColumn("product", F.round("product", 6))


@query()
def onsets_and_pitch(spark, sf):
    """[D8 D9 D10 D11 D14 W6] Onsets, pitch and tempo of every recording."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rid, x in zip(pdf["recording_id"], pdf["samples"], strict=True):
                x = np.asarray(x, float)
                s = dsp.stft(x, RATE, SMALL)
                found, pitch, tempo = dsp.onsets(s), dsp.yin(x, RATE), dsp.tempo(s)
                rows.append((rid, len(found), len(dsp.tracked(s)), pitch[0] if pitch else None, tempo.bpm if tempo else None))
            yield pd.DataFrame(rows, columns=["recording_id", "onsets", "notes", "frequency", "bpm"])

    return _recordings(spark, sf).mapInPandas(run, "recording_id string, onsets long, notes long, frequency double, bpm double")
