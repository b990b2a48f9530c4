"""Sources, SQL functions and streams in Spark."""

import time

import numpy as np
import pytest
from fixtures import wide_stereo
from pyspark.sql import functions as F

from sonorum.formats import midi
from sonorum.functions import udfs
from sonorum.operators import links
from sonorum.operators.pursuit import Note
from sonorum.operators.relational import dense_number
from sonorum.sources import archive, audio, datasource
from sonorum.streaming import notes


@pytest.fixture()
def folder(tmp_path):
    own = wide_stereo(8000, "pcm_i16")
    for name in ("a.wav", "b.aiff", "c.flac"):
        (tmp_path / name).write_bytes(audio.encode(own, {"wav": "wav", "aiff": "aiff", "flac": "flac"}[name[2:]]))
    return tmp_path, own


def test_recordings(spark, folder):
    path, own = folder
    rows = datasource.read(spark, f"file://{path}/*").collect()
    assert len(rows) == 6 and all(r.samples == own.channels[r.channel].tolist() for r in rows)
    datasource.register(spark)
    assert spark.read.format("recordings").load(f"{path}/*").groupBy("channel").count().count() == 2
    (path / "bad.wav").write_bytes(b"junk")
    assert datasource.read(spark, f"file://{path}/*", permissive=True).where("_error is not null").count() == 1
    back = datasource.encode(datasource.read(spark, f"file://{path}/a.wav"), "flac").first()
    assert np.array_equal(audio.decode(bytes(back.content)).channels, own.channels)
    assert datasource.durations(datasource.read(spark, f"file://{path}/a.wav")).first().seconds == 4.0


def test_sql_functions(spark):
    udfs.register(spark)
    spark.createDataFrame([([0.0, 1.0, 0.5],), ([-0.0, 1.0, 0.5],), ([1.0],)], "x array<double>").createOrReplaceTempView("w")
    prints = [r[0] for r in spark.sql("SELECT waveform_fingerprint(x) FROM w").collect()]
    assert len(set(prints)) == 2
    assert spark.sql("SELECT links_encode('a b')").first()[0] == "a%20b"
    assert [tuple(r) for r in spark.sql("SELECT * FROM links_rows('(a: b (c d))')").collect()] == [(0, "a", "b"), (1, "a", "(c d)")]
    t = np.arange(4096) / 44100
    spark.createDataFrame([(np.sin(2 * np.pi * 440 * t).tolist(), 44100), ([0.0] * 64, 44100)], "x array<double>, r int").createOrReplaceTempView("tones")
    found = [r[0] for r in spark.sql("SELECT estimate_pitch(x, r) FROM tones").collect()]
    assert abs(found[0]["frequency"] - 440) < 1 and found[1]["frequency"] is None or np.isnan(found[1]["frequency"])
    r = spark.sql("SELECT align(array(0D, 0D, 0D, 0.5D, -0.25D, 0D), 2L, array(1D, -0.5D), 2) AS a").first().a
    assert (r.start, r.gain_num) == (3, 32768)
    data = midi.encode(midi.from_notes([Note(0, 10, 20, 60, 99, 0.0, 1.0)], 8000, "n"))
    spark.createDataFrame([(bytearray(data),)], "b binary").createOrReplaceTempView("m")
    assert [tuple(r) for r in spark.sql("SELECT n.* FROM m, LATERAL midi_notes(b, 8000) n").collect()] == [(0, 10, 20, 60, 99)]


def test_dense_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("k"))
    got = dense_number(df, ["k"], "n", 5).orderBy("k").collect()
    assert [r.n for r in got] == list(range(5, 1005))
    assert dense_number(df.limit(0), ["k"]).count() == 0


def test_sequences_share_prefixes(spark):
    items = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 1), (2, 1, 2), (3, 0, 9)], "k long, o long, v long")
    made, last = links.sequences(spark, items, "k", "o", "v", first=100)
    assert made.count() == 2
    ends = {r.k: r.idx for r in last.collect()}
    pair = {(r.source, r.target): r.idx for r in made.collect()}
    assert ends == {1: pair[pair[1, 2], 3], 2: pair[1, 2], 3: 9}


def test_archive_checks(spark):
    bank = spark.createDataFrame([("r", 0)], "recording_id string, sample_id long")
    placed = spark.createDataFrame([("r", 0), ("r", 5)], "recording_id string, sample_id long")
    signals = spark.createDataFrame([("r", [1.0]), ("r", [1.0, 2.0])], "recording_id string, samples array<double>")
    assert {(r.what, r.n) for r in archive.check_tables(placed, bank, signals).collect()} == {("dangling placements", 1), ("uneven recordings", 1)}


def test_streams(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(2).write.parquet(f"{tmp_path}/events")
    for make, name in ((notes.envelope, "env"), (notes.sessions, "ses")):
        stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/events").withColumn("ts", F.col("ts").cast("timestamp"))
        q = make(stream, late="365 days").writeStream.outputMode("complete" if name == "env" else "append").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(120)
        if name == "env":
            assert spark.table("env").agg(F.sum("n")).first()[0] >= source.count()
    frames = spark.createDataFrame([(0, 60, f) for f in (1, 2, 3, 7, 8, 12)], "channel int, note int, frame long")
    frames.coalesce(1).write.parquet(f"{tmp_path}/frames")
    q = notes.note_islands(spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/frames")).writeStream.outputMode("append").format("memory").queryName("isl").trigger(processingTime="1 second").option("checkpointLocation", f"{tmp_path}/isl").start()
    try:
        for _ in range(60):  # the last run comes when its key has been silent
            if spark.table("isl").count() >= 3:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert sorted((r.start_frame, r.frames) for r in spark.table("isl").collect()) == [(1, 3), (7, 2), (12, 1)]
