"""Queries cover the whole input, and operators keep whole results."""

import math

import pytest
from pyspark.sql import functions as F

from sonorum import catalog

FOLDER = "/root/testdata/sf0.001"

def test_every_user_is_verified(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    assert catalog.queries()["residual_of_render"](spark, FOLDER).count() == events.count()
    assert catalog.queries()["render_and_verify"](spark, FOLDER).count() == events.select("user_id").distinct().count()


def test_length_candidates_by_brute_force(spark):
    from sonorum.operators.relational import length_candidates

    events = [(i, i % 3, float(1 + i * 7 % 20)) for i in range(40)] + [(7, 1, 10.0)]  # the last row repeats an event
    bank = [(j, j % 3, 1 + j * 5 % 23) for j in range(120)]
    got = length_candidates(spark.createDataFrame(events, "id long, k long, len double"), spark.createDataFrame(bank, "sample_id long, k long, size int"), ["id", "k", "len"], "k", "len", "size", 3)
    expected = []
    for key in sorted(set(events)):
        found = [(abs(math.log2(size / key[2])), -j) for j, k, size in bank if k == key[1] and abs(math.log2(size / key[2])) <= 1]
        expected += [(key[0], -j, place) for place, (_, j) in enumerate(sorted(found * events.count(key))[:3], 1)]
    assert sorted((r.id, r.sample_id, r.place) for r in got.collect()) == sorted(expected)


def test_dense_numbers_by_group(spark):
    from sonorum.operators.relational import dense_number

    rows = [(None if i % 5 == 4 else i % 5, i * 7 % 311) for i in range(1000)]
    got = dense_number(spark.createDataFrame(rows, "g long, k long"), ["k"], "n", by=("g",)).collect()
    for g in (None, 0, 1, 2, 3):
        own = sorted((r.n, r.k) for r in got if r.g == g)
        assert own == list(enumerate(sorted(k for h, k in rows if h == g), 1))


def test_fades_reach_the_true_ends(spark):
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    got = {(r.vec_id, r.i): (r.faded, r.tail) for r in catalog.queries()["fades"](spark, FOLDER).collect()}
    assert len(got) == sum(map(len, vectors.values()))
    for v, a in vectors.items():
        n = len(a)
        assert n > 10
        edge = [min(i, n - 1 - i) for i in range(n)]
        assert [got[v, i][0] for i in range(n)] == pytest.approx([x * (edge[i] + 1) / 4 if edge[i] < 3 else x for i, x in enumerate(a)], abs=1e-8)
        assert [got[v, i][1] for i in range(n)] == pytest.approx([x * (n - 1 - i) / 4 if i >= n - 4 else x for i, x in enumerate(a)], abs=1e-8)


def test_voices_beyond_any_count(spark):
    from sonorum.operators.relational import nearest_voice

    voices = spark.range(300).select((F.col("id") * 3).alias("voice"))
    notes = spark.createDataFrame([(290,), (877,), (1,), (None,), (2000,)], "note int")
    assert {r.note: r.voice for r in nearest_voice(notes, voices).collect()} == {290: 291, 877: 876, 1: 0, 2000: 897}
    assert nearest_voice(notes, voices.limit(0)).count() == 0


def test_sequences_longer_than_the_levels(spark):
    from sonorum.operators import links

    rows = {1: [1, 2, 3, 1, 2, 3, 4], 2: [1, 2, 3, 1, 2, 3, 5], 3: [1, 2, 3], 4: [9]}
    items = spark.createDataFrame([(k, o, v) for k, vs in rows.items() for o, v in enumerate(vs)], "k long, o long, v long")
    made, last = links.sequences(spark, items, "k", "o", "v", first=100, levels=3)
    pair = {(r.source, r.target): r.idx for r in made.collect()}
    assert sorted(pair.values()) == list(range(100, 107))

    def fold(values):
        idx = values[0]
        for v in values[1:]:
            idx = pair[idx, v]
        return idx

    assert {r.k: r.idx for r in last.collect()} == {k: fold(vs) for k, vs in rows.items()}


def test_lifo_pairs(spark):
    import random

    from sonorum.operators.relational import pair_lifo

    random.seed(4)
    rows = [(k, i, random.random() < 0.5) for k in range(30) for i in range(random.randint(0, 30))]
    expected = []
    for k in range(30):
        held = []
        for _, i, on in sorted(r for r in rows if r[0] == k):
            if on:
                held.append(i)
            elif held:
                expected.append((k, held.pop(), i))
    got = pair_lifo(spark.createDataFrame(rows, "k int, t int, on boolean"), ["k"], ["t"], "on").collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)
