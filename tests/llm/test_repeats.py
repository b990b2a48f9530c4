"""Corpus operators on rows that repeat."""

import numpy as np
import pytest

from sonorum.llm import bitslice_topk, line_dedup, suffix_dedup, toxicity


def test_topk_of_repeated_query_ids(spark):
    """As in the SQL, every row of a repeated query id asks, and its ranks are those of all their answers."""
    rng = np.random.default_rng(4)
    top = rng.standard_normal(12)
    rows = [(100, (3 * top + rng.standard_normal(12) / 9).tolist()) for _ in range(30)] + [(i * 7 + 1, rng.standard_normal(12).tolist()) for i in range(60)]
    got = bitslice_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 100").collect()
    own = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows]
    best = sorted(((i, int(x @ y)) for q, x in own if q == 100 for i, y in own if i != 100), key=lambda p: (-p[1], p[0]))[:10]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == best


def test_later_batches_are_anti_joined(spark, monkeypatch):
    added, add = [], line_dedup.LineRuns.add

    def seen(self, batch):
        added.append({(r.h1, r.h2): r.docs for r in batch.collect()})
        add(self, batch)

    monkeypatch.setattr(line_dedup.LineRuns, "add", seen)
    docs = spark.createDataFrame([(i, f"common\nown {i}\npair {i // 2}") for i in range(60)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(docs, min_docs=5).collect()}
    assert got == {i: f"own {i}\npair {i // 2}" for i in range(60)}
    common = tuple(line_dedup.as_longs([line_dedup.key_hash(b"common")])[0])
    assert [common in a for a in added] == [True, False, False, False]  # the first batch holds it in more than 5 documents


@pytest.mark.parametrize("times", [1, 100])
def test_density_does_not_depend_on_length(times):
    x = toxicity.Reader({"vile": 2.0, "nasty": 3.0})(" ".join((["vile"] * 5 + ["nasty"] + ["good"] * 194) * times))
    assert x[5] == pytest.approx((5 * 2.0 + 3.0) / 200)
    assert x[6] == 3.0 and x[7] == (7.0 if times == 1 else 9.0)


def test_longest_previous_factors():
    rng = np.random.default_rng(0)
    for t in range(60):
        n = int(rng.integers(1, 40))
        suffixes = rng.integers(0, 2 + t % 2, (n, 6)).astype(np.uint8) + t % 3
        position = rng.integers(0, 10, n), rng.integers(0, 3, n)
        places = list(zip(*(x.tolist() for x in position), strict=True))
        wanted = [max((int(np.argmin(np.append(a == b, False))) for b, q in zip(suffixes, places, strict=True) if q < p), default=0) for a, p in zip(suffixes, places, strict=True)]
        assert suffix_dedup.longest_previous(np.ascontiguousarray(suffixes), position).tolist() == wanted
