"""Top-k search, WARC, the pipeline and the registered SQL."""

import base64
import gzip
import hashlib

import numpy as np
import pytest
from oracle import connect, same

from sonorum.llm import bitslice_topk, queries, warc
from sonorum.llm.sharedfs import read

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    same(queries.queries()[name](spark, FOLDER).toPandas(), connect(FOLDER).execute(queries.oracle_sql()[name]).df())


def test_topk(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.standard_normal(12).tolist() for _ in range(300)]
    rows = [(i * 7, v) for i, v in enumerate(vectors)] + [(100, vectors[3]), (200, vectors[3]), (None, vectors[0]), (300, None), (400, [1.0, None]), (500, [float("nan")]), (600, [float("inf")]), (800, []), (1100, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = [(i, np.floor(1024 * np.pad(v, (0, 12 - len(v)))).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for kw in ({}, {"block": 40, "queries": 2}):
        got = {}
        for r in bitslice_topk.top_k(df, **kw).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        for q, x in own:
            if q % 100 == 0 and [i for i, _ in own].count(q) == 1:
                best = sorted(((i, int(x @ y)) for i, y in own if i != q), key=lambda p: (-p[1], p[0]))[:10]
                assert [got[q][k] for k in range(1, 11)] == best
    assert bitslice_topk.top_k(df.limit(0)).count() == 0


def test_index_selects_from_the_top_slice():
    rng = np.random.default_rng(2)
    values = rng.integers(-900, 900, (500, 9))
    index = bitslice_topk.Index(np.arange(500), values)
    for _ in range(20):
        q = rng.integers(-900, 900, 9)
        weights = np.round(q / 32).astype(np.int64)
        total = index.coarse_sums(weights)
        sums = sum((total[b, :, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).ravel()[:500].astype(object) * (1 << b) for b in range(len(total)))
        assert [int(s) for s in sums + index.offset(weights)] == ((values >> index.shift) @ weights).tolist()
        ids, scores = index.top(-1, q, 7)
        wanted = sorted(range(500), key=lambda i: (-int(values[i] @ q), i))[:7]
        assert ids.tolist() == wanted and scores.tolist() == [int(values[i] @ q) for i in wanted]


@pytest.fixture()
def pages(spark):
    rows = [(1, "http://a/ b\r\n", "same"), (2, None, "same"), (3, "u", None), (4, "", ""), (None, "n", "alone"), (None, "n", "same"), (5, "u", "é" * 5000), (5, "u", "é" * 5000), (6, "u", "other")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


def test_warc(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write(pages, folder, roll=200)
    assert manifest.agg({"records": "sum"}).first()[0] == 9
    got = warc.read(manifest, folder).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
        assert len(r.payload_digest) == 32 and r.record_type in ("response", "revisit")
        assert (r.refers_to is None) == (r.record_type == "response")
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(r.block).digest()).decode() == r.payload_digest
    assert by[1][0].refers_to == 2 and by[2][0].record_type == "response" and by[3][0].refers_to == 4
    assert sorted(r.record_type for r in by[5]) == ["response", "revisit"]
    assert {r.refers_to for r in by[None]} == {None, 2}
    names = [r.file for r in manifest.collect()]
    assert len(names) > 2 and not [p for p in (tmp_path / "warc").iterdir() if ".tmp-" in p.name]
    assert gzip.decompress(read(f"{folder}/{names[0]}")).startswith(b"WARC/1.1")
    again = f"file://{tmp_path}/again"
    second = warc.write(pages, again, roll=200)
    assert {r.file: read(f"{again}/{r.file}") for r in second.collect()} == {n: read(f"{folder}/{n}") for n in names}
    assert warc.round_trip(pages, min_payload=10).where("page_id = 1").first().record_type == "response"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_damaged_records_are_refused():
    data = warc.record(1, "u", b"payload", None)
    assert warc.parsed(data)[6] == b"payload"
    with pytest.raises(ValueError):
        warc.parsed(data.replace(b"payload", b"paylaod"))


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns
        assert docs.where("n_chars <> length(text)").count() == 0
        now = docs.count()
        assert now < before if name in ("toxicity", "ngram_jaccard_join") else now == before
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == before
