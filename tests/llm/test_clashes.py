"""Extra columns whose names the operators use themselves, null and repeated ids, empty tables and long texts."""

import brute
import pytest
from pyspark.sql import functions as F

from sonorum.llm import bitslice_topk, line_dedup, suffix_dedup

NAMES = ["_gone", "_doc_id", "_mark", "_cuts", "_d_id", "_d_mark", "mark", "start", "cuts", "kept_id", "batch", "n", "H1", "set_id"]


@pytest.fixture(scope="module")
def docs(spark):
    shared = "a line that all of them hold and that goes"
    rows = [(i, f"{shared}\nown text of number {i} " + "tail that repeats " * 12, len(shared)) for i in range(30)]
    rows += [(3, rows[3][1], 1), (None, None, 0), (None, shared, 0), (40, "", 0), (41, "long words " * 20_000, 0), (42, "x" * 120_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    return df.select("*", *(F.lit(c).alias(c) for c in NAMES)).repartition(3)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_lines_keep_clashing_columns(docs, limit):
    got = line_dedup.drop_lines(docs, min_docs=5, broadcast_keys=limit, keep_columns=True)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(((d, t) for d, _, _, t in brute.lines(rows, 5)), key=str)
    assert got.where(" or ".join(f"{c} <> '{c}'" for c in NAMES)).count() == 0


def test_repeats_keep_clashing_columns(docs):
    got = suffix_dedup.remove_repeats(docs, keep_columns=True)
    assert got.columns == docs.columns and got.count() == docs.count()
    plain = {(r.doc_id, r.n_bytes - r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert {(r.doc_id, len(r.text.encode())) for r in got.collect()} == plain


def test_pipeline_stages_keep_clashing_columns(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, 0, int(i % 7 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.limit(0)):
        now = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path)).cache()
            assert now.columns == docs.columns
        if rows is docs:
            assert now.where("doc_id is null").count() and now.where("doc_id = 41").count() == 1
            assert now.groupBy("doc_id", "text").count().where("count > 1").count() == 0
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def test_scores_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(0, [4e4] * 4)], "vec_id long, embedding array<double>")
    assert bitslice_topk.top_k(df.union(df)).count() == 0
    big = spark.createDataFrame([(0, [4e9] * 4), (1, [4e9] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceed 64 bits"):
        bitslice_topk.top_k(big).collect()
