"""A training corpus from raw documents: five stages, each one operator, each over all that the one before it kept.

Every stage but the last returns the columns of documents; where a text changes,
n_chars is counted anew.  In every stage a null text counts as empty, rows
without an id take part, columns beside doc_id and text are carried on whatever
their names, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorum.llm import line_dedup, ngram_join, packing, suffix_dedup, toxicity
from sonorum.llm.common import documents, dropped, scratch, unused, written

#: The pipeline's rows can't be had from SQL (trained scores, tokens, packing).
ORACLE_SQL = None


def recounted(docs: DataFrame) -> DataFrame:
    kinds = dict(docs.dtypes)
    return docs.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learns from the labelled rows that are not held out.

    Rows are judged one by one, repeated ones alike; empty texts stay; without
    labelled rows nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    return toxicity.score(docs, toxicity.train(documents(docs), labels), keep_columns=True)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them hold.

    Every row is a document, repeated rows too; an empty text stays one empty line.
    """
    return recounted(line_dedup.drop_lines(docs, keep_columns=True))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies.

    Rows equal in doc_id and text are one document; rows without an id stay
    unless all of them lie in groups with an id.
    """
    groups = ngram_join.jaccard_components(docs)
    (kept_id,) = unused(docs, "_kept_id")
    kept = groups.where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)), "left_semi").dropDuplicates(["doc_id", "text"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 100 bytes or more that occur earlier.

    Rows equal in doc_id and text are one document; a character that is cut
    apart goes as a whole; what is left may be empty.
    """
    return recounted(suffix_dedup.remove_repeats(docs, keep_columns=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; an empty text is one end id."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
        dropped(spark, *before)
        before = [f"{folder}/{name}"]
    return STAGES[-1][1](spark, docs, sf_dir)
