"""Corpus preparation: documents through five operators in a row.

Each stage takes all that the one before kept, and its decisions take effect:
toxic and poor documents go, one document of each group of near copies stays,
sources are repeated or thinned to their target weights, and what is left is
packed into sequences. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.llm.classifier import drop_poor
from quillveil.llm.common import column, free_names, grows, row_key, settle
from quillveil.llm.mixing import mix_sources, repeat_rows
from quillveil.llm.neardup import drop_near_copies
from quillveil.llm.packing import pack_documents
from quillveil.llm.queries import learnable_labels, tokenizer_path
from quillveil.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic."""
    return drop_toxic(docs, learnable_labels(spark, sf_dir, "toxic"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as poor."""
    return drop_poor(docs, learnable_labels(spark, sf_dir, "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins documents to their sources' target weights."""
    # rows are told by all their columns: equal rows are one entry and take the copies of all of them
    id_, row, copies, rows = free_names(docs, "id", "row", "copies", "rows")
    mixed = mix_sources(docs.withColumn(row, row_key(docs)), keep=(row,)).filter("copies > 0")
    mixed = settle(mixed.groupBy(F.col("doc_id").alias(id_), row).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)))
    taken = docs.join(grows(mixed), (row_key(docs) == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(id_))).drop(id_, row)
    # of equal rows some may have no copies, so those that are drawn do not tell whether there are others
    keys = docs.select(F.col("doc_id").alias(id_), row_key(docs).alias(row))
    if not keys.groupBy(id_, row).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        taken = taken.drop(rows).dropDuplicates()
    else:
        taken = taken.drop(rows)
    return repeat_rows(taken, copies).select([column(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("quality", quality), ("near duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL cannot express the learned models and the random rounding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
