"""From raw documents to packed training sequences, one operator a stage.

Every stage takes and returns rows with the columns of ``documents``, but for the last one, which returns the pieces of
the packed sequences.  Rows with a null doc_id or text pass every filter that has nothing to say about them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.llm import leaks, neardup, packing, quality, surrogates
from paperfold.llm.common import prepared, table

KEY = "corpus"  # of the surrogates


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good, by their text, site and language section, is at least one half."""
    labels = prepared(spark).read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.judged(docs, labels, host=F.col("source"), path=F.col("lang"), keep=docs.columns)
    return judged.where("good").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest doc_id."""
    prepared(spark)
    found = neardup.near_duplicates(docs, width=5, similarity=0.8)
    gone = table(found.where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    benchmark = prepared(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = table(leaks.leaks(docs, benchmark).select("doc_id").distinct(), "leaking")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced with surrogates; n_chars follows the new text."""
    prepared(spark)
    return surrogates.replaced(docs, KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 1024 tokens."""
    prepared(spark)
    return packing.pack(docs, capacity=1024)


STAGES = [
    ("quality_filter", quality_filter), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
    ("hide_personal_data", hide_personal_data), ("pack", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again."""
    prepared(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
