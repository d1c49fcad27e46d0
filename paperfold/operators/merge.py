"""Merging partial results of chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperfold.functions.text import normal_key
from paperfold.plans.pick import pick_first
from paperfold.plans.segments import ranged_numbers


def best_confidence(results: DataFrame, keys: Sequence[str] = ("doc_id", "field_key")) -> DataFrame:
    """Per key: non-null beats null, then the higher confidence, then the lower chunk."""
    missing = F.col("value").isNull()
    order = [missing, F.when(~missing, -F.col("confidence")), F.col("chunk_index")]
    return pick_first(results, keys, order, ["value", "confidence", "chunk_index"])


def first_non_null(results: DataFrame, keys: Sequence[str] = ("doc_id", "field_key")) -> DataFrame:
    """Per key: the first non-null value in chunk order, else the first chunk's null."""
    order = [F.col("value").isNull(), F.col("chunk_index")]
    return pick_first(results, keys, order, ["value", "chunk_index"])


def canonical_keys(df: DataFrame, key: str, model_keys: DataFrame, model_key: str = "field_key") -> DataFrame:
    """Replace spellings of a key by the model's key; unknown keys stay as they are."""
    known = model_keys.select(normal_key(F.col(model_key)).alias("__norm"), F.col(model_key).alias("__canon"))
    known = known.groupBy("__norm").agg(F.min("__canon").alias("__canon"))
    out = df.withColumn("__norm", normal_key(F.col(key))).join(known, "__norm", "left")
    return out.withColumn(key, F.coalesce("__canon", key)).drop("__norm", "__canon")


def append_rows(rows: DataFrame, doc: str, chunk: str, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Rows of all chunks as one table per document, numbered in chunk order.

    The list stays a table of rows; nothing collects a document into one value.
    """
    return ranged_numbers(rows, [doc], [chunk, *order], name)


def dedup_rows(rows: DataFrame, keys: Sequence[str], content: Sequence[str],
               order: Sequence[str]) -> DataFrame:
    """One row per equal content; the first occurrence tells the source chunk and position."""
    return pick_first(rows, [*keys, *content], [F.col(c) for c in order], list(order))


def duplicate_flag(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "is_duplicate") -> DataFrame:
    """True on the second and later rows of each key in row order; the first is clean.

    The first place of each key is a minimum with map-side combine; only rows that tie for it are counted.
    """
    place = F.struct(*order)
    firsts = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(place).alias("__first"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    tie = F.row_number().over(Window.partitionBy(*keys, *order).orderBy(*order))
    return rows.join(firsts, same).withColumn(name, (place > F.col("__first")) | (tie > 1)).select(*rows.columns, name)


def chunk_accounting(results: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunks, successes and success ratio per document."""
    ok = F.count_if(F.col("success"))
    return results.groupBy(doc).agg(
        F.count(F.lit(1)).alias("total_chunks"), ok.alias("successful_chunks"),
        (F.floor(ok * 1000 / F.count(F.lit(1)) + 0.5) / 1000).alias("success_ratio"),
    )


def chunk_errors(results: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, chunk_index, error) of the chunks that failed; an error without a message says so.  Rows, so there may be any number."""
    return results.where(~F.col("success")).select(doc, "chunk_index", F.coalesce("error", F.lit("Unknown Error")).alias("error"))


def field_sources(results: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, field_key, chunk_index) of the chunk that each merged value comes from; fields without a value have none."""
    merged = best_confidence(results.where("success"), (doc, "field_key"))
    return merged.where(F.col("value").isNotNull()).select(doc, "field_key", "chunk_index")
