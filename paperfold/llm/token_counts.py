"""Exact histogram of encoded lengths, and what its suffix sums tell for every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperfold.llm.common import map_texts, table
from paperfold.llm.tokens import default_path, encoder

_BAND = 1024


def lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row; a null text has none.  Repeated rows count as often as they come."""
    path = tokenizer or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.concatenate([np.diff(at) for _, _, _, at in encoder(path).columns(batch.column(1))])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64))], ["doc_id", "n_tokens"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id bigint, n_tokens bigint", encodes=True)


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) of a table with n_tokens."""
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def counted(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The histogram of ``docs``, written once: it has a row for each length, and texts are encoded a single time."""
    return table(histogram(lengths(docs, tokenizer)), "lengths")


def for_every_limit(hist: DataFrame) -> DataFrame:
    """One row for each length that occurs, taken as a context limit.

    docs_at_least and tokens_at_least are suffix sums; docs_at_most and quantile (its share of all documents) rank the
    length; kept_tokens is what remains of all tokens if every document is cut at the limit, cut_tokens what goes.
    Between two lengths a and b, kept tokens grow by the documents longer than a for each unit of the limit, so these
    rows answer every limit.  Sums run within bands of 1024 lengths and over the totals of the bands, so no task gets
    all lengths.  An empty table gives no rows.
    """
    hist = hist.withColumn("_band", F.floor(F.col("n_tokens") / _BAND)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    bands = hist.groupBy("_band").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    above = Window.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("long")
    bands = bands.select(
        "_band", F.coalesce(F.sum("_d").over(above), none).alias("_d_above"), F.coalesce(F.sum("_t").over(above), none).alias("_t_above"),
        F.sum("_d").over(everything).alias("total_docs"), F.sum("_t").over(everything).alias("total_tokens"),
    )
    within = Window.partitionBy("_band").orderBy(F.desc("n_tokens"))
    out = hist.withColumn("_d", F.sum("n_docs").over(within)).withColumn("_t", F.sum("_tokens").over(within)).join(bands, "_band")
    docs, tokens = F.col("_d") + F.col("_d_above"), F.col("_t") + F.col("_t_above")
    longer = tokens - F.col("_tokens") - F.col("n_tokens") * (docs - F.col("n_docs"))
    most = F.col("total_docs") - docs + F.col("n_docs")
    return out.select(
        "n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), most.alias("docs_at_most"),
        (most / F.col("total_docs")).alias("quantile"), (F.col("total_tokens") - longer).alias("kept_tokens"),
        longer.alias("cut_tokens"), "total_docs", "total_tokens",
    )


def at_limit(answers: DataFrame, limit: int) -> DataFrame:
    """One row (limit, docs_longer, kept_tokens) read off the answers for any limit."""
    longer = F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0))
    kept = F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0))
    return answers.agg(longer.alias("docs_longer"), kept.alias("kept_tokens")).select(F.lit(limit).alias("limit"), "docs_longer", "kept_tokens")
