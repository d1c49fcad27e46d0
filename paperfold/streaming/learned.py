"""Learned synonyms as a table of logged batches: a batch that runs twice counts once.

Below a base folder, ``hits/batch=<id>`` holds what a micro-batch adds, ``decisions/batch=<id>`` what people decided, and
``snapshot/batch=<id>`` the table as of a batch.  Each is a folder named by its batch and replaced whole, so writing it
again changes nothing; a reader takes the newest complete snapshot and what has been logged after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEARNED = "AI_GENERATED"  # fixed value: source of what was not entered by people
KEY = ["field_name", "raw_val"]
_HITS = "field_name string, raw_val string, value string, hits bigint"
_DECISIONS = "field_name string, raw_val string, value string, is_verified boolean"
_SNAPSHOT = "field_name string, raw_val string, learned string, value string, is_verified boolean, hit_count bigint"


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Complete batches of a log, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    found = [s.getPath() for s in store.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName().removeprefix("batch=")) for p in found if store.exists(path(p, "_SUCCESS")))


def _log(spark: SparkSession, folder: str, schema: str, after: int) -> DataFrame:
    paths = [f"{folder}/batch={b}" for b in _batches(spark, folder) if b > after]
    full = f"{schema}, batch bigint"
    return spark.read.schema(full).option("basePath", folder).parquet(*paths) if paths else spark.createDataFrame([], full)


def learn(base: str, batch: DataFrame, batch_id: int) -> None:
    """Log what a micro-batch of (field_name, raw_val, value, ts) adds: hits, and the value of the first by time."""
    first = F.min_by("value", F.struct("ts", "value"))
    hits = batch.where("raw_val is not null").groupBy(*KEY).agg(first.alias("value"), F.count(F.lit(1)).alias("hits"))
    hits.write.mode("overwrite").parquet(f"{base}/hits/batch={batch_id}")


def decide(base: str, decisions: DataFrame, decision_id: int) -> None:
    """Log decisions (field_name, raw_val, value, is_verified); of several on one synonym the latest batch holds."""
    decisions.select(*KEY, "value", "is_verified").write.mode("overwrite").parquet(f"{base}/decisions/batch={decision_id}")


def _state(spark: SparkSession, base: str) -> tuple[DataFrame, int, int]:
    """The table with what is needed to go on, and the last batches of both logs in it."""
    known = _batches(spark, f"{base}/snapshot")
    old = spark.read.schema(_SNAPSHOT).parquet(f"{base}/snapshot/batch={known[-1]}") if known else spark.createDataFrame([], _SNAPSHOT)
    hits_done, decided = divmod(known[-1], 1 << 32) if known else (0, 0)  # both counts stand in a snapshot's name
    hits = _log(spark, f"{base}/hits", _HITS, hits_done - 1).select(
        *KEY, F.col("value").alias("learned"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("boolean").alias("is_verified"), "hits",
        F.col("batch").alias("at"), F.lit(None).cast("bigint").alias("decided"))
    said = _log(spark, f"{base}/decisions", _DECISIONS, decided - 1).select(
        *KEY, F.lit(None).cast("string").alias("learned"), "value", "is_verified", F.lit(0).cast("bigint").alias("hits"),
        F.lit(None).cast("bigint").alias("at"), F.col("batch").alias("decided"))
    old = old.select(*KEY, "learned", "value", "is_verified", F.col("hit_count").alias("hits"), F.lit(-1).cast("bigint").alias("at"),
                     F.when(F.col("is_verified").isNotNull(), F.lit(-1)).cast("bigint").alias("decided"))
    out = old.unionByName(hits).unionByName(said).groupBy(*KEY).agg(
        F.min_by("learned", F.when(F.col("learned").isNotNull(), F.struct("at", "learned"))).alias("learned"),
        F.max_by(F.struct("value", "is_verified"), F.when(F.col("decided").isNotNull(), F.struct("decided", "value"))).alias("d"),
        F.sum("hits").alias("hit_count"))
    out = out.select(*KEY, "learned", "d.value", "d.is_verified", "hit_count")
    last = [(_batches(spark, f"{base}/{log}") or [seen - 1])[-1] + 1 for log, seen in (("hits", hits_done), ("decisions", decided))]
    return out, *last


def read(spark: SparkSession, base: str) -> DataFrame:
    """(field_name, raw_val, value, source, is_verified, hit_count): a person's value before a learned one."""
    out, _, _ = _state(spark, base)
    return out.select(*KEY, F.coalesce("value", "learned").alias("value"), F.when(F.col("is_verified").isNull(), LEARNED).otherwise("MANUAL").alias("source"),
                      F.coalesce("is_verified", F.lit(False)).alias("is_verified"), "hit_count")


def compact(spark: SparkSession, base: str) -> None:
    """Write the table as of now; what it covers is not read again.  Its batches must be committed by their stream."""
    out, hits, decided = _state(spark, base)
    out.write.mode("overwrite").parquet(f"{base}/snapshot/batch={(hits << 32) + decided}")
