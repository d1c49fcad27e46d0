"""Sinks: upsert, offload of large fields, outbox."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.plans.pick import pick_last


def upsert(existing: DataFrame, updates: DataFrame, key: str, order: str,
           keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """Last write wins; the ``keep`` columns stay as first stored.

    Several updates of one key are reduced on the map side before the join.
    """
    fields = [c for c in existing.columns if c != key]
    latest = pick_last(updates, [key], [order], fields)
    new = latest.select(F.col(key).alias("__k"), *[F.col(f).alias(f"__n_{f}") for f in fields])
    joined = existing.join(new, F.col(key) == F.col("__k"), "full")
    seen_old, seen_new = F.col(key).isNotNull(), F.col("__k").isNotNull()

    def value(f: str) -> Column:
        old, fresh = F.col(f), F.col(f"__n_{f}")
        if f in keep:
            return F.when(seen_old, old).otherwise(fresh).alias(f)
        return F.when(seen_new, fresh).otherwise(old).alias(f)

    return joined.select(F.coalesce(key, "__k").alias(key), *[value(f) for f in fields])


def versions(spark: SparkSession, base: str) -> list[int]:
    """Complete versions of a versioned table, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    found = [s.getPath() for s in store.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("version=")]
    done = [p for p in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in done)


def read_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """A version of a versioned table, the newest unless one is named."""
    return spark.read.parquet(f"{base}/version={versions(spark, base)[-1] if version is None else version}")


def upsert_into(base: str, updates: DataFrame, key: str, order: str, keep: Sequence[str] = ("created_at", "ttl")) -> int:
    """Upsert as a sink: the next version of the table below ``base`` is written whole; readers see it once complete.

    ``keep`` columns stay as first stored (those that the table has).  A run that dies leaves an incomplete version, which
    the next run replaces.  Returns the version.
    """
    spark = updates.sparkSession
    known = versions(spark, base)
    version = (known or [0])[-1] + 1
    old = read_version(spark, base) if known else updates.drop(order).limit(0)
    upsert(old, updates, key, order, [c for c in keep if c in old.columns]).write.mode("overwrite").parquet(f"{base}/version={version}")
    return version


def offload(df: DataFrame, key: str, fields: Sequence[str], limit: int) -> DataFrame:
    """Move fields out of records over ``limit`` characters, in order, until they fit.

    Adds ``<field>_out`` flags; :func:`main_table` and :func:`payload_table`
    split the result.
    """
    size = lambda f: F.coalesce(F.length(f), F.lit(0))
    left = reduce(lambda a, b: a + b, [size(f) for f in fields])
    out = df.withColumn("__left", left)
    for f in fields:
        goes = (F.col("__left") > limit) & F.col(f).isNotNull()
        out = out.withColumn(f"{f}_out", goes)
        out = out.withColumn("__left", F.when(F.col(f"{f}_out"), F.col("__left") - size(f)).otherwise(F.col("__left")))
    return out.drop("__left")


def main_table(marked: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Records with pointers in place of the moved fields."""
    cols = []
    for f in fields:
        moved = F.col(f"{f}_out")
        cols.append(F.when(~moved, F.col(f)).alias(f))
        cols.append(F.when(moved, F.concat_ws("/", F.col(key).cast("string"), F.lit(f))).alias(f"{f}_ref"))
    rest = [c for c in marked.columns if c not in fields and not c.endswith("_out")]
    return marked.select(*rest, *cols)


def payload_table(marked: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(ref, payload): one row per moved field."""
    parts = F.array(*[
        F.struct(F.col(f"{f}_out").alias("out"),
                 F.concat_ws("/", F.col(key).cast("string"), F.lit(f)).alias("ref"), F.col(f).alias("payload"))
        for f in fields])
    return marked.select(F.explode(parts).alias("p")).where("p.out").select("p.ref", "p.payload")


def hydrate(main: DataFrame, payloads: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Put moved fields back in place of their pointers."""
    out = main
    for f in fields:
        side = payloads.select(F.col("ref").alias(f"{f}_ref"), F.col("payload").alias("__p"))
        out = out.join(side, f"{f}_ref", "left").withColumn(f, F.coalesce("__p", f)).drop("__p", f"{f}_ref")
    return out


def outbox(df: DataFrame, event: str, fields: Sequence[str]) -> DataFrame:
    """One message per confirmed record, ready to be delivered."""
    return df.select(F.to_json(F.struct(F.lit(event).alias("event"), *fields)).alias("message"))
