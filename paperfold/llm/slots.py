"""Sharding over fixed virtual slots.

A record's slot is a hash of its id modulo a fixed number of slots; which shard holds a slot is said by a map that is
stored with a version.  Bytes are aggregated for each slot; rebalancing edits the map: slots stay where they are while
their shard has room and the rest moves to the emptiest shards.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperfold.llm.common import numbered, parts_of, table
from paperfold.sources.shared import new_path

SLOTS = 8192


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of each row; a null text has no bytes, a null id has a slot of its own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    """Bytes of each slot that has rows: at most as many entries as there are slots."""
    return {r["vslot"]: r["n"] for r in rows.groupBy("vslot").agg(F.sum("size").alias("n")).collect()}


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots dealt out in turn."""
    return [s % shards for s in range(slots)]


def rebalanced(held: list[int], weights: dict[int, int], shards: int) -> list[int]:
    """The map edited so that bytes are near equal: a shard keeps slots, largest first, up to the mean; the rest moves."""
    target = sum(weights.values()) / shards
    loads, free, edited = [0] * shards, [], list(held)
    for slot in sorted(range(len(held)), key=lambda s: (-weights.get(s, 0), s)):
        shard, w = held[slot], weights.get(slot, 0)
        if shard < shards and (not loads[shard] or loads[shard] + w <= target):
            loads[shard] += w
        else:
            free.append(slot)
    emptiest = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(emptiest)
    for slot in free:  # still largest first
        load, shard = heapq.heappop(emptiest)
        edited[slot] = shard
        heapq.heappush(emptiest, (load + weights.get(slot, 0), shard))
    return edited


def store_map(spark: SparkSession, path: str, version: int, held: list[int]) -> None:
    """Write one version of the map; earlier versions stay."""
    rows = spark.createDataFrame(list(enumerate(held)), "vslot int, shard int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(vslot, shard) of a stored version."""
    return spark.read.parquet(f"{path}/version={version}").select("vslot", "shard")


def assign(docs: DataFrame, shards: int = 24, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot) for every row of ``docs`` (doc_id, text).

    Sizes of the shards are near equal (law ``bytes``).  Version 0 deals slots out in turn, version 1 is its edit by the
    bytes of this table; both are stored under ``path``.  ``slot`` numbers the rows of a shard without gaps, slot after
    slot.  Null texts count as empty, repeated rows are numbered one by one, an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "llm-slot-map")
    rows = table(sized(docs, slots), "sized")
    store_map(spark, path, 0, first_map(shards, slots))
    store_map(spark, path, 1, rebalanced(first_map(shards, slots), slot_bytes(rows), shards))
    held = load_map(spark, path, 1)
    sums = rows.groupBy("vslot").agg(F.count("*").alias("_n")).join(held, "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("vslot", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = numbered(rows, ["vslot"], ["doc_id", "size", "text_crc32"], "_number", max(1, parts_of(spark) // 64))
    return placed.join(sums, "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_base") + F.col("_number")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )
