"""Helpers that the operators share: Arrow text access, word hashes, numbering, intermediate tables."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paperfold.sources.shared import new_path, tune, written

CHUNK_BYTES = 1 << 18  # texts are worked through in groups of about this size (a longer text is a group of its own)
ENCODERS = "_paperfold_encoders"  # attribute of the sys module under which a Python process keeps its encoders
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: small Arrow batches, so that a Python worker holds few texts at once."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return written(df, f"llm-{label}")


def shared_uri(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder with the scheme that Spark's file systems give it, for tasks that write files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, label))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path and the path in it; only ``file:`` and a bare path are this machine's."""
    if uri.startswith(("/", "file:")):
        return pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a finaliser of multiply and shift steps)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed))


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size, one = max(n, CHUNK_BYTES * 2), np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(size - 1, _BASE, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(size - 1, _INVERSE, np.uint64))])
        return self.up[:n], self.down[:n]


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of ``units``; equal spans have equal hashes wherever they stand."""
    up, down = powers.to(len(units) + 1)
    prefix = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of texts: first row, end row, UTF-8 bytes, offsets of the rows in them.  Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def words(units: np.ndarray, offsets: np.ndarray, powers: Powers, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a group, and where each row's words start in them."""
    if lower:
        units = _LOWER[units]
    gap = np.ones(len(units) + 1, bool)
    gap[:-1] = _IS_SPACE[units]
    inside = ~gap[:-1]
    before = np.empty(len(units), bool)
    before[:1] = True
    before[1:] = gap[:-2]
    edge = offsets[:-1][offsets[:-1] < len(units)]
    before[edge] = True
    after = gap[1:].copy()
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return span_hashes(units, starts, ends, powers), np.searchsorted(starts, offsets)


def map_texts(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str, encodes: bool = False) -> DataFrame:
    """Apply ``rows`` to each Arrow batch of ``df``.

    Python processes go from one operator to the next: one that doesn't encode frees the encoders that another has kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            sys.__dict__.pop(ENCODERS, None)
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, key: list[str], order: list[str], name: str, parts: int) -> DataFrame:
    """Number the rows of each key from 0 without gaps, a key being spread over ``parts`` groups.

    Rows that are equal in ``key`` and ``order`` are counted before they are numbered, so neither a frequent key nor a
    row repeated very often meets in one task.  Returns key, order and number.
    """
    same = df.groupBy(*key, *order).agg(F.count(F.lit(1)).alias("_n"))
    same = same.withColumn("_part", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(parts)).cast("int"))
    sums = same.groupBy(*key, "_part").agg(F.sum("_n").alias("_all"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, "_part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("_first", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    left, right = same.alias("l"), sums.alias("r")
    on = F.col("l._part") == F.col("r._part")
    for k in key:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    first = F.col("_base") + F.col("_first")
    return left.join(right, on).select(
        *[F.col(f"l.{k}") for k in key], *[F.col(f"l.{o}") for o in order],
        F.explode(F.sequence(first, first + F.col("_n") - 1)).alias(name),
    )


def parts_of(spark: SparkSession) -> int:
    """Into how many groups a frequent key is split: as many as there are shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
