"""Running a stream over what is available and reading its result back.

State and output live in the shared folder.  Micro-batches are written to a
folder named after the batch, so a batch that runs twice replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.sources.shared import new_path

BATCH = "batch_id"


def stream_table(spark: SparkSession, folder: str, name: str, **options) -> DataFrame:
    """A given table as a file stream, whether it is one file or a folder of part files."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    if _is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Asks the store that the path is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def stream_folder(spark: SparkSession, folder: str, schema, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State on local disk with changes logged to the checkpoint: what ``transformWithState`` needs, set for one run."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def run_append(stream: DataFrame, label: str, out: str | None = None, state: str | None = None) -> DataFrame:
    """Append-mode run into parquet (exactly once by the sink's log).

    With ``out`` and ``state`` named, a later run goes on where this one ended; without, they are new folders.
    """
    spark = stream.sparkSession
    out = out or new_path(spark, label)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
         .option("checkpointLocation", state or new_path(spark, f"{label}-state")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, label: str, step: Callable[[DataFrame], DataFrame], mode: str = "append",
                out: str | None = None, state: str | None = None) -> DataFrame:
    """Write ``step(batch)`` of every micro-batch, tagged with ``batch_id``; read all of them back.

    With ``out`` and ``state`` named, a later run goes on where this one ended; without, they are new folders.
    """
    spark = stream.sparkSession
    out = out or new_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    schema = step(spark.createDataFrame([], stream.schema)).schema
    q = (stream.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", state or new_path(spark, f"{label}-state")).trigger(availableNow=True).start())
    q.awaitTermination()
    full = schema.add(BATCH, "long")
    return spark.read.schema(full).option("basePath", out).parquet(f"{out}/{BATCH}=*") if _any_batch(spark, out) else spark.createDataFrame([], full)


def run_each(stream: DataFrame, label: str, step: Callable[[DataFrame, int], None], state: str | None = None) -> None:
    """Hand every micro-batch and its id to ``step``, which has to bear being called again for a batch."""
    (stream.writeStream.foreachBatch(step).option("checkpointLocation", state or new_path(stream.sparkSession, f"{label}-state"))
     .trigger(availableNow=True).start().awaitTermination())


def _any_batch(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path).limit(1).count()
        return True
    except AnalysisException:
        return False


def latest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Last written state of each key."""
    from paperfold.plans.pick import pick_last

    return pick_last(batches, keys, [BATCH], [c for c in batches.columns if c not in (*keys, BATCH)])


def run_update(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Update-mode run of an aggregation: the final value of each key."""
    return latest(run_batches(stream, label, lambda b: b, "update"), keys)


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as an instant; watermarks do not take local timestamps."""
    return df.withColumn(column, F.col(column).cast("timestamp"))
