"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even when that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Run-time settings the operators rely on; sizes stay with the cluster.

    Functions that run on executors travel with the query, so the package
    need not be installed there.
    """
    cloudpickle.register_pickle_by_value(sys.modules["paperfold"])
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where unset and all tasks run on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="paperfold-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, remembered for ``scratch`` and ``discard``."""
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def discard(spark: SparkSession, since: int = 0) -> int:
    """Delete the intermediate tables that this driver has made (from number ``since`` on); how many there were.

    Results that still read them have to be written before.
    """
    gone = 0
    for name in _made[since:]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _made[since:]
    return gone


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end."""
    since = len(_made)
    try:
        yield
    finally:
        discard(spark, since)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
