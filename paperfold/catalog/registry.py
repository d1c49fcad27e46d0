"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from paperfold.sources.shared import tune
from paperfold.sources.tables import Tables


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same question in DuckDB's dialect."""

    def keep(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return keep


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    entry = REGISTRY[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return entry.build(Tables(tune(spark), folder))

    run.__name__ = name
    return run
