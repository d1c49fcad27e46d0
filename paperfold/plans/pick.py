"""Pick one or a few rows per key with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
               cols: Sequence[str] | None = None) -> DataFrame:
    """The row with the smallest ``order`` per key.

    ``min_by`` aggregates partially on the map side, so a hot key sends one
    row per input task over the network instead of all its rows.
    """
    cols = [c for c in (cols or df.columns) if c not in keys]
    best = F.min_by(F.struct(*cols), F.struct(*order)).alias("__b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in cols])


def pick_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
              cols: Sequence[str] | None = None) -> DataFrame:
    """The row with the largest ``order`` per key."""
    cols = [c for c in (cols or df.columns) if c not in keys]
    best = F.max_by(F.struct(*cols), F.struct(*order)).alias("__b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in cols])


def head_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                 name: str | None = None) -> DataFrame:
    """First ``n`` rows per key.

    Catalyst turns ``row_number() <= n`` into a group limit that runs before
    the shuffle, so a hot key sends at most ``n`` rows per input task.
    """
    rn = name or "__rn"
    out = df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.where(F.col(rn) <= n)
    if name:
        return out.withColumn(name, F.col(name).cast("bigint"))
    return out.drop(rn)
