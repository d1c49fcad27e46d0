"""Ordered (window) calculations that survive hot keys.

A plain window puts every row of one key into one task.  Here a key is cut
into *segments*: order-preserving slices such as "page number div 256" or
"hour of the timestamp".  Each segment is windowed on its own, and a small
per-segment summary (one row per key and segment, built with map-side
combine) supplies what the segment needs to know about its neighbours.

``segment`` must be monotone in ``order``: sorting by (segment, order) has to
give the same sequence as sorting by order alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperfold.sources.shared import written

SEG, RANGE = "__seg", "__range"
ROWS_PER_TASK = 1 << 19


@dataclass(frozen=True)
class Calc:
    """One ordered calculation: kind, input column, output name."""

    kind: str  # row_number | prefix_sum | prefix_max | carry | lead | total | peak
    name: str
    value: Column | None = None


def row_number(name: str) -> Calc:
    return Calc("row_number", name)


def prefix_sum(value: Column, name: str) -> Calc:
    """Sum over the rows strictly before this one, 0 for the first."""
    return Calc("prefix_sum", name, value)


def prefix_max(value: Column, name: str) -> Calc:
    """Maximum over the rows strictly before this one, null for the first."""
    return Calc("prefix_max", name, value)


def carry(value: Column, name: str) -> Calc:
    """Last non-null value up to and including this row."""
    return Calc("carry", name, value)


def lead(value: Column, name: str) -> Calc:
    """Value of the next row, null for the last one."""
    return Calc("lead", name, value)


def total(name: str, value: Column | None = None) -> Calc:
    """Number of rows of the key, or the sum of a value over them."""
    return Calc("total", name, value)


def peak(name: str, value: Column) -> Calc:
    """Maximum of a value over the rows of the key."""
    return Calc("peak", name, value)


def tasks_for(df: DataFrame) -> int | None:
    """How many partitions keep a task at some ROWS_PER_TASK rows; None where the session's number does."""
    need = math.ceil(df.count() / ROWS_PER_TASK)
    return need if need > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def segmented(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Sequence[Column],
    calcs: Sequence[Calc],
    tasks: int | None = None,
) -> DataFrame:
    """Append the calculations to ``df``; no task ever holds a whole key.

    Key and segment are one struct: it is never null and equal where its fields are equal or both null, so the rows stay
    as the window has dealt and sorted them when they meet the summary.  ``tasks`` is the number of partitions, if not
    the session's.
    """
    keys = list(keys)
    parts = [*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[c.alias(f"s{i}") for i, c in enumerate(segment)]]
    staged = df.withColumn(SEG, F.struct(*parts))
    for i, c in enumerate(calcs):
        if c.value is not None:
            staged = staged.withColumn(f"__v{i}", c.value)
    pos = F.struct(*order)

    local = Window.partitionBy(SEG).orderBy(*order)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what only the summary needs stays out of the rows' shuffle
    out = staged.drop(*[f"__v{i}" for i, c in enumerate(calcs) if c.kind in ("total", "peak")])
    out = out.repartition(tasks, SEG) if tasks else out
    aggs: list[Column] = []
    for i, c in enumerate(calcs):
        v, loc, agg = F.col(f"__v{i}"), f"__l{i}", f"__a{i}"
        if c.kind == "row_number":
            out = out.withColumn(loc, F.row_number().over(local).cast("bigint"))
            aggs.append(F.count(F.lit(1)).alias(agg))
        elif c.kind == "prefix_sum":
            out = out.withColumn(loc, F.coalesce(F.sum(v).over(before), F.lit(0)))
            aggs.append(F.sum(v).alias(agg))
        elif c.kind == "prefix_max":
            out = out.withColumn(loc, F.max(v).over(before))
            aggs.append(F.max(v).alias(agg))
        elif c.kind == "carry":
            out = out.withColumn(loc, F.last(v, ignorenulls=True).over(upto))
            aggs.append(F.max_by(v, F.when(v.isNotNull(), pos)).alias(agg))
        elif c.kind == "lead":
            # boxed so that a null value is told from "no next row here"
            out = out.withColumn(loc, F.lead(F.struct(v.alias("v"))).over(local))
            aggs.append(F.min_by(F.struct(v.alias("v")), pos).alias(agg))
        elif c.kind == "total":
            aggs.append((F.count(F.lit(1)) if c.value is None else F.sum(v)).alias(agg))
        elif c.kind == "peak":
            aggs.append(F.max(v).alias(agg))
        else:
            raise ValueError(f"unknown calculation {c.kind}")

    key = [f"__k{i}" for i in range(len(keys))]
    summary = staged.groupBy(SEG).agg(*aggs).select("*", *[F.col(f"{SEG}.k{i}").alias(k) for i, k in enumerate(key)])
    chain = Window.partitionBy(*key).orderBy(SEG)
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    for i, c in enumerate(calcs):
        a, p = F.col(f"__a{i}"), f"__p{i}"
        if c.kind in ("row_number", "prefix_sum"):
            summary = summary.withColumn(p, F.coalesce(F.sum(a).over(earlier), F.lit(0)))
        elif c.kind == "prefix_max":
            summary = summary.withColumn(p, F.max(a).over(earlier))
        elif c.kind == "carry":
            summary = summary.withColumn(p, F.last(a, ignorenulls=True).over(earlier))
        elif c.kind == "lead":
            summary = summary.withColumn(p, F.lead(a).over(chain))
        elif c.kind == "total":
            summary = summary.withColumn(p, F.sum(a).over(Window.partitionBy(*key)))
        elif c.kind == "peak":
            summary = summary.withColumn(p, F.max(a).over(Window.partitionBy(*key)))
    joined = out.join(summary.select(SEG, *[f"__p{i}" for i in range(len(calcs))]), SEG)
    results = []
    for i, c in enumerate(calcs):
        loc, p = F.col(f"__l{i}"), F.col(f"__p{i}")
        if c.kind in ("row_number", "prefix_sum"):
            value = loc + p
        elif c.kind == "prefix_max":
            value = F.greatest(loc, p)
        elif c.kind == "carry":
            value = F.coalesce(loc, p)
        elif c.kind == "lead":
            value = F.coalesce(loc, p).getField("v")
        else:
            value = p
        results.append(value.alias(c.name))
    return joined.select(*df.columns, *results)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Sequence[Column],
             name: str = "rn") -> DataFrame:
    """1-based position of each row within its key."""
    return segmented(df, keys, order, segment, [row_number(name)])


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], calcs: Sequence[Calc]) -> DataFrame:
    """``segmented`` over range partitions of (key, order): for orders that no expression cuts into segments of many rows.

    A range holds the rows of many keys or a stretch of one, so the summary has at most a row for each key and one for
    each task, whatever the data.  The partitioned rows are written once: both passes must see the same ranges.
    """
    placed = written(df.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranged")
    return segmented(placed, keys, order, [F.col(RANGE)], calcs, tasks_for(placed)).drop(RANGE)


def ranged_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """1-based position of each row within its key, by range partitions."""
    return ranged(df, keys, order, [row_number(name)])


def numbered_all(df: DataFrame, order: Sequence[str], name: str = "rn") -> DataFrame:
    """1-based position of each row in the whole table."""
    return ranged_numbers(df, [], order, name)
