"""Dashboards, counters and declared exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from paperfold.functions import status as st
from paperfold.functions.numbers import half_up, parse_number, percent_of

# Price per thousand prompt and completion tokens.
PROMPT_PRICE, COMPLETION_PRICE = 0.005, 0.015


def period_kpis(logs: DataFrame, name: str = "model_name") -> DataFrame:
    """Total, success rate and number of distinct model names, in one pass."""
    ok = F.count_if(F.col("status").isin(st.SUCCESS, st.PREVIEW_READY))
    total = F.count(F.lit(1))
    return logs.agg(total.alias("total"), percent_of(ok, total).alias("success_rate"),
                    F.count_distinct(F.col(name)).alias("active_models"))


def daily_trend(df: DataFrame, when: Column, first: str, last: str, **counts: Column) -> DataFrame:
    """One row per day between two dates, zero where nothing happened.

    The calendar is a generated range, the counts are a pre-aggregated
    group-by, so only one row per day meets the join.
    """
    spark = df.sparkSession
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    day = when.cast("date")
    inside = df.where((when >= F.lit(first).cast("timestamp_ntz"))
                      & (when < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")))
    per_day = inside.groupBy(day.alias("day")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return days.join(per_day, "day", "left").na.fill(0, list(counts))


def usage(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("uses"))


def status_tiles(df: DataFrame, as_of: str) -> DataFrame:
    s = F.col("status")
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(st.is_success(s)).alias("success"),
        F.count_if(st.is_processing(s)).alias("processing"), F.count_if(st.is_error(s)).alias("error"),
        F.count_if(F.col("created_at").cast("date") == F.lit(as_of).cast("date")).alias("today"))


def token_cost(prompt: Column, completion: Column) -> Column:
    return half_up(prompt / 1000 * PROMPT_PRICE + completion / 1000 * COMPLETION_PRICE, 6)


def grouped_totals(df: DataFrame, keys: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Sum, average and count per group with total rows; text that is no number counts as 0.

    Groups are summed before the rollup, which then multiplies a few groups
    instead of every row.
    """
    amounts = {}
    for c in numbers:
        parsed = F.col(c) if isinstance(df.schema[c].dataType, NumericType) else parse_number(F.col(c))
        amounts[f"__{c}"] = F.coalesce(parsed, F.lit(0)).cast("decimal(18,2)")
    groups = df.select(*keys, *[v.alias(k) for k, v in amounts.items()]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(k).alias(k) for k in amounts])
    rows = F.sum("__n")
    aggs = []
    for c in numbers:
        amount = F.sum(f"__{c}").cast("double")
        aggs += [amount.alias(f"{c}_sum"), half_up(amount / rows, 4).alias(f"{c}_avg")]
    return groups.rollup(*keys).agg(F.grouping_id().cast("bigint").alias("total_level"), rows.alias("row_count"), *aggs)


def pivot_export(df: DataFrame, keys: Sequence[str], column: str, names: Sequence[str],
                 value: str, order: Sequence[str]) -> DataFrame:
    """One column per name holding the first non-empty value in row order."""
    filled = df.where(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
    return filled.groupBy(*keys).pivot(column, list(names)).agg(F.min_by(value, F.struct(*order)))


def repeat_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  blocks: int, fields: Sequence[str]) -> DataFrame:
    """The n-th child row written to block n; what the layout has no block for goes on in further rows (``layout_row``)."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    rows = df.select("*", number.alias("__n")).withColumns({"layout_row": F.floor(F.col("__n") / blocks), "__block": F.col("__n") % blocks + 1})
    return rows.groupBy(*keys, "layout_row").agg(*[
        F.max(F.when(F.col("__block") == b, F.col(f))).alias(f"{f}_{b}")
        for b in range(1, blocks + 1) for f in fields])


def table_size(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and columns of a table; declared counts win when they are not zero."""
    return cells.groupBy(*keys).agg(
        F.coalesce(F.nullif(F.max("declared_rows"), F.lit(0)),
                   F.max(F.col("row_index") + F.col("row_span"))).cast("bigint").alias("row_count"),
        F.coalesce(F.nullif(F.max("declared_cols"), F.lit(0)),
                   F.max(F.col("col_index") + F.col("col_span"))).cast("bigint").alias("col_count"))


def upsert_hits(existing: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Learned pairs: known ones gain the new hits, new ones enter unverified."""
    fresh = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("__new"))
    return existing.join(fresh, list(keys), "full").select(
        *keys, (F.coalesce("hit_count", F.lit(0)) + F.coalesce("__new", F.lit(0))).alias("hit_count"),
        F.coalesce("is_verified", F.lit(False)).alias("is_verified"))
