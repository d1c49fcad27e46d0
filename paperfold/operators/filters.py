"""Predicates, projections and row splits."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.functions import text as tx
from paperfold.functions.numbers import looks_numeric

# Column names that never leave the system.
INTERNAL_NAMES = ("bbox", "confidence", "page_number", "validation_status", "original_value")


def where_equal(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; a value of None means "not asked for"."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def missing_or(c: Column, value) -> Column:
    return c.isNull() | (c == F.lit(value))


def in_period(c: Column, start, end) -> Column:
    """Both ends inclusive; either may be None."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (c >= F.lit(start))
    if end is not None:
        cond = cond & (c <= F.lit(end))
    return cond


def in_bucket(c: Column, bucket: str, as_of: Column) -> Column:
    """today | week (last 7 days) | month (since the same day last month)."""
    day = c.cast("date")
    if bucket == "today":
        return day == as_of
    if bucket == "week":
        return (day >= F.date_sub(as_of, 7)) & (day <= as_of)
    if bucket == "month":
        return (day >= F.add_months(as_of, -1)) & (day <= as_of)
    raise ValueError(bucket)


def search(df: DataFrame, columns: Sequence[str], needle: str | None) -> DataFrame:
    """Case-insensitive substring search over any of the columns."""
    if not needle:
        return df
    return df.where(reduce(lambda a, b: a | b, [tx.contains_ci(F.col(c), needle) for c in columns]))


def json_value(c: Column, path: str) -> Column:
    """Text at a path like ``a.b[0].c``; a cell object gives its ``value``."""
    rooted = path if path.startswith("[") else f".{path}"
    v = F.try_parse_json(c)
    inner = F.try_variant_get(v, f"${rooted}.value", "string")
    return F.coalesce(inner, F.try_variant_get(v, f"${rooted}", "string"))


def any_filled(columns: Iterable[str]) -> Column:
    """At least one cell is neither blank nor the text ``nan``."""
    cells = F.array(*[F.trim(F.col(c).cast("string")) for c in columns])
    return F.exists(cells, lambda v: v.isNotNull() & (v != "") & (F.lower(v) != "nan"))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any non-blank value; one aggregate row reaches the driver."""
    counts = df.agg(*[
        F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias(c)
        for c in df.columns
    ]).first()
    return df.select(*[c for c in df.columns if counts[c] > 0])


def with_drop_reason(df: DataFrame, reasons: Mapping[str, Column], name: str = "drop_reason") -> DataFrame:
    """Name of the first failed check, null for the rows to keep."""
    return df.withColumn(name, F.coalesce(*[F.when(cond, F.lit(why)) for why, cond in reasons.items()]))


def category_reasons(c: Column, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> dict[str, Column]:
    """Allow-list or deny-list, case-insensitive; an allow-list wins over a deny-list."""
    low = F.lower(c)
    if allow:
        return {"category_not_allowed": ~low.isin(*[a.lower() for a in allow])}
    if deny:
        return {"category_excluded": low.isin(*[d.lower() for d in deny])}
    return {}


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def public_columns(df: DataFrame) -> DataFrame:
    """Without internal columns: a leading underscore or a reserved name."""
    return df.select(*[c for c in df.columns if not c.startswith("_") and c not in INTERNAL_NAMES])


def worth_matching(c: Column) -> Column:
    """Two characters or more and not a number."""
    return (F.length(c) >= 2) & ~looks_numeric(c)


PATH_SHAPE = re.compile(r"^[A-Za-z_][\w]*(\[\d+\])*(\.[A-Za-z_][\w]*(\[\d+\])*)*$")


def valid_path(path: str) -> bool:
    return bool(PATH_SHAPE.match(path))
