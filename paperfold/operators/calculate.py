"""Calculations that users write: they give null where they fail, and never a wrapped number.

An expression is Spark SQL over the columns of a record or, for a list of rows, over the fields of an item and the
columns of its record.  Names are put in by what they stand for: whole numbers as 64-bit numbers, so that those of 32
bits cannot overflow, and a second time as decimals of 38 digits, which tell when 64 bits were not enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_WORD = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]+`|[A-Za-z_]\w*""")
_TYPE_BOUND = re.compile(r"hash|typeof", re.IGNORECASE)  # functions whose result depends on the type of a number
_ITEM = "__item"


def in_terms_of(text: str, names: Mapping[str, str]) -> str:
    """The expression with each name (lower case) replaced by what it stands for; ``cast`` gives null where it fails.

    Quoted texts, fields after a dot and functions stay as they are.
    """
    def swap(m: re.Match) -> str:
        word, before, after = m.group(), text[: m.start()].rstrip()[-1:], text[m.end():].lstrip()[:1]
        if word[0] in "'\"" or before == ".":
            return word
        if after == "(" and word[0] != "`":
            return "try_cast" if word.lower() == "cast" else word
        return names.get(word.strip("`").lower(), word)

    return _WORD.sub(swap, text)


@contextmanager
def failing_gives_null(spark: SparkSession) -> Iterator[None]:
    """Expressions that are resolved meanwhile give null where they would fail (division by zero, bad casts)."""
    before = spark.conf.get("spark.sql.ansi.enabled", None)
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset("spark.sql.ansi.enabled")
        else:
            spark.conf.set("spark.sql.ansi.enabled", before)


def _standing_for(fields: Sequence[tuple[str, str, T.DataType]], kind: str | None) -> dict[str, str]:
    """Names and what they stand for, whole numbers as ``kind``."""
    whole = {name.lower(): f"CAST({ref} AS {kind})" for name, ref, t in fields if kind and isinstance(t, _WHOLE)}
    return {name.lower(): ref for name, ref, _ in fields if ref.startswith(_ITEM)} | whole


def _type_of(df: DataFrame, text: str) -> T.DataType | None:
    """Type of a SQL expression over ``df``; None if it does not resolve."""
    try:
        return df.select(F.expr(text)).schema[0].dataType
    except (AnalysisException, ParseException):
        return None


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _checked(probe: DataFrame, text: str, fields: Sequence[tuple[str, str, T.DataType]], bare: str = "") -> tuple[str, T.DataType]:
    """SQL for the value of an expression, null where a number did not fit, and its type.

    ``probe`` is a frame on which the references resolve once ``bare`` is taken off them.
    """
    kinds = {kind: in_terms_of(text, _standing_for(fields, kind)) for kind in ("BIGINT", "DECIMAL(20, 0)")}
    plain = in_terms_of(text, _standing_for(fields, None))
    on = lambda sql: _type_of(probe, sql.replace(bare, "") if bare else sql)
    wide, exact = kinds["BIGINT"], kinds["DECIMAL(20, 0)"]
    found = on(wide)
    if found is None:  # a name that stands for something else here, such as a unit of time
        wide, found = plain, on(plain)
    if found is None:
        probe.select(F.expr(plain.replace(bare, "") if bare else plain))  # says why
    if not isinstance(found, _WHOLE) or _TYPE_BOUND.search(text) or on(exact) is None:
        return wide, found
    shadow = f"CAST({exact} AS DECIMAL(38, 0))"
    return f"CASE WHEN abs({shadow} - CAST({wide} AS DECIMAL(38, 0))) < 4611686018427387904 THEN {wide} END", found


def _fitted(sql: str, found: T.DataType, field: T.DataType | None) -> str:
    """The value in the type of the field that it replaces, null where it does not fit."""
    both = field is not None and isinstance(found, _WHOLE) and isinstance(field, _WHOLE)
    return f"TRY_CAST({sql} AS {field.simpleString()})" if both else sql


def calculated(df: DataFrame, field: str, expression: str, condition: str = "true") -> tuple[DataFrame, DataFrame]:
    """``field`` set where the condition holds; a row whose expression gives nothing keeps its value.

    The second frame has ``__failed`` beside, which marks such rows.
    """
    fields = [(f.name, _quoted(f.name), f.dataType) for f in df.schema.fields]
    known = {f.name.lower(): f.dataType for f in df.schema.fields}.get(field.lower())
    with failing_gives_null(df.sparkSession):
        sql, found = _checked(df, expression, fields)
        new = F.expr(_fitted(sql, found, known))
        holds = F.coalesce(F.expr(_checked(df, condition, fields)[0]), F.lit(False))
        old = F.col(_quoted(field)) if known is not None else F.lit(None)
        marked = df.select("*", (holds & new.isNull()).alias("__failed"), F.when(holds & new.isNotNull(), new).otherwise(old).alias("__value"))
        marked.schema  # resolved here, while failing gives null
    out = marked.withColumn(field, F.col("__value")).drop("__value")
    return out.drop("__failed"), out


def assign_when(df: DataFrame, field: str, expression: str, condition: str = "true") -> DataFrame:
    """Set ``field`` where the condition holds; a failing expression leaves it as it is."""
    return calculated(df, field, expression, condition)[0]


def calculated_items(df: DataFrame, target: str, field: str, expression: str, condition: str = "true") -> tuple[DataFrame, DataFrame]:
    """The same for each item of the list ``target`` of rows: names are the item's fields first, then the record's columns.

    The second frame has ``__failed``, the number of items that keep their value though the condition holds.
    """
    kind = df.schema[target].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        raise ValueError(f"{target} is not a list of rows")
    item = kind.elementType
    own = [(f.name, f"{_ITEM}.{_quoted(f.name)}", f.dataType) for f in item.fields]
    taken = {f.name.lower() for f in item.fields}
    fields = [(f.name, _quoted(f.name), f.dataType) for f in df.schema.fields if f.name.lower() not in taken] + own
    known = {f.name.lower(): f.dataType for f in item.fields}.get(field.lower())
    # an item's fields beside the record's columns, to resolve types on
    probe = df.select(*[F.col(_quoted(f.name)) for f in df.schema.fields if f.name.lower() not in taken], F.get(_quoted(target), F.lit(0)).alias(_ITEM))
    probe = probe.select("*", f"{_ITEM}.*")
    with failing_gives_null(df.sparkSession):
        sql, found = _checked(probe, expression, fields, f"{_ITEM}.")
        new = _fitted(sql, found, known)
        holds = f"coalesce({_checked(probe, condition, fields, f'{_ITEM}.')[0]}, false)"
        old = f"{_ITEM}.{_quoted(field)}" if known is not None else "NULL"
        value = f"CASE WHEN {holds} AND ({new}) IS NOT NULL THEN {new} ELSE {old} END"
        rest = [f"'{f.name}', {_ITEM}.{_quoted(f.name)}" if f.name.lower() != field.lower() else f"'{f.name}', {value}" for f in item.fields]
        rest += [] if known is not None else [f"'{field}', {value}"]
        q = _quoted(target)
        marked = df.select(
            "*", F.expr(f"coalesce(size(filter({q}, {_ITEM} -> {_ITEM} IS NOT NULL AND {holds} AND ({new}) IS NULL)), 0)").alias("__failed"),
            F.expr(f"transform({q}, {_ITEM} -> CASE WHEN {_ITEM} IS NOT NULL THEN named_struct({', '.join(rest)}) END)").alias("__value"))
        marked.schema
    out = marked.withColumn(target, F.col("__value")).drop("__value")
    return out.drop("__failed"), out


def combinations(df: DataFrame, sources: Mapping[str, str], preserve: Sequence[str], output: str) -> DataFrame:
    """All combinations of list fields, under aliases, as a list of rows ``output`` with the preserved fields in each.

    A single value counts as a list of one, a null one as an empty list.
    """
    def values(name: str) -> Column:
        c, kind = F.col(_quoted(name)), df.schema[name].dataType
        listed = c if isinstance(kind, T.ArrayType) else F.when(c.isNotNull(), F.array(c))
        return F.coalesce(listed, F.array().cast(listed_type(kind)))

    def listed_type(kind: T.DataType) -> T.DataType:
        return kind if isinstance(kind, T.ArrayType) else T.ArrayType(kind)

    def joined(rows: Column, name: str, before: Sequence[str]) -> Column:
        return F.flatten(F.transform(rows, lambda row: F.transform(
            values(name), lambda v: F.struct(*[row[b].alias(b) for b in before], v.alias(sources[name])))))

    kept = [F.col(_quoted(p)).alias(p) for p in preserve]
    rows, names = F.array(F.struct(F.lit(0).alias("__none"))), list(sources.values())
    for n, name in enumerate(sources):
        rows = joined(rows, name, names[:n])
    return df.withColumn(output, F.transform(rows, lambda row: F.struct(*[row[n].alias(n) for n in names], *kept)))


def failures(frames: Sequence[tuple[int, DataFrame]]) -> DataFrame | None:
    """(n, unchanged): how many rows or items calculation number n left as they were though its condition holds."""
    failed = F.coalesce(F.sum(F.col("__failed").cast("bigint")), F.lit(0)).alias("unchanged")
    each = [f.agg(failed).select(F.lit(n).alias("n"), "unchanged") for n, f in frames]
    return reduce(DataFrame.unionAll, each) if each else None
