"""Nested records to rows: unwrap, flatten, zip, unpivot, search text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperfold.functions.text import collapse_spaces


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def unwrap(df: DataFrame) -> DataFrame:
    """Replace every top-level struct that has a ``value`` member by that member, repeatedly."""
    while True:
        rich = [f.name for f in df.schema if isinstance(f.dataType, T.StructType) and "value" in f.dataType.fieldNames()]
        if not rich:
            return df
        df = df.select(*[_q(c).getField("value").alias(c) if c in rich else _q(c) for c in df.columns])


def unwrap_json(c: Column) -> Column:
    """Text of a JSON cell, going through nested ``value`` members as deep as they go.

    A text cannot hold more of them than it names, which bounds the steps.
    """
    steps = F.sequence(F.lit(0), F.regexp_count(c, F.lit('"value"')))
    inner = F.aggregate(steps, F.try_parse_json(c), lambda v, _: F.coalesce(F.try_variant_get(v, "$.value", "variant"), v))
    return F.try_variant_get(inner, "$", "string")


def deep_flatten(df: DataFrame, path: str = "_path") -> DataFrame:
    """Rows and dotted columns from any nesting.

    Arrays of one round are zipped (short ones padded with null) and exploded
    together; structs become dotted columns when no array is left; ``path``
    keeps the position taken in each round of exploding.  Driven by the schema,
    which is finite: rounds go on until it holds no list and no struct.
    """
    out = unwrap(df).withColumn(path, F.array().cast("array<int>"))
    while True:
        fields = [f for f in out.schema if f.name != path]
        arrays = [f.name for f in fields if isinstance(f.dataType, T.ArrayType)]
        structs = [f for f in fields if isinstance(f.dataType, T.StructType)]
        if arrays:
            zipped = F.arrays_zip(*[F.coalesce(_q(a), F.array().cast(out.schema[a].dataType)).alias(f"a{i}") for i, a in enumerate(arrays)])
            out = out.withColumn("__z", zipped).select(*[_q(c) for c in out.columns], F.posexplode_outer("__z").alias("__p", "__e"))
            out = out.select(
                *[_item(out, arrays.index(f.name)).alias(f.name)
                  if f.name in arrays else _q(f.name) for f in fields],
                F.when(F.col("__p").isNull(), _q(path)).otherwise(F.array_append(_q(path), F.col("__p"))).alias(path))
        elif structs:
            names = [f.name for f in structs]
            cols: list[Column] = []
            for f in fields:
                if f.name in names:
                    cols += [_q(f.name).getField(m).alias(f"{f.name}.{m}") for m in f.dataType.fieldNames()]
                else:
                    cols.append(_q(f.name))
            out = out.select(*cols, _q(path))
        else:
            break
        out = unwrap(out)
    return out


def _item(df: DataFrame, i: int) -> Column:
    element = df.schema["__e"].dataType.fieldNames()[i]
    return F.col("__e").getField(element)


def master_detail(df: DataFrame) -> DataFrame:
    """One level: scalars repeat, lists zip by position, list objects become ``list.key``.

    Other objects turn into JSON text, null scalars into blank text;
    plain columns come first, dotted ones last, each alphabetical.
    """
    src = unwrap(df)
    arrays = [f.name for f in src.schema if isinstance(f.dataType, T.ArrayType)]
    if arrays:
        zipped = F.arrays_zip(*[F.coalesce(_q(a), F.array().cast(src.schema[a].dataType)).alias(f"a{i}") for i, a in enumerate(arrays)])
        src = src.withColumn("__z", zipped).select(*[_q(c) for c in src.columns], F.explode_outer("__z").alias("__e"))
    cols: dict[str, Column] = {}

    def put(name: str, c: Column, kind: T.DataType):
        if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
            c = F.to_json(c)
        cols[name] = F.coalesce(c.cast("string"), F.lit(""))

    for f in src.schema:
        if f.name in ("__e", "__z") or f.name.startswith("_"):
            continue
        if f.name in arrays:
            item, kind = _item(src, arrays.index(f.name)), f.dataType.elementType
            if isinstance(kind, T.StructType):
                for m in kind.fields:
                    put(f"{f.name}.{m.name}", item.getField(m.name), m.dataType)
            else:
                put(f.name, item, kind)
        else:
            put(f.name, _q(f.name), f.dataType)
    order = sorted(c for c in cols if "." not in c) + sorted(c for c in cols if "." in c)
    return src.select(*[cols[c].alias(c) for c in order])


def unpivot_maps(df: DataFrame, maps: Sequence[str], key: str = "_container_type") -> DataFrame:
    """One row per sub-key of any of the maps; missing values are blank; rows without sub-keys stay."""
    keys = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(m), F.array().cast("array<string>")) for m in maps])))
    out = df.withColumn(key, F.explode_outer(keys))
    value = lambda m: F.when(F.col(key).isNotNull(), F.coalesce(F.try_element_at(F.col(m), F.col(key)).cast("string"), F.lit("")))
    return out.select(*[value(c).alias(c) if c in maps else _q(c) for c in df.columns], key)


def cartesian_explode(df: DataFrame, sources: dict[str, str], preserve: Sequence[str] = ()) -> DataFrame:
    """All combinations of the list fields of one row, under aliases; a null list gives no rows."""
    out = df
    for field, alias in sources.items():
        kind = df.schema[field].dataType
        lists = _q(field) if isinstance(kind, T.ArrayType) else F.when(_q(field).isNotNull(), F.array(_q(field)))
        out = out.withColumn(f"__x_{alias}", F.explode(lists))
    return out.select(*preserve, *[F.col(f"__x_{a}").alias(a) for a in sources.values()])


_SCALAR = r'"(?:[^"\\]|\\.)*"(?:\s*:)?|-?[0-9][0-9.eE+-]*|true|false'


def search_text(c: Column) -> Column:
    """All scalar values of a JSON text, in document order, as one line.

    One regular-expression pass picks texts, numbers and truth values (a text
    followed by a colon is a key and left out); they are decoded as one JSON
    list, at any depth.
    """
    scalars = F.filter(F.regexp_extract_all(c, F.lit(_SCALAR), F.lit(0)), lambda x: ~x.endswith(":"))
    listed = F.from_json(F.concat(F.lit("["), F.array_join(scalars, ","), F.lit("]")), "array<string>")
    return collapse_spaces(F.array_join(F.transform(listed, lambda x: F.trim(x)), " "))


# Field types of a model and the Spark types they parse to.
FIELD_TYPES = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.DoubleType(),
               "boolean": T.BooleanType(), "date": T.StringType()}
ROW_TYPES = ("array", "list", "table")


def schema_from_fields(fields: Sequence[dict]) -> T.StructType:
    """StructType of a model's fields; objects and rows without sub-fields stay free-form."""
    out = T.StructType()
    for f in fields:
        subs = schema_from_fields(f["sub_fields"]) if f.get("sub_fields") else T.VariantType()
        if f["type"] in ROW_TYPES:
            kind: T.DataType = T.ArrayType(subs)
        elif f["type"] == "object":
            kind = subs
        else:
            kind = FIELD_TYPES.get(f["type"], T.StringType())
        out.add(f["key"], kind)
    return out
