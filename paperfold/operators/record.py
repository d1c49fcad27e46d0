"""Canonical records: response shapes, coverage, masking, key spelling, migrations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperfold.functions import boxes
from paperfold.functions import numbers as num
from paperfold.functions.text import normal_key
from paperfold.operators.constraints import constraint_status
from paperfold.plans.pick import pick_last

# Containers a response may be wrapped in, names an answer may carry, default confidences.
WRAPPERS = ("result", "results", "data", "extraction", "extracted", "output", "response", "fields", "guide_extracted")
ANSWER_NAMES = ("answer", "text", "result", "extracted_value")
CONFIDENCE_GIVEN, CONFIDENCE_FLAT, CONFIDENCE_OTHER = 0.8, 0.7, 0.5
MASK = "***"
COMPLEX = ("array", "list", "object", "table")


@dataclass(frozen=True)
class Field:
    key: str
    kind: str = "string"
    required: bool = False
    pattern: str | None = None


def normalise_response(df: DataFrame, body: str, expected: Sequence[str], key: str) -> DataFrame:
    """Long cells from JSON answers of any of the known shapes, one for every key of the answer, expected or not.

    The first element of a list counts; a wrapper is opened only when no
    expected key is present; answers may be rich cells, odd objects or scalars.
    """
    get = F.try_variant_get
    out = df.select(key, F.try_parse_json(body).alias("__v"))
    out = out.withColumn("__v", F.coalesce(get("__v", "$[0]", "variant"), F.col("__v")))
    has = F.lit(False)
    for k in expected:
        has = has | get("__v", f"$.{k}", "variant").isNotNull()
    inner = F.coalesce(*[x for w in WRAPPERS for x in (get("__v", f"$.{w}[0]", "variant"), get("__v", f"$.{w}", "variant"))], F.col("__v"))
    out = out.withColumn("__has", has).withColumn("__v", F.when(F.col("__has"), F.col("__v")).otherwise(inner))
    # an object's keys are not known before: they come out as rows
    keys = df.sparkSession.tvf.variant_explode(F.col("__v").outer()).toDF("__pos", "field_key", "item")
    out = out.lateralJoin(keys).where(F.col("field_key").isNotNull() & ~F.is_variant_null("item"))
    text = lambda p: get("item", p, "string")
    is_object = F.schema_of_variant("item").startswith("OBJECT")
    rich = get("item", "$.value", "variant").isNotNull()
    answer = F.coalesce(*[F.nullif(text(f"$.{n}"), F.lit("")) for n in ANSWER_NAMES])
    score = lambda p: get("item", p, "double")
    value = F.when(rich, text("$.value")).when(is_object, answer).otherwise(text("$"))
    conf = (F.when(rich, F.coalesce(score("$.confidence"), F.lit(CONFIDENCE_GIVEN)))
            .when(is_object, F.coalesce(F.nullif(score("$.confidence"), F.lit(0.0)), score("$.score"), F.lit(CONFIDENCE_FLAT)))
            .otherwise(F.lit(CONFIDENCE_FLAT)))
    source = (F.when(is_object, F.coalesce(text("$.source_text"), F.when(~rich, text("$.source")), F.lit("")))
              .otherwise(F.coalesce(text("$"), F.lit(""))))
    return out.select(key, "field_key", value.alias("value"), conf.alias("confidence"), source.alias("source_text"))


def canonical_record(docs: DataFrame, doc: str, cells: DataFrame, fields: Sequence[Field], pages: DataFrame | None = None) -> DataFrame:
    """One cell of six keys per modelled field: missing ones are empty, strays are dropped, values checked and typed.

    ``cells(doc, field_key, value, confidence, page_number, bbox)``; ``pages(doc, page_number, width, height)`` as far as
    they are known.  ``value`` is a VARIANT: a number for number fields, the parsed list or object for complex ones, else
    the text; ``bbox`` is in percent of its page.  The model's fields are literals, so the record is spread without a
    join; the cells meet it in one equi join.
    """
    keys = F.array(*[F.lit(f.key) for f in fields])
    out = docs.select(doc, F.explode(keys).alias("field_key")).join(cells, [doc, "field_key"], "left")
    if pages is not None:
        sizes = pages.select(F.col(doc).alias("__d"), F.col("page_number").alias("__p"), F.col("width").alias("__width"), F.col("height").alias("__height"))
        out = out.join(sizes, (F.col(doc) == F.col("__d")) & (F.col("page_number") == F.col("__p")), "left")
    else:
        out = out.withColumns({"__width": F.lit(None).cast("double"), "__height": F.lit(None).cast("double")})
    out = boxes.to_percent(out, "bbox", "__width", "__height", "__box")
    raw, k = F.col("value"), F.col("field_key")
    status, value = F.lit("valid"), raw.cast("variant")
    for f in fields:
        mine, checked = k == f.key, constraint_status(raw, f.kind, f.required, f.pattern)
        if f.kind == "number":
            number = num.parse_number(raw)
            value = F.when(mine & number.isNotNull(), number.cast("variant")).otherwise(value)
        elif f.kind in COMPLEX:
            parsed = F.try_parse_json(raw)
            value = F.when(mine & parsed.isNotNull(), parsed).otherwise(value)
            checked = F.when(parsed.isNull() & (F.trim(raw) != ""), "error_json_format").otherwise(checked)
        status = F.when(mine, checked).otherwise(status)
    return out.select(
        doc, "field_key", value.alias("value"), raw.alias("original_value"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.col("__box").alias("bbox"), "page_number", status.alias("validation_status"))


def split_unmapped(cells: DataFrame, name: str = "unmapped_critical_info") -> DataFrame:
    """Side data of a record: the unmapped entries with a value, confidence 0.5 unless given."""
    odd = (F.col("field_key") == name) & (F.coalesce("value", F.lit("")) != "")
    return cells.where(odd | (F.col("field_key") != name)).select(
        *[c for c in cells.columns if c != "confidence"],
        F.when(odd, F.coalesce("confidence", F.lit(CONFIDENCE_OTHER))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(odd, "other_data").otherwise("record").alias("part"))


def path_pattern(path: Column) -> Column:
    """Path with ``*`` for list positions and without wrapper members."""
    p = F.regexp_replace(path, r"\[[0-9]+\]", ".*")
    return F.regexp_replace(F.regexp_replace(p, r"^guide_extracted\.", ""), r"\.value(?=\.|$)", "")


def mask_cells(cells: DataFrame, pii_paths: Sequence[str], path: str = "path", value: str = "value") -> DataFrame:
    """``***`` for every filled scalar at a personal-data path of the model."""
    hidden = path_pattern(F.col(path)).isin(*pii_paths) & F.col(value).isNotNull() & (F.col(value) != "")
    return cells.withColumn(value, F.when(hidden, MASK).otherwise(F.col(value)))


def mask_record(df: DataFrame, column: str, pii_paths: Sequence[str]) -> DataFrame:
    """The nested record ``column`` with ``***`` for filled scalars at personal-data paths, at any depth.

    Paths are dotted, ``*`` stands for any list position, wrapper members (``guide_extracted``, ``value``) are left out of
    them.  Driven by the schema: a record comes back in its own shape; a masked number becomes text.
    """
    paths = set(pii_paths)

    def masked(c: Column, kind: T.DataType, path: tuple[str, ...]) -> Column:
        if isinstance(kind, T.StructType):
            inner = F.struct(*[masked(c.getField(f.name), f.dataType, (*path, f.name)).alias(f.name) for f in kind.fields])
            return F.when(c.isNotNull(), inner)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: masked(x, kind.elementType, (*path, "*")))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda k, v: F.when(F.concat_ws(".", *map(F.lit, named(path)), k).isin(*paths) & (v.cast("string") != ""), MASK).otherwise(v.cast("string"))
                                      if not isinstance(kind.valueType, (T.StructType, T.ArrayType, T.MapType)) else masked(v, kind.valueType, (*path, "*")))
        if ".".join(named(path)) in paths:
            return F.when(c.isNotNull() & (c.cast("string") != ""), MASK).otherwise(c.cast("string"))
        return c

    def named(path: tuple[str, ...]) -> tuple[str, ...]:
        own = path[1:] if path[:1] == ("guide_extracted",) else path
        return tuple(p for i, p in enumerate(own) if p != "value" or i == 0)

    return df.withColumn(column, masked(F.col(column), df.schema[column].dataType, ()))


def align_keys(cells: DataFrame, table: str, row: str, key: str, pos: str, value: str) -> DataFrame:
    """One spelling per key: the one in the table's first row; the last of repeated keys wins."""
    norm = cells.withColumn("__n", normal_key(F.col(key)))
    first = norm.groupBy(table).agg(F.min(row).alias("__first"))
    heads = norm.join(first, table).where(F.col(row) == F.col("__first"))
    spelling = heads.groupBy(table, "__n").agg(F.max_by(key, pos).alias("__canon"))
    out = norm.join(spelling, [table, "__n"], "left").withColumn(key, F.coalesce("__canon", key))
    return pick_last(out, [table, row, key], [pos], [value])


def with_default_flags(flags: Column, defaults: Mapping[str, bool]) -> Column:
    """Add missing default flags, never overwrite one that is set."""
    given = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])
    present = F.coalesce(flags, F.create_map().cast("map<string,boolean>"))
    return F.map_concat(present, F.map_filter(given, lambda k, v: ~F.map_contains_key(present, k)))


def migrate_status(c: Column, legacy: Mapping[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in legacy.items() for x in kv])
    return F.coalesce(F.try_element_at(known, c), c)


def jobs_to_logs(logs: DataFrame, jobs: DataFrame, done: str = "confirmed", status: str = "success") -> DataFrame:
    """Logs after the confirmed jobs have become logs (log_id, owner, status, data).

    ``jobs(job_id, original_log_id, owner, status, data, updated_at)``.  A job that repeated a log sets its status and data,
    the latest one where there are several; one whose log is gone changes nothing; a job of its own becomes a log, unless
    there is one of its name.
    """
    confirmed = jobs.where(F.col("status") == done)
    again = pick_last(confirmed.where(F.col("original_log_id").isNotNull()), ["original_log_id"], ["updated_at", "job_id"], ["data"])
    again = again.select(F.col("original_log_id").alias("__id"), F.col("data").alias("__data"))
    seen = F.col("__id").isNotNull()
    updated = logs.join(again, F.col("log_id") == F.col("__id"), "left").select(
        "log_id", "owner", F.when(seen, status).otherwise(F.col("status")).alias("status"), F.when(seen, F.col("__data")).otherwise(F.col("data")).alias("data"))
    new = confirmed.where(F.col("original_log_id").isNull()).select(F.col("job_id").alias("log_id"), "owner", F.lit(status).alias("status"), "data")
    return updated.unionByName(new.join(logs.select("log_id"), "log_id", "left_anti"))
