"""Scans: encoded text, JSON of unknown casing, permissive records, dictionaries."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperfold.functions.files import safe_names
from paperfold.plans.segments import carry, lead, prefix_sum, segmented
from paperfold.sources.shared import written

# Encodings tried in order; the last one always decodes.
ENCODINGS = ("UTF-8", "x-windows-949", "ISO-8859-1")
REPLACEMENT = "�"


@contextmanager
def lenient_charsets(spark: SparkSession):
    """Allow every Java charset and mark undecodable bytes instead of failing."""
    names = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "true")
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def read_encoded_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headerless CSV files whose encoding is found per file: UTF-8, CP949, Latin-1.

    Files are scanned as raw lines, so large ones stay splittable; lines that a
    quoted line break has cut are joined again, and the encoding is a per-file
    aggregate joined back.
    """
    with lenient_charsets(spark):
        lines = csv_records(spark, path)
        utf8, cp949, latin1 = (F.decode("raw", e) for e in ENCODINGS)
        decoded = lines.select("file", utf8.alias("utf8"), cp949.alias("cp949"), latin1.alias("latin1"))
        clean = lambda c: F.bool_and(~F.contains(F.col(c), F.lit(REPLACEMENT)))
        per_file = decoded.groupBy("file").agg(clean("utf8").alias("is_utf8"), clean("cp949").alias("is_cp949"))
        text = F.when(F.col("is_utf8"), F.col("utf8")).when(F.col("is_cp949"), F.col("cp949")).otherwise(F.col("latin1"))
        name = F.when(F.col("is_utf8"), "utf-8").when(F.col("is_cp949"), "cp949").otherwise("latin-1")
        out = decoded.join(per_file, "file").select(name.alias("encoding"), text.alias("line"))
        ddl = F.lit(schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
        row = F.from_csv(F.col("line"), ddl, {"escape": '"', "multiLine": "true"})
        return out.select("encoding", row.alias("r")).select("encoding", "r.*")


# a field, quoted or not; an unquoted one may hold quotes
_FIELD = r'(?:"(?:[^"]|"")*+"[^,]*|[^",][^,]*|)'
_OPEN = rf'(?:{_FIELD},)*+"(?:[^"]|"")*+$'
_CLOSED = r'(?:[^"]|"")*+"[^,]*'


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, raw): the records of CSV files as bytes, with the line breaks inside quotes.

    Whether a line ends within quotes depends on how it began, so each line is a map of two states: it keeps the state,
    turns it, or sets it.  The state before a line is the last one set, turned as often as lines have turned it since;
    every split of a file finds it with a summary of the splits before.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), F.col("value"))
    bare = F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), r"\r$", "")
    from_out, from_in = bare.rlike("^" + _OPEN), bare.rlike(r'^(?:[^"]|"")*+$') | bare.rlike(f"^{_CLOSED},{_OPEN}")
    lines = written(lines.select("file", "split", "n", F.col("value").cast("binary").alias("raw"), from_out.alias("out"), from_in.alias("in")), "csv-lines")
    order, segment = ["split", "n"], [F.col("split")]
    turns = segmented(lines, ["file"], order, segment, [prefix_sum((F.col("out") & ~F.col("in")).cast("int"), "turned")])
    # a line that ends the same however it began sets the state
    sets = F.when(F.col("out") == F.col("in"), F.struct(F.col("out").cast("int").alias("state"), F.col("turned")))
    states = segmented(turns, ["file"], order, segment, [carry(sets, "held"), lead(F.lit(1), "more")])
    here = F.col("turned") + (F.col("out") & ~F.col("in")).cast("int")
    ends_in = (F.coalesce("held.state", F.lit(0)) + here - F.coalesce("held.turned", F.lit(0))) % 2 == 1
    states = written(states.select("file", "split", "n", "raw", (ends_in & F.col("more").isNotNull()).alias("goes_on")), "csv-states")
    # a record is named by the place of its last line
    back = [-F.col("split"), -F.col("n")]
    last = F.when(~F.col("goes_on"), F.struct("split", "n"))
    named = segmented(states.withColumns({"b": back[0], "r": back[1]}), ["file"], ["b", "r"], [F.col("b")], [carry(last, "end")])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("split", "n", "raw"))), lambda x: x["raw"])
    joined = F.aggregate(F.slice(parts, 2, F.size(parts)), parts[0], lambda a, x: F.concat(a, F.lit(b"\n"), x))
    return named.groupBy("file", "end").agg(joined.alias("raw")).select("file", "raw")


def either_case(struct: Column, snake: str, camel: str) -> Column:
    """A member that may come in snake_case or camelCase."""
    return F.coalesce(struct[camel], struct[snake])


def parse_records(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """JSON text to columns; malformed records keep their text in ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return df.withColumn("__r", F.from_json(column, full, options)).select(*df.columns, "__r.*")


def polygon_box(polygon: Column) -> Column:
    """[x1, y1, x2, y2] around a polygon."""
    xs, ys = F.filter(polygon, lambda v, i: i % 2 == 0), F.filter(polygon, lambda v, i: i % 2 == 1)
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def extend_cache(source: DataFrame, path: str, key: str, process, schema: T.StructType | str) -> DataFrame:
    """Results for ``source`` from the cache table at ``path``, which first gains what it lacks."""
    spark = source.sparkSession
    try:
        cache = spark.read.schema(schema).parquet(path)
    except AnalysisException:  # no table yet
        cache = spark.createDataFrame([], schema)
    process(source.join(cache.select(key), key, "left_anti")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).join(source.select(key).distinct(), key, "left_semi")


def through_cache(source: DataFrame, cache: DataFrame, key: str, process) -> DataFrame:
    """Cached results plus freshly processed ones; cached keys are never processed again."""
    todo = source.join(cache.select(key), key, "left_anti")
    known = cache.join(source.select(key), key, "left_semi")
    return known.withColumn("cached", F.lit(True)).unionByName(process(todo).withColumn("cached", F.lit(False)))


def _base64_letters(text: Column) -> Column:
    """The letters of a base64 text: without data-URL prefix, URL-safe ones in their plain form."""
    body = F.when(F.startswith(text, F.lit("data:")), F.regexp_replace(text, r"^data:[^,]*,", "")).otherwise(text)
    for old, new in (("-", "+"), ("_", "/")):
        body = F.replace(body, F.lit(old), F.lit(new))
    return F.regexp_replace(body, "[^A-Za-z0-9+/]+", "")


def _with_bytes(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Bytes of a base64 text: data-URL prefix, URL-safe letters and padding are repaired.

    The letters are a column of their own, so they are made once.
    """
    out = df.withColumn("__letters", _base64_letters(text))
    padded = F.concat("__letters", F.repeat(F.lit("="), F.pmod(-F.length("__letters"), F.lit(4)).cast("int")))
    return out.withColumn(name, F.try_to_binary(padded, F.lit("base64"))).drop("__letters")


# Leading bytes (hex) of the accepted file kinds.
FILE_SIGNATURES = ("25504446", "FFD8FF", "89504E470D0A1A0A", "504B0304", "D0CF11E0", "49492A00", "4D4D002A")


def has_signature(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 8))
    cond = F.lit(False)
    for s in FILE_SIGNATURES:
        cond = cond | head.startswith(s)
    return F.coalesce(cond & (F.length(data) >= 4), F.lit(False))


def decode_attachment(df: DataFrame, column: str, name: str, max_chars: int | None = None) -> DataFrame:
    """Decode once; peel up to two more layers, but only onto a known file signature.

    With ``max_chars``, longer texts are not decoded and ``reject_reason`` says so.
    """
    if max_chars is None:
        out = _with_bytes(df, F.col(column), name)
    else:
        fits = F.length(column) <= max_chars
        out = _with_bytes(df, F.when(fits, F.col(column)), name).withColumn("reject_reason", F.when(~fits, "too long"))
    # a layer is only decoded where those before it show no signature
    deeper = lambda c: F.when(~has_signature(F.col(c)), F.col(c).cast("string"))
    out = _with_bytes(out, deeper(name), "__two")
    out = _with_bytes(out, deeper("__two"), "__three")
    data = (F.when(has_signature(F.col(name)), F.col(name))
            .when(has_signature(F.col("__two")), F.col("__two"))
            .when(has_signature(F.col("__three")), F.col("__three")).otherwise(F.col(name)))
    return out.withColumn(name, data).drop("__two", "__three")


def load_dictionary(sheet: DataFrame, category: str, position: str | None = None) -> DataFrame:
    """Any sheet as dictionary: first two columns are code and name, the rest a map.

    ``position`` names a column with the row's place in the sheet; it enters the row id.  ``headers`` has the sheet's own
    header of each safe name.
    """
    place = [F.col(position).cast("string")] if position else []
    columns = [c for c in sheet.columns if c != position]
    cells = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    names = safe_names(columns)
    return sheet.select(
        F.lit(category).alias("category"), cells[0].alias("code"), cells[1].alias("name"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in names[2:]]), F.array(*cells[2:])).alias("extra")
        if len(cells) > 2 else F.create_map().cast("map<string,string>").alias("extra"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(c) for c in columns])).alias("headers"),
        F.md5(F.concat_ws("|", F.lit(category), *place, *cells)).alias("row_id"))


def read_users(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(email, name, group_name) of a user list: ``csv`` (groups with semicolons), ``json`` (one list) or ``jsonl`` (a user a line).

    In JSON, groups are a list or a text with semicolons.  Rows without an email or a name are dropped; a user without groups has one row with a null group.
    """
    schema = "email string, name string, groups string"
    users = spark.read.csv(path, header=True, schema=schema) if kind == "csv" else spark.read.json(path, schema=schema, multiLine=kind == "json")
    present = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    listed = F.coalesce(F.from_json("groups", "array<string>", {"mode": "PERMISSIVE"}), F.split("groups", ";"))
    groups = F.filter(F.transform(listed, lambda g: F.trim(g)), lambda g: g != "")
    return users.where(present("email") & present("name")).select("email", "name", F.explode_outer(groups).alias("group_name"))
