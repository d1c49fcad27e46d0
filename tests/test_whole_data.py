"""Nothing is left out: folders as tables, any depth, any length."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from paperfold.catalog import runner
from paperfold.functions.dates import parse_date
from paperfold.operators import nested, tables_text
from paperfold.sources import readers, shared, sinks
from paperfold.sources.shared import new_path
from paperfold.streaming import runs


@pytest.mark.parametrize("name", ["j1_job_state", "j2_retention", "j4_live_trend", "j5", "j7", "j8_synonym_learning"])
def test_streams_read_folders(spark, folder, name):
    from paperfold.catalog import REGISTRY

    name = next(n for n in REGISTRY if n.startswith(name))
    root = new_path(spark, "parts")
    for path in folder.glob("*.parquet"):
        spark.read.parquet(str(path)).repartition(3).write.parquet(f"{root}/{path.name}")
    assert runner(name)(spark, root).count() == runner(name)(spark, str(folder)).count() > 0


def test_a_later_run_goes_on(spark):
    rows, out, state = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "state")
    for k in (1, 2):
        spark.range(10 * k, 10 * k + 5).write.mode("append").parquet(rows)
        stream = runs.stream_folder(spark, rows, "id long", 1)
        got = runs.run_append(stream, "x", out, state)
        assert got.count() == got.distinct().count() == 5 * k


def test_deep_nesting(spark):
    value = F.struct(F.lit(1).alias("v"), F.lit("end").alias("z"))
    for _ in range(12):
        value = F.struct(F.array(value, value).alias("k"))
    flat = nested.deep_flatten(spark.range(1).select(value.alias("a")))
    assert flat.count() == 2**12 and "array" not in str([t for c, t in flat.dtypes if c != "_path"])
    text = '{"value": ' * 9 + '"x"' + "}" * 9
    assert spark.range(1).select(nested.unwrap_json(F.lit(text)).alias("t")).first().t == "x"


def test_long_table_text(spark):
    rows = spark.range(5000).select(F.lit("a").alias("k"), F.col("id"), F.lit(" ").alias("blank"))
    lines = tables_text.text_lines(rows, ["k"], ["id"], ["id", "blank"]).orderBy("position").collect()
    assert [r.line for r in lines[:3]] == ["| id |", "|---|", "| 0 |"] and len(lines) == 5002 and lines[-1].line == "| 4999 |"


def test_long_attachment(spark):
    frame = spark.createDataFrame([("QUJD" * 10,)], "sent string")
    assert bytes(readers.decode_attachment(frame, "sent", "data").first().data) == b"ABC" * 10
    cut = readers.decode_attachment(frame, "sent", "data", max_chars=8).first()
    assert cut.data is None and cut.reject_reason == "too long"


@pytest.mark.parametrize("text, iso", [
    ("2024.1.5", "2024-01-05"), ("2024/12/31 10:00", "2024-12-31"), ("1.5.2024", "2024-01-05"), ("2024년 3월 7일 (목)", "2024-03-07"), (" ", None),
    ("2024-01-05", "2024-01-05"), ("2024. 1. 5", "2024. 1. 5"), ("24.1.5", "24.1.5"), ("x 2024.1.5", "x 2024.1.5"), ("2024년1월123일", "2024년1월123일"), ("2024.1", "2024.1"), ("2024.01.055", "2024-01-05"), ("3월 7일", "3월 7일"),
])
def test_dates(spark, text, iso):
    assert spark.range(1).select(parse_date(F.lit(text)).alias("d")).first().d == iso


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="yarn"))
    with pytest.raises(ValueError):
        shared.shared_dir(session)


def test_scratch_leaves_nothing(spark):
    with shared.scratch(spark):
        kept = shared.written(spark.range(5), "scratch-test")
        assert kept.count() == 5
        path = kept.inputFiles()[0]
    assert not spark._jvm.java.io.File(path.removeprefix("file://")).exists()


def test_versions_of_an_upsert(spark):
    base = new_path(spark, "versions")
    first = spark.createDataFrame([(1, "a", "2001", 30, 1), (2, "b", "2001", None, 1)], "k int, v string, created_at string, ttl int, seq int")
    assert sinks.upsert_into(base, first, "k", "seq") == 1
    second = spark.createDataFrame([(1, "c", "2002", 99, 3), (1, "z", "2002", 98, 2), (3, "d", "2002", 5, 1)], first.schema)
    assert sinks.upsert_into(base, second, "k", "seq") == 2 and sinks.versions(spark, base) == [1, 2]
    assert sorted(tuple(r) for r in sinks.read_version(spark, base).collect()) == [(1, "c", "2001", 30), (2, "b", "2001", None), (3, "d", "2002", 5)]
    assert sinks.read_version(spark, base, 1).count() == 2


def test_cache_grows(spark):
    path, seen = new_path(spark, "cache"), []

    def process(todo):
        seen.append(sorted(r.id for r in todo.collect()))
        return todo.select("id", (F.col("id") * 2).alias("size"))

    for ids, new in (([1, 2], [1, 2]), ([2, 3], [3]), ([1, 3], [])):
        got = readers.extend_cache(spark.createDataFrame([(i,) for i in ids], "id long"), path, "id", process, "id long, size long")
        assert sorted(tuple(r) for r in got.collect()) == [(i, 2 * i) for i in ids] and seen[-1] == new
