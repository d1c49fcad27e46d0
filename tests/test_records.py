"""Goldens of the record, merge, rule and storage operators."""

import csv
import io
import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperfold.operators import expand, merge, nested, record
from paperfold.operators import rules as rl
from paperfold.operators.constraints import apply_post_rules
from paperfold.sources import readers as rd
from paperfold.sources import sinks as sk

CELL = "doc int, field_key string, value string, confidence double, page_number int, bbox array<double>"


def test_canonical_record(spark):
    fields = [record.Field("total", "number"), record.Field("bad", "number"), record.Field("absent"), record.Field("items", "table"), record.Field("broken", "array")]
    box = [20.0, 40.0, 60.0, 80.0]
    cells = spark.createDataFrame([
        (1, "total", "1234.56", 0.9, 2, box), (1, "bad", "not a number", 0.9, 1, box), (1, "stray", "x", 0.9, 1, None), (1, "items", '[{"a": 1}, {"a": null}]', 0.5, None, None),
        (1, "broken", "[1,", 0.5, 1, [5.0, 5.0, 5.0, 9.0])], CELL)
    pages = spark.createDataFrame([(1, 2, 200.0, 400.0)], "doc int, page_number int, width double, height double")
    out = record.canonical_record(spark.range(1, 2).select(F.col("id").cast("int").alias("doc")), "doc", cells, fields, pages)
    assert out.columns == ["doc", "field_key", "value", "original_value", "confidence", "bbox", "page_number", "validation_status"]
    out = {r.field_key: r for r in out.withColumn("kind", F.schema_of_variant("value")).withColumn("value", F.to_json("value")).collect()}
    assert set(out) == {"total", "bad", "absent", "items", "broken"}
    assert (out["total"].value, out["total"].kind, out["total"].original_value, out["total"].bbox) == ("1234.56", "DOUBLE", "1234.56", [10.0, 10.0, 30.0, 20.0])
    assert out["bad"].validation_status == "error_type_mismatch" and out["bad"].value == '"not a number"'
    assert out["bad"].bbox == box  # page of unknown size, neither inches nor pixels: percent as they are
    assert out["items"].value == '[{"a":1},{"a":null}]' and out["items"].validation_status == "valid"
    assert out["broken"].validation_status == "error_json_format" and out["broken"].bbox is None
    assert out["absent"].value is None and out["absent"].confidence == 0 and out["absent"].validation_status == "valid"


def test_quoted_line_breaks_across_splits(spark, tmp_path):
    rnd = random.Random(8)
    cells = ["a", "", "x,y", 'say "hi"', "two\nlines", "\n", '"', '",\n"', "é", "plain text " * 3, 'in"side', "end\n"]
    files = {f"f{k}.csv": [[str(i), rnd.choice(cells), rnd.choice(cells)] for i in range(n)] for k, n in enumerate([1, 60, 120])}
    files["long.csv"] = [["0", "line\n" * 200, "x"], ["1", "", "y"]]
    for name, rows in files.items():
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as out:
            csv.writer(out, lineterminator="\n").writerows(rows)
    (tmp_path / "stray.csv").write_text('0,5" pipe,a "quoted" word\n1,"open,\nend",z\n2,x\r\n3,"no end\nof it\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        raw = rd.csv_records(spark, str(tmp_path)).collect()
        got = rd.read_encoded_csv(spark, str(tmp_path / "f*.csv"), T.StructType([T.StructField(c, T.StringType()) for c in "abc"])).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = {}
    for r in raw:
        found.setdefault(r.file.rsplit("/", 1)[1], []).append(bytes(r.raw).decode())
    for name, rows in files.items():
        assert sorted(next(csv.reader(io.StringIO(x, newline=""))) for x in found[name]) == sorted(rows), name
    assert sorted(found["stray.csv"]) == ['0,5" pipe,a "quoted" word', '1,"open,\nend",z', "2,x\r", '3,"no end\nof it']
    want = [(a, b or None, c or None) for name, rows in files.items() if name != "long.csv" for a, b, c in rows]
    assert sorted(((r.a, r.b, r.c) for r in got), key=str) == sorted(want, key=str)


def test_user_lists(spark, tmp_path):
    (tmp_path / "u.csv").write_text("email,name,groups\na@x,A,g1; g2;\n,B,g1\nc@x, ,g1\nd@x,D,\n")
    (tmp_path / "u.json").write_text(json.dumps([{"email": "a@x", "name": "A", "groups": ["g1", " g2 ", ""]}, {"email": "b@x", "name": "B", "groups": "g3;g4"}, {"name": "C"}, {"email": "d@x", "name": "D"}]))
    rows = lambda kind: sorted(((r.email, r.name, r.group_name) for r in rd.read_users(spark, str(tmp_path / f"u.{kind}"), kind).collect()), key=str)
    assert rows("csv") == [("a@x", "A", "g1"), ("a@x", "A", "g2"), ("d@x", "D", None)]
    assert rows("json") == [("a@x", "A", "g1"), ("a@x", "A", "g2"), ("b@x", "B", "g3"), ("b@x", "B", "g4"), ("d@x", "D", None)]


def test_response_keys_that_nobody_expected(spark):
    rows = [(1, '{"data": {"total": {"value": "5", "confidence": 0.4}, "note": {"answer": "n"}, "odd": {"x": 1}, "flag": true, "list": [1, 2]}}'),
            (2, '[{"total": 3, "data": {"total": 9}}]'), (3, "no json"), (4, None), (5, "[]"), (6, '{"result": [{"port": "Busan"}]}')]
    out = record.normalise_response(spark.createDataFrame(rows, "id int, body string"), "body", ["total"], "id").collect()
    got = {(r.id, r.field_key): (r.value, r.confidence, r.source_text) for r in out}
    assert got == {
        (1, "total"): ("5", 0.4, ""), (1, "note"): ("n", 0.7, ""), (1, "odd"): (None, 0.7, ""), (1, "flag"): ("true", 0.7, "true"), (1, "list"): ("[1,2]", 0.7, "[1,2]"),
        (2, "total"): ("3", 0.7, "3"), (2, "data"): (None, 0.7, ""), (6, "port"): ("Busan", 0.7, "Busan")}


def test_merge_does_not_depend_on_order_or_partitions(spark):
    rnd = random.Random(4)
    rows = [(d, c, k, rnd.choice([None, "a", "b"]), rnd.choice([0.2, 0.5, 0.5, 0.9])) for d in range(4) for c in range(6) for k in "xyz"]
    want = None
    for parts in (1, 3, 7):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id int, chunk_index int, field_key string, value string, confidence double").repartition(parts)
        got = (sorted(map(str, merge.best_confidence(df).collect())), sorted(map(str, merge.first_non_null(df).collect())))
        want = want or got
        assert got == want
    # one pass in chunk order: replace a null by a value, a value by a surer one
    for d in range(4):
        for k in "xyz":
            cur = None
            for _, c, _, v, conf in sorted((r for r in rows if r[0] == d and r[2] == k), key=lambda r: r[1]):
                if cur is None or (cur[0] is None and v is not None) or (v is not None and conf > cur[1]):
                    cur = (v, conf, c)
            row = [x for x in want[0] if f"doc_id={d}," in x and f"field_key='{k}'" in x]
            assert row == [f"Row(doc_id={d}, field_key='{k}', value={cur[0]!r}, confidence={cur[1]}, chunk_index={cur[2]})"]


def test_duplicate_rows_and_keys(spark):
    rows = [(1, 0, "THC", "Shanghai", "TEST1234567"), (1, 1, "thc ", "Shanghai", "TEST1234567"), (1, 2, "DOC", "Busan", "TEST1234567")]
    df = spark.createDataFrame(rows, "doc int, row_idx int, charge_code string, port string, container_no string")
    df = df.withColumn("key", F.concat_ws("|", F.lower(F.trim("container_no")), F.lower(F.trim("charge_code"))))
    out = merge.duplicate_flag(df, ["doc", "key"], ["row_idx"])
    assert [r.is_duplicate for r in out.orderBy("row_idx").collect()] == [False, True, False]


def test_row_keys_take_the_model_spelling_and_the_last_value(spark):
    cells = spark.createDataFrame([("t", 0, 0, "charge_type", "first"), ("t", 1, 0, "Charge_Type", "OFR"), ("t", 1, 1, "chargeType", "OFR_Dup"), ("t", 1, 2, "Unknown_Field", "u")],
                                  "tab string, row int, pos int, key string, value string")
    out = {(r.row, r.key): r.value for r in record.align_keys(cells, "tab", "row", "key", "pos", "value").collect()}
    assert out == {(0, "charge_type"): "first", (1, "charge_type"): "OFR_Dup", (1, "Unknown_Field"): "u"}


def test_masking_leaves_no_personal_value(spark):
    paths = ["name", "name.value", "guide_extracted.name.value", "people[3].phone", "guide_extracted.people.value[0].phone.value", "people[0].role"]
    df = spark.createDataFrame([(p, "secret") for p in paths] + [("name", ""), ("name", None)], "path string, value string")
    out = [(r.path, r.value) for r in record.mask_cells(df, ["name", "people.*.phone"]).collect()]
    assert [v for p, v in out[:6]] == ["***"] * 5 + ["secret"] and out[6][1] == "" and out[7][1] is None


def test_offload_and_hydrate_round_trip(spark):
    rnd = random.Random(8)
    text = lambda: rnd.choice([None, "x" * rnd.randrange(80)])
    rows = [(i, text(), text(), text()) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, debug string, extracted string, preview string")
    parts = ["debug", "extracted", "preview"]
    marked = sk.offload(df, "id", parts, 60)
    main, side = sk.main_table(marked, "id", parts), sk.payload_table(marked, "id", parts)
    kept = main.select((sum((F.coalesce(F.length(p), F.lit(0)) for p in parts), F.lit(0)) <= 60).alias("ok"))
    assert kept.where(~F.col("ok")).count() == 0 and side.count() > 0
    back = sk.hydrate(main, side, parts).select("id", *parts)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_post_rules(spark):
    df = spark.createDataFrame([("USD 1602",), ("1,602.5 eur",), ("n/a",), (" ",), (None,)], "v string")
    out = apply_post_rules(df, "v", ["split_currency", "extract_digits"]).collect()
    assert [(r.v, r.modifier, r.modified_from) for r in out] == [
        ("1602", "Rule: Split Currency", "USD 1602"), ("1602.5", "Rule: Extract Digits", "1,602.5"), ("", "Rule: Extract Digits", "n/a"), (" ", None, None), (None, None, None)]


def test_group_expansion(spark):
    ports = ["Busan", "Jebel Ali", "Shanghai", "Ningbo", "Qingdao", "Tianjin", "Dalian"]
    df = spark.createDataFrame([(1, "AS1 group", "?", None), (2, "other", "?", "keep"), (3, None, "?", None)], "id int, grp string, port string, code string")
    out = expand.expand_group_codes(df, [expand.ExpandRule("grp", "as1", "port", ports, ["KRPUS"], "code")]).orderBy("id", "port").collect()
    assert len(out) == 9 and {r.port for r in out if r.id == 1} == set(ports)
    assert [(r.port, r.code) for r in out if r.code] == [("Busan", "KRPUS"), ("?", "keep")]


def test_rule_audit(spark):
    df = spark.createDataFrame([(1, 4.0)], "id int, q double")
    out, audit = rl.apply_rules(df, [rl.Rule("a", "CALCULATE", {"field": "q", "expression": "q + 1"}), rl.Rule("b", "CALCULATE", {"field": "q", "expression": "nope"}),
                                     rl.Rule("c", "SHRINK"), rl.Rule("d", "VALIDATE", {"check": "q > 9"}, enabled=False), rl.Rule("e", "VALIDATE", {"check": "q > 9"})])
    assert [(r.rule, r.outcome) for r in audit.collect()] == [("a", "applied"), ("b", "failed"), ("c", "failed"), ("d", "disabled"), ("e", "applied")]
    row = out.first()
    assert row.q == 5.0 and [e["check"] for e in row.validation_errors] == ["q > 9"]


def test_deep_flatten(spark):
    df = spark.sql("""select 1 as id, array(named_struct('k', 'a', 'xs', array(1, 2)), named_struct('k', 'b', 'xs', array())) as rows,
        named_struct('value', array('p')) as tags, named_struct('n', named_struct('value', 7)) as obj""")
    out = nested.deep_flatten(df).orderBy("_path").collect()
    assert [(r["id"], r["rows.k"], r["rows.xs"], r["tags"], r["obj.n"], r["_path"]) for r in out] == [
        (1, "a", 1, "p", 7, [0, 0]), (1, "a", 2, "p", 7, [0, 1]), (1, "b", None, None, 7, [1])]


def test_search_text(spark):
    body = '{"a": {"b": ["x  y", 1.50, null, {"c": "q\\"z: "}]}, "t": true, "k:": "v:"}'
    assert spark.createDataFrame([(body,)], "j string").select(nested.search_text(F.col("j"))).first()[0] == 'x y 1.5 q"z: true v:'


def test_attachment_layers(spark):
    import base64

    pdf = b"%PDF-1.7 \xff\x00 body"
    one = base64.b64encode(pdf)
    texts = [one.decode(), "data:application/pdf;base64," + one.decode(), base64.urlsafe_b64encode(pdf).decode().rstrip("="),
             base64.b64encode(one).decode(), base64.b64encode(base64.b64encode(one)).decode()]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, body string")
    assert [bytes(r.data) for r in rd.decode_attachment(df, "body", "data").orderBy("i").collect()] == [pdf] * 5
    plain = spark.createDataFrame([(base64.b64encode(b"aGVsbG8gd29ybGQ=").decode(),)], "body string")
    assert bytes(rd.decode_attachment(plain, "body", "data").first().data) == b"aGVsbG8gd29ybGQ="
