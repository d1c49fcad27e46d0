"""What users write must not end a run."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperfold.operators.constraints import constraint_status, is_pattern
from paperfold.operators.fuzzy import contained, match_dictionary
from paperfold.operators.rules import Rule, apply_rules


def test_failing_expressions_leave_values(spark):
    rows = spark.createDataFrame([(1, 0, "7"), (4, 2, "x")], "a int, b int, s string")
    rules = [Rule("division", "CALCULATE", {"field": "a", "expression": "cast(a / b as int)"}), Rule("cast", "CALCULATE", {"field": "s", "expression": "cast(cast(s as int) + 1 as string)"}),
             Rule("check", "VALIDATE", {"check": "b / b = 1"}), Rule("unknown", "CALCULATE", {"field": "a", "expression": "nothing"})]
    before = spark.conf.get("spark.sql.ansi.enabled")
    out, audit = apply_rules(rows, rules)
    assert [(r.a, r.s, len(r.validation_errors)) for r in out.collect()] == [(1, "8", 1), (2, "x", 0)]
    assert [r.outcome for r in audit.collect()] == ["applied", "applied", "applied", "failed"] and spark.conf.get("spark.sql.ansi.enabled") == before


def test_bad_pattern_checks_nothing(spark):
    assert not is_pattern("[") and is_pattern("[a]")
    row = spark.createDataFrame([("b",)], "v string").select(constraint_status(F.col("v"), "string", pattern="[").alias("x"), constraint_status(F.col("v"), "string", pattern="[a]").alias("y")).first()
    assert tuple(row) == ("valid", "error_format_invalid")


def test_containment_pairs(spark):
    words = [f"{a}{b}{c}" for a in ("no", "la", "x") for b in ("", "ri", "to q") for c in ("s", "", "ne")]
    needles = spark.createDataFrame([(w,) for w in [*words, "o", "zz", ""]], "v string")
    hays = spark.createDataFrame([(w * 2,) for w in words], "w string")
    got = {(r.needle, r.hay) for r in contained(needles, hays).collect()}
    assert got == {(n, h) for n in [*words, "o"] for h in {w * 2 for w in words} if n and n in h}


def test_candidates_grow_with_the_input(spark):
    """Twice the values against twice the entries: about twice the pairs."""
    def pairs(n):
        values = spark.range(n).select(F.concat(F.lit("item "), F.sha1(F.col("id").cast("string")), F.lit(" new")).alias("v"))
        entries = spark.range(n).select(F.sha1(F.col("id").cast("string")).alias("w"))
        return contained(entries, values).count()

    assert (pairs(1000), pairs(2000)) == (1000, 2000)


def test_dictionary_order(spark):
    entries = spark.createDataFrame([("b", "x1", "blue pen", 1), ("a", "x2", "pen", 2), ("a", "pe", "other", 1)], "category string, code string, name string, entry_no bigint")
    values = spark.createDataFrame([("a blue pen",), ("PEN",), ("pe",), ("zz",)], "value string")
    got = {r.value: (r.category, r.entry_no, r.score) for r in match_dictionary(values, entries, fuzzy=False).collect()}
    assert got == {"a blue pen": ("a", 2, 0.85), "PEN": ("a", 2, 1.0), "pe": ("a", 1, 1.0)}


BIG = 2**63 - 1


@pytest.mark.parametrize(("expression", "want"), [
    ("i + 1", None), ("i * i", None), ("-i - 2", None), ("i - 1", 2**31 - 2), ("b + 1", None), ("b * 2", None), ("-b - 2", None), ("b - 1", BIG - 1), ("b % 10", 7), ("b div 2", BIG // 2),
    ("cast(b as int)", None), ("cast(i as smallint)", None), ("i div z", None), ("z div i", 0), ("i % z", None), ("cast(s as int)", None), ("cast('12' as int) + z", 12), ("b & 1", 1),
    ("abs(-b)", BIG), ("s.x", "no field"), ("length(s) + z", 3), ("xxhash64(z) * 0", 0), ("coalesce(i + 1, 5)", "bigger"), ("`i` - 1", 2**31 - 2), ("size(l) + z", 2), ("l[z]", 4), ("l[0] + i", 4 + 2**31 - 1),
])
def test_numbers_never_wrap(spark, expression, want):
    df = spark.createDataFrame([(2**31 - 1, BIG, 0, "a+b", [4, 5])], "i int, b bigint, z int, s string, l array<int>")
    for field, kind in (("i", 32), ("b", 64)):
        out, audit = apply_rules(df, [Rule("r", "CALCULATE", {"field": field, "expression": expression})])
        got, told = out.first()[field], audit.first()
        if want == "no field":
            assert told.outcome == "failed" and got == df.first()[field]
            continue
        value = 2**31 if want == "bigger" else want
        value = value if value is not None and abs(value) < 2 ** (kind - 1) else None
        if field == "b" and expression in ("i + 1", "i * i", "-i - 2"):
            value = {"i + 1": 2**31, "i * i": (2**31 - 1) ** 2, "-i - 2": -(2**31) - 1}[expression]
        assert (got, told.outcome, told.unchanged) == (df.first()[field] if value is None else value, "applied", int(value is None)), expression


def test_floating_numbers_and_texts(spark):
    df = spark.createDataFrame([(3, 2.5, "x", dt.date(2024, 1, 31))], "n int, d double, t string, day date")
    out, audit = apply_rules(df, [
        Rule("half", "CALCULATE", {"field": "half", "expression": "n / 2"}), Rule("sum", "CALCULATE", {"field": "d", "expression": "d + n"}),
        Rule("text", "CALCULATE", {"field": "t", "expression": "concat(t, ' n ', cast(n as string), \"n\")"}), Rule("date", "CALCULATE", {"field": "day", "expression": "date_add(day, n)"}),
        Rule("unit", "CALCULATE", {"field": "later", "expression": "day + interval 2 day"}), Rule("pick", "CALCULATE", {"field": "n", "expression": "n + 1", "condition": "n / 0 > 1"}),
    ])
    r = out.first()
    assert (r.half, r.d, r.t, r.day, r.n) == (1.5, 5.5, "x n 3n", dt.date(2024, 2, 3), 3) and str(r.later)[:10] == "2024-02-05"
    assert [(a.rule, a.outcome, a.unchanged) for a in audit.collect()] == [(x, "applied", 0) for x in ("half", "sum", "text", "date", "unit", "pick")]


def test_calculations_on_list_items(spark):
    """Rates of all combinations of ports, raised where the port says so; an item's fields come before the record's."""
    rows = [("K1", ["Busan", "Incheon"], ["Rotterdam"], 100, 7), ("K2", [], ["x"], 1, 7), ("K3", None, ["x"], 1, 7), ("K4", ["Incheon"], ["a", "b"], 2147483647, 0)]
    df = spark.createDataFrame(rows, "carrier string, pols array<string>, pods array<string>, base int, pol int")
    rules = [
        Rule("all", "EXPLODE", {"sources": {"pols": "pol", "pods": "pod", "carrier": "line"}, "preserve": ["base"], "output": "rates"}),
        Rule("rate", "CALCULATE", {"target_list": "rates", "field": "rate", "expression": "base"}),
        Rule("raise", "CALCULATE", {"target_list": "rates", "field": "base", "expression": "base + 50", "condition": "pol = 'Incheon'"}),
        Rule("after", "CALCULATE", {"target_list": "rates", "field": "twice", "expression": "rates[0].base * 0 + base * 2"}),
        Rule("none", "CALCULATE", {"target_list": "base", "field": "x", "expression": "1"}),
        Rule("whole", "VALIDATE", {"check": "len(rates) = len(pols) * len(pods)", "message": "count"}),
    ]
    out, audit = apply_rules(df, rules)
    got = {r.carrier: ([tuple(x) for x in r.rates], len(r.validation_errors)) for r in out.collect()}
    assert got["K1"] == ([("Busan", "Rotterdam", "K1", 100, 100, 200), ("Incheon", "Rotterdam", "K1", 150, 100, 300)], 0)
    assert got["K2"] == ([], 0) and got["K3"] == ([], 1)
    assert got["K4"][0] == [("Incheon", p, "K4", 2147483647, 2147483647, 4294967294) for p in "ab"]
    assert {a.rule: (a.outcome, a.unchanged) for a in audit.collect()} == {
        "all": ("applied", None), "rate": ("applied", 0), "raise": ("applied", 2), "after": ("applied", 0), "none": ("failed", None), "whole": ("applied", None)}
