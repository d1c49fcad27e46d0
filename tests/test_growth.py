"""Steps that grew faster than their input: what they may still do, seen in plans and small tables."""

import random
import time

import pandas as pd
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from paperfold.catalog import shapes
from paperfold.catalog.registry import REGISTRY
from paperfold.functions.text import is_entity
from paperfold.operators import fuzzy, rules, tables_text
from paperfold.plans import segments
from paperfold.sources import readers
from paperfold.sources.tables import Tables


@pytest.fixture
def plan(spark, capsys):
    """The physical plan of a table where nothing is small enough to be sent to all tasks, or as set."""
    def show(make, threshold="-1"):
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            capsys.readouterr()
            make().explain()
            return capsys.readouterr().out
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

    return show


def test_passages_are_not_sent_to_every_task(spark, plan):
    targets = spark.createDataFrame([(1, 1, "some passage", None), (2, 2, "other", 0)], "target_id int, doc_id int, t string, page int")
    refs = spark.createDataFrame([(1, 0, 0, "some passages"), (1, 1, 1, "x"), (2, 0, 0, "mother"), (2, 1, 1, "other")],
                                 "doc_id int, ref_no int, page_no int, r string")
    for partial in (False, True):
        assert "Broadcast" not in plan(lambda: fuzzy.passage_candidates(targets, refs, 0.9, partial), "10m")
    pairs = lambda partial: {(r.target_id, r.ref_no) for r in fuzzy.passage_candidates(targets, refs, 0.9, partial).collect()}
    assert pairs(False) == {(1, 0), (2, 0)}
    assert pairs(True) == {(1, 0), (1, 1), (2, 0)}


def test_words_meet_the_values_of_their_own_document(spark, plan):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    words, cells = [], []
    for doc in range(12):
        for page in range(7):
            words += [(doc, page, 700 * k, word()) for k in range(6)]
        cells += [(100 * doc + k, doc, word(), rng.choice([None, 0, 3, 9])) for k in range(5)]
    w = spark.createDataFrame(words, "doc_id int, page_no int, start long, word string")
    c = spark.createDataFrame(cells, "cell_id int, doc_id int, value string, page int")
    assert "Join [word" not in plan(lambda: fuzzy.locate_values(c, w))
    got = {r.cell_id: (r.page_no, r.start, r.word, r.tier) for r in fuzzy.locate_values(c, w).collect()}
    expected = {}
    for cell, doc, value, page in cells:
        found = [((page is not None and p != page, p, int(x != value), s), (p, s, x, int(x != value))) for d, p, s, x in words
                 if d == doc and (x == value or len(x) > 1 and (x in value or value in x))]
        if found:
            expected[cell] = min(found)[1]
    assert got == expected


def best_place(value, page, words):
    """(page_no, start, word, tier) by comparing a value with all words (page_no, start, word) of its document."""
    found = [(page is not None and p != page, p, int(x != value), s, x) for p, s, x in words
             if x == value or len(x) > 1 and value and (x in value or value in x)]
    return (lambda _, p, tier, s, x: (p, s, x, tier))(*min(found)) if found else None


def test_words_and_cells_move_once(spark, plan):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcé한") for _ in range(rng.choice([1, 2, 3, 40])))
    words = [(rng.choice([1, 2, None]), rng.randint(0, 9), 10 * k, word()) for k in range(300)]
    cells = [(k, rng.choice([1, 2, 3, None]), rng.choice([word(), None, ""]), rng.choice([None, 0, 4, 99])) for k in range(60)]
    w = spark.createDataFrame(words * 2, "doc_id bigint, page_no int, start long, word string").repartition(3)
    c = spark.createDataFrame(cells * 2, "cell_id int, doc_id int, value string, page int").repartition(2)
    text = plan(lambda: fuzzy.locate_values(c.coalesce(1), w.coalesce(1)))
    # words and cells by document, results by cell; no list of words is made of rows
    assert text.count("Exchange hashpartitioning") == 3 and "collect_" not in text
    out = fuzzy.locate_values(c, w)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [
        ("cell_id", "int"), ("doc_id", "int"), ("value", "string"), ("word", "string"), ("page_no", "int"), ("start", "bigint"), ("tier", "int")]
    expected = {}
    for cell, doc, value, page in cells:
        if doc is not None and value is not None and (top := best_place(value, page, [x[1:] for x in words if x[0] == doc])):
            expected[cell] = (doc, value, *top)
    rows = out.collect()
    assert {r.cell_id: (r.doc_id, r.value, r.page_no, r.start, r.word, r.tier) for r in rows} == expected and len(rows) == len(expected) > 10


@pytest.mark.parametrize("seed,block,at_once,kept,long", [(1, 30, 3, 20, 4), (2, 1 << 14, 1 << 16, 1 << 18, 32), (3, 1, 1 << 16, 0, 0)])
def test_blocks_of_words_keep_every_place(monkeypatch, seed, block, at_once, kept, long):
    for name, value in (("BYTES_PER_BLOCK", block), ("CELLS_AT_ONCE", at_once), ("PARTS_KEPT", kept), ("LONG_VALUE", long)):
        monkeypatch.setattr(fuzzy, name, value)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab\n\0é한") for _ in range(rng.choice([0, 1, 1, 2, 3, 7])))
    words = [(rng.randint(0, 4), rng.choice([0, 1, 2, 7, -3]), rng.randint(0, 60), word()) for _ in range(400)]
    cells = [(rng.randint(0, 5), k, word(), rng.choice([None, 0, 2, 5])) for k in range(120)]
    if seed == 2:
        words.sort()

    def packed(pack, rows, names):
        batches = (pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k:k + 90]]) for k in range(0, len(rows), 90))
        return pa.Table.from_batches(list(pack(batches)))

    blocks = packed(fuzzy._packed_words, words, ["doc_id", "page_no", "start", "word"])
    lists = packed(fuzzy._packed_cells, cells[:60] * 2 + cells, ["doc_id", "cell_id", "value", "page"])
    assert sum(map(len, lists["cells"].to_pylist())) < 240
    pairs = sorted(((i, j) for i, d in enumerate(blocks["doc_id"].to_pylist()) for j, e in enumerate(lists["doc_id"].to_pylist()) if d == e),
                   key=lambda x: (blocks["doc_id"][x[0]].as_py(), x))
    left, right = (pa.array(x) for x in zip(*pairs, strict=True))
    joined = pa.table({"doc_id": blocks["doc_id"].take(left), "cells": lists["cells"].take(right), "block": blocks["block"].take(left)})
    got: dict[int, tuple] = {}
    for batch in fuzzy._best_of_words(iter(joined.combine_chunks().to_batches(max_chunksize=7))):
        for r in batch.to_pylist():
            order = (r["page"] is not None and r["page_no"] != r["page"], r["page_no"], r["tier"], r["start"], r["word"])
            got[r["cell_id"]] = min(got.get(r["cell_id"], order), order)
    expected = {cell: best_place(value, page, [x[1:] for x in words if x[0] == doc]) for doc, cell, value, page in cells}
    assert {cell: (p, start, x, tier) for cell, (_, p, tier, start, x) in got.items()} == {k: v for k, v in expected.items() if v}
    assert 10 < len(got) < len(cells)


def test_only_words_that_can_be_tagged_are_placed_among_claims(spark, folder, monkeypatch):
    seen = []
    unclaimed = shapes.spans.unclaimed_words
    monkeypatch.setattr(shapes.spans, "unclaimed_words", lambda words, claims: seen.append((words, claims)) or unclaimed(words, claims))
    t = Tables(spark, str(folder))
    REGISTRY["e36_tagged_text"].build(t)
    words, claims = seen[0]
    assert words.where(is_entity(F.col("word"))).count() == words.count() > 0
    assert claims.join(t.documents, "doc_id", "left_anti").count() == 0


def test_extractor_reads_a_text_once():
    plain = regex.compile(rules.PAIR_TEXT)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab_é1  \t\r\n:=.;-") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    run = lambda texts: next(rules.key_value_extractor(iter([pd.DataFrame(
        {"doc_id": range(len(texts)), "chunk_index": 0, "content": texts})])))
    got = run(texts)
    expected = [(n, k.strip(" ").lower(), v.strip(" ")) for n, text in enumerate(texts) for k, v in plain.findall(text)]
    assert list(zip(got["doc_id"], got["field_key"], got["value"])) == expected
    before = time.perf_counter()
    assert run(["a " * 60_000 + ". key: v"])["value"].tolist() == ["v"]
    assert time.perf_counter() - before < 5


def test_similar_words_cut_only_what_is_asked(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "_grams", lambda words: pytest.fail("all pieces of all words"))
    values = spark.createDataFrame([("extraction",), ("a",)], "value string")
    words = spark.createDataFrame([("extractions",), ("extractoin",), ("ex",), ("a",), ("unrelated",)], "word string")
    assert {(r.value, r.word) for r in fuzzy.similar_words(values, words).collect()} == {
        ("extraction", "extractions"), ("extraction", "extractoin"), ("a", "a")}


def test_tasks_grow_with_the_rows(spark, monkeypatch, plan):
    monkeypatch.setattr(segments, "ROWS_PER_TASK", 20)
    rows = [(k % 3, k, "x" if k % 3 else " ") for k in range(600)]
    df = spark.createDataFrame(rows, "k int, id int, v string")
    assert segments.tasks_for(df) == 30
    out = tables_text.text_lines(df, ["k"], ["id"], ["id", "v"])
    lines = {(r.k, r.position): r.line for r in out.collect()}
    assert len(lines) == 606 and lines[0, 0] == "|---|" and lines[1, -1] == "| id | v |"
    assert lines[1, 1] == "| 1 | x |" and lines[0, 200] == "| 597 |"
    assert plan(lambda: tables_text.text_lines(df, ["k"], ["id"], ["id", "v"])).count("Join [") == 1


def test_merged_cells_are_joined_once(spark, plan):
    cells = spark.createDataFrame([(1, r, c, "v" if r == 1 else "") for r in range(4) for c in range(4)] + [(None, r, 0, "v" if r == 1 else "") for r in range(4)],
                                  "t int, r int, c int, v string")
    assert plan(lambda: tables_text.carry_merged(cells, "t", "r", "c", "v")).count("Join [") == 1
    got = {(x.t, x.r, x.c): x.v for x in tables_text.carry_merged(cells, "t", "r", "c", "v").collect()}
    assert [got[1, 3, c] for c in range(4)] == ["v", "v", "v", ""] and got[None, 3, 0] == "" and len(got) == 20


def test_attachment_layers_are_decoded_only_where_needed(spark, plan):
    df = spark.createDataFrame([("JVBERi0xLjQ",), ("data:x,JVBERi0xLjQ=",), (None,)], "sent string")
    text = plan(lambda: readers.decode_attachment(df, "sent", "data"))
    assert "translate(" not in text and "CASE WHEN NOT coalesce(" in text
    assert [r.data and bytes(r.data) for r in readers.decode_attachment(df, "sent", "data").collect()] == [b"%PDF-1.4", b"%PDF-1.4", None]


def test_segments_deal_rows_out_once(spark, plan):
    df = spark.createDataFrame([(1, 1), (None, 2), (None, 3)], "k int, at int")
    calc = lambda: segments.segmented(df, ["k"], ["at"], [F.floor(F.col("at") / 2)], [segments.prefix_sum(F.col("at"), "s")])
    # rows, summary by segment, summary by key, summary back to its segment
    assert plan(calc).count("Exchange hashpartitioning") == 4
    assert {(r.k, r.at, r.s) for r in calc().collect()} == {(1, 1, 0), (None, 2, 0), (None, 3, 2)}


def test_entries_of_equal_words_are_one_candidate(spark, monkeypatch):
    kept, written = {}, fuzzy.written
    monkeypatch.setattr(fuzzy, "written", lambda df, label: kept.setdefault(label, written(df, label)))
    entries = spark.createDataFrame([("c", f"{k:03}", "green steel" if k % 2 else "steel green") for k in range(50)] + [("c", "900", "red tin")],
                                    "category string, code string, name string")
    cells = spark.createDataFrame([(1, "green steel", "c"), (2, "tin red", "c"), (3, "none here", "c")], "id int, value string, category string")
    got = {r.id: r.normalized_code for r in fuzzy.normalise_fields(cells, entries).collect()}
    assert got == {1: "000", 2: "900", 3: None}
    assert kept["entry-words"].count() == 2
