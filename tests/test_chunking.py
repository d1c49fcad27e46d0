"""Packing against a plain Python fold, with blocks small enough to matter."""

import random
import re

import pytest

from pyspark.sql import functions as F

from paperfold.operators import chunking as ch


def fold(sizes, limit):
    out, used, chunk, empty = [], 0, 0, True
    for s in sizes:
        if used + s > limit and not empty:
            chunk, used = chunk + 1, 0
        used, empty = used + s, False
        out.append(chunk)
    return out


@pytest.mark.parametrize("block", [2, 8, 4096])
def test_packing_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ch, "BLOCK", block)
    rnd = random.Random(5)
    docs = {d: [rnd.choice([0, 0, 1, 3, 7, 20, 60, 150]) for _ in range(n)] for d, n in enumerate([1, 7, 8, 9, 40, 200, 333])}
    rows = [(d, i, s) for d, sizes in docs.items() for i, s in enumerate(sizes)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc int, page int, size int").repartition(4)
    got = {(r.doc, r.page): r.chunk_index for r in ch.assign_chunks(df, "doc", "page", "size", 100).collect()}
    assert len(got) == len(rows)
    for d, sizes in docs.items():
        assert [got[d, i] for i in range(len(sizes))] == fold(sizes, 100), d


def test_overheads_and_gaps(spark, monkeypatch):
    """Positions with gaps, text ids, overheads beyond the limit, a whole document of nothing."""
    rnd = random.Random(9)
    docs = {f"d{n}": [(rnd.choice([0, 5, 30, 200]), rnd.choice([0, 0, 10, 90, 150])) for _ in range(n)] for n in (1, 5, 6, 30, 170)}
    docs["zero"] = [(0, 0)] * 40
    rows = [(d, 3 * i + 7, s, x) for d, pieces in docs.items() for i, (s, x) in enumerate(pieces)]
    df = spark.createDataFrame(rows, "doc string, page bigint, size int, over int").repartition(3)
    for block in (4, 4096):
        monkeypatch.setattr(ch, "BLOCK", block)
        got = {(r.doc, r.page): r.chunk_index for r in ch.assign_chunks(df, "doc", "page", "size", 100, "over").collect()}
        for d, pieces in docs.items():
            chunk, used, want = 0, pieces[0][0], [0]
            for s, x in pieces[1:]:
                chunk, used = (chunk + 1, x + s) if used + s > 100 else (chunk, used + s)
                want.append(chunk)
            assert [got[d, 3 * i + 7] for i in range(len(pieces))] == want, (d, block)


def test_many_short_pages(spark):
    """Chunks of far more pages than a block holds."""
    df = spark.range(200_000).select((F.col("id") % 2).alias("doc"), F.col("id").alias("page"), (F.col("id") % 11).alias("size"))
    chunks = ch.chunk_table(ch.assign_chunks(df, "doc", "page", "size", 320_000), "doc", "page", "size").orderBy("doc", "chunk_index").collect()
    for doc in (0, 1):
        sizes = [i % 11 for i in range(doc, 200_000, 2)]
        index = fold(sizes, 320_000)
        assert [(c.chunk_index, c.page_count) for c in chunks if c.doc == doc] == [(k, index.count(k)) for k in range(index[-1] + 1)]


def test_chunks_respect_the_limit(spark):
    rows = [(1, i, 30 + i % 50) for i in range(300)]
    df = spark.createDataFrame(rows, "doc int, page int, size int")
    chunks = ch.chunk_table(ch.assign_chunks(df, "doc", "page", "size", 120), "doc", "page", "size").collect()
    assert all(c.est_size <= 120 or c.page_count == 1 for c in chunks)
    assert sum(c.page_count for c in chunks) == 300


def fold_lines(lines, limit):
    """Line packing as one sequential pass: [(chunk, repeated header or None)] per line."""
    divider = re.compile(r"^\|[\s\-:|]+\|$")
    heads = {i: (a, b) for i, (a, b) in enumerate(zip(lines, lines[1:]))
             if a.strip().startswith("|") and b.strip().startswith("|") and "-" in b and divider.match(b.strip())}
    out, used, chunk, empty, head, blanks = [], 0, 0, True, None, 0
    for i, line in enumerate(lines):
        t, prefix = line.strip(), None
        if i in heads:
            head, blanks = heads[i], 0
        elif t.startswith("|"):
            blanks = 0
        elif t:
            head, blanks = None, blanks + 1
        else:
            blanks += 1
            if blanks > 2:
                head = None
        n = len(line) + 1
        if used + n > limit and not empty:
            chunk, used = chunk + 1, 0
            if head:
                prefix = re.sub(r"\^C[0-9A-F]+", "", head[0]) + "\n" + head[1] + "\n"
                used = len(prefix)
        used, empty = used + n, False
        out.append((chunk, prefix))
    return out


def test_line_packing(spark, monkeypatch):
    monkeypatch.setattr(ch, "BLOCK", 16)
    rnd = random.Random(11)
    kinds = ["| a ^C1 | b ^CF |", "|---|:---|", "| 1 | 2 |", "| long cell text here | x |", "", "", "", "free text", "x" * 90]
    docs = {d: [rnd.choice(kinds) for _ in range(n)] for d, n in enumerate([3, 30, 150])}
    docs[9] = ["| h ^C2 | k |", "|---|---|"] + [f"| {i} | v |" for i in range(60)]
    rows = [(d, i, x) for d, lines in docs.items() for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, line string").repartition(3)
    got = {(r.doc_id, r.line_no): (r.chunk_index, r.prefix) for r in ch.pack_lines(df, 100).collect()}
    for d, lines in docs.items():
        assert [got[d, i] for i in range(len(lines))] == fold_lines(lines, 100), d
