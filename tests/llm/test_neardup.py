import re

import numpy as np
import pytest

from paperfold.llm import components, neardup
from paperfold.llm.queries import QUERIES, SQL
from tests.llm.helpers import ODD, table, texts


def brute(rows, width):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_chains_of_copies(spark, width):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for _ in range(5):
        text = list(rng.choice(words, 90))
        for _ in range(14):
            rows.append((i, " ".join(text)))
            text = list(text)
            for k in rng.integers(0, 90, 4):
                text[k] = str(rng.choice(words))
            i += 1
    rows += [(i + k, " ".join(rng.choice(words, 30))) for k in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table(spark, rows), width).collect()}
    assert got == brute(rows, width)


def test_odd_rows(spark):
    got = sorted(neardup.near_duplicates(table(spark, ODD), 2).collect(), key=str)
    assert len(got) == len(ODD)
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got}
    assert found == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (None, 1, None, True), (7, 2, 7, True), (8, 2, 7, False)}
    assert neardup.near_duplicates(table(spark, []), 2).count() == 0


def test_against_sql(spark, con, folder):
    got = sorted(tuple(r) for r in QUERIES["op2_near_duplicates"](spark, str(folder)).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == sorted(con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({SQL['op2_near_duplicates']})").fetchall())
    assert len(got) == len(texts(folder))


def test_sketches_estimate(spark):
    """The XOR of two sketches has about the bits expected, and no pair at the threshold exceeds the limit."""
    rng = np.random.default_rng(1)
    base = [f"t{k}" for k in range(400)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):  # single changed words: about two shingles each
        text = list(base)
        for p in rng.choice(400, 20, replace=False):
            text[p] = f"x{k}-{p}"
        rows.append((k, " ".join(text)))
    signed = {r.doc_id: r.sketch for r in neardup.signatures(table(spark, rows), 2).collect()}
    bits = [sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(signed[0], signed[k], strict=True)) for k in range(1, 60)]
    assert max(bits) <= neardup.sketch_limit(0.8)
    assert 25 < np.mean(bits) < 60


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0
