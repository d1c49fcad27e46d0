import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from paperfold.llm import listrank, trie
from paperfold.llm.common import prepared
from paperfold.llm.queries import QUERIES, SQL
from tests.oracle import duck
from tests.oracle import table as comparable

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """rows of (conv_id, turn, role, text): the nodes by dictionaries."""
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    said = {c: [x[2:] for x in sorted(v)] for c, v in said.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(said.get(c - c % 100, [])[:h] + said[c][h:])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for t in members:
        if t:
            children[t[:-1]].append(t)
    leaves, saved = defaultdict(int), defaultdict(int)
    for t in members:
        for d in range(len(t) + 1):
            leaves[t[:d]] += not children[t]
            saved[t[:d]] += (len(members[t]) - 1) * len(t[-1][1]) if t else 0
    return sorted(
        (min(m), len(t), min(members[t[:-1]]) if t else None, len(m), len(children[t]), leaves[t], saved[t], hashlib.sha256(",".join(map(str, sorted(ends[t]))).encode()).hexdigest())
        for t, m in members.items()
    )


def frame(spark, rows):
    prepared(spark)
    return spark.createDataFrame([(*r, 1, 2, "h") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, k int, pos string")


def run(spark, rows, tmp_path, name):
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    out = QUERIES["op13_prefix_trie"](spark, f"{tmp_path}/{name}")
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()))


def odd(seed):
    rnd, rows = random.Random(seed), []
    for c in range(0, 700, 3):
        if c % 100 == 0 and rnd.random() < 0.4:
            continue
        for _ in range(rnd.choice([1, 1, 2, 4, 9])):
            rows.append((c, rnd.choice([None, 1, 2, 2, 3, 7]), rnd.choice([None, "", "user"]), rnd.choice([None, "", "a", "ab", "é😀", "x" * 300])))
    rows += [(1000 + k, k, "r", f"long {k // 2}") for k in range(3)] + [(1100, k, "user", f"t{k}") for k in range(300)] + [(1101, k, "user", f"t{k}") for k in range(299)]
    return rows + [(None, 1, "user", "nobody's")] * 3 + [(5000, 1, "b", "again")] * 7


def test_whole_table(spark, folder, con):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{folder}/conversations.parquet'").fetchall()
    out = QUERIES["op13_prefix_trie"](spark, str(folder))
    assert sorted(map(tuple, out.collect())) == plain(rows)
    cur = duck(folder).execute(SQL["op13_prefix_trie"])
    assert comparable(out.columns, [tuple(r) for r in out.collect()]) == comparable([d[0] for d in cur.description], cur.fetchall())


def test_odd_rows(spark, tmp_path):
    rows = odd(1)
    assert run(spark, rows, tmp_path, "odd") == plain(rows)
    assert run(spark, [], tmp_path, "none") == []
    assert run(spark, [(7, 1, "user", "one")], tmp_path, "one") == plain([(7, 1, "user", "one")])


def test_many_small_blocks(spark, tmp_path, monkeypatch):
    """The same nodes where the tour needs rounds of contraction and the lists of ends need pieces."""
    monkeypatch.setattr(trie, "_ENDS", 4)
    monkeypatch.setattr(trie, "_STEP", 8)
    rows = odd(2) + [(2000 + k, 0, "user", "the same") for k in range(90)]
    turns = trie.turns_of(frame(spark, rows))
    from pyspark.sql import functions as F

    base, kept = F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string")) % 6
    out = trie.trie(*trie.forked(turns, base, kept, 6), block=16, limit=20)
    assert sorted(map(tuple, out.collect())) == plain(rows)


@pytest.mark.parametrize(("size", "block", "limit"), [(0, 4, 4), (1, 4, 4), (500, 1, 10), (500, 64, 2), (500, 4096, 4096)])
def test_positions(spark, size, block, limit):
    prepared(spark)
    order = np.random.default_rng(size + block).permutation(size).tolist()
    rows = [(a, b) for a, b in zip(order, [*order[1:], None], strict=True)] if size else []
    got = listrank.ranked(spark.createDataFrame(rows, "id int, succ int"), block, limit).collect()
    assert sorted((r.pos, r.id) for r in got) == list(enumerate(order))
