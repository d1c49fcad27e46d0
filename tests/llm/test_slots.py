import zlib
from collections import Counter, defaultdict

from paperfold.llm import slots
from paperfold.llm.queries import QUERIES
from paperfold.sources.shared import new_path
from tests.llm.helpers import ODD, table, texts


def check(rows, out):
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append((r.slot, r["size"]))
        assert r.law == "bytes" and r.grown_shard is None
    for places in shards.values():
        assert sorted(s for s, _ in places) == list(range(len(places)))
    return {k: sum(n for _, n in v) for k, v in shards.items()}


def test_whole_table(spark, folder):
    rows = texts(folder)
    sums = check(rows, QUERIES["op3_virtual_slots"](spark, str(folder)).collect())
    assert set(sums) == set(range(24))
    largest = max(len(t.encode()) + 8 for _, t in rows)
    assert max(sums.values()) - min(sums.values()) <= largest


def test_odd_rows(spark):
    check(ODD * 3, slots.assign(table(spark, ODD * 3), shards=3).collect())
    assert slots.assign(table(spark, [])).count() == 0


def test_edits_move_little(spark):
    held = slots.first_map(4, 64)
    weights = {s: 10 for s in range(64)}
    assert slots.rebalanced(held, weights, 4) == held
    grown = slots.rebalanced(held, weights, 5)
    moved = [s for s in range(64) if grown[s] != held[s]]
    assert all(grown[s] == 4 for s in moved) and 11 <= len(moved) <= 13
    weights[0] = 300  # a heavy slot: its shard hands the others on
    loads = Counter()
    for s, k in enumerate(slots.rebalanced(held, weights, 4)):
        loads[k] += weights[s]
    assert max(loads.values()) == 300


def test_versions_stay(spark):
    path = new_path(spark, "slot-test")
    slots.store_map(spark, path, 0, slots.first_map(3, 9))
    slots.store_map(spark, path, 1, [0] * 9)
    assert [r.shard for r in slots.load_map(spark, path, 0).orderBy("vslot").collect()] == [0, 1, 2] * 3
    assert {r.shard for r in slots.load_map(spark, path, 1).collect()} == {0}
