import numpy as np

from paperfold.llm import leaks
from paperfold.llm.common import Powers
from paperfold.llm.queries import QUERIES
from tests.llm.helpers import ODD, table, texts


def words_of(text):
    return leaks.word_hashes(text, Powers()).tolist()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b):
            row[k + 1], before = (before + 1 if x == y else max(row[k + 1], row[k])), row[k + 1]
    return row[-1]


def test_subsequences():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(1, 70)).astype(np.uint64) for _ in range(2))
        assert leaks.common_subsequence(a, b) == lcs(a.tolist(), b.tolist())


def test_whole_table(spark, folder, con):
    """All pairs by brute force: a stretch of the text that has four fifths of an item's words in order."""
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op9_benchmark_leaks"](spark, str(folder)).collect()}
    want = set()
    for d, t in texts(folder):
        w = words_of(t)
        held = set(w)
        for i, item in items:
            v = words_of(item)
            if sum(x in held for x in v) >= 0.8 * len(v):
                step = max(1, len(v) // 4)
                if any(lcs(v, w[k : k + len(v) + 2 * step]) >= 0.8 * len(v) for k in range(0, max(1, len(w) - len(v)), step)):
                    want.add((d, i))
    assert {k for k, r in got.items() if r.verbatim} == want and len(want) >= 3


def test_paraphrases(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(vocabulary, 30)) + ". So the answer is " + " ".join(rng.choice(vocabulary, 3)) + ".") for k in range(300)]
    rows, want = [], set()
    for k in range(120):
        text = items[k][1].split()
        for p in rng.choice(30, 9, replace=False):  # nearly a third of the words changed, the answer kept
            text[p] = str(rng.choice(vocabulary))
        rows.append((k, " ".join(rng.choice(vocabulary, 200)) + " " + " ".join(text).upper() + "! " + " ".join(rng.choice(vocabulary, 200))))
        want.add((k, k))
    rows += [(1000 + k, " ".join(rng.choice(vocabulary, 400))) for k in range(200)]
    benchmark = spark.createDataFrame([*items, (None, "x y"), (900, None), (901, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(table(spark, rows), benchmark).collect()}
    assert not got - want and len(got & want) >= 0.95 * len(want)


def test_latent_space_keeps_cosines(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary, 20))) for k in range(40)]
    (block,) = leaks.blocks_of(spark.createDataFrame(items, "item_id bigint, text string"))
    block = leaks.fitted(block, 100, np.ones(len(block.vocabulary), np.int64), spark)
    item, word, weight = leaks._vectors(block)
    full = np.zeros((40, len(block.vocabulary)))
    full[item, word] = weight
    assert np.abs(full @ block.scores - full @ full.T).max() < 1e-4


def test_odd_rows(spark):
    benchmark = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id bigint, text string")
    rows = [*ODD, (10, "x one two three four five six y"), (10, "one two three four five six"), (11, "One, two: three-four (five) six!")]
    got = leaks.leaks(table(spark, rows), benchmark)
    assert sorted((r.doc_id, r.item_id, r.verbatim) for r in got.collect()) == [(10, 1, True), (11, 1, True)]
    assert leaks.leaks(table(spark, []), benchmark).count() == 0
    assert leaks.leaks(table(spark, rows), benchmark.limit(0)).count() == 0


def test_long_item(spark):
    """An item longer than a block is searched piece by piece."""
    text = " ".join(f"u{k}" for k in range(leaks.BLOCK_WORDS + 500))
    got = leaks.leaks(table(spark, [(1, text), (2, "u1 u2")]), spark.createDataFrame([(5, text)], "item_id bigint, text string"))
    assert [(r.doc_id, r.item_id) for r in got.collect()] == [(1, 5)]


def test_mixed_lengths(spark):
    """Every item is found whatever its length, the items beside it and what else the document holds."""
    rng = np.random.default_rng(7)
    vocabulary = [f"m{k}" for k in range(2500)]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate([*rng.integers(5, 60, 150).tolist(), 300, 1500, 3000])]
    every = " ".join(t for _, t in items)  # the benchmark back to back
    long = " ".join(rng.choice(vocabulary, 3000)) + " " + items[151][1] + " " + " ".join(rng.choice(vocabulary, 3000))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(table(spark, [(1, every), (2, long), (3, items[0][1])]), benchmark).collect() if r.verbatim}
    assert got == {(1, k) for k, _ in items} | {(2, 151), (3, 0)}


def test_common_words(spark):
    """Paraphrases that keep just the item's common words, and none of its rare ones, are found."""
    rng = np.random.default_rng(8)
    common = [f"c{k}" for k in range(40)]
    item = " ".join(f"rare{k} {a} {b}" for k, (a, b) in enumerate(rng.choice(common, (10, 2)))) + ". " + " ".join(common[:5]) + "."
    text = " ".join(w for w in item.split() if not w.startswith("rare"))
    rows = [(k, " ".join(rng.permutation(common))) for k in range(200)] + [(500, text)]
    got = leaks.leaks(table(spark, rows), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.verbatim) for r in got] == [(500, 1, False)]
