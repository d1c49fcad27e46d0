"""Similarity goldens and exactness of the candidate keys against all-pairs scoring."""

import math
import random

import numpy as np
import pytest

from paperfold.functions import similarity as sim
from paperfold.operators import fuzzy


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc한é") for _ in range(rnd.randrange(12))) for _ in range(2))
        assert sim.lcs(a, b) == slow_lcs(a, b)


@pytest.mark.parametrize("a,b,ratio,token_set,partial", [
    ("busan", "busan", 100, 100, 100),  # equal
    ("busan", "pusan", 80, 80, 89),  # 4 of 5 letters in common: 2*4/10; against "usan" 2*4/9
    ("port of busan", "busan", 56, 100, 100),  # 2*5/18; one token set holds the other; a stretch is equal
    ("busan port", "port busan", 50, 100, 67),  # 2*5/20; "port" against " port bu"... best stretch 2*5/15
    ("abc", "xyz", 0, 0, 0),
])
def test_ratios(a, b, ratio, token_set, partial):
    assert (sim.ratio(a, b), sim.token_set_ratio(a, b)) == (ratio, token_set)
    assert sim.partial_ratio(a, b) == partial


def test_batches_equal_single_pairs(monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abc 한é") for _ in range(rnd.choice([0, 1, 5, 12, 63, 64, 65, 130, 200]))) for _ in range(45)]
    others = texts[:10] + ["".join(rnd.choice("abcd 한ê") for _ in range(rnd.choice([0, 1, 5, 12, 64, 128]))) for _ in range(30)]
    pairs = [(a, b) for a in range(len(texts)) for b in range(len(others))]
    rnd.shuffle(pairs)
    i, j = (np.array(x) for x in zip(*pairs, strict=True))
    for masks, at_once in ((1 << 21, 1 << 17), (40, 100)):
        monkeypatch.setattr(sim, "MASKS", masks)
        monkeypatch.setattr(sim, "PAIRS", at_once)
        assert sim.lcs_of(texts, others, i, j).tolist() == [sim.lcs(texts[a], others[b]) for a, b in pairs]
        assert sim.ratios(texts, others, i, j).tolist() == [sim.ratio(texts[a], others[b]) for a, b in pairs]
        assert sim.token_set_ratios(texts, others, i, j).tolist() == [sim.token_set_ratio(texts[a], others[b]) for a, b in pairs]
    none = np.zeros(0, np.int64)
    assert len(sim.token_set_ratios([], [], none, none)) == 0


def test_columns_with_nulls(spark):
    rows = [("busan", "pusan"), (None, "x"), ("x", None), ("", ""), ("busan", "pusan"), ("port of busan", "busan")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = df.select(sim.ratio_udf("a", "b"), sim.token_set_ratio_udf("a", "b"), sim.partial_ratio_udf("a", "b"), sim.ratio_float_udf("a", "b")).collect()
    assert [tuple(r) for r in got][:4] == [(80, 80, 89, 80.0), (None,) * 4, (None,) * 4, (100, 0, 100, 100.0)] and got[4] == got[0] and got[5][:3] == (56, 100, 100)


def words(rnd, n):
    letters = "abcdeé한"
    return ["".join(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 4, 5, 7, 9, 12, 17]))) for _ in range(n)]


def mutate(rnd, w):
    w = list(w)
    for _ in range(rnd.choice([0, 1, 1, 2, 3])):
        i = rnd.randrange(len(w) + 1)
        if rnd.random() < 0.5 or not w:
            w.insert(i, rnd.choice("abx"))
        else:
            w.pop(min(i, len(w) - 1))
    return "".join(w) or "z"


def test_similar_words_misses_nothing(spark):
    rnd = random.Random(3)
    vocab = words(rnd, 150)
    values = list({mutate(rnd, rnd.choice(vocab)) for _ in range(150)})
    got = fuzzy.similar_words(spark.createDataFrame([(v,) for v in values], "value string"),
                              spark.createDataFrame([(w,) for w in vocab], "word string"))
    want = {(v, w, sim.ratio(v, w)) for v in values for w in set(vocab) if sim.ratio(v, w) >= 85}
    assert {tuple(r) for r in got.select("value", "word", "score").collect()} == want
    assert len(want) > 50


def test_containing_pairs(spark):
    rnd = random.Random(4)
    vocab, values = words(rnd, 120), list(set(words(rnd, 60)) | {"한", "ab"})
    got = fuzzy.containing_pairs(spark.createDataFrame([(v,) for v in values], "value string"),
                                 spark.createDataFrame([(w,) for w in vocab], "word string"))
    want = {(v, w, 0) for v in values for w in set(vocab) if v == w} | {
        (v, w, 1) for v in values for w in set(vocab) if v != w and len(w) > 1 and (v in w or w in v)}
    rows = [tuple(r) for r in got.select("value", "word", "tier").collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_dictionary_match_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "ENTRIES_PER_BLOCK", 13)
    monkeypatch.setattr(fuzzy, "VALUES_PER_SLICE", 17)
    rnd = random.Random(7)
    parts = ["busan", "port", "new", "jebel ali", "shanghai", "terminal", "south", "harbour", "inchon"]
    entries = [(rnd.choice("xy"), f"{rnd.choice(['kr', 'cn', 'ae'])}{i}", " ".join(rnd.sample(parts, rnd.choice([1, 2, 3]))).title(), i)
               for i in range(60)] + [("x", "", "", 99)]
    names = [e[2] for e in entries if e[2]]
    values = {mutate(rnd, rnd.choice(names)) for _ in range(60)} | {"Busan", "KR1", "12", "1,200", "q", "zzzzqqq", "port"}

    def best(v):
        q, top = v.lower().strip(), None
        for c, code, name, no in sorted(entries, key=lambda e: (e[0], e[3])):
            ck, nk = code.lower().strip(), name.lower().strip()
            if q and q in (ck, nk):
                return (c, code, name, no, 1.0)
            if nk and (q in nk or nk in q):
                s = 0.85
            elif ck and (q in ck or ck in q):
                s = 0.8
            else:
                s = max(sim.token_set_ratio(q, nk) if nk else 0, sim.ratio(q, nk) if nk else 0, sim.ratio(q, ck) if ck else 0) / 100
            if s >= 0.6 and (top is None or s > top[-1]):
                top = (c, code, name, no, s)
        return top

    def usable(v):
        try:
            float(v.replace(",", ""))
            return False
        except ValueError:
            return len(v) >= 2

    want = {(v, *best(v)) for v in values if usable(v) and best(v)}
    got = fuzzy.match_dictionary(spark.createDataFrame([(v,) for v in values], "value string"),
                                 spark.createDataFrame(entries, "category string, code string, name string, entry_no bigint"))
    assert {tuple(r) for r in got.select("value", "category", "code", "name", "entry_no", "score").collect()} == want
    assert len(want) > 40


def test_locate_fuzzy(spark):
    cells = [(1, 10, "the terminl of"), (2, 10, "nothing"), (3, 11, "Busan")]
    ws = [(10, 0, 0, "terminal"), (10, 1, 4, "terminal"), (10, 0, 9, "the"), (11, 2, 0, "Busan"), (10, 0, 20, "Busan")]
    got = fuzzy.locate_fuzzy(spark.createDataFrame(cells, "cell_id int, doc_id int, source_text string"),
                             spark.createDataFrame(ws, "doc_id int, page_no int, start int, word string"))
    assert {(r.cell_id, r.word, r.score, r.page_no, r.start) for r in got.collect()} == {(1, "terminal", 93, 0, 0), (3, "Busan", 100, 2, 0)}


def test_locate_passages(spark):
    rnd = random.Random(12)
    refs, targets = [], []
    for doc in range(6):
        texts = [" ".join(words(rnd, rnd.choice([1, 2, 4, 8]))) + rnd.choice(["", ".", " !"]) for _ in range(12)]
        refs += [(doc, i, i % 3, x) for i, x in enumerate(texts)]
        for i in range(10):
            src = rnd.choice(texts)
            a = rnd.randrange(len(src))
            cut = src if i % 2 else src[a:a + rnd.choice([4, 9, 20])]
            targets.append((doc * 100 + i, doc, mutate(rnd, cut or "zz"), rnd.choice([None, None, 0, 1, 2])))

    def bare(x):
        return "".join(ch for ch in x.lower() if ch in "abcdefghijklmnopqrstuvwxyz0123456789" or "가" <= ch <= "힣")

    def scan(tid, doc, page, t, clean, scorer, least):
        best = None
        for d, no, p, raw in refs:
            r = clean(raw)
            if d != doc or not r or (page is not None and p != page):
                continue
            score = scorer(t, r)
            if page is not None:
                score = min(100.0, score + 5)
            if t == r or score >= 98:
                return (tid, doc, no, p, score)
            if score >= least and (best is None or score > best[-1]):
                best = (tid, doc, no, p, score)
        return best

    want = set()
    for tid, doc, text, page in targets:
        hit = None
        if sim.normal(text):
            hit = scan(tid, doc, page, sim.normal(text), sim.normal, sim.exact_ratio, 95)
        strict = hit is not None
        if not strict and bare(text):
            hit = scan(tid, doc, page, bare(text), bare, sim.exact_partial_ratio, 85)
        if hit:
            want.add((*hit, strict))
    got = fuzzy.locate_passages(spark.createDataFrame(targets, "target_id int, doc_id int, text string, page int"),
                                spark.createDataFrame(refs, "doc_id int, ref_no int, page_no int, text string"))
    assert {tuple(r) for r in got.select("target_id", "doc_id", "ref_no", "page_no", "score", "strict").collect()} == want
    assert {w[-1] for w in want} == {True, False}


def test_partial_ratio_skips_no_window():
    rnd = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abcde ") for _ in range(rnd.randrange(1, 14))) for _ in range(2))
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        # stretches of the shorter text's length, cut off at both ends of the longer one
        cuts = [long[max(0, i):i + len(short)] for i in range(1 - len(short), len(long))]
        best = max(200 * slow_lcs(short, x) / (len(short) + len(x)) for x in cuts)
        assert abs(sim.exact_partial_ratio(a, b) - best) < 1e-9, (a, b)


def test_search_with_words_that_all_entries_have(spark):
    """Score bounds leave out nothing: against all entries of all queries, ties and one-word queries included."""
    rnd = random.Random(12)
    vocabulary = ["port", "of"] + [f"w{i}" for i in range(25)]
    entries = [(rnd.choice("xyz"), f"c{i:03d}", " ".join(["Port", "of", *rnd.sample(vocabulary[2:], rnd.choice([0, 1, 2, 4]))])) for i in range(150)]
    queries = ["port", "of port", "w3", "nothing", "port w1 w2", "w1 w2 w3 w4 of", "of w24 nothing", "w5 port of w5"] + [" ".join(rnd.sample(vocabulary, 3)) for _ in range(20)]
    df = {c: len({e[1] for e in entries if c in e[2].lower().split()}) for c in vocabulary}
    weight = {c: math.log1p(len(entries) / n) for c, n in df.items() if n}
    want = set()
    for q in set(queries):
        scores = [(-math.floor(sum(weight[t] for t in set(q.split()) & set(name.lower().split())) * 1e6 + 0.5) / 1e6, cat, code) for cat, code, name in entries]
        top = [s for c in "xyz" for s in sorted(s for s in scores if s[1] == c and s[0] < 0)[:3]]
        want |= {(q, cat, code, -score, rank) for rank, (score, cat, code) in enumerate(sorted(top)[:5], 1)}
    got = fuzzy.search_dictionary(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(entries, "category string, code string, name string"), 3, 5)
    assert {(r.query, r.category, r.code, r.score, r["rank"]) for r in got.collect()} == want


def test_one_word_values_take_the_first_entry(spark):
    entries = [("x", "b", "port of busan"), ("x", "a", "port of inchon"), ("y", "c", "port")]
    cells = [(1, "Port", "x"), (2, "PORT!", "y"), (3, "busan", "x"), (4, "q", "x"), (5, "unknown", "x"), (6, "port busan", "x"), (7, None, "x")]
    got = fuzzy.normalise_fields(spark.createDataFrame(cells, "id int, value string, category string"), spark.createDataFrame(entries, "category string, code string, name string"))
    assert {r.id: (r.normalized_code, r.dict_score) for r in got.collect()} == {1: ("a", 1.0), 2: ("c", 1.0), 3: ("b", 1.0), 4: (None, 0.0), 5: (None, 0.0), 6: ("b", 1.0), 7: (None, 0.0)}
