import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from paperfold.llm import packing, token_counts
from paperfold.llm.queries import QUERIES
from paperfold.llm.tokens import Encoder, default_path
from tests.llm.helpers import LONG, ODD, table, texts

ODD_TEXTS = ["", "don't it's 's ''s x's", "a  b\n\nc \n d   ", "  lead", "trail  ", "<|endoftext|> x<|endoftext|>", "\tq\r\n \n", "日本語 text 漢字", "1234 56a7, b!!  --\n--x", "'s", "a 's", None, " ", "\n", " \n", "x́y ½ ² ª z", "\x1c\x85 a", LONG]


def plain(texts):
    tokenizer = Tokenizer.from_file(default_path())
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_are_the_tokenizers(folder):
    rows = ODD_TEXTS + [t for _, t in texts(folder)]
    got = [ids[a:b].tolist() for _, _, ids, at in Encoder(default_path()).columns(pa.array(rows)) for a, b in zip(at, at[1:], strict=False)]
    assert got == plain(rows)


def test_forgotten_pieces_are_learned_again(folder, monkeypatch):
    monkeypatch.setattr("paperfold.llm.tokens._CACHED", 3000)
    rows = ODD_TEXTS + [t for _, t in texts(folder)] * 2
    coder = Encoder(default_path())
    got = [ids[a:b].tolist() for k in range(0, len(rows), 7) for _, _, ids, at in coder.columns(pa.array(rows[k : k + 7])) for a, b in zip(at, at[1:], strict=False)]
    assert got == plain(rows) and len(coder.pieces.hashes) < 20_000


def check(rows, out, capacity):
    """All ids are there once, in place, and sequences are filled without gaps."""
    want = Counter()
    for (i, _), ids in zip(rows, plain([t for _, t in rows]), strict=True):
        ids, start, piece = [*ids, 2], 0, 0
        length = len(ids) % capacity or min(len(ids), capacity)
        while start < len(ids):
            want[i, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
            start, piece, length = start + length, piece + 1, capacity
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in out)


def test_whole_table(spark, folder):
    rows = texts(folder)
    bins, total = check(rows, QUERIES["op5_best_two_fit"](spark, str(folder)).collect(), 1024)
    assert bins <= -(-total // 1024) + 1


def test_odd_rows(spark):
    check(ODD, packing.pack(table(spark, ODD), 16).collect(), 16)
    assert packing.pack(table(spark, []), 16).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 101), 25, replace=False), rng.integers(1, 300, 25), strict=True)}
    plan = packing.best_two_fit(counts, 100)
    used = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += n
    assert used == counts
    first_fit = []
    for x in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        for b in range(len(first_fit)):
            if first_fit[b] >= x:
                first_fit[b] -= x
                break
        else:
            first_fit.append(100 - x)
    assert sum(n for _, n in plan) <= len(first_fit)


def test_two_for_one():
    assert packing.best_two_fit({7: 1, 2: 1, 4: 1}, 13) == [([7, 4, 2], 1)]
    assert packing.best_two_fit({9: 2, 6: 1, 5: 1}, 20) == [([9, 6, 5], 1), ([9], 1)]  # 9 + 9 at first, then 6 + 5 for the second 9


def test_histogram_answers_every_limit(spark, folder):
    lengths = [len(x) for x in plain([t for _, t in texts(folder)])]
    answers = QUERIES["op10_length_histogram"](spark, str(folder))
    for r in answers.collect():
        at_least = [x for x in lengths if x >= r.n_tokens]
        kept = sum(min(x, r.n_tokens) for x in lengths)
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(r.n_tokens), len(at_least), sum(at_least))
        assert (r.kept_tokens, r.cut_tokens, r.total_docs) == (kept, sum(lengths) - kept, len(lengths))
        assert r.docs_at_most == sum(x <= r.n_tokens for x in lengths) and r.quantile == r.docs_at_most / len(lengths)
    one = token_counts.at_limit(answers, 777).first()
    assert one.kept_tokens == sum(min(x, 777) for x in lengths)


def test_histogram_encodes_once(spark, folder):
    plan = QUERIES["op10_length_histogram"](spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_histogram_of_odd_rows(spark):
    hist = {r.n_tokens: r.n_docs for r in token_counts.histogram(token_counts.lengths(table(spark, ODD))).collect()}
    assert hist == dict(Counter(len(x) for x in plain([t for _, t in ODD])))
    assert token_counts.for_every_limit(token_counts.histogram(token_counts.lengths(table(spark, [])))).count() == 0
