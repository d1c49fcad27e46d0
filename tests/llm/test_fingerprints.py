import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from paperfold.llm import fingerprints as fp
from paperfold.llm.queries import QUERIES
from tests.llm.helpers import ODD, table, texts


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=40), st.text("ab", max_size=40), st.integers(0, 40), st.integers(0, 40), st.integers(0, 40))
def test_spans_and_extensions(a, b, i, j, size):
    i, j = min(i, len(a)), min(j, len(b))
    x, y = fp.PrefixHash(fp.units_of(a)), fp.PrefixHash(fp.units_of(b))
    inside = i + size <= len(a) and j + size <= len(b)
    assert fp.same(x, i, y, j, size) == (inside and a[i : i + size] == b[j : j + size])
    common = 0
    while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
        common += 1
    assert fp.common_extension(x, i, y, j) == common


def check(rows, out):
    rows = [(i, t or "") for i, t in rows]
    assert len(out) == len(rows)
    worst = 0
    for k, ((i, t), r) in enumerate(zip(rows, out, strict=True)):
        after, n = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - n] + after[:n]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())

        def spans(s):
            return {s[j : j + fp.SPAN] for j in range(max(1, len(s) - fp.SPAN + 1))} if s else set()

        for got, other in ((r.near_edited, edited), (r.near_next, after)):
            assert 0 <= got <= 1 and (got == 1 or t != other)
            if t != other:
                worst = max(worst, abs(got - len(spans(t) & spans(other)) / max(1, len(spans(t) | spans(other)))))
        common = next((j for j, (a, b) in enumerate(zip(t, edited, strict=False)) if a != b), min(len(t), len(edited)))
        assert r.common_edited == common
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
    return worst


def test_whole_table(spark, folder):
    rows = texts(folder)
    out = sorted(QUERIES["op8_prefix_fingerprints"](spark, str(folder)).collect(), key=lambda r: r.doc_id)
    assert check(rows, out) < 0.25
    same = {}
    for (_, t), r in zip(rows, out, strict=True):
        assert same.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(same.values())) == len(same)


def test_odd_rows(spark):
    rows = sorted(ODD, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    out = sorted(fp.with_next(table(spark, ODD[::-1])).collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    check(rows, out)
    assert fp.with_next(table(spark, [])).count() == 0
    (one,) = fp.with_next(table(spark, [(3, "abcdef")])).collect()
    assert (one.near_edited, one.near_next, one.common_next) == (fp.likeness(one.fingerprint, one.edited_fingerprint), 1.0, 6)


def test_long_powers():
    h = fp.PrefixHash(np.zeros(5000, np.uint32))
    assert fp.common_extension(h, 0, h, 1000) == 4000
