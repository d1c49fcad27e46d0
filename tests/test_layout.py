"""Spans, gaps and tagged text against a character mask."""

import random

from paperfold.operators import spans
from paperfold.operators import tables_text as tt


def make_doc(rnd, n_lines):
    return "\n".join("".join(rnd.choice("ab 1 X") for _ in range(rnd.choice([0, 2, 5, 12, 30]))) for _ in range(n_lines))


def line_rows(doc, text):
    rows, at = [], 0
    for i, line in enumerate(text.split("\n")):
        rows.append((doc, i, at, line))
        at += len(line) + 1
    return rows


def mask_of(text, claims):
    mask = [False] * len(text)
    for s, e in claims:
        for i in range(s, min(e, len(text))):
            mask[i] = True
    return mask


def runs(mask, lo, hi):
    """Unclaimed [from, to) stretches between two positions."""
    out, start = [], None
    for i in range(lo, hi):
        if not mask[i] and start is None:
            start = i
        if mask[i] and start is not None:
            out.append((start, i))
            start = None
    return out + ([(start, hi)] if start is not None else [])


def fixtures(seed):
    rnd = random.Random(seed)
    docs, claims = {}, {}
    for d in range(8):
        docs[d] = make_doc(rnd, rnd.choice([1, 4, 12]))
        claims[d] = [(s, s + rnd.randrange(1, 9)) for s in (rnd.randrange(len(docs[d]) + 5) for _ in range(rnd.choice([0, 3, 15])))]
    return docs, claims


def test_gaps_and_words(spark, monkeypatch):
    monkeypatch.setattr(spans, "SPAN_BLOCK", 16)
    docs, claims = fixtures(2)
    lines = [r for d, x in docs.items() for r in line_rows(d, x)]
    ldf = spark.createDataFrame(lines, "doc_id int, line_no int, start bigint, line string")
    cdf = spark.createDataFrame([(d, s, e) for d, cs in claims.items() for s, e in cs], "doc_id int, start bigint, end bigint")
    want = set()
    for d, no, at, line in lines:
        mask = mask_of(docs[d], claims[d])
        for a, b in runs(mask, at, at + len(line)):
            if b - a >= 3 and len(docs[d][a:b].strip(" ")) >= 2:
                want.add((d, no, a, b, docs[d][a:b].strip(" ")))
    assert {tuple(r) for r in spans.text_gaps(ldf, cdf).collect()} == want and want

    words = [(d, i, w) for d, x in docs.items() for i, w in ((m, x[m:].split()[0]) for m in range(len(x)) if not x[m].isspace() and (m == 0 or x[m - 1].isspace()))]
    wdf = spark.createDataFrame(words, "doc_id int, start bigint, word string")
    free = {(d, i, w) for d, i, w in words if not any(mask_of(docs[d], claims[d])[i:i + len(w)])}
    assert {tuple(r) for r in spans.unclaimed_words(wdf, cdf).collect()} == free


def rebuilt(text, lines, tables, tags, claims):
    """The tagged text in one sequential pass."""
    mask = mask_of(text, claims)
    ends = {at + len(line) for _, _, at, line in lines}
    events = [(s, 0, (e, md)) for s, e, md in tables]
    events += [(p, 1, t) for p, t in tags if not any(s <= p <= e for s, e, _ in tables)]
    events.sort(key=lambda x: (x[0], x[1], str(x[2][0]) if x[1] == 0 else x[2]))
    out, last = [], 0
    for pos, kind, data in events:
        if kind == 0:
            end, md = data
            if pos > last:
                out.append(text[last:pos])
            lo = max(pos, last)
            for a, b in runs([m or i in ends for i, m in enumerate(mask)], lo, min(end, len(text))):
                piece = text[a:b].strip(" ")
                if len(piece) >= 2:
                    out.append(piece + "\n")
            out.append("\n" + md + "\n")
            last = max(last, end)
        elif pos >= last:
            out += [text[last:pos], " ^" + data]
            last = pos
    return "".join(out) + text[last:]


def test_tagged_text(spark, monkeypatch):
    monkeypatch.setattr(tt, "SPAN_BLOCK", 16)
    monkeypatch.setattr(spans, "SPAN_BLOCK", 16)
    docs, claims = fixtures(9)
    rnd = random.Random(1)
    lines, tables, tags, want = [], [], [], {}
    for d, x in docs.items():
        rows = line_rows(d, x)
        lines += rows
        tb, at = [], 0
        while len(x) - at > 12 and len(tb) < 3:
            s = at + rnd.randrange(1, 6)
            e = min(len(x), s + rnd.randrange(3, 25))
            tb.append((s, e, f"|T{len(tb)}|"))
            at = e + 1 if d % 2 else max(e - 2, s + 1)  # half of the documents have overlapping tables
        starts = sorted(rnd.sample(range(1, len(x)), min(5, len(x) - 1))) if len(x) > 1 else []
        tg = [(p, f"W{i + 1}") for i, p in enumerate(starts)]
        tables += [(d, *t) for t in tb]
        tags += [(d, *t) for t in tg]
        want[d] = rebuilt(x, rows, tb, tg, claims[d])
    df = tt.rebuild_text(
        spark.createDataFrame(lines, "doc_id int, line_no int, start bigint, line string"),
        spark.createDataFrame(tables, "doc_id int, start bigint, end bigint, table_text string"),
        spark.createDataFrame(tags, "doc_id int, at bigint, tag string"),
        spark.createDataFrame([(d, s, e) for d, cs in claims.items() for s, e in cs], "doc_id int, start bigint, end bigint"))
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.pos, r.step, r["sub"])):
        got[r.doc_id] = got.get(r.doc_id, "") + r.text
    assert {d: got.get(d, "") for d in docs} == want
