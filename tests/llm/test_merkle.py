import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from paperfold.llm import merkle
from paperfold.llm.queries import QUERIES, SQL
from tests.llm.helpers import ODD, table
from tests.oracle import duck
from tests.oracle import table as comparable


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, fanout):
    """Root and, for each leaf, the siblings on its path."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for nodes in levels[:-1]:
            start = i - i % fanout
            path.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + fanout])))
            i //= fanout
        paths.append(path)
    return levels[-1][0], paths


def plain(rows, fanout):
    """rows of (lang, doc_id, leaf): sorted (doc_id, lang, leaf, path, subroot, root)."""
    langs = sorted({r[0] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    out, roots = [], []
    for lang in langs:
        own = sorted(((i, leaf) for name, i, leaf in rows if name == lang), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        root, paths = tree([leaf for _, leaf in own], fanout)
        roots.append(root)
        out += [(i, lang, leaf, path, root) for (i, leaf), path in zip(own, paths, strict=True)]
    top, above = tree(roots, fanout)
    return sorted(((i, lang, leaf, tuple(path + above[langs.index(lang)]), root, top) for i, lang, leaf, path, root in out), key=str)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 2), (3, 1), (8, 3)])
def test_paths_of_any_shape(spark, fanout, levels):
    table(spark, [])
    counts = {"aa": 1, "b": fanout**levels, "Z": fanout**levels + 1, None: 2 * fanout**levels + 1, "é": 29, "": 70, "x": 3, "y": 2, "z": 7}
    rows = [(lang, i * 7 % n if i % 5 else i, f"{lang}{i}") for lang, n in counts.items() for i in range(n)]
    rows += [("x", None, "n"), ("x", 1, "again")] + [("é", 3, "often")] * 40
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string").repartition(3)
    got = [(r.doc_id, r.lang, r.leaf, tuple((s.before, s.after) for s in r.path), r.subroot, r.root) for r in merkle.manifest(df, fanout=fanout, levels=levels).collect()]
    assert sorted(got, key=str) == plain(rows, fanout)


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def check(rows, out):
    """The query's columns by hand; rows of (doc_id, source, lang, n_chars, text)."""
    now = {}
    for r in rows:
        leaf, changed = h("".join(map(field, r))), list(r)
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
            changed[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
        now[r[0], leaf] = h("".join(map(field, changed)))
    want = []
    for i, _, leaf, path, sub, root in plain([(r[2], r[0], h("".join(map(field, r)))) for r in rows], 8):
        folded = now[i, leaf]
        for before, after in path:
            folded = h(before + folded + after)
        want.append((i, leaf, sub, root, h("".join(a + b for a, b in path)), folded, folded == root))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_whole_table(spark, folder):
    rows = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{folder}/documents.parquet'").fetchall()
    out = QUERIES["op12_butterfly_manifest"](spark, str(folder)).collect()
    check(rows, out)
    assert 0 < sum(not r.verified for r in out) < len(out) / 2


def test_odd_rows(spark, tmp_path):
    docs = table(spark, [*ODD, (9, "UPPER"), (12, "UPPER"), (15, "UPPER É")]).withColumn("lang", F.when(F.col("doc_id") > 2, F.col("lang"))).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("s")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    check(rows, QUERIES["op12_butterfly_manifest"](spark, str(tmp_path)).collect())
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["op12_butterfly_manifest"](spark, str(tmp_path)).count() == 0


def test_sql_twin(spark, folder):
    out = QUERIES["op12_butterfly_manifest"](spark, str(folder))
    cur = duck(folder).execute(SQL["op12_butterfly_manifest"])
    assert comparable(out.columns, [tuple(r) for r in out.collect()]) == comparable([d[0] for d in cur.description], cur.fetchall())
