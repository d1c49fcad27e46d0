import subprocess
import sys

import corpus_pipeline
from paperfold.llm import leaks, neardup, quality
from tests.llm.helpers import ODD, table
from tests.llm.test_neardup import brute
from tests.llm.test_packing import check
from tests.oracle import ROOT


def test_stages(spark, folder):
    """Each stage on the rows that its predecessor kept, against what its operator or brute force says of them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.table(stage(spark, docs, str(folder)), "test-stage")
        assert docs.columns == columns and dict(docs.dtypes) == dict(before.dtypes)
        kept[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before, after = kept["quality_filter"]
    assert all(i in after for i, q in labels.items() if q == 1) and not any(i in after for i, q in labels.items() if q == 0)
    before, after = kept["near_dedup"]
    assert set(after) == {i for i, (_, c) in brute([(i, r.text) for i, r in before.items()], 5).items() if c == i} and len(after) < len(before)
    before, after = kept["decontaminate"]
    found = leaks.leaks(spark.createDataFrame([(i, r.text) for i, r in before.items()], "doc_id bigint, text string"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert set(before) - set(after) == {r.doc_id for r in found.collect()} != set()
    before, after = kept["hide_personal_data"]
    assert set(before) == set(after) and all(r.n_chars == len(r.text) for r in after.values())
    assert {(r.lang, r.source) for r in after.values()} <= {(r.lang, r.source) for r in before.values()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(folder)).collect()
    check([(i, r.text) for i, r in after.items()], packed, 1024)
    assert neardup and quality and sorted(map(str, corpus_pipeline.run(spark, str(folder)).collect())) == sorted(map(str, packed))


def test_odd_rows(spark, folder):
    docs = table(spark, ODD).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(folder))
        assert out.count() > 0
        assert stage(spark, docs.limit(0), str(folder)).count() == 0
        if "text" in out.columns:
            docs = out


def test_without_this_part():
    """The entry file still gives the other queries if these folders are gone."""
    code = """
import sys
class Gone:
    def find_spec(self, name, *a):
        if name in ("corpus_pipeline", "paperfold.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
