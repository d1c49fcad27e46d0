import numpy as np
from pyspark.sql import functions as F

from paperfold.llm import quality
from paperfold.llm.queries import QUERIES
from tests.llm.helpers import ODD, table


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark, folder):
    wide = str(folder).replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{wide}/{t}.parquet") for t in ("documents", "labels"))
    seen, unseen = labels.where("doc_id % 3 > 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    out = quality.judged(docs, seen, F.col("source"), F.col("lang"), ["doc_id"]).collect()
    right = [r.good == bool(unseen[r.doc_id]) for r in out if r.doc_id in unseen]
    clean = [r.good for r in out if unseen.get(r.doc_id) == 1]
    assert np.mean(right) > 0.95 and np.mean(clean) > 0.98 and len(right) > 100
    assert QUERIES["op1_quality"](spark, str(folder)).count() == 200


def test_sites_shrink(spark):
    """A large bad site weighs on its documents, a site with one document hardly differs from the whole."""
    rows = [("big-bad", "p", -2.0)] * 200 + [("big-good", "p", 3.0)] * 200 + [("big-good", "bad", -3.0)] * 100 + [("one", "x", -3.0), (None, None, 1.0)]
    got = {(r.host, r.path): r for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, log_odds double")).collect()}
    share = got["one", "x"].global_share
    total = sum(1 / (1 + np.exp(-x)) for _, _, x in rows) / len(rows)
    assert abs(share - total) < 1e-9
    assert got["big-bad", "p"].path_share < 0.2 < 0.5 < got["big-good", "p"].path_share
    assert got["big-good", "bad"].path_share < 0.2 < got["big-good", "bad"].host_share
    assert abs(got["one", "x"].path_share - share) < 0.35 * abs(0.05 - share) + 0.2
    assert got["one", "x"].path_share > got["big-bad", "p"].path_share
    assert (None, None) in got


def test_site_moves_the_posterior(spark):
    rows = [(k, "good clean words here") for k in range(20)]
    docs = table(spark, rows).withColumn("source", F.when(F.col("doc_id") < 10, "a").otherwise("b"))
    out = quality.judged(docs, labels_of(spark, [(0, 1, 0)]), F.col("source"), F.col("lang"), docs.columns)
    assert {r.good for r in out.collect()} == {True}
    assert out.columns[: len(docs.columns)] == docs.columns


def test_odd_rows(spark):
    frame = table(spark, ODD)
    labels = labels_of(spark, [(4, 1, 0), (6, 0, 0), (6, 0, 1), (None, 1, 0), (7, None, 0), (99, 0, 0)])
    out = quality.judged(frame, labels, F.col("host"), F.col("path"), ["doc_id", "host", "n"])
    assert out.count() == len(ODD) and out.where("posterior is null or good is null").count() == 0
    assert quality.judged(table(spark, []), labels, F.col("host"), F.col("path"), ["doc_id"]).count() == 0
    assert quality.judged(frame, labels.limit(0), F.col("host"), F.col("path"), ["doc_id"]).where("good").count() == len(ODD)
