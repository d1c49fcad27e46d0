"""Streams that stop, start again, repeat batches, and whose data come late."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from paperfold.functions import status as st
from paperfold.sources.shared import new_path, tune
from paperfold.streaming import jobs, learned, runs, states


def day(x):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=x)


class Feed:
    """A folder that grows, read as a stream that goes on where it ended."""

    def __init__(self, spark, schema):
        tune(spark)
        self.spark, self.schema, self.path = spark, schema, new_path(spark, "feed")
        spark.createDataFrame([], schema).write.parquet(self.path)

    def put(self, *rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def test_job_machine_over_restarts(spark):
    feed = Feed(spark, "job_id string, ts timestamp, event_id bigint, status string, message string")
    out, state = new_path(spark, "jobs"), new_path(spark, "jobs-state")

    def run():
        with runs.rocks(spark):
            rows = runs.run_append(states.job_transitions(feed.stream(), "1 day", 5), "jobs", out, state)
        return {(r.job_id, r.event_id, r.outcome): (r.status, r.previous, r.message, r.reason) for r in rows.collect()}

    feed.put(("a", day(1), 1, "P100", None), ("a", day(3), 3, "E100", None), ("a", day(2), 2, "P300", None), ("b", day(1), 4, "E300", "x"),
             ("b", day(2), 5, "S100", None), ("c", day(3), 6, "P400", None), ("d", day(3), 7, "Q1", None))
    got = run()
    assert got["a", 3, "applied"] == ("E100", "P300", "Unknown Error (No error message provided by caller)", None)
    assert got["b", 5, "rejected"] == ("S100", "E300", None, "cancelled") and got["b", 4, "applied"][2] is None
    assert got["d", 7, "rejected"][3] == "unknown status" and len(got) == 7
    # a new run knows the jobs: backwards, out of order, failed, and a fresh start after a failure
    feed.put(("c", day(4), 8, "P200", None), ("c", day(2.5), 9, "P500", None), ("a", day(4), 10, "S100", None), ("a", day(5), 11, "P100", None), ("c", day(5), 12, "S100", "done"))
    got = run()
    assert [got["c", 8, "rejected"][3], got["c", 9, "rejected"][3], got["a", 10, "rejected"][3]] == ["backwards", "out of order", "failed"]
    assert got["a", 11, "applied"][:2] == ("P100", "E100") and got["c", 12, "applied"][:3] == ("S100", "P400", "done")
    # finished jobs expire when the watermark has passed their time, unfinished ones stay
    feed.put(("z", day(20), 13, "P100", None))
    got = run()
    assert {k[0] for k in got if k[2] == "expired"} == {"b", "c"} and got["c", 12, "expired"][0] == "S100"
    feed.put(("c", day(21), 14, "P100", None), ("a", day(21), 15, "P200", None))
    got = run()
    assert got["c", 14, "applied"][1] is None and got["a", 15, "applied"][1] == "P100"
    final = jobs.job_state(spark.read.parquet(out))
    assert {r.job_id: (r.status, r.updates, r.rejected) for r in final.collect()}["a"] == ("P200", 5, 1)


@pytest.mark.parametrize(("now", "then", "reason"), [
    (None, "P400", None), (None, "nothing", "unknown status"), ("P300", "P300", None), ("P300", "P100", "backwards"), ("P500", "S100", None), ("P100", "E300", None),
    ("E200", "P100", None), ("E200", "P300", "failed"), ("S100", "E100", "finished"), ("E300", "E100", "cancelled"), ("E300", "E300", None),
])
def test_jumps(now, then, reason):
    assert st.refusal(now, then) == reason


def test_late_early_and_missing_updates(spark):
    logs = Feed(spark, "log_id bigint, owner string, created timestamp")
    updates = Feed(spark, "owner string, ts timestamp, event_id bigint, status string")
    out, state = new_path(spark, "linked"), new_path(spark, "linked-state")

    def run():
        rows = runs.run_append(jobs.linked_updates(logs.stream(), updates.stream(), "3 days", "2 days"), "linked", out, state).collect()
        found = defaultdict(list)
        for r in rows:
            found[r.log_id].append(r.status)
        return {k: sorted(v, key=str) for k, v in found.items()}

    logs.put((1, "a", day(1)), (2, "b", day(1)), (3, "c", day(2)))
    updates.put(("a", day(2), 1, "P300"), ("early", day(3), 2, "P300"), ("a", day(9), 3, "S100"))
    assert run() == {1: ["P300"]}  # the watermark is the slower stream's: day 0
    logs.put((4, "early", day(3)))  # its update came before it
    updates.put(("b", day(4), 4, "S100"))  # late, but within the time
    assert run() == {1: ["P300"], 2: ["S100"], 4: ["P300"]}
    logs.put((5, "d", day(30)))
    updates.put(("x", day(30), 5, "P100"))
    got = run()  # nothing can come for log 3 any more
    assert got == {1: ["P300"], 2: ["S100"], 3: [None], 4: ["P300"]}
    updates.put(("c", day(3), 6, "S100"))
    assert run() == got


def test_learning_counts_a_repeated_batch_once(spark):
    feed = Feed(spark, "field_name string, raw_val string, value string, ts timestamp")
    base, state, calls = new_path(spark, "learned"), new_path(spark, "learned-state"), []

    def step(batch, batch_id):
        learned.learn(base, batch, batch_id)
        calls.append(batch_id)
        if len(calls) == 2:
            raise RuntimeError("killed after the write, before the commit")

    def table():
        return {(r.field_name, r.raw_val): (r.value, r.source, r.is_verified, r.hit_count) for r in learned.read(spark, base).collect()}

    assert table() == {}
    feed.put(("port", "pusan", "KRPUS", day(2)), ("port", "pusan", "KRXXX", day(3)), ("port", "inchon", "KRINC", day(1)), ("port", None, "x", day(1)))
    runs.run_each(feed.stream(), "learning", step, state)
    feed.put(("port", "pusan", "KRYYY", day(1)), ("unit", "kgs", "KGM", day(1)))
    with pytest.raises(StreamingQueryException):
        runs.run_each(feed.stream(), "learning", step, state)
    runs.run_each(feed.stream(), "learning", step, state)
    assert calls == [0, 1, 1]
    want = {("port", "pusan"): ("KRPUS", "AI_GENERATED", False, 3), ("port", "inchon"): ("KRINC", "AI_GENERATED", False, 1), ("unit", "kgs"): ("KGM", "AI_GENERATED", False, 1)}
    assert table() == want
    decisions = [("port", "pusan", "KRPUS", True), ("unit", "lbs", "LBR", True), ("unit", "kgs", None, False)]
    learned.decide(base, spark.createDataFrame(decisions, "field_name string, raw_val string, value string, is_verified boolean"), 0)
    want |= {("port", "pusan"): ("KRPUS", "MANUAL", True, 3), ("unit", "lbs"): ("LBR", "MANUAL", True, 0), ("unit", "kgs"): ("KGM", "MANUAL", False, 1)}
    assert table() == want
    for _ in range(2):
        learned.compact(spark, base)
        assert table() == want
    # a batch that the snapshot holds runs again, then a new one comes: flags stay, hits add up
    learned.learn(base, spark.createDataFrame([("unit", "kgs", "KGM", day(1))], feed.schema), 1)
    assert table() == want
    feed.put(("port", "pusan", "KRZZZ", day(0)))
    runs.run_each(feed.stream(), "learning", step, state)
    want["port", "pusan"] = ("KRPUS", "MANUAL", True, 4)
    assert table() == want
    learned.decide(base, spark.createDataFrame([("port", "pusan", "KRBUS", False)], "field_name string, raw_val string, value string, is_verified boolean"), 1)
    learned.compact(spark, base)
    want["port", "pusan"] = ("KRBUS", "MANUAL", False, 4)
    assert table() == want


def test_intake_takes_a_bounded_number_of_files(spark):
    folder = new_path(spark, "many-files")
    spark.range(47).repartition(47).write.parquet(folder)
    n = sum(1 for _ in spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("f")).distinct().collect())
    src = runs.stream_folder(spark, folder, "id bigint", 20).select("id", F.col("_metadata.file_path").alias("file"))
    out = runs.run_batches(src, "intake", lambda b: b.groupBy("file").agg(F.count(F.lit(1)).alias("docs")))
    per_batch = sorted(r["count"] for r in out.groupBy("batch_id").count().collect())
    assert sum(per_batch) == n and max(per_batch) == 20 and len(per_batch) == -(-n // 20)
