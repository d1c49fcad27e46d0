"""Streaming upkeep of jobs, limits, trends and learned synonyms.

All aggregations combine on the map side before they reach state, so a hot
job or user costs one partial row per input task and micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.plans.pick import pick_last
from paperfold.streaming.states import APPLIED, EXPIRED


def job_state(transitions: DataFrame) -> DataFrame:
    """State of each job as of its transitions: the last that was applied, and how many were applied and rejected."""
    applied = F.col("outcome") == APPLIED
    state = transitions.where(F.col("outcome") != EXPIRED).groupBy("job_id").agg(
        F.max_by(F.struct("status", "message"), F.when(applied, F.struct("ts", "event_id"))).alias("last"),
        F.count_if(applied).alias("updates"), F.count_if(~applied).alias("rejected"))
    return state.select("job_id", "last.status", "last.message", "updates", "rejected")


def unexpired(rows: DataFrame, expires: str, as_of: str) -> DataFrame:
    return rows.where(F.col(expires) > F.lit(as_of).cast("timestamp_ntz"))


def trend(events: DataFrame, width: str, late: str) -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("errors")).select(
        F.col("window.start").alias("start"), "total", "errors")


def request_rate(events: DataFrame, limit: int, late: str, width: str = "1 minute") -> DataFrame:
    """Requests per user and minute with the over-limit flag."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", width)).agg(F.count(F.lit(1)).alias("requests")).select(
        "user_id", F.col("window.start").alias("start"), "requests", (F.col("requests") > limit).alias("over_limit"))


def read_volume(events: DataFrame, late: str, width: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """Rows read per user over sliding windows."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", width, slide)).agg(
        F.sum("rows_read").alias("rows_read")).select("user_id", F.col("window.start").alias("start"), "rows_read")


def once(events: DataFrame, key: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latest_updates(batch: DataFrame) -> DataFrame:
    """Last job update of each log in a micro-batch, by event time."""
    return pick_last(batch, ["log_id"], ["ts", "event_id"], ["ts", "event_id", "status"])


def linked_updates(logs: DataFrame, updates: DataFrame, within: str, late: str) -> DataFrame:
    """Each log (log_id, owner, created) with every update (owner, ts, event_id, status) of its owner up to ``within`` after it.

    Both sides are streams.  A log without an update comes out with nulls once the watermark, the slower stream's latest
    time less ``late``, says that none can come any more; an update that arrives before its log waits for it as long.
    """
    logs = logs.withWatermark("created", late)
    updates = updates.withWatermark("ts", late).withColumnRenamed("owner", "by")
    on = F.expr(f"owner = by AND ts >= created AND ts <= created + INTERVAL {within}")
    return logs.join(updates, on, "left_outer").select("log_id", "created", "ts", "event_id", "status")
