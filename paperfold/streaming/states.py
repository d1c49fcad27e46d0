"""Jobs as state machines: a value state for each job, legal jumps, expiry of finished jobs by timer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperfold.functions import status as st
from paperfold.operators.lookups import NO_MESSAGE

# times travel as microseconds: what tasks see of a timestamp depends on their time zone
_STATE = "status string, message string, at bigint, event_id bigint"
_OUT = "job_id {kind}, event_id bigint, at bigint, status string, message string, previous string, outcome string, reason string"
_ROW = Row("job_id", "event_id", "at", "status", "message", "previous", "outcome", "reason")
APPLIED, REJECTED, EXPIRED = "applied", "rejected", "expired"


class JobMachine(StatefulProcessor):
    """Applies the updates of a job in event order; what the state does not allow comes out with a reason."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now, message, *last = self.job.get() if self.job.exists() else (None, None)
        for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
            place = [r["at"], r["event_id"]]
            reason = "out of order" if last and place <= last else st.refusal(now, r["status"])
            if reason:
                yield _ROW(key[0], r["event_id"], r["at"], r["status"], r["message"], now, REJECTED, reason)
                continue
            before, now, last, message = now, r["status"], place, r["message"]
            if now in (st.FAILED, st.ERROR):
                message = message or NO_MESSAGE
            elif now == st.CANCELLED:
                message = None
            yield _ROW(key[0], r["event_id"], r["at"], now, message, before, APPLIED, None)
        if last:
            self.job.update((now, message, *last))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if now in st.FINAL:
                self.handle.registerTimer(last[0] // 1000 + self.keep_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now, message, at, event_id = self.job.get()
        self.job.clear()
        yield _ROW(key[0], event_id, at, now, message, now, EXPIRED, None)

    def close(self) -> None:
        pass


def job_transitions(events: DataFrame, late: str, keep_days: int) -> DataFrame:
    """Every update (job_id, ts, event_id, status, message) as applied or rejected, and finished jobs as they expire.

    A job's updates of a micro-batch are applied by (ts, event_id); one that is older than what was applied before is
    rejected as out of order, and one that the watermark has passed is not looked at.  A finished job is forgotten ``keep_days`` after its last update, once the watermark is
    that far; an update that comes later begins the job anew.  A job's updates of one micro-batch stand in one task;
    a stream that reads a bounded number of files at a time bounds them.
    """
    kind = events.schema["job_id"].dataType.simpleString()
    rows = events.select("job_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "status", "message").withWatermark("ts", late)
    out = rows.groupBy("job_id").transformWithState(
        JobMachine(keep_days * 86_400_000), _OUT.format(kind=kind), outputMode="Append", timeMode="EventTime")
    return out.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "ts")
