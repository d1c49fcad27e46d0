"""Lifecycle status codes and their classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status codes and status words of the lifecycle records.
PENDING, UPLOADING, ANALYZING, REFINING, PREVIEW_READY = "P100", "P200", "P300", "P400", "P500"
SUCCESS = "S100"
FAILED, ERROR, CANCELLED = "E100", "E200", "E300"
SUCCESS_CLASS = ("S100", "S200", "S300", "P500", "success", "completed", "preview_ready")
ERROR_CLASS = ("E100", "E200", "E300", "error", "failed")
PROCESSING_CLASS = ("P100", "P200", "P300", "P400", "P450", "pending", "processing", "analyzing", "syncing")
CANCELLED_CLASS = ("E300", "cancelled")
LEGACY_STATUS = {"success": "S100", "confirmed": "S100", "S200": "S100", "pending": "P100",
                 "processing": "P300", "error": "E200", "failed": "E100", "cancelled": "E300"}


# Own rule: the next states of each state.  An error can follow any work, a failed job can only start again, a success
# and a cancel are final; the same state again is an update of its message.
_WORK = (PENDING, UPLOADING, ANALYZING, REFINING, PREVIEW_READY)
JUMPS = {state: frozenset((*_WORK[k:], SUCCESS, FAILED, ERROR, CANCELLED)) for k, state in enumerate(_WORK)}
JUMPS |= {FAILED: frozenset((FAILED, PENDING)), ERROR: frozenset((ERROR, PENDING)), SUCCESS: frozenset((SUCCESS,)), CANCELLED: frozenset((CANCELLED,))}
FINAL = (SUCCESS, FAILED, ERROR, CANCELLED)


def refusal(now: str | None, then: str | None) -> str | None:
    """Why a job in state ``now`` cannot go to ``then``; None if it can.  A new job may begin anywhere."""
    if then not in JUMPS:
        return "unknown status"
    if now is None or then in JUMPS[now]:
        return None
    return {CANCELLED: "cancelled", SUCCESS: "finished", FAILED: "failed", ERROR: "failed"}.get(now, "backwards")


def is_success(c: Column) -> Column:
    return c.isin(*SUCCESS_CLASS)


def is_error(c: Column) -> Column:
    return c.isin(*ERROR_CLASS)


def is_processing(c: Column) -> Column:
    return c.isin(*PROCESSING_CLASS)


def is_cancelled(c: Column) -> Column:
    return c.isin(*CANCELLED_CLASS)


def from_order_status(c: Column) -> Column:
    """Order status letters stand in for log status codes."""
    return F.when(c == "F", SUCCESS).when(c == "O", ANALYZING).when(c == "P", FAILED)
