"""Positions in a linked list that is a table: contraction of blocks, then of independent elements, then the way back.

First, stretches of the list whose elements stand in one block of ids are walked inside the block and become one element
each.  While more elements remain than one task should hold, every element whose hash is below those of both neighbours
is taken out (a third of them, no two of them neighbours) and its weight goes to the one before.  What remains is ranked
by one task; elements taken out then look up the one after them, round by round in reverse, and blocks their heads.  All
rounds together handle a few times as many rows as the list has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm.common import table

BLOCK, LIMIT = 1 << 14, 1 << 16  # ids a block spans; elements that one task ranks


def stretches(ids: np.ndarray, after: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each element, the place of its stretch's first one, the weight before it there, and whether it is the last.

    ``after`` holds the id of the next element; one that is not among ``ids`` (or -1) ends a stretch.
    """
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids[order], after), len(ids) - 1)
    last = ids[order][at] != after
    first = np.arange(len(ids))
    first[order[at[~last]]] = np.flatnonzero(~last)
    before = np.where(first != np.arange(len(ids)), weights[first], 0)
    while (first[first] != first).any():
        before += before[first]
        first = first[first]
    return first, before, last


_STRETCHES = "id bigint, head bigint, before bigint, last boolean, succ bigint, w bigint"


def _walked(t: pa.Table) -> pa.Table:
    ids, weights = (t.column(c).to_numpy() for c in ("id", "w"))
    first, before, last = stretches(ids, t.column("succ").fill_null(-1).to_numpy(), weights)
    return pa.table({"id": ids, "head": ids[first], "before": before, "last": last, "succ": t.column("succ"), "w": before + weights})


def ranked(elements: DataFrame, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """(id, pos) of every element of the one list in ``elements`` (id, succ): pos counts from 0 at the head.

    Ids are distinct, not negative and best without large gaps; succ is null at the end.  Neighbours with near ids make
    stretches long, but any order of ids gives the same positions.  An empty table gives no rows.
    """
    spark = elements.sparkSession
    unit = elements.select(F.col("id").cast("long"), F.col("succ").cast("long"), F.lit(1).cast("long").alias("w"))
    walked = table(unit.groupBy(F.floor(F.col("id") / block)).applyInArrow(_walked, _STRETCHES), "stretches")
    held = walked.where("last").select(F.col("head").alias("id"), "succ", "w")
    size, total = held.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    taken: list[DataFrame] = []
    if size > limit:
        ahead = held.where("succ is not null").select(F.col("succ").alias("s"), F.col("id").alias("pred"))
        held = table(held.join(ahead, F.col("id") == F.col("s"), "left").drop("s"), "list")
    while size > limit:
        draw = len(taken)
        own, one, other = (F.xxhash64(c, F.lit(draw)) for c in ("id", "pred", "succ"))
        out = F.col("pred").isNotNull() & (own < one) & (F.col("succ").isNull() | (own < other))
        gone = table(held.where(out), "list-gone")
        next_, prev = (gone.select(*[F.col(c).alias(f"{m}_{c}") for c in ("id", "pred", "succ", "w")]) for m in ("n", "p"))
        stay = held.where(~out).join(next_, F.col("succ") == F.col("n_id"), "left").join(prev, F.col("pred") == F.col("p_id"), "left")
        held = table(stay.select(
            "id", F.when(F.col("p_id").isNull(), F.col("pred")).otherwise(F.col("p_pred")).alias("pred"),
            F.when(F.col("n_id").isNull(), F.col("succ")).otherwise(F.col("n_succ")).alias("succ"), (F.col("w") + F.coalesce("n_w", F.lit(0))).alias("w"),
        ), "list")
        taken.append(gone)
        size = held.count()
    places = held.select("id", "succ", "w", F.lit(0).alias("all")).groupBy("all").applyInArrow(_walked, _STRETCHES).select("id", F.col("before").alias("pos"))
    places = table(places, "list-places")
    for gone in reversed(taken):
        known = places.select(F.col("id").alias("s"), "pos")
        found = gone.join(known, F.col("succ") == F.col("s"), "left").select("id", (F.coalesce("pos", F.lit(total)) - F.col("w")).alias("pos"))
        places = places.unionByName(table(found, "list-places"))
    heads = places.select(F.col("id").alias("h"), "pos")
    return walked.join(heads, F.col("head") == F.col("h")).select("id", (F.col("pos") + F.col("before")).alias("pos"))
