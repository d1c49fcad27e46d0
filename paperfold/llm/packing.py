"""Packing documents into sequences by best-two-fit, on counts of lengths.

A bin is filled greedily with the largest piece that fits; then its smallest piece is replaced with the two unpacked
pieces that fill the widened gap most tightly, as long as this fills it better.  Pieces of one length are alike, so the
plan is made on at most ``capacity`` counts: a bin's pattern is used as often as the counts allow, which is what filling
bin after bin would do.  The pieces, numbered within their length, then look up their place in the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm.common import map_texts, numbered, parts_of, table
from paperfold.llm.tokens import default_path, encoder

END_ID = 2
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token ids of each text and an end id, cut where longer than capacity."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple[int, int, int, int, int]] = []
        for first, _, ids, at in encoder(tokenizer).columns(batch.column(1)):
            for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
                whole = np.append(ids[a:b], END_ID).astype("<u4")
                start, length = 0, len(whole) % capacity or min(len(whole), capacity)
                piece = 0
                while start < len(whole):
                    rows.append((first + k, piece, start, length, zlib.crc32(whole[start : start + length].tobytes())))
                    start, piece, length = start + length, piece + 1, capacity
        index, piece, start, length, crc = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(index)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, _PIECES, encodes=True)


def _tightest_two(left: np.ndarray, room: int) -> tuple[int, int, int]:
    """(a + b, a, b) with the largest sum up to ``room`` of two lengths that are left, or zeros.

    Lengths under a quarter of the capacity are not taken: they fill the gaps of later bins.
    """
    lengths = np.flatnonzero(left[: room + 1])
    lengths = lengths[lengths >= (len(left) - 1) // 4]
    if not len(lengths):
        return 0, 0, 0
    best = (0, 0, 0)
    j = np.searchsorted(lengths, room - lengths, "right") - 1  # the largest partner that fits
    for i in range(len(lengths) - 1, -1, -1):
        a, k = int(lengths[i]), min(int(j[i]), i)
        if k == i and left[a] < 2:
            k -= 1
        if k >= 0 and a + int(lengths[k]) > best[0]:
            best = (a + int(lengths[k]), a, int(lengths[k]))
            if best[0] == room:
                break
    return best


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a bin, longest first) and how many bins have them."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[list[int], int]] = []
    while left.any():
        used: Counter[int] = Counter()
        gap = capacity
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            n = min(int(left[length]), gap // length)
            used[length] += n
            left[length] -= n
            gap -= n * length
        while gap:
            smallest = min(used)
            total, a, b = _tightest_two(left, gap + smallest)
            if total <= smallest:
                break
            used[smallest] -= 1
            used += Counter()
            left[smallest] += 1
            for x in (a, b):
                used[x] += 1
                left[x] -= 1
            gap += smallest - total
        more = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= more * n
        plan.append((sorted(used.elements(), reverse=True), more + 1))
    return plan


def _places(plan: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, ranges of its numbers: where they begin, the sequence of the first, the offset in the sequence."""
    rows: list[tuple[int, int, int, int]] = []
    taken = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for lengths, n in plan:
        offset = 0
        for x in lengths:
            rows.append((x, int(taken[x]), sequence, offset))
            taken[x] += n
            offset += x
        sequence += n
    rows.sort()
    length, low, first, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    base = np.concatenate([[0], np.cumsum(taken)])
    return {"base": base, "at": base[length] + low, "low": low, "first": first, "offset": offset}


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``.

    ``docs`` has doc_id and text; other columns are ignored.  A null text is empty and is one piece, the end id alone;
    a null doc_id is carried along; repeated rows are packed as often as they come; an empty table gives no rows.  The
    driver holds one count for each length, at most ``capacity`` of them.
    """
    spark = docs.sparkSession
    pieces = table(pieces_of(docs, capacity, tokenizer or default_path()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(best_two_fit(counts, capacity), capacity)
    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "number", parts_of(spark))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 5))
        k = np.searchsorted(places["at"], places["base"][length] + number, "right") - 1
        return pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in (1, 2, 3, 0, 4)), pa.array(places["first"][k] + number - places["low"][k]), pa.array(places["offset"][k])],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )

    return map_texts(ranked, place, _PIECES + ", sequence_id bigint, offset bigint", encodes=True)
