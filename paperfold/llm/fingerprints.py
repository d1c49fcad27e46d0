"""Fingerprints of texts from prefix polynomial hashes.

Prefix arrays modulo two primes give the hash of any span in a step, so spans are compared without being read again, and
the longest common extension of two places is found by binary search.  A fingerprint holds the hash of the whole text
and, for each of 128 slots, the least hash of the spans of 16 code points that fall into the slot; the share of slots
that agree estimates how many spans two texts have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm.common import mix, parts_of

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353 % 2147483629)
SPAN, SLOTS, HEX = 16, 128, 3
EMPTY = "." * HEX


class _Powers:
    """Powers of a base and of its inverse modulo a prime, by doubling."""

    def __init__(self, base: int, prime: int) -> None:
        self.prime, self.base, self.inverse = np.uint64(prime), base, pow(base, -1, prime)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, int(self.prime))) % self.prime])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, int(self.prime))) % self.prime])
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


class PrefixHash:
    """The prefix arrays of one text (its code points)."""

    def __init__(self, units: np.ndarray) -> None:
        self.size = len(units)
        self.sums = []
        values = units.astype(np.uint64) + np.uint64(1)
        for powers in _POWERS:
            up, _ = powers.to(self.size + 1)
            sums = np.zeros(self.size + 1, np.uint64)
            np.cumsum(values * up[:-1] % powers.prime, out=sums[1:])
            sums %= powers.prime
            self.sums.append(sums)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans; equal spans have equal hashes wherever they stand."""
        out = np.zeros(len(starts), np.uint64)
        for powers, sums in zip(_POWERS, self.sums, strict=True):
            _, down = powers.to(self.size + 1)
            h = (sums[ends] + powers.prime - sums[starts]) % powers.prime * down[starts] % powers.prime
            out = out << np.uint64(31) | h
        return out

    def span(self, start: int, end: int) -> int:
        out = 0
        for powers, sums in zip(_POWERS, self.sums, strict=True):
            p = int(powers.prime)
            _, down = powers.to(self.size + 1)
            out = out << 31 | (int(sums[end]) - int(sums[start])) % p * int(down[start]) % p
        return out

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of a size, the whole text if it is shorter."""
        if not self.size:
            return np.zeros(0, np.uint64)
        starts = np.arange(max(1, self.size - size + 1))
        return self.spans(starts, np.minimum(starts + size, self.size))


def same(a: PrefixHash, i: int, b: PrefixHash, j: int, size: int) -> bool:
    """Whether a[i:i+size] and b[j:j+size] are equal."""
    return i + size <= a.size and j + size <= b.size and a.span(i, i + size) == b.span(j, j + size)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:]."""
    low, high = 0, min(a.size - i, b.size - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def fingerprint(hashed: PrefixHash) -> str:
    """Hash of the whole text and three hexadecimal digits for each slot; equal texts have equal fingerprints."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max)
    values = mix(hashed.windows(SPAN))
    np.minimum.at(least, (values & np.uint64(SLOTS - 1)).astype(np.int64), values >> np.uint64(7))
    digits = (mix(least) & np.uint64(16**HEX - 1)).tolist()
    empty = (least == np.iinfo(np.uint64).max).tolist()
    return f"{hashed.span(0, hashed.size):016x}{hashed.size:x}:" + "".join(EMPTY if e else f"{d:0{HEX}x}" for d, e in zip(digits, empty, strict=True))


def likeness(a: str, b: str) -> float:
    """Estimated share of the spans of two texts that both have: 1 for equal texts."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(f.rpartition(":")[2].encode(), f"S{HEX}") for f in (a, b))
    filled = (x != EMPTY.encode()) | (y != EMPTY.encode())
    return float(np.sum((x == y) & filled) / max(1, np.sum(filled)))


def units_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_edited", pa.int64()), ("common_next", pa.int64()),
])


def _described(doc_id: int | None, text: str, own: PrefixHash, mark: str, after: str, other: PrefixHash, other_mark: str) -> tuple:
    n = len(text) // 2
    changed = text[: len(text) - n] + after[:n]
    edited = own if changed == text else PrefixHash(units_of(changed))
    edited_mark = mark if edited is own else fingerprint(edited)
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mark, edited_mark, likeness(mark, edited_mark),
        likeness(mark, other_mark), common_extension(own, 0, edited, 0), common_extension(own, 0, other, 0),
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its text with the last half taken from the next row.

    Rows follow each other by doc_id, null first, rows of one doc_id by text; the first follows the last.  Rows are
    dealt into ranges of doc_id, and the first rows of a range are sent to the range before as well, so no task needs
    another's rows and texts are shuffled once.  A null text is empty; an empty text shares nothing with any other text
    and all with an empty one; a single row is its own next; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wanted = parts_of(spark)
    bounds = np.array(sorted(set(rows.where("doc_id is not null").approxQuantile("doc_id", [k / wanted for k in range(1, wanted)], 0.1 / wanted))))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "right").astype(np.int32))

    heads = rows.select(key.alias("k")).groupBy(place("k").alias("range")).agg(F.min("k").alias("k")).orderBy("range").collect()  # one row for each range
    before = {r["k"]: heads[i - 1]["range"] for i, r in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def targets(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, ids.to_numpy(), "right")
        return pd.Series([[2 * r] if k not in before else [2 * r, 2 * before[k] + 1] for k, r in zip(ids, own.tolist(), strict=True)])

    dealt = rows.select("doc_id", "text", F.explode(targets(key)).alias("t"))
    dealt = dealt.select((F.col("t") / 2).cast("int").alias("range"), (F.col("t") % 2).alias("ahead"), "doc_id", "text")
    dealt = dealt.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("ahead", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = None, False
        for batch in batches:
            out = []
            for ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if over:
                    break
                hashed = PrefixHash(units_of(text))
                mark = fingerprint(hashed)
                if held is not None:
                    out.append(_described(*held, text, hashed, mark))
                held, over = (doc_id, text, hashed, mark), bool(ahead)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _ROW, strict=True)], schema=_ROW)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited bigint, common_next bigint"
    return dealt.mapInArrow(run, schema)
