"""Secrets in texts: fixed patterns, and the cost of guessing the values that stand in a credential's context.

The cost is that of the cheapest way to put a value together, found by dynamic programming over its positions: known
words (by rank, with capitals and digits for letters), dates, repeats, walks on a keyboard or in a row of characters, and
brute force for what is left.  A value that is dear to guess is a secret; ``password=changeme2024`` is not.

Words are ranked by the number of documents that use them, after a short list of words that people choose first.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm.common import map_texts, table

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"[0-9a-f]{24}")
# what names a value as a credential; the scheme of an authorization is part of it
_CONTEXT = re.compile(
    r"""(?:(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|credentials?|auth(?:orization)?)["']?\x20*[:=]\x20*["']?(?ai:(?:bearer|basic|digest|token)\x20+)?"""
    r"""|(?ai:\bbearer(?:\x20*[:=])?\x20*)["']?)([^\s"'<>,;]+)"""
)
_BEARER = re.compile(r"(?ai:bearer)")
# Words that people choose first, by rank.
COMMON_WORDS = (
    "password", "qwerty", "letmein", "admin", "welcome", "monkey", "dragon", "master", "login", "princess", "sunshine",
    "football", "shadow", "secret", "changeme", "default", "example", "test", "user", "guest", "root", "hello", "summer",
    "winter", "spring", "autumn", "love", "pass", "temp", "demo", "sample", "your", "token", "key", "none", "null", "true",
    "false", "server", "database", "system", "public", "private", "home", "work", "name", "mail", "access", "api", "xxx",
)
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEAST_LOG10 = 9.0  # guesses (as a power of ten) from which on a value counts as a secret
_LEET = str.maketrans("013457@$!", "oieastasi")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
_YEAR = re.compile(r"(?:19|20)\d\d")
UNIT = 8192  # characters of a unit that may be repeated
WALK = 64  # characters of a walk, at most, before its end
WORDS = 20_000  # words ranked by the corpus, at most: some 300 kB, held by the driver and sent to each task
# words of prose: not what follows or stands before a colon or an equals sign
_PROSE = r"""(?<![:=]["']?\x20?["']?)\b[a-z]{3,}\b(?!["']?\x20?[:=])"""


def _one(c: str) -> float:
    """Cost of guessing one character."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33)


def _beside() -> dict[str, str]:
    beside: dict[str, str] = {}
    for row in KEY_ROWS:
        for a, b in zip(row, row[1:], strict=False):
            beside[a] = beside.get(a, "") + b
            beside[b] = beside.get(b, "") + a
    return beside


_BESIDE = _beside()
_RANK = {w: k + 1 for k, w in enumerate(COMMON_WORDS)}


def frequent_words(docs: DataFrame, most: int = WORDS) -> list[str]:
    """The words that most documents use, counted over all whole texts; words of one document are left out."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(_PROSE), F.lit(0)))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # written first: each task's candidates go to one task, and only the words that are left to the driver
    first = table(counted.orderBy(F.desc("n"), "word").limit(most), "frequent-words")
    return [r["word"] for r in first.orderBy(F.desc("n"), "word").collect()]


def ranked_words(words: list[str]) -> dict[str, int]:
    """Ranks from 1: the fixed words, then the others."""
    return {w: k for k, w in enumerate(dict.fromkeys((*COMMON_WORDS, *words)), 1)}


def repeats_of(value: str) -> dict[int, list[tuple[int, int]]]:
    """For each place the repeats that start there: (end, size of the unit).

    A repeat goes on as far as it goes; of several units at one place, those are taken that get farther than all shorter
    ones do.
    """
    units = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, found = len(units), defaultdict(list)
    farthest = np.zeros(n, np.int64)
    for size in range(1, min(n // 2, UNIT) + 1):
        differ = np.flatnonzero(units[:-size] != units[size:])
        if not len(differ) or np.diff(differ, prepend=-1, append=n - size).max() > size:
            at = np.arange(n - size)
            same = np.append(differ, n - size)[np.searchsorted(differ, at)] - at  # how long each place equals the one a unit on
            ends = at + size * (1 + same // size)
            for i in np.flatnonzero((same >= size) & (ends > farthest[: n - size])).tolist():
                found[i].append((int(ends[i]), size))
                farthest[i] = ends[i]
    return found


def guess_cost(value: str, ranks: dict[str, int] = _RANK, longest: int = max(map(len, COMMON_WORDS))) -> float:
    """Least log10 of guesses for a value; 0 for an empty one.  ``longest`` is the length of the longest word."""
    n = len(value)
    best = [0.0] + [math.inf] * n
    lower = value.lower() if len(value.lower()) == n else value
    plain = lower.translate(_LEET)
    repeats = repeats_of(value)
    walk_ends = list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if lower[i + 1] in _BESIDE.get(lower[i], ""):
            walk_ends[i] = walk_ends[i + 1]
    walk_turns = [0] * (n + 1)  # turns before a place: its step goes another way than the step before
    for i in range(2, n):
        walk_turns[i + 1] = walk_turns[i] + ((lower[i] > lower[i - 1]) != (lower[i - 1] > lower[i - 2]))
    part = math.log10(2)  # each part that isn't brute force also says what kind it is
    for i in range(n):
        here = best[i]

        def reach(end: int, cost: float, here: float = here) -> None:
            if here + cost < best[end]:
                best[end] = here + cost

        reach(i + 1, _one(value[i]))
        for text, extra in ((lower, 0.0), (plain, 0.5)):
            for end in range(i + 3, min(n, i + longest) + 1):
                rank = ranks.get(text[i:end])
                if rank:
                    capitals = sum(c.isupper() for c in value[i:end])
                    reach(end, part + math.log10(rank + 1) + extra + (0.3 if capitals in (1, end - i) else 0.3 * capitals))
        m = _DATE.match(value, i)
        if m:
            reach(m.end(), part + math.log10(365 * 120) + 0.3)
        m = _YEAR.match(value, i)
        if m:
            reach(m.end(), part + math.log10(120))
        for end in {*range(i + 3, min(walk_ends[i], i + WALK) + 1), *([walk_ends[i]] if walk_ends[i] >= i + 3 else ())}:
            reach(end, part + math.log10(47 * (end - i)) + 0.6 * (walk_turns[end] - walk_turns[i + 2]))
        for end, size in repeats.get(i, ()):
            reach(end, part + sum(map(_one, value[i : i + size])) + math.log10((end - i) // size))
    return best[n]


def spans(text: str, least: float = LEAST_LOG10, ranks: dict[str, int] = _RANK, longest: int = max(map(len, COMMON_WORDS))) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, cost) of a text's secrets, by start and then by kind; cost is 0 but for ``guess``."""
    found: list[tuple[int, int, str, float]] = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign", 0.0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if ":" in text or "=" in text or _BEARER.search(text):
        for m in _CONTEXT.finditer(text):
            cost = guess_cost(m[1], ranks, longest)
            if cost >= least:
                found.append((*m.span(1), "guess", cost))
    if "AKIA" in text:
        found += [(*m.span(), "access", 0.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_LONG.search(text):
        found += [(*m.span(), "hex", 0.0) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, least: float = LEAST_LOG10, words: list[str] | None = None) -> DataFrame:
    """(doc_id, spans: array of start, end, kind, log10_guesses) for every row of ``docs`` (doc_id, text).

    ``words`` are known words in falling rank, by default those that most of the documents use.

    Positions are code points, ends exclusive.  A null or empty text has none; rows are never joined, so repeated ids,
    ties and further columns make no difference, and an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("log10_guesses", pa.float64())]))

    ranks = ranked_words(frequent_words(docs) if words is None else words)
    longest = max(map(len, ranks))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[dict(zip(("start", "end", "kind", "log10_guesses"), s, strict=True)) for s in spans(t or "", least, ranks, longest)] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    schema = "doc_id bigint, spans array<struct<start: bigint, end: bigint, kind: string, log10_guesses: double>>"
    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and digests of ``scan``'s spans for each row."""
    base = F.filter("spans", lambda s: s["kind"] != "guess")

    def joined(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["log10_guesses"])).alias("log10_guesses"),
    )


