"""Text similarity on 0..100: ratio, token set ratio, partial ratio.

The ratio is 2*LCS/(m+n), not an edit-distance ratio.  The scorers run inside
Arrow-fed tasks; Spark decides which pairs they see.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

STRETCHES = 1 << 15
PAIRS, MASKS = 1 << 17, 1 << 21  # pairs compared at once; entries of their table of letters
_NOISE = re.compile(r"[\W_]+")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word step per character of b."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _codes(texts: list[str], letters: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the characters of each text, padded to one length (0: a character that ``letters`` lacks), and lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), int(sizes.max(initial=0))), np.uint16)
    flat = np.fromiter((letters.get(ch, 0) for text in texts for ch in text), np.uint16, int(sizes.sum()))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def lcs_of(lefts: list[str], rights: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the pairs (lefts[i], rights[j]), all pairs a step at a time.

    A pair's row of the table is kept as bits, one for each character of the left text in words of 64; a step takes the
    next character of every right text.  Pairs are worked through by falling length of the right text, so those that
    have ended drop out.  Texts with many different characters are dealt into groups, so the masks stay small.
    """
    out = np.zeros(len(i), np.int64)
    group = np.argsort(i, kind="stable")
    for first in range(0, len(group), PAIRS):
        pairs = group[first : first + PAIRS]
        own, own_at = np.unique(i[pairs], return_inverse=True)
        other, other_at = np.unique(j[pairs], return_inverse=True)
        texts = [lefts[k] for k in own.tolist()]
        letters = {ch: n for n, ch in enumerate(sorted(set("".join(texts))), 1)}
        if len(own) > 1 and len(own) * len(letters) > MASKS:  # many scripts at once: two halves
            half = len(pairs) // 2
            for part in (pairs[:half], pairs[half:]):
                out[part] = lcs_of(lefts, rights, i[part], j[part])
            continue
        codes, sizes = _codes(texts, letters)
        theirs, lengths = _codes([rights[k] for k in other.tolist()], letters)
        order = np.argsort(-lengths[other_at], kind="stable")
        own_at, other_at = own_at[order], other_at[order]
        running = len(order) - np.searchsorted(lengths[other_at][::-1], np.arange(theirs.shape[1]), "right")
        steps = np.ascontiguousarray(theirs.T)
        words = max(1, -(-codes.shape[1] // 64))
        masks = np.zeros((words, len(own), len(letters) + 1), np.uint64)
        row_at, place = np.nonzero(np.arange(codes.shape[1]) < sizes[:, None])
        np.bitwise_or.at(masks, (place // 64, row_at, codes[row_at, place]), np.uint64(1) << (place % 64).astype(np.uint64))
        rows = np.full((words, len(order)), ~np.uint64(0))
        for step, k in enumerate(running.tolist()):
            letter, left = steps[step][other_at[:k]], own_at[:k]
            carry = None
            for w in range(words):
                row = rows[w, :k]
                hit = row & masks[w, left, letter]
                added = row + hit
                if words > 1:
                    over = added < row
                    if carry is not None:
                        added += carry
                        over |= added < carry
                    carry = over.astype(np.uint64)
                rows[w, :k] = added | (row & ~hit)
        ones = np.zeros(len(order), np.int64)
        for w in range(words):
            inside = np.clip(sizes[own_at] - 64 * w, 0, 64)
            keep = np.where(inside == 64, ~np.uint64(0), (np.uint64(1) << (inside % 64).astype(np.uint64)) - np.uint64(1))
            ones += inside - np.bitwise_count(rows[w] & keep).astype(np.int64)
        out[pairs[order]] = ones
    return out


def exact_ratio(a: str, b: str) -> float:
    size = len(a) + len(b)
    return 200.0 * lcs(a, b) / size if size else 100.0


def ratio(a: str, b: str) -> int:
    return round(exact_ratio(a, b))


def normal(text: str) -> str:
    """Lower case, everything but letters and digits as blanks."""
    return _NOISE.sub(" ", text.lower()).strip()


def token_set_ratio(a: str, b: str) -> int:
    """Best ratio among shared tokens and either remainder, word order ignored."""
    left, right = set(normal(a).split()), set(normal(b).split())
    if not left or not right:
        return 0
    shared, only_l, only_r = left & right, left - right, right - left
    if shared and (not only_l or not only_r):
        return 100
    s = len(" ".join(sorted(shared)))
    gap = 1 if s else 0
    x, y = " ".join(sorted(only_l)), " ".join(sorted(only_r))
    whole = 2 * s + 2 * gap + len(x) + len(y)
    best = 100 - 100 * (len(x) + len(y) - 2 * lcs(x, y)) / whole
    if shared:
        for rest in (len(x), len(y)):
            best = max(best, 100 - 100 * (gap + rest) / (2 * s + gap + rest))
    return round(best)


def exact_ratios(lefts: list[str], rights: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``exact_ratio`` of the pairs (lefts[i], rights[j])."""
    size = _lengths(lefts)[i] + _lengths(rights)[j]
    return np.where(size > 0, 200.0 * lcs_of(lefts, rights, i, j) / np.maximum(size, 1), 100.0)


def ratios(lefts: list[str], rights: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``ratio`` of the pairs (lefts[i], rights[j])."""
    return np.rint(exact_ratios(lefts, rights, i, j)).astype(np.int64)


def token_set_ratios(lefts: list[str], rights: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``token_set_ratio`` of the pairs (lefts[i], rights[j]); only pairs that share a token differ from their own texts."""
    left, right = ([frozenset(normal(x).split()) for x in texts] for texts in (lefts, rights))
    shares = np.fromiter((not left[a].isdisjoint(right[b]) for a, b in zip(i.tolist(), j.tolist())), bool, len(i))
    out = np.zeros(len(i), np.int64)
    apart, some = np.flatnonzero(~shares), np.flatnonzero(shares)
    x, y = ([" ".join(sorted(t)) for t in tokens] for tokens in (left, right))
    size = _lengths(x)[i[apart]] + _lengths(y)[j[apart]]
    both = (_lengths(x)[i[apart]] > 0) & (_lengths(y)[j[apart]] > 0)
    apart, size = apart[both], size[both]
    out[apart] = np.rint(100 - 100 * (size - 2 * lcs_of(x, y, i[apart], j[apart])) / size)
    out[some] = 100
    pairs = [(left[a], right[b]) for a, b in zip(i[some].tolist(), j[some].tolist())]
    some, pairs = some[[not (a <= b or b <= a) for a, b in pairs]], [(a, b) for a, b in pairs if not (a <= b or b <= a)]
    x, y, s = ([" ".join(sorted(t)) for t in sets] for sets in ([a - b for a, b in pairs], [b - a for a, b in pairs], [a & b for a, b in pairs]))
    lx, ly, s, each = _lengths(x), _lengths(y), _lengths(s), np.arange(len(some))
    best = 100 - 100 * (lx + ly - 2 * lcs_of(x, y, each, each)) / (2 * s + 2 + lx + ly)
    for rest in (lx, ly):
        best = np.maximum(best, 100 - 100 * (1 + rest) / (2 * s + 1 + rest))
    out[some] = np.rint(best)
    return out


def _lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def exact_partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Best ratio of the shorter text against any stretch of the longer one of its length; 0 if it is below ``least``."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(short), len(long)
    if not m:
        return 0.0 if n else 100.0
    if short in long:
        return 100.0
    # letter counts bound the common subsequence of every stretch; the most promising ones are compared first
    letters = {ch: i for i, ch in enumerate(dict.fromkeys(short))}
    need = np.array([short.count(ch) for ch in letters])[:, None]
    best = least - 1e-6 if least else 0.0
    for first in range(1 - m, n, STRETCHES):
        starts = np.arange(first, min(n, first + STRETCHES))
        lo, hi = np.maximum(starts, 0), np.minimum(starts + m, n)
        base = int(lo[0])
        codes = np.array([letters.get(ch, -1) for ch in long[base:int(hi[-1])]])
        seen = np.zeros((len(letters), len(codes) + 1), dtype=np.int32)
        np.cumsum(codes == np.arange(len(letters))[:, None], axis=1, out=seen[:, 1:])
        common = np.minimum(seen[:, hi - base] - seen[:, lo - base], need).sum(axis=0)
        bound = 200.0 * common / (m + hi - lo)
        # moved by one, a stretch's common subsequence changes by one at most, so each comparison bounds its neighbours
        while bound.max() > best:
            i = int(bound.argmax())
            score = exact_ratio(short, long[lo[i]:hi[i]])
            best = max(best, score)
            length = score * (m + hi[i] - lo[i]) / 200 + 1e-6
            bound = np.minimum(bound, 200.0 * (length + np.abs(starts - starts[i])) / (m + hi - lo))
            bound[i] = score
    return best if best >= least else 0.0


def partial_ratio(a: str, b: str) -> int:
    return round(exact_partial_ratio(a, b))


def _distinct(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, list[str], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Rows with both texts, the distinct texts of each side, the distinct pairs, and each row's pair."""
    rows = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    i, lefts = pd.factorize(a.iloc[rows])
    j, rights = pd.factorize(b.iloc[rows])
    pairs, which = np.unique(i.astype(np.int64) * max(1, len(rights)) + j, return_inverse=True)
    return rows, list(lefts), list(rights), pairs // max(1, len(rights)), pairs % max(1, len(rights)), which


def _column(fn, kind=LongType(), dtype="Int64"):
    """A column function of two texts from one of lists of distinct texts and pairs of them; null for a null."""
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        rows, lefts, rights, i, j, which = _distinct(a, b)
        out = pd.Series([None] * len(a), dtype=dtype)
        if len(rows):
            out.iloc[rows] = fn(lefts, rights, i, j)[which]
        return out

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def _each(fn):
    return lambda lefts, rights, i, j: np.array([fn(lefts[a], rights[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)])


ratio_udf = _column(ratios)
token_set_ratio_udf = _column(token_set_ratios)
partial_ratio_udf = _column(_each(partial_ratio))
ratio_float_udf = _column(exact_ratios, DoubleType(), "float64")


def partial_ratio_from(least: float):
    """Partial ratio as a column function; what is below ``least`` is 0, which spares most comparisons."""
    return _column(_each(lambda a, b: exact_partial_ratio(a, b, least)), DoubleType(), "float64")
