"""Token ids of whole texts, by a tokenizer file.

For byte-level BPE the pieces that the tokenizer encodes on their own (words with their blank, runs of digits, signs and
blanks) are cut for many texts at once with array operations, and every distinct piece is encoded by the tokenizer once;
the ids of a text are those of its pieces in a row.  Texts with contractions, special tokens, rare blanks or characters
beyond U+04FF, and all texts of other kinds of tokenizers, go to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from paperfold.llm.common import ENCODERS, Powers, chunks, span_hashes

_OTHER, _LETTER, _NUMBER, _BLANK, _WHOLE = range(5)
_LIMIT, _CACHED, _AT_ONCE, _JOINED = 0x500, 1 << 20, 500, 4000


def _kinds() -> np.ndarray:
    """Kind of each code point; all from _LIMIT on share the last entry."""
    kinds = np.full(_LIMIT + 1, _WHOLE, np.uint8)
    for c in range(_LIMIT):
        group = unicodedata.category(chr(c))[0]
        kinds[c] = {"L": _LETTER, "N": _NUMBER}.get(group, _OTHER)
    kinds[[9, 10, 11, 12, 13, 32, 0xA0]] = _BLANK
    kinds[[0x1C, 0x1D, 0x1E, 0x1F, 0x85]] = _WHOLE
    for c in range(_LIMIT):  # not assigned (here): may be assigned elsewhere
        if unicodedata.category(chr(c)) == "Cn":
            kinds[c] = _WHOLE
    return kinds


class Pieces:
    """Ids of known pieces by their hash, in arrays.  Beyond _CACHED pieces, the half not seen for longest is dropped."""

    def __init__(self) -> None:
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted by hash
        self.sizes, self.starts, self.seen = (np.zeros(0, np.int32) for _ in range(3))
        self.pool, self.clock = np.zeros(0, np.uint32), 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes (sorted, distinct) are known, and the entries of those."""
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        entry = self.entry[at[known]]
        self.clock += 1
        self.seen[entry] = self.clock
        return known, entry

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New pieces (hashes sorted, distinct, unknown) with their ids in a row."""
        if len(self.hashes) + len(hashes) > _CACHED:
            self._drop()
        at = np.searchsorted(self.hashes, hashes)
        entry = np.arange(len(self.sizes), len(self.sizes) + len(hashes), dtype=np.int32)
        self.hashes, self.entry = np.insert(self.hashes, at, hashes), np.insert(self.entry, at, entry)
        self.starts = np.append(self.starts, (len(self.pool) + np.cumsum(sizes) - sizes).astype(np.int32))
        self.sizes = np.append(self.sizes, sizes.astype(np.int32))
        self.seen = np.append(self.seen, np.full(len(hashes), self.clock, np.int32))
        self.pool = np.append(self.pool, ids.astype(np.uint32))

    def _drop(self) -> None:
        """Keep what was seen after the median time, and whatever the text at hand has shown."""
        keep = (self.seen > np.median(self.seen)) | (self.seen == self.clock) if len(self.seen) else np.zeros(0, bool)
        self.pool = self.pool[np.repeat(keep, self.sizes)]
        moved = np.cumsum(keep, dtype=np.int32) - 1
        stays = keep[self.entry]
        self.hashes, self.entry = self.hashes[stays], moved[self.entry[stays]]
        self.sizes, self.seen = self.sizes[keep], self.seen[keep]
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)

    def ids(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries in a row, and how many each has."""
        sizes = self.sizes[entry].astype(np.int64)
        done = np.cumsum(sizes)
        return self.pool[np.repeat(self.starts[entry] - (done - sizes), sizes) + np.arange(done[-1] if len(done) else 0)], sizes


class Encoder:
    """Encodes columns of texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a process for each core
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        cut = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec["model"]["type"] == "BPE" and not spec.get("normalizer") and cut.get("type") == "ByteLevel"
            and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.kinds, self.powers, self.pieces = _kinds(), Powers(), Pieces()
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, encoded whole, a few at a time: the tokenizer's own results are large."""
        out: list[np.ndarray] = []
        for k in range(0, len(texts), _AT_ONCE):
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[k : k + _AT_ONCE], add_special_tokens=False)]
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[str], joins: np.ndarray) -> None:
        """Encode unknown pieces.  Those that may stand between line ends (``joins``) go as one text, cut at the line ends."""
        if len(self.line) != 1:
            joins = np.zeros(len(pieces), bool)
        alone, others = np.flatnonzero(~joins).tolist(), np.flatnonzero(joins).tolist()
        for k in range(0, len(others), _JOINED):
            some = others[k : k + _JOINED]
            ids = np.array([*self.tokenizer.encode("\n".join([pieces[i] for i in some]), add_special_tokens=False).ids, *self.line], np.uint32)
            cut = ids == self.line[0]
            sizes = np.diff(np.flatnonzero(cut), prepend=-1) - 1
            assert len(sizes) == len(some)
            self.pieces.add(hashes[some], ids[~cut], sizes)
        if alone:
            parts = self.whole([pieces[i] for i in alone])
            self.pieces.add(hashes[alone], np.concatenate(parts), np.array([len(x) for x in parts]))

    def _cut(self, units: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces of all texts, and which texts have to be encoded whole."""
        kind = self.kinds[np.minimum(units, _LIMIT)]
        n = len(units)
        head = np.zeros(n + 1, bool)
        head[at] = True
        blank = kind == _BLANK
        changed = np.ones(n, bool)
        changed[1:] = kind[1:] != kind[:-1]
        changed |= head[:-1]
        taken = np.zeros(n, bool)  # a single blank before a run belongs to it
        taken[1:] = (units[:-1] == 32) & ~head[1:-1]
        start = changed & (blank | ~taken)
        last = np.zeros(n, bool)  # the last of several blanks before a run stands alone or goes with the run
        last[:-1] = blank[:-1] & ~blank[1:] & ~head[1:-1]
        start |= last
        odd = kind == _WHOLE
        quote = np.flatnonzero(units[:-1] == 39)
        odd[quote] |= np.isin(units[quote + 1], np.frombuffer(b"stmlvrd", np.uint8))
        return np.flatnonzero(start), odd

    def columns(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Groups of texts: first row, end row, ids of all in a row, offsets of the rows in them.  Null is empty."""
        for first, end, data, offsets in chunks(column):
            text = data.tobytes().decode()
            if not self.by_piece:
                yield first, end, *self._joined(self.whole([data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)]))
                continue
            units = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            starts, odd = self._cut(units, at)
            ends = np.append(starts[1:], len(units))
            hashes = span_hashes(units, starts, ends, self.powers)
            distinct, where, which = np.unique(hashes, return_index=True, return_inverse=True)
            known, _ = self.pieces.find(distinct)
            new = np.flatnonzero(~known)
            if len(new):
                body = starts[where[new]]
                body += (units[body] == 32) & (ends[where[new]] - body > 1)
                kinds = self.kinds[np.minimum(units[body], _LIMIT)]
                self._learn(distinct[new], [text[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)], (kinds != _BLANK) & (kinds != _WHOLE))
            _, entry = self.pieces.find(distinct)
            ids, sizes = self.pieces.ids(entry[which])
            done = np.concatenate([[0], np.cumsum(sizes)])
            rows = done[np.searchsorted(starts, at)]
            odd_rows = set((np.searchsorted(at, np.flatnonzero(odd), "right") - 1).tolist())
            for mark in self.special:
                found = text.find(mark)
                while found >= 0:
                    odd_rows.add(int(np.searchsorted(at, found, "right")) - 1)
                    found = text.find(mark, found + 1)
            if odd_rows:
                parts = [ids[a:b] for a, b in zip(rows, rows[1:], strict=False)]
                picked = sorted(odd_rows)
                for i, x in zip(picked, self.whole([text[at[i] : at[i + 1]] for i in picked]), strict=True):
                    parts[i] = x
                ids, rows = self._joined(parts)
            yield first, end, ids, rows

    @staticmethod
    def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def encoder(path: str) -> Encoder:
    """The Encoder of this process: functions travel by value, so a global of this module would be new for each task."""
    kept = sys.__dict__.setdefault(ENCODERS, {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def default_path() -> str:
    """The byte-level BPE file that comes with the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
