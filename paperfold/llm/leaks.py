"""Benchmark passages in documents, by latent semantic retrieval.

Documents are cut into passages once for each class of item lengths, so that every stretch in which an item can be
confirmed lies whole in a passage of a few item lengths.  A candidate is a passage that contains enough of the item's words:
of its rarer words so many that no stretch with ``PARAPHRASE`` of the item in order has fewer.  Candidates are confirmed by
the longest common subsequence of words and, where the text is a paraphrase, by the item's answer (its last sentence); which
items share a block makes no difference.  A confirmed stretch and its item are TF-IDF vectors over the words of the items,
with document frequencies counted over all documents; their cosine is taken in the latent space of a randomised SVD of the
items' matrix, its products summed over partitions.  No cosine is asked for: a least one would only lose matches.

Items go block by block, a block holding at most ``BLOCK_WORDS`` words (longer items are cut at this length), so what a
task is sent is bounded whatever the size of the benchmark.  A rank as large as the number of a block's passages makes
the latent cosine the exact one; ``BLOCK_ITEMS`` is that rank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm.common import Powers, chunks, map_texts, seeds, table, words

BLOCK_ITEMS, BLOCK_WORDS = 256, 16384
COMMON, COMMON_LEAST, RAREST = 0.01, 50, 4  # words in more documents weigh nothing, but each item keeps its four rarest
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.7  # shares of an item's (answer's) words in common, in order
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(33, 128) if not chr(c).isalnum()]] = 32


def plain_words(column: pa.Array, powers: Powers):
    """For groups of texts: first row, end row, hashes of the words, offsets of the rows in them.

    Words are lower case; ASCII signs and the dashes and quotation marks of U+2000 to U+203F part them.
    """
    lower = pa.array([(t or "").lower() for t in column.to_pylist()], pa.large_string())
    for first, end, units, offsets in chunks(lower):
        units = _PLAIN[units]
        sign = np.flatnonzero((units[:-2] == 0xE2) & (units[1:-1] == 0x80)) if len(units) > 2 else np.zeros(0, np.int64)
        for k in range(3):
            units[sign + k] = 32
        yield first, end, *words(units, offsets, powers, lower=False)


def word_hashes(text: str, powers: Powers) -> np.ndarray:
    return next(plain_words(pa.array([text]), powers))[2]


@dataclass
class Group:
    """Items of a block whose lengths are alike, and where their telling words are."""

    items: np.ndarray
    needs: np.ndarray  # telling words of each item, counted as they stand in it, that any match has
    stretch: int  # words of the longest stretch compared with one of them
    edges: np.ndarray  # of each word of the vocabulary in ``holder`` and ``times``
    holder: np.ndarray  # places in ``items``
    times: np.ndarray


@dataclass
class Block:
    """Some items, their vocabulary and, once fitted, the latent space."""

    item_ids: list[int]
    sequences: list[np.ndarray]  # word hashes of each item
    answers: list[np.ndarray]  # word hashes of its last sentence
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray | None = None  # inverse document frequencies
    scores: np.ndarray | None = None  # words x items: a word's place in the latent space times each item's
    common: np.ndarray | None = None  # words that say little
    groups: list[Group] = field(default_factory=list)


def blocks_of(benchmark: DataFrame) -> Iterator[Block]:
    """The items block by block.  Items without words match nothing and are left out; so are those with a null id."""
    powers, now, size = Powers(), [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null")
    for row in rows.orderBy("item_id").toLocalIterator(prefetchPartitions=True):
        text = (row["text"] or "").strip()
        sequence = word_hashes(text, powers)
        last = [h for h in (word_hashes(s, powers) for s in re.split(r"(?<=[.!?])\s+", text)) if len(h)]
        answer = last[-1] if last else sequence
        for k in range(0, len(sequence), BLOCK_WORDS):
            piece = sequence[k : k + BLOCK_WORDS]
            if now and (len(now) == BLOCK_ITEMS or size + len(piece) > BLOCK_WORDS):
                yield _block(now)
                now, size = [], 0
            now.append((row["item_id"], piece, answer if k + BLOCK_WORDS >= len(sequence) else piece[:0]))
            size += len(piece)
    if now:
        yield _block(now)


def _block(items: list[tuple[int, np.ndarray, np.ndarray]]) -> Block:
    ids, sequences, answers = (list(x) for x in zip(*items, strict=True))
    return Block(ids, sequences, answers, np.unique(np.concatenate(sequences)))


def _lookup(vocabulary: np.ndarray):
    """Function from word hashes to places in the vocabulary (-1: not in it); most misses cost one table read."""
    size = 1 << max(16, int(len(vocabulary) * 8).bit_length())
    mask = np.uint64(size - 1)
    present = np.zeros(size, bool)
    present[vocabulary & mask] = True

    def find(hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(present[hashes & mask])
        at = np.searchsorted(vocabulary, hashes[maybe])
        at[at == len(vocabulary)] = 0
        same = vocabulary[at] == hashes[maybe]
        out[maybe[same]] = at[same]
        return out

    return find


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and of documents that hold each word of the vocabulary."""
    n, powers = len(vocabulary), Powers()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        find, seen = _lookup(vocabulary), np.zeros(n + 1, np.int64)
        seen[n] = batch.num_rows
        for _, _, hashes, at in plain_words(batch.column(0), powers):
            place = find(hashes)
            hit = np.flatnonzero(place >= 0)
            row = np.searchsorted(at, hit, "right") - 1
            pairs = np.unique(row * n + place[hit])
            seen[:n] += np.bincount(pairs % n, minlength=n)
        some = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["word", "n"])

    out = np.zeros(n + 1, np.int64)
    counted = map_texts(docs.select(F.col("text").cast("string")), run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # at most one row for each word of a block
        out[r["word"]] = r["n"]
    return int(out[n]), out[:n]


def _vectors(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF of the items: item, word and weight of each entry; items have length one."""
    item = np.repeat(np.arange(len(block.sequences)), [len(s) for s in block.sequences])
    word = np.searchsorted(block.vocabulary, np.concatenate(block.sequences))
    pair, count = np.unique(item * len(block.vocabulary) + word, return_counts=True)
    item, word = pair // len(block.vocabulary), pair % len(block.vocabulary)
    weight = (1 + np.log(count)) * block.weights[word]
    length = np.sqrt(np.bincount(item, weight**2, len(block.sequences)))
    return item, word, weight / np.maximum(length, 1e-12)[item]


def _product(entries: DataFrame, right: np.ndarray) -> np.ndarray:
    """A'A times ``right``, where ``entries`` has one row for each item: lists of words and weights.

    Each task multiplies its own rows and hands on sums by word, which Spark adds up.
    """
    n, rank = right.shape

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros((n, rank))
        for k in range(batch.num_rows):
            w, x = (np.asarray(batch.column(i)[k].values) for i in (0, 1))
            total[w] += np.outer(x, x @ right[w])
        some = np.flatnonzero(total.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], ["word", "row"])

    parts = map_texts(entries, run, "word bigint, row array<double>")
    sums = parts.groupBy("word").agg(F.array(*[F.sum(F.col("row")[i]) for i in range(rank)]).alias("row")) if rank <= 8 else (
        parts.select("word", F.posexplode("row").alias("k", "v")).groupBy("word", "k").agg(F.sum("v").alias("v"))
        .groupBy("word").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("row")).select("word", F.col("row.v").alias("row"))
    )
    out = np.zeros((n, rank))
    for r in sums.toLocalIterator():
        out[r["word"]] = r["row"]
    return out


def fitted(block: Block, n_docs: int, frequencies: np.ndarray, spark, rank: int = BLOCK_ITEMS, rounds: int = 1) -> Block:
    """The block with weights and latent space: randomised range finder, then the small problem solved exactly."""
    block.common = frequencies > max(COMMON * n_docs, COMMON_LEAST)
    for s in block.sequences:  # every item keeps its rarest words
        places = np.unique(np.searchsorted(block.vocabulary, s))
        block.common[places[np.argsort(frequencies[places], kind="stable")[:RAREST]]] = False
    block.weights = np.where(block.common, 0.0, np.log((1 + n_docs) / (1 + frequencies)) + 1)
    item, word, weight = _vectors(block)
    rank = min(rank, len(block.sequences), len(block.vocabulary))
    cuts = np.flatnonzero(np.diff(item)) + 1
    rows = [(w.tolist(), x.tolist()) for w, x in zip(np.split(word, cuts), np.split(weight, cuts), strict=True)]
    entries = table(spark.createDataFrame(rows, "words array<bigint>, weights array<double>"), "items")
    random = np.random.default_rng(5).standard_normal((len(block.vocabulary), min(rank + 8, len(block.vocabulary))))
    for _ in range(rounds):
        random = np.linalg.qr(_product(entries, random))[0]
    _, kept = np.linalg.eigh(random.T @ _product(entries, random))
    basis = random @ kept[:, ::-1][:, :rank]
    latent = np.zeros((len(block.sequences), basis.shape[1]))
    np.add.at(latent, item, weight[:, None] * basis[word])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    block.scores = (basis @ latent.T).astype(np.float32)  # (x V) L' = x (V L')
    block.groups = _groups(block, frequencies)
    return block


def _least(n: int) -> int:
    """Words in order that a match of an item of ``n`` words has at least."""
    return max(1, int(np.ceil(PARAPHRASE * n - 1e-9)))


def _step(n: int) -> int:
    """An item of ``n`` words is compared with stretches this far apart, each two such steps longer than the item."""
    return max(1, n // 4)


def _groups(block: Block, frequencies: np.ndarray) -> list[Group]:
    """The items by length class, each class within a factor of two.

    An item's telling words are those that are not common and, if need be, its next rarest ones, until they are a third of
    the item more than a match may lack: a match without any of them does not exist.
    """
    classes: dict[int, list[int]] = {}
    for i, s in enumerate(block.sequences):
        classes.setdefault(len(s).bit_length(), []).append(i)
    groups = []
    for _, items in sorted(classes.items()):
        needs, entries = np.zeros(len(items), np.int64), []
        for k, i in enumerate(items):
            n = len(block.sequences[i])
            word, times = np.unique(np.searchsorted(block.vocabulary, block.sequences[i]), return_counts=True)
            order = np.lexsort((word, frequencies[word], block.common[word]))
            word, times = word[order], times[order]
            lacking, total = n - _least(n), np.cumsum(times)
            enough = int(np.searchsorted(total, min(n, lacking + -(-n // 3)))) + 1
            enough = max(enough, int((~block.common[word]).sum()))
            needs[k] = total[enough - 1] - lacking
            entries.append((word[:enough], np.full(enough, k), times[:enough]))
        word, holder, times = (np.concatenate(x) for x in zip(*entries, strict=True))
        order = np.argsort(word, kind="stable")
        longest = max(len(block.sequences[i]) for i in items)
        edges = np.searchsorted(word[order], np.arange(len(block.vocabulary) + 1))
        groups.append(Group(np.array(items), needs, longest + 2 * _step(longest), edges, holder[order], times[order]))
    return groups


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    spots: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        spots[x] = spots.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & spots.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _candidates(group: Group, place: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first word within the row, item) of the passages that hold as many telling words as a match has.

    Passages are two stretches long and one apart, so every stretch lies in the passage in whose first half it starts.
    """
    spot = np.flatnonzero(place >= 0)
    spot = spot[group.edges[place[spot] + 1] > group.edges[place[spot]]]
    if not len(spot):
        return
    row = np.searchsorted(at, spot, "right") - 1
    n_words, apart = len(group.edges) - 1, group.stretch
    base = np.concatenate([[0], np.cumsum(-(-np.diff(at) // apart))])  # first passage of each row
    k = (spot - at[row]) // apart
    one = (base[row] + k) * n_words + place[spot]
    pairs = np.unique(np.concatenate([one, one[k > 0] - n_words]))
    passage, word = pairs // n_words, pairs % n_words
    size = group.edges[word + 1] - group.edges[word]
    some, n = max(1, (1 << 20) // max(len(group.items), len(group.holder))), len(group.items)
    first = int(passage[0])
    while True:
        low, high = np.searchsorted(passage, (first, first + some))
        many = size[low:high]
        entry = np.repeat(group.edges[word[low:high]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        key = (np.repeat(passage[low:high], many) - first) * n + group.holder[entry]
        held = np.bincount(key, group.times[entry], some * n).reshape(some, n)
        for p, i in zip(*np.nonzero(held >= group.needs), strict=True):
            r = int(np.searchsorted(base, first + p, "right")) - 1
            yield r, int(first + p - base[r]) * apart, int(group.items[i])
        if high == len(passage):
            return
        first = int(passage[high])


def _agreement(item: np.ndarray, answer: np.ndarray, text: np.ndarray, first: int, end: int) -> tuple[float, float, int]:
    """Best confirmed stretch of ``text`` that starts in [first, end): shares of the item and of the answer, place.

    Stretches start at multiples of the item's step from the text's begin.  One with fewer of the item's words, in any order,
    than a match or the best one so far has in order is not compared.
    """
    step, best = _step(len(item)), (0.0, 0.0, -1)
    size = len(item) + 2 * step
    last = -(-max(0, len(text) - size) // step) * step
    starts = np.arange(-(-first // step) * step, min(end, last + 1), step)
    if not len(starts):
        return best
    here = np.concatenate([[0], np.cumsum(np.isin(text[first : end + size], item))])
    held = here[np.minimum(starts + size - first, len(here) - 1)] - here[starts - first]
    for k in np.argsort(-held, kind="stable"):
        if held[k] < max(_least(len(item)), best[0] * len(item)):
            break
        part = text[starts[k] : starts[k] + size]
        share = common_subsequence(item, part) / len(item)
        if share < PARAPHRASE or share < best[0]:
            continue
        said = common_subsequence(answer, part) / len(answer) if len(answer) else 1.0
        if (share >= VERBATIM or said >= ANSWER) and (share, said) > best[:2]:
            best = share, said, int(starts[k])
        if best[:2] == (1.0, 1.0):
            break
    return best


def _cosine(block: Block, item: int, place: np.ndarray) -> float:
    """Cosine of an item and a stretch of text in the latent space."""
    word, times = np.unique(place[place >= 0], return_counts=True)
    weight = (1 + np.log(times)) * block.weights[word]
    return float(weight @ block.scores[word, item] / max(np.linalg.norm(weight), 1e-12))


def _search(block: Block, doc_ids: list, column: pa.Array, powers: Powers, find) -> list[tuple]:
    """(doc_id, item_id, cosine, lcs_share, answer_share) of the confirmed candidates of some texts."""
    best: dict[tuple[int, int], tuple] = {}
    for first, _, hashes, at in plain_words(column, powers):
        place = find(hashes)
        for group in block.groups:
            for r, low, i in _candidates(group, place, at):
                text, item = hashes[at[r] : at[r + 1]], block.sequences[i]
                share, said, start = _agreement(item, block.answers[i], text, low, low + group.stretch)
                if start >= 0 and (share, said) > best.get((first + r, i), (0.0, 0.0))[:2]:
                    start += at[r]
                    end = min(start + len(item) + 2 * _step(len(item)), at[r + 1])
                    best[first + r, i] = share, said, _cosine(block, i, place[start:end])
    return [(doc_ids[r], block.item_ids[i], cos, share, said) for (r, i), (share, said, cos) in best.items()]


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share, verbatim): the items found in each row of ``docs``.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored.  Null and blank texts hold
    nothing; rows that repeat a doc_id give one row for each item; if either table is empty there are no rows.
    """
    spark, found = docs.sparkSession, []
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for block in blocks_of(benchmark):
        n_docs, frequencies = document_frequencies(slim, block.vocabulary)
        block = fitted(block, n_docs, frequencies, spark, rank)
        powers = Powers()

        def run(batch: pa.RecordBatch, block: Block = block, powers: Powers = powers) -> pa.RecordBatch | None:
            rows = _search(block, batch.column(0).to_pylist(), batch.column(1), powers, _lookup(block.vocabulary))
            if not rows:
                return None
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"],
            )

        # written at once: the driver holds one block at a time
        found.append(table(map_texts(slim, run, "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_share double"), "leaks"))
    if not found:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_share double, verbatim boolean")
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    one = every.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("m"))
    return one.select("doc_id", "item_id", "m.cosine", "m.lcs_share", "m.answer_share", (F.col("m.lcs_share") >= VERBATIM).alias("verbatim"))
