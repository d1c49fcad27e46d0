"""Dictionary matching, keyword search and locating values in text.

Every match is exact with respect to its scoring rule: candidate keys are
chosen so that no pair above the threshold can be missed, and only distinct
values are ever compared.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperfold.functions.similarity import lcs_of, normal, partial_ratio_from, ratio_float_udf, ratio_udf, token_set_ratios
from paperfold.operators.filters import worth_matching
from paperfold.plans.pick import head_per_key, pick_first
from paperfold.sources.shared import written

# Scores of the tiers and acceptance thresholds.
SCORE_EXACT, SCORE_IN_NAME, SCORE_IN_CODE = 1.0, 0.85, 0.8
ACCEPT_MATCH, ACCEPT_SEARCH, ACCEPT_WORD = 0.6, 0.5, 85

ENTRIES_PER_BLOCK = 2048
VALUES_PER_SLICE = 4096
_AT_ONCE = 1 << 18  # pairs of a block that are looked at together
_BAG = 64


def _key(c: Column) -> Column:
    return F.lower(F.trim(c))


def _bags(texts: list[str]) -> np.ndarray:
    """How often each letter (by its number modulo _BAG) stands in each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % _BAG
    cell = np.repeat(np.arange(len(texts)), sizes) * _BAG + flat
    return np.bincount(cell, minlength=len(texts) * _BAG).reshape(-1, _BAG).astype(np.int32)


class _Side:
    """Texts of one kind of a block with what bounds their similarity to others."""

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.bags = texts, _bags(texts)
        self.sizes = self.bags.sum(axis=1)

    def common(self, other: _Side, some: slice) -> np.ndarray:
        """Letters that each of some own texts has in common with each other text: no common subsequence is longer."""
        out = np.zeros((len(self.bags[some]), len(other.bags)), np.int32)
        for letter in np.flatnonzero(self.bags[some].any(axis=0) & other.bags.any(axis=0)):
            out += np.minimum(self.bags[some, letter, None], other.bags[None, :, letter])
        return out


def _tokens(text: str) -> str:
    return " ".join(sorted(set(normal(text).split())))


def _scores(values: _Side, entries: _Side, i: np.ndarray, j: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
    """Rounded ratio of pairs as a share, and ``within`` where one text contains the other (only then is it a common subsequence)."""
    shorter = np.minimum(values.sizes[i], entries.sizes[j])
    length = lcs_of(values.texts, entries.texts, i, j)
    score = np.where(shorter > 0, np.rint(200.0 * length / np.maximum(values.sizes[i] + entries.sizes[j], 1)) / 100, 0.0)
    inside = np.zeros(len(i))
    for k in np.flatnonzero((length == shorter) & (shorter > 0)).tolist():
        a, b = values.texts[i[k]], entries.texts[j[k]]
        if a in b or b in a:
            inside[k] = within
    return score, inside


def _best_of_block(values: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Best entry of one dictionary block for each value of one slice.

    Letter counts bound the common subsequence from above, so most pairs are dismissed by array arithmetic; the texts of
    the rest are compared a batch at a time.
    """
    columns = ["value", "category", "code", "name", "entry_no", "score"]
    entries = entries.sort_values(["category", "entry_no"], kind="stable").reset_index(drop=True)
    names, codes = _Side(entries["name_key"].tolist()), _Side(entries["code_key"].tolist())
    keys = _Side(values["value_key"].tolist())
    name_tokens, key_tokens = _Side([_tokens(x) for x in names.texts]), _Side([_tokens(x) for x in keys.texts])
    by_token: dict[str, list[int]] = defaultdict(list)
    for k, text in enumerate(name_tokens.texts):
        for token in text.split():
            by_token[token].append(k)
    found, least = [], ACCEPT_MATCH - 0.005
    step = max(1, _AT_ONCE // max(1, len(entries)))
    for first in range(0, len(keys.texts), step):
        some = slice(first, first + step)
        keep = np.zeros((len(keys.texts[some]), len(entries)), bool)
        for side, other in ((keys, names), (keys, codes), (key_tokens, name_tokens)):
            common, a, b = side.common(other, some), side.sizes[some, None], other.sizes[None, :]
            keep |= (2 * common >= least * (a + b)) | (common >= np.minimum(a, b))
        for k, text in enumerate(key_tokens.texts[some]):
            for token in text.split():
                keep[k, by_token.get(token, [])] = True
        i, j = np.nonzero(keep)
        i += first
        by_name, in_name = _scores(keys, names, i, j, SCORE_IN_NAME)
        by_code, in_code = _scores(keys, codes, i, j, SCORE_IN_CODE)
        named = names.sizes[j] > 0
        by_words = np.zeros(len(i))
        by_words[named] = token_set_ratios(keys.texts, names.texts, i[named], j[named]) / 100
        score = np.where(in_name > 0, in_name, np.where(in_code > 0, in_code, np.maximum(by_words, np.maximum(by_name, by_code))))
        order = np.lexsort((j, -score, i))
        heads = order[np.unique(i[order], return_index=True)[1]]
        found += [(i[k], j[k], score[k]) for k in heads.tolist() if score[k] >= ACCEPT_MATCH]
    if not found:
        return pd.DataFrame({c: [] for c in columns})
    i, j, score = (np.array(x) for x in zip(*found, strict=True))
    best = entries.iloc[j][["category", "code", "name", "entry_no"]].reset_index(drop=True)
    return pd.DataFrame({"value": values["value"].to_numpy()[i], **best, "score": score})[columns]


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay): all pairs of texts where the needle stands in the hay.

    A needle is looked up by the one of its pieces of three characters (itself, if shorter) that the fewest hays have, so
    the join meets little more than the pairs that hold.
    """
    texts = lambda df: df.select(F.col(df.columns[0]).alias("word")).where(F.col("word") != "").distinct()
    held = written(_grams(texts(hays)).select("word", "gram").distinct(), "hay-pieces")
    frequency = held.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    pieces = _grams(texts(needles)).where(F.length("gram") == F.least(F.length("word"), F.lit(GRAM))).select("word", "gram").distinct()
    rarest = pieces.join(frequency, "gram", "left").groupBy("word").agg(
        F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), F.col("gram"))).alias("gram"))
    pairs = rarest.select(F.col("word").alias("needle"), "gram").join(held.select(F.col("word").alias("hay"), "gram"), "gram")
    return pairs.where(F.contains("hay", F.col("needle"))).select("needle", "hay")


def _containing_entries(keys: DataFrame, keyed: DataFrame) -> DataFrame:
    """Best entry whose name, or else code, contains the key or stands in it: (value_key, entry, score)."""
    found = []
    for column, score in (("name_key", SCORE_IN_NAME), ("code_key", SCORE_IN_CODE)):
        texts = keyed.where(F.col(column) != "")
        firsts = pick_first(texts, [column], ["category", "entry_no"], ["category", "code", "name", "entry_no"])
        inside = contained(keys, firsts.select(column)).select(F.col("needle").alias("value_key"), F.col("hay").alias(column))
        around = contained(firsts.select(column), keys).select(F.col("hay").alias("value_key"), F.col("needle").alias(column))
        found.append(inside.unionByName(around).join(firsts, column).drop(column).withColumn("score", F.lit(score)))
    return pick_first(found[0].unionByName(found[1]), ["value_key"], [-F.col("score"), F.col("category"), F.col("entry_no")],
                      ["category", "code", "name", "entry_no", "score"])


def match_dictionary(values: DataFrame, entries: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Best entry per distinct value: exact, then containment, then similarity.

    ``values(value)``; ``entries(category, code, name, entry_no)``.  Ties go to
    the first entry in (category, entry_no) order.  Exact matches and
    containment are equi joins.  A similarity of 0.6 by common subsequence is
    so loose that no key leaves out pairs: with ``fuzzy``, the values without an
    exact match meet the dictionary in bounded blocks, and each block returns
    one best entry per value, never the pairs.
    """
    distinct = values.where(worth_matching(F.col("value"))).select("value").distinct()
    distinct = distinct.withColumn("value_key", _key(F.col("value"))).where(F.col("value_key") != "")
    keyed = entries.select("category", "code", "name", "entry_no",
                           _key(F.col("code")).alias("code_key"), _key(F.col("name")).alias("name_key"))
    exact_keys = keyed.select(
        F.explode(F.array_distinct(F.array("code_key", "name_key"))).alias("value_key"),
        "category", "code", "name", "entry_no").where(F.col("value_key") != "")
    firsts = pick_first(exact_keys, ["value_key"], ["category", "entry_no"], ["category", "code", "name", "entry_no"])
    exact = distinct.join(firsts, "value_key").withColumn("score", F.lit(SCORE_EXACT))
    misses = written(distinct.join(firsts, "value_key", "left_anti"), "match-misses")
    if fuzzy:
        best = _similar_entries(misses, keyed)
    else:
        best = misses.join(_containing_entries(misses.select("value_key"), keyed), "value_key").drop("value_key")
    columns = ["value", "category", "code", "name", "entry_no", "score"]
    return exact.select(*columns).unionByName(best.select(*columns))


def _similar_entries(misses: DataFrame, keyed: DataFrame) -> DataFrame:
    """Best entry by containment or similarity, block by block."""
    blocks = max(1, math.ceil(keyed.count() / ENTRIES_PER_BLOCK))
    slices = max(1, math.ceil(misses.count() / VALUES_PER_SLICE))
    left = misses.select("value", "value_key",
                         F.pmod(F.xxhash64("value_key"), F.lit(slices)).cast("int").alias("slice"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = keyed.select("*", F.pmod(F.xxhash64("code", "name", "category"), F.lit(blocks)).cast("int").alias("block"),
                         F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    scored = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(
        _best_of_block, "value string, category string, code string, name string, entry_no bigint, score double")
    return pick_first(scored, ["value"], [-F.col("score"), F.col("category"), F.col("entry_no")],
                      ["category", "code", "name", "entry_no", "score"])


def tokens_of(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def _postings(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.select(*keys, F.explode(tokens_of(F.col("name"))).alias("token"))


def _token_weights(postings: DataFrame, n: Column) -> DataFrame:
    """ln(1 + entries / entries holding the token)."""
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).select("token", F.log1p(n / F.col("df")).alias("idf"))


def _rest(i: Column) -> Column:
    """Weight of the words of ``w`` from number ``i`` on."""
    return F.aggregate(F.slice("w", i + 1, F.size("w")), F.lit(0.0), lambda s, x: s + x["idf"])


def _shared(words: str) -> Column:
    """Weight of the words of ``w`` that an entry has."""
    return F.aggregate(F.filter("w", lambda x: F.array_contains(words, x["token"])), F.lit(0.0), lambda s, x: s + x["idf"])


def search_dictionary(queries: DataFrame, entries: DataFrame, per_category: int, k: int) -> DataFrame:
    """Keyword search: top entries per category, then overall, by the weight of shared words.

    ``queries(query)`` with two characters or more.  The entries of a query's
    rarest word give a score that the answer must reach; an entry that lacks
    the words without which it cannot be reached is never looked at, so
    frequent words only check what rarer ones have found.  Queries of one word
    take the first entries of each category, found once for each word.
    """
    n = entries.agg(F.count(F.lit(1))).scalar()
    post = written(_postings(entries, ["category", "code"]).distinct(), "postings")
    weights = _token_weights(post, n)
    asked = queries.where(F.length("query") >= 2).select("query").distinct().select("query", F.explode(tokens_of(F.col("query"))).alias("token"))
    bags = asked.join(weights, "token").groupBy("query").agg(F.reverse(F.array_sort(F.collect_list(F.struct("idf", "token")))).alias("w"))
    bags = written(bags, "query-words")  # a query's words are few: they fit one row
    whole = lambda c: F.floor(c * 1e6 + 0.5) / 1e6
    order = [F.desc("score"), F.asc("category"), F.asc("code")]

    single = bags.where(F.size("w") == 1).select("query", F.col("w")[0]["token"].alias("token"), whole(F.col("w")[0]["idf"]).alias("score"))
    heads = head_per_key(post.join(single.select("token").distinct(), "token", "left_semi"), ["token", "category"], [F.asc("code")], per_category)
    found = single.join(heads, "token").select("query", "category", "code", "score")

    several = bags.where(F.size("w") > 1)
    per_entry = post.groupBy("category", "code").agg(F.collect_set("token").alias("entry_words"))

    def scored(probes: DataFrame) -> DataFrame:
        hits = probes.join(post, "token").select("query", "category", "code").distinct()
        hits = hits.join(several.select("query", "w"), "query").join(per_entry, ["category", "code"])
        hits = hits.select("query", "category", "code", whole(_shared("entry_words")).alias("score"))
        return head_per_key(hits, ["query", "category"], [F.desc("score"), F.asc("code")], per_category)

    rarest = scored(several.select("query", F.col("w")[0]["token"].alias("token")))
    reached = head_per_key(rarest, ["query"], order, k, "rank").where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    least = F.coalesce("least", F.lit(0.0)) - 2e-6
    needed = F.filter(F.transform("w", lambda x, i: F.struct(x["token"].alias("token"), _rest(i).alias("rest"))), lambda x: x["rest"] >= least)
    probes = several.join(written(reached, "reached"), "query", "left").select("query", F.explode(F.transform(needed, lambda x: x["token"])).alias("token"))
    return head_per_key(found.unionByName(scored(probes)), ["query"], order, k, "rank")


def normalise_fields(cells: DataFrame, entries: DataFrame) -> DataFrame:
    """Best entry per distinct (value, category): shared word weight over the value's, above 0.5.

    Only the words a match above 0.5 cannot do without (the rarest ones, up to
    half the weight) fetch candidates, so frequent words never list their entries.
    A value of one word takes the first entry that has it, found once for each word.
    """
    pairs = cells.where(F.length(F.trim("value")) >= 2).select("value", "category").distinct()
    n = entries.agg(F.count(F.lit(1))).scalar()
    post = _postings(entries, ["category", "code"])
    weights = _token_weights(post, n)
    words = pairs.select("value", "category", F.explode(tokens_of(F.col("value"))).alias("token"))
    words = words.join(weights, "token", "left").withColumn("idf", F.coalesce("idf", F.log1p(n.cast("double"))))
    # one value's words are few: they fit one row
    w = F.reverse(F.array_sort(F.collect_list(F.struct("idf", "token"))))
    bag = words.groupBy("value", "category").agg(w.alias("w")).withColumn(
        "total", F.aggregate("w", F.lit(0.0), lambda s, x: s + x["idf"]))
    # words in falling weight; the tail that starts at or below half the weight cannot carry a match
    needed = F.filter(F.transform("w", lambda x, i: F.struct(x["token"].alias("token"), _rest(i).alias("rest"))),
                      lambda x: x["rest"] * 2 >= F.col("total") * 0.999999)
    bag = written(bag, "value-words")
    single, bag = bag.where(F.size("w") == 1), bag.where(F.size("w") > 1)
    firsts = post.groupBy("category", "token").agg(F.min("code").alias("code"))
    single = single.select("value", "category", F.col("w")[0]["token"].alias("token")).join(firsts, ["category", "token"])
    single = single.select("value", "category", "code", F.lit(1.0).alias("dict_score"))
    probes = bag.select("value", "category", F.explode(F.transform(needed, lambda x: x["token"])).alias("token"))
    # entries of one category and the same words have the same score; the first of them stands for all
    alike = entries.groupBy("category", F.array_sort(tokens_of(F.col("name"))).alias("entry_words")).agg(F.min("code").alias("code"))
    alike = written(alike.where(F.col("code").isNotNull()), "entry-words")
    listed = alike.select("category", "code", "entry_words", F.explode("entry_words").alias("token"))
    scored = probes.hint("merge").join(listed, ["category", "token"]).join(bag, ["value", "category"])
    scored = scored.select("value", "category", "code", (F.floor(_shared("entry_words") / F.col("total") * 1e6 + 0.5) / 1e6).alias("dict_score"))
    best = pick_first(scored.unionByName(single).where(F.col("dict_score") > ACCEPT_SEARCH), ["value", "category"],
                      [-F.col("dict_score"), F.col("code")], ["code", "dict_score"])
    out = cells.join(best, ["value", "category"], "left")
    return out.select(*[c for c in cells.columns if c != "value"], F.col("value").alias("raw_value"),
                      F.col("code").alias("normalized_code"), F.coalesce("dict_score", F.lit(0.0)).alias("dict_score"))


# ---- locating values among the words of a document ------------------------------

GRAM = 3


def _gram_array(chars: str, size: int, at: Column) -> Column:
    """The ``size`` characters from 0-based ``at`` on, from an array of characters (linear in the text)."""
    return F.concat(*[F.get(chars, at + j) for j in range(size)])


def _grams(words: DataFrame) -> DataFrame:
    """(word, gram, at): every piece of one to three characters with its 1-based position."""
    out = words.select("word", F.split("word", "").alias("__c")).withColumn("__n", F.length("word"))

    def listed(g: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.col("__n") - (g - 1)),
                            lambda i: F.struct(_gram_array("__c", g, i - 1).alias("gram"), i.alias("at")))
        return F.when(F.col("__n") >= g, every).otherwise(F.array().cast("array<struct<gram:string,at:int>>"))

    pieces = F.flatten(F.array(*[listed(g) for g in range(1, GRAM + 1)]))
    return out.select("word", F.explode(pieces).alias("g")).select("word", "g.gram", "g.at")


def containing_pairs(values: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct (value, word) pairs where one contains the other; tier 0 equal, 1 contained.

    A word inside a value is one of the value's substrings; a value inside a
    word shows its first characters as one of the word's grams.
    """
    v = values.select("value").distinct()
    w = written(words.select("word").distinct(), "vocabulary")
    long = w.where(F.length("word") > 1)
    equal = v.join(w, F.col("value") == F.col("word")).withColumn("tier", F.lit(0))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("value")), lambda i: F.transform(
        F.sequence(F.lit(1), F.length("value") - i + 1), lambda n: F.substring(F.col("value"), i, n))))
    subs = v.select("value", F.explode(F.array_distinct(parts)).alias("word")).where(F.col("word") != F.col("value"))
    inside = subs.join(long, "word").select("value", "word", F.lit(1).alias("tier"))
    probe = v.withColumn("gram", F.left("value", F.lit(GRAM)))
    around = probe.join(_grams(long).select("word", "gram").distinct(), "gram").where(
        F.contains(F.col("word"), F.col("value")) & (F.col("word") != F.col("value"))
    ).select("value", "word", F.lit(1).alias("tier"))
    return equal.unionByName(inside).unionByName(around)


BYTES_PER_BLOCK = 1 << 14
CELLS_AT_ONCE, BYTES_PER_CELL = 1 << 18, 64
PARTS_KEPT, LONG_VALUE = 1 << 18, 32  # pieces of values remembered; values that are not cut into pieces
_ROWS_PER_SLICE = 256


def _firsts(doc_id: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """First row of each block: a new one for each run of a document and after some BYTES_PER_BLOCK of it."""
    ends = pc.run_end_encode(doc_id).run_ends.to_numpy().astype(np.int64)
    rows = np.diff(ends, prepend=0)
    run = np.repeat(np.arange(len(ends)), rows)
    before = np.cumsum(sizes) - sizes
    part = (before - before[ends - rows][run]) // BYTES_PER_BLOCK
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (part[1:] != part[:-1])
    return np.flatnonzero(new)


def _scattered(doc_id: pa.Array) -> bool:
    runs = pc.run_end_encode(doc_id).values
    return pc.count_distinct(runs, mode="all").as_py() < len(runs)


def _whole(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=True).astype(np.int64)  # refuses nulls


def _in_order(batch: pa.RecordBatch) -> bool:
    """A document's words are one run, by rising page and start."""
    doc_id, page, start = batch.column(0), _whole(batch.column(1)), _whole(batch.column(2))
    rising = (page[1:] > page[:-1]) | ((page[1:] == page[:-1]) & (start[1:] > start[:-1]))
    rising[pc.run_end_encode(doc_id).run_ends.to_numpy()[:-1] - 1] = True
    return bool(rising.all()) and not _scattered(doc_id)


def _packed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a document's words by page and start: a text with their places where these do not just go on."""
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        if not batch.num_rows:
            continue
        if not _in_order(batch):
            batch = batch.sort_by([(name, "ascending") for name in batch.schema.names])
        doc_id, page, start, word = batch.column(0), _whole(batch.column(1)), _whole(batch.column(2)), batch.column(3)
        firsts = _firsts(doc_id, _whole(pc.binary_length(word)) + 1)
        size = _whole(pc.utf8_length(word)) + 1
        at = np.cumsum(size) - size
        at -= np.repeat(at[firsts], np.diff(firsts, append=len(at)))
        told = np.ones(len(at), bool)
        told[1:] = (page[1:] != page[:-1]) | (start[1:] != start[:-1] + size[:-1])
        told[firsts] = True
        told = np.flatnonzero(told)
        sep = next(c for c in map(chr, (10, *range(0xD800))) if not pc.any(pc.match_substring(word, c)).as_py())
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(firsts, len(at)), pa.int32()), word), sep)
        places, cut = np.stack([at[told], page[told], start[told]]), np.searchsorted(told, np.append(firsts, len(at)))
        blocks = []
        for k, text in enumerate(texts.to_pylist()):
            here = np.diff(places[:, cut[k]:cut[k + 1]], axis=1, prepend=0)
            raw = np.array([ord(sep), here.shape[1]], np.int64).tobytes() + here.tobytes() + text.encode()
            blocks.append(len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True))
        yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(firsts)), pa.array(blocks, pa.binary())], names=["doc_id", "block"])


def _packed_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of a document's different cells."""
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([]).combine_chunks().to_batches()[0]
        if _scattered(batch.column(0)):
            batch = batch.sort_by(batch.schema.names[0])
        firsts = _firsts(batch.column(0), _whole(pc.binary_length(batch.column(2))) + BYTES_PER_CELL)
        cells = pa.StructArray.from_arrays(batch.columns[1:], names=batch.schema.names[1:])
        lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, batch.num_rows), pa.int32()), cells)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(firsts)), lists], names=["doc_id", "cells"])


class _Parts(dict):
    """Pieces of two characters or more, shorter than the value, for each short value met."""

    kept = 0

    def __missing__(self, value: str) -> frozenset[str]:
        if self.kept > PARTS_KEPT:
            self.clear()
            self.kept = 0
        self[value] = frozenset(value[i:i + n] for n in range(2, len(value)) for i in range(len(value) - n + 1))
        self.kept += len(self[value])
        return self[value]


class _Block:
    """Words of a document, by page and start, as one text with a separator around each of them."""

    def __init__(self, raw: bytes) -> None:
        sep, n = np.frombuffer(raw, np.int64, 2).tolist()
        self.at, self.pages, self.starts = np.cumsum(np.frombuffer(raw, np.int64, 3 * n, 16).reshape(3, n), axis=1).tolist()
        self.sep = chr(sep)
        self.text = f"{self.sep}{raw[16 + 24 * n:].decode()}{self.sep}"

    @cached_property
    def words(self) -> set[str]:
        return set(self.text.split(self.sep))

    def inside(self, value: str, parts: _Parts) -> set[str]:
        """Words of two characters or more that stand in the value and are shorter."""
        if len(value) > LONG_VALUE:
            return {w for w in self.words if 1 < len(w) < len(value) and w in value}
        return parts[value] & self.words

    def place(self, at: int) -> tuple[int, int]:
        k = bisect_right(self.at, at) - 1
        return self.pages[k], self.starts[k] + at - self.at[k]

    def span(self, page: int) -> tuple[int, int] | None:
        """Where the words of a page stand."""
        first, end = bisect_left(self.pages, page), bisect_right(self.pages, page)
        if first == end:
            return None
        return self.at[first], self.at[end] - 1 if end < len(self.at) else len(self.text) - 2

    def best(self, value: str, inside: set[str], first: int, end: int) -> tuple[int, int, int, str] | None:
        """(page_no, tier, start, word) of the first page there that has a word for the value: the word itself, else the
        first that contains it or stands in it."""
        text, sep = self.text, self.sep
        equal = text.find(f"{sep}{value}{sep}", first, end + 2) if value in self.words else -1
        around = text.find(value, first + 1, end + 1) if value and sep not in value else -1
        at = text.rfind(sep, first, around) if around >= 0 else equal
        for word in inside:  # only what stands before
            before = text.find(f"{sep}{word}{sep}", first, end + 2 if at < 0 else at + len(word) + 1)
            if before >= 0:
                at = before
        if at < 0:
            return None
        page_no, start = self.place(at)
        if equal >= 0 and self.place(equal)[0] == page_no:
            return page_no, 0, self.place(equal)[1], value
        return page_no, 1, start, text[at + 1:text.index(sep, at + 1)]


def _best_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best word of the blocks that follow each other for each cell of a document."""
    codec = pa.Codec("zstd")
    parts = _Parts()
    best: dict[tuple, tuple] = {}  # by value and page, and by value alone
    cells: dict[tuple, None] = {}
    last = None  # document whose cells and words these are
    rows: list[tuple] = []
    kinds: list[pa.DataType] = []

    def close() -> None:
        for cell_id, value, page in cells:
            top = best.get((value, page)) or best.get((value,))
            if top:
                page_no, tier, start, word = top
                rows.append((cell_id, last, value, page, word, page_no, start, tier))
        best.clear()
        cells.clear()

    def table() -> pa.RecordBatch:
        columns = [[r[c] for r in rows] for c in range(len(kinds))]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                                          names=["cell_id", "doc_id", "value", "page", "word", "page_no", "start", "tier"])

    def better(key: tuple, found: tuple | None) -> None:
        if found and (key not in best or found < best[key]):
            best[key] = found

    for batch in batches:
        for first in range(0, batch.num_rows, _ROWS_PER_SLICE):
            part = batch.slice(first, _ROWS_PER_SLICE)
            ids, lists, blocks = part.columns
            own = [f.type for f in lists.type.value_type.fields]
            kinds = [own[0], ids.type, own[1], own[2], pa.string(), pa.int64(), pa.int64(), pa.int32()]
            listed, asked, known_as, block = None, {}, None, None
            for doc_id, some, packed in zip(ids.to_pylist(), lists, blocks):
                if doc_id != last or len(cells) > CELLS_AT_ONCE:
                    close()
                    last, listed = doc_id, None
                own_cells = list(zip(*(c.to_pylist() for c in some.values.flatten()), strict=True))
                if own_cells != listed:
                    listed, asked = own_cells, defaultdict(set)
                    for _, value, page in listed:
                        asked[value].add(page)
                    cells.update(dict.fromkeys(listed))
                packed = packed.as_py()
                if packed != known_as:
                    block = _Block(codec.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True))
                    known_as = packed
                spans = {page: block.span(page) for page in set().union(*asked.values()) if page is not None}
                for value, pages in asked.items():
                    known = best.get((value,))
                    pages = [page for page in pages if spans.get(page)]
                    if known and known[0] < block.pages[0] and not pages:
                        continue  # an earlier page has a word
                    inside = block.inside(value, parts)
                    found = block.best(value, inside, 0, len(block.text) - 2)
                    better((value,), found)
                    for page in pages:
                        better((value, page), found if found and found[0] == page else block.best(value, inside, *spans[page]))
            if rows:
                yield table()
    close()
    if rows:
        yield table()


def locate_values(cells: DataFrame, words: DataFrame) -> DataFrame:
    """Best word for each cell (cell_id, doc_id, value, page): proposed page, page order, tier, position.

    ``words(doc_id, page_no, start, word)``.  A word only meets the values of its own document.  Words and cells move
    once, as compressed blocks and lists; a task searches the text of a block for the first word of each value and
    asked page and sends one word for each cell, never the pairs.
    """
    doc_id, cell = cells.schema["doc_id"], [cells.schema[c] for c in ("cell_id", "value", "page")]
    given = cells.where(F.col("value").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "cell_id", "value", "page")
    asked = given.mapInArrow(_packed_cells, T.StructType([doc_id, T.StructField("cells", T.ArrayType(T.StructType(cell)))]))
    placed = words.where(F.col("word").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast(doc_id.dataType), "page_no", "start", "word")
    blocks = placed.mapInArrow(_packed_words, T.StructType([doc_id, T.StructField("block", T.BinaryType())]))
    place = [T.StructField("page_no", T.LongType()), T.StructField("start", T.LongType()), T.StructField("tier", T.IntegerType())]
    found = blocks.hint("merge").join(asked, "doc_id").select("doc_id", "cells", "block").mapInArrow(
        _best_of_words, T.StructType([cell[0], doc_id, *cell[1:], T.StructField("word", T.StringType()), *place]))
    found = found.withColumns({c: F.col(c).cast(words.schema[c].dataType) for c in ("page_no", "start")})
    return pick_first(found, ["cell_id", "doc_id"],
                      [F.col("page_no") != F.col("page"), F.col("page_no"), F.col("tier"), F.col("start")],
                      ["value", "word", "page_no", "start", "tier"])


def similar_words(values: DataFrame, words: DataFrame, least: int = ACCEPT_WORD) -> DataFrame:
    """Distinct (value, word, score) with a ratio of at least ``least``, none missed.

    A ratio r bounds the number of unmatched characters by d, for each length
    of a word; of d + 1 pieces of the value at least one stands unchanged in
    the word, shifted by no more than what is unmatched before it.  Pieces and
    the words' characters at these places meet in an equi join.
    """
    share = (least - 0.5) / 100  # scores are rounded
    v = values.select("value").distinct().where(F.length("value") > 0)
    # a word of n characters leaves at most d of both unmatched, a number that is odd or even like m + n
    m, n = F.length("value"), F.col("size")
    reach = F.floor(m * (2 * (1 - share) / share)).cast("int") + 1
    v = v.select("value", F.explode(F.sequence(F.greatest(F.lit(1), m - reach), m + reach)).alias("size"))
    d = F.floor((m + n) * (1 - share) + 1e-9).cast("int")
    v = v.withColumn("d", d - F.pmod(m + n - d, F.lit(2))).where(F.abs(m - n) <= F.col("d"))
    v = v.withColumn("k", F.least(F.col("d") + 1, m))
    cut = lambda i: F.floor(F.length("value") * i / F.col("k")).cast("int")
    piece = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(
        F.substring(F.col("value"), cut(i) + 1, F.least(cut(i + 1) - cut(i), F.lit(GRAM))).alias("gram"), (cut(i) + 1).alias("vat")))
    pieces = v.select("value", "size", "d", F.explode(piece).alias("p")).select("value", "size", "d", "p.gram", "p.vat")
    # unmatched characters of the value before a piece move it back, those of the word move it on
    first = F.greatest(F.lit(1), F.col("vat") - F.floor((F.col("d") + m - n) / 2).cast("int"))
    last = F.least(n - F.length("gram") + 1, F.col("vat") + F.floor((F.col("d") + n - m) / 2).cast("int"))
    spots = pieces.where(first <= last).select("value", "gram", "size", F.explode(F.sequence(first, last)).alias("at")).distinct()
    spots = written(spots, "value-pieces")
    probes = spots.select("size", "at", F.length("gram").alias("n")).distinct()
    vocabulary = words.select("word").distinct().withColumn("size", F.length("word"))
    grams = vocabulary.join(probes, "size").select("word", "size", "at", F.substr("word", "at", "n").alias("gram"))
    pairs = spots.join(grams, ["gram", "size", "at"]).select("value", "word").distinct()
    return pairs.withColumn("score", ratio_udf("value", "word")).where(F.col("score") >= least)


def locate_fuzzy(cells: DataFrame, words: DataFrame, least: int = ACCEPT_WORD) -> DataFrame:
    """Cells (cell_id, doc_id, source_text) to the most similar word of their document.

    Phrases are located by their longest word; ties go to the first word.
    """
    parts = F.filter(F.split(F.trim("source_text"), r"\s+"), lambda w: w != "")
    longest = F.aggregate(parts, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    asked = cells.select("cell_id", "doc_id", longest.alias("value")).where(F.col("value") != "")
    pairs = written(similar_words(asked, words, least), "similar-words")
    # only words that are like a value are placed
    near = words.join(pairs.select("word").distinct(), "word", "left_semi")
    pages = near.groupBy("doc_id", "word", "page_no").agg(F.min("start").alias("start"))
    hits = asked.join(pairs, "value").join(pages, ["doc_id", "word"])
    return pick_first(hits, ["cell_id", "doc_id"], [-F.col("score"), F.col("page_no"), F.col("start")],
                      ["value", "word", "score", "page_no", "start"])


# ---- locating passages ------------------------------------------------------------

# Thresholds of both passes, bonus for the asked page, score that ends the search.
STRICT, LENIENT, PAGE_BONUS, ENOUGH = 95, 85, 5, 98


def passage_candidates(targets: DataFrame, refs: DataFrame, share: float, partial: bool) -> DataFrame:
    """Pairs of one document that can reach a score of ``share``, with all columns of both sides.

    ``targets(target_id, doc_id, t, page)``, ``refs(doc_id, ref_no, page_no, r)``.  A whole ratio is bounded by the
    lengths; a partial one is not, and a passage meets nearly all lines of its document.  Both sides are dealt out by
    document and joined in order: texts repeat, so their files say little about the memory they need, and a table
    that looks small on disk must not be sent to every task.
    """
    both = targets.hint("merge").join(refs, "doc_id").where(F.col("page").isNull() | (F.col("page") == F.col("page_no")))
    if partial:
        return both
    m, n = F.length("t"), F.length("r")
    return both.where(F.least(m, n) * 2 >= (m + n) * (share - 1e-9))


def _pass(targets: DataFrame, refs: DataFrame, least: int, partial: bool) -> DataFrame:
    share = (least - PAGE_BONUS) / 100
    both = passage_candidates(targets, refs, share, partial)
    scorer = partial_ratio_from(least - PAGE_BONUS) if partial else ratio_float_udf
    both = both.withColumn("score", scorer("t", "r"))
    both = both.withColumn("score", F.when(F.col("page").isNotNull(), F.least(F.col("score") + PAGE_BONUS, F.lit(100.0))).otherwise(F.col("score")))
    both = both.where((F.col("score") >= least) | (F.col("t") == F.col("r")))
    done = (F.col("score") >= ENOUGH) | (F.col("t") == F.col("r"))
    # the first sure hit ends the search; without one the best score wins, then the first
    return pick_first(both, ["target_id", "doc_id"], [~done, F.when(~done, -F.col("score")), F.col("ref_no")], ["ref_no", "page_no", "score"])


def locate_passages(targets: DataFrame, refs: DataFrame) -> DataFrame:
    """Where a text stands among the references of its document, in two passes.

    ``targets(target_id, doc_id, text, page)`` with an optional page,
    ``refs(doc_id, ref_no, page_no, text)`` in reading order.  Strict: ratio of
    the normalised texts.  Lenient, for what is left: partial ratio of the
    letters and digits alone.
    """
    normal = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]+", " "))
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9ㄱ-ㅎㅏ-ㅣ가-힣]", "")
    t1 = targets.select("target_id", "doc_id", "page", normal("text").alias("t")).where(F.col("t") != "")
    r1 = refs.select("doc_id", "ref_no", "page_no", normal("text").alias("r")).where(F.col("r") != "")
    strict = written(_pass(written(t1, "targets"), written(r1, "references"), STRICT, False), "strict-hits")
    left = targets.join(strict.select("target_id", "doc_id"), ["target_id", "doc_id"], "left_anti")
    t2 = left.select("target_id", "doc_id", "page", bare(F.col("text")).alias("t")).where(F.col("t") != "")
    r2 = refs.select("doc_id", "ref_no", "page_no", bare(F.col("text")).alias("r")).where(F.col("r") != "")
    lenient = _pass(written(t2, "targets-left"), written(r2, "references-bare"), LENIENT, True)
    return strict.withColumn("strict", F.lit(True)).unionByName(lenient.withColumn("strict", F.lit(False)))
