"""Near duplicates by MinHash bands, with odd sketches between candidates and the exact check.

Every text becomes a set of word shingles.  128 MinHash values are cut into 32 bands of four: two texts of similarity
0.8 share no band with a probability below 1e-7.  The same values are folded into an odd sketch: value i toggles one of
512 bits, so equal values cancel and the XOR of two sketches has about ``256 * (1 - exp(-D / 128))`` bits for D differing
values.  Candidates whose XOR has more bits than a pair at the threshold shows (six standard deviations above its mean)
are left out; all others are confirmed on their full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperfold.llm.common import Powers, chunks, map_texts, mix, seeds, table, words
from paperfold.llm.components import components

BANDS, ROWS, BITS = 32, 4, 512
_SIGNATURE = "doc_id bigint, n bigint, c1 bigint, c2 bigint, bands array<bigint>, sketch array<bigint>"


def sketch_limit(similarity: float, samples: int = BANDS * ROWS, bits: int = BITS) -> int:
    """Bits in the XOR of two sketches that a pair of at least ``similarity`` exceeds with a probability below 1e-9."""
    differ = samples * (1 - similarity)
    spread = math.sqrt(max(differ * similarity, 1.0))
    mean = bits / 2 * (1 - math.exp(-4 * differ / bits))
    slope = 2 * math.exp(-4 * differ / bits)
    return math.ceil(mean + 6.2 * math.hypot(slope * spread, math.sqrt(mean) * 0.7))


def _shingle_sets(column, width: int, powers: Powers):
    """For each group of texts: rows, sorted distinct shingle hashes, offsets of the rows in them."""
    factors = seeds(width, 11) | np.uint64(1)
    for first, end, units, offsets in chunks(column):
        hashes, at = words(units, offsets, powers)
        rolled = np.zeros(len(hashes), np.uint64)
        for k in range(width):
            rolled[: max(0, len(hashes) - k)] += hashes[k:] * factors[k]
        rolled = mix(rolled)
        sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                sets.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:  # fewer words: the whole sequence is one shingle
                whole = np.uint64(b - a)
                for h in hashes[a:b]:
                    whole = mix(np.array([whole * factors[0] + h]))[0]
                sets.append(np.array([whole], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
        sizes = np.array([len(s) for s in sets], np.int64)
        yield first, end, np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64).ravel()))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, c1, c2, bands, sketch) of each row; c1 and c2 name the set, so equal sets share them."""
    a, b, c = seeds(BANDS * ROWS, 1) | np.uint64(1), seeds(BANDS * ROWS, 2), seeds(BANDS * ROWS, 3)
    powers = Powers()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        with np.errstate(over="ignore"):
            for first, end, values, at in _shingle_sets(batch.column(1), width, powers):
                full = np.flatnonzero(np.diff(at))
                n, starts = end - first, at[:-1][full]
                least = np.zeros((n, BANDS * ROWS), np.uint64)
                names = np.zeros((n, 2), np.uint64)
                if len(full):
                    for i in range(BANDS * ROWS):
                        least[full, i] = np.minimum.reduceat((values ^ b[i]) * a[i], starts)
                    names[full, 0] = np.add.reduceat(mix(values ^ b[0]), starts)
                    names[full, 1] = np.add.reduceat(mix(values ^ b[1]), starts)
                banded = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
                for k in range(ROWS):
                    banded = mix(banded * a[k] + least[:, k::ROWS])
                spot = (mix(least ^ c) % np.uint64(BITS)).astype(np.int64)
                odd = np.zeros((n, BITS), np.uint8)
                np.bitwise_xor.at(odd, (np.repeat(np.arange(n), BANDS * ROWS), spot.ravel()), 1)
                bits = np.packbits(odd, axis=1, bitorder="little").view(np.uint64)
                out.append((np.diff(at), names, banded, bits))
        sizes, names, banded, bits = (np.concatenate(x) for x in zip(*out, strict=True))
        rows = np.arange(batch.num_rows + 1)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(names[:, 0].copy().view(np.int64)), pa.array(names[:, 1].copy().view(np.int64)),
             _lists(banded, rows * BANDS), _lists(bits, rows * (BITS // 64))],
            ["doc_id", "n", "c1", "c2", "bands", "sketch"],
        )

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, _SIGNATURE)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles): the full set of each row."""
    powers = Powers()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            parts = [_lists(v, at) for _, _, v, at in _shingle_sets(batch.column(1), width, powers)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.concat_arrays(parts)], ["doc_id", "shingles"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id bigint, shingles array<bigint>")


def _may_link(similarity: float) -> Column:
    """The sizes and sketches of l and r allow the similarity."""
    xor = sum((F.bit_count(F.col("l.sketch")[i].bitwiseXOR(F.col("r.sketch")[i])) for i in range(BITS // 64)), F.lit(0))
    percent = F.lit(round(100 * similarity))
    sizes = F.least("l.n", "r.n") * 100 >= F.greatest("l.n", "r.n") * percent
    return sizes & (xor <= sketch_limit(similarity))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    reached = both * 100 >= (F.size("x") + F.size("y") - both) * F.lit(round(100 * similarity))
    return table(pairs.join(left, "a").join(right, "b").where(reached).select("a", "b").distinct(), "links")


def _stars(members: DataFrame) -> DataFrame:
    """(hub, id) once each: every member of a bucket with the member that meets most others in all its buckets.

    The text that a group of copies was made from shares buckets with nearly all of them, so it is the hub of most.
    """
    met = members.groupBy("id").agg(F.sum("size").alias("met"))
    hubs = members.join(met, "id").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("id")).alias("m"))).alias("h"))
    return members.join(hubs, "bucket").select((-F.col("h.m")).alias("hub"), "id").where("hub <> id").distinct()


def _across(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of different components that may reach the similarity; none that does is missing.

    ``placed`` has id and component c, ``sets`` their shingles.  Shingles are ordered by how many sets hold them, rarest
    first.  Two sets of sizes m and n that reach similarity s share at least s(m+n)/(1+s) shingles, so the first that
    they share, at places p and q, leaves enough behind it: min(m-p, n-q) + 1 is no less.  Texts that differ from their
    group by rare shingles fail this without being paired with the group.
    """
    percent = F.lit(round(100 * similarity))
    each = sets.select(F.col("doc_id").alias("id"), F.size("shingles").alias("m"), F.explode("shingles").alias("s"))
    held = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    by_id = Window.partitionBy("id")
    shared = each.join(held, "s").withColumn("k", F.row_number().over(by_id.orderBy("df", "s"))).withColumn("n", F.count("*").over(by_id))
    left_over = F.col("n") - F.col("k") + 1  # shingles from this one on that any other set has
    prefix = shared.select("id", "s", "m", left_over.alias("rest")).where(F.col("rest") * 100 >= F.col("m") * percent)
    prefix = table(prefix.join(placed, "id"), "prefixes")
    l, r = prefix.alias("l"), prefix.alias("r")
    enough = F.least("l.rest", "r.rest") * (percent + 100) >= (F.col("l.m") + F.col("r.m")) * percent
    on = (F.col("l.s") == F.col("r.s")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.c") != F.col("r.c")) & enough
    return l.join(r, on).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, more columns are ignored).

    Linked are sets whose intersection is at least ``similarity`` of their union; component_id is the smallest doc_id
    reachable.  Equal sets meet first, by name, so copies are never paired.  In each band bucket all members are compared
    with one hub; what this leaves in different components of one bucket is joined on its rarest shingles.
    A null or blank text has an empty set and is linked with nothing; a null doc_id gives a null component and is kept;
    rows that repeat a doc_id count as one document.
    """
    signed = table(signatures(docs, width), "signed")
    classes = table(signed.where("n > 0 and doc_id is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("class_id")), "classes")
    one = signed.join(classes.select(F.col("class_id").alias("doc_id"), "c1", "c2"), ["doc_id", "c1", "c2"], "left_semi")
    banded = one.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = table(banded.join(sizes, "bucket"), "members")
    sketches = one.select(F.col("doc_id").alias("id"), "n", "sketch")

    def may_link(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sketches.select(F.col("id").alias("a"), F.struct("n", "sketch").alias("l")), "a")
        both = left.join(sketches.select(F.col("id").alias("b"), F.struct("n", "sketch").alias("r")), "b")
        return table(both.where(_may_link(similarity)).select("a", "b"), "pairs")

    def sets_of(ids: DataFrame) -> DataFrame:
        return table(shingle_sets(docs.join(table(ids, "ids").select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), width), "sets")

    pairs = may_link(_stars(members).select(F.col("hub").alias("a"), F.col("id").alias("b")))
    links = _confirmed(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), similarity)
    found = table(components(links), "first-components")

    placed = members.join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    split = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    placed = table(placed.join(split, "bucket", "left_semi").select("id", "c").distinct(), "open")
    sets = sets_of(placed.select("id"))
    more = _confirmed(may_link(_across(placed, sets, similarity)), sets, similarity)

    joined = table(components(links.unionAll(more)), "components").withColumnRenamed("id", "class_id")
    named = classes.join(joined, "class_id", "left").select("c1", "c2", F.coalesce("component", "class_id").alias("component_id"))
    found_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    found_id = F.when(F.col("doc_id").isNotNull(), found_id)
    return signed.select("doc_id", "n", "c1", "c2").join(named, ["c1", "c2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), found_id.alias("component_id"),
        F.coalesce(F.col("doc_id") == found_id, F.lit(True)).alias("kept"),
    )
