"""The prefix trie of conversations, and what its subtrees hold, by the Euler tour technique.

A node is a distinct sequence of first turns; turns travel as digests, never as texts.  Every node has an arc that
enters it and one that leaves it; each arc knows the next one of the tour around the trie (children by their smallest
conversation).  The tour is a linked list, whose positions ``listrank`` finds; sums over the arcs in this order, read at a
node's two arcs, give what its subtree holds.

A sequence is told from others by four sums of 31 bits, each over hashes of (place, turn) drawn by another seed: two
different ones have equal sums with probability below 1e-37.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.llm import listrank
from paperfold.llm.common import parts_of, table
from paperfold.plans.segments import lead, numbered_all, prefix_sum, ranged, row_number, segmented, total

_SUMS = 4
_KEY = ["depth", *[f"s{j}" for j in range(_SUMS)]]
_ENDS = 1 << 14  # conversation ids that one piece of a node's list spans
_STEP = 4096  # arcs in a segment of the tour, at least


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, turn_digest, chars): the turns of each conversation from 0, by turn, null first.

    A null role or text is empty; rows of one turn follow each other by their digest, and repeated rows are turns of
    their own; rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), said.alias("turn_digest"), F.length(text).cast("long").alias("chars")
    )
    out = ranged(rows, ["conv_id"], ["turn", "turn_digest"], [row_number("i")])
    return table(out.select("conv_id", (F.col("i") - 1).alias("i"), "turn_digest", "chars"), "turns")


def forked(turns: DataFrame, base: Column, kept: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another: (conv_id, pos, turn_digest, chars), and all (conv_id).

    Of the conversation ``base`` (of conv_id) the first ``kept`` turns (of conv_id, at most ``most``), then the own turns
    after as many.
    """
    ids = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), kept.cast("long").alias("kept"))
    sizes = turns.where(F.col("i") < most).groupBy("conv_id").agg(F.count("*").alias("n")).withColumnRenamed("conv_id", "c")
    ids = ids.join(sizes, F.col("base") == F.col("c"), "left")
    ids = table(ids.select("conv_id", "base", "kept", F.least("kept", F.coalesce("n", F.lit(0))).alias("used")), "forks")
    heads = turns.where(F.col("i") < most).select(F.col("conv_id").alias("c"), F.col("i").alias("pos"), "turn_digest", "chars")
    heads = ids.join(heads, (F.col("base") == F.col("c")) & (F.col("pos") < F.col("kept"))).select("conv_id", "pos", "turn_digest", "chars")
    own = turns.join(ids, "conv_id").where(F.col("i") >= F.col("kept"))
    own = own.select("conv_id", (F.col("i") - F.col("kept") + F.col("used")).alias("pos"), "turn_digest", "chars")
    return heads.unionByName(own), ids.select("conv_id")


def _ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id) rows: SHA-256 of the conversation ids of each key, ascending, comma-joined.

    Ids are joined piece by piece before; a key's pieces then pass through one digest in order, one at a time.
    """
    pieces = rows.groupBy(*_KEY, F.floor(F.col("conv_id") / _ENDS).alias("piece")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select(*_KEY, "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    pieces = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, done = None, None, []
        for batch in batches:
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != held:
                    if held is not None:
                        done.append((*held, state.hexdigest()))
                    held, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], [*_KEY, "ends_sha256"])
                done = []
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held, state.hexdigest())], [*_KEY, "ends_sha256"])

    return pieces.mapInArrow(run, ", ".join(f"{c} bigint" for c in _KEY) + ", ends_sha256 string")


def _nodes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each node, numbered by (conv_id, depth), so that the nodes of one conversation's path follow each other."""
    marks = [(F.xxhash64("pos", "turn_digest", F.lit(j)).bitwiseAND(F.lit(0x7FFFFFFF))) for j in range(_SUMS)]
    placed = turns.select("conv_id", "pos", "chars", *[m.alias(f"m{j}") for j, m in enumerate(marks)])
    placed = ranged(placed, ["conv_id"], ["pos"], [total("size"), *[prefix_sum(F.col(f"m{j}"), f"p{j}") for j in range(_SUMS)]])
    placed = table(placed.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "size", "chars", *[f"p{j}" for j in range(_SUMS)], *[(F.col(f"p{j}") + F.col(f"m{j}")).alias(f"s{j}") for j in range(_SUMS)],
    ), "prefixes")
    zeros = [F.lit(0).cast("long").alias(c) for c in _KEY]
    found = placed.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), *[F.min(f"p{j}").alias(f"p{j}") for j in range(_SUMS)])
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*zeros, "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"), *[F.lit(None).cast("long").alias(f"p{j}") for j in range(_SUMS)])
    turnless = members.join(placed.select("conv_id").distinct(), "conv_id", "left_anti").select(*zeros, "conv_id")
    ends = _ends(placed.where("depth = size").select(*_KEY, "conv_id").unionByName(turnless))
    found = found.unionByName(root).join(ends, _KEY, "left")
    nodes = table(numbered_all(found, ["conv_id", "depth"], "k").withColumn("k", F.col("k") - 1), "trie-numbered")
    above = nodes.select(F.col("k").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("d"), *[F.col(f"s{j}").alias(f"q{j}") for j in range(_SUMS)])
    on = F.col("d") == F.col("depth") - 1
    for j in range(_SUMS):
        on = on & (F.col(f"q{j}") == F.col(f"p{j}"))
    below = ranged(nodes.join(above, on).select("k", "up", "parent_conv_id"), ["up"], ["k"], [lead(F.col("k"), "sibling")])
    below = table(below, "trie-children")
    first = below.groupBy("up").agg(F.min("k").alias("child"), F.count("*").alias("n_children")).withColumnRenamed("up", "u")
    nodes = nodes.join(below, "k", "left").join(first, F.col("k") == F.col("u"), "left")
    return table(nodes.select(
        "k", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "up", "child", "sibling",
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    ), "trie-nodes")


def trie(turns: DataFrame, members: DataFrame, block: int = listrank.BLOCK, limit: int = listrank.LIMIT) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` (conv_id, pos, turn_digest, chars) are numbered from 0 without gaps in each conversation; ``members`` lists
    every conversation, with or without turns.  A node goes by its smallest member; saved_tokens are the code points that
    need not be stored or computed again because conversations share the nodes of the subtree; ends_sha256 is of the
    conversations that end at the node.  No members, no rows.
    """
    nodes = _nodes(turns, members)
    down = F.when(F.col("child").isNotNull(), F.col("child") * 2).otherwise(F.col("k") * 2 + 1)
    on = F.when(F.col("sibling").isNotNull(), F.col("sibling") * 2).otherwise(F.col("up") * 2 + 1)
    arcs = nodes.select(F.explode(F.array(F.struct((F.col("k") * 2).alias("id"), down.alias("succ")), F.struct((F.col("k") * 2 + 1).alias("id"), on.alias("succ")))).alias("a")).select("a.*")
    places = listrank.ranked(arcs, block, limit)
    enters = F.col("id") % 2 == 0
    held = nodes.select("k", (F.col("child").isNull()).cast("long").alias("leaf"), "saved")
    tour = places.withColumn("k", F.floor(F.col("id") / 2)).join(held, "k")
    zero = F.lit(0).cast("long")
    tour = table(tour.select("pos", "k", enters.alias("enters"), F.when(enters, F.col("leaf")).otherwise(zero).alias("leaf"), F.when(enters, F.col("saved")).otherwise(zero).alias("saved")), "tour")
    step = max(_STEP, tour.count() // (16 * parts_of(nodes.sparkSession)))
    sums = segmented(tour, [], ["pos"], [F.floor(F.col("pos") / step)], [prefix_sum(F.col("leaf"), "leaves"), prefix_sum(F.col("saved"), "savings")])
    both = sums.groupBy("k").agg(*[
        (F.max(F.when(~F.col("enters"), F.col(c))) - F.max(F.when(F.col("enters"), F.col(c)))).alias(name) for c, name in (("leaves", "n_leaves"), ("savings", "saved_tokens"))
    ])
    return nodes.join(both, "k").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
