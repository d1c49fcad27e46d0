"""Merkle manifests of a table: every row learns its proof up to the root by a butterfly exchange.

Leaves are numbered within their tree (a language) and cut into aligned blocks of FANOUT**LEVELS leaves, the partitions
of the exchange.  A block hashes its own subtree and then, round by round, swaps roots: in round r it asks, for each of
the other subtrees under the next common ancestor, the block that stands there at its own place.  All blocks below an
ancestor hash it alike, so each ends with its whole upper proof and the root, and nothing is sent downwards.  Where the
last subtree is cut short its blocks answer in turn, so no block answers for many.

The roots of the trees, ordered by language, are the leaves of one more tree.  A node is the SHA-256 (lower-case hex) of
its children's digests as text; a last run of fewer children, even of one, is hashed likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.llm.common import table
from paperfold.plans.segments import prefix_sum, ranged, total

FANOUT, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(*values: Column) -> Column:
    """Digest of a row's fields, each as its UTF-8 byte count, ``:`` and itself, or ``-`` if null."""
    named = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in named]))


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda below, step: digest(F.concat(step["before"], below, step["after"])))


def siblings(path: Column) -> Column:
    """The digests of all siblings on a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


_PATH = "array<struct<before: string, after: string>>"


def _parents(nodes: Column, fanout: int) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), "")))


def _step(run: Column, own: Column) -> Column:
    """What stands before and after the node number ``own`` of a run."""
    after = F.slice(run, own + 2, F.size(run))
    return F.struct(F.array_join(F.slice(run, F.lit(1), own), "").alias("before"), F.array_join(after, "").alias("after"))


def _blocks(rows: DataFrame, order: list[str], fanout: int, levels: int) -> DataFrame:
    """(tree, block, blocks, items, below, digest): the leaves of each block and the levels of its own subtree.

    ``rows`` has tree, digest, n (how many equal leaves it stands for) and item.
    """
    size = fanout**levels
    spread = ranged(rows, ["tree"], order, [prefix_sum(F.col("n"), "first"), total("leaves", F.col("n"))])
    spread = spread.withColumn("end", F.col("first") + F.col("n")).withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("end") - 1) / size)))
    )
    start = F.greatest("first", F.col("block") * size)
    member = F.struct(start.alias("start"), (F.least("end", (F.col("block") + 1) * size) - start).cast("int").alias("count"), "digest", "item")
    grouped = spread.groupBy("tree", "block").agg(F.max("leaves").alias("leaves"), F.array_sort(F.collect_list(member)).alias("m"))
    one_by_one = F.flatten(F.transform("m", lambda x: F.array_repeat(F.struct(x["digest"].alias("digest"), x["item"].alias("item")), x["count"])))
    out = grouped.select("tree", "block", F.ceil(F.col("leaves") / size).alias("blocks"), one_by_one.alias("items"))
    out = out.withColumn("nodes", F.col("items.digest")).withColumn("below", F.array().cast("array<array<string>>"))
    for _ in range(levels):
        goes_on = (F.col("blocks") > 1) | (F.size("nodes") > 1)
        out = out.withColumn("below", F.when(goes_on, F.array_append("below", F.col("nodes"))).otherwise(F.col("below")))
        out = out.withColumn("nodes", F.when(goes_on, _parents(F.col("nodes"), fanout)).otherwise(F.col("nodes")))
    return table(out.select("tree", "block", "blocks", "items", "below", F.col("nodes")[0].alias("digest")), "merkle-blocks")


def _exchanged(blocks: DataFrame, fanout: int) -> DataFrame:
    """(tree, block, root, upper): each block's path above its own subtree, after as many rounds as the largest tree has levels."""
    held = blocks.select("tree", "block", "blocks", "digest", F.array().cast(_PATH).alias("upper"))
    most, span = held.agg(F.max("blocks")).first()[0] or 0, 1
    while span < most:
        active = held.where(F.col("blocks") > span)
        own = F.floor(F.col("block") / span) % fanout
        group = F.col("block") - F.col("block") % (span * fanout)
        asks = active.select("tree", "block", "blocks", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("k"), (group + F.col("k") * span).alias("start"))
        place = F.col("start") + F.col("block") % span
        place = F.when(place < F.col("blocks"), place).otherwise(F.col("start") + F.col("block") % span % (F.col("blocks") - F.col("start")))
        asks = asks.where(F.col("start") < F.col("blocks")).withColumn("place", place)
        answers = held.select(F.col("tree").alias("t"), F.col("block").alias("b"), "digest", "upper")
        heard = asks.join(answers, F.col("tree").eqNullSafe(F.col("t")) & (F.col("place") == F.col("b")))
        heard = heard.groupBy("tree", "block").agg(
            F.max("blocks").alias("blocks"), F.max("own").cast("int").alias("own"),
            F.array_sort(F.collect_list(F.struct("k", "digest")))["digest"].alias("run"), F.max(F.when(F.col("k") == F.col("own"), F.col("upper"))).alias("upper"),
        )
        heard = heard.select("tree", "block", "blocks", digest(F.array_join("run", "")).alias("digest"), F.array_append("upper", _step(F.col("run"), F.col("own"))).alias("upper"))
        held = table(heard.unionByName(held.where(F.col("blocks") <= span)), "merkle-round")
        span *= fanout
    return held.select("tree", "block", F.col("digest").alias("root"), "upper")


def _rows_of(blocks: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """One row for each leaf: tree, item, leaf, path, root; ``above`` has the root and the upper path of each block."""

    def path(i: Column) -> Column:
        def at(nodes: Column, level: Column) -> Column:
            place = F.floor(i / F.pow(F.lit(fanout), level)).cast("int")
            return _step(F.slice(nodes, place - place % fanout + 1, F.lit(fanout)), place % fanout)

        return F.concat(F.transform("below", at), F.col("upper"))

    each = F.transform("items", lambda x, i: F.struct(x["item"].alias("item"), x["digest"].alias("leaf"), path(i).alias("path")))
    above = above.select(F.col("tree").alias("t"), F.col("block").alias("b"), "root", "upper")
    joined = blocks.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b")))
    return joined.select("tree", "root", F.explode(each).alias("x")).select("tree", "x.item", "x.leaf", "x.path", "root")


def manifest(leaves: DataFrame, carry: list[str] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc_id, lang, leaf, path, subroot, root, and ``carry``) for every row of ``leaves`` (lang, doc_id, leaf).

    There is a tree for each language, null too, with leaves ascending by doc_id (null first), equal ids by leaf.  Equal
    rows are counted before they are numbered and come back as often as they came.  ``path`` holds the texts before and
    after the own digest on every level up to the root of all trees; a tree of one leaf adds no level, an empty table
    gives no rows.  Carried columns may have any name.
    """
    carry = carry or []
    kept = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry])
    rows = leaves.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("id"), F.col("leaf").alias("digest"), kept.alias("kept"))
    rows = rows.groupBy("tree", "id", "digest", "kept").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("tree", "digest", "n", "id", F.struct("id", "kept").alias("item"))
    blocks = _blocks(rows, ["id", "digest", "item"], fanout, levels)
    above = _exchanged(blocks, fanout)
    tops = above.where("block = 0").select(F.lit(0).alias("tree"), F.col("root").alias("digest"), F.lit(1).cast("long").alias("n"), F.struct(F.col("tree").alias("lang")).alias("item"))
    tops = _blocks(tops, ["item"], fanout, levels)
    tops = _rows_of(tops, _exchanged(tops, fanout), fanout).select(F.col("item.lang").alias("lang"), F.col("path").alias("top"), F.col("root").alias("top_root"))
    # only the blocks' paths meet the tops by language; leaves are joined by block
    above = above.join(tops, F.col("tree").eqNullSafe(F.col("lang")))
    above = above.select("tree", "block", F.struct(F.col("root").alias("subroot"), F.col("top_root").alias("root")).alias("root"), F.concat("upper", "top").alias("upper"))
    below = _rows_of(blocks, table(above, "merkle-above"), fanout)
    return below.select(
        F.col("item.id").alias("doc_id"), F.col("tree").alias("lang"), "leaf", "path", "root.subroot", "root.root", *[F.col("item.kept").getField(c).alias(c) for c in carry],
    )
