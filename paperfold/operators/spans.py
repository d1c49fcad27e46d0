"""Character spans: claims, gaps and references, without pairing spans.

Overlap questions are answered by one ordered pass over the union of both
sides (a running maximum of interval ends), so neither a hot document nor
dense overlaps multiply rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.plans.pick import pick_first
from paperfold.plans.segments import carry, prefix_max, segmented

SPAN_BLOCK = 4096


def unclaimed_words(words: DataFrame, claims: DataFrame) -> DataFrame:
    """Words (doc_id, start, word) whose span overlaps no claim (doc_id, start, end).

    A word is claimed when, among the claims that start before its end, the
    largest end lies beyond its start.
    """
    w = words.select("doc_id", (F.col("start") + F.length("word") - 1).alias("at"), F.lit(1).alias("kind"),
                     "start", F.lit(None).cast("bigint").alias("end"), "word")
    c = claims.where(F.col("end") > F.col("start")).select(
        "doc_id", F.col("start").alias("at"), F.lit(0).alias("kind"), "start", F.col("end").cast("bigint").alias("end"),
        F.lit(None).cast("string").alias("word"))
    out = segmented(w.unionByName(c), ["doc_id"], ["at", "kind", "start", "end"], [F.floor(F.col("at") / SPAN_BLOCK)],
                    [prefix_max(F.col("end"), "reach")])
    free = (F.col("kind") == 1) & ~F.coalesce(F.col("reach") > F.col("start"), F.lit(False))
    return out.where(free).select("doc_id", "start", "word")


def text_gaps(lines: DataFrame, claims: DataFrame, least: int = 3, least_trimmed: int = 2,
              keep_edges: bool = False) -> DataFrame:
    """Unclaimed stretches of each line (doc_id, line_no, start, line).

    The end of a line counts as a claim of its own, so every gap lies inside
    one line and the pass needs no pairing of lines and claims.
    """
    ends = lines.select("doc_id", (F.col("start") + F.length("line")).alias("start"),
                        (F.col("start") + F.length("line") + 1).alias("end"), "line_no")
    # an empty claim covers nothing but, when kept, cuts a gap in two
    spans = claims.where(F.col("end") >= F.col("start") if keep_edges else F.col("end") > F.col("start")).select(
        "doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"),
        F.lit(None).cast("int").alias("line_no"))
    events = ends.unionByName(spans).withColumn("is_end", F.col("line_no").isNotNull())
    out = segmented(events, ["doc_id"], ["start", "end", "is_end"], [F.floor(F.col("start") / SPAN_BLOCK)],
                    [prefix_max(F.col("end"), "reach"), carry(F.col("line_no"), "last_line")])
    reach = F.coalesce("reach", F.lit(0))
    line_no = F.when(F.col("is_end"), F.col("line_no")).otherwise(F.coalesce(F.col("last_line") + 1, F.lit(0)))
    gaps = out.where(F.col("start") - reach >= least).select(
        "doc_id", line_no.alias("line_no"), reach.alias("gap_start"), F.col("start").alias("gap_end"))
    text = F.trim(F.substr(F.col("line"), (F.col("gap_start") - F.col("start") + 1).cast("int"),
                           (F.col("gap_end") - F.col("gap_start")).cast("int")))
    return (
        gaps.join(lines, ["doc_id", "line_no"])
        .select("doc_id", "line_no", "gap_start", "gap_end", text.alias("text"))
        .where(F.length("text") >= least_trimmed)
    )


def resolve_refs(cells: DataFrame, refs: DataFrame) -> DataFrame:
    """Cell references to text, box and page, with the confidence the reference earns."""
    known = refs.select("ref_id", F.col("text").alias("ref_text"), "page_number", F.lit(True).alias("__known"))
    out = cells.join(known, "ref_id", "left")
    base = (F.when(F.col("__known"), F.when(F.col("is_uncertain"), 0.5).otherwise(1.0))
            .when(F.col("ref_id").isNotNull(), 0.3).otherwise(0.0))
    blank = F.coalesce("value", F.lit("")) == ""
    return out.select(
        *[c for c in cells.columns if c not in ("value", "confidence")],
        F.when(blank & F.col("ref_text").isNotNull(), F.col("ref_text")).otherwise(F.col("value")).alias("value"),
        F.coalesce("confidence", base).alias("confidence"), "page_number")


def resolve_many(cells: DataFrame, keys: list[str], refs: DataFrame) -> DataFrame:
    """Cells with several references: union of the boxes, first page, file of the first reference."""
    each = cells.select(*keys, F.posexplode("indices").alias("pos", "ref_id")).join(refs, "ref_id", "left")
    return each.groupBy(*keys).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.min_by("page_number", F.when(F.col("page_number").isNotNull(), F.col("pos"))).alias("page_number"),
        F.max(F.when(F.col("pos") == 0, F.col("file_id"))).alias("file_id"))


def first_writer(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Merged cells spread over every covered position; the first cell written there wins."""
    spread = cells.withColumn("r", F.explode(F.sequence("row_index", F.col("row_index") + F.col("row_span") - 1)))
    spread = spread.withColumn("c", F.explode(F.sequence("col_index", F.col("col_index") + F.col("col_span") - 1)))
    return pick_first(spread, [*keys, "r", "c"], ["row_index", "col_index", "cell_no"], ["content"])
