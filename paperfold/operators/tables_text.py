"""Tables as text, header and merged-cell fills, tagged text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperfold.functions.text import is_entity, markdown_cell
from paperfold.operators.spans import SPAN_BLOCK, text_gaps
from paperfold.plans.segments import carry, numbered, peak, prefix_max, ranged, row_number, segmented, tasks_for, total
from paperfold.sources.shared import written

# Carry-forward columns and ratio, header region.
CARRY_COLUMNS, CARRY_RATIO = 3, 0.3
FILL_ACROSS_ROWS, FILL_DOWN_ROWS = 30, 10


def carry_merged(cells: DataFrame, table: str, row: str, col: str, value: str) -> DataFrame:
    """Fill empty cells from above in columns that look merged.

    Only the first three columns of tables with more than one data row, and
    only where some cells are filled and at least 30 % of the data rows are
    empty.  The first data row may inherit the header.
    """
    cells = written(cells, "cells")
    filled = F.nullif(F.trim(F.coalesce(value, F.lit(""))), F.lit(""))
    data = F.col(row) > 0
    looked_at = F.coalesce(F.col(col) < CARRY_COLUMNS, F.lit(False)) & F.col(table).isNotNull()
    count = lambda c: F.when(c, 1).otherwise(0)
    head = cells.where(looked_at)
    out = segmented(head, [table, col], [row], [F.floor(F.col(row) / 256)], [
        carry(filled, "__up"), peak("__rows", F.col(row)), total("__full", count(data & filled.isNotNull())),
        total("__empty", count(data & filled.isNull()))], tasks_for(head))
    merged = ((F.col("__rows") > 1) & (F.col("__full") > 0) & (F.col("__empty") > 0)
              & (F.col("__empty") >= CARRY_RATIO * F.col("__rows")))
    new = F.when(merged & data & filled.isNull(), F.coalesce("__up", value)).otherwise(F.col(value))
    columns = [c for c in cells.columns if c != value]
    return out.select(*columns, new.alias(value)).unionByName(cells.where(~looked_at).select(*columns, value))


def fill_headers(cells: DataFrame, sheet: str, row: str, col: str, value: str) -> DataFrame:
    """Left-to-right fill on each sheet's first 30 rows, then top-down on the first 10."""
    cells = written(cells, "cells")
    across = Window.partitionBy(sheet, row).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(sheet, col).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    region = cells.where(F.col(row) < FILL_ACROSS_ROWS).withColumn(value, F.last(value, ignorenulls=True).over(across))
    head = region.where(F.col(row) < FILL_DOWN_ROWS).withColumn(value, F.last(value, ignorenulls=True).over(down))
    return head.unionByName(region.where(F.col(row) >= FILL_DOWN_ROWS)).unionByName(cells.where(F.col(row) >= FILL_ACROSS_ROWS))


def text_lines(rows: DataFrame, keys: Sequence[str], order: Sequence[str], headers: Sequence[str]) -> DataFrame:
    """Each key's table as lines of text (position, line): -1 the header, 0 the dashes, then all rows in order.

    Columns that are blank in all rows of a key are left out.  Lines stay rows, so a table may be of any length.
    """
    texts = [markdown_cell(F.trim(F.coalesce(F.col(h).cast("string"), F.lit("")))) for h in headers]
    grid = rows.select(*dict.fromkeys([*keys, *order]), F.array(*texts).alias("__c"))
    used = [total(f"__u{i}", F.when(F.get("__c", F.lit(i)) != "", 1).otherwise(0)) for i in range(len(headers))]
    grid = ranged(grid, list(keys), list(order), [row_number("position"), *used])
    grid = grid.select(*keys, F.col("position").cast("bigint").alias("position"), "__c",
                       F.array(*[F.col(f"__u{i}") > 0 for i in range(len(headers))]).alias("__u"))
    line = lambda values: F.concat(F.lit("| "), F.array_join(F.filter(values, lambda _, i: F.get("__u", i)), " | "), F.lit(" |"))
    dashes = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.filter("__u", lambda u: u))))
    at = lambda position, text: F.struct(position.cast("bigint").alias("position"), text.alias("line"))
    # the first row of a key also gives its header; a row without a key belongs to no table
    head = F.when(F.col("position") == 1, F.array(at(F.lit(-1), line(F.array(*[F.lit(h) for h in headers]))), at(F.lit(0), dashes)))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    body = F.when(known, F.array(at(F.col("position"), line(F.col("__c")))))
    none = F.array().cast("array<struct<position:bigint,line:string>>")
    return grid.select(*keys, F.inline(F.concat(F.coalesce(head, none), F.coalesce(body, none))))


def payload_cut(rows: DataFrame, sheet: str, order: Sequence[str]) -> DataFrame:
    """All rows with their number in the sheet, whether they are in its sample, and how many are not.

    A sheet's sample is its first N rows, N = clamp(500 / number of sheets, 50, 150).
    """
    sheets = rows.select(sheet).distinct().agg(F.floor(F.lit(500) / F.greatest(F.count(F.lit(1)), F.lit(1)))).scalar()
    keep = F.greatest(F.lit(50), F.least(F.lit(150), sheets))
    out = ranged(rows, [sheet], order, [row_number("row_no"), total("row_total")])
    return out.withColumn("in_sample", F.col("row_no") <= keep).withColumn("hidden_rows", F.greatest(F.col("row_total") - keep, F.lit(0)).cast("bigint"))


def number_tags(pieces: DataFrame, doc: str = "doc_id", kind: str = "kind", start: str = "start") -> DataFrame:
    """Tag per document and type in reading order: type letter and hexadecimal number."""
    out = numbered(pieces, [doc, kind], [start], [F.floor(F.col(start) / SPAN_BLOCK)], "__rn")
    return out.withColumn("tag", F.concat(F.col(kind), F.hex("__rn"))).drop("__rn")


def entity_tags(words: DataFrame) -> DataFrame:
    """Tags of the entity words."""
    return number_tags(words.where(is_entity(F.col("word"))).withColumn("kind", F.lit("W")))


def rebuild_text(lines: DataFrame, tables: DataFrame, tags: DataFrame, claims: DataFrame) -> DataFrame:
    """Ordered pieces (doc_id, pos, step, text) of the tagged text; their concatenation is the text.

    ``lines(doc_id, line_no, start, line)``, ``tables(doc_id, start, end,
    table_text)``, ``tags(doc_id, at, tag)``, ``claims(doc_id, start, end)`` of
    cells and tagged words.  Table spans give way to their text table, after
    any text in them that no claim covers; tags stand after their span unless
    inside a table.  The result stays a table of pieces, so a large document
    never has to fit one value.
    """
    block = [F.floor(F.col("pos") / SPAN_BLOCK)]
    none = F.lit(None)
    lines, tags = written(lines, "lines"), written(tags, "tags")
    zone = tables.where(F.col("end") > F.col("start"))
    t_ev = zone.select("doc_id", F.col("start").alias("pos"), F.lit(0).alias("kind"), F.col("end").alias("stop"),
                       "table_text", none.cast("string").alias("tag"), none.cast("int").alias("line_no"))
    g_ev = tags.select("doc_id", F.col("at").alias("pos"), F.lit(1).alias("kind"), F.col("at").alias("stop"),
                       none.cast("string").alias("table_text"), "tag", none.cast("int").alias("line_no"))
    last_line = lines.groupBy("doc_id").agg(F.max("line_no").alias("__last"))
    n_ev = lines.select("doc_id", (F.col("start") + F.length("line")).alias("pos"), F.lit(2).alias("kind"),
                        (F.col("start") + F.length("line") + 1).alias("stop"), none.cast("string").alias("table_text"),
                        none.cast("string").alias("tag"), "line_no")
    events = t_ev.unionByName(g_ev).unionByName(n_ev).withColumn("order_key", F.coalesce("tag", "table_text", F.lit("")))
    order = ["pos", "kind", "stop", "order_key"]
    is_table, is_tag, is_line = (F.col("kind") == k for k in (0, 1, 2))
    # how far the tables before an event reach decides what they swallow
    ev = segmented(events, ["doc_id"], order, block, [prefix_max(F.when(is_table, F.col("stop")), "zone_end")])
    zone_end = F.coalesce("zone_end", F.lit(-1))
    # a tag on the last character of a table still belongs to it, a line end does not
    ev = ev.where(is_table | (is_tag & (zone_end < F.col("pos"))) | (is_line & (zone_end <= F.col("pos"))))
    ev = written(ev, "text-events")
    ev = segmented(ev, ["doc_id"], order, block,
                   [prefix_max(F.col("stop"), "done")])
    ev = written(ev, "text-events-placed")
    done = F.coalesce("done", F.lit(0))
    # text before an event: inside one line, because line ends are events
    texts = ev.where(F.col("pos") > done).select("doc_id", "pos", done.alias("from"))
    # tables swallow line ends, so the line is looked up by position
    starts = lines.select("doc_id", F.col("start").alias("pos"), F.lit(0).alias("kind"), F.struct("line_no", "start").alias("at"))
    ask = texts.select("doc_id", F.col("from").alias("pos"), F.lit(1).alias("kind"), none.cast(starts.schema["at"].dataType).alias("at"),
                       F.col("pos").alias("to"))
    asof = segmented(starts.withColumn("to", none.cast("bigint")).unionByName(ask), ["doc_id"], ["pos", "kind", "to"], block,
                     [carry(F.col("at"), "found")]).where(F.col("kind") == 1)
    plain = asof.select("doc_id", F.col("pos").alias("from"), "to", F.col("found.line_no").alias("line_no")).join(lines, ["doc_id", "line_no"])
    plain = plain.select("doc_id", F.col("to").alias("pos"), F.lit(0).alias("step"), F.lit("").alias("sub"), F.substr(
        F.col("line"), (F.col("from") - F.col("start") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int")).alias("text"))
    # the text before a table precedes what the table recovers
    ends = ev.join(last_line, "doc_id").where(is_line & (F.col("line_no") < F.col("__last"))).select(
        "doc_id", "pos", F.lit(4).alias("step"), F.lit("").alias("sub"), F.lit("\n").alias("text"))
    marks = ev.where(is_tag).select("doc_id", "pos", F.lit(3).alias("step"), F.col("tag").alias("sub"), F.concat(F.lit(" ^"), F.col("tag")).alias("text"))
    grids = ev.where(is_table).select("doc_id", "pos", F.lit(2).alias("step"), F.col("stop").cast("string").alias("sub"),
                                      F.concat(F.lit("\n"), F.col("table_text"), F.lit("\n")).alias("text"))

    # text inside a table that no claim covers, cut at the table's edges
    reach = ev.where(is_table).select("doc_id", F.greatest("pos", F.coalesce("zone_end", F.lit(0))).alias("from"), F.col("stop").alias("to"), F.col("pos").alias("owner")).where(
        F.col("to") > F.col("from"))
    edges = reach.select("doc_id", F.explode(F.array("from", "to")).alias("start")).withColumn("end", F.col("start"))
    gaps = text_gaps(lines, claims.select("doc_id", "start", "end").unionByName(edges), least=1, least_trimmed=2, keep_edges=True)
    gaps = written(gaps, "text-gaps")
    zones = reach.select("doc_id", F.col("from").alias("pos"), F.lit(0).alias("kind"), F.struct("from", "to", "owner").alias("z"), none.cast("string").alias("text"))
    loose = gaps.select("doc_id", F.col("gap_start").alias("pos"), F.lit(1).alias("kind"), none.cast(zones.schema["z"].dataType).alias("z"), "text")
    owned = segmented(zones.unionByName(loose), ["doc_id"], ["pos", "kind"], block, [carry(F.col("z"), "zone")]).where(
        (F.col("kind") == 1) & (F.col("zone.to") > F.col("pos")))
    saved = owned.select("doc_id", F.col("zone.owner").alias("pos"), F.lit(1).alias("step"), F.lpad(F.col("pos").cast("string"), 19, "0").alias("sub"),
                         F.concat("text", F.lit("\n")).alias("text"))
    return plain.unionByName(saved).unionByName(grids).unionByName(marks).unionByName(ends)
