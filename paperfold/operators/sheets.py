"""Spreadsheet grids: mapping to fields, scalars by coordinate, virtual cell boxes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperfold.operators.filters import any_filled

# Width of the virtual sheet and height of its rows.
VIRTUAL_WIDTH, CELL_HEIGHT = 1000, 50


def filled(c: Column) -> Column:
    v = F.trim(c.cast("string"))
    return F.when((v != "") & (F.lower(v) != "nan"), v)


def pick_sheet(grid: DataFrame, sheet: str | None) -> DataFrame:
    """Rows of the named sheet (trimmed, case-insensitive); all rows when there is none such."""
    if not sheet:
        return grid
    wanted = F.lower(F.trim("sheet")) == sheet.strip().lower()
    if grid.where(wanted).limit(1).count() == 0:  # one-row probe
        return grid
    return grid.where(wanted)


def map_table(grid: DataFrame, mapping: Mapping[str, str | None], first_data_row: int) -> DataFrame:
    """Letter columns to field keys from the first data row on; blank rows drop out.

    A key without a column gives null cells.
    """
    rows = grid.where(F.col("local_row_id") >= first_data_row)
    mapped = [c for c in mapping.values() if c]
    rows = rows.where(any_filled(mapped))
    return rows.select("sheet", "row_id", "local_row_id", *[
        (filled(F.col(c)) if c else F.lit(None).cast("string")).alias(k) for k, c in mapping.items()])


def to_cells(table: DataFrame, keys: list[str]) -> DataFrame:
    """Long cells with a mapping status."""
    cells = table.unpivot(["sheet", "row_id", "local_row_id"], keys, "sub_key", "value")
    return cells.withColumn("status", F.when(F.col("value").isNull(), "blank").otherwise("valid"))


def scalars(grid: DataFrame, wanted: DataFrame, letters: list[str]) -> DataFrame:
    """Values by (sheet, row_id, col), else the supplied literal."""
    long = grid.unpivot(["sheet", "row_id"], letters, "col", "__cell").where(filled(F.col("__cell")).isNotNull())
    out = wanted.join(long, ["sheet", "row_id", "col"], "left")
    return out.select(*wanted.columns, F.coalesce(filled(F.col("__cell")), filled(F.col("fallback"))).alias("value"))


def cell_box(col_index: Column, row_index: Column, columns: int) -> Column:
    """Box of a cell on the virtual sheet: equal column widths, fixed row height."""
    width = F.lit(VIRTUAL_WIDTH) / F.lit(max(1, columns))
    x, y = col_index * width, row_index * CELL_HEIGHT
    return F.array(*[F.floor(v * 100 + 0.5) / 100 for v in (x, y, x + width, y + CELL_HEIGHT)])


def cell_of_box(box: Column, columns: int) -> tuple[Column, Column]:
    """(column, row) of a box: the inverse of :func:`cell_box`."""
    width = VIRTUAL_WIDTH / max(1, columns)
    return F.floor(box[0] / width + 0.01), F.floor(box[1] / CELL_HEIGHT + 0.01)
