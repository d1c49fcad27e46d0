"""Bounding boxes as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letter page in inches and in points, padding of the pixel guess.
PAGE_IN = (8.5, 11.0)
PAGE_PT = (612.0, 792.0)
PIXEL_PAD = 1.1


def to_rect(box: Column) -> Column:
    """[x1, y1, x2, y2] of a 4-number box or of a polygon with 8 or more numbers."""
    xs = F.filter(box, lambda v, i: i % 2 == 0)
    ys = F.filter(box, lambda v, i: i % 2 == 1)
    poly = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return F.when(F.size(box) >= 8, poly).when(F.size(box) >= 4, F.slice(box, 1, 4))


def object_rect(box: Column) -> Column:
    """[x1, y1, x2, y2] of a box given by names (map<string,double>): corners, or a corner with width and height."""
    at = lambda name: F.try_element_at(box, F.lit(name))
    corners = F.array(at("x1"), at("y1"), at("x2"), at("y2"))
    sized = F.array(at("x"), at("y"), at("x") + at("w"), at("y") + at("h"))
    whole = lambda a: ~F.exists(a, lambda v: v.isNull())
    return F.when(whole(corners), corners).when(whole(sized), sized)


def to_percent(df: DataFrame, box: str, width: str, height: str, name: str) -> DataFrame:
    """Append the box in percent of the page; the unit is guessed when the page size is unknown.

    Boxes without area become null.
    """
    staged = df.withColumn("__r", to_rect(F.col(box))).withColumns({
        "__hi": F.array_max("__r"), "__lo": F.array_min("__r")})
    r, w, h = F.col("__r"), F.col(width), F.col(height)
    x2, y2 = r[2], r[3]
    known = (w > 0) & (h > 0)
    fraction = (F.col("__lo") >= 0) & (F.col("__hi") < 1)
    inches = (F.col("__lo") >= 0) & (F.col("__hi") <= 20)
    pixels = (x2 > 100) | (y2 > 100)
    unit = lambda size, page, point, far: (
        F.when(known, size).when(fraction, 1.0).when(inches, page)
        .when(pixels, F.greatest(far * PIXEL_PAD, F.lit(point))).otherwise(100.0)
    )
    staged = staged.withColumns({
        "__w": unit(w, PAGE_IN[0], PAGE_PT[0], x2), "__h": unit(h, PAGE_IN[1], PAGE_PT[1], y2)})
    pct = F.array(*[r[i] / F.col("__w" if i % 2 == 0 else "__h") * 100.0 for i in range(4)])
    has_area = (r[2] > r[0]) & (r[3] > r[1])
    return staged.withColumn(name, F.when(has_area, pct)).drop("__r", "__hi", "__lo", "__w", "__h")


def box_text(box: Column, digits: int = 3) -> Column:
    scale = 10 ** digits
    return F.array_join(
        F.transform(box, lambda v: F.floor(v * scale + 0.5).cast("bigint").cast("string")), ","
    )
