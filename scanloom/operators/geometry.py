"""Coordinate remaps and resampling.

What works along x works on scanlines, without a shuffle; along y it works on
columns, which the same relation gives with x and y exchanged. So a separable
operator costs the two shuffles that gather scanlines and columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import PIXEL, PLANE, sized, to_plane_rows, to_px, to_rows


def _ends(a: float, b: float, size: Column) -> tuple[Column, Column]:
    """A window's ends; ends of 1 or less are shares of the size."""
    start, stop = (((size * float(e)).cast("int") if e <= 1 else F.lit(int(e))) for e in (a, b))
    return start, stop


def crop_x(px: DataFrame, left: float, right: float) -> DataFrame:
    """Columns from left to right, half open."""
    if not 0 <= left or left == right:
        raise ValueError("crop: needs 0 <= left < right <= width")
    a, b = _ends(left, right, F.col("w"))
    return sized(px.where((F.col("x") >= a) & (F.col("x") < b)).withColumn("x", F.col("x") - a), F.least(b, F.col("w")) - a)


def crop_y(px: DataFrame, top: float, bottom: float) -> DataFrame:
    """Rows from top to bottom, half open."""
    return transposed(crop_x(transposed(px), top, bottom))


def transposed(px: DataFrame) -> DataFrame:
    """x and y exchanged."""
    return px.select("img", "pag", F.col("h").alias("w"), F.col("w").alias("h"), "chan", F.col("x").alias("y"), F.col("y").alias("x"), "v")


def split_x(px: DataFrame, at: float) -> tuple[DataFrame, DataFrame]:
    """Left and right part; the right one's page is the next. ``at`` over 1 is the number of parts that the left is one of."""
    if at <= 0 or at == 1:
        raise ValueError("split: the share must be positive and not 1")
    cut = F.floor(F.col("w") * (1.0 / at if at > 1 else float(at))).cast("int")
    left = sized(px.where(F.col("x") < cut), cut)
    right = px.where(F.col("x") >= cut).withColumns({"x": F.col("x") - cut, "pag": F.col("pag") + 1})
    return left, sized(right, F.col("w") - cut)


def split_y(px: DataFrame, at: float) -> tuple[DataFrame, DataFrame]:
    """Top and bottom part; the bottom one's page is the next."""
    top, bottom = split_x(transposed(px), at)
    return transposed(top), transposed(bottom)


def rotate(px: DataFrame, angle: float) -> DataFrame:
    """Clockwise by the nearest multiple of 90 degrees."""
    turns = math.floor(angle / 90 + 0.5) % 4
    w, h, x, y = (F.col(c) for c in "whxy")
    to = {0: (w, h, x, y), 1: (h, w, h - 1 - y, x), 2: (w, h, w - 1 - x, h - 1 - y), 3: (h, w, y, w - 1 - x)}[turns]
    return px.select("img", "pag", to[0].alias("w"), to[1].alias("h"), "chan", to[3].alias("y"), to[2].alias("x"), "v")


def _along_x(px: DataFrame, size: Column, cell) -> DataFrame:
    """New scanlines of a new width: ``cell(x, at)`` with ``at(k)`` the old sample k."""
    rows = to_rows(px)
    made = F.transform(F.sequence(F.lit(0), size - 1), lambda x: cell(x, lambda k: F.get("row", k.cast("int") if isinstance(k, Column) else k)))
    return to_px(sized(rows.withColumn("row", made), size))


def _along_y(px: DataFrame, operator, *args) -> DataFrame:
    return transposed(operator(transposed(px), *args))


def half_x(px: DataFrame) -> DataFrame:
    """Half the width: kernels 1 3 3 1 (even widths, to w/2 + 1) and 1 4 6 4 1 (odd ones, to (w+1)/2); ends are copied."""
    w = F.col("w")
    even = w % 2 == 0
    size = F.when(even, F.floor(w / 2) + 1).otherwise(F.floor((w + 1) / 2)).cast("int")

    def cell(x: Column, at) -> Column:
        four = (3 * (at(2 * x - 1) + at(2 * x)) + at(2 * x - 2) + at(2 * x + 1)) / 8
        five = (6 * at(2 * x) + 4 * (at(2 * x - 1) + at(2 * x + 1)) + at(2 * x - 2) + at(2 * x + 2)) / 16
        return F.when(x == 0, at(0)).when(x == size - 1, at(w - 1)).when(even, four).otherwise(five)

    return _along_x(px, size, cell)


def half_y(px: DataFrame) -> DataFrame:
    """Half the height."""
    return _along_y(px, half_x)


def half(px: DataFrame) -> DataFrame:
    """Half the size."""
    return half_y(half_x(px))


def redouble_x(px: DataFrame, odd: bool) -> DataFrame:
    """Double the width, on the grid that ``half_x`` leaves: to 2w - 1 (odd) or 2w - 2; ends are copied. Needs 3 columns."""
    w = F.col("w")
    size = (2 * w - 2 + int(odd)).cast("int")

    def cell(x: Column, at) -> Column:
        def beyond(k: Column) -> Column:
            return F.when(k < 0, 2 * at(0) - at(1)).when(k >= w, 2 * at(w - 1) - at(w - 2)).otherwise(at(k))

        k = F.floor((x + 1) / 2).cast("int")
        on_odd = x % 2 == 1
        if odd:
            value = F.when(on_odd, 11 / 16 * (at(k - 1) + at(k)) - 3 / 16 * (beyond(k - 2) + beyond(k + 1))).otherwise(10 / 8 * at(k) - (at(k - 1) + at(k + 1)) / 8)
        else:
            value = F.when(on_odd, at(k - 1) / 16 + 18 / 16 * at(k) - 3 / 16 * at(k + 1)).otherwise(-3 / 16 * at(k - 1) + 18 / 16 * at(k) + at(k + 1) / 16)
        return F.when(x == 0, at(0)).when(x == size - 1, at(w - 1)).otherwise(value)

    return _along_x(px, size, cell)


def redouble_y(px: DataFrame, odd: bool) -> DataFrame:
    """Double the height, on the grid that ``half_y`` leaves."""
    return _along_y(px, redouble_x, odd)


def redouble(px: DataFrame, odd_w: bool, odd_h: bool) -> DataFrame:
    """Double the size, back to widths and heights of the given parity."""
    return redouble_y(redouble_x(px, odd_w), odd_h)


def double(px: DataFrame, sharpness: float = 0.0) -> DataFrame:
    """Twice the size: each sample four times, weighted with its nearest neighbours (clamped at the edges)."""
    a, b, c = (s + (t - s) * sharpness for s, t in ((9 / 16, 8 / 15), (3 / 16, 2 / 15), (1 / 16, 3 / 15)))
    down = Window.partitionBy("img", "chan").orderBy("y")
    rows = to_plane_rows(px).withColumns({"up": F.coalesce(F.lag("row").over(down), "row"), "down": F.coalesce(F.lead("row").over(down), "row")})

    def line(other: str) -> Column:
        def cell(x: Column) -> Column:
            at = F.floor(x / 2).cast("int")
            near = F.least(F.greatest(at + F.when(x % 2 == 1, 1).otherwise(-1), F.lit(0)), F.col("w") - 1)
            return a * F.get("row", at) + b * (F.get("row", near) + F.get(other, at)) + c * F.get(other, near)

        return F.transform(F.sequence(F.lit(0), 2 * F.col("w") - 1), cell)

    both = rows.select(*PLANE, F.explode(F.array(F.struct((2 * F.col("y")).alias("y"), line("up").alias("row")), F.struct((2 * F.col("y") + 1).alias("y"), line("down").alias("row")))).alias("o"))
    return to_px(sized(both.select(*PLANE, "o.y", "o.row"), 2 * F.col("w"), 2 * F.col("h")))


def _slope(px: DataFrame, slope: float | DataFrame) -> DataFrame:
    """``px`` with the column slope: one for all images, or each image's own (img, slope)."""
    if isinstance(slope, DataFrame):
        return px.join(slope.select(F.col("img").alias("of"), "slope"), F.col("img") == F.col("of")).drop("of")
    if abs(slope) > 1:
        raise ValueError("shear: the slope must be between -1 and 1")
    return px.withColumn("slope", F.lit(float(slope)))


def _sheared(px: DataFrame, slope, offset: Column, cell) -> DataFrame:
    rows = _slope(to_rows(px), slope).withColumn("shift", offset * F.col("slope"))
    rows = rows.withColumn("whole", F.floor("shift").cast("int")).withColumn("part", F.col("shift") - F.col("whole"))
    made = F.transform(F.sequence(F.lit(0), F.col("w") - 1), cell)
    return to_px(rows.select(*PLANE, "y", made.alias("row")))


def _clamped(k: Column) -> Column:
    return F.get("row", F.least(F.greatest(k, F.lit(0)), F.col("w") - 1).cast("int"))


def shear_x(px: DataFrame, slope: float | DataFrame) -> DataFrame:
    """Shift each row by slope times its distance from the middle, interpolating; a slope of 0 shifts by one pixel."""
    d, part = F.col("whole"), F.col("part")

    def cell(x: Column) -> Column:
        start = F.when(d > 0, F.least(x, F.col("w") - 1 - d)).otherwise(F.greatest(x, 1 - d))
        return part * _clamped(start + d) + (1 - part) * _clamped(start + d - 1)

    return _sheared(px, slope, F.col("y") - F.floor(F.col("h") / 2), cell)


def shear_y(px: DataFrame, slope: float | DataFrame) -> DataFrame:
    """Shift each column by slope times its distance from the middle, interpolating; edges are clamped."""

    def cell(y: Column) -> Column:
        return (1 - F.col("part")) * _clamped(y + F.col("whole")) + F.col("part") * _clamped(y + F.col("whole") + 1)

    # of the exchanged relation: its y is the column
    return transposed(_sheared(transposed(px), slope, F.floor(F.col("h") / 2) - F.col("y"), cell))


def skew(px: DataFrame, angle: float | DataFrame) -> DataFrame:
    """Rotate by a small angle in degrees (or each image's own, img and angle) by three shears."""
    if isinstance(angle, DataFrame):
        b = F.sin(F.radians("angle"))
        a = angle.select("img", (b / (1 + F.cos(F.radians("angle")))).alias("slope"))
        b = angle.select("img", b.alias("slope"))
    else:
        if abs(angle) > 45:
            raise ValueError("skew: angle must be between -45 and 45")
        b = math.sin(math.radians(angle))
        a = b / (1 + math.cos(math.radians(angle)))
    return shear_x(shear_y(shear_x(px, a), b), a)


def deskew(px: DataFrame) -> DataFrame:
    """Detect each image's skew and rotate it back."""
    from scanloom.operators.stats import detect_skew

    return skew(px, detect_skew(px)).select(*PIXEL, "v")
