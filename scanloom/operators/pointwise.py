"""Pointwise maps, planes and selections."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import ALPHA, IMAGE, PIXEL, SELECTION, colour, not_selection, rnd, where_planes


def contrast(px: DataFrame, black: float, white: float) -> DataFrame:
    """Stretch [black, white] to [0, 255] on the colour planes, inverted where white < black; a step where equal."""
    v = F.col("v")
    if black == white:
        return where_planes(px, colour(), F.when(v <= black, 0.0).otherwise(255.0))
    m = 255.0 / (white - black)
    low, high = (v <= black, v >= white) if black < white else (v >= black, v <= white)
    return where_planes(px, colour(), F.when(low, 0.0).when(high, 255.0).otherwise(v * m - black * m))


def binarize(px: DataFrame, threshold: float) -> DataFrame:
    """0 up to the threshold and 255 above; a threshold of 1 or less is a share of 255."""
    t = threshold * 255 if threshold <= 1 else threshold
    return contrast(px, t, t)


def binarize_auto(px: DataFrame, statistics: DataFrame) -> DataFrame:
    """Binarize each image at its own gray threshold (``graythr`` of its statistics)."""
    t = statistics.select(F.col("img").alias("of"), F.round(F.col("graythr") * 255).alias("t"))
    joined = px.join(t, F.col("img") == F.col("of"), "left").drop("of")
    return where_planes(joined, colour() & F.col("t").isNotNull(), F.when(F.col("v") <= F.col("t"), 0.0).otherwise(255.0)).drop("t")


def contrast_auto(px: DataFrame, statistics: DataFrame) -> DataFrame:
    """Stretch each image's own mean black to mean white."""
    s = statistics.select(F.col("img").alias("of"), (F.col("black") * 255).alias("b"), (F.col("white") * 255).alias("t"))
    joined = px.join(s, F.col("img") == F.col("of"), "left").drop("of")
    v, b, t = F.col("v"), F.col("b"), F.col("t")
    stretched = F.when(v <= b, 0.0).when(v >= t, 255.0).otherwise((v - b) * 255.0 / F.when(t != b, t - b))
    return where_planes(joined, colour() & b.isNotNull() & t.isNotNull(), stretched).drop("b", "t")


def quantize(px: DataFrame, steps: float) -> DataFrame:
    """Nearest of ``steps`` levels per gray level around 128."""
    return where_planes(px, not_selection(), rnd((F.col("v") - 128.0) * float(steps)) / float(steps) + 128.0)


@lru_cache(maxsize=4)
def blue_noise_matrix(size: int = 16, seed: int = 7) -> tuple[int, ...]:
    """A threshold matrix of ranks by void and cluster: no two near ranks lie near each other.

    Each rank goes to the emptiest place: that of the least sum of Gaussians
    around the places taken, wrapping at the edges.
    """
    y, x = np.mgrid[:size, :size]
    d2 = np.minimum(y, size - y) ** 2 + np.minimum(x, size - x) ** 2
    bump = np.exp(-d2 / (2 * 1.9**2))
    energy = np.random.default_rng(seed).random((size, size)) * 1e-6
    ranks = np.zeros((size, size), int)
    taken = np.zeros((size, size), bool)
    for rank in range(size * size):
        at = np.unravel_index(np.argmin(np.where(taken, np.inf, energy)), (size, size))
        ranks[at], taken[at] = rank, True
        energy = energy + np.roll(bump, at, (0, 1))
    return tuple(int(r) for r in ranks.ravel() * 256 // (size * size))


def dither_blue_noise(px: DataFrame, step: float, matrix: tuple[int, ...] | None = None) -> DataFrame:
    """Ordered dither by a square matrix of ranks 0 to 255, row by row."""
    matrix = blue_noise_matrix() if matrix is None else tuple(matrix)
    n = int(len(matrix) ** 0.5)
    table = F.split(F.lit(",".join(map(str, matrix))), ",").cast("array<int>")
    rank = F.get(table, n * (F.col("y") % n) + F.col("x") % n)
    return where_planes(px, not_selection(), rnd(F.col("v") / float(step) + rank / 255.0 - 0.5) * float(step))


def fill(px: DataFrame, values: dict[int, float | None]) -> DataFrame:
    """Set planes to constants, weighted by the selection where an image has one; None keeps a plane."""
    table = {k: v for k, v in values.items() if v is not None}
    if not table:
        return px
    sel = px.where(F.col("chan") == SELECTION).select(*[F.col(c).alias(f"s_{c}") for c in ("img", "y", "x")], F.col("v").alias("s"))
    joined = px.join(sel, (F.col("img") == F.col("s_img")) & (F.col("y") == F.col("s_y")) & (F.col("x") == F.col("s_x")), "left")
    target = F.lit(None).cast("double")
    for chan, value in table.items():
        target = F.when(F.col("chan") == chan, float(value)).otherwise(target)
    s = F.coalesce("s", F.lit(1.0))
    value = F.when(s == 0, F.col("v")).when(s == 1, target).otherwise(F.col("v") + s * (target - F.col("v")))
    return where_planes(joined, not_selection() & target.isNotNull(), value).select(*px.columns)


def grid(px: DataFrame, step: float, compat: bool = False) -> DataFrame:
    """Draw full lines every 10 steps and dashed ones every step; pixels on them become black or white, away from their own."""
    sx, sy = ((F.col("w") * step).cast("int"), (F.col("h") * step).cast("int")) if step <= 1 else (F.lit(int(step)), F.lit(int(step)))
    sx, sy = F.greatest(sx, F.lit(1)), F.greatest(sy, F.lit(1))
    x, y = F.col("x"), F.col("y")

    def half(s: Column, parts: int) -> Column:
        return F.floor(s / parts).cast("int")

    dashed_x = (x % sx == 0) & ((y + half(sy, 4)) % sy < half(sy, 2))
    dashed_y = (y % sy == 0) & ((x + half(sx, 4)) % sx < half(sx, 2))
    hit = (y % (10 * sy) == 0) | (x % (10 * sx) == 0) | dashed_x | dashed_y
    return where_planes(px, colour() & hit, F.when(F.col("v") < 128, 1.0 if compat else 255.0).otherwise(0.0))


def extract_channel(px: DataFrame, chan: int) -> DataFrame:
    """Plane ``chan`` as the only one, gray."""
    if not 0 <= chan <= 4:
        raise ValueError("a plane is 0 to 4")
    return px.where(F.col("chan") == chan).withColumn("chan", F.lit(1))


def opaque(px: DataFrame) -> DataFrame:
    """Drop the alpha plane."""
    return px.where(F.col("chan") != ALPHA)


def _places(px: DataFrame) -> DataFrame:
    """Every pixel place of each image once, off its first plane, without a shuffle of pixels."""
    first = px.groupBy("img").agg(F.min("chan").alias("first")).withColumnRenamed("img", "of")
    return px.join(first, (F.col("img") == F.col("of")) & (F.col("chan") == F.col("first"))).select(*IMAGE, "y", "x")


def _with_plane(px: DataFrame, chan: int, value: float) -> DataFrame:
    """``px`` with a constant plane where an image lacks it."""
    has = px.where(F.col("chan") == chan).select(F.col("img").alias("of")).distinct()
    new = _places(px).join(has, F.col("img") == F.col("of"), "left_anti").withColumns({"chan": F.lit(chan), "v": F.lit(float(value))})
    return px.unionByName(new.select(*PIXEL, "v"))


def add_alpha(px: DataFrame) -> DataFrame:
    """An opaque alpha plane for the images without one."""
    return _with_plane(px, ALPHA, 255.0)


def depth(px: DataFrame) -> DataFrame:
    """The number of planes 0 to 3 of each image."""
    return px.where(not_selection()).groupBy("img").agg(F.countDistinct("chan").cast("int").alias("depth"))


def _edge(at: float, size: Column, end: bool) -> Column:
    """A coordinate: whole numbers are pixels, others shares; negative ones (at an end, 0 too) count from the far side."""
    place = F.lit(int(at)) if float(at).is_integer() and not isinstance(at, float) else (size * float(at)).cast("int")
    return size + place if at < 0 or (end and at == 0) else place


def select_rectangle(px: DataFrame, value: float, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Set the selection within a half-open box to ``value``; with a minus sign (-0.0 too), outside it to -value."""
    px = _with_plane(px, SELECTION, 0.0)
    w, h, x, y = (F.col(c) for c in "whxy")
    inside = (x >= _edge(x0, w, False)) & (x < _edge(x1, w, True)) & (y >= _edge(y0, h, False)) & (y < _edge(y1, h, True))
    outside = str(float(value)).startswith("-")
    return where_planes(px, (F.col("chan") == SELECTION) & (~inside if outside else inside), F.lit(abs(float(value))))


def set_selection(px: DataFrame, value: float) -> DataFrame:
    """A selection of one weight everywhere."""
    return where_planes(_with_plane(px, SELECTION, value), F.col("chan") == SELECTION, F.lit(float(value)))


def selection_to_alpha(px: DataFrame) -> DataFrame:
    """The selection as alpha; 1 everywhere without one."""
    whole = _with_plane(px, SELECTION, 1.0)
    alpha = whole.where(F.col("chan") == SELECTION).withColumn("chan", F.lit(ALPHA))
    return opaque(px).unionByName(alpha)


def poke(px: DataFrame, x: int, y: int, chan: int, value: float) -> DataFrame:
    """Set one sample; outside of the image nothing happens."""
    return where_planes(px, (F.col("x") == x) & (F.col("y") == y) & (F.col("chan") == chan), F.lit(float(value)))


def by_parity(px: DataFrame, odd: bool) -> DataFrame:
    """The images with odd (or even) page numbers."""
    return px.where(F.col("pag") % 2 == (1 if odd else 0))
