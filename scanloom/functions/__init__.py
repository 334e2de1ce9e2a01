"""Scalar functions and layouts of the raster relation.

A set of images is one relation of pixels with the columns

    img LONG, pag INT, w INT, h INT, chan INT, y INT, x INT, v DOUBLE

``chan`` is 0 for alpha, 1 to 3 for gray or colour, 4 for the selection; a plane
that an image lacks has no rows. The same relation by scanline has ``row
ARRAY<DOUBLE>`` in place of x and v. Every operator takes and gives one of these,
lazily, for any number of images at once; ``img`` (and ``chan``) are the keys
that partition it. Operators that look along scanlines also take images by
scanline, as files are read, and then need not gather them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = ["img", "pag", "w", "h"]
PLANE = [*IMAGE, "chan"]
PIXEL = [*PLANE, "y", "x"]
PX_SCHEMA = "img long, pag int, w int, h int, chan int, y int, x int, v double"
ROWS_SCHEMA = "img long, pag int, w int, h int, chan int, y int, row array<double>"

ALPHA, SELECTION = 0, 4


def colour() -> Column:
    """Whether a row is of the planes 1 to 3."""
    return F.col("chan").between(1, 3)


def not_selection() -> Column:
    """Whether a row is of the planes 0 to 3."""
    return F.col("chan").between(0, 3)


def rnd(x: Column) -> Column:
    """Round half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def where_planes(px: DataFrame, planes: Column, value: Column) -> DataFrame:
    """``v`` replaced on the planes named; other planes pass."""
    return px.withColumn("v", F.when(planes, value).otherwise(F.col("v")))


def to_rows(px: DataFrame) -> DataFrame:
    """Pixels gathered to scanlines: one shuffle, by scanline. What comes by scanline passes."""
    if "row" in px.columns:
        return px.select(*PLANE, "y", "row")
    pairs = F.sort_array(F.collect_list(F.struct("x", "v")))
    return px.groupBy(*PLANE, "y").agg(pairs.alias("p")).select(*PLANE, "y", F.transform("p", lambda s: s["v"]).alias("row"))


def to_plane_rows(px: DataFrame) -> DataFrame:
    """Scanlines, each plane's in one partition: for windows over a plane's scanlines, which then need no shuffle of their own."""
    return to_rows(px.repartition("img", "chan"))


def to_px(rows: DataFrame) -> DataFrame:
    """Scanlines spread to pixels, without a shuffle. Pixels pass."""
    if "row" not in rows.columns:
        return rows.select(*PIXEL, "v")
    return rows.select(*PLANE, "y", F.posexplode("row").alias("x", "v"))


def map_rows(px: DataFrame, work: Callable[[np.ndarray, pd.DataFrame], np.ndarray], planes: Column | None = None) -> DataFrame:
    """Scanlines changed by numpy: ``work(samples, keys)`` gets scanlines of one length as a matrix, and their keys (img to y).

    Any new width goes. Scanlines are independent, so nothing is gathered but
    pixels to scanlines; on other planes than ``planes`` they pass.
    """
    rows = to_rows(px)
    asked = rows if planes is None else rows.where(planes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby("w"):
                made = work(np.stack(part["row"].to_numpy()).astype(float), part[[*PLANE, "y"]])
                yield part.assign(row=list(made), w=made.shape[1])

    out = to_px(asked.mapInPandas(run, ROWS_SCHEMA))
    return out if planes is None else out.unionByName(to_px(rows.where(~planes)))


def sized(rows: DataFrame, w: Column | str = "w", h: Column | str = "h") -> DataFrame:
    """The columns of a relation in order, with a new size."""
    w, h = (F.col(c) if isinstance(c, str) else c for c in (w, h))
    last = [c for c in ("y", "x", "v", "row") if c in rows.columns]
    return rows.select("img", "pag", w.cast("int").alias("w"), h.cast("int").alias("h"), "chan", *last)
