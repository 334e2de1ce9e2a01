"""Positional joins of images of the same size: keyed by img, chan, y and x.

Two single images are joined by giving both the same key (``keyed``). A plane
that the second image lacks leaves that of the first as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import PIXEL, colour, where_planes

PLACE = ["img", "chan", "y", "x"]


def keyed(px: DataFrame, img: int) -> DataFrame:
    """A single image under another key."""
    return px.withColumn("img", F.lit(img).cast("long"))


def combined(a: DataFrame, b: DataFrame, value: Column) -> DataFrame:
    """``a`` with ``value`` (of v and u, the other image's sample) on its colour planes."""
    other = b.where(colour()).select(*(F.col(c).alias(f"b_{c}") for c in PLACE), F.col("v").alias("u"))
    on = reduce(lambda p, q: p & q, [F.col(c) == F.col(f"b_{c}") for c in PLACE])
    return where_planes(a.join(other, on, "left"), colour() & F.col("u").isNotNull(), value).select(*a.columns)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b around 128."""
    return combined(a, b, F.col("v") - F.col("u") + 128.0)


def patch(a: DataFrame, b: DataFrame) -> DataFrame:
    """a + b around 128: undoes ``diff``."""
    return combined(a, b, F.col("v") + F.col("u") - 128.0)


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """a / b in parts of 255; white where b is 0."""
    return combined(a, b, F.when(F.col("u") != 0, F.col("v") / F.col("u") * 255.0).otherwise(255.0))


def darker(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The pointwise least of images, on the planes that the first has: one aggregation for any number of them."""
    tagged = [px.where(colour()).select(*PLACE, "pag", "w", "h", "v", F.lit(k).alias("k")) for k, px in enumerate((first, *others))]
    together = reduce(DataFrame.unionByName, tagged)
    own = F.min_by(F.struct("pag", "w", "h"), "k").alias("own")
    least = together.groupBy(*PLACE).agg(F.min("v").alias("v"), F.min("k").alias("k"), own).where(F.col("k") == 0)
    rest = first.where(~colour())
    return least.select("img", "own.pag", "own.w", "own.h", "chan", "y", "x", "v").select(*PIXEL, "v").unionByName(rest)


def darkest(px: DataFrame, img: int = 1) -> DataFrame:
    """The pointwise least of all images of a set, as one image: one pass over the set."""
    kept = [F.min(c).alias(c) for c in ("pag", "w", "h")]
    return px.where(colour()).groupBy("chan", "y", "x").agg(*kept, F.min("v").alias("v")).withColumn("img", F.lit(img).cast("long")).select(*PIXEL, "v")


def fix_background(px: DataFrame, distance: float) -> DataFrame:
    """Divide an image by its own background."""
    from scanloom.operators.scan import background

    return divide(px, background(px, distance))


def residual(guess_laplacian: DataFrame, target: DataFrame) -> DataFrame:
    """target - laplacian(guess) around 128, and 128 where the target's alpha is below 1."""
    alpha = target.where("chan = 0").select(F.col("img").alias("m_img"), F.col("y").alias("m_y"), F.col("x").alias("m_x"), F.col("v").alias("m"))
    out = combined(guess_laplacian, target, F.col("u") - F.col("v") + 128.0)
    joined = out.join(alpha, (F.col("img") == F.col("m_img")) & (F.col("y") == F.col("m_y")) & (F.col("x") == F.col("m_x")), "left")
    return where_planes(joined, colour() & (F.col("m") < 1), F.lit(128.0)).select(*out.columns)


def masked_add(guess: DataFrame, correction: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """guess + correction - 128 where the mask's alpha is at least 1 (everywhere without one)."""
    added = combined(guess, correction, F.col("v") + F.col("u") - 128.0)
    if mask is None:
        return added
    alpha = mask.where("chan = 0").select(*(F.col(c).alias(f"m_{c}") for c in ("img", "y", "x")), F.col("v").alias("m"))
    old = guess.select(*(F.col(c).alias(f"o_{c}") for c in PLACE), F.col("v").alias("old"))
    joined = added.join(alpha, (F.col("img") == F.col("m_img")) & (F.col("y") == F.col("m_y")) & (F.col("x") == F.col("m_x")), "left")
    joined = joined.join(old, reduce(lambda p, q: p & q, [F.col(c) == F.col(f"o_{c}") for c in PLACE]), "left")
    return where_planes(joined, colour() & (F.col("m") < 1), F.col("old")).select(*added.columns)
