"""Reductions: histograms, thresholds, skew."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import IMAGE, to_plane_rows

LEVELS = 256


def level(v: Column) -> Column:
    """The gray level of a sample, 0 to 255."""
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))).cast("int")


def histogram(px: DataFrame, chan: int = 1, compat: bool = False) -> DataFrame:
    """img, level, n for all 256 levels of a plane; ``compat`` counts below 0, above 1 and what lies between."""
    v = F.col("v")
    bin_ = F.when(v < 0, 0).when(v > 1, 255).otherwise(v.cast("int")) if compat else level(v)
    counts = px.where(F.col("chan") == chan).groupBy("img", bin_.alias("level")).agg(F.count("*").alias("n"))
    images = px.where(F.col("chan") == chan).select("img").distinct()
    return _dense(images, counts, ["n"])


def _dense(images: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """All levels of all images, 0 where nothing was counted."""
    every = images.select("img", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    return every.join(counts, ["img", "level"], "left").select("img", "level", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))


def edge_histograms(px: DataFrame) -> DataFrame:
    """img, level, edges, energy: running sums' steps over neighbour pairs of plane 1.

    A pair (a, b) to the right or below steps up at min(a, b) and down at
    max(a, b): by 1 (edges) and by (b - a) squared (energy). The last row and
    column begin no pair.
    """
    rows = to_plane_rows(px.where("chan = 1"))
    below = Window.partitionBy("img", "chan").orderBy("y")
    pairs = rows.withColumn("down", F.lead("row").over(below)).where("down is not null and w > 1")

    def at(x: Column) -> Column:
        a = level(F.get("row", x))
        return F.array(F.struct(a.alias("a"), level(F.get("row", x + 1)).alias("b")), F.struct(a.alias("a"), level(F.get("down", x)).alias("b")))

    one = pairs.select("img", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("w") - 2), at))).alias("p")).groupBy("img", "p.a", "p.b").agg(F.count("*").alias("n"))
    square = (F.col("b") - F.col("a")) * (F.col("b") - F.col("a")) * F.col("n")
    steps = one.select("img", F.explode(F.array(F.struct(F.least("a", "b").alias("level"), F.col("n").alias("edges"), square.alias("energy")), F.struct(F.greatest("a", "b").alias("level"), (-F.col("n")).alias("edges"), (-square).alias("energy")))).alias("s"))
    sums = steps.groupBy("img", "s.level").agg(F.sum("s.edges").alias("edges"), F.sum("s.energy").alias("energy"))
    return _dense(px.where("chan = 1").select("img").distinct(), sums, ["edges", "energy"])


def cumulative(levels: DataFrame, names: list[str]) -> DataFrame:
    """Running sums over the levels of each image."""
    over = Window.partitionBy("img").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return levels.select("img", "level", *(F.sum(n).over(over).cast("long").alias(n) for n in names))


def argmax(series: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The first place of the greatest value of each series."""
    return series.groupBy(*keys).agg(F.max(F.struct(F.col(value), (-F.col(at)).alias("neg"))).alias("m")).select(*keys, (-F.col("m.neg")).alias(at), F.col(f"m.{value}").alias(value))


def statistics(px: DataFrame) -> DataFrame:
    """Of each image: threshold t at the greatest edge energy, edges and area there, and the five derived figures.

    One pass over plane 1 counts levels and pairs of levels together; all the
    rest looks at the 256 levels of an image at most.
    """
    rows = to_plane_rows(px.where("chan = 1")).withColumn("down", F.lead("row").over(Window.partitionBy("img", "chan").orderBy("y")))

    def at(x: Column) -> Column:
        a = level(F.get("row", x))
        paired = F.col("down").isNotNull() & (x < F.col("w") - 1)
        pairs = [F.when(paired, level(F.get(*b))).otherwise(-1) for b in (("row", x + 1), ("down", x))]
        return F.array(F.struct(a.alias("a"), F.lit(-1).alias("b")), *(F.struct(a.alias("a"), b.alias("b")) for b in pairs))

    # A pair with level -1 is none: such rows count the first level of an array of three alone.
    one = rows.select("img", F.posexplode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("w") - 1), at))).alias("place", "p")).select("img", (F.col("place") % 3 == 0).alias("alone"), "p.*")
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    counted = one.where("alone or b >= 0").groupBy("img", "alone", "a", "b").agg(F.count("*").alias("n"))
    square, zero = (b - a) * (b - a) * n, F.lit(0).cast("long")

    def step(at: Column, n: Column, edges: Column, energy: Column) -> Column:
        return F.struct(at.alias("level"), n.alias("n"), edges.alias("edges"), energy.alias("energy"))

    none = step(F.lit(0), zero, zero, zero)  # every image has level 0
    steps = F.when(F.col("alone"), F.array(step(a, n, zero, zero), none)).otherwise(F.array(step(F.least("a", "b"), zero, n, square), step(F.greatest("a", "b"), zero, -n, -square)))
    levels = counted.select("img", F.explode(steps).alias("s")).groupBy("img", "s.level").agg(*(F.sum(f"s.{c}").alias(c) for c in ("n", "edges", "energy")))
    so_far, whole = Window.partitionBy("img").orderBy("level").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("img")
    sums = levels.select("img", "level", "n", *(F.sum(c).over(so_far).alias(c) for c in ("edges", "energy")))
    best = F.max(F.struct("energy", (-F.col("level")).alias("neg"), "edges")).over(whole)
    found = sums.select("img", "level", "n", (-best["neg"]).alias("t"), best["edges"].alias("edges"))
    dark = F.col("level") <= F.col("t")
    made = found.groupBy("img", "t", "edges").agg(
        F.sum(F.when(dark, n).otherwise(0)).alias("area"), F.sum(F.when(~dark, n).otherwise(0)).alias("light"),
        F.sum(F.when(dark, n * F.col("level")).otherwise(0)).alias("dark_sum"), F.sum(F.when(~dark, n * (F.col("level") - 1)).otherwise(0)).alias("light_sum"),
    )
    border = F.col("edges") * 0.8
    return made.select(
        "img", "t", "edges", "area", (F.col("t") / 255.0).alias("graythr"), F.when(border != 0, F.col("area") * 2.0 / border).alias("thickness"),
        F.when(F.col("area") > 0, F.col("dark_sum") / F.col("area") / 255.0).alias("black"), F.when(F.col("light") > 0, F.col("light_sum") / F.col("light") / 255.0).alias("white"),
    )


def gradient(px: DataFrame) -> DataFrame:
    """Rows of the absolute difference of each row of plane 1 and the next, 0 below their root mean square."""
    rows = to_plane_rows(px.where("chan = 1"))
    steps = rows.withColumn("down", F.lead("row").over(Window.partitionBy("img", "chan").orderBy("y"))).where("down is not null")
    steps = steps.select(*IMAGE, "chan", "y", F.zip_with("row", "down", lambda a, b: F.abs(a - b)).alias("row"))
    rms = steps.groupBy("img").agg(F.sqrt(F.sum(F.aggregate("row", F.lit(0.0), lambda s, t: s + t * t)) / (F.max("w") * (F.max("h") - 1))).alias("rms"))
    joined = steps.join(rms.withColumnRenamed("img", "of"), F.col("img") == F.col("of"))
    return joined.select(*IMAGE, "chan", "y", F.transform("row", lambda t: F.when(t < F.col("rms"), 0.0).otherwise(t)).alias("row"), "rms")


def gradient_rms(px: DataFrame) -> DataFrame:
    """img and the root mean square of the vertical gradient of plane 1."""
    return gradient(px).groupBy("img").agg(F.max("rms").alias("rms"))


def skew_scores(px: DataFrame, slopes: list[int]) -> DataFrame:
    """img, d, score: sums of squares of the gradient summed along lines that fall d rows over the width."""
    one = gradient(px).select("img", "w", "y", F.posexplode("row").alias("x", "t")).where("t != 0")
    tried = one.withColumn("d", F.explode(F.array(*(F.lit(int(d)) for d in slopes))))
    step = F.floor(((F.col("x") + 1) * (F.abs("d") + 1) - 1) / F.col("w")).cast("int")
    bucket = F.col("y") + F.when(F.col("d") >= 0, step).otherwise(F.col("w") - step)
    return tried.groupBy("img", "d", bucket.alias("b")).agg(F.sum("t").alias("s")).groupBy("img", "d").agg(F.sum(F.col("s") * F.col("s")).alias("score"))


def _searched(rows: pd.DataFrame) -> float:
    """The angle of one image whose gradient rows are given."""
    rows = rows.sort_values("y")
    t = np.stack(rows["row"].to_numpy())
    h, w = t.shape
    y, x = np.nonzero(t)
    weight = t[y, x]

    def score(d: int) -> float:
        step = ((x + 1) * (abs(d) + 1) - 1) // w
        sums = np.bincount(y + (step if d >= 0 else w - step), weight)
        return float(sums @ sums)

    ends = {"a": w // 10, "b": -(w // 10)}
    scores = {k: score(d) for k, d in ends.items()}
    while abs(ends["a"] - ends["b"]) > 1:
        worse, better = ("b", "a") if scores["a"] > scores["b"] else ("a", "b")
        ends[worse] = int((5 * ends[better] - 2 * ends[worse]) / 3)
        scores[worse] = score(ends[worse])
    best = ends["b"] if scores["b"] > scores["a"] else ends["a"]
    return math.degrees(math.atan((best + (best > 0) - (best < 0)) / w))


def detect_skew(px: DataFrame) -> DataFrame:
    """img and its angle in degrees: each image's bracket search is one task's work, all images side by side."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"img": [rows["img"].iloc[0]], "angle": [_searched(rows)]})

    return gradient(px).select("img", "y", "row").groupBy("img").applyInPandas(search, "img long, angle double")


def border_mean(px: DataFrame) -> DataFrame:
    """img, chan and the mean of the frame one pixel wide, of the colour planes."""
    frame = (F.col("x") == 0) | (F.col("x") == F.col("w") - 1) | (F.col("y") == 0) | (F.col("y") == F.col("h") - 1)
    return px.where(F.col("chan").between(1, 3) & frame).groupBy("img", "chan").agg(F.avg("v").alias("mean"))
