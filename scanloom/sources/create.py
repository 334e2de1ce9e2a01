"""New images and vectors, and passing between the two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import PIXEL, PLANE, sized

#: Planes of an image by depth: alpha comes first where the depth is even.
DEPTH_PLANES = {1: (1,), 2: (0, 1), 3: (1, 2, 3), 4: (0, 1, 2, 3)}


def new_image(spark: SparkSession, depth: int, w: int, h: int, img: int = 0) -> DataFrame:
    """An image of zeros."""
    if depth not in DEPTH_PLANES or w < 1 or h < 1:
        raise ValueError("an image has 1 to 4 planes and at least one pixel")
    planes = F.explode(F.array(*(F.lit(c) for c in DEPTH_PLANES[depth])))
    rows = spark.range(h).select(F.lit(img).cast("long").alias("img"), F.lit(0).alias("pag"), F.lit(w).alias("w"), F.lit(h).alias("h"), planes.alias("chan"), F.col("id").cast("int").alias("y"))
    return rows.select(*PLANE, "y", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x"), F.lit(0.0).alias("v"))


def clone_shape(px: DataFrame, depth: int = 0, w: int = 0, h: int = 0) -> DataFrame:
    """Images of zeros with the keys of others; a depth or size below 1 is theirs."""
    if depth > 4:
        raise ValueError("an image has 1 to 4 planes")
    own = px.where("chan < 4").groupBy("img", "pag", "w", "h").agg(F.collect_set("chan").alias("planes"))
    planes = F.array(*(F.lit(c) for c in DEPTH_PLANES[depth])) if depth >= 1 else F.col("planes")
    named = sized(own.select("img", "pag", F.lit(w).alias("w") if w >= 1 else F.col("w"), F.lit(h).alias("h") if h >= 1 else F.col("h"), F.explode(planes).alias("chan")))
    rows = named.select(*PLANE, F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    return rows.select(*PLANE, "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"), F.lit(0.0).alias("v"))


def new_vector(spark: SparkSession, n: int, vec_id: int = 0) -> DataFrame:
    """A vector of zeros."""
    return spark.range(n).select(F.lit(vec_id).cast("long").alias("vec_id"), F.col("id").cast("int").alias("i"), F.lit(0.0).alias("v"))


def clear_vector(vec: DataFrame) -> DataFrame:
    """A vector's places with zeros."""
    return vec.withColumn("v", F.lit(0.0))


def import_row(px: DataFrame, chan: int, y: int) -> DataFrame:
    """A scanline as a vector."""
    return px.where((F.col("chan") == chan) & (F.col("y") == y)).select(F.col("img").alias("vec_id"), F.col("x").alias("i"), "v")


def import_column(px: DataFrame, chan: int, x: int) -> DataFrame:
    """A column as a vector."""
    return px.where((F.col("chan") == chan) & (F.col("x") == x)).select(F.col("img").alias("vec_id"), F.col("y").alias("i"), "v")


def _export(px: DataFrame, vec: DataFrame, chan: int, line: str, at: int, place: str) -> DataFrame:
    v = vec.select(F.col("vec_id").alias("of"), F.col("i").alias("at"), F.col("v").alias("u"))
    on = (F.col("img") == F.col("of")) & (F.col(place) == F.col("at")) & (F.col(line) == at) & (F.col("chan") == chan)
    return px.join(v, on, "left").select(*PIXEL, F.coalesce("u", "v").alias("v"))


def export_row(px: DataFrame, vec: DataFrame, chan: int, y: int) -> DataFrame:
    """A vector written over a scanline."""
    return _export(px, vec, chan, "y", y, "x")


def export_column(px: DataFrame, vec: DataFrame, chan: int, x: int) -> DataFrame:
    """A vector written over a column."""
    return _export(px, vec, chan, "x", x, "y")
