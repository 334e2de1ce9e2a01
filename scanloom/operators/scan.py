"""Stencils and scans: windows over scanlines, columns and vectors.

A vector relation has the columns vec_id LONG, i INT, v DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import PLANE, colour, not_selection, rnd, to_plane_rows, to_px, to_rows, where_planes


def along():
    """A vector, in order."""
    return Window.partitionBy("vec_id").orderBy("i")


def along_x():
    """A scanline, in order."""
    return Window.partitionBy("img", "chan", "y").orderBy("x")


def along_y():
    """A column, in order."""
    return Window.partitionBy("img", "chan", "x").orderBy("y")


def rows_down():
    """The scanlines of a plane, in order."""
    return Window.partitionBy("img", "chan").orderBy("y")


def so_far(window):
    """All up to and with the current row."""
    return window.rowsBetween(Window.unboundedPreceding, 0)


def from_here(window):
    """The current row and all after it."""
    return window.rowsBetween(0, Window.unboundedFollowing)


def cumul(vec: DataFrame) -> DataFrame:
    """Running sums."""
    return vec.withColumn("v", F.sum("v").over(so_far(along())))


def diff_vector(vec: DataFrame, lag: int = 1, compat: bool = False) -> DataFrame:
    """Differences from ``lag`` places before; the first ``lag`` values stay. ``compat`` looks one place back whatever the lag."""
    return vec.withColumn("v", F.when(F.col("i") >= lag, F.col("v") - F.lag("v", 1 if compat else lag).over(along())).otherwise(F.col("v")))


def convolve_vector(vec: DataFrame, a: float, b: float, c: float, border: bool = False) -> DataFrame:
    """a, b and c times the value before, at and after; ends stay, or with ``border`` are scaled by a + b + c."""
    before, after, v = F.lag("v").over(along()), F.lead("v").over(along()), F.col("v")
    return vec.withColumn("v", F.coalesce(a * before + b * v + c * after, v * (a + b + c) if border else v))


def mean_y(px: DataFrame, d: int) -> DataFrame:
    """Moving mean of d rows of plane 1; rows too near an edge stay."""
    if d < 1:
        raise ValueError("the mean needs at least one row")
    after = d // 2
    mean = F.avg("v").over(along_y().rowsBetween(-(d - 1 - after), after))
    return where_planes(px, (F.col("chan") == 1) & (F.col("y") + after).between(d, F.col("h") - 1), mean)


def _rows_apply(px: DataFrame, planes: Column, cell) -> DataFrame:
    """Cells of the planes from the row above, their own and the one below: one shuffle, by plane."""
    rows = to_plane_rows(px.where(planes)).withColumns({"up": F.lag("row").over(rows_down()), "down": F.lead("row").over(rows_down())})
    made = rows.select(*PLANE, "y", F.transform(F.sequence(F.lit(0), F.col("w") - 1), cell).alias("row"))
    return to_px(made).unionByName(to_px(px.where(~planes)))


def convolve_3x3(px: DataFrame, a: float, b: float, c: float, d: float) -> DataFrame:
    """a the centre, b left and right, c above and below, d the corners; the frame stays."""

    def cell(x: Column) -> Column:
        def near(name: str, k: int) -> Column:
            return F.get(name, x + k)

        centre = near("row", 0)
        total = a * centre + b * (near("row", -1) + near("row", 1)) + c * (near("up", 0) + near("down", 0)) + d * (near("up", -1) + near("up", 1) + near("down", -1) + near("down", 1))
        return F.coalesce(total, centre)  # null where a neighbour is missing

    return _rows_apply(px, colour(), cell)


def laplacian(px: DataFrame, k: float = -0.25) -> DataFrame:
    """128 + k times the sum of each axis' neighbours less twice the centre.

    An axis counts only where both its neighbours are there and opaque (alpha
    of 255). A masked centre with a usable axis gives null, one without 128.
    """
    alpha = to_rows(px.where("chan = 0")).select(F.col("img").alias("a_img"), F.col("y").alias("a_y"), F.col("row").alias("alpha"))
    rows = to_rows(px.where(colour())).join(alpha, (F.col("img") == F.col("a_img")) & (F.col("y") == F.col("a_y")), "left")
    masked = F.transform("row", lambda v, x: F.when(F.coalesce(F.get("alpha", x), F.lit(255.0)) >= 255, v))
    rows = rows.withColumn("row", masked).withColumns({"up": F.lag("row").over(rows_down()), "down": F.lead("row").over(rows_down())})

    def cell(x: Column) -> Column:
        centre = F.get("row", x)
        across, along = F.get("row", x - 1) + F.get("row", x + 1), F.get("up", x) + F.get("down", x)
        value = 128.0 + k * (F.coalesce(across - 2 * centre, F.lit(0.0)) + F.coalesce(along - 2 * centre, F.lit(0.0)))
        return F.when(centre.isNotNull() | (across.isNull() & along.isNull()), value)

    made = rows.select(*PLANE, "y", F.transform(F.sequence(F.lit(0), F.col("w") - 1), cell).alias("row"))
    return to_px(made).unionByName(to_px(px.where(~colour())))


def dither_cumulative(px: DataFrame, step: float) -> DataFrame:
    """Dither so that every rectangle from the corner keeps its sum to half a step: differences of the rounded integral image."""
    part = px.where(not_selection()).withColumn("s", F.sum(F.col("v") / float(step)).over(so_far(along_x())))
    part = part.withColumn("s", rnd(F.sum("s").over(so_far(along_y()))))
    part = part.withColumn("s", F.col("s") - F.coalesce(F.lag("s").over(along_y()), F.lit(0.0)))
    part = part.withColumn("v", (F.col("s") - F.coalesce(F.lag("s").over(along_x()), F.lit(0.0))) * float(step))
    return part.drop("s").unionByName(px.where(~not_selection()))


def background(px: DataFrame, distance: float) -> DataFrame:
    """The maximum that decays by exp(-0.333 / distance) per pixel, of the colour planes.

    Running maxima of logarithms: left and right, then down (rounded), then up.
    Negative samples count as 0.
    """
    rate = 0.333 / float(distance)

    def running(value: Column, place: str, window, sign: int) -> Column:
        slope = F.col(place) * (sign * rate)
        log = F.when(value > 0, F.log(F.when(value > 0, value)) + slope)
        return F.coalesce(F.exp(F.max(log).over(window) - slope), F.lit(0.0))

    v = F.greatest(F.col("v"), F.lit(0.0))
    across = px.where(colour()).withColumn("b", F.greatest(running(v, "x", so_far(along_x()), 1), running(v, "x", from_here(along_x()), -1)))
    down = across.withColumn("b", running(F.col("b"), "y", so_far(along_y()), 1))
    down = down.withColumn("b", F.when(F.col("y") == F.col("h") - 1, F.col("b")).otherwise(rnd(F.col("b"))))
    up = down.withColumn("v", rnd(running(F.col("b"), "y", from_here(along_y()), -1))).drop("b")
    return up.unionByName(px.where(~colour()))


def find_margin(vec: DataFrame, width: int) -> DataFrame:
    """vec_id and the middle of the best margin of each profile.

    On log(v + 1), what lies above half-way between the mean and the mean of
    what is below it is forbidden. Elsewhere a place is worth its distance to
    the run's left end less that to its right end; a margin's score is the
    worth of its left edge less that of its right edge. The first best score's
    plateau is halved.
    """
    whole = Window.partitionBy("vec_id")
    p = vec.withColumn("p", F.log(F.col("v") + 1)).withColumn("n", F.count("*").over(whole)).withColumn("mean", F.avg("p").over(whole))
    p = p.withColumn("bound", (F.col("mean") + F.avg(F.when(F.col("p") <= F.col("mean"), F.col("p"))).over(whole)) / 2).withColumn("bad", F.col("p") > F.col("bound"))
    last_bad = F.coalesce(F.max(F.when(F.col("bad"), F.col("i"))).over(so_far(along())), F.lit(-1))
    back = Window.partitionBy("vec_id").orderBy(F.col("i").desc())
    next_bad = F.coalesce(F.min(F.when(F.col("bad"), F.col("i"))).over(so_far(back)), F.col("n").cast("int"))
    worth = F.when(~F.col("bad"), (F.col("i") - last_bad) - (next_bad - F.col("i"))).otherwise(F.col("n") + 1)
    p = p.withColumn("worth", worth.cast("long"))
    far, far_bad = F.lead("worth", width + 1).over(along()), F.lead("bad", width + 1).over(along())
    p = p.withColumn("score", F.when(~F.col("bad") & ~far_bad, F.col("worth") - far)).withColumn("final", F.coalesce("score", "worth"))
    best = p.groupBy("vec_id").agg(F.max(F.struct("score", (-F.col("i")).alias("neg"))).alias("m"), F.max("n").alias("n")).where(F.col("m.score").isNotNull() & (F.col("m.score") > -F.col("n")))
    best = best.select(F.col("vec_id").alias("of"), F.col("m.score").alias("t"), (-F.col("m.neg")).alias("j"))
    after = p.join(best, F.col("vec_id") == F.col("of")).where((F.col("i") > F.col("j")))
    end = after.groupBy("vec_id", "j").agg(F.min(F.when(F.col("final") != F.col("t"), F.col("i"))).alias("end"), F.max("i").alias("last"))
    found = end.select("vec_id", F.floor((F.col("j") + F.coalesce("end", F.col("last") + 1)) / 2).cast("int").alias("margin"))
    return vec.select("vec_id").distinct().join(found, "vec_id", "left").select("vec_id", F.coalesce("margin", F.lit(0)).alias("margin"))


def poisson_vector(target: DataFrame, nlap: DataFrame) -> DataFrame:
    """The vector with the target's ends and 2 u[i] - u[i-1] - u[i+1] = nlap[i-1]: two running sums and a ramp."""
    ends = target.groupBy("vec_id").agg(F.min_by("v", "i").alias("first"), F.max_by("v", "i").alias("last"), F.count("*").alias("n"))
    once = nlap.withColumn("c", F.sum("v").over(so_far(along())))
    twice = once.withColumn("c", F.sum("c").over(so_far(along()))).select("vec_id", (F.col("i") + 2).alias("i"), F.col("c"))
    bent = target.join(twice, ["vec_id", "i"], "left").join(ends, "vec_id").withColumn("u", F.col("first") - F.coalesce("c", F.lit(0.0)))
    ramp = (F.col("last") - F.last("u").over(along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) / (F.col("n") - 1)
    return bent.select("vec_id", "i", (F.col("u") + F.col("i") * F.when(F.col("n") > 1, ramp).otherwise(0.0)).alias("v"))
