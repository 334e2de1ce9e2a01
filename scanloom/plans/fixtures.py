"""Rasters and vectors derived from the star-schema tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.functions import PIXEL

W, H = 64, 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def places(spark: SparkSession, w: int, h: int) -> DataFrame:
    """Every place of a grid."""
    return spark.range(h).select(F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x"))


def as_image(df: DataFrame, w: int | Column, h: int | Column, img: int | Column = 1, pag: int | Column = 1) -> DataFrame:
    """chan, y, x and v as pixels of one image."""
    made = {"img": img, "pag": pag, "w": w, "h": h}
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in made.items()}).select(
        F.col("img").cast("long").alias("img"), *(F.col(c).cast("int").alias(c) for c in PIXEL[1:]), F.col("v").cast("double").alias("v")
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the line items of each place of F1 and F3: added up before they meet the grid."""
    place = (F.col("l_orderkey") % H).cast("int").alias("y"), (F.col("l_partkey") % W).cast("int").alias("x")
    sums = table(spark, sf_dir, "lineitem").groupBy(*place).agg(F.sum("l_quantity").cast("long").alias("q"), F.sum(F.round(F.col("l_discount") * 100)).cast("long").alias("d"), F.count("*").alias("n"))
    return places(spark, W, H).join(sums, ["y", "x"], "left").select("y", "x", *(F.coalesce(c, F.lit(0)).alias(c) for c in "qdn"))


def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 x 48 gray."""
    return as_image(_items(spark, sf_dir).withColumns({"chan": F.lit(1), "v": F.col("q") % 256}), W, H)


def f2(spark: SparkSession, sf_dir: str, w: int = 64) -> DataFrame:
    """A tall image of the embeddings, one row each."""
    e = table(spark, sf_dir, "embeddings")
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 256 * F.col("e").cast("double"))))
    px = e.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e")).where(F.col("x") < w).select(F.lit(1).alias("chan"), "y", "x", v.alias("v"))
    height = e.agg((F.max("vec_id") + 1).alias("rows"))
    return as_image(px.crossJoin(F.broadcast(height)), w, F.col("rows"))  # one row


def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 x 48 colour with alpha."""
    alpha = F.when((F.col("x") * 7 + F.col("y") * 3) % 11 == 0, 0).otherwise(255)
    planes = [(0, alpha), (1, F.col("q") % 256), (2, F.col("d") * 5 % 256), (3, F.col("n") * 17 % 256)]
    spread = F.explode(F.array(*(F.struct(F.lit(c).alias("chan"), v.cast("double").alias("v")) for c, v in planes)))
    return as_image(_items(spark, sf_dir).select("y", "x", spread.alias("p")).select("y", "x", "p.*"), W, H)


def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages of 60 x 48 gray, one per kind of event."""
    e = table(spark, sf_dir, "events")
    x = (F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")) * 2 + F.floor(F.hour("ts") / 12)).cast("int")
    sums = e.groupBy("event_type", (F.col("user_id") % 48).cast("int").alias("y"), x.alias("x")).agg(F.sum(F.round(F.col("value") * 100)).cast("long").alias("s"))
    page = sums.select("event_type").distinct().withColumn("pag", F.row_number().over(Window.orderBy("event_type")))  # one row per kind
    dense = page.crossJoin(places(spark, 60, 48)).join(sums, ["event_type", "y", "x"], "left")  # one row per kind
    return as_image(dense.select("pag", F.lit(1).alias("chan"), "y", "x", (F.coalesce("s", F.lit(0)) % 256).alias("v")), 60, 48, F.col("pag"), F.col("pag"))


def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector: events per day."""
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("int")
    return table(spark, sf_dir, "events").groupBy(day.alias("i")).agg(F.count("*").cast("double").alias("v")).select(F.lit(1).cast("long").alias("vec_id"), "i", "v")


def f7(spark: SparkSession) -> DataFrame:
    """A soft selection of 64 x 48."""
    inside = F.col("y").between(8, 31)
    v = F.when(F.col("x").between(10, 29) & inside, 1.0).when(F.col("x").between(30, 39) & inside, 0.5).otherwise(0.0)
    return as_image(places(spark, W, H).select(F.lit(4).alias("chan"), "y", "x", v.alias("v")), W, H)


def _grid(w: int, h: int) -> str:
    return f"(select x, y from (select unnest(range({w})) x) a cross join (select unnest(range({h})) y) b)"


_DAY = "date_diff('day', date '2024-01-01', cast(e.ts as date))"
#: The same in DuckDB, as common table expressions that a query may use.
SQL = {
    "f1": f"select 1 as chan, g.y, g.x, cast(coalesce(cast(sum(l.l_quantity) as bigint), 0) % 256 as double) v from {_grid(W, H)} g left join lineitem l on l.l_partkey % 64 = g.x and l.l_orderkey % 48 = g.y group by g.y, g.x",
    "f2": "select 1 as chan, vec_id as y, x, cast(least(255, greatest(0, floor(128 + 256 * cast(e as double)))) as double) v from (select vec_id, unnest(range(len(embedding))) x, unnest(embedding) e from embeddings)",
    "f3w": f"select g.y, g.x, coalesce(cast(sum(l.l_quantity) as bigint), 0) % 256 c1, coalesce(cast(sum(round(l.l_discount * 100)) as bigint), 0) * 5 % 256 c2, count(l.l_orderkey) * 17 % 256 c3, case when (g.x * 7 + g.y * 3) % 11 = 0 then 0 else 255 end c0 from {_grid(W, H)} g left join lineitem l on l.l_partkey % 64 = g.x and l.l_orderkey % 48 = g.y group by g.y, g.x",
    "f3": "select * from (" + " union all ".join(f"select {c} as chan, y, x, cast(c{c} as double) v from f3w" for c in range(4)) + ")",
    "f4": f"select p.pag, 1 as chan, g.y, g.x, cast(coalesce(cast(sum(round(e.value * 100)) as bigint), 0) % 256 as double) v from (select event_type, row_number() over (order by event_type) pag from (select distinct event_type from events)) p cross join {_grid(60, 48)} g left join events e on e.event_type = p.event_type and e.user_id % 48 = g.y and cast({_DAY} * 2 + floor(hour(e.ts) / 12) as int) = g.x group by p.pag, g.y, g.x",
    "f5": f"select cast({_DAY} as integer) i, cast(count(*) as double) v from events e group by 1",
    "f7": f"select 4 as chan, g.y, g.x, cast(case when g.x between 10 and 29 and g.y between 8 and 31 then 1.0 when g.x between 30 and 39 and g.y between 8 and 31 then 0.5 else 0.0 end as double) v from {_grid(W, H)} g",
}
