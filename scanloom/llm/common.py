"""What the training-data operators share: reading tables and cutting lineage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (local tests).
LOCAL_SHARED_DIR = "/tmp/checkpoints/scanloom"
#: A bitmap of words has this many longs: 128 kB whatever the number of words.
BITMAP_LONGS = 1 << 14


#: Rows of a batch that goes to Python, and its bytes unless one row has more: texts stand in it whole, so it holds few of them.
BATCH_ROWS = 1000
BATCH_BYTES = 1 << 20
#: A key on more than one in this many rows is joined by broadcast.
HOT_SHARES = 1000

_KEPT: dict[Any, Any] = {}


def worker_cache(name: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task for one operator; another operator's is dropped first."""
    if name not in _KEPT:
        _KEPT.clear()
        freed()
        _KEPT[name] = make()
        freed()
    return _KEPT[name]


def freed() -> None:
    """Give the system back what this process has freed, which allocators keep otherwise: idle workers and the JVM share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES``, which bounds what the JVM and a worker keep outside the heap.

    The settings stay, as a lazy result is computed when its caller asks for it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of ``sf_dir``, by any path that Spark can read; batches to Python are bounded from now on."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_SHARED_DIR
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read again.

    This cuts the lineage: what was written survives the loss of executors and
    is not computed anew by each later use.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` or an operator made and nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def joined(rows: DataFrame, facts: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``: one row per key, and in ``__n`` (dropped) the number of ``rows`` that bear it.

    Keys on more than one in ``HOT_SHARES`` of ``total`` rows are broadcast, and
    their rows stay where they are; only rows of other keys are shuffled. With
    ``total`` rows or fewer, fewer than ``HOT_SHARES`` keys are broadcast. Keys
    are not null. ``how`` may be "left" for rows whose key has no fact.
    """
    hot = F.col("__n") * HOT_SHARES > total
    few, many = F.broadcast(facts.where(hot).drop("__n")), facts.where(~hot).drop("__n")
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(many, on, how))


def bitmap(words: DataFrame) -> Column:
    """A foldable array of longs with the bit of each distinct ``word`` set, to ask with ``in_bitmap``."""
    slots = words.select(F.expr(f"shiftright(hash(word), 6) & {BITMAP_LONGS - 1}").alias("slot"), F.expr("hash(word) & 63").alias("bit")).distinct()
    longs = {r.slot: r.v for r in slots.groupBy("slot").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("v")).collect()}  # BITMAP_LONGS rows at most
    return F.split(F.lit(",".join(str(longs.get(k, 0)) for k in range(BITMAP_LONGS))), ",").cast("array<bigint>")


def in_bitmap(word: str, bits: str = "bits") -> str:
    """SQL: whether the bit of the expression ``word`` is set in the column ``bits``; true for every word put in."""
    return f"getbit(get({bits}, shiftright(hash({word}), 6) & {BITMAP_LONGS - 1}), hash({word}) & 63) = 1"
