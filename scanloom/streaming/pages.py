"""Structured Streaming over image files: each new page goes through a pipeline once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scanloom.functions import to_px
from scanloom.sources.pnm import read_images

FILES = "path string, modificationTime timestamp, length long, content binary"


def page_stream(spark: SparkSession, folder: str, pattern: str = "*.p[gnpa]m") -> DataFrame:
    """New files of a folder as a stream of rows."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)


def process_pages(stream: DataFrame, pipeline: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run each batch of pages through ``pipeline`` (pixels to pixels) and append its pixels as Parquet, by page.

    Operators are stateless from image to image, so the stream needs no state
    but its offsets; a batch that is repeated overwrites what it wrote.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        pipeline(to_px(read_images(batch.select("path", "content")))).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
