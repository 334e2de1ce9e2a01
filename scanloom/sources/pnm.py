"""PNM and PAM files, page numbers and vector text.

Files come as Spark's ``binaryFile`` rows and are decoded on the executors. A
decoded plane stays one binary until scanlines are asked for.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import IMAGE, PLANE, ROWS_SCHEMA, to_rows

#: Tuple types of PAM files and their depths.
TUPLE_TYPES = {"GRAYSCALE": 1, "GRAYSCALE_ALPHA": 2, "RGB": 3, "RGB_ALPHA": 4}
#: Colour types of PNG files by depth.
PNG_TYPES = {1: 0, 2: 4, 3: 2, 4: 6}
#: Page numbers are smaller.
PAGES = 10_000
#: Planes in file order, by depth.
FILE_PLANES = {1: (1,), 2: (1, 0), 3: (1, 2, 3), 4: (1, 2, 3, 0)}


def _token(data: bytes, at: int) -> tuple[str, int]:
    """The next header token and the place of the byte after it; comments run from # to the line's end."""
    while at < len(data):
        if data[at : at + 1].isspace():
            at += 1
        elif data[at : at + 1] == b"#":
            stop = data.find(b"\n", at)
            at = len(data) if stop < 0 else stop
        else:
            break
    end = at
    while end < len(data) and not data[end : end + 1].isspace() and data[end : end + 1] != b"#":
        end += 1
    if end == at:
        raise ValueError("the header ends early")
    return data[at:end].decode("latin-1"), end


def decode(data: bytes) -> dict[int, np.ndarray]:
    """Planes of a P5, P6 or P7 file with a greatest value of 255."""
    kind, at = _token(data, 0)
    head: dict[str, str] = {}
    if kind in ("P5", "P6"):
        for name in ("WIDTH", "HEIGHT", "MAXVAL"):
            head[name], at = _token(data, at)
        depth = 1 if kind == "P5" else 3
    elif kind == "P7":
        while True:
            name, at = _token(data, at)
            if name == "ENDHDR":
                break
            head[name], at = _token(data, at)
        depth = TUPLE_TYPES.get(head.get("TUPLTYPE", ""), int(head.get("DEPTH", 0)))
    else:
        raise ValueError(f"{kind} is not supported")
    w, h = int(head["WIDTH"]), int(head["HEIGHT"])
    if int(head["MAXVAL"]) != 255 or depth not in FILE_PLANES or w < 1 or h < 1:
        raise ValueError("the header is not supported")
    at += 1  # one white space
    if len(data) - at < w * h * depth:
        raise ValueError("the file ends early")
    samples = np.frombuffer(data, np.uint8, w * h * depth, at).reshape(h, w, depth)
    return {c: samples[:, :, k].astype(float) for k, c in enumerate(FILE_PLANES[depth])}


def encode(planes: dict[int, np.ndarray]) -> bytes:
    """A P5, P6 or P7 file of the planes 0 to 3; samples are clamped, then cut to whole numbers."""
    depth = sum(c in planes for c in range(4))
    order = FILE_PLANES[depth]
    if any(c not in planes for c in order):
        raise ValueError("the planes are neither gray nor colour")
    h, w = planes[order[0]].shape
    samples = np.stack([np.clip(np.nan_to_num(planes[c]), 0, 255).astype(np.uint8) for c in order], axis=-1)
    if depth % 2:
        head = f"P{5 if depth == 1 else 6}\n{w} {h}\n255\n"
    else:
        kind = next(k for k, d in TUPLE_TYPES.items() if d == depth)
        head = f"P7\nWIDTH {w}\nHEIGHT {h}\nDEPTH {depth}\nMAXVAL 255\nTUPLTYPE {kind}\nENDHDR\n"
    return head.encode() + samples.tobytes()


def encode_png(planes: dict[int, np.ndarray]) -> bytes:
    """A PNG file of the planes 0 to 3, with samples as in ``encode``."""
    depth = sum(c in planes for c in range(4))
    samples = np.stack([np.clip(np.nan_to_num(planes[c]), 0, 255).astype(np.uint8) for c in FILE_PLANES[depth]], axis=-1)
    h, w, _ = samples.shape
    lines = np.zeros((h, 1 + w * depth), np.uint8)  # each line begins with its filter: none
    lines[:, 1:] = samples.reshape(h, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, PNG_TYPES[depth], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def page_number(path: Column) -> Column:
    """The first run of digits before a point that is not all zeros; else the digits at the end; else 0."""
    before, last = F.regexp_extract(path, r"([0-9]*[1-9][0-9]*)\.", 1), F.regexp_extract(path, "([0-9]+)$", 1)
    return F.coalesce(F.when(before != "", before.try_cast("int")), F.when(last != "", last.try_cast("int")), F.lit(0))


def _page(path: Column) -> Column:
    """The page number of a file's own name; an error if it is too large."""
    n = page_number(F.element_at(F.split(path, "/"), -1))
    return F.when(n < PAGES, n).otherwise(F.raise_error(F.concat(F.lit("page number too large: "), path)).cast("int"))


def read_images(files: DataFrame) -> DataFrame:
    """Scanlines of PNM and PAM files given as rows of path and content; img is a hash of the path."""
    keyed = files.select(F.xxhash64("path").alias("img"), _page(F.col("path")).alias("pag"), "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch.itertuples():
                for chan, plane in decode(bytes(one.content)).items():
                    h, w = plane.shape
                    yield pd.DataFrame({"img": one.img, "pag": one.pag, "w": w, "h": h, "chan": chan, "y": range(h), "row": list(plane)})

    return keyed.mapInPandas(rows, ROWS_SCHEMA)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Scanlines of all images under a path or pattern; JPEG and PNG go through Spark's own decoder."""
    if path.lower().endswith((".jpg", ".jpeg", ".png")):
        return from_spark_images(spark.read.format("image").load(path))
    return read_images(spark.read.format("binaryFile").load(path).select("path", "content"))


def from_spark_images(images: DataFrame) -> DataFrame:
    """Scanlines of the rows of Spark's image source, whose samples stand in the order blue, green, red, alpha."""
    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    keyed = flat.select(F.xxhash64("origin").alias("img"), _page(F.col("origin")).alias("pag"), "height", "width", "nChannels", "data")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch.itertuples():
                samples = np.frombuffer(bytes(one.data), np.uint8).reshape(one.height, one.width, one.nChannels).astype(float)
                for k, chan in enumerate((1,) if one.nChannels == 1 else (3, 2, 1, 0)[: one.nChannels]):
                    yield pd.DataFrame({"img": one.img, "pag": one.pag, "w": one.width, "h": one.height, "chan": chan, "y": range(one.height), "row": list(samples[:, :, k])})

    return keyed.mapInPandas(rows, ROWS_SCHEMA)


def encoded(px: DataFrame, png: bool = False) -> DataFrame:
    """img, pag and content: each image as the bytes of a PNM or PAM file, or of a PNG file."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("y")
        planes = {int(c): np.stack(g["row"].to_numpy()) for c, g in rows.groupby("chan")}
        return pd.DataFrame({"img": [rows["img"].iloc[0]], "pag": [rows["pag"].iloc[0]], "content": [encode_png(planes) if png else encode(planes)]})

    rows = to_rows(px.where("chan between 0 and 3")).select(*IMAGE, "chan", "y", "row")
    return rows.groupBy("img").applyInPandas(run, "img long, pag int, content binary")


def write_file(path: str, content: bytes) -> None:
    """Write a file under a passing name and move it to its own."""
    if ":/" in path:
        files, name = pyarrow.fs.FileSystem.from_uri(path)
    else:
        files, name = pyarrow.fs.LocalFileSystem(), os.path.abspath(path)
    passing = f"{name}.{os.getpid()}.part"
    with files.open_output_stream(passing) as f:
        f.write(content)
    files.move(passing, name)


def write_images(px: DataFrame, template: str) -> DataFrame:
    """img and path of files written from the executors, each named by the template and its page (``p%03d.pgm``).

    A template with a scheme (``hdfs://``, ``s3://``, ``gs://``, ``file:``) is
    written through Arrow's file system of that scheme, one without as a local
    path. A file appears under its name when it is whole, so a task that is run
    again changes nothing. JPEG files need a codec that is not here.
    """
    if template.lower().endswith((".jpg", ".jpeg")):
        raise ValueError("JPEG files can be read, not written")
    named = encoded(px, template.lower().endswith(".png")).withColumn("path", F.format_string(template, "pag") if "%" in template else F.lit(template))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch.itertuples():
                write_file(one.path, bytes(one.content))
            yield batch[["img", "path"]]

    return named.mapInPandas(run, "img long, path string")


def sample_bytes(px: DataFrame) -> DataFrame:
    """What a file holds of each sample: clamped to 0 to 255 and cut to a whole number."""
    return px.select(*PLANE, "y", "x", F.least(F.greatest(F.col("v"), F.lit(0.0)), F.lit(255.0)).cast("int").alias("sample"))


def vector_text(vec: DataFrame) -> DataFrame:
    """Lines of index and value with six decimals."""
    return vec.select("vec_id", "i", F.format_string("%d %f", "i", "v").alias("line"))


def write_vector(vec: DataFrame, path: str) -> None:
    """The lines of vectors as text files, in order of vector and index."""
    vector_text(vec).orderBy("vec_id", "i").select("line").write.text(path)
