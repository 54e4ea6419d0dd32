"""Image sequences: times and file names first, pixels last and only for rows that are left.

Pixels are a column that is computed from the path, so filters on time and choices of columns go below it in the plan: a
file that no row of the result needs is never opened. Joins stay above it: leave `image` out before a join and add
decoded("file") after it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType

from trailmark.sources.readers import _number, _raising

#: Fixed: names of the column with a frame's path, first match wins; PNG's signature and its colour types' channels.
PATH_COLUMNS = ("path", "image_path", "frame_path")
SIGNATURE, CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Fixed: weights of red, green and blue, and the same in 14 bits.
LUMA, LUMA_BITS = (0.299, 0.587, 0.114), (4899, 9617, 1868)
IMAGE = StructType().add("height", "integer").add("width", "integer").add("channels", "integer").add("pixels", "binary")


def image_times(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """t, rel_path, problem of a table of frames. Times must be numbers; with strict=False bad ones have a problem instead.
    The file's own column `path` wins over where it was read from."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    name = next((c for c in PATH_COLUMNS if c in rows.columns), None)
    if name is None:
        raise ValueError(f"{path} has no column for an image's path: {', '.join(PATH_COLUMNS)}")
    named = rows.withColumnRenamed(name, "rel_path").withColumn("path", F.input_file_name())
    value, problem = _number(named, "t")
    return _raising(named.select("path", value.alias("t"), "rel_path", problem.alias("problem")), strict).drop("path")


def listing(spark: SparkSession, root: str, glob: str = "*.png") -> DataFrame:
    """file, rel_path (below root), length of the files there, without their contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    place = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    at = F.instr("path", place)
    return found.select(F.col("path").alias("file"), F.expr(f"substring(path, instr(path, '{place}') + {len(place)})").alias("rel_path"), "length").where(at > 0)


def scan_images(spark: SparkSession, root: str, times: DataFrame | None = None, glob: str = "*.png", strict: bool = True) -> DataFrame:
    """t, rel_path, file, length, image of a sequence's frames; image is decoded only where it is used.

    times: t and rel_path (see image_times). Without it, files are frames 0, 1, 2, ... by name; that numbering sorts the
    names in one task, as they are one order. A frame whose file is missing raises, or with strict=False has a null file
    and image. Files that no time names are left out. A file that can't be decoded raises when its image is used.
    """
    files = listing(spark, root, glob)
    if times is None:
        frames = files.withColumn("t", (F.row_number().over(Window.orderBy("rel_path")) - 1).cast("double"))
    else:
        frames = times.select("t", "rel_path").join(files, "rel_path", "left")
        if strict:
            missing = F.raise_error(F.concat(F.lit("no such image frame: "), "rel_path")).cast("string")
            frames = frames.withColumn("file", F.coalesce("file", missing))
    return frames.select("t", "rel_path", "file", "length", decoded("file").alias("image"))


def read_file(path: str) -> bytes:
    """A file's bytes from any store that Arrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if ":" not in path.split("/")[0]:
        store, place = fs.LocalFileSystem(), path
    else:
        store, place = fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    with store.open_input_stream(place) as stream:
        return stream.read()


@pandas_udf(IMAGE)
def decoded(paths: pd.Series) -> pd.DataFrame:
    """Height, width, channels and pixels (rows of bytes) of PNG files; null for a null path."""
    out = []
    for path in paths:
        if path is None or path != path:
            out.append((None, None, None, None))
            continue
        try:
            image = decode_png(read_file(path))
        except (ValueError, zlib.error, struct.error) as problem:
            raise ValueError(f"{path}: {problem}") from problem
        out.append((*image.shape, image.tobytes()))
    return pd.DataFrame(out, columns=["height", "width", "channels", "pixels"], dtype=object)


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG's bytes: gray, RGB, palette (as RGB) or either with alpha, of 8 or 16 bits (the
    upper 8 are kept), not interlaced. Checksums aren't verified, but the pixels must be all there."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG file")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("a PNG without a head")
    width, height, depth, colour, _, _, interlaced = head
    if depth not in (8, 16) or colour not in CHANNELS or interlaced:
        raise ValueError(f"a PNG of {depth} bits, colour type {colour}{', interlaced' * bool(interlaced)} isn't read")
    size = CHANNELS[colour] * depth // 8
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(rows) != height * (1 + width * size):
        raise ValueError(f"{len(rows)} bytes of pixels, expected {height * (1 + width * size)}")
    rows = rows.reshape(height, 1 + width * size)
    pixels = unfiltered(rows[:, 0], rows[:, 1:].reshape(height, width, size))
    if depth == 16:
        pixels = pixels[:, :, ::2]
    if colour == 3:
        if palette is None or pixels.max(initial=0) >= len(palette):
            raise ValueError("a PNG with a palette too small")
        pixels = palette[pixels[:, :, 0]]
    return np.ascontiguousarray(pixels)


def unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pixels (height, width, bytes) from what each row's filter left of them (0 none, 1 left, 2 above, 3 their mean, 4 the
    nearest of left, above and above left to their plane).

    A pixel needs those to its left and above, so all on one slanted line are made at once."""
    if kinds.max(initial=0) > 4:
        raise ValueError(f"unknown filter {kinds.max()}")
    height, width, size = rows.shape
    if not kinds.any():
        return rows
    made = np.zeros((height + 1, width + 1, size), np.int32)
    for line in range(height + width - 1):
        y = np.arange(max(0, line - width + 1), min(height, line + 1))
        x, kind = line - y, kinds[y][:, None]
        left, above, slant = made[y + 1, x], made[y, x + 1], made[y, x]
        plane = left + above - slant
        far = [np.abs(plane - v) for v in (left, above, slant)]
        nearest = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, slant))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) // 2, nearest], 0)
        made[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return made[1:, 1:].astype(np.uint8)


def gray(image: Column, rule: str = "luma") -> Column:
    """array<double> of a frame's cells, row by row, as one of three rules has them: `luma`, weighted red, green and blue
    cut to whole numbers; `luma_rounded`, the same in 14-bit arithmetic, rounded; `mean` of the channels, by 255 where a
    value is over 1, from 0 to 1. Frames of one channel keep it (but for that scale); alpha counts in the mean only."""
    if rule not in ("luma", "luma_rounded", "mean"):
        raise ValueError(f"unknown rule {rule}")

    @pandas_udf("array<double>")
    def run(channels: pd.Series, pixels: pd.Series) -> pd.Series:
        out = [None if p is None else gray_cells(np.frombuffer(p, np.uint8).reshape(-1, int(n)), rule).tolist() for n, p in zip(channels, pixels, strict=True)]
        return pd.Series(out, dtype=object)

    return run(image["channels"], image["pixels"])


def gray_cells(cells: np.ndarray, rule: str) -> np.ndarray:
    """Cells (n, channels) of bytes as doubles (n)."""
    if rule == "mean":
        mean = cells.mean(axis=1)
        return np.clip(mean / 255.0 if mean.max(initial=0) > 1 else mean, 0.0, 1.0)
    if cells.shape[1] < 3:
        return cells[:, 0].astype(float)
    if rule == "luma":
        return np.floor(np.clip(cells[:, :3].astype(float) @ np.array(LUMA), 0, 255))
    return ((cells[:, :3].astype(np.int64) @ np.array(LUMA_BITS) + (1 << 13)) >> 14).astype(float)
