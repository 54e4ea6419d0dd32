"""Helpers that several operators share: tables, the shared folder, text slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of what is none of space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch that goes to Python; a longer row is alone.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a local one is set if the
    master is local, too; on a cluster executors would not see each other's files there, so that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trailmark-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def tracked() -> Iterator[list[str]]:
    """Collects the paths that scratch() gives within, so that they can be removed when nothing reads them any more."""
    token = _made.set([])
    try:
        yield _made.get()
    finally:
        _made.reset(token)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python by bytes, unless the session has a bound of its own below Spark's default:
    ten thousand long texts would not fit a small executor beside its Python workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64m") in ("64m", "67108864b", "67108864"):
        spark.conf.set(name, str(BATCH_BYTES))


def map_batches(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """mapInArrow in small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, so that lost executors cost no more than the tasks they ran."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def slices(items: Iterable, sizes: Iterable[int], most: int = 2_000_000) -> Iterator[list]:
    """Consecutive items in lists of about `most` characters; a longer item is alone."""
    out, total = [], 0
    for item, size in zip(items, sizes, strict=True):
        if out and total + size > most:
            yield out
            out, total = [], 0
        out.append(item)
        total += size
    if out:
        yield out


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a frame of narrow rows has at most so many, found without reading more than that."""
    return df.limit(rows + 1).count() <= rows
