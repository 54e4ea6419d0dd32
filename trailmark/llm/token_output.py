"""Token-ID output: ORC files with run-length encoded ids, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import map_batches, slices, type_of
from trailmark.llm.tokens import ChunkCache, WordEncoder

END_ID = 1
#: Stripes are read in parallel; the row index of each stride and the Bloom filters let a reader skip them.
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20), "orc.compress": "ZSTD", "orc.encoding.strategy": "SPEED",
}


@cache
def worker_encoder(path: str) -> tuple[WordEncoder, ChunkCache]:
    """One encoder with its bounded caches for each Python worker, which runs one task after another."""
    encoder = WordEncoder(path)
    return encoder, ChunkCache(encoder.chunks)


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id") -> None:
    """Encode every whole text and write ORC files whose rows ascend by document id from file to file.

    Columns: part and row (place in the order), doc_id, local_start (ids of the part's earlier rows), ids (with END_ID
    at the end). Null texts count as empty, so each row has an id at least. Null ids come first; equal ids stay
    together, ordered by a hash of the text. No rows: a file without rows. Rows are dealt by ranges of id and text hash,
    so a repeated id with many texts is split.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    dealt = keyed.repartitionByRange(F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
    dealt = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kept = worker_encoder(tokenizer_path)
        start, row, end = 0, 0, encoder.pack([END_ID])
        for rows in parts:
            texts, at = rows.column("text").to_pylist(), 0
            for part in slices(texts, map(len, texts)):
                chunked = [t.split(" ") for t in part]
                known = kept.get(chunked)
                packed = []
                for t, c in zip(part, chunked, strict=True):
                    try:
                        packed.append(b"".join(map(known.__getitem__, c)) + end)
                    except TypeError:  # a chunk that isn't plain: None
                        packed.append(encoder.whole([t])[0] + end)
                sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32()))
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("part").slice(at, n), pa.array(np.arange(row, row + n), pa.int64()), rows.column("doc_id").slice(at, n), pa.array(start + offsets[:-1], pa.int64()), ids],
                    ["part", "row", "doc_id", "local_start", "ids"],
                )
                at, row, start = at + n, row + n, start + int(offsets[-1])

    made = map_batches(dealt, encode, f"part int, row long, doc_id {type_of(docs, id_col)}, local_start long, ids array<int>")
    made.write.options(**ORC_OPTIONS).orc(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all rows before it), n_tokens, ids_crc32, from the files alone.

    A part's offset is the sum of the parts before it: one number for each part, however many rows it has.
    """
    files = spark.read.orc(path)

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            ids = rows.column("ids")
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("part"), rows.column("doc_id"), rows.column("local_start"), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    read = map_batches(files.select("part", "doc_id", "local_start", "ids"), sums, f"part int, doc_id {type_of(files, 'doc_id')}, local_start long, n_tokens long, ids_crc32 long")
    totals = files.groupBy("part").agg(F.max(F.col("local_start") + F.size("ids")).alias("total"))
    before, offset = 0, {}
    for part, total in sorted(totals.collect()):
        offset[part] = before
        before += total
    offsets = spark.createDataFrame(sorted(offset.items()), "part int, before long")  # one row for each part
    return read.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The rows of some documents; ORC's row indexes and Bloom filters on doc_id skip what can't have them."""
    return spark.read.orc(path).where(F.col("doc_id").isin(ids)).select("doc_id", "ids")
