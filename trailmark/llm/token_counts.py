"""Token counts with a digest cache: only texts whose digest the cache lacks are encoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import map_batches, slices
from trailmark.llm.tokens import ChunkCache, piece_chunks, piece_model

CACHE_SCHEMA = "digest string, version string, n_tokens long"


def file_version(path: str) -> str:
    """Digest of a tokenizer file; a change of vocabulary makes older counts void."""
    import hashlib

    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()[:32]


def count_pieces(texts: DataFrame, model_path: str, version: str) -> DataFrame:
    """digest, version, n_tokens for digest, text by the sentencepiece library."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, by_words = piece_model(model_path)

        def lengths(chunks: list[str]) -> dict[str, int]:
            return dict(zip(chunks, map(len, model.encode(chunks, num_threads=1)), strict=True))

        cache = ChunkCache(lengths)
        for rows in parts:
            out: list[int] = []
            texts = rows.column("text").to_pylist()
            for part in slices(texts, map(len, texts)):
                chunked = [piece_chunks(t) if by_words else None for t in part]
                known = cache.get([c for c in chunked if c is not None])
                out += [len(model.encode(t, num_threads=1)) if c is None else sum(map(known.__getitem__, c)) for t, c in zip(part, chunked, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("digest"), pa.array([version] * len(out), pa.string()), pa.array(out, pa.int64())], ["digest", "version", "n_tokens"])

    return map_batches(texts.select("digest", "text"), count, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, model_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """Tokens of every whole text, looked up in the cache at cache_path, which is made or appended to.

    Content is normalised to the text's UTF-8 bytes with null as empty (anything more would change counts) and known by
    its SHA-256 and the tokenizer file's digest. Distinct misses are encoded once and appended; the counts are then all
    joined from the cache. Returns id, n_bytes, n_tokens and over_limit (n_tokens > limit), one row for each row of docs,
    repeated and null ids included; no rows: no rows. A digest that several writers appended counts once.
    """
    spark = docs.sparkSession
    version = file_version(model_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col(id_col), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    spark.createDataFrame([], CACHE_SCHEMA).coalesce(1).write.mode("append").parquet(cache_path)  # so that it can be read
    store = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    old = store.where(F.col("version") == version)
    misses = keyed.select("digest", "text").join(old, "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    count_pieces(misses, model_path, version).write.mode("append").parquet(cache_path)
    # A digest counts once, should several writers have appended it.
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    found = keyed.drop("text").join(counts.select("digest", "n_tokens"), "digest")
    return found.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
