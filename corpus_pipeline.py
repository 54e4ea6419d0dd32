"""The corpus pipeline: language ID, line dedup, near duplicates, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and
reads it again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import bpe, decontaminate, jaccard_join, langid, line_dedup
from trailmark.llm.common import materialise, remove, table, tracked, type_of


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of documents: those without a letter or far from every prototype go, as do null texts."""
    profiles = langid.fit_profiles(langid.training_rows(docs))
    # The verdict travels with its row, so that repeated and null ids need no join, and beside it, so that no name clashes.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return langid.with_language(rows, profiles).where(~langid.is_rejected(F.col("language"))).select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines are cut; documents with nothing left but such lines go. What a copy has from its
    original stays, for the next stage to group copies on their texts."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")
    cut = line_dedup.dedup_lines(rows, spare_copies=True).where("n_removed = 0 or trim(text) <> ''")
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(type_of(docs, "n_chars"))
    made = {"text": F.col("text"), "n_chars": length}
    return cut.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' number and digest, and that of the decoded bytes, for each document."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, limits=bpe.BESIDE)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: SQL can't express language ID by random vectors; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote on its way, and its predecessor's rows, go once its own are written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with tracked() as made:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        remove(spark, [*made[:-1], *before])  # the last path is the stage's own
        before = made[-1:]
    return docs
