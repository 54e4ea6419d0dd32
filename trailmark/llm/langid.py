"""Language ID by hyperdimensional profiles: permuted random letter vectors bound into n-gram vectors and bundled."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import crc_mod, map_batches, slices, small_batches

DIMENSIONS = 512
SEED = 20_240_501
#: A text of so many letter trigrams and a smaller cosine to every prototype is in none of the languages: prototypes of
#: different languages have cosines up to 0.19, texts of fifty trigrams 0.2 or more with their own language's.
MIN_TRIGRAMS, MIN_SCORE = 50, 0.2
#: Characters of each text piece that is counted at once; a longer text is summed over its pieces.
PIECE = 1_000_000
#: Texts, and trigrams, whose counts and vectors are multiplied at once: what a task holds doesn't grow with its texts.
TEXTS_AT_ONCE, TRIGRAMS_AT_ONCE = 256, 8192


@cache
def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@cache
def letter_vector(code: int) -> np.ndarray:
    """A random vector of +1 and -1 that the code point alone determines; 0 stands for what is between words."""
    return np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """First letter permuted twice, second once, third as it is; bound by multiplication."""
    bound = None
    for turns, letters in ((2, codes >> 42), (1, codes >> 21 & 0x1FFFFF), (0, codes & 0x1FFFFF)):
        distinct, which = np.unique(letters, return_inverse=True)
        vectors = np.roll(np.stack([letter_vector(c) for c in distinct.tolist()]), turns, axis=1)[which]
        bound = vectors if bound is None else bound * vectors
    return bound


def bundle(counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum of the trigram vectors, each as often as it is counted, for each (sorted trigrams, counts)."""
    out = np.zeros((len(counted), DIMENSIONS))
    codes = np.unique(np.concatenate([c for c, _ in counted])) if counted else np.empty(0, np.int64)
    for at in range(0, len(codes), TRIGRAMS_AT_ONCE):
        part = codes[at : at + TRIGRAMS_AT_ONCE]
        dense = np.zeros((len(counted), len(part)), np.float32)
        for i, (c, n) in enumerate(counted):
            low, high = np.searchsorted(c, [part[0], part[-1] + 1])
            dense[i, np.searchsorted(part, c[low:high])] = n[low:high]
        out += dense @ trigram_vectors(part).astype(np.float32)
    return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of the lower-cased text and their counts; each run between words is one mark."""
    all_codes, all_counts = [], []
    for at in range(0, len(text), PIECE):
        symbols = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letters = letter_table()[symbols]
        if not letters.any():
            continue
        symbols[~letters] = 0
        symbols = np.concatenate([[0], symbols, [0]])
        symbols = symbols[(symbols != 0) | np.concatenate([[True], symbols[:-1] != 0])]
        code = symbols[:-2] << 42 | symbols[1:-1] << 21 | symbols[2:]
        codes, counts = np.unique(code[symbols[1:-1] != 0], return_counts=True)
        all_codes.append(codes)
        all_counts.append(counts)
    if len(all_codes) < 2:
        return (all_codes[0], all_counts[0]) if all_codes else (np.empty(0, np.int64), np.empty(0, np.int64))
    codes, back = np.unique(np.concatenate(all_codes), return_inverse=True)
    return codes, np.bincount(back, np.concatenate(all_counts)).astype(np.int64)


def batches(rows: pa.RecordBatch, *columns: str) -> Iterator[list[tuple]]:
    texts = rows.column("text").to_pylist()
    for part in slices(zip(texts, *(rows.column(c).to_pylist() for c in columns), strict=True), (len(t or "") for t in texts), 400_000):
        for at in range(0, len(part), TEXTS_AT_ONCE):
            yield part[at : at + TEXTS_AT_ONCE]


def fit_profiles(docs: DataFrame, lang_col: str = "lang") -> dict[str, list[int]]:
    """Language prototypes: the bundle of the trigram vectors of all texts with that label.

    Bundling is a sum, so each task sums its own rows and Spark adds the sums: nothing but one vector of DIMENSIONS
    whole numbers for each language reaches the driver. Rows with a null text or label are left out; no rows: no profiles.
    """

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(DIMENSIONS))
        for rows in parts:
            for part in batches(rows, "label"):
                by = defaultdict(list)
                for text, label in part:
                    by[label].append(trigrams(text))
                for label, counted in by.items():
                    codes, back = np.unique(np.concatenate([c for c, _ in counted]), return_inverse=True)
                    if len(codes):
                        total[label] += bundle([(codes, np.bincount(back, np.concatenate([n for _, n in counted])))])[0]
        labels = list(total)
        yield pa.RecordBatch.from_pydict({
            "label": pa.array([x for x in labels for _ in range(DIMENSIONS)], pa.string()),
            "dim": pa.array(np.tile(np.arange(DIMENSIONS), len(labels)), pa.int32()),
            "value": pa.array(np.concatenate([np.rint(total[x]).astype(np.int64) for x in labels]) if labels else [], pa.int64()),
        })

    labelled = docs.select("text", F.col(lang_col).cast("string").alias("label")).where("text is not null and label is not null")
    summed = map_batches(labelled, sums, "label string, dim int, value long").groupBy("label", "dim").agg(F.sum("value").alias("value"))
    found: dict[str, list[int]] = {}
    for label, dims in summed.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("dims")).collect():
        found[label] = [x.value for x in dims]
    return dict(sorted(found.items()))


def with_language(docs: DataFrame, profiles: dict[str, list[int]], into: str = "language") -> DataFrame:
    """All rows and columns of docs (text among them) with a struct `into` of lang_pred, score, margin and n_trigrams.

    Only texts go to Python, and only verdicts come back. A column of docs that is named as `into` gives way.
    """
    labels = list(profiles)
    prototypes = np.array([profiles[x] for x in labels], np.float64).reshape(len(labels), DIMENSIONS)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)

    def judge(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            out = []
            for part in batches(pa.record_batch([texts], ["text"])):
                counted = [trigrams(text or "") for (text,) in part]
                vectors = bundle(counted)
                cosines = vectors @ prototypes.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                for (codes, counts), cosine in zip(counted, np.round(cosines, 9), strict=True):
                    if not len(codes) or not labels:
                        out.append(("und", 0.0, 0.0, int(counts.sum())))
                        continue
                    best = int(cosine.argmax())
                    rest = max(np.delete(cosine, best), default=0.0)
                    out.append((labels[best], min(1.0, max(0.0, float(cosine[best]))), float(cosine[best] - rest), int(counts.sum())))
            types = (pa.string(), pa.float64(), pa.float64(), pa.int64())
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["lang_pred", "score", "margin", "n_trigrams"])

    # Non-deterministic in name, so that a filter on the verdict doesn't have it computed twice.
    verdict = F.arrow_udf(judge, "struct<lang_pred:string,score:double,margin:double,n_trigrams:bigint>").asNondeterministic()
    small_batches(docs.sparkSession)
    return docs.withColumn(into, verdict("text"))


def is_rejected(language: Column) -> Column:
    """Whether a verdict says that a text is in none of the languages: no letter, or MIN_TRIGRAMS or more that are nearer
    than MIN_SCORE to no prototype. Shorter texts say too little to be rejected by their score."""
    return (language["lang_pred"] == "und") | ((language["n_trigrams"] >= MIN_TRIGRAMS) & (language["score"] < MIN_SCORE))


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id") -> DataFrame:
    """The prototype with the largest cosine to each text's own bundle.

    Returns one row for each row: id, lang_pred, score (that cosine, cut to 0..1) and margin over the next language.
    `und` with score 0 for a null text, one without a letter, or when there are no profiles; equal cosines: the first
    label in order. Null ids and repeated rows are kept as they are; other columns are not read.
    """
    found = with_language(docs.select(F.col(id_col).alias("id"), "text"), profiles)
    return found.select(F.col("id").alias(id_col), "language.lang_pred", "language.score", "language.margin")


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that may be learnt from: those whose crc32(doc_id as text) mod 4 is not 2."""
    return docs.where(crc_mod("doc_id", 4) != 2)
