"""Quality rules: repetition counts and the divergence of a text's histograms from those of its language."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.llm.common import map_batches, materialise, slices, type_of

#: Common words of each language that the word histogram tells apart; all others share one bin.
COMMON_WORDS = 60
#: Character classes, by byte: lower case, upper case, digits, white space, plain punctuation, other ASCII; code points beyond ASCII by their first byte.
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "beyond")
#: Largest Jensen-Shannon distances (base 2, 0 to 1) from the language's reference.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.44
#: Below so many characters or words, a histogram says too little and the distance isn't judged.
MIN_CHARS, MIN_WORDS = 200, 50
#: Words that a task counts before it hands its counts on.
FLUSH = 300_000
EDGE = b".,;:!?\"'()"


def class_table() -> np.ndarray:
    """256 x len(CLASSES): which class a byte adds to; continuation bytes add to none."""
    out = np.zeros((256, len(CLASSES)))
    for byte in range(256):
        c = chr(byte)
        if byte >= 0xC0:
            k = "beyond"
        elif byte >= 0x80:
            continue
        elif c.isalpha():
            k = "lower" if c.islower() else "upper"
        else:
            k = "digit" if c.isdigit() else "space" if c in " \t\n\v\f\r" else "punctuation" if c in ".,;:!?'\"()-" else "symbol"
        out[byte, CLASSES.index(k)] = 1
    return out


CLASS_TABLE = class_table()
SYMBOLS = np.frombuffer(b"[#*$%&|<>]", np.uint8)[1:-1]
BLANK = np.array([0x20, *range(0x09, 0x0E)])


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits; 0 if either histogram is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        halves = [np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(halves) / 2)))


def word_ids(words: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    seen: dict[bytes, int] = {}
    return seen, np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in three-word windows that the text has twice or more, the first included."""
    if len(ids) < 4:
        return 0
    _, pairs = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)
    _, back, counts = np.unique(pairs * distinct + ids[2:], return_inverse=True, return_counts=True)
    hit = counts[back] > 1
    in_any = np.zeros(len(ids), bool)
    for k in range(3):
        in_any[k : k + len(hit)] |= hit
    return int(in_any.sum())


def common_form(word: bytes) -> bytes:
    """A word as the common words have it: in lower case by Unicode's rules, without the marks at its ends."""
    return (word.lower() if word.isascii() else word.decode().lower().encode()).strip(EDGE)


def references(docs: DataFrame, lang_col: str = "lang") -> dict[str, dict]:
    """For each language: the character-class histogram, and its COMMON_WORDS most frequent words with the count of all.

    Counted over all texts; tasks count their own rows, Spark adds and ranks the counts. Null texts and labels are left
    out. What reaches the driver is COMMON_WORDS words and a few numbers for each language.
    """

    def counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        chars: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES)))

        def out() -> pa.RecordBatch:
            folded: dict[str, Counter] = defaultdict(Counter)
            for label, c in words.items():
                for w, n in c.items():
                    folded[label][common_form(w)] += n
            rows = [(k, f"w{w.decode()}", n) for k, c in folded.items() for w, n in c.items()]
            rows += [(k, f"c{i}", int(n)) for k, h in chars.items() for i, n in enumerate(h)]
            words.clear()
            chars.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["label", "item", "n"])

        for rows in parts:
            for text, label in zip(rows.column("text").to_pylist(), rows.column("label").to_pylist(), strict=True):
                data = text.encode("utf-8", "replace")
                chars[label] += np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASS_TABLE
                words[label].update(data.split())
                if sum(map(len, words.values())) > FLUSH:
                    yield out()
        yield out()

    labelled = docs.select("text", F.col(lang_col).cast("string").alias("label")).where("text is not null and label is not null")
    summed = map_batches(labelled, counts, "label string, item string, n long").groupBy("label", "item").agg(F.sum("n").alias("n"))
    summed = materialise(summed, "reference-counts")  # three aggregations read it
    # A language's rows are ranked within buckets of words first, so that no task sorts a whole vocabulary.
    words = summed.where("item like 'w_%'").withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(64)))
    order = (F.desc("n"), "item")
    top = words.withColumn("r", F.row_number().over(Window.partitionBy("label", "bucket").orderBy(*order))).where(F.col("r") <= COMMON_WORDS)
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("r") <= COMMON_WORDS).select("label", "item", "n")
    all_words = summed.where("item like 'w%'").groupBy("label").agg(F.lit("t").alias("item"), F.sum("n").alias("n"))
    found: dict[str, dict] = {}
    for label, item, n in top.unionByName(all_words).unionByName(summed.where("item like 'c%'")).orderBy("label", F.desc("n"), "item").collect():
        ref = found.setdefault(label, {"chars": [0] * len(CLASSES), "words": [], "counts": [], "total": 0})
        if item[0] == "w":
            ref["words"].append(item[1:])
            ref["counts"].append(n)
        elif item[0] == "c":
            ref["chars"][int(item[1:])] = n
        else:
            ref["total"] = n
    return found


def judge_quality(docs: DataFrame, refs: dict[str, dict], id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """Counts and verdict for every whole text.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than 50 words, or more
    than half of them in repeated three-word windows), char_distance and word_distance (Jensen-Shannon, from the
    references of the row's language; for a null or unknown one, of the nearest), and kept. A distance counts against a
    text only from MIN_CHARS characters or MIN_WORDS words on. Null texts count as empty: no words, not kept. Null ids
    and repeated rows stay; other columns aren't read. Without references, only the base rules judge.
    """
    labels = sorted(refs)
    char_refs = {x: np.array(refs[x]["chars"], float) for x in labels}
    word_index = {x: {w.encode(): i for i, w in enumerate(refs[x]["words"])} for x in labels}
    word_refs = {x: np.array([*refs[x]["counts"], refs[x]["total"] - sum(refs[x]["counts"])], float) for x in labels}
    fields = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "char_distance": "double", "word_distance": "double", "kept": "boolean"}

    def one(text: str, label: str | None) -> tuple:
        data = text.encode("utf-8", "replace")
        by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        words = data.split()  # bytes.split() cuts at the six blanks of the word pattern
        seen, ids = word_ids(words)
        lines = [x for x in data.split(b"\n") if x.strip()]
        n, repeat = len(words), repeated_words(ids, len(seen))
        base_failed = n < 50 or 100 * repeat > 50 * n
        times = np.bincount(ids, minlength=len(seen))
        common: dict[bytes, int] = defaultdict(int)
        for w, k in zip(seen, times.tolist(), strict=True):
            common[common_form(w)] += k
        best = (0.0, 0.0)
        near = [label] if label in char_refs else labels
        histogram = by_byte @ CLASS_TABLE
        for i, x in enumerate(near):
            bins = np.zeros(len(word_refs[x]))
            for w, at in word_index[x].items():
                bins[at] = common.get(w, 0)
            bins[-1] = n - bins.sum()
            d = (js_distance(histogram, char_refs[x]), js_distance(bins, word_refs[x]))
            best = d if not i or sum(d) < sum(best) else best
        apart = len(text) >= MIN_CHARS and best[0] > MAX_CHAR_DISTANCE or n >= MIN_WORDS and best[1] > MAX_WORD_DISTANCE
        return n, len(text) - int(by_byte[BLANK].sum()), int(by_byte[SYMBOLS].sum()), len(lines) - len(set(lines)), repeat, base_failed, round(best[0], 9), round(best[1], 9), not (base_failed or apart)

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            texts = rows.column("text").to_pylist()
            out = [one(text or "", label) for part in slices(zip(texts, rows.column("label").to_pylist(), strict=True), (len(t or "") for t in texts)) for text, label in part]
            types = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array([r[i] for r in out], types[t]) for i, t in enumerate(fields.values()))], ["id", *fields])

    chosen = docs.select(F.col(id_col).alias("id"), "text", F.col(lang_col).cast("string").alias("label"))
    return map_batches(chosen, judge, f"id {type_of(docs, id_col)}, " + ", ".join(f"{k} {v}" for k, v in fields.items())).withColumnRenamed("id", id_col)
