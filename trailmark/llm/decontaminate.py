"""Benchmark decontamination: latent semantic retrieval by a randomised SVD of TF-IDF passages, then exact checks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import map_batches, slices, type_of

#: Words of a passage and the step between passages: every run of SPAN - STEP words lies whole in one of them.
SPAN, STEP = 64, 32
#: Latent dimensions, and how many more the range finder samples.
RANK, OVERSAMPLE = 64, 8
#: Words in more than MAX_SHARE of all passages, but MIN_PASSAGES at least, are stop words and no terms; a passage or
#: part of an item with fewer than MIN_TERMS different terms has no place in the latent space.
MAX_SHARE, MIN_PASSAGES, MIN_TERMS = 0.01, 100, 3
#: A part of an item with fewer different terms than this (as copies make all words of an item stop words) is searched by
#: its words too: passages with MIN_LCS_WITH_ANSWER of its different words are candidates.
ENOUGH_TERMS = 5
#: A passage of at least so large a cosine with a part of an item, that has this share of the part's terms, is a candidate;
#: so is one of a high cosine with a smaller share.
MIN_COSINE, MIN_SHARED = 0.3, 0.5
HIGH_COSINE, LOW_SHARED = 0.6, 0.3
#: Words at the start of an item by which word-for-word copies are found.
HEAD = 8
#: Share of an item's words that the longest common subsequence must have: alone, or with the answer found.
MIN_LCS, MIN_LCS_WITH_ANSWER = 0.8, 0.55
#: Share of the answer's words that must follow each other in the window, and the fewest words of an item that is
#: searched for paraphrases; shorter ones are found word for word only.
MIN_ANSWER, MIN_WORDS = 0.8, 5
#: Items whose words and vectors go to the tasks at once; a larger benchmark is searched in blocks.
ITEM_BLOCK = 4096
SEED = 11
EDGE = b".,;:!?\"'()|*#$%&<>"
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def tokens(text: str) -> list[bytes]:
    """Lower-cased words without outer punctuation; words of punctuation alone are left out."""
    return [w for x in text.lower().encode("utf-8", "replace").split() if (w := x.strip(EDGE))]


def answer_words(text: str) -> list[list[bytes]]:
    """The answers that an item may ask for: its last sentence of three words or more, or else its last eight words; and
    where that is more than half of the item, also its last half: eight words at most, five at least."""
    words = tokens(text)
    found = next((f for x in reversed(SENTENCE.split(text)) if len(f := tokens(x)) >= 3), words[-8:])
    return [found] if 2 * len(found) <= len(words) else [found, words[-max(5, min(8, len(words) // 2)) :]]


class Benchmark:
    """Items as lists of word numbers. Words that no item has get number 0, which is in no term."""

    def __init__(self, items: list[tuple]) -> None:
        self.ids, texts = [x[0] for x in items], [x[1] or "" for x in items]
        words = [tokens(t) for t in texts]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.words = [np.array([self.number[w] for w in ws], np.int64) for ws in words]
        self.answers = [[[self.number[w] for w in a] for a in answer_words(t)] for t in texts]
        self.size = len(self.number) + 1

        # Word-for-word copies: items by their first words, HEAD of them or as many as there are, and by the first two.
        self.heads: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for k, w in enumerate(self.words):
            if len(w):
                self.heads.setdefault(min(HEAD, len(w)), {}).setdefault(tuple(w[:HEAD].tolist()), []).append(k)
        self.begins = np.zeros(self.size, bool)
        self.begins[[w[0] for w in self.words if len(w)]] = True
        self.pairs = np.unique(np.array([w[0] * self.size + w[1] for w in self.words if len(w) > 1], np.int64))

    def numbers(self, text: str) -> np.ndarray:
        """The benchmark's words of a text, in order, by number; words of punctuation alone are left out."""
        get, words = self.number.get, text.lower().encode("utf-8", "replace").split()
        found = np.fromiter((get(w) or (get(s, 0) if (s := w.strip(EDGE)) else -1) for w in words), np.int64, len(words))
        return found[found >= 0] if len(found) and found.min() < 0 else found

    def copies(self, numbers: np.ndarray) -> set[int]:
        """Items that these words hold word for word, however short or frequent."""
        out: set[int] = set()
        starts = np.flatnonzero(self.begins[numbers])
        if not len(starts):
            return out
        if len(self.pairs):  # of the places where an item's first word is, those where its second follows
            after = np.append(numbers, -1)[starts + 1]
            pair = numbers[starts] * self.size + after
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            begun = starts[(self.pairs[at] == pair) & (after >= 0)]
        else:
            begun = starts[:0]
        for size, heads in self.heads.items():
            for start in (starts if size == 1 else begun).tolist():
                for k in heads.get(tuple(numbers[start : start + size].tolist()), ()):
                    if k not in out and np.array_equal(numbers[start : start + len(self.words[k])], self.words[k]):
                        out.add(k)
        return out


class Passages:
    """Counts of terms in the passages of some texts, as arrays: passage and term (sorted by both), count.

    `of` and `first` tell each passage's text and first word; passages are numbered from 0.
    """

    def __init__(self, numbered: list[np.ndarray], terms: np.ndarray, step: int) -> None:
        size, n_terms = np.array([len(n) for n in numbered]), len(terms)
        many = np.maximum(1, -(-(size - (SPAN - step)) // step))
        before = np.cumsum(many) - many
        text = np.repeat(np.arange(len(numbered)), size)
        word = np.concatenate(numbered)
        place = np.arange(len(word)) - (np.cumsum(size) - size)[text]
        term = terms[word]
        word, text, place = word[term], text[term], place[term]
        keys = []
        for back in range(SPAN // step):
            k = place // step - back
            there = (k >= 0) & (k < many[text])
            keys.append((before[text[there]] + k[there]) * n_terms + word[there])
        key, self.count = np.unique(np.concatenate(keys), return_counts=True)
        self.passage, self.term = key // n_terms, key % n_terms
        self.many = int(many.sum())
        self.of = np.repeat(np.arange(len(numbered)), many)
        self.first = (np.arange(self.many) - before[self.of]) * step

    def weighted(self, idf: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """TF-IDF rows of length 1 for passages with `least` terms: passages, and row, term, value of what isn't 0."""
        enough = (np.bincount(self.passage, minlength=self.many) >= least)[self.passage]
        found, row = np.unique(self.passage[enough], return_inverse=True)
        value = np.log1p(self.count[enough]) * idf[self.term[enough]]
        length = np.sqrt(np.bincount(row, value * value, minlength=len(found)))
        return found, row, self.term[enough], (value / np.maximum(length[row], 1e-12)).astype(np.float32)


def sums_by(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the runs of equal numbers in row, which is sorted."""
    return np.add.reduceat(values, np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), axis=0)


def summed(docs: DataFrame, benchmark: Benchmark, terms: np.ndarray, columns: int, add) -> np.ndarray:
    """The sum over all passages, which here don't overlap, of a matrix with a row for each term.

    Each task adds up its own, Spark adds the tasks' rows, and the driver gets one matrix of fixed shape.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((benchmark.size, columns))
        for rows in parts:
            texts = rows.column("text").to_pylist()
            for part in slices(texts, map(len, texts), 1_000_000):
                add(Passages([benchmark.numbers(t) for t in part], terms, SPAN), total)
        used = np.flatnonzero(total.any(axis=1))
        offsets = pa.array(np.arange(len(used) + 1) * columns, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(total[used].ravel()))], ["row", "part"])

    sums = map_batches(docs.select("text"), run, "row int, part array<double>")
    sums = sums.groupBy("row").agg(*[F.sum(F.col("part")[k]).alias(f"c{k}") for k in range(columns)])
    out = np.zeros((benchmark.size, columns))
    for row, *values in sums.collect():
        out[row] = values
    return out


def latent_space(docs: DataFrame, benchmark: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(idf, X): the weights of the terms, 0 for stop words, and the map to the latent space.

    Randomised SVD of A, the TF-IDF matrix of the corpus's passages by the benchmark's terms: tasks sum Z = A'(A G) for
    an orthonormal random G; Z and G'Z give the leading right singular vectors V and values s without another pass
    (the Nystrom form). X = V / s, so that rare directions, which tell items apart, weigh as much as common ones. A is
    never held, and what reaches the driver has a row for each word of the benchmark's block.
    """
    words = np.arange(benchmark.size) > 0

    def frequencies(passages: Passages, total: np.ndarray) -> None:
        total[:, 0] += np.bincount(passages.term, minlength=benchmark.size)
        total[0, 1] += passages.many

    found = summed(docs, benchmark, words, 2, frequencies)
    n = found[0, 1]
    terms = words & (found[:, 0] <= max(MAX_SHARE * n, MIN_PASSAGES))
    idf = np.where(terms, np.log((n + 1) / (found[:, 0] + 1)) + 0.01, 0)
    size = min(RANK + OVERSAMPLE, benchmark.size)
    sample = np.linalg.qr(np.random.default_rng(SEED).standard_normal((benchmark.size, size)))[0].astype(np.float32)

    def sketch(passages: Passages, total: np.ndarray) -> None:
        found, row, term, value = passages.weighted(idf, MIN_TERMS)
        if not len(found):
            return
        projected = sums_by(row, value[:, None] * sample[term])
        order = np.argsort(term, kind="stable")
        total[np.unique(term)] += sums_by(term[order], value[order, None] * projected[row[order]])

    z = summed(docs, benchmark, terms, size, sketch)
    shift = np.sqrt(benchmark.size) * np.finfo(np.float32).eps * max(np.linalg.norm(z), 1e-9)
    z = z + shift * sample
    inner = sample.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, shift))
    left, singular, _ = np.linalg.svd(z @ root, full_matrices=False)
    return idf, (left[:, :RANK] / np.maximum(singular[:RANK], 1e-6 * max(singular[0], 1e-9))).astype(np.float32)


def latent(passages: Passages, idf: np.ndarray, space: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Passages with `least` terms and their unit vectors in the latent space."""
    found, row, term, value = passages.weighted(idf, least)
    if not len(found):
        return found, np.zeros((0, space.shape[1]), np.float32)
    out = sums_by(row, value[:, None] * space[term])
    return found, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def common_subsequence(item: np.ndarray, window: np.ndarray) -> int:
    """Length of the longest common subsequence, with the item's places as bits of one number."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in window.tolist():
        if m := places.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return len(item) - row.bit_count()


def longest_run(answer: list[int], window: list[int]) -> int:
    """Most words of the answer that follow each other in the window without a break."""
    best, before = 0, {}
    for w in window:
        now = {}
        for i, a in enumerate(answer):
            if a == w:
                now[i] = before.get(i - 1, 0) + 1
                best = max(best, now[i])
        before = now
    return best


def search_block(docs: DataFrame, items: list[tuple], id_col: str) -> DataFrame:
    """id, text_key (SHA-256 of the text), item, cosine, lcs for the items of one block."""
    benchmark = Benchmark(items)
    used = [k for k, w in enumerate(benchmark.words) if len(w) >= MIN_WORDS]
    schema = f"id {type_of(docs, 'id')}, text_key binary, item long, cosine double, lcs double"
    idf, space = latent_space(docs, benchmark)
    # Long items are searched by their parts, so that a part is about as long as what a passage surely holds.
    width = SPAN - STEP
    parts = [(k, benchmark.words[k][at : at + width]) for k in used for at in range(0, max(1, len(benchmark.words[k]) - width // 2), width)]
    which, queries = latent(Passages([p for _, p in parts], idf > 0, SPAN), idf, space, MIN_TERMS) if parts else (np.zeros(0, np.int64), np.zeros((0, space.shape[1]), np.float32))
    owner = np.array([parts[q][0] for q in which], np.int64)
    asked = [{*parts[q][1][idf[parts[q][1]] > 0].tolist()} for q in which]
    distinct = [np.unique(p) for _, p in parts]
    # Parts of few terms: the words of each, and which of the words that any of them has.
    few = [q for q, words in enumerate(distinct) if np.count_nonzero(idf[words] > 0) < ENOUGH_TERMS]
    few_words = np.unique(np.concatenate([distinct[q] for q in few])) if few else np.zeros(0, np.int64)
    is_few, few_at = np.zeros(benchmark.size, bool), np.zeros(benchmark.size, np.int64)
    is_few[few_words], few_at[few_words] = True, np.arange(len(few_words))
    few_has = np.zeros((len(few_words), len(few)), np.float32)
    for c, q in enumerate(few):
        few_has[few_at[distinct[q]], c] = 1

    def by_words(numbered: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """text, first word, part: passages that have enough of the words of a part of few terms."""
        passages = Passages(numbered, is_few, STEP)
        at_once = max(1, 4_000_000 // len(few_words))
        for a in range(0, passages.many, at_once):
            low, high = np.searchsorted(passages.passage, [a, a + at_once])
            has = np.zeros((min(at_once, passages.many - a), len(few_words)), np.float32)
            has[passages.passage[low:high] - a, few_at[passages.term[low:high]]] = 1
            share = (has @ few_has) / few_has.sum(axis=0)
            for r, c in np.argwhere(share >= MIN_LCS_WITH_ANSWER).tolist():
                yield int(passages.of[a + r]), int(passages.first[a + r]), few[c]

    def judge(numbers: np.ndarray, k: int, at: int) -> float | None:
        """Whether the words around a passage hold the item: its share of common words in order, or None."""
        item = benchmark.words[k]
        margin = len(item)
        near = numbers[max(0, at - margin) : at + SPAN + margin]
        near = near[near > 0]
        share = common_subsequence(item, near) / len(item)
        if share < MIN_LCS_WITH_ANSWER:
            return None
        # The words must lie together: within a window of the item's length and half as much again.
        width, best = len(item) + len(item) // 2 + 2, 0.0
        for start in range(0, max(1, len(near) - width + 1 + len(item) // 4), max(1, len(item) // 4)):
            best = max(best, common_subsequence(item, near[start : start + width]) / len(item))
        if best >= MIN_LCS:
            return best
        found = best >= MIN_LCS_WITH_ANSWER and any(longest_run(a, near.tolist()) >= MIN_ANSWER * len(a) for a in benchmark.answers[k])
        return best if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, texts, out = rows.column("id").to_pylist(), rows.column("text").to_pylist(), []
            for part in slices(zip(ids, texts, strict=True), (len(t or "") for t in texts), 500_000):
                numbered, keys = [(i, benchmark.numbers(t or "")) for i, t in part], {}
                passages = Passages([n for _, n in numbered], idf > 0, STEP)
                found, vectors = latent(passages, idf, space, MIN_TERMS)
                edges = np.searchsorted(passages.passage, [found, found + 1]).T.tolist()
                best: dict[tuple[int, int], tuple[float, float | None]] = {}
                for a in range(0, len(found), 1024):
                    cosines = vectors[a : a + 1024] @ queries.T
                    tried: set[tuple[int, int]] = set()
                    for r, q in np.argwhere(cosines >= MIN_COSINE).tolist():
                        k, (low, high) = int(owner[q]), edges[a + r]
                        least = LOW_SHARED if cosines[r, q] >= HIGH_COSINE else MIN_SHARED
                        if (r, k) in tried or len(asked[q].intersection(passages.term[low:high].tolist())) < least * len(asked[q]):
                            continue
                        tried.add((r, k))
                        d = int(passages.of[found[a + r]])
                        lcs = judge(numbered[d][1], k, int(passages.first[found[a + r]]))
                        if lcs is not None and (lcs, float(cosines[r, q])) > best.get((d, k), (0.0, 0.0)):
                            best[d, k] = (lcs, float(cosines[r, q]))
                judged: set[tuple[int, int, int]] = set()
                for d, at, q in by_words([n for _, n in numbered]) if few else ():
                    k = parts[q][0]
                    if (d, k, at) in judged or best.get((d, k), (0.0, None))[0] == 1.0:
                        continue
                    judged.add((d, k, at))
                    lcs = judge(numbered[d][1], k, at)
                    if lcs is not None and lcs > best.get((d, k), (0.0, None))[0]:
                        best[d, k] = (lcs, None)
                for d, (_, n) in enumerate(numbered):
                    for k in benchmark.copies(n):
                        best[d, k] = (1.0, best.get((d, k), (0.0, None))[1])
                for d, _ in best:
                    keys[d] = keys.get(d) or hashlib.sha256((part[d][1] or "").encode("utf-8", "replace")).digest()
                out += [(numbered[d][0], keys[d], k, c, s) for (d, k), (s, c) in best.items()]
            types = (rows.schema.field("id").type, pa.binary(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["id", "text_key", "item", "cosine", "lcs"])

    return map_batches(docs, run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """Documents that hold benchmark items: id, item_id, cosine, lcs, one row for each pair; see keyed_leaks()."""
    return keyed_leaks(docs, benchmark, id_col, item_col).drop("text_key")


def keyed_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """Documents that hold benchmark items, word for word or paraphrased: id, text_key, item_id, cosine, lcs, one row
    for each pair. text_key is the SHA-256 of the text, as ids may repeat or be null.

    Every passage of every whole text is projected into the latent space and compared with all items (a stated query
    set); candidates are confirmed where the longest common subsequence with the item has MIN_LCS of its words close
    together, or MIN_LCS_WITH_ANSWER of them and the item's answer (its last sentence) stands nearby.

    Null texts and ids: a null text has no passage, a null id stays. Items that a text holds word for word (but for case,
    outer punctuation and white space) are found by the hash of their first words, whatever their length and however
    many documents hold them. Paraphrases of items of fewer than MIN_WORDS words are not searched, as chance would find
    them; null and wordless items neither. Where a part has fewer than ENOUGH_TERMS terms, as in an item that many
    documents hold, its words are searched without the latent space. cosine is null for what only a search without it
    finds. Repeated rows are each judged, so equal rows give equal results; an item id may have several texts and any
    type. An empty benchmark or empty docs: no rows. The benchmark is read in blocks of ITEM_BLOCK items.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("id"), "text").where("text is not null")
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    n_blocks = max(1, -(-items.count() // ITEM_BLOCK))
    out = None
    blocked = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)))
    for block in range(n_blocks):
        rows = sorted((r[0], r[1]) for r in blocked.where(F.col("block") == block).collect())
        if not rows:
            continue
        names = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], f"item long, item_id {type_of(items, 'item_id')}")  # about ITEM_BLOCK rows
        found = search_block(source, rows, id_col).join(F.broadcast(names), "item").drop("item")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = source.select("id", F.lit(b"").alias("text_key"), F.lit(None).cast(type_of(items, "item_id")).alias("item_id"), F.lit(0.0).alias("cosine"), F.lit(0.0).alias("lcs")).limit(0)
    return out.select(F.col("id").alias(id_col), "text_key", F.col("item_id").alias(item_col), F.round("cosine", 6).alias("cosine"), F.round("lcs", 6).alias("lcs"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that hold no item; columns stay, however they are named. Rows are told by id and text, so null and
    repeated ids take no other row with them."""
    leaks = keyed_leaks(docs, benchmark, id_col).select(F.col(id_col).alias("id"), "text_key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key"))
    return rows.join(leaks, rows["id"].eqNullSafe(leaks["id"]) & (rows["text_key"] == leaks["text_key"]), "left_anti").select("row.*")
