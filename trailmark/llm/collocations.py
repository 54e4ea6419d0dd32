"""Phrase collocation mining: candidates level by level, counted by double-array tries over whole texts.

Texts become arrays of 64-bit word hashes, which hold the language, with 0 between pieces; they are written once to the
shared folder. A phrase of k words is a candidate only if both its parts of k - 1 words are frequent (Apriori): a bitmap
of fixed size tells tasks which windows to hand on, so no dictionary is sent out. Candidates go into double-array tries of
a bounded number of phrases, one after the other; tasks walk all positions of an array at once, level by level, and
count the accepting states that they reach; Spark adds the tasks' counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import map_batches, materialise

#: Fixed: marks between pieces become full stops, which stand alone between words.
PIECES = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")
LONGEST = 5
#: Hashes in an array that is written, bytes of a text that are cut at once (at a piece's end), words that a task counts.
ARRAY, SLICE, FLUSH = 1 << 18, 1 << 20, 100_000
#: Windows that a task adds up before it hands their sums on; parts that keys are dealt in; phrases whose counts are one row.
MERGED, BUCKETS, COUNTS = 1 << 20, 1024, 1024
#: Bits of the bitmap of frequent parts; when there are many more parts, it lets more windows pass, never fewer.
BITS = 1 << 26
#: Phrases of a trie: what is sent to tasks at once is a few times ten bytes for each.
TRIE = 400_000
#: Factor of rolling hashes.
FACTOR = 0x9E3779B97F4A7C15
#: Parts that a language's candidates are ranked in first.
SALTS = 64


class Hashes(dict):
    """Word -> signed 64-bit hash with its language; forgets all when it grows beyond FLUSH words."""

    def __init__(self, lang: str, seed: int) -> None:
        self.lang, self.seed = lang.encode() + b"\n", seed
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(self.lang + word, self.seed) or 1
        if len(self) > FLUSH:
            self.clear()
            self[b"."] = 0
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h


def pieces_of(text: str) -> Iterator[list[bytes]]:
    """A text's words and full stops (between pieces), in lists of about SLICE bytes, cut at ends of pieces."""
    data = text.encode("utf-8", "replace").lower().translate(PIECES)  # bytes.lower() folds A-Z only
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE else data.find(b".", at + SLICE) + 1 or len(data)
        yield data[at:end].replace(b".", b" . ").split()
        at = end


def encode_words(docs: DataFrame, text_col: str, lang_col: str, seed: int) -> DataFrame:
    """Rows of two kinds: arrays of hashes (ids), and words with their counts (lang, word, h, n)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, Hashes] = {}
        words: dict[str, Counter] = defaultdict(Counter)
        held: list[np.ndarray] = []

        def arrays() -> pa.RecordBatch:
            made = np.concatenate(held)
            held.clear()
            return batch([None], [None], [None], [None], [made.tobytes()])

        def counts() -> pa.RecordBatch:
            rows = [(lang, w.decode(), hashes[lang][w], n) for lang, c in words.items() for w, n in c.items() if w != b"."]
            words.clear()
            return batch(*([r[i] for r in rows] for i in range(4)), [None] * len(rows))

        for rows in parts:
            for text, lang in zip(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), strict=True):
                known = hashes.setdefault(lang, Hashes(lang, seed))
                for tokens in pieces_of(text or ""):
                    words[lang].update(tokens)
                    held += [np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)), np.zeros(1, np.int64)]
                    if sum(map(len, held)) >= ARRAY:
                        yield arrays()
            if sum(map(len, words.values())) > FLUSH:
                yield counts()
        if held:
            yield arrays()
        yield counts()

    def batch(*columns: list) -> pa.RecordBatch:
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "word", "h", "n", "ids"])

    chosen = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    return map_batches(chosen, run, "lang string, word string, h long, n long, ids binary")


def hashed_words(docs: DataFrame, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """Arrays (ids) and words (lang, word, h, n) under hashes that no two words share; a seed that gives one hash to two
    words of the corpus is put aside for the next."""
    for seed in range(8):
        made = materialise(encode_words(docs, text_col, lang_col, seed), "word-hashes")
        both = F.struct("lang", "word")
        words = made.where("ids is null").groupBy("h").agg(F.sum("n").alias("n"), F.min(both).alias("one"), F.max(both).alias("other"))
        words = materialise(words, "word-counts")
        if words.where("one <> other").isEmpty():
            return made.where("ids is not null").select("ids"), words.select("h", "n", "one.lang", "one.word")
    raise ValueError("every seed gives one hash to two words")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """BITS bits, two of which are set for each hash; summed by Spark, so that no list of hashes reaches the driver."""
    at = hashes.select(F.explode(F.array(F.expr(f"hash & {BITS - 1}L"), F.expr(f"shiftrightunsigned(hash, 32) & {BITS - 1}L"))).alias("at"))
    slots = at.groupBy(F.expr("shiftright(at, 6)").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for at in (hashes & np.uint64(BITS - 1), (hashes >> np.uint64(32)) & np.uint64(BITS - 1)):
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def rolling(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window of so many words, and whether it lies within one piece."""
    n = max(0, len(words) - size + 1)
    out, whole = words[:n].copy(), words[:n] != 0
    for j in range(1, size):
        out = out * np.uint64(FACTOR) + words[j : n + j]
        whole &= words[j : n + j] != 0
    return out, whole


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of 64-bit numbers as one big-endian binary value each."""
    width = 8 * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.astype(">u8").tobytes())])


def safe_windows(words: np.ndarray, size: int, bits: np.ndarray, heavy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first place and count of the different windows whose parts may both be frequent (and, with `heavy`, they
    themselves). Windows that share a hash but not their words stand alone."""
    part, whole = rolling(words, size - 1)
    whole &= in_bitmap(bits, part)
    at = np.flatnonzero(whole[:-1] & whole[1:]) if len(whole) > 1 else np.zeros(0, np.int64)
    hashes = part[at] * np.uint64(FACTOR) + words[at + size - 1]
    if heavy is not None:
        some = in_bitmap(heavy, hashes)
        at, hashes = at[some], hashes[some]
    order = np.argsort(hashes, kind="stable")
    at, hashes = at[order], hashes[order]
    new = np.ones(len(at), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    first = at[new][np.cumsum(new) - 1] if len(at) else at
    other = np.zeros(len(at), bool)
    for j in range(size):
        other |= words[at + j] != words[first + j]
    new |= other
    new[1:] |= other[:-1]
    starts = np.flatnonzero(new)
    return hashes[starts], at[starts], np.diff(np.append(starts, len(at)))


def window_sums(arrays: DataFrame, size: int, bits: Broadcast, least: int) -> DataFrame:
    """hash of the windows of so many words whose parts may both be frequent, and that are frequent by the sum of all
    windows with that hash. Tasks add up what they can hold before Spark does."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add(full: bool) -> Iterator[pa.RecordBatch]:
            every, times = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            order = np.argsort(every, kind="stable")
            every, times = every[order], times[order]
            starts = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
            every, times = every[starts], np.add.reduceat(times, starts) if len(starts) else times
            held.clear()
            if full or len(starts) > MERGED // 2:
                for cut in range(0, len(starts), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(every[cut : cut + 100_000].view(np.int64)), pa.array(times[cut : cut + 100_000])], ["hash", "n"])
            else:
                held.append((every, times))

        for rows in parts:
            for ids in rows.column("ids"):
                words = np.frombuffer(ids.as_py(), np.uint64)
                hashes, _, times = safe_windows(words, size, bits.value)
                held.append((hashes, times))
                if sum(len(h) for h, _ in held) > MERGED:
                    yield from add(False)
        yield from add(True)

    summed = map_batches(arrays, run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return materialise(summed.where(F.col("n") >= least).select("hash"), "frequent-windows")


def candidates(arrays: DataFrame, size: int, frequent: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """key of the phrases of so many words that can be frequent, with few others; and the hashes that they have.

    Tasks hand on each key once, packed by bucket; a bucket's task drops what several tasks have handed on."""
    context = arrays.sparkSession.sparkContext
    bits = context.broadcast(bitmap(frequent))
    heavy = window_sums(arrays, size, bits, least)
    heavy_bits, width = context.broadcast(bitmap(heavy)), 8 * size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def packed() -> pa.RecordBatch:
            by: dict[int, list[bytes]] = defaultdict(list)
            for key in seen:
                by[zlib.crc32(key) % BUCKETS].append(key)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([b"".join(x) for x in by.values()], pa.binary())], ["bucket", "keys"])

        for rows in parts:
            for ids in rows.column("ids"):
                words = np.frombuffer(ids.as_py(), np.uint64)
                at = safe_windows(words, size, bits.value, heavy_bits.value)[1]
                seen.update(binary(words[at[:, None] + np.arange(size)]).to_pylist())
                if len(seen) > FLUSH:
                    yield packed()
        yield packed()

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, seen = None, set()
        for rows in parts:
            out = []
            for own, keys in zip(rows.column("bucket").to_pylist(), rows.column("keys").to_pylist(), strict=True):
                if own != bucket:
                    bucket, seen = own, set()
                new = {keys[i : i + width] for i in range(0, len(keys), width)} - seen
                seen |= new
                out += new
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["key"])

    made = map_batches(arrays, run, "bucket int, keys binary").repartition("bucket").sortWithinPartitions("bucket")
    return materialise(map_batches(made, merge, "key binary"), "phrases"), heavy


class Trie:
    """A double array over symbols 1, 2, ...: the child of state s by symbol c is base[s] + c if check there is s.

    The root is state 0 with base 0; phrase[s] is the number of the phrase that ends in s, or -1. Nodes with many children
    are placed first, one by one; those with few are placed all at once, again and again until no two want one place.
    """

    def __init__(self, phrases: list[np.ndarray]) -> None:
        self.symbols = np.unique(np.concatenate(phrases)) if phrases else np.zeros(0, np.uint64)
        n, wide = len(phrases), len(self.symbols) + 1
        sizes = np.array([len(p) for p in phrases], np.int64)
        table = np.zeros((n, LONGEST), np.int64)
        table[np.arange(LONGEST) < sizes[:, None]] = np.searchsorted(self.symbols, np.concatenate(phrases)) + 1 if n else 0
        # Nodes by level: number 0 is the root; at[i] is the node that phrase i has reached.
        parent, symbol, ends, at, nodes = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], np.zeros(n, np.int64), np.zeros(n, np.int64), 1
        for j in range(LONGEST):
            live = np.flatnonzero(sizes > j)
            edges, back = np.unique(at[live] * wide + table[live, j], return_inverse=True)
            at[live] = nodes + back
            parent.append(edges // wide)
            symbol.append(edges % wide)
            nodes += len(edges)
            ends[live[sizes[live] == j + 1]] = at[live[sizes[live] == j + 1]]
        parents, symbols = np.concatenate(parent), np.concatenate(symbol)
        base, place, size = self._place(parents, symbols, wide)
        self.base, self.check, self.phrase = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[place], self.check[place[1:]] = base, place[parents[1:]]
        self.phrase[place[ends]] = np.arange(n)

    @staticmethod
    def _place(parents: np.ndarray, symbols: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Each node's base and place, and the length of the arrays."""
        nodes, rng = len(parents), np.random.default_rng(1)
        size = 2 * wide + 4 * nodes
        used, base = np.zeros(size, bool), np.zeros(nodes, np.int64)
        used[:wide] = True  # the root and its children
        inner = np.flatnonzero(parents[1:] > 0) + 1  # nodes below the first level, grouped by parent as levels are sorted
        owners, starts, counts = np.unique(parents[inner], return_index=True, return_counts=True)
        for k in np.argsort(-counts, kind="stable")[: int((counts > 8).sum())]:
            own = symbols[inner[starts[k] : starts[k] + counts[k]]]
            for _ in range(20):
                tries = rng.integers(wide, size - wide, 64)
                free = np.flatnonzero(~used[tries[:, None] + own].any(1))
                if len(free):
                    base[owners[k]] = tries[free[0]]
                    break
            else:
                base[owners[k]], size = size, size + wide
                used = np.append(used, np.zeros(wide, bool))
            used[base[owners[k]] + own] = True
        few = np.zeros(nodes, bool)
        few[owners[counts <= 8]] = True
        while few.any():
            base[few] = rng.integers(wide, size - wide, int(few.sum()))
            edges = inner[few[parents[inner]]]
            want = base[parents[edges]] + symbols[edges]
            _, first = np.unique(want, return_index=True)
            lost = np.ones(len(want), bool)
            lost[first] = False
            bad = np.zeros(nodes, bool)
            bad[parents[edges[lost | used[want]]]] = True
            used[want[~bad[parents[edges]]]] = True
            few &= bad
        place = base[parents] + symbols
        place[0] = 0
        return base, place, size

    def count(self, words: np.ndarray, totals: np.ndarray) -> None:
        """Add the numbers of times that each state is reached from any position of an array."""
        if not len(self.symbols) or not len(words):
            return
        found = np.minimum(np.searchsorted(self.symbols, words), len(self.symbols) - 1)
        symbol = np.where(self.symbols[found] == words, found + 1, 0)
        at = np.flatnonzero(symbol)
        state, depth = np.zeros(len(at), np.int64), 0
        while len(at):
            after = self.base[state] + symbol[at + depth]
            ok = self.check[after] == state
            at, state, depth = at[ok], after[ok], depth + 1
            totals += np.bincount(state, minlength=len(totals))
            more = at + depth < len(words)
            at, state = at[more], state[more]
            more = symbol[at + depth] > 0
            at, state = at[more], state[more]


def count_phrases(arrays: DataFrame, phrases: DataFrame, trie_phrases: int = TRIE) -> DataFrame:
    """key, a for each phrase (key) and how often the arrays have it, overlaps included. Phrases go in shards of about
    trie_phrases each; a shard is one trie, sent to all tasks, and one pass over the arrays. Tasks hand on blocks of
    counts, which are added one after the other."""
    spark, shards = phrases.sparkSession, max(1, math.ceil(phrases.count() / trie_phrases))
    counts = []
    for shard in range(shards):
        keys = phrases.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == shard).select("key").toArrow().column("key").to_pylist()
        sent = spark.sparkContext.broadcast((Trie([np.frombuffer(k, ">u8").astype(np.uint64) for k in keys]), keys))

        def run(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trie, keys = sent.value
            totals = np.zeros(len(trie.base), np.int64)
            for rows in parts:
                for ids in rows.column("ids"):
                    trie.count(np.frombuffer(ids.as_py(), np.uint64), totals)
            ends = np.flatnonzero(trie.phrase >= 0)
            counts = np.zeros(-(-len(keys) // COUNTS) * COUNTS, np.int64)
            counts[trie.phrase[ends]] = totals[ends]
            blocks = counts.reshape(-1, COUNTS)
            some = np.flatnonzero(blocks.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([blocks[i].tobytes() for i in some], pa.binary())], ["block", "counts"])

        def add(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, block, total = sent.value[1], None, None

            def done() -> pa.RecordBatch:
                some = np.flatnonzero(total) if block is not None else np.zeros(0, np.int64)
                return pa.RecordBatch.from_arrays([pa.array([keys[block * COUNTS + i] for i in some], pa.binary()), pa.array(total[some] if len(some) else [], pa.int64())], ["key", "a"])

            for rows in parts:
                for own, counts in zip(rows.column("block").to_pylist(), rows.column("counts").to_pylist(), strict=True):
                    if own != block:
                        yield done()
                        block, total = own, np.zeros(COUNTS, np.int64)
                    total += np.frombuffer(counts, np.int64)
            yield done()

        found = map_batches(arrays, run, "block int, counts binary").repartition("block").sortWithinPartitions("block")
        counts.append(materialise(map_batches(found, add, "key binary, a long"), "phrase-counts"))
        sent.unpersist()
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def part_of(key: str, start: Column | int, words: Column | int) -> Column:
    """So many words of a key from word `start` (from 0) on."""
    return F.substring(key, F.lit(start) * 8 + 1, F.lit(words) * 8)


def mine_phrases(docs: DataFrame, least: int = 100, first: int = 2000, text_col: str = "text", lang_col: str = "lang", trie_phrases: int = TRIE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best collocations of 2 to LONGEST words.

    Words are runs of what is neither blank nor a mark that ends a piece; A-Z are folded; phrases lie within pieces. a, l
    and r count all occurrences of the phrase and of the parts before and after its weakest cut, n all words of the
    language; score is floor(1000 a n / (l r)) at that cut. Phrases with a below `least` are left out, and those that
    always come within one longer phrase. Ties go to the larger a, then to the phrase's UTF-8 bytes.

    A null text has no words; a null language is `und`. Repeated rows count each time; ids and other columns aren't read.
    No phrases: no rows. Arithmetic is in decimals of 38 digits, exact for up to 10^16 words.
    """
    arrays, words = hashed_words(docs, text_col, lang_col)
    frequent, levels = words.where(F.col("n") >= least).select(F.col("h").alias("hash")), []
    for size in range(2, LONGEST + 1):
        keys, frequent = candidates(arrays, size, frequent, least)
        levels.append(keys)
        if frequent.isEmpty():
            break
    phrases = levels[0]
    for more in levels[1:]:
        phrases = phrases.unionByName(more)
    counts = count_phrases(arrays, phrases, trie_phrases).where(F.col("a") >= least).withColumn("size", (F.octet_length("key") / 8).cast("int"))
    single = words.where(F.col("n") >= least).select(F.expr("unhex(lpad(hex(h), 16, '0'))").alias("key"), F.col("n").alias("f"), "lang", "word")
    parts = single.select("key", "f").unionByName(counts.select("key", F.col("a").alias("f")))
    # Every cut meets the counts of its two parts, both frequent as the whole is.
    cuts = counts.select("key", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "size", "k", part_of("key", 0, F.col("k")).alias("left"), part_of("key", F.col("k"), F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    # The language, n and the words of each phrase.
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    named = single.join(totals, "lang").select(F.col("key").alias("word_key"), "word", "lang", "total")
    spelt = counts.select("key", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i")).withColumn("word_key", part_of("key", F.col("i"), 1)).join(named, "word_key")
    spelt = spelt.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.first("lang").alias("lang"), F.first("total").alias("n"))
    big = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "n", "l", "r")}
    scored = cuts.join(spelt, "key").withColumns({f"_{c}": v for c, v in big.items()}).withColumn("score", F.expr("(1000BD * _a * _n) div (_l * _r)"))
    worst = scored.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "lang", "phrase")).alias("w")).select("key", "w.*")
    longer = counts.where("size > 2").select("a", F.explode(F.array(part_of("key", 0, F.col("size") - 1), part_of("key", 1, F.col("size") - 1))).alias("key"))
    longer = longer.groupBy("key").agg(F.max("a").alias("within"))
    kept = worst.join(longer, "key", "left").where("within is null or within < a")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # A language's phrases are ranked in parts first, so that no task sorts all of them.
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
