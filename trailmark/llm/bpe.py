"""Byte-level BPE: each task contracts its distinct words in DuckDB by recursive queries and decodes by ordered aggregation."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import map_batches, slices, type_of
from trailmark.llm.tokens import LETTER, MARK, PLAIN, SPLIT, ChunkCache, Kept, read_ranks, space_chunks


class Limits(NamedTuple):
    """What a worker holds: words of one recursive query, contracted words and chunks that it keeps (beside as many that
    came up before), characters of texts whose words are contracted together (a longer text is alone), DuckDB's memory."""

    query: int
    words: int
    chunks: int
    characters: int
    memory: str


#: For a job of its own, and for one among others whose executors have little memory left for Python.
ALONE, BESIDE = Limits(30_000, 300_000, 150_000, 4_000_000, "250MB"), Limits(20_000, 120_000, 80_000, 2_500_000, "100MB")
#: The longest word (in bytes) that a recursive query may hold: it keeps every step of its words, which for a longer word
#: would grow as the square of its length. Such words are contracted with a heap.
LONGEST_WORD = 255
#: The pattern's pieces of plain chunks that are joined by MARK, by Python's re.
_PLAIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+|{MARK}| ?[^\s{LETTER}0-9{MARK}]+|[^\S{MARK}]+(?=[{MARK}]|$)|[^\S{MARK}]+(?!\S)|[^\S{MARK}]+")

#: A row is a token of a word with the token after it. Each round joins these pairs with the merge table, takes the pair
#: of least rank, leftmost first, of each word (its rank, place and its partner's place in one number) and puts the
#: merged token in its place. A word is done in the round after which it has no pair left.
CONTRACT = """
WITH RECURSIVE step(round, word, pos, tok, next_pos, next_tok) AS (
    SELECT 0, word, pos, tok, next_pos, next_tok FROM start
    UNION ALL
    (WITH best AS (
        SELECT word, min(rank::BIGINT * 65536 + pos * 256 + next_pos) AS least FROM step JOIN merges ON tok = a AND next_tok = b GROUP BY word
    ), pair AS (
        SELECT word, (least // 65536)::INT AS merged, (least // 256 % 256)::INT AS kept, (least % 256)::INT AS gone, next_pos AS after_pos, next_tok AS after_tok
        FROM step JOIN best USING (word) WHERE pos = least % 256
    )
    SELECT round + 1, word, pos, CASE WHEN pos = kept THEN merged ELSE tok END, CASE WHEN pos = kept THEN after_pos ELSE next_pos END,
           CASE WHEN pos = kept THEN after_tok WHEN next_pos = kept THEN merged ELSE next_tok END
    FROM step JOIN pair USING (word) WHERE pos <> gone)
), done AS (SELECT word, max(round) AS round FROM step GROUP BY word)
SELECT word, string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS ids, string_agg(hex, '' ORDER BY pos) AS decoded
FROM step JOIN done USING (word, round) JOIN vocabulary ON tok = rank GROUP BY word
"""


@cache
def merge_tables(path: str) -> tuple[dict[bytes, int], pa.Table, pa.Table]:
    """Ranks by bytes; (a, b, rank) for every way to part a token into two tokens; (rank, hex)."""
    ranks = read_ranks(path)
    split = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    merges = pa.table([pa.array(c, pa.int32()) for c in zip(*split, strict=True)], ["a", "b", "rank"])
    return ranks, merges, pa.table([pa.array(ranks.values(), pa.int32()), pa.array([t.hex() for t in ranks], pa.string())], ["rank", "hex"])


def contract_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction for one long word, with a heap of (rank, place)."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = [*range(1, len(parts) + 1)], [*range(-1, len(parts) - 1)]
    heap = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        left, j = parts[i], after[i]
        if left is None or j >= len(parts) or ranks.get(left + parts[j]) != rank:
            continue
        parts[i], parts[j], after[i] = left + parts[j], None, after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < len(parts) and (r := ranks.get(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (r, k))
    return [ranks[p] for p in parts if p is not None]


class RankEncoder:
    """Encodes distinct words with DuckDB; gives (ids joined by spaces, decoded bytes) for each chunk."""

    def __init__(self, path: str, pattern: str, limits: Limits = ALONE) -> None:
        import duckdb
        import regex

        self.ranks, merges, vocabulary = merge_tables(path)
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern, self.known_pattern, self.words = regex.compile(pattern), pattern == SPLIT, Kept(limits.words)
        self.limits = limits
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": limits.memory, "autoinstall_known_extensions": "false", "autoload_known_extensions": "false"})
        self.db.register("merges_given", merges)
        self.db.register("vocabulary_given", vocabulary)
        self.db.execute("CREATE TABLE merges AS FROM merges_given")
        self.db.execute("CREATE TABLE vocabulary AS FROM vocabulary_given")

    def parted(self, text: str) -> list[str]:
        """Chunks that the pattern treats alone; where its matches could reach across spaces, the matches themselves."""
        chunks = space_chunks(text) if self.known_pattern else None
        return self.pattern.findall(text) if chunks is None else chunks

    def pieces(self, chunks: list[str]) -> list[list[str]]:
        """The pattern's matches in each chunk."""
        if not self.known_pattern or not PLAIN.fullmatch("".join(chunks)):
            return [_pieces_alone(c) if self.known_pattern and PLAIN.fullmatch(c) else self.pattern.findall(c) for c in chunks]
        return _pieces_of(chunks)

    def contract(self, words: list[bytes]) -> Iterator[tuple[int, str, str]]:
        """Place, ids joined by spaces and decoded bytes in hex, of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        place = np.repeat(np.arange(len(words)), sizes)
        pos, tok = np.arange(ends[-1]) - (ends - sizes)[place], self.single[np.frombuffer(b"".join(words), np.uint8)]
        last = np.zeros(len(tok), bool)
        last[ends - 1] = True
        after = [pa.array((pos + 1).astype(np.int32), mask=last), pa.array(np.roll(tok, -1), mask=last)]
        start = pa.table([place.astype(np.int32), pos.astype(np.int32), tok, *after], ["word", "pos", "tok", "next_pos", "next_tok"])
        self.db.register("start", start)
        found = self.db.sql(CONTRACT).to_arrow_table()
        self.db.unregister("start")
        return zip(*(c.to_pylist() for c in found.columns), strict=True)

    def chunks(self, chunks: list[str]) -> dict[str, tuple[str, bytes]]:
        parted = self.pieces(chunks)
        new = self.words.missing({*chain.from_iterable(parted)})
        known = self.words.new
        data = [p.encode("utf-8", "replace") for p in new]
        short = []
        for p, b in zip(new, data, strict=True):
            if b in self.ranks:  # a word that is a token has its id without contraction, as the library gives it
                known[p] = (str(self.ranks[b]), self.bytes_of[self.ranks[b]])
            elif len(b) > LONGEST_WORD:
                ids = contract_long(b, self.ranks)
                known[p] = (" ".join(map(str, ids)), b"".join(self.bytes_of[i] for i in ids))
            else:
                short.append((p, b))
        short.sort(key=lambda x: len(x[1]))  # words of one query need about as many rounds
        for at in range(0, len(short), self.limits.query):
            part = short[at : at + self.limits.query]
            for word, ids, decoded in self.contract([b for _, b in part]):
                known[part[word][0]] = (ids, bytes.fromhex(decoded))
        out = {}
        for c, ps in zip(chunks, parted, strict=True):
            if len(ps) == 1:
                out[c] = known[ps[0]]
            else:
                got = [known[p] for p in ps]
                out[c] = (" ".join([g[0] for g in got]), b"".join([g[1] for g in got]))
        return out


def _pieces_of(chunks: list[str]) -> list[list[str]]:
    """The fixed pattern's matches in plain chunks, cut in one pass over all of them."""
    out, part = [], []
    for piece in _PLAIN_PIECES.findall(MARK.join(chunks)):
        if piece == MARK:
            out.append(part)
            part = []
        else:
            part.append(piece)
    return [*out, part]


def _pieces_alone(chunk: str) -> list[str]:
    return _pieces_of([chunk])[0]


@cache
def worker_ranks(path: str, pattern: str, limits: Limits) -> tuple[RankEncoder, ChunkCache]:
    """One encoder with its bounded caches for each Python worker, which runs one task after another."""
    encoder = RankEncoder(path, pattern, limits)
    return encoder, ChunkCache(encoder.chunks, limits.chunks)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", with_ids: bool = False, limits: Limits = ALONE) -> DataFrame:
    """Encode every whole text by the ranks, each match of the pattern separately, and decode the ids again.

    Returns id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256 (of the decoded bytes), and
    with with_ids the ids themselves, one row for each row. Null texts count as empty: no tokens. Repeated and null ids
    stay; other columns aren't read; no rows: no rows.
    """

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cache = worker_ranks(ranks_path, pattern, limits)
        for rows in parts:
            texts, out = rows.column("text").to_pylist(), []
            for part in slices(texts, (len(t or "") for t in texts), limits.characters):
                chunked = [[c for c in encoder.parted(t) if c] if t else [] for t in part]
                known = cache.get(chunked)
                for chunks in chunked:
                    got = list(map(known.__getitem__, chunks))
                    ids = " ".join([g[0] for g in got])
                    digest = hashlib.sha256(b"".join([g[1] for g in got])).hexdigest()
                    out.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), digest, *([[int(x) for x in ids.split()]] if with_ids else ())))
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            columns = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 3 + with_ids]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array([r[i] for r in out], types[i]) for i in range(len(columns)))], ["id", *columns])

    schema = f"id {type_of(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(docs.select(F.col(id_col).alias("id"), "text"), encode, schema).withColumnRenamed("id", id_col)
