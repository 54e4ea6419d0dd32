"""Prefix trie of conversations by vertical bitmaps, in shards of conversations that Spark merges.

A shard holds a bounded number of conversations. Its index has a bitset of conversations for each (position, turn) that
several of them share; walking down depth first, a node's bitset meets the postings of its members' next turns, and each
intersection is a child. Shards give partial nodes under digests of their paths, so conversations of one hot prefix may
lie in any number of shards: counts, least ids and subtree sums are added by digest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import map_batches, materialise

#: Conversations in a shard, on average.
SHARD = 2048
#: The root's digest.
ROOT = b""
#: Fixed: the parts that a rebuilt conversation's origin and its length are taken from.
FAMILY, LENGTHS = 5, 9


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, n_bytes of each turn, in order of turn (null first), then of role and text.

    Null roles and texts are empty; rows without a conv_id belong to no conversation. The digest holds role and text."""
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    mark = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return turns.select("conv_id", pos.alias("pos"), F.substring(F.unhex(F.sha2(mark.cast("binary"), 256)), 1, 16).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


def rebuild(turns: DataFrame) -> DataFrame:
    """Conversations begun by another: conv_id, origin, pos, digest, n_bytes; one row with a null pos where no turn is left.

    Conversation c has the first h turns of its origin c - c % 5 (none if that is absent), then its own after its first h,
    where h is the unsigned crc32 of c's decimal text modulo 9. Positions leave no gap, but don't begin at 1 for certain."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENGTHS).cast("int")
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("origin"), head.alias("h"))
    lent = ids.join(turns.where(F.col("pos") < LENGTHS).select(F.col("conv_id").alias("origin"), "pos", "digest", "n_bytes"), "origin").where("pos <= h")
    own = turns.withColumns({"h": head, "origin": F.col("conv_id") - F.col("conv_id") % FAMILY}).where("pos > h")
    none = ids.withColumns({"pos": F.lit(None).cast("int"), "digest": F.lit(None).cast("binary"), "n_bytes": F.lit(None).cast("long")})
    columns = ["conv_id", "origin", "pos", "digest", "n_bytes"]
    return lent.select(*columns).unionByName(own.select(*columns)).unionByName(none.select(*columns))


def shard_nodes(ids: np.ndarray, path: np.ndarray, starts: np.ndarray, digests: list[bytes], sizes: np.ndarray) -> dict[str, list]:
    """A shard's nodes in depth-first order. ids: conversations, ascending; path: numbers of the turns of one after the
    other, from starts[i] to starts[i + 1]; digests and sizes: by turn number."""
    lengths = np.diff(starts)
    position = np.arange(len(path)) - np.repeat(starts[:-1], lengths)
    owner = np.repeat(np.arange(len(ids)), lengths)
    # Postings that several conversations share, as bitsets; one of a single conversation is that conversation's bit.
    order = np.lexsort((owner, path, position))
    new = np.ones(len(order), bool)
    new[1:] = (position[order][1:] != position[order][:-1]) | (path[order][1:] != path[order][:-1])
    cuts = np.append(np.flatnonzero(new), len(order))
    postings: dict[tuple[int, int], int] = {}
    for a, b in zip(cuts[:-1][np.diff(cuts) > 1].tolist(), cuts[1:][np.diff(cuts) > 1].tolist(), strict=True):
        bits = np.zeros(len(ids), np.uint8)
        bits[owner[order[a:b]]] = 1
        postings[(int(position[order[a]]), int(path[order[a]]))] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    out: dict[str, list] = {k: [] for k in ("key", "parent", "depth", "n_bytes", "conv", "n", "last", "ends")}
    wide = (len(ids) + 7) // 8

    def members(bits: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(wide, "little"), np.uint8), bitorder="little"))

    def add(key: bytes, parent: bytes | None, depth: int, n_bytes: int, first: int, n: int, ends: list[int]) -> None:
        for name, value in zip(out, (key, parent, depth, n_bytes, int(ids[first]), n, 0, ends), strict=True):
            out[name].append(value)

    stack: list[tuple] = [((1 << len(ids)) - 1, ROOT, None, 0, 0)]
    while stack:
        bits, key, parent, depth, n_bytes = stack.pop()
        if bits < 0:  # all below this node has been walked
            out["last"][~bits] = len(out["key"])
            continue
        if bits.bit_count() == 1:  # one conversation: the rest of its path is a chain
            i = bits.bit_length() - 1
            chain, first = path[starts[i] + depth : starts[i + 1]].tolist(), len(out["key"])
            for k in range(len(chain) + 1):
                add(key, parent, depth + k, n_bytes, i, 1, [int(ids[i])] if k == len(chain) else [])
                if k < len(chain):
                    key, parent, n_bytes = hashlib.sha256(key + digests[chain[k]]).digest()[:16], key, int(sizes[chain[k]])
            out["last"][first:] = [len(out["key"])] * (len(chain) + 1)
            continue
        who = members(bits)
        going = who[lengths[who] > depth]
        stack.append((~len(out["key"]), key, parent, depth, n_bytes))
        add(key, parent, depth, n_bytes, int(who[0]), len(who), ids[who[lengths[who] == depth]].tolist())
        turns, at = np.unique(path[starts[going] + depth], return_index=True)
        for turn, one in zip(turns.tolist(), going[at].tolist(), strict=True):
            child = bits & postings.get((depth, turn), 1 << one)
            stack.append((child, hashlib.sha256(key + digests[turn]).digest()[:16], key, depth + 1, int(sizes[turn])))
    return out


NODES = "shard int, pre int, last int, key binary, parent binary, depth int, n_bytes long, conv long, n long, ends array<long>"


def partial_nodes(rebuilt: DataFrame, shard: int = SHARD) -> DataFrame:
    """Each shard's nodes: place in depth-first order, end of the subtree, digest, parent's digest, depth, bytes of the last
    text, least member, members, and the members that end there."""
    shards = max(1, math.ceil(rebuilt.where("pos is null").count() / shard))
    placed = rebuilt.withColumn("shard", F.pmod(F.xxhash64("origin"), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        conv, pos = table.column("conv_id").to_numpy(), table.column("pos").fill_null(0).to_numpy()
        order = np.lexsort((pos, conv))
        turns = order[pos[order] > 0]
        ids, names = np.unique(conv), {}
        starts = np.append(np.searchsorted(conv[turns], ids), len(turns))
        digests = table.column("digest").take(pa.array(turns)).to_pylist()
        path = np.fromiter((names.setdefault(d, len(names)) for d in digests), np.int64, len(turns))
        sizes = np.zeros(len(names), np.int64)
        sizes[path] = table.column("n_bytes").take(pa.array(turns)).to_numpy()
        made = shard_nodes(ids, path, starts, list(names), sizes)
        n = len(made["key"])
        columns = [pa.array([table.column("shard")[0].as_py()] * n, pa.int32()), pa.array(np.arange(n), pa.int32())]
        kinds = {"last": pa.int32(), "key": pa.binary(), "parent": pa.binary(), "depth": pa.int32(), "n_bytes": pa.int64(), "conv": pa.int64(), "n": pa.int64(), "ends": pa.list_(pa.int64())}
        return pa.Table.from_arrays(columns + [pa.array(made[k], t) for k, t in kinds.items()], ["shard", "pre", *kinds])

    return placed.groupBy("shard").applyInArrow(run, NODES)


def end_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of each key's conversation ids, ascending, joined by commas. One pass over sorted rows;
    a key of any number of ids is read batch by batch, never held."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made = None, None
        for rows in parts:
            keys, convs, done = rows.column("key").to_pylist(), rows.column("conv").to_pylist(), []
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if key != keys[at]:
                    if made is not None:
                        done.append((key, made.hexdigest()))
                    key, made = keys[at], hashlib.sha256()
                    made.update(",".join(map(str, convs[at:end])).encode())
                else:
                    made.update("".join(f",{c}" for c in convs[at:end]).encode())
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["key", "ends_sha256"])
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([made.hexdigest()])], ["key", "ends_sha256"])

    return map_batches(ends.repartition("key").sortWithinPartitions("key", "conv"), run, "key binary, ends_sha256 string")


def subtree_sums(rows: DataFrame) -> DataFrame:
    """key, parent_conv, leaves, saved: each shard's share of the sums over all nodes below (itself among them). A node's own
    numbers count in one shard only, that of its least member, which has all its ancestors, too."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pre")
        own = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
        last, depth, conv = (table.column(c).to_numpy() for c in ("last", "depth", "least"))
        sums = [np.concatenate([[0], np.cumsum(np.where(own, table.column(c).to_numpy(), 0))]) for c in ("leaf", "value")]
        at, above, parent = np.arange(len(own)), [], np.full(len(own), -1)
        for i, d in enumerate(depth.tolist()):
            del above[d:]
            parent[i] = above[-1] if above else -1
            above.append(i)
        up = pa.array(np.where(own & (parent >= 0), conv[parent], 0), mask=~(own & (parent >= 0)))
        return pa.Table.from_arrays([table.column("key"), up, *(pa.array(s[last] - s[at]) for s in sums)], ["key", "parent_conv", "leaves", "saved"])

    return rows.groupBy("shard").applyInArrow(run, "key binary, parent_conv long, leaves long, saved long")


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations, the textless root among them.

    conv_id: its least member; depth; parent_conv_id: its parent's (root: null); n_convs: members; n_children; n_leaves:
    childless nodes in its subtree, itself included; saved_tokens: over its subtree, (n_convs - 1) times the UTF-8 bytes
    of a node's last text; ends_sha256: digest of the ids of members that end there, ascending (none: of the empty text).

    Nulls come first among turns; equal turns of one conversation go by role and text, repeated rows count as turns; null
    roles and texts are empty; rows without a conv_id are left out. Other columns aren't read. No rows: no nodes, not
    even a root. One conversation is one task's work, as is the list of ids that one node's digest is taken of.
    """
    rebuilt = materialise(rebuild(materialise(numbered(conversations), "turns")), "rebuilt")
    parts = materialise(partial_nodes(rebuilt, shard), "partial-nodes")
    nodes = parts.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("n_bytes").alias("n_bytes"), F.min("conv").alias("least"), F.sum("n").alias("n_convs"))
    nodes = materialise(nodes, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    value = nodes.select("key", "least", F.col("n_children").eqNullSafe(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("value"))
    rows = parts.select("shard", "pre", "last", "key", "depth", "conv").join(value, "key")
    rows = rows.select("shard", "pre", "last", "key", "depth", "least", "leaf", "value", (F.col("conv") == F.col("least")).alias("own"))
    sums = subtree_sums(rows).groupBy("key").agg(F.max("parent_conv").alias("parent_conv_id"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = end_digests(parts.select("key", F.explode("ends").alias("conv")))
    out = nodes.join(sums, "key").join(ends, "key", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
