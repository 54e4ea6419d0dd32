"""N-gram Jaccard join: a MinHash LSH forest finds clusters, exact verification in blocks finds their links.

The forest is one sorted table: each tree's entries in the order of their signatures are its prefix trie, and how much
of a signature an entry shares with the one before it tells at which depths both are below one node. Matching starts
with whole signatures; prefixes are shortened by a value at a time until the recall, estimated from the links that were
verified, reaches the target.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import map_batches, materialise, slices, type_of
from trailmark.llm.graph import components

WORDS, SIMILARITY = 5, 0.8
#: Trees of the forest, values of 32 bits in each tree's full signature, the shortest prefix that is matched, and the
#: recall at which prefixes are shortened no more.
TREES, DEPTH, LEAST_DEPTH, RECALL = 20, 7, 3, 0.999
#: Shingles, and sets, of one block of a cluster; pairs of blocks are verified each in one task.
BLOCK, SETS = 200_000, 1_000
#: Words of a text that are hashed at once.
WORDS_AT_ONCE = 200_000
SEED = 7

_random = np.random.default_rng(SEED)
_BYTES = _random.integers(0, 2**64, 256, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_A = _random.integers(0, 2**32, TREES * DEPTH, np.uint32) | np.uint32(1)
_B = _random.integers(0, 2**32, TREES * DEPTH, np.uint32)
_powers: list[np.ndarray] = []


def chance(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """Probability that two sets share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_ODD), -1, 2**64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_ODD, inverse)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words, lower-cased and parted by one space each.

    A text of one to four words has one shingle of all of them; one without words has none. The hash of a run is taken
    from prefix sums over the text's bytes, so the cost doesn't grow with the width.
    """
    words = text.lower().encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, np.uint64)
    width, out = min(width, len(words)), []
    for at in range(0, len(words) - width + 1, WORDS_AT_ONCE):
        part = words[at : at + WORDS_AT_ONCE + width - 1]
        data = np.frombuffer(b" ".join(part), np.uint8)
        power, inverse = powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[: len(data)])])
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(part) - width + 1]
        out.append(mix((sums[ends[width - 1 :]] - sums[starts]) * inverse[starts]))
    return np.unique(np.concatenate(out))


def signature(hashes: np.ndarray) -> bytes:
    """The MinHash values of all trees, TREES * DEPTH of them, big-endian so that their bytes sort as they do."""
    least, low = np.full(TREES * DEPTH, np.uint32(2**32 - 1)), (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 1024):
        made = low[at : at + 1024, None] * _A
        made += _B
        np.minimum(least, made.min(axis=0), out=least)
    return least.astype(">u4").tobytes()


def sign(docs: DataFrame) -> DataFrame:
    """id, text_key, node (digest of the shingle set, null without words), n_shingles and signature of each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            texts, at = rows.column("text").to_pylist(), 0
            for part in slices(texts, (len(t or "") for t in texts)):
                nodes, sizes, made = [], [], []
                for text in part:
                    found = shingles(text or "")
                    nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    sizes.append(len(found))
                    made.append(signature(found) if len(found) else None)
                n = len(part)
                yield pa.RecordBatch.from_arrays([rows.column("id").slice(at, n), rows.column("text_key").slice(at, n), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], ["id", "text_key", "node", "n_shingles", "signature"])
                at += n

    return map_batches(docs, run, f"id {type_of(docs, 'id')}, text_key binary, node binary, n_shingles long, signature binary")


def prefix_links(nodes: DataFrame) -> DataFrame:
    """a, b, depth for node, signature: two nodes that share a prefix of `depth` values in some tree.

    The entries (tree, its part of the signature, node) are sorted over all tasks. An entry that shares d values with
    the one before it is below the same trie node of depth d as the first entry of that node's run, and one row links
    the two; so the rows of depth d or more connect all that share prefixes of d values, with one row for each entry at
    most. Runs go on from task to task: the driver links the last entry of each with the first of the next, two entries
    for each task.
    """
    width, depths = 4 * DEPTH, range(LEAST_DEPTH, DEPTH + 1)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    entries = nodes.select("node", "signature", tree).select("tree", F.expr(f"substring(signature, tree * {width} + 1, {width})").alias("part"), "node")
    entries = entries.repartitionByRange("tree", "part", "node").sortWithinPartitions("tree", "part", "node").withColumn("task", F.spark_partition_id())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_node, task, leaders, ends = None, None, 0, {}, []
        for rows in parts:
            if not len(rows):
                continue
            node, trees = rows.column("node").to_pylist(), rows.column("tree").to_numpy()
            keys = np.empty((len(rows) + 1, DEPTH + 1), np.uint32)
            keys[1:, 0] = trees
            keys[1:, 1:] = np.frombuffer(b"".join(rows.column("part").to_pylist()), ">u4").reshape(-1, DEPTH)
            keys[0] = keys[1] + np.uint32(1) if last_key is None else last_key
            same = np.cumprod(keys[1:] == keys[:-1], axis=1)
            shared = np.where(same[:, 0] == 1, same.sum(axis=1) - 1, -1)
            if last_key is None:
                task = rows.column("task")[0].as_py()
                ends.append((keys[1].copy(), node[0]))
            made: list[tuple] = []
            at = np.arange(len(rows))
            for d in depths:
                first = np.maximum.accumulate(np.where(shared < d, at, -1))
                made += [(node[f] if f >= 0 else leaders[d], node[k], d) for k, f in zip(*(x[shared == d].tolist() for x in (at, first)), strict=True)]
                leaders[d] = node[first[-1]] if first[-1] >= 0 else leaders[d]
            last_key, last_node = keys[-1].copy(), node[-1]
            yield batch_of([(a, b, d, None, None) for a, b, d in made if a != b])
        if last_node is not None:
            ends.append((last_key, last_node))
            yield batch_of([(n, n, int(is_last), k.astype(">u4").tobytes(), task) for is_last, (k, n) in enumerate(ends)])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["a", "b", "depth", "key", "task"])

    found = materialise(map_batches(entries, run, "a binary, b binary, depth int, key binary, task int"), "prefixes")
    ends = sorted(found.where("key is not null").select("task", "depth", "key", "a").collect())
    across = []
    for before, after in zip(ends[1::2], ends[2::2], strict=False):
        x, y = (np.frombuffer(bytes(e[2]), ">u4") for e in (before, after))
        d = int(np.cumprod(x == y).sum()) - 1
        if d >= LEAST_DEPTH and before[3] != after[3]:
            across.append((before[3], after[3], d))
    links = found.where("key is null").select("a", "b", "depth")
    if across:
        links = links.unionByName(nodes.sparkSession.createDataFrame(across, "a binary, b binary, depth int"))
    return materialise(links.groupBy("a", "b").agg(F.max("depth").alias("depth")), "prefix-links")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node, hashes (little-endian 64-bit) of texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for part in slices(texts := rows.column("text").to_pylist(), (len(t or "") for t in texts)):
                found = [shingles(t or "").tobytes() for t in part]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(f, digest_size=16).digest() for f in found], pa.binary()), pa.array(found, pa.binary())], ["node", "hashes"])

    return map_batches(docs.select("text"), run, "node binary, hashes binary")


def similarities(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities of sets of one list with those of another, by products of incidence blocks."""
    sets, n = [*left, *right], len(left)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    # Only shingles that both sides have count.
    both = (np.bincount(column[row < n], minlength=len(values)) > 0) & (np.bincount(column[row >= n], minlength=len(values)) > 0)
    column_of = np.cumsum(both) - 1
    keep = both[column]
    row, column = row[keep], column_of[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column, total = row[order], column[order], int(both.sum())
    sizes = np.array([len(s) for s in sets], np.float32 if max(map(len, sets)) < 1 << 23 else np.float64)
    common = np.zeros((n, len(right)), sizes.dtype)
    for at in range(0, total, 1024):
        a, b = np.searchsorted(column, [at, at + 1024])
        block = np.zeros((len(sets), min(1024, total - at)), np.float32)
        block[row[a:b], column[a:b] - at] = 1
        common += block[:n] @ block[n:].T
    return common / (sizes[:n, None] + sizes[None, n:] - common)


def verify(blocks: DataFrame, similarity: float, depth: int) -> DataFrame:
    """For rows cluster, i, j, block, node, copies, hashes, sorted by cluster, i, j: node, leader, links, text_links, expected.

    Compares the sets of block i with those of block j (all pairs where i = j). links counts documents, text_links
    shingle sets; expected sums 1 / chance(similarity of the pair) over these, what text_links would be if none were
    missed; leader is the least node that the pair of blocks connects this one with. Nodes without links give no row, so
    a cluster of n sets gives n rows for each of its blocks at most, however many pairs link.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in parts:
                yield from zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "node", "copies", "hashes")), strict=True)

        out: list[tuple] = []
        for (_, i, j), group in groupby(rows(), key=lambda r: r[:3]):
            got = list(group)
            sides = [[r for r in got if r[3] == k] for k in dict.fromkeys((i, j))]
            left, right = sides[0], sides[-1]
            if not left or not right:
                continue
            found = similarities(*([np.frombuffer(r[6], "<u8") for r in side] for side in (left, right)))
            hit = found >= similarity - 1e-6
            if left is right:
                np.fill_diagonal(hit, False)
            expected = np.where(hit, 1 / chance(np.maximum(found, similarity), depth), 0)
            names = sorted({r[4] for r in got})
            order = {node: k for k, node in enumerate(names)}
            label = [np.array([order[r[4]] for r in side]) for side in (left, right)]
            changed = True
            while changed:
                new = np.minimum(label[0], np.where(hit, label[1][None, :], len(names)).min(axis=1))
                back = np.minimum(label[1], np.where(hit, new[:, None], len(names)).min(axis=0))
                if left is right:
                    new = back = np.minimum(new, back)
                changed = bool((new != label[0]).any() or (back != label[1]).any())
                label = [new, back]
            for side, other, h, e, names_of in ((left, right, hit, expected, label[0]), (right, left, hit.T, expected.T, label[1]))[: len(sides)]:
                links, text_links, hoped = h @ np.array([r[5] for r in other]), h.sum(axis=1), e.sum(axis=1)
                out += [(r[4], names[names_of[k]], int(links[k]), int(text_links[k]), float(hoped[k])) for k, r in enumerate(side) if text_links[k]]
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["node", "leader", "links", "text_links", "expected"])

    return map_batches(blocks, run, "node binary, leader binary, links long, text_links long, expected double")


def verified(source: DataFrame, nodes: DataFrame, edges: DataFrame, similarity: float, depth: int) -> DataFrame:
    """verify() of the clusters that these edges (a, b) make."""
    clusters = components(edges)
    members = materialise(clusters.select("node", F.col("label").alias("cluster")).join(nodes, "node"), "members")
    # The text of one document of each clustered set; ids may repeat, so what comes back is matched by its set.
    wanted = members.select(F.col("first_id").alias("id")).distinct()
    texts = source.where("text is not null").join(wanted, source["id"].eqNullSafe(wanted["id"]), "left_semi")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n_shingles") / BLOCK), F.ceil(F.count("*") / SETS)).cast("int").alias("n_blocks"))
    dealt = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    sets = dealt.join(shingle_sets(texts).dropDuplicates(["node"]), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    pairs = sets.select("cluster", "block", "node", "copies", "hashes", other).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "hashes")
    order = ["cluster", "i", "j"]
    return materialise(verify(pairs.repartition(*order).sortWithinPartitions(*order), similarity, depth), "links")


def links_of(source: DataFrame, nodes: DataFrame, similarity: float, recall: float) -> DataFrame:
    """The verified links of all nodes, by prefixes that are shortened until the estimated recall reaches the target.

    The estimate: a link of similarity s is met with chance(s, depth), so each one that was found stands for
    1 / chance(s, depth) that there are. Clusters are verified whole, which finds more, so the estimate is on the safe
    side. At the shortest prefix, the chance at the threshold itself is 1 - 10^-6.
    """
    edges = prefix_links(nodes)
    for depth in range(DEPTH, LEAST_DEPTH - 1, -1):
        found = verified(source, nodes.drop("signature"), edges.where(F.col("depth") >= depth).select("a", "b"), similarity, depth)
        if depth == LEAST_DEPTH or chance(similarity, depth) >= recall:
            break
        have, expected = found.agg(F.sum("text_links"), F.sum("expected")).first()
        if have is not None and have >= recall * expected:
            break
    return found


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: id, text_key, class_id, n_copies, n_links; see labelled()."""
    return labelled(docs, similarity, recall, id_col).drop("label")


def labelled(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: id, text_key, class_id, n_copies, n_links, label.

    Texts with the same set of five-word shingles are copies. Sets whose signature prefixes meet in a tree are put in
    one cluster; within a cluster all pairs of sets are compared exactly, larger clusters in pairs of blocks that are
    dealt over tasks, and without a row for each pair. class_id is the least id of those that copies and links connect,
    n_copies the number of documents with this set, n_links the number of other documents whose set has the similarity
    (copies included). Prefixes are shortened until the estimated share of links that are found is recall.

    Null or wordless texts have no links; each is its own class. A null id stays null, and a class of null ids only has
    a null class_id; ids may repeat, so classes are told apart by label, which is null without words only. Repeated rows are copies of each other. Other columns aren't read. No rows: no rows.
    """
    source = docs.select(F.col(id_col).alias("id"), "text")
    keyed = source.withColumn("text_key", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    signed = materialise(sign(keyed), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    nodes = materialise(nodes, "nodes")
    found = links_of(source, nodes, similarity, recall)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("leader").alias("a"), F.col("node").alias("b")))
    classes = groups.join(nodes.select("node", "first_id"), "node").groupBy("label").agg(F.min("first_id").alias("class_id"))
    classes = groups.join(classes, "label").select("node", "label", "class_id")
    about = nodes.select("node", "copies", "first_id").join(classes, "node", "left").join(links, "node", "left")
    about = materialise(about.select("node", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    return signed.select("id", "text_key", "node").join(about, "node", "left").select(
        F.col("id").alias(id_col), "text_key", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), "label",
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id") -> DataFrame:
    """One document of each group of near-duplicates: the one with its least id, of these the one whose text has the
    least digest; a null id counts as the greatest. Columns stay as they are, however they are named.

    Where rows repeat an id and a text, one of them stays, so wordless rows stay unless they repeat both.
    """
    found = materialise(labelled(docs, similarity, id_col=id_col).withColumnRenamed(id_col, "id"), "near-duplicates")
    alone = found.where("n_copies = 1 and n_links = 0").select("id", "text_key")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key"))
    # Classes may share class_id, as null and repeated ids do, but not the label. Only rows with the class's id can be least.
    of_class = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("n_copies") + F.col("n_links") > 1)
    chosen = found.where(of_class).groupBy("label").agg(least.alias("least")).select("least.id", "least.text_key")
    keep = alone.unionByName(chosen).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("text_key"))
    kept = rows.join(keep, rows["id"].eqNullSafe(keep["id"]) & (rows["text_key"] == keep["text_key"]), "left_semi")
    unique = found.groupBy("id", "text_key").count().where("count > 1").isEmpty()
    return (kept if unique else kept.dropDuplicates(["id", "text_key"])).select("row.*")
