"""Prefix scans of ordered sequences by an associative operation, over many tasks for one sequence.

What a row does to the state before it is an element: some numbers, such as a turn, an affine map, or where each of a
few states leads. Two elements one after the other make one. A sequence is parted into buckets: tasks reduce each to its
element, one small pass gives every bucket what came before it, and tasks scan their bucket from there. Within a task a
batch is scanned by doubling steps on whole arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: combine(earlier, later) of arrays (n, width) of elements.
Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]


def running(elements: np.ndarray, combine: Combine) -> np.ndarray:
    """Each element together with all before it."""
    out, step = elements.copy(), 1
    while step < len(out):
        out[step:] = combine(out[:-step], out[step:])
        step *= 2
    return out


#: Rows that are scanned together: a result depends on its sequence's rows, not on how batches cut them.
BLOCK = 32


class Runner:
    """Prefixes of sequences that follow one another in batches; each sequence begins with the identity.

    A sequence is cut into blocks, counted from its first row. Blocks of all sequences of a batch are scanned at once, by
    doubling; then what came before each is passed on from block to block, of all sequences at once. The state is what
    came before the last sequence's current block, and that block's elements so far.
    """

    def __init__(self, identity: list[float], combine: Combine) -> None:
        self.first, self.combine = np.array([identity], float), combine
        self.carry, self.pending = self.first, self.first[:0]

    def feed(self, elements: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The prefixes of a batch's rows; starts: whether a row begins a sequence."""
        if not len(elements):
            return elements
        if starts[0]:
            self.carry, self.pending = self.first, self.first[:0]
        held, width = len(self.pending), elements.shape[1]
        every = np.concatenate([self.pending, elements])
        begins = np.concatenate([np.zeros(held, bool), starts])
        begins[0] = True
        firsts = np.flatnonzero(begins)
        lengths = np.diff(np.append(firsts, len(every)))
        place = np.arange(len(every)) - np.repeat(firsts, lengths)
        blocks = -(-lengths // BLOCK)
        offset = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        at, inside = np.repeat(offset, lengths) + place // BLOCK, place % BLOCK
        grid = np.tile(self.first, (int(blocks.sum()), int(inside.max()) + 1, 1))
        grid[at, inside] = every
        step, (many, long, _) = 1, grid.shape
        while step < long:
            grid[:, step:] = self.combine(grid[:, :-step].reshape(-1, width), grid[:, step:].reshape(-1, width)).reshape(many, -1, width)
            step *= 2
        carries = np.tile(self.first, (many, 1))
        carries[0] = self.carry[0]
        for k in range(1, int(blocks.max())):
            own = offset[blocks > k] + k
            carries[own] = self.combine(carries[own - 1], grid[own - 1, -1])
        found = self.combine(carries[at], grid[at, inside])
        left = int(lengths[-1]) % BLOCK
        self.carry, self.pending = (carries[-1:], every[len(every) - left :]) if left else (found[-1:], self.first[:0])
        return found[held:]


def sequence_starts(batch: pd.DataFrame, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Whether each row begins a new key, given the key of the row before the batch; and the last row's key. Nulls are equal."""
    changed = np.zeros(len(batch), bool)
    for k in keys:
        now, before = batch[k], batch[k].shift()
        changed |= ((now != before) & ~(now.isna() & before.isna())).to_numpy(bool)
    ends = [tuple(None if pd.isna(v) else v for v in batch[keys].iloc[i]) for i in (0, -1)]
    changed[0] = ends[0] != last
    return changed, ends[1]


def prefix_scan(df: DataFrame, keys: list[str], order: list[str], element: list[Column], combine: Combine, identity: list[float], names: list[str], bucket: float | None = None) -> DataFrame:
    """Rows with names: their element together with all before it in their key's order, as doubles.

    order: columns, ascending. With a bucket, a length of the first, which is then a number without nulls, a key is many
    tasks: the rows are read twice (write them first if they are dear to make), and one row for some thousand goes
    through one task a key. Choose a bucket of some ten thousand rows. Without one, a key is one task. The operation must
    be associative but for rounding. Null keys form one sequence.
    """
    inner = [f"_e{i}" for i in range(len(element))]
    rows = df.withColumns(dict(zip(inner, (e.cast("double") for e in element), strict=True)))
    own = df.columns
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    made = ", ".join(f"`{n}` double" for n in names)

    def dealt(frame: DataFrame, by: list[str], sort: list[str]) -> DataFrame:
        return frame.repartition(*by).sortWithinPartitions(*by, *sort)

    def scanned(by: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            runner, last = Runner(identity, combine), None
            for batch in batches:
                if len(batch):
                    starts, last = sequence_starts(batch, by, last)
                    found = pd.DataFrame(runner.feed(batch[inner].to_numpy(float), starts), columns=names)
                    out = pd.concat([batch[own].reset_index(drop=True), found], axis=1)
                    yield out[batch["_tag"].to_numpy() == 1] if "_tag" in batch else out

        return run

    if bucket is None:
        return dealt(rows, keys, order).mapInPandas(scanned(keys), f"{kept}, {made}")
    parted = rows.withColumn("_bucket", F.floor(F.col(order[0]) / bucket))
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    numbers = ", ".join(f"`{n}` double" for n in inner)
    by = [*keys, "_bucket"]

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each bucket's rows of a batch: their element, the batch's number, and whether the bucket begins there."""
        last = None
        for number, batch in enumerate(batches):
            if len(batch):
                starts, last = sequence_starts(batch, by, last)
                begins = starts.copy()
                begins[0] = True
                ends = np.append(np.flatnonzero(begins)[1:], len(batch)) - 1
                found = Runner(identity, combine).feed(batch[inner].to_numpy(float), begins)[ends]
                out = batch[by].iloc[np.flatnonzero(begins)].reset_index(drop=True).assign(_place=number, _first=starts[begins])
                yield pd.concat([out, pd.DataFrame(found, columns=inner)], axis=1)

    def before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What came before each bucket."""
        runner, last, held = Runner(identity, combine), None, None
        for batch in batches:
            if len(batch):
                starts, last = sequence_starts(batch, keys, last)
                found = runner.feed(batch[inner].to_numpy(float), starts)
                entry = np.concatenate([runner.first if held is None else held, found[:-1]])
                entry[starts] = runner.first
                held = found[-1:]
                yield pd.concat([batch[by].reset_index(drop=True), pd.DataFrame(entry, columns=inner)], axis=1)[batch["_first"].to_numpy(bool)]

    sums = dealt(parted.select(*by, *order, *inner), by, order).mapInPandas(reduce, f"{types}, _bucket long, _place long, _first boolean, {numbers}")
    entries = dealt(sums, keys, ["_bucket", "_place"]).mapInPandas(before, f"{types}, _bucket long, {numbers}")
    # What came before a bucket is its first row.
    spare = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name not in keys]
    lead = entries.select(*keys, *spare, *inner, "_bucket", F.lit(0).alias("_tag"))
    return dealt(lead.unionByName(parted.withColumn("_tag", F.lit(1))), by, ["_tag", *order]).mapInPandas(scanned(by), f"{kept}, {made}")


def turns(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of quaternions (n, 4: x, y, z, w)."""
    (ax, ay, az, aw), (bx, by, bz, bw) = a.T, b.T
    return np.stack([aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz], axis=1)


def turned(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Vectors (n, 3) turned by unit quaternions."""
    (x, y, z, w), (a, b, c) = q.T, v.T
    e, f, g = 2 * (y * c - z * b), 2 * (z * a - x * c), 2 * (x * b - y * a)
    return np.stack([a + w * e + y * g - z * f, b + w * f + z * e - x * g, c + w * g + x * f - y * e], axis=1)


def affine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Maps x -> factor x + shift (n, 2), the earlier one applied first."""
    return np.stack([a[:, 0] * b[:, 0], b[:, 0] * a[:, 1] + b[:, 1]], axis=1)


def paths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where each of a few states leads (n, states)."""
    return np.take_along_axis(b, a.astype(int), axis=1)


def motions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Turn, change of speed and way, seen from where the first began, and time (n, 4 + 3 + 3 + 1)."""
    q = turns(a[:, :4], b[:, :4])
    q /= np.sqrt((q * q).sum(axis=1, keepdims=True))
    speed = a[:, 4:7] + turned(a[:, :4], b[:, 4:7])
    way = a[:, 7:10] + a[:, 4:7] * b[:, 10:] + turned(a[:, :4], b[:, 7:10])
    return np.concatenate([q, speed, way, a[:, 10:] + b[:, 10:]], axis=1)


def motions_since(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """motions(), and the time of the first (n, 12; none for the identity)."""
    return np.column_stack([motions(a[:, :11], b[:, :11]), np.where(np.isnan(a[:, 11]), b[:, 11], a[:, 11])])
