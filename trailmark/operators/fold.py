"""Sequential folds over ordered sequences whose state doesn't fit a window function.

Rows are dealt by key and sorted within partitions, and a task walks its partition batch by batch with one state at a
time: no sequence is collected, and a key larger than memory is still one pass. A key is one task, as each row needs
the state that the row before it left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain, pairwise
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequences that a task of fold_abreast() walks at once, about.
ABREAST = 512

Step = Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame]]


def fold(df: DataFrame, keys: list[str], order: list[Any], step: Step, schema: str) -> DataFrame:
    """Apply step(state, rows) -> (state, output rows) to consecutive rows of each key; the state starts as None.

    A key's rows may come in several pieces; step must give the same output however they are cut. No rows: no rows.
    Null keys form one sequence.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for batch in batches:
            changed = pd.Series(False, index=batch.index)
            for k in keys:
                before = batch[k].shift()
                changed |= (batch[k] != before) & ~(batch[k].isna() & before.isna())
            for _, rows in batch.groupby(changed.cumsum(), sort=False):
                key = tuple(None if pd.isna(v) else v for v in rows[keys].iloc[0])
                if key != current:
                    current, state = key, None
                state, out = step(state, rows.reset_index(drop=True))
                if len(out):
                    yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def fold_abreast(df: DataFrame, keys: list[str], order: list[Any], ends: Column, start: Callable[[], Any], step: Callable[[Any, dict[str, np.ndarray]], list[dict[str, Any]]], schema: str) -> DataFrame:
    """A fold that takes many sequences through the same turn at once, so that a step's work is on arrays over sequences.

    A turn of a sequence is a row for which ends is 1 and the rows before it for which it is 0 (those before the first
    end belong to the second turn). Keys are dealt by hash to groups of about ABREAST; a group is one state, made by
    start(), and its rows come turn by turn, in a turn by key and order. step(state, rows) changes the state and gives
    pieces of output, as columns. rows: columns by name as arrays, `slot` (a key's number in its group) and `turn` among
    them. A task holds one state and one turn. The keys are counted first, as the number of groups follows from it.
    """
    many = df.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    group = F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(max(1, math.ceil(many / ABREAST))))
    dealt = df.withColumn("_group", group).withColumn("_ends", ends).repartition("_group")
    each = Window.partitionBy("_group", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("_ends") == 1, F.sum("_ends").over(each)).otherwise(F.greatest(F.sum("_ends").over(each) + 1, F.lit(2)))
    numbered = dealt.withColumn("turn", turn).withColumn("slot", F.dense_rank().over(Window.partitionBy("_group").orderBy(*keys)) - 1).drop("_ends")
    names = [part.strip().split(" ")[0].strip("`") for part in schema.split(",")]
    numbers = {part.strip().split(" ")[0].strip("`") for part in schema.split(",") if part.strip().endswith(" double")}

    def filled(piece: dict[str, Any], name: str, n: int) -> np.ndarray:
        value = piece.get(name)
        if isinstance(value, np.ndarray):
            return value
        return np.full(n, np.nan if value is None else value, float) if name in numbers else np.full(n, value, object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, held = None, None, []
        for batch in chain(batches, [None]):
            if batch is not None and not len(batch):
                continue
            place = None if batch is None else [tuple(batch[["_group", "turn"]].iloc[i]) for i in (0, -1)]
            goes_on = bool(place) and bool(held) and place[0] == place[1] == tuple(held[-1][["_group", "turn"]].iloc[-1])
            held += [batch] if batch is not None else []
            if goes_on or not held:
                continue
            rows = pd.concat(held, ignore_index=True)
            columns = {c: rows[c].to_numpy() for c in rows.columns}
            g, turns = columns["_group"], columns["turn"]
            cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (turns[1:] != turns[:-1])) + 1), len(rows)]
            held = []
            if batch is not None:  # the last turn may go on
                held, cuts = [rows.iloc[cuts[-2] :]], cuts[:-1]
            out: list[dict[str, Any]] = []
            for a, b in pairwise(cuts):
                if g[a] != current:
                    current, state = g[a], start()
                out += step(state, {c: v[a:b] for c, v in columns.items()})
            sizes = [len(piece[keys[0]]) for piece in out]
            if sum(sizes):
                yield pd.DataFrame({c: np.concatenate([filled(piece, c, n) for piece, n in zip(out, sizes, strict=True)]) for c in names})

    return numbered.sortWithinPartitions("_group", "turn", "slot", *order).mapInPandas(run, schema)
