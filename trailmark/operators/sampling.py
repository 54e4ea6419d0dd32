"""Minibatches without a global shuffle, by permuting row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: a prime below 2^31, a factor, rounds, and steps of the walk back into range.
PRIME, FACTOR, ROUNDS, WALK = 2_147_483_647, 48_271, 4, 64


def scrambled(value: Column, seed: int, turn: int) -> Column:
    """A number below PRIME that looks unlike its neighbours'; exact in 64 bits for values below 2^31."""
    first = F.pmod(value * (FACTOR + 2 * turn) + (seed % PRIME + turn * 7_919), F.lit(PRIME))
    return F.pmod(first * F.pmod(first + (turn + 1) * 104_729, F.lit(65_537)), F.lit(PRIME))


def permuted(rank: Column, n: int, seed: int) -> Column:
    """A place from 0 to n - 1 for each rank from 0 to n - 1, each place once, drawn by the seed.

    A Feistel network on a grid of about sqrt(n) by sqrt(n) places, whose halves are added to in turn; the few places
    beyond n are walked through until one is within (at most as many steps as there are places beyond: under sqrt(n))."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))

    def once(x: Column) -> Column:
        # Each half is a field of a struct that the rounds pass on, so that no expression is repeated.
        halves = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).alias("r"))

        def turn(s: Column, k: Column) -> Column:
            left = F.struct(*[F.pmod(s["l"] + _pick(s["r"], k, seed, 0), F.lit(a)).alias("l"), s["r"].alias("r")])
            return F.transform(F.array(left), lambda h: F.struct(h["l"].alias("l"), F.pmod(h["r"] + _pick(h["l"], k, seed, 1), F.lit(b)).alias("r")))[0]

        mixed = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda s: s["l"] * b + s["r"])
        return mixed.cast("long")

    first = F.transform(F.array(rank.cast("long")), once)[0]
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("no place within range")).cast("long"))


def _pick(value: Column, k: Column, seed: int, side: int) -> Column:
    """The scrambled value of a round that is only known by its number."""
    out = scrambled(value, seed, side)
    for turn in range(1, ROUNDS):
        out = F.when(k == turn, scrambled(value, seed, 2 * turn + side)).otherwise(out)
    return out


def ranked(df: DataFrame, order: str, bucket: float, name: str = "rank") -> DataFrame:
    """Rows with rank: their place, from 0, in the order of a number without nulls or repeats.

    Only buckets (lengths of the order) are sorted, each in a task, and counted; the counts, one row a bucket, are summed
    up in one. Choose a bucket of some ten thousand rows."""
    dealt = df.withColumn("_bucket", F.floor(F.col(order) / bucket))
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(order)) - 1
    return dealt.withColumn("_own", own).join(before, "_bucket").withColumn(name, F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before")


def minibatches(rows: DataFrame, n: int, size: int, epochs: int, seed: int = 0) -> DataFrame:
    """Rows with epoch, place and batch: each row once an epoch, in batches of `size` (the last may be smaller), shuffled.

    rows have rank, from 0 to n - 1. Nothing is sorted or shuffled: a row's place is computed from its rank."""
    if size < 1:
        raise ValueError("a batch has one row at least")
    size, each = min(size, max(1, n)), []
    for epoch in range(epochs):
        place = permuted(F.col("rank"), n, seed + 1_000_003 * epoch)
        each.append(F.struct(F.lit(epoch).alias("epoch"), place.alias("place")))
    spread = rows.select("*", F.inline(F.array(*each)))
    return spread.withColumn("batch", F.floor(F.col("place") / size))


def draws(rows: DataFrame, n: int, size: int, batches: int, seed: int = 0) -> DataFrame:
    """Rows with batch and times: `batches` batches of min(size, n) draws each, with replacement; a row that a batch doesn't
    draw has no row there. rows have rank, from 0 to n - 1. Draws are made where their numbers are, then meet their rows."""
    many = min(size, n)
    # A draw's number, scrambled in two halves, as 62 bits modulo n.
    drawn = rows.sparkSession.range(batches * many).withColumn("batch", F.floor(F.col("id") / F.lit(max(1, many))))
    low, high = F.pmod(F.col("id"), F.lit(PRIME)), F.floor(F.col("id") / PRIME).cast("long")
    number = scrambled(low + high, seed, 1) * PRIME + scrambled(low, seed, 2)
    times = drawn.withColumn("rank", F.pmod(number, F.lit(max(1, n)))).groupBy("batch", "rank").agg(F.count("*").alias("times"))
    return rows.join(times, "rank")
