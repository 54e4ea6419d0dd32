"""Ordered-sequence operators within keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trailmark.functions import geometry


def previous(df: DataFrame, keys: list[str], order: str | list[str], columns: list[str], bucket: float | None = None) -> DataFrame:
    """Rows with prev: the row before it in its key, as a struct of these columns; null for the first.

    Without a bucket a key is one task. With one (a length of the first of order, which is then a number), each bucket of
    a key is sorted alone, and its first row takes the last of the bucket before it from a table of one row a bucket.
    Equal orders go in any order."""
    order = [order] if isinstance(order, str) else order
    kept = F.struct(*columns)
    if bucket is None:
        return df.withColumn("prev", F.lag(kept).over(Window.partitionBy(*keys).orderBy(*order)))
    parted = [*keys, "_bucket"]
    dealt = df.withColumn("_bucket", F.floor(F.col(order[0]) / bucket))
    ends = dealt.groupBy(*parted).agg(F.max_by(kept, F.struct(*order)).alias("_end"))
    ends = ends.select(*parted, F.lag("_end").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_end"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in parted]
    own = dealt.withColumn("prev", F.lag(kept).over(Window.partitionBy(*parted).orderBy(*order)))
    both = own.alias("l").join(ends.alias("r"), same, "left")
    return both.select(*[F.col(f"l.{c}") for c in df.columns], F.coalesce("prev", "_end").alias("prev"))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: float | None = None, name: str = "running") -> DataFrame:
    """Rows with the sum of a value up to and with them, nulls as 0. With a bucket (a length of the first of order, a number)
    buckets are summed alone and take what was before them from a table of one row a bucket, so that a key is many tasks."""
    amount = F.coalesce(F.col(value), F.lit(0.0))
    upto = Window.unboundedPreceding, 0
    if bucket is None:
        return df.withColumn(name, F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)))
    parted = [*keys, "_bucket"]
    dealt = df.withColumn("_bucket", F.floor(F.col(order[0]) / bucket))
    sums = dealt.groupBy(*parted).agg(F.sum(amount).alias("_sum"))
    sums = sums.select(*parted, F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    own = dealt.withColumn(name, F.sum(amount).over(Window.partitionBy(*parted).orderBy(*order).rowsBetween(*upto)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in parted]
    return own.alias("l").join(sums.alias("r"), same).select(*[F.col(f"l.{c}") for c in df.columns], (F.col(f"l.{name}") + F.col("r._before")).alias(name))


def velocity(df: DataFrame, keys: list[str], value: str, order: list[str], t: str = "t") -> DataFrame:
    """Forward difference; the last row repeats the one before, a lone row has 0; steps of no time count as 1e-9."""
    w = Window.partitionBy(*keys).orderBy(*order)

    def rate(a: Column, b: Column, ta: Column, tb: Column) -> Column:
        return (b - a) / F.when(tb > ta, tb - ta).otherwise(1e-9)

    x, now = F.col(value), F.col(t)
    ahead, back = rate(x, F.lead(x).over(w), now, F.lead(now).over(w)), rate(F.lag(x).over(w), x, F.lag(now).over(w), now)
    return df.withColumn("velocity", F.when(F.lead(now).over(w).isNotNull(), ahead).when(F.lag(now).over(w).isNotNull(), back).otherwise(0.0))


def cumulative_distance(df: DataFrame, keys: list[str], axes: list[str], order: list[str]) -> DataFrame:
    """Running sum of the distances between consecutive rows, 0 at the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in axes), F.lit(0.0)))
    return df.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("distance", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def normalised_weight(df: DataFrame, value: str, within: WindowSpec) -> DataFrame:
    """Each row's share of the sum within the window; 0 where the sum is."""
    total = F.sum(value).over(within)
    return df.withColumn("weight", F.when(total > 1e-9, F.col(value) / total).otherwise(0.0))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key in that order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def ego_motion(df: DataFrame, keys: list[str], order: list[str], position: list[str], quaternion: list[str], t: str = "t") -> DataFrame:
    """Each row but the last of a sequence, with forward, left, up (the way to the next row, seen from this one), the
    rotation vector rx, ry, rz to it, and dt. Quaternions have length one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead = df.withColumns({f"_n{i}": F.lead(c).over(w) for i, c in enumerate([*position, *quaternion, t])})
    q = [F.col(c) for c in quaternion]
    way = geometry.rotate_back(q, [F.col(f"_n{i}") - F.col(c) for i, c in enumerate(position)])
    turn = geometry.rotation_vector(geometry.multiply([-q[0], -q[1], -q[2], q[3]], [F.col(f"_n{3 + i}") for i in range(4)]))
    made = ahead.where("_n7 is not null").withColumns(dict(zip(["forward", "left", "up", "rx", "ry", "rz"], [*way, *turn], strict=True)) | {"dt": F.col("_n7") - F.col(t)})
    return made.drop(*[f"_n{i}" for i in range(8)])


#: Fixed: the weight of the first state, of mean 0 and variance 1, and what is added to a variance.
FIRST_COUNT, SLACK = 1e-4, 1e-8


def running_norm(df: DataFrame, keys: list[str], value: str, state: DataFrame | None = None) -> DataFrame:
    """keys, count, mean, var: a running normaliser after these rows, begun from a state (the first one if there is none).

    States merge by counts, so batches may come in any order or at once."""
    seen = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    begun = seen.join(state.select(*keys, "count", "mean", "var"), keys, "full") if state is not None else seen.withColumns({c: F.lit(None).cast("double") for c in ("count", "mean", "var")})
    n0, m0, v0 = F.coalesce("count", F.lit(FIRST_COUNT)), F.coalesce("mean", F.lit(0.0)), F.coalesce("var", F.lit(1.0))
    n, m, v = F.coalesce("_n", F.lit(0)), F.coalesce("_m", m0), F.coalesce("_v", F.lit(0.0))
    total, delta = n0 + n, m - m0
    return begun.select(*keys, total.alias("count"), (m0 + delta * n / total).alias("mean"), ((v0 * n0 + v * n + delta * delta * n0 * n / total) / total).alias("var"))


def normalise(df: DataFrame, state: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with normal: the value less the state's mean, by its standard deviation."""
    joined = df.join(state.select(*keys, F.col("mean").alias("_mean"), F.col("var").alias("_var")), keys)
    return joined.withColumn("normal", (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + SLACK)).drop("_mean", "_var")
