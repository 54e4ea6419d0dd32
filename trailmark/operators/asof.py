"""As-of, interpolating and interval joins of time series, by union and window within each key.

Every function takes the key columns that part independent sequences, so that nothing sorts a whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _brackets(source: DataFrame, target: DataFrame, keys: list[str], t: str, closed: bool, bucket: float | None = None) -> DataFrame:
    """Source rows with prev and next: the target rows around them as structs.

    closed: a target at the same time is both prev and next; otherwise it is next only. Both are running values, in time
    order and against it, so a sequence is one sorted pass. With a bucket (a length of time) a sequence is parted: each
    bucket is sorted alone and takes what lies beyond its ends from a table of one row for each bucket, so that one hot
    sequence is many tasks. Choose a bucket that holds some thousand rows.
    """
    columns = [c for c in target.columns if c not in keys]
    shared = [F.col(t).alias("_t"), *([F.floor(F.col(t) / bucket).alias("_bucket")] if bucket else [])]
    left = source.select(*keys, *shared, F.lit(0).alias("_tag"), F.struct(*source.columns).alias("_s"), F.lit(None).cast(target.select(F.struct(*columns)).schema[0].dataType).alias("_u"))
    right = target.select(*keys, *shared, F.lit(1).alias("_tag"), F.lit(None).cast(source.select(F.struct(*source.columns)).schema[0].dataType).alias("_s"), F.struct(*columns).alias("_u"))
    parted = [*keys, "_bucket"] if bucket else keys
    before = Window.partitionBy(*parted).orderBy("_t", F.desc("_tag") if closed else F.asc("_tag")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*parted).orderBy(F.desc("_t"), F.desc("_tag")).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).select("*", F.last("_u", True).over(before).alias("prev"), F.last("_u", True).over(after).alias("next"))
    found = both.where("_tag = 0")
    if not bucket:
        return found.select("_s.*", "prev", "next")
    ends = left.unionByName(right).groupBy(*parted).agg(F.max_by("_u", F.when(F.col("_tag") == 1, F.col("_t"))).alias("_last"), F.min_by("_u", F.when(F.col("_tag") == 1, F.col("_t"))).alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = ends.select(*parted, F.last("_last", True).over(earlier).alias("_earlier"), F.last("_first", True).over(later).alias("_later"))
    same = [found[c].eqNullSafe(beyond[c]) for c in parted]
    return found.join(beyond, same, "left").select(found["_s"], F.coalesce("prev", "_earlier").alias("prev"), F.coalesce("next", "_later").alias("next")).select("_s.*", "prev", "next")


def nearest(source: DataFrame, target: DataFrame, keys: list[str], t: str = "t", tie: str = "next", bucket: float | None = None) -> DataFrame:
    """Source rows with `near`, the target row nearest in time, and `gap`; of two equally near the next, or the previous."""
    found = _brackets(source, target, keys, t, tie == "prev", bucket)
    to_prev, to_next = F.abs(F.col(t) - F.col(f"prev.{t}")), F.abs(F.col(f"next.{t}") - F.col(t))
    closer = to_prev < to_next if tie == "next" else to_prev <= to_next
    use_prev = F.col("next").isNull() | (F.col("prev").isNotNull() & closer)
    return found.withColumn("near", F.when(use_prev, F.col("prev")).otherwise(F.col("next"))).drop("prev", "next").withColumn("gap", F.abs(F.col(t) - F.col(f"near.{t}")))


def match_nearest(source: DataFrame, target: DataFrame, keys: list[str], tolerance: float, source_id: str, target_id: str, t: str = "t", bucket: float | None = None) -> DataFrame:
    """One-to-one nearest matches within a closed tolerance: each target keeps its closest source, and losers stay unmatched."""
    near = nearest(source, target, keys, t, bucket=bucket).where(F.col("gap") <= tolerance)
    rank = F.row_number().over(Window.partitionBy(*keys, F.col(f"near.{target_id}")).orderBy("gap", source_id))
    return near.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def unmatched_ranges(source: DataFrame, matched: DataFrame, keys: list[str], source_id: str, t: str = "t") -> DataFrame:
    """keys, t_first, t_last, n for each run of consecutive source rows that are not matched."""
    flagged = source.join(matched.select(*keys, source_id).withColumn("_hit", F.lit(True)), [*keys, source_id], "left").withColumn("_miss", F.col("_hit").isNull())
    return runs(flagged, keys, "_miss", [t, source_id], t).where("state").select(*keys, "t_first", "t_last", "n")


def runs(df: DataFrame, keys: list[str], state: str, order: list[str], t: str = "t") -> DataFrame:
    """keys, state, t_first, t_last, n for each run of consecutive rows with the same state (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    start = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    grouped = df.withColumn("_start", start).withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_run").agg(F.first(state).alias("state"), F.min(t).alias("t_first"), F.max(t).alias("t_last"), F.count("*").alias("n"))


def interpolate(source: DataFrame, target: DataFrame, keys: list[str], values: list[str], t: str = "t", bucket: float | None = None) -> DataFrame:
    """Source rows with each value of the target interpolated linearly at their time, clamped outside the target's range,
    and in_range."""
    found = _brackets(source.select(*keys, *[c for c in source.columns if c not in keys and c not in values]), target.select(*keys, t, *values), keys, t, True, bucket)
    span = F.col(f"next.{t}") - F.col(f"prev.{t}")
    weight = F.when(span > 0, (F.col(t) - F.col(f"prev.{t}")) / span).otherwise(F.lit(0.0))

    def lerp(value: str) -> Column:
        a, b = F.col(f"prev.{value}"), F.col(f"next.{value}")
        return F.when(F.col("prev").isNull(), b).when(F.col("next").isNull(), a).otherwise(a + weight * (b - a))

    return found.select("*", *[lerp(v).alias(v) for v in values], (F.col("prev").isNotNull() & F.col("next").isNotNull()).alias("in_range")).drop("prev", "next")


def slerp(a: list[Column], b: list[Column], weight: Column) -> list[Column]:
    """Shortest-arc spherical interpolation between unit quaternions; linear where they nearly meet."""
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    flat = F.sin(angle) < 1e-9
    wa = F.when(flat, 1 - weight).otherwise(F.sin((1 - weight) * angle) / F.sin(angle))
    wb = F.when(flat, weight).otherwise(F.sin(weight * angle) / F.sin(angle)) * sign
    out = [wa * x + wb * y for x, y in zip(a, b, strict=True)]
    norm = F.sqrt(sum((x * x for x in out), F.lit(0.0)))
    return [x / norm for x in out]


def interpolate_rotation(source: DataFrame, target: DataFrame, keys: list[str], t: str = "t", bucket: float | None = None) -> DataFrame:
    """Source rows with the target's orientation (qx, qy, qz, qw) at their time."""
    names = ["qx", "qy", "qz", "qw"]
    found = _brackets(source.select(*keys, *[c for c in source.columns if c not in keys and c not in names]), target.select(*keys, t, *names), keys, t, True, bucket)
    span = F.col(f"next.{t}") - F.col(f"prev.{t}")
    weight = F.when(span > 0, (F.col(t) - F.col(f"prev.{t}")) / span).otherwise(F.lit(0.0))
    a, b = ([F.coalesce(f"{x}.{n}", f"{y}.{n}") for n in names] for x, y in (("prev", "next"), ("next", "prev")))
    return found.select("*", *[x.alias(n) for n, x in zip(names, slerp(a, b, weight), strict=True)]).drop("prev", "next")


def latest(source: DataFrame, target: DataFrame, keys: list[str], value: str, default: float = 0.0, t: str = "t", bucket: float | None = None) -> DataFrame:
    """Source rows with the target's latest value at or before their time; `default` before the first."""
    found = _brackets(source, target.select(*keys, t, value), keys, t, True, bucket)
    return found.withColumn(value, F.coalesce(f"prev.{value}", F.lit(default))).drop("prev", "next")


def first_at_or_after(measurements: DataFrame, steps: DataFrame, keys: list[str], t: str = "t", bucket: float | None = None) -> DataFrame:
    """Measurements with step_t, the first step at or after them; those after the last step go."""
    found = _brackets(measurements, steps.select(*keys, t), keys, t, False, bucket)
    return found.withColumn("step_t", F.col(f"next.{t}")).drop("prev", "next").where("step_t is not null")


def in_windows(points: DataFrame, windows: DataFrame, keys: list[str], width: float, t: str = "t", lower: str = "lo", upper: str = "hi") -> DataFrame:
    """Pairs of windows and the points in them (both ends closed), joined by equal time buckets of `width`.

    Each window is repeated for the buckets it touches, so choose a width of about the windows' length.
    """
    bucketed = points.withColumn("_bucket", F.floor(F.col(t) / width))
    spread = windows.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lower) / width), F.floor(F.col(upper) / width))))
    return spread.join(bucketed, [*keys, "_bucket"]).where((F.col(t) >= F.col(lower)) & (F.col(t) <= F.col(upper))).drop("_bucket")
