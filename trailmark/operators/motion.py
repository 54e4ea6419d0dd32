"""Motion from ordered poses and inertial samples."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators import scan, sequences
from trailmark.operators.asof import _brackets, interpolate, latest, nearest
from trailmark.operators.fold import fold


def resample(grid: DataFrame, trajectory: DataFrame, keys: list[str], values: list[str], t: str = "t", bucket: float | None = None) -> DataFrame:
    """Grid rows with the trajectory's values, confidence and health at their times, and in_range.

    Values are interpolated and clamped; confidence is interpolated and clipped to 0..1; health is that of the nearest
    row, of two equally near the earlier. Outside the trajectory's range confidence is 0 and health INVALID. With a bucket
    (a length of time) a sequence is many tasks.
    """
    names = [*values, "confidence", "health"]
    found = _brackets(grid.select(*[c for c in grid.columns if c not in names]), trajectory.select(*keys, t, *names), keys, t, closed=True, bucket=bucket)
    inside = F.col("prev").isNotNull() & F.col("next").isNotNull()
    to_prev, to_next = F.col(t) - F.col(f"prev.{t}"), F.col(f"next.{t}") - F.col(t)
    span = to_prev + to_next
    weight = F.when(span > 0, to_prev / span).otherwise(0.0)

    def lerp(name: str) -> Column:
        a, b = F.col(f"prev.{name}"), F.col(f"next.{name}")
        return F.when(F.col("prev").isNull(), b).when(F.col("next").isNull(), a).otherwise(a + weight * (b - a))

    confidence = F.when(inside, F.least(F.greatest(lerp("confidence"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    health = F.when(inside, F.when(to_prev <= to_next, F.col("prev.health")).otherwise(F.col("next.health"))).otherwise("INVALID")
    return found.select("*", *[lerp(v).alias(v) for v in values], confidence.alias("confidence"), health.alias("health"), inside.alias("in_range")).drop("prev", "next")


def mean_in_windows(points: DataFrame, windows: DataFrame, keys: list[str], value: str, width: float, window_id: str, t: str = "t", bucket: float | None = None) -> DataFrame:
    """Windows (lo, hi, both closed) with the mean of the points in them; the point nearest their middle where there is none."""
    from trailmark.operators.asof import in_windows

    means = in_windows(points.select(*keys, t, value), windows.select(*keys, window_id, "lo", "hi"), keys, width, t).groupBy(*keys, window_id).agg(F.avg(value).alias("_mean"))
    middle = windows.withColumn(t, (F.col("lo") + F.col("hi")) / 2)
    near = nearest(middle, points.select(*keys, t, value), keys, t, tie="prev", bucket=bucket)
    return near.join(means, [*keys, window_id], "left").withColumn(value, F.coalesce("_mean", f"near.{value}")).drop("_mean", "near", "gap", t)


def ramp_offsets(poses: DataFrame, cues: DataFrame, keys: list[str], t: str = "t", bucket: float | None = None, corrections: dict[str, str] | None = None) -> DataFrame:
    """Poses with offset: the sum of the corrections of cues (t0, t1, correction; not overlapping) that ended, and that
    part of a running cue's correction which has passed. corrections names other columns: a correction's, and its offset's.

    Equal to adding every cue to every pose, at the cost of one as-of lookup of running sums. With a bucket (a length of
    time) a sequence is many tasks.
    """
    corrections = corrections or {"correction": "offset"}
    sums = cues.select(*keys, "t0", "t1", *corrections)
    for c in corrections:
        sums = sequences.running_sum(sums, keys, ["t0"], c, bucket, f"_sum_{c}")
    sums = sums.select(*keys, F.col("t0").alias(t), "t1", *corrections, *[(F.col(f"_sum_{c}") - F.col(c)).alias(f"_sum_{c}") for c in corrections])
    found = _brackets(poses, sums, keys, t, closed=False, bucket=bucket)
    part = F.least((F.col(t) - F.col(f"prev.{t}")) / (F.col("prev.t1") - F.col(f"prev.{t}")), F.lit(1.0))
    return found.withColumns({o: F.coalesce(F.col(f"prev._sum_{c}") + part * F.col(f"prev.{c}"), F.lit(0.0)) for c, o in corrections.items()}).drop("prev", "next")


def displacement(windows: DataFrame, trajectory: DataFrame, keys: list[str], value: str, window_id: str, t: str = "t") -> DataFrame:
    """keys, window_id, and the change of an interpolated value from lo to hi."""
    ends = windows.select(*keys, window_id, F.inline(F.array(F.struct(F.lit(0).alias("_end"), F.col("lo").alias(t)), F.struct(F.lit(1).alias("_end"), F.col("hi").alias(t)))))
    at = interpolate(ends, trajectory.select(*keys, t, value), keys, [value], t)
    return at.groupBy(*keys, window_id).agg((F.max_by(value, "_end") - F.min_by(value, "_end")).alias(value))


def hopping(df: DataFrame, keys: list[str], width: float, stride: float, t: str = "t") -> DataFrame:
    """keys, win, lo, hi: full windows only, each `stride` after the one before; one of the whole span if that is shorter."""
    span = df.groupBy(*keys).agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    many = F.when(F.col("t1") - F.col("t0") > width, F.floor((F.col("t1") - F.col("t0") - width + 1e-9) / stride)).otherwise(0)
    wins = span.select(*keys, "t0", "t1", F.explode(F.sequence(F.lit(0).cast("long"), many.cast("long"))).alias("win"))
    lo = F.col("t0") + F.col("win") * F.lit(stride)
    return wins.select(*keys, "win", lo.alias("lo"), F.when(F.col("t1") - F.col("t0") > width, lo + width).otherwise(F.col("t1")).alias("hi"))


def control_windows(df: DataFrame, keys: list[str], period: float, order: list[str], t: str = "t") -> DataFrame:
    """Rows with win: a window ends before the first row that is `period` or more after its first row."""

    def step(state: Any, rows: pd.DataFrame) -> tuple[Any, pd.DataFrame]:
        win, start = state or (-1, -np.inf)
        times, out, at = rows[t].to_numpy(), np.empty(len(rows), np.int64), 0
        while at < len(times):
            if times[at] >= start + period:
                win, start = win + 1, times[at]
            end = max(at + 1, int(np.searchsorted(times, start + period)))
            out[at:end], at = win, end
        return (win, start), rows.assign(win=out)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return fold(df, keys, order, step, f"{columns}, win long")


def hysteresis_winner(scores: DataFrame, keys: list[str], methods: list[str], order: list[str], margin: float = 0.10, bucket: float | None = None) -> DataFrame:
    """Rows (one score column for each method) with winner: the best method at first, of equal ones the first in the
    alphabet; another takes over only if its score exceeds the incumbent's by more than the margin. A null score is the
    least. With a bucket (see prefix_scan) a key is many tasks: a row says where each incumbent leads."""
    names = sorted(methods)
    values = [F.coalesce(F.col(m).cast("double"), F.lit(float("-inf"))) for m in names]
    top = F.greatest(*values)
    best = F.lit(float(len(names) - 1))
    for i in reversed(range(len(names) - 1)):
        best = F.when(values[i] == top, float(i)).otherwise(best)
    # State 0 is none yet; state i + 1 is names[i].
    leads = [best + 1, *[F.when(top > v + margin, best + 1).otherwise(float(i + 1)) for i, v in enumerate(values)]]
    size = len(leads)
    found = scan.prefix_scan(scores, keys, order, leads, scan.paths, list(range(size)), [f"_s{i}" for i in range(size)], bucket)
    winner = F.element_at(F.array(*map(F.lit, names)), F.col("_s0").cast("int"))
    return found.select(*scores.columns, winner.alias("winner"))


def rotvec(v: np.ndarray) -> np.ndarray:
    """Unit quaternion (x, y, z, w) of a rotation vector."""
    angle = float(np.linalg.norm(v))
    half = 0.5 * angle
    scale = 0.5 - angle * angle / 48 if angle < 1e-6 else np.sin(half) / angle
    return np.array([*(v * scale), np.cos(half)])


def quat_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.array([*(a[3] * b[:3] + b[3] * a[:3] + np.cross(a[:3], b[:3])), a[3] * b[3] - a[:3] @ b[:3]])
    return out / np.linalg.norm(out)


def matrix(q: np.ndarray) -> np.ndarray:
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


#: What samples are, and what strapdown() and gyro_orientation() make of them.
IMU, POSE = ["ax", "ay", "az", "gx", "gy", "gz"], ["x", "y", "z", "vx", "vy", "vz", "qx", "qy", "qz", "qw"]


def sample_motion(dt: Column, sample: list[Column]) -> list[Column]:
    """Turn, change of speed, way and time of a sample that lasts dt, as scan.motions takes them."""
    g = [c * dt for c in sample[3:]]
    angle = F.sqrt(sum((c * c for c in g), F.lit(0.0)))
    k = F.when(angle < 1e-6, 0.5 - angle * angle / 48).otherwise(F.sin(angle / 2) / F.nullif(angle, F.lit(0.0)))
    return [*[c * k for c in g], F.cos(angle / 2), *[c * dt for c in sample[:3]], *[0.5 * c * dt * dt for c in sample[:3]], dt]


def strapdown(imu: DataFrame, keys: list[str], gravity: float = 9.81, degraded: tuple[float, float] = (5.0, 50.0), lost: tuple[float, float] = (10.0, 100.0), t: str = "t", bucket: float | None = None) -> DataFrame:
    """Open-loop inertial navigation from ax..gz: keys, t, position, velocity, quaternion and a health that never recovers.

    Each row is the state before its own sample is applied; steps of no time count as 1e-6 s. Health is LOST or
    DEGRADED after the given (seconds, metres) from the start. With a bucket (a length of time, see prefix_scan) a
    sequence is many tasks. Gravity is taken off at the end, so positions lose digits as its fall grows: 1e-9 m or so
    after a quarter of an hour.
    """
    before = sequences.previous(imu.select(*keys, t, *IMU), keys, t, [t, *IMU], bucket)
    dt = F.when(F.col("prev").isNull(), 0.0).when(F.col(t) > F.col(f"prev.{t}"), F.col(t) - F.col(f"prev.{t}")).otherwise(1e-6)
    steps = sample_motion(dt, [F.coalesce(F.col(f"prev.{c}"), F.lit(0.0)) for c in IMU])
    moved = [f"_m{i}" for i in range(12)]
    rows = before.select(*keys, t, *[s.alias(f"_{i}") for i, s in enumerate(steps)], F.col(t).cast("double").alias("_11"))
    found = scan.prefix_scan(rows, keys, [t], [F.col(f"_{i}") for i in range(12)], scan.motions_since, [0.0, 0, 0, 1] + [0.0] * 7 + [float("nan")], moved, bucket)
    fall = [F.lit(0.0), F.lit(0.0), F.lit(gravity)]
    time = F.col("_m10")
    values = [*[F.col(f"_m{7 + i}") - 0.5 * fall[i] * time * time for i in range(3)], *[F.col(f"_m{4 + i}") - fall[i] * time for i in range(3)], *[F.col(f"_m{i}") for i in range(4)]]
    poses = found.select(*keys, t, *[v.alias(n) for v, n in zip(values, POSE, strict=True)], (F.col(t) - F.col("_m11")).alias("_gone"))
    far = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    bad, worst = ((F.col("_gone") > s) | (far > m) for s, m in (degraded, lost))
    if bucket is None:
        worse = F.max(F.when(worst, 2).when(bad, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0))
        return poses.select(*keys, t, *POSE, F.when(worse == 2, "LOST").when(worse == 1, "DEGRADED").otherwise("OK").alias("health"))
    # Health never recovers, so it turns at the first rows of either kind: two times for each key.
    marks = poses.groupBy(*keys).agg(F.min(F.when(bad | worst, F.col(t))).alias("_bad"), F.min(F.when(worst, F.col(t))).alias("_worst"))
    both = poses.alias("p").join(marks.alias("s"), [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]).select("p.*", "_bad", "_worst")
    health = F.when(F.col(t) >= F.col("_worst"), "LOST").when(F.col(t) >= F.col("_bad"), "DEGRADED").otherwise("OK")
    return both.select(*keys, t, *POSE, health.alias("health"))


def ground_truth(log: DataFrame, keys: list[str], order: list[str], t: str = "t") -> DataFrame:
    """keys, t, x, y, z, qx..qw, vx, vy, vz from a log of lat, lon, alt, heading_deg (0 is north) and speed.

    The first row of a key is the origin; x is east, y north, z up. The heading is the turn about z as it stands, and the
    velocity is the speed towards it. Only the first row of each key is looked up, so no sequence is sorted."""
    from trailmark.functions import geometry

    first = log.groupBy(*keys).agg(F.min_by(F.struct("lat", "lon", "alt"), F.struct(*order)).alias("_o"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    rows = log.alias("l").join(first.alias("r"), same).select("l.*", "_o")
    east, north = F.radians(F.col("lon") - F.col("_o.lon")) * F.cos(F.radians("_o.lat")) * geometry.EARTH_RADIUS_M, F.radians(F.col("lat") - F.col("_o.lat")) * geometry.EARTH_RADIUS_M
    yaw = F.radians("heading_deg")
    made = {"x": east, "y": north, "z": F.col("alt") - F.col("_o.alt"), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(yaw / 2), "qw": F.cos(yaw / 2), "vx": F.col("speed") * F.sin(yaw), "vy": F.col("speed") * F.cos(yaw), "vz": F.lit(0.0)}
    return rows.select(*log.columns, *[v.alias(k) for k, v in made.items()])


def gyro_turn(dt: Column, g: list[Column]) -> list[Column]:
    """The turn of a gyro sample that lasts dt; its axis is divided by the sum of its absolute components, as the compared
    system does, so it isn't of length one."""
    angle, size = F.sqrt(sum((c * c for c in g), F.lit(0.0))) * dt, sum((F.abs(c) for c in g), F.lit(0.0))
    some = (angle > 0) & (size > 0)
    return [*[F.when(some, c / F.nullif(size, F.lit(0.0)) * F.sin(angle / 2)).otherwise(0.0) for c in g], F.when(some, F.cos(angle / 2)).otherwise(1.0)]


def gyro_orientation(imu: DataFrame, keys: list[str], t: str = "t", bucket: float | None = None) -> DataFrame:
    """keys, t, quaternion by the gyro alone; the first sample sets the clock, backward steps count as none.

    With a bucket (a length of time, see prefix_scan) a sequence is many tasks."""
    names = ["gx", "gy", "gz"]
    before = sequences.previous(imu.select(*keys, t, *names), keys, t, [t], bucket)
    dt = F.greatest(F.coalesce(F.col(t) - F.col(f"prev.{t}"), F.lit(0.0)), F.lit(0.0))
    turn = [f"_{i}" for i in range(4)]
    rows = before.select(*keys, t, *[c.alias(n) for c, n in zip(gyro_turn(dt, [F.col(c) for c in names]), turn, strict=True)])
    return scan.prefix_scan(rows, keys, [t], [F.col(c) for c in turn], scan.turns, [0.0, 0, 0, 1], ["qx", "qy", "qz", "qw"], bucket).drop(*turn)


def embedding_signals(df: DataFrame, keys: list[str], order: str, embedding: str = "embedding", bucket: float | None = None) -> DataFrame:
    """surprise (1 - cosine to the row before, 1 if a norm is 0) and speed (distance by the root of the size); 0 in the first row.

    With a bucket (a length of the order, a number) a key is many tasks."""
    rows = sequences.previous(df.withColumn("_now", F.col(embedding).cast("array<double>")), keys, order, ["_now"], bucket)
    rows = rows.withColumn("_last", F.col("prev._now")).drop("prev")

    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda acc, x: acc + x)

    dot = total(F.zip_with("_now", "_last", lambda a, b: a * b))
    norms = F.sqrt(total(F.transform("_now", lambda a: a * a))) * F.sqrt(total(F.transform("_last", lambda a: a * a)))
    cosine = F.when(norms > 0, F.least(F.greatest(dot / norms, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)
    speed = F.sqrt(total(F.zip_with("_now", "_last", lambda a, b: (a - b) * (a - b)))) / F.sqrt(F.size("_now").cast("double"))
    first = F.col("_last").isNull()
    return rows.withColumn("surprise", F.when(first, 0.0).otherwise(1 - cosine)).withColumn("speed", F.when(first, 0.0).otherwise(speed)).drop("_now", "_last")


def union_grid(streams: list[DataFrame], keys: list[str], value: str, t: str = "t", bucket: float | None = None) -> DataFrame:
    """Distinct times of all streams with each stream's latest value (value_0, value_1, ...; 0 before its first) and their mean."""
    grid = streams[0].select(*keys, t)
    for s in streams[1:]:
        grid = grid.unionByName(s.select(*keys, t))
    out = grid.distinct()
    for i, s in enumerate(streams):
        out = latest(out, s.select(*keys, t, F.col(value).alias(f"{value}_{i}")), keys, f"{value}_{i}", t=t, bucket=bucket)
    return out.withColumn("mean", sum((F.col(f"{value}_{i}") for i in range(len(streams))), F.lit(0.0)) / len(streams))


def held_velocity(df: DataFrame, keys: list[str], velocity: str, confidence: str, order: list[str], least: float = 0.15, decay: float = 0.95) -> DataFrame:
    """Rows with used: their velocity where confidence is enough, otherwise the last such velocity, decayed once for each
    row since (0 before the first), and position, the running sum of used."""
    w = Window.partitionBy(*keys).orderBy(*order)
    good = F.col(confidence) >= least
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("_good", F.when(good, F.struct(F.col("_n").alias("n"), F.col(velocity).alias("v"))))
    rows = rows.withColumn("_last", F.last("_good", True).over(upto))
    used = F.coalesce(F.col("_last.v") * F.pow(F.lit(decay), F.col("_n") - F.col("_last.n")), F.lit(0.0))
    return rows.withColumn("used", used).withColumn("position", F.sum("used").over(upto)).drop("_n", "_good", "_last")


def unwrap(df: DataFrame, keys: list[str], angle: str, order: list[str]) -> DataFrame:
    """Rows with unwrapped: the angle in degrees without jumps of more than half a turn."""
    w = Window.partitionBy(*keys).orderBy(*order)
    jump = F.col(angle) - F.lag(angle).over(w)
    turns = F.coalesce(-F.round(jump / 360.0), F.lit(0.0))
    return df.withColumn("_turns", turns).withColumn("unwrapped", F.col(angle) + 360.0 * F.sum("_turns").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turns")


def gradient(df: DataFrame, keys: list[str], value: str, order: list[str], t: str = "t") -> DataFrame:
    """Rows with gradient: central differences, one-sided at the ends, null for a lone row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    a, b = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
    ta, tb = F.coalesce(F.lag(t).over(w), F.col(t)), F.coalesce(F.lead(t).over(w), F.col(t))
    return df.withColumn("gradient", F.when(tb > ta, (b - a) / (tb - ta)))


def discounted_scan(df: DataFrame, keys: list[str], order: list[str], gamma: float = 0.99, lam: float = 0.95, bucket: float | None = None) -> DataFrame:
    """Rows (reward, value, done) with advantage: generalised advantage estimates, walked from the last row back.

    order: columns of numbers, ascending; of equal rows the one that comes later in the walk is any. With a bucket (a
    length of the first, see prefix_scan) a key is many tasks: a row is an affine map of the advantage behind it."""
    back = df.withColumns({f"_o{i}": -F.col(c) for i, c in enumerate(order)})
    names = [f"_o{i}" for i in range(len(order))]
    rows = sequences.previous(back, keys, names, ["value"], bucket)
    going = ~F.coalesce(F.col("done"), F.lit(False))
    ahead = F.when(going, F.coalesce(F.col("prev.value"), F.lit(0.0))).otherwise(0.0)
    shift, factor = F.col("reward") + gamma * ahead - F.col("value"), F.when(going, gamma * lam).otherwise(0.0)
    found = scan.prefix_scan(rows.select(*df.columns, *names, factor.alias("_f"), shift.alias("_s")), keys, names, [F.col("_f"), F.col("_s")], scan.affine, [1.0, 0.0], ["_factor", "advantage"], bucket)
    return found.select(*df.columns, "advantage")
