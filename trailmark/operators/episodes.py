"""Perturbed estimates, episodes cut from sequences, event cues of frame pairs, and a stepwise estimator's states."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import geometry
from trailmark.operators import asof, motion
from trailmark.operators.fold import fold

# Kinds of perturbations, in the order that draws choose from, and what honest ones leave of confidence.
KINDS = ("dropout", "bias_ramp", "noise_burst", "confident_bias")
BIAS_CONFIDENCE, NOISE_CONFIDENCE = 0.6, 0.7
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Perturbation:
    """A degradation of one method within a closed window of time."""

    method: str
    kind: str
    start: float
    end: float
    magnitude: float = 0.0
    direction: tuple[float, float, float] = (1.0, 0.0, 0.0)
    seed: int = 0

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")
        if self.end <= self.start or self.magnitude < 0:
            raise ValueError("a window needs time, a magnitude is not negative")

    def unit(self) -> np.ndarray:
        norm = np.linalg.norm(self.direction)
        return np.array(self.direction) / norm if norm > 0 else np.array([1.0, 0.0, 0.0])


def perturbed(poses: DataFrame, keys: list[str], perturbations: list[Perturbation], order: list[str], t: str = "t") -> DataFrame:
    """Poses (method, x, y, z, confidence, health) with all perturbations of their method applied, one after the other.

    A bias grows linearly over its window; a noise burst draws from its seed in time order, so it is a fold over the
    window's rows of each key. Confident bias leaves confidence as it is."""
    out = poses
    for p in perturbations:
        hit = (F.col("method") == p.method) & F.col(t).between(p.start, p.end)
        if p.kind == "dropout":
            out = out.withColumns({"confidence": F.when(hit, 0.0).otherwise(F.col("confidence")), "health": F.when(hit, "LOST").otherwise(F.col("health"))})
        elif p.kind == "noise_burst":
            out = out.where(~F.coalesce(hit, F.lit(False))).unionByName(noisy(out.where(hit), keys, p, order))
        else:
            ramp = F.least(F.greatest((F.col(t) - p.start) / (p.end - p.start), F.lit(0.0)), F.lit(1.0))
            moved = {a: F.when(hit, F.col(a) + p.magnitude * ramp * float(u)).otherwise(F.col(a)) for a, u in zip(AXES, p.unit(), strict=True)}
            kept = F.col("confidence") * (BIAS_CONFIDENCE if p.kind == "bias_ramp" else 1.0)
            out = out.withColumns(moved | {"confidence": F.when(hit, kept).otherwise(F.col("confidence"))})
    return out


def noisy(rows: DataFrame, keys: list[str], p: Perturbation, order: list[str]) -> DataFrame:
    def step(state: Any, part: pd.DataFrame) -> tuple[Any, pd.DataFrame]:
        state = state or np.random.Generator(np.random.PCG64(p.seed))
        noise = state.normal(0.0, p.magnitude, size=(len(part), 3))
        return state, part.assign(**{a: part[a] + noise[:, i] for i, a in enumerate(AXES)}, confidence=part["confidence"] * NOISE_CONFIDENCE)

    return fold(rows, keys, order, step, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields))


def draw_perturbations(random: np.random.Generator, methods: list[str], start: float, end: float, severity: int) -> list[Perturbation]:
    """As many perturbations as severity says, drawn in a fixed order: method, kind, length and start of the window,
    magnitude (noise has a fixed one), direction, seed. None for no severity, methods or time."""
    if severity < 0:
        raise ValueError("severity is not negative")
    out = []
    for _ in range(severity if methods and end > start else 0):
        method, kind = str(random.choice(methods)), str(random.choice(list(KINDS)))
        length = float(random.uniform(0.2, 0.4)) * (end - start)
        begin = start + float(random.uniform(0.0, max(end - start - length, 1e-9)))
        magnitude = 0.15 * severity if kind == "noise_burst" else float(random.uniform(0.5, 1.5)) * severity
        direction = random.normal(size=3)
        out.append(Perturbation(method, kind, begin, begin + length, magnitude, tuple(direction.tolist()), int(random.integers(0, 2**31 - 1))))
    return out


@dataclass(frozen=True)
class Episodes:
    """windows: keys, win, lo, hi, position at the first sample and velocity over the first step (ref_x, vx, ...); samples:
    inertial rows of each window with the reference at their times; estimates: other rows, shifted to agree with the
    reference at the window's start; problems: windows of fewer than two samples."""

    windows: DataFrame
    samples: DataFrame
    estimates: DataFrame
    problems: DataFrame


def build_episodes(imu: DataFrame, reference: DataFrame, estimates: DataFrame, keys: list[str], width: float, stride: float, axes: tuple[str, ...] = AXES, t: str = "t") -> Episodes:
    """Episodes of `width` seconds, each `stride` after the one before, over the time that imu and reference share; one of
    the whole span if that is shorter. imu: keys, t; reference: keys, t, axes; estimates: keys, method, t, axes and more."""
    if width <= 0 or stride <= 0:
        raise ValueError("width and stride must be positive")
    ends = [df.groupBy(*keys).agg(F.min(t).alias(f"{n}0"), F.max(t).alias(f"{n}1")) for n, df in (("i", imu), ("r", reference))]
    span = ends[0].join(ends[1], keys).select(*keys, F.greatest("i0", "r0").alias("a"), F.least("i1", "r1").alias("b")).where("b > a")
    windows = motion.hopping(span.select(*keys, F.explode(F.array("a", "b")).alias(t)), keys, width, stride, t)
    dense = asof.interpolate(imu, reference.select(*keys, t, *axes), keys, list(axes), t).drop("in_range")
    dense = dense.withColumnsRenamed({a: f"ref_{a}" for a in axes})
    samples = asof.in_windows(dense, windows, keys, width, t)
    w = Window.partitionBy(*keys, "win").orderBy(t)
    first = samples.withColumn("_r", F.row_number().over(w)).withColumn("_dt", F.lead(t).over(w) - F.col(t))
    first = first.select("*", *[(F.lead(f"ref_{a}").over(w) - F.col(f"ref_{a}")).alias(f"_d{a}") for a in axes]).where("_r = 1")
    speeds = [F.when(F.col("_dt") > 0, F.col(f"_d{a}") / F.col("_dt")).otherwise(0.0).alias(f"v{a}") for a in axes]
    starts = first.where("_dt is not null").select(*keys, "win", "lo", "hi", *[f"ref_{a}" for a in axes], *speeds)
    anchors = windows.join(estimates.select(*keys, "method").distinct(), keys).select(*keys, "method", "win", F.col("lo").alias(t))
    at = asof.interpolate(anchors, estimates.select(*keys, "method", t, *axes), [*keys, "method"], list(axes), t).select(*keys, "method", "win", *[F.col(a).alias(f"_at_{a}") for a in axes])
    within = asof.in_windows(estimates, windows, keys, width, t).join(at, [*keys, "method", "win"]).join(starts.select(*keys, "win", *[f"ref_{a}" for a in axes]), [*keys, "win"])
    moved = within.withColumns({a: F.col(a) + F.col(f"ref_{a}") - F.col(f"_at_{a}") for a in axes}).drop(*[f"_at_{a}" for a in axes], *[f"ref_{a}" for a in axes], "lo", "hi")
    problems = windows.join(starts, [*keys, "win"], "left_anti").select(*keys, "win", F.lit("fewer than two samples").alias("problem"))
    return Episodes(starts, samples.join(starts.select(*keys, "win"), [*keys, "win"], "left_semi"), moved, problems)


def pair_cues(pairs: DataFrame, imu: DataFrame, trajectory: DataFrame, keys: list[str], focal: float, depth: float, gain: float = 0.5, most: float = 0.5, least_confidence: float = 0.2, gyro: bool = True, width: float = 1.0, camera: list[float] | None = None) -> DataFrame:
    """pairs (keys, pair, lo, hi, shift_x, shift_y, confidence, valid, reason) with correction_x, _y, _z, confidence, reason and applied.

    The image shift of a frame pair, less what the mean gyro of the pair's samples (or the sample nearest its middle)
    explains, is a camera velocity at an assumed depth; turned by the trajectory's orientation nearest the middle (and by
    camera, a quaternion from camera to body) it is a way through the world. Its difference from the inertial way, times gain and confidence and at most `most` long, is the
    correction. imu: keys, t, gx, gy; trajectory: keys, t, x, y, z, qx..qw; width: about the length of a pair.
    """
    windows = pairs.select(*keys, "pair", "lo", "hi")
    middle = windows.withColumn("t", (F.col("lo") + F.col("hi")) / 2).drop("lo", "hi")
    means = asof.in_windows(imu.select(*keys, "t", "gx", "gy"), windows, keys, width).groupBy(*keys, "pair").agg(F.avg("gx").alias("_gx"), F.avg("gy").alias("_gy"))
    nearest = asof.nearest(middle, imu.select(*keys, "t", "gx", "gy"), keys, tie="prev").select(*keys, "pair", F.col("near.gx").alias("_nx"), F.col("near.gy").alias("_ny"))
    turns = asof.nearest(middle, trajectory.select(*keys, "t", "qx", "qy", "qz", "qw"), keys, tie="prev").select(*keys, "pair", F.struct(*[f"near.{q}" for q in ("qx", "qy", "qz", "qw")]).alias("_q"))
    ends = windows.select(*keys, "pair", F.inline(F.array(F.struct(F.lit(0).alias("_end"), F.col("lo").alias("t")), F.struct(F.lit(1).alias("_end"), F.col("hi").alias("t")))))
    at = asof.interpolate(ends, trajectory.select(*keys, "t", *AXES), keys, list(AXES))
    ways = at.groupBy(*keys, "pair").agg(*[(F.max_by(a, "_end") - F.min_by(a, "_end")).alias(f"_way_{a}") for a in AXES])
    found = pairs
    for part in (means, nearest, turns, ways):
        found = found.join(part, [*keys, "pair"], "left")
    dt, turning = F.col("hi") - F.col("lo"), F.lit(1.0 if gyro else 0.0)
    wx, wy = F.coalesce("_gx", "_nx", F.lit(0.0)), F.coalesce("_gy", "_ny", F.lit(0.0))
    shift = [F.col("shift_x") + turning * focal * dt * wy, F.col("shift_y") - turning * focal * dt * wx]
    velocity: list[Column] = [*[-s / dt * depth / focal for s in shift], F.lit(0.0)]
    if camera is not None:
        velocity = geometry.rotate([F.lit(c) for c in camera], velocity)
    world = geometry.rotate([F.col(f"_q.{q}") for q in ("qx", "qy", "qz", "qw")], velocity)
    ahead = [v * dt - F.col(f"_way_{a}") for v, a in zip(world, AXES, strict=True)]
    finite = ~(sum((F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 1).otherwise(0) for x in ahead), F.lit(0)) > 0)
    raw = [gain * F.col("confidence") * x for x in ahead]
    norm = F.sqrt(sum((x * x for x in raw), F.lit(0.0)))
    scale = F.when(norm > most, most / norm).otherwise(1.0)
    reason = F.when(~F.col("valid"), F.col("reason")).when(dt <= 0, "non_positive_dt").when(F.col("confidence") < least_confidence, "low_confidence").when(~finite, "non_finite_innovation")
    judged = found.withColumns({f"correction_{a}": x * scale for a, x in zip(AXES, raw, strict=True)} | {"_why": reason, "_none": ~F.col("valid") | (dt <= 0) | (~finite & (F.col("confidence") >= least_confidence))})
    used = F.col("_why").isNull()
    corrections = [F.when(used, F.col(f"correction_{a}")).otherwise(0.0).alias(f"correction_{a}") for a in AXES]
    return judged.select(*keys, "pair", "lo", "hi", *corrections, F.when(F.col("_none"), 0.0).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("_why", "reason").alias("reason"), used.alias("applied"))


def event_inertial(imu: DataFrame, pairs: DataFrame, keys: list[str], focal: float, depth: float, slack: float = 0.25, **options: Any) -> DataFrame:
    """Inertial navigation with the corrections of frame pairs: strapdown() moved by the sum of the cues so far, a running
    one in part; confidence is 0 further than `slack` from the time that pairs cover."""
    trajectory = motion.strapdown(imu, keys)
    cues = pair_cues(pairs, imu, trajectory, keys, focal, depth, **options).where("applied")
    ramps = cues.select(*keys, F.col("lo").alias("t0"), F.col("hi").alias("t1"), *[f"correction_{a}" for a in AXES])
    moved = motion.ramp_offsets(trajectory, ramps, keys, corrections={f"correction_{a}": f"_by_{a}" for a in AXES})
    out = moved.withColumns({a: F.col(a) + F.col(f"_by_{a}") for a in AXES}).drop(*[f"_by_{a}" for a in AXES])
    covered = pairs.groupBy(*keys).agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    near = asof.latest(out.join(covered, keys, "left"), pairs.select(*keys, F.col("hi").alias("t"), "confidence"), keys, "confidence")
    inside = F.col("t").between(F.col("_lo") - slack, F.col("_hi") + slack)
    return near.withColumn("confidence", F.when(F.coalesce(inside, F.lit(False)), F.col("confidence")).otherwise(0.0)).drop("_lo", "_hi")


def cue_diagnostics(cues: DataFrame, keys: list[str], poses: DataFrame, slack: float = 0.25, t: str = "t") -> DataFrame:
    """keys, pairs, applied, skipped, invalid, mean_confidence, coverage of pair_cues(): a pair that isn't applied is invalid if
    its confidence is 0, else skipped; coverage is the share of poses (keys, t) within `slack` of the time the pairs cover,
    0 without poses."""
    counts = cues.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.count_if("applied").alias("applied"), F.count_if(~F.col("applied") & (F.col("confidence") > 0)).alias("skipped"), F.count_if(~F.col("applied") & (F.col("confidence") <= 0)).alias("invalid"),
        F.avg("confidence").alias("mean_confidence"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"),
    )
    inside = F.col(t).between(F.col("_lo") - slack, F.col("_hi") + slack)
    covered = poses.select(*keys, t).join(counts.select(*keys, "_lo", "_hi"), keys).groupBy(*keys).agg(F.avg(inside.cast("int")).alias("coverage"))
    return counts.drop("_lo", "_hi").join(covered, keys, "left").fillna(0.0, ["coverage"])


def estimator_states(events: DataFrame, imu: DataFrame, keys: list[str], step: str = "step") -> DataFrame:
    """keys, step, t, qx, qy, qz, qw: after each step of packets (events: keys, step, t; imu: keys, step, t, gx, gy, gz), the
    latest time of what it held, or the one before, and the orientation by the gyro alone."""
    turned = motion.gyro_orientation(imu, keys).join(imu.select(*keys, "t", step), [*keys, "t"])
    last = turned.groupBy(*keys, step).agg(F.max_by(F.struct("qx", "qy", "qz", "qw"), "t").alias("_q"))
    times = events.select(*keys, step, "t").unionByName(imu.select(*keys, step, "t")).groupBy(*keys, step).agg(F.max("t").alias("t"))
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    found = times.join(last, [*keys, step], "left").withColumn("_q", F.last("_q", True).over(w))
    still = {"qx": 0.0, "qy": 0.0, "qz": 0.0, "qw": 1.0}
    return found.select(*keys, step, "t", *[F.coalesce(f"_q.{q}", F.lit(v)).alias(q) for q, v in still.items()])


def feature_names(methods: list[str], of_method: list[str], of_all: list[str]) -> list[str]:
    """Names of an observation's places: every method's features, methods in the alphabet's order, then the global ones."""
    if not methods or methods != sorted(methods):
        raise ValueError("methods must be sorted, and one at least")
    return [f"{m}.{f}" for m in methods for f in of_method] + [f"global.{f}" for f in of_all]


def trust_of(trusts: dict[str, float] | list[float], methods: list[str]) -> dict[str, float]:
    """Trust of each method within 0 to 1; a vector must have one for each, a mapping no other method."""
    if isinstance(trusts, dict):
        if unknown := set(trusts) - set(methods):
            raise ValueError(f"unknown methods {sorted(unknown)}")
        named = trusts
    elif len(trusts) != len(methods):
        raise ValueError(f"{len(trusts)} trusts for {len(methods)} methods")
    else:
        named = dict(zip(methods, trusts, strict=True))
    return {m: min(1.0, max(0.0, float(named[m]))) for m in methods if m in named}


def with_latency(poses: DataFrame, seconds: float, count: int) -> DataFrame:
    """Poses with latency_ms: the elapsed time shared out evenly over `count` samples."""
    return poses.withColumn("latency_ms", F.lit(1000.0 * seconds / max(1, count)))
