"""Fusion of several estimates of one path."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import SimpleNamespace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import gates, geometry
from trailmark.operators.fold import fold_abreast
from trailmark.operators.motion import matrix, quat_mul, resample, rotvec


def sample_methods(grid: DataFrame, trajectories: DataFrame, keys: list[str], methods: list[str], values: list[str], t: str = "t", bucket: float | None = None) -> DataFrame:
    """Grid rows for each method, with that method's pose at their time (see resample)."""
    each = grid.select("*", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    return resample(each, trajectories.where(F.col("method").isin(methods)).select(*keys, "method", t, *values, "confidence", "health"), [*keys, "method"], values, t, bucket)


def blend(sampled: DataFrame, row: list[str], static: dict[str, float], values: list[str], fallback: str) -> DataFrame:
    """One row for each grid row: values and confidence weighted by static weight, confidence and health.

    Where all weights are 0 the fallback method counts alone.
    """
    weights = F.create_map(*[F.lit(v) for kv in static.items() for v in kv])[F.col("method")]
    raw = F.greatest(weights * F.col("confidence") * gates.multiplier(F.col("health")), F.lit(0.0))
    weighted = sampled.withColumn("_w", raw)
    total, spare = F.sum("_w"), F.when(F.col("method") == fallback, 1.0).otherwise(0.0)

    def mean(name: str) -> Column:
        return F.when(total > 1e-9, F.sum(F.col("_w") * F.col(name)) / total).otherwise(F.sum(spare * F.col(name))).alias(name)

    return weighted.groupBy(*row).agg(*[mean(v) for v in [*values, "confidence"]], total.alias("total_weight"))


def ensemble_weights(sampled: DataFrame, row: list[str], static: dict[str, float], fallback: str) -> DataFrame:
    """row, method, raw, weight: each method's static weight times its confidence and what its health is worth (not below
    0), and its share of the row's sum; where all are 0 the fallback method has 1 and the others nothing.

    A method without a static weight counts as one of 0. Rows meet by their key, so many methods of few rows are few groups."""
    weights = F.coalesce(F.create_map(*[F.lit(v) for kv in static.items() for v in kv])[F.col("method")], F.lit(0.0))
    raw = F.greatest(weights * F.coalesce("confidence", F.lit(0.0)) * gates.multiplier(F.col("health")), F.lit(0.0))
    rows = sampled.select(*row, "method", raw.alias("raw"))
    total = F.sum("raw").over(Window.partitionBy(*row))
    return rows.withColumn("weight", F.when(total > 1e-9, F.col("raw") / total).otherwise(F.when(F.col("method") == fallback, 1.0).otherwise(0.0)))


def observations(stats: DataFrame, steps: DataFrame, row: list[str], methods: list[str], innovation_scale: float = 5.0, staleness: float = 5.0, speed_scale: float = 20.0) -> DataFrame:
    """row, features: what a policy sees of each control step, as one array in the order of episodes.feature_names().

    stats: row, method and window_stats() with age, seconds since the method's last accepted update. steps: row, sigma,
    speed, progress, mean_trust. Squashed into bounded ranges; a method that a step has nothing of counts as unseen and as
    stale as can be."""
    ordered = sorted(methods)

    def squash(x: Column, scale: float) -> Column:
        return F.tanh(x / scale)

    seen = [F.lit(1.0), F.col("mean_confidence"), F.col("degraded_share"), F.col("failed_share"), squash(F.col("mean_innovation"), innovation_scale), squash(F.log1p("mean_d2"), 4.0), F.least(F.col("age") / staleness, F.lit(1.0)), F.col("accepted") / F.col("offered")]
    blocks = stats.where(F.col("method").isin(ordered) & (F.col("offered") > 0)).groupBy(*row).agg(*[F.max(F.when(F.col("method") == m, F.array(*[c.cast("double") for c in seen]))).alias(f"_m{i}") for i, m in enumerate(ordered)])
    nothing = F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)])
    whole = [squash(F.log1p("sigma"), 2.0), squash(F.col("speed"), speed_scale), gates.clip(F.col("progress")), F.col("mean_trust")]
    joined = steps.join(blocks, row, "left")
    return joined.select(*row, F.concat(*[F.coalesce(f"_m{i}", nothing) for i in range(len(ordered))], F.array(*[c.cast("double") for c in whole])).alias("features"))


def rewards(rows: DataFrame, keys: list[str], order: list[str], error: str, trusts: list[str], bucket: float | None = None, change: float = 0.05, most: float = 2.0) -> DataFrame:
    """Rows with reward: how far the error fell since the row before, less a share of the mean squared change of the trusts,
    within -most to most; null for a key's first row. With a bucket (a length of the first of order) a key is many tasks."""
    from trailmark.operators.sequences import previous

    both = previous(rows, keys, order, list(dict.fromkeys([error, *trusts])), bucket)
    moved = sum(((F.col(c) - F.col(f"prev.{c}")) * (F.col(c) - F.col(f"prev.{c}")) for c in trusts), F.lit(0.0)) / max(1, len(trusts))
    return both.withColumn("reward", F.when(F.col("prev").isNotNull(), gates.clip(F.col(f"prev.{error}") - F.col(error) - change * moved, -most, most))).drop("prev")


def blend_rotations(rows: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    """One quaternion for each key: the weighted sum after turning each to the side of the first in order, to length one."""
    names = ["qx", "qy", "qz", "qw"]
    first = Window.partitionBy(*keys).orderBy(order)
    dot = sum((F.col(n) * F.first(n).over(first) for n in names), F.lit(0.0))
    sums = rows.withColumn("_w", F.when(dot < 0, -F.col(weight)).otherwise(F.col(weight))).groupBy(*keys).agg(*[F.sum(F.col("_w") * F.col(n)).alias(n) for n in names])
    norm = F.sqrt(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0)))
    return sums.withColumn("_norm", norm).select(*keys, *[F.when(F.col("_norm") <= 1e-9, 1.0 if n == "qw" else 0.0).otherwise(F.col(n) / F.col("_norm")).alias(n) for n in names])


def correct_with(inertial: DataFrame, visual: DataFrame, keys: list[str], values: list[str], gain: float = 0.35, least: float = 0.2, base: float = 0.3, t: str = "t") -> DataFrame:
    """Inertial poses drawn towards the visual ones at their time by gain times confidence, if that is enough.

    confidence: that of the visual pose, or `base` at most where it is out of range; INVALID for 0 or less.
    """
    grid = inertial.select("*", *[F.col(v).alias(f"_{v}") for v in values]).drop("confidence", "health", *values)
    both = resample(grid, visual, keys, values, t)
    weight = F.when(F.col("confidence") >= least, gates.clip(F.lit(gain) * F.col("confidence"))).otherwise(0.0)
    trusted = F.when(F.col("in_range"), F.col("confidence")).otherwise(F.least(F.lit(base), F.greatest(F.col("confidence"), F.lit(base))))
    out = both.withColumn("weight", weight).select("*", *[(F.col(f"_{v}") + F.col("weight") * (F.col(v) - F.col(f"_{v}"))).alias(f"fused_{v}") for v in values])
    out = out.withColumn("confidence", trusted).withColumn("health", F.when(trusted <= 0, "INVALID").otherwise(gates.health_from_confidence(trusted)))
    return out.drop(*values, *[f"_{v}" for v in values])


@dataclass(frozen=True)
class FilterConfig:
    """Noise, first uncertainty and gates of the filter."""

    gravity: float = 9.81
    accel_noise: float = 0.05
    gyro_noise: float = 0.005
    accel_bias_walk: float = 0.0002
    gyro_bias_walk: float = 0.00002
    first_sigma: tuple[float, float, float, float, float] = (1e-3, 0.1, 0.01, 0.02, 0.002)
    sigma_least: float = 0.05
    sigma_spread: float = 5.0
    chi_square: float = 16.27
    max_age: float = 0.25
    max_speed: float = 60.0
    min_confidence: float = 0.15
    degraded: float = 0.35
    tau: float = 1.0
    ok_age: float = 0.5
    lost_age: float = 5.0


@dataclass
class _Filter:
    """Position, velocity, attitude and biases with a 15-state error covariance."""

    config: FilterConfig
    start: float
    p: np.ndarray = field(default_factory=lambda: np.zeros(3))
    v: np.ndarray = field(default_factory=lambda: np.zeros(3))
    q: np.ndarray = field(default_factory=lambda: np.array([0.0, 0, 0, 1]))
    accel_bias: np.ndarray = field(default_factory=lambda: np.zeros(3))
    gyro_bias: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def __post_init__(self) -> None:
        self.cov = np.diag(np.repeat(self.config.first_sigma, 3) ** 2)
        self.now = self.accepted = self.start

    def predict(self, sample: np.ndarray, dt: float) -> None:
        c, turn = self.config, matrix(self.q)
        f, g = sample[:3] - self.accel_bias, sample[3:] - self.gyro_bias
        a = turn @ f - (0, 0, c.gravity)
        cross = np.array([[0, -f[2], f[1]], [f[2], 0, -f[0]], [-f[1], f[0], 0]])
        move = np.eye(15)
        move[0:3, 3:6], move[3:6, 6:9], move[3:6, 9:12], move[6:9, 12:15] = np.eye(3) * dt, -turn @ cross * dt, -turn * dt, -np.eye(3) * dt
        noise = np.repeat([0, c.accel_noise, c.gyro_noise, c.accel_bias_walk, c.gyro_bias_walk], 3) ** 2 * dt
        self.cov = move @ self.cov @ move.T + np.diag(noise)
        self.p, self.v, self.q = self.p + self.v * dt + 0.5 * a * dt * dt, self.v + a * dt, quat_mul(self.q, rotvec(g * dt))

    def offer(self, row: Any, trust: float, least_trust: float = 0.05) -> list[Any]:
        """accepted, reason, innovation, d2, sigma of a measurement; it is applied if every gate lets it pass."""
        c = self.config
        if row.health in ("LOST", "INVALID"):
            return [False, "health_gate", None, None, None]
        if row.confidence < c.min_confidence:
            return [False, "confidence_gate", None, None, None]
        if abs(row.t - self.now) > c.max_age:
            return [False, "timestamp_gate", None, None, None]
        confidence = row.confidence * (c.degraded if row.health == "DEGRADED" else 1.0) * min(max(trust, 0.0), 1.0)
        sigma = c.sigma_least + (1 - min(max(confidence, 0.0), 1.0)) * c.sigma_spread
        e = np.array([row.x, row.y, row.z]) - self.p
        size, s = float(np.linalg.norm(e)), self.cov[:3, :3] + np.eye(3) * sigma**2
        if size / max(self.now - self.accepted, 1e-3) > c.max_speed:
            return [False, "motion_sanity_gate", size, None, sigma]
        d2 = float(e @ np.linalg.solve(s, e))
        if d2 > c.chi_square:
            return [False, "mahalanobis_gate", size, d2, sigma]
        if trust < least_trust:
            return [False, "policy_gate", size, d2, sigma]
        gain = self.cov[:, :3] @ np.linalg.inv(s)
        dx = gain @ e
        self.p, self.v, self.q = self.p + dx[:3], self.v + dx[3:6], quat_mul(self.q, rotvec(dx[6:9]))
        self.accel_bias, self.gyro_bias = self.accel_bias + dx[9:12], self.gyro_bias + dx[12:15]
        self.cov = self.cov - gain @ self.cov[:3]
        self.accepted = row.t
        return [True, None, size, d2, sigma]

    def pose(self) -> list[Any]:
        c, age = self.config, self.now - self.accepted
        health = "OK" if age <= c.ok_age else "DEGRADED" if age <= c.lost_age else "LOST"
        return [*self.p, *self.v, *self.q, float(np.exp(-age / c.tau)), health, float(np.sqrt(np.trace(self.cov[:3, :3]) / 3))]


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (x, y, z), (u, v, w) = a.T, b.T
    return np.stack([y * w - z * v, z * u - x * w, x * v - y * u], axis=1)


def _turned_by(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """quat_mul(q, rotvec(v)) of each row."""
    angle = np.sqrt((v * v).sum(axis=1))
    scale = np.where(angle < 1e-6, 0.5 - angle * angle / 48, np.sin(0.5 * angle) / np.maximum(angle, 1e-300))
    r, w = v * scale[:, None], np.cos(0.5 * angle)
    out = np.concatenate([q[:, 3:] * r + w[:, None] * q[:, :3] + _cross(q[:, :3], r), (q[:, 3] * w - (q[:, :3] * r).sum(axis=1))[:, None]], axis=1)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


#: Reasons of a rejection, in the order of the gates.
REASONS = np.array([None, "health_gate", "confidence_gate", "timestamp_gate", "motion_sanity_gate", "mahalanobis_gate", "policy_gate"], object)


class Filters:
    """What _Filter is, for many sequences at once: `state` holds an array over their slots for each part, and `w` those
    parts of the slots that are in the present turn, from take() to put()."""

    def __init__(self, config: FilterConfig) -> None:
        self.config, self.state, self.w, self.slot = config, {}, {}, np.zeros(0, int)

    def begin(self, slot: np.ndarray, t: np.ndarray, sample: np.ndarray) -> None:
        n = int(slot.max()) + 1
        start = {"p": np.zeros(3), "v": np.zeros(3), "q": np.array([0.0, 0, 0, 1]), "accel_bias": np.zeros(3), "gyro_bias": np.zeros(3), "cov": np.diag(np.repeat(self.config.first_sigma, 3) ** 2)}
        self.state = {k: np.repeat(v[None], n, axis=0) for k, v in start.items()} | {"now": np.zeros(n), "accepted": np.zeros(n), "sample": np.zeros((n, 6))}
        self.take(slot)
        self.w |= {"now": t.copy(), "accepted": t.copy(), "sample": sample}

    def take(self, slot: np.ndarray) -> None:
        self.slot, self.w = slot, {k: v[slot] for k, v in self.state.items()}

    def put(self) -> None:
        for k, v in self.w.items():
            self.state[k][self.slot] = v

    def predict(self, t: np.ndarray, sample: np.ndarray) -> None:
        """By the sample before, which this one then replaces."""
        c, w = self.config, self.w
        dt = np.maximum(t - w["now"], 1e-6)
        step, (x, y, z, s) = dt[:, None], w["q"].T
        turn = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * s), 2 * (x * z + y * s), 2 * (x * y + z * s), 1 - 2 * (x * x + z * z), 2 * (y * z - x * s), 2 * (x * z - y * s), 2 * (y * z + x * s), 1 - 2 * (x * x + y * y)], axis=1).reshape(-1, 3, 3)
        f, g = w["sample"][:, :3] - w["accel_bias"], w["sample"][:, 3:] - w["gyro_bias"]
        a = (turn @ f[:, :, None])[:, :, 0] - (0, 0, c.gravity)
        o, (fx, fy, fz) = np.zeros(len(t)), f.T
        cross = np.stack([o, -fz, fy, fz, o, -fx, -fy, fx, o], axis=1).reshape(-1, 3, 3)
        # The state's transition is the identity and four blocks: rows of the covariance first, then columns.
        mix, by, cov = np.concatenate([turn @ cross, turn], axis=2) * -dt[:, None, None], dt[:, None, None], w["cov"]
        cov[:, 0:3] += by * cov[:, 3:6]
        cov[:, 3:6] += mix @ cov[:, 6:12]
        cov[:, 6:9] -= by * cov[:, 12:15]
        cov[:, :, 0:3] += by * cov[:, :, 3:6]
        cov[:, :, 3:6] += cov[:, :, 6:12] @ mix.transpose(0, 2, 1)
        cov[:, :, 6:9] -= by * cov[:, :, 12:15]
        cov[:, range(15), range(15)] += np.repeat([0, c.accel_noise, c.gyro_noise, c.accel_bias_walk, c.gyro_bias_walk], 3) ** 2 * step
        w["p"], w["v"], w["q"] = w["p"] + w["v"] * step + 0.5 * a * step * step, w["v"] + a * step, _turned_by(w["q"], g * step)
        w["now"], w["sample"] = t.copy(), sample

    def offer(self, at: np.ndarray, m: dict[str, np.ndarray], trust: np.ndarray, least_trust: float = 0.05) -> dict[str, np.ndarray]:
        """accepted, reason, innovation, d2, sigma of one measurement of each of the sequences `at` (places in the turn)."""
        c, w = self.config, self.w
        bad, low = np.isin(m["health"], ("LOST", "INVALID")), m["confidence"] < c.min_confidence
        late = np.abs(m["t"] - w["now"][at]) > c.max_age
        sigma = self.sigma(m, np.clip(trust, 0.0, 1.0))
        e = self.off(at, m)
        size = np.sqrt((e * e).sum(axis=1))
        fast = size / np.maximum(w["now"][at] - w["accepted"][at], 1e-3) > c.max_speed
        code = np.select([bad, low, late, fast], [1, 2, 3, 4], 0)
        d2, met = np.full(len(at), np.nan), np.flatnonzero(code == 0)
        if len(met):
            s = self.spread(at[met], sigma[met])
            d2[met] = (e[met] * np.linalg.solve(s, e[met][:, :, None])[:, :, 0]).sum(axis=1)
            code[met] = np.select([d2[met] > c.chi_square, trust[met] < least_trust], [5, 6], 0)
            fits = code[met] == 0
            self.apply(at[met][fits], s[fits], e[met][fits], m["t"][met][fits])
        known = (code == 0) | (code > 3)
        return {"accepted": (code == 0).astype(object), "reason": REASONS[code], "innovation": np.where(known, size, np.nan), "d2": d2, "sigma": np.where(known, sigma, np.nan)}

    def sigma(self, m: dict[str, np.ndarray], trust: np.ndarray | float) -> np.ndarray:
        c = self.config
        confidence = m["confidence"] * np.where(m["health"] == "DEGRADED", c.degraded, 1.0) * trust
        return c.sigma_least + (1 - np.clip(confidence, 0.0, 1.0)) * c.sigma_spread

    def off(self, at: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
        return np.stack([m["x"], m["y"], m["z"]], axis=1) - self.w["p"][at]

    def spread(self, at: np.ndarray, sigma: np.ndarray) -> np.ndarray:
        return self.w["cov"][at, :3, :3] + np.eye(3) * (sigma * sigma)[:, None, None]

    def apply(self, at: np.ndarray, s: np.ndarray, e: np.ndarray, t: np.ndarray) -> None:
        if not len(at):
            return
        w = self.w
        cov = w["cov"][at]
        gain = cov[:, :, :3] @ np.linalg.inv(s)
        dx = (gain @ e[:, :, None])[:, :, 0]
        for k, part in (("p", dx[:, 0:3]), ("v", dx[:, 3:6]), ("accel_bias", dx[:, 9:12]), ("gyro_bias", dx[:, 12:15])):
            w[k][at] += part
        w["q"][at] = _turned_by(w["q"][at], dx[:, 6:9])
        w["cov"][at] = cov - gain @ cov[:, :3]
        w["accepted"][at] = t

    def position_sigma(self) -> np.ndarray:
        return np.sqrt(np.trace(self.w["cov"][:, :3, :3], axis1=1, axis2=2) / 3)

    def pose(self) -> dict[str, np.ndarray]:
        c, w = self.config, self.w
        age = w["now"] - w["accepted"]
        health = np.array(["OK", "DEGRADED", "LOST"], object)[np.where(age <= c.ok_age, 0, np.where(age <= c.lost_age, 1, 2))]
        parts = dict(zip(["x", "y", "z", "vx", "vy", "vz", "qx", "qy", "qz", "qw"], [*w["p"].T, *w["v"].T, *w["q"].T], strict=True))
        return parts | {"confidence": np.exp(-age / c.tau), "health": health, "position_sigma": self.position_sigma()}


_OUT = ["kind", "t", "step_t", "method", "accepted", "reason", "innovation", "d2", "sigma", "x", "y", "z", "vx", "vy", "vz", "qx", "qy", "qz", "qw", "confidence", "health", "position_sigma"]
_TYPES = "kind string, t double, step_t double, method string, accepted boolean, reason string, innovation double, d2 double, sigma double, x double, y double, z double, vx double, vy double, vz double, qx double, qy double, qz double, qw double, confidence double, health string, position_sigma double"


def filter_fusion(imu: DataFrame, measurements: DataFrame, keys: list[str], config: FilterConfig | None = None) -> DataFrame:
    """Error-state filter over inertial samples with gated position measurements.

    imu: keys, t, ax..gz. measurements: keys, t, method, x, y, z, confidence, health and, if it has it, trust (0 to 1:
    lowers the confidence; under 0.05 the policy gate rejects). Returns rows of kind `step`, the state at each sample after what
    was due then, and of kind `update`, one for each measurement with whether it was accepted and the first gate that
    rejected it. A measurement is due at the first sample at or after its time, the second sample at the earliest;
    those after the last sample have no row. Samples of equal time count as 1e-6 s apart. Many sequences are walked at
    once (see fold_abreast); what a sequence gives doesn't depend on the others.
    """
    key_types = ", ".join(f"`{k}` {imu.schema[k].dataType.simpleString()}" for k in keys)
    return fold_abreast(offered(imu, measurements, keys), keys, ["t", "tag", "method"], F.col("tag"), lambda: Filters(config or FilterConfig()), _turn(keys), f"{key_types}, {_TYPES}")


_SAMPLE = ["ax", "ay", "az", "gx", "gy", "gz"]


def offered(imu: DataFrame, measurements: DataFrame, keys: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """Samples (tag 1) and measurements (tag 0) as one stream of rows; `more` columns of samples are null for measurements."""
    trust = F.col("trust") if "trust" in measurements.columns else F.lit(1.0)
    none = F.lit(None).cast("double")
    left = imu.select(*keys, "t", F.lit(1).alias("tag"), F.lit("").alias("method"), *_SAMPLE, *[none.alias(c) for c in ("x", "y", "z", "confidence", "trust")], F.lit("").alias("health"), *more)
    right = measurements.select(*keys, "t", F.lit(0).alias("tag"), "method", *[none.alias(n) for n in _SAMPLE], "x", "y", "z", "confidence", trust.alias("trust"), "health")
    return left.unionByName(right, allowMissingColumns=True)


def stepper(keys: list[str], config: FilterConfig):
    """step(state, rows) -> (state, output): the filter after rows in time order. A sample older than the state changes
    nothing, and has a row of kind `late`."""

    def step(state: Any, rows: pd.DataFrame) -> tuple[Any, pd.DataFrame]:
        fused, sample, due = state or (None, None, [])
        out: list[list[Any]] = []
        key = [rows[k].iloc[0] for k in keys]
        # Columns are walked in step; a measurement waits as a plain namespace, so that a state can be stored.
        columns = {c: rows[c].tolist() for c in ("t", "tag", "method", "x", "y", "z", "confidence", "trust", "health")}
        samples = rows[_SAMPLE].to_numpy(float)
        for i, (t, tag) in enumerate(zip(columns["t"], columns["tag"], strict=True)):
            if tag == 0:
                due.append(SimpleNamespace(**{c: v[i] for c, v in columns.items()}))
                continue
            if fused is None:
                fused = _Filter(config, t)
            elif t < fused.now:
                out.append([*key, "late", t, fused.now, *[None] * (len(_OUT) - 3)])
                continue
            else:
                fused.predict(sample, max(t - fused.now, 1e-6))
                fused.now = t
                for m in due:
                    out.append([*key, "update", m.t, t, m.method, *fused.offer(m, m.trust), *[None] * 10, m.confidence, m.health, None])
                due = []
            sample = samples[i]
            out.append([*key, "step", t, t, None, None, None, None, None, None, *fused.pose()])
        return (fused, sample, due), pd.DataFrame(out, columns=[*keys, *_OUT])

    return step


def samples_and_offers(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Places of a turn's samples among its rows, and its measurements in waves of one for each sequence at most: their
    places, and the numbers of their samples. A sequence's measurements without a sample are after its last one."""
    at, given = np.flatnonzero(rows["tag"] == 1), np.flatnonzero(rows["tag"] == 0)
    owner = np.searchsorted(at, given)
    given, owner = given[owner < len(at)], owner[owner < len(at)]
    own = rows["slot"][at[owner]] == rows["slot"][given]
    given, owner = given[own], owner[own]
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return at, [(given[nth == k], owner[nth == k]) for k in range(int(nth.max(initial=-1)) + 1)]


def _turn(keys: list[str]):
    """step(state, rows) of fold_abreast(): a turn of many filters."""

    def step(fused: Filters, rows: dict[str, np.ndarray]) -> list[dict[str, Any]]:
        at, waves = samples_and_offers(rows)
        if not len(at):
            return []
        slot, t, sample = rows["slot"][at], rows["t"][at], np.stack([rows[c][at] for c in _SAMPLE], axis=1)
        out: list[dict[str, Any]] = []
        if rows["turn"][0] == 1:
            fused.begin(slot, t, sample)
        else:
            fused.take(slot)
            fused.predict(t, sample)
        for given, owner in waves:
            m = {c: v[given] for c, v in rows.items()}
            out.append({k: m[k] for k in keys} | {"kind": "update", "t": m["t"], "step_t": t[owner], "method": m["method"], "confidence": m["confidence"], "health": m["health"]} | fused.offer(owner, m, m["trust"]))
        out.append({k: rows[k][at] for k in keys} | {"kind": "step", "t": t, "step_t": t} | fused.pose())
        fused.put()
        return out

    return step


def step_weights(updates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step_t, method, weight: accepted updates' 1 / sigma^2 as a share of their step's."""
    raw = updates.where("accepted").groupBy(*keys, "step_t", "method").agg(F.sum(1 / (F.col("sigma") * F.col("sigma"))).alias("raw"))
    total = F.sum("raw").over(Window.partitionBy(*keys, "step_t"))
    return raw.withColumn("weight", F.when(total > 0, F.col("raw") / total).otherwise(0.0)).drop("raw")


def window_stats(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Offered and accepted updates, mean confidence, shares of degraded and failed ones, mean innovation and d2; 0 for none."""
    failed = F.col("health").isin("LOST", "INVALID").cast("int")
    return updates.groupBy(*keys).agg(
        F.count("*").alias("offered"), F.count_if("accepted").alias("accepted"), F.avg("confidence").alias("mean_confidence"), F.avg((F.col("health") == "DEGRADED").cast("int")).alias("degraded_share"),
        F.avg(failed).alias("failed_share"), F.coalesce(F.avg("innovation"), F.lit(0.0)).alias("mean_innovation"), F.coalesce(F.avg("d2"), F.lit(0.0)).alias("mean_d2"),
    )


def fuse_three(inertial: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], values: list[str], gains: tuple[float, float] = (0.5, 0.5), least: float = 0.1, t: str = "t") -> DataFrame:
    """Inertial rows blended with two other streams at their times: fused_<value>, w_inertial, w_first, w_second,
    confidence, health.

    A stream weighs its gain times its confidence, 0 under `least`; two that weigh more than 1 together are scaled to 1
    and leave nothing for the inertial row. A key without a stream gets none of it. confidence: 0.3 of the inertial
    row's and 0.35 of each stream's; 0.3 at most where neither is in range; INVALID for 0 or less.
    """
    both = inertial.select("*", *[F.col(v).alias(f"_own_{v}") for v in values], F.coalesce("confidence", F.lit(1.0)).alias("_own_c"))
    for name, stream in (("first", first), ("second", second)):
        both = resample(both, stream, keys, values, t).withColumnsRenamed({v: f"_{name}_{v}" for v in values} | {"confidence": f"_{name}_c", "in_range": f"_{name}_in"})
    raw = [F.when(F.col(f"_{n}_c") >= least, gates.clip(gain * F.col(f"_{n}_c"), 0.0, gain)).otherwise(0.0) for n, gain in zip(("first", "second"), gains, strict=True)]
    both = both.withColumns({"_w1": raw[0], "_w2": raw[1]}).withColumn("_sum", F.col("_w1") + F.col("_w2"))
    scale = F.greatest(F.col("_sum"), F.lit(1.0))
    both = both.withColumns({"w_inertial": F.greatest(F.lit(0.0), 1 - F.col("_sum")), "w_first": F.col("_w1") / scale, "w_second": F.col("_w2") / scale})
    # A stream without rows has null values, and weighs 0.
    blended = [sum((F.col(f"w_{w}") * F.coalesce(f"_{c}_{v}", F.lit(0.0)) for w, c in (("inertial", "own"), ("first", "first"), ("second", "second"))), F.lit(0.0)).alias(f"fused_{v}") for v in values]
    mixed = gates.clip(0.3 * F.col("_own_c") + 0.35 * F.col("_first_c") + 0.35 * F.col("_second_c"))
    trusted = F.when(F.col("_first_in") | F.col("_second_in"), mixed).otherwise(F.least(mixed, F.lit(0.3)))
    health = F.when(F.col("confidence") <= 0, "INVALID").otherwise(gates.health_from_confidence(F.col("confidence")))
    kept = [c for c in inertial.columns if c not in (*values, "confidence", "health")]
    return both.select(*kept, *blended, "w_inertial", "w_first", "w_second", trusted.alias("confidence")).withColumn("health", health)


def fuse_three_rotations(inertial: list[Column], first: list[Column], second: list[Column], weights: list[Column]) -> list[Column]:
    """The inertial quaternion turned towards the first stream's by its share of both weights, then towards the second's."""
    return geometry.blend(geometry.blend(inertial, first, weights[1] / F.greatest(weights[0] + weights[1], F.lit(1e-9))), second, weights[2])
