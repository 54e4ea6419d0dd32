"""Filter fusion in a closed loop with a policy: what a control step saw decides how far the next step trusts each method."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.episodes import feature_names
from trailmark.operators.fold import fold_abreast
from trailmark.operators.fusion import _SAMPLE, _TYPES, FilterConfig, Filters, _Filter, offered, samples_and_offers
from trailmark.operators.motion import control_windows

#: The features of an observation, methods' first, and what is added to variances.
OF_METHOD = ["available", "mean_confidence", "frac_degraded", "frac_failed", "innovation", "mahalanobis", "staleness", "accept_ratio"]
OF_ALL = ["ekf_sigma", "speed", "progress", "prev_mean_trust"]
OF_SIGNALS = ["rgb_surprise", "event_surprise", "embedding_speed"]
SLACK = 1e-8
#: Weights of a policy at most: it is read by the driver and sent to every task.
MOST_WEIGHTS = 4_000_000


@dataclass(frozen=True)
class Policy:
    """A frozen normaliser and a small network (tanh between layers, a logistic curve at the end), with the layout and
    timing it was trained with. layers: (weights, bias) with weights by output, then input."""

    methods: tuple[str, ...]
    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    mean: np.ndarray
    var: np.ndarray
    period: float = 0.1
    least_trust: float = 0.05
    innovation_scale: float = 5.0
    staleness: float = 5.0
    speed_scale: float = 20.0
    signals: bool = False

    def __post_init__(self) -> None:
        size, widths = len(self.features), [w.shape for w, _ in self.layers]
        if self.period <= 0:
            raise ValueError("the control period must be positive")
        if len(self.mean) != size or len(self.var) != size or not widths or widths[0][1] != size:
            raise ValueError(f"a policy for {size} features has a normaliser of {len(self.mean)} and a first layer of {widths[0][1] if widths else 0}")
        if any(a[0] != b[1] for a, b in zip(widths, widths[1:], strict=False)) or widths[-1][0] != len(self.methods):
            raise ValueError(f"layers {widths} don't lead to {len(self.methods)} methods")

    @property
    def features(self) -> list[str]:
        return feature_names(list(self.methods), OF_METHOD, OF_ALL) + [f"jepa.{s}" for s in OF_SIGNALS] * self.signals

    def trusts(self, observation: np.ndarray) -> np.ndarray:
        """Of one observation, or of a row for each."""
        x = (observation - self.mean) / np.sqrt(self.var + SLACK)
        for i, (w, b) in enumerate(self.layers):
            x = x @ w.T + b
            if i < len(self.layers) - 1:
                x = np.tanh(x)
        return np.clip(1 / (1 + np.exp(-x)), 0.0, 1.0)

    def first_observation(self) -> np.ndarray:
        return np.array([1.0 if f == "global.prev_mean_trust" else 0.0 for f in self.features])


def read_policy(weights: DataFrame, methods: list[str], **settings: Any) -> Policy:
    """A policy from a table of numbers: part ('mean', 'var', or 'weight' and 'bias' with their layer), row, column, value.

    The table is bounded: more than MOST_WEIGHTS rows raise, as do gaps."""
    rows = weights.select("part", "layer", "row", "column", "value").limit(MOST_WEIGHTS + 1).toPandas()
    if len(rows) > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} weights")

    def block(part: str, layer: int, two: bool = False) -> np.ndarray:
        own = rows[(rows["part"] == part) & (rows["layer"] == layer)]
        shape = (int(own["row"].max()) + 1, int(own["column"].max()) + 1) if len(own) else (0, 0)
        out = np.full(shape, np.nan)
        out[own["row"], own["column"]] = own["value"]
        if np.isnan(out).any():
            raise ValueError(f"{part} of layer {layer} has gaps")
        return out if two else out.ravel()

    depth = int(rows[rows["part"] == "weight"]["layer"].max()) + 1 if (rows["part"] == "weight").any() else 0
    layers = tuple((block("weight", k, two=True), block("bias", k)) for k in range(depth))
    return Policy(tuple(methods), layers, block("mean", 0), block("var", 0), **settings)


#: What a control step has seen of each method.
SEEN = ["offered", "accepted", "confidence", "degraded", "failed", "innovation", "compared", "d2"]


class _Loops:
    """Many closed loops: filters, and for each the trusts, begin and number of its control step, what the step has seen of
    each method, and when each method was last accepted."""

    def __init__(self, policy: Policy, config: FilterConfig) -> None:
        self.policy, self.fused = policy, Filters(config)

    def begin(self, slot: np.ndarray, t: np.ndarray, sample: np.ndarray) -> None:
        self.fused.begin(slot, t, sample)
        n, many = int(slot.max()) + 1, len(self.policy.methods)
        self.trusts, self.seen = np.tile(self.policy.trusts(self.policy.first_observation()), (n, 1)), np.zeros((n, many, len(SEEN)))
        self.begun, self.done, self.last = np.zeros(n), np.zeros(n), np.zeros((n, many))
        self.begun[slot], self.last[slot] = t, t[:, None]

    def offer(self, owner: np.ndarray, slot: np.ndarray, m: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """A measurement of each owner (its place in the turn) at most: the verdicts, and the trusts they were offered with."""
        number = {name: i for i, name in enumerate(self.policy.methods)}
        if unknown := set(m["method"]) - set(number):
            raise ValueError(f"method {min(unknown)!r} is none of the policy's: {list(self.policy.methods)}")
        k = np.array([number[name] for name in m["method"]])
        trust = self.trusts[slot, k]
        e = self.fused.off(owner, m)
        d2 = (e * np.linalg.solve(self.fused.spread(owner, self.fused.sigma(m, 1.0)), e[:, :, None])[:, :, 0]).sum(axis=1)
        verdict = self.fused.offer(owner, m, trust, self.policy.least_trust)
        accepted, compared = verdict["accepted"].astype(bool), ~np.isnan(verdict["innovation"])
        self.seen[slot, k] += np.stack([np.ones(len(k)), accepted, m["confidence"], m["health"] == "DEGRADED", np.isin(m["health"], ("LOST", "INVALID")), np.where(compared, verdict["innovation"], 0.0), compared, np.where(compared, d2, 0.0)], axis=1).astype(float)
        self.last[slot[accepted], k[accepted]] = m["t"][accepted]
        return verdict, trust

    def decide(self, place: np.ndarray, slot: np.ndarray, t: np.ndarray, steps: np.ndarray, signals: np.ndarray) -> None:
        """Ends the control steps of these slots, at these places of the turn: the trusts of the next ones."""
        p = self.policy
        self.done[slot] += 1
        s = dict(zip(SEEN, np.moveaxis(self.seen[slot], 2, 0), strict=True))
        n, k = np.maximum(1.0, s["offered"]), np.maximum(1.0, s["compared"])
        of_method = [s["offered"] > 0, s["confidence"] / n, s["degraded"] / n, s["failed"] / n, np.tanh(s["innovation"] / k / p.innovation_scale), np.tanh(np.log1p(s["d2"] / k) / 4.0), np.minimum((t[:, None] - self.last[slot]) / p.staleness, 1.0), s["accepted"] / n]
        speed = np.sqrt((self.fused.w["v"][place] ** 2).sum(axis=1))
        of_all = [np.tanh(np.log1p(self.fused.position_sigma()[place]) / 2.0), np.tanh(speed / p.speed_scale), np.clip(self.done[slot] / np.maximum(1, steps), 0.0, 1.0), self.trusts[slot].mean(axis=1)]
        observed = np.concatenate([np.stack(of_method, axis=2).reshape(len(slot), -1), np.stack(of_all, axis=1), *([np.tanh(signals)] if p.signals else [])], axis=1)
        self.trusts[slot], self.seen[slot], self.begun[slot] = p.trusts(observed), 0.0, t


def _turn(keys: list[str]):
    """step(state, rows) of fold_abreast(): a turn of many closed loops."""

    def step(s: _Loops, rows: dict[str, np.ndarray]) -> list[dict[str, Any]]:
        at, waves = samples_and_offers(rows)
        if not len(at):
            return []
        slot, t, sample = rows["slot"][at], rows["t"][at], np.stack([rows[c][at] for c in _SAMPLE], axis=1)
        key = {k: rows[k][at] for k in keys}
        out: list[dict[str, Any]] = []
        if rows["turn"][0] == 1:
            s.begin(slot, t, sample)
            out.append(key | {"kind": "step", "t": t, "step_t": t} | s.fused.pose())
            s.fused.put()
            return out
        s.fused.take(slot)
        s.fused.predict(t, sample)
        for given, owner in waves:
            m = {c: v[given] for c, v in rows.items()}
            verdict, trust = s.offer(owner, slot[owner], m)
            out.append({k: m[k] for k in keys} | {"kind": "update", "t": m["t"], "step_t": t[owner], "method": m["method"], "confidence": m["confidence"], "health": m["health"], "trust": trust} | verdict)
        out.append(key | {"kind": "step", "t": t, "step_t": t} | s.fused.pose())
        ended = np.flatnonzero((t >= s.begun[slot] + s.policy.period) | (t >= rows["last_t"][at]))
        if len(ended):
            own, end = slot[ended], t[ended]
            out += [{k: v[ended] for k, v in key.items()} | {"kind": "trust", "t": end, "step_t": end, "method": name, "trust": s.trusts[own, i]} for i, name in enumerate(s.policy.methods)]
            signals = np.nan_to_num(np.stack([rows[c][at[ended]].astype(float) for c in OF_SIGNALS], axis=1)) if s.policy.signals else np.zeros((len(own), 0))
            s.decide(ended, own, end, rows["steps"][at[ended]], signals)
        s.fused.put()
        return out

    return step


def _plain_d2(fused: _Filter, m: Any) -> float:
    """The squared distance of a measurement as its own confidence has it, whatever the policy trusts."""
    c = fused.config
    confidence = m.confidence * (c.degraded if m.health == "DEGRADED" else 1.0)
    sigma = c.sigma_least + (1 - min(max(confidence, 0.0), 1.0)) * c.sigma_spread
    e = np.array([m.x, m.y, m.z]) - fused.p
    return float(e @ np.linalg.solve(fused.cov[:3, :3] + np.eye(3) * sigma**2, e))


def policy_fusion(imu: DataFrame, measurements: DataFrame, keys: list[str], policy: Policy, config: FilterConfig | None = None) -> DataFrame:
    """filter_fusion under a policy: rows of kind `step`, `update` (with the trust it was offered with) and `trust`, one for
    each control step and method, at the step's end.

    A control step ends at the first sample that is the policy's period or more after its begin, and at the last. The
    first is decided by an observation of nothing, each later one by what the step before it saw. A method that the
    policy doesn't know raises, and so does a policy trained with signals if the samples lack them (columns of the latest
    signal at each sample; see asof.latest). Times of a key must increase. One sequence is in one task, as each
    step needs the one before it; a task walks many at once (see fold_abreast).
    """
    if policy.signals and (missing := set(OF_SIGNALS) - set(imu.columns)):
        raise ValueError(f"the policy was trained with signals; the samples lack {sorted(missing)}")
    # How many steps there will be: windows of all samples, but for one that the last sample alone begins.
    windows = control_windows(imu.select(*keys, "t"), keys, policy.period, ["t"]).groupBy(*keys, "win").agg(F.count("*").alias("n"), F.max("t").alias("t"))
    steps = windows.groupBy(*keys).agg((F.max("win") + 1 - F.when(F.max_by("n", "win") == 1, 1).otherwise(0)).alias("steps"), F.max("t").alias("last_t"))
    # Before samples and measurements are put together: afterwards adaptive execution may merge their partitions apart.
    rows = offered(imu.join(steps, keys), measurements, keys, ("steps", "last_t", *(OF_SIGNALS if policy.signals else [])))
    types = ", ".join(f"`{k}` {imu.schema[k].dataType.simpleString()}" for k in keys)
    return fold_abreast(rows, keys, ["t", "tag", "method"], F.col("tag"), lambda: _Loops(policy, config or FilterConfig()), _turn(keys), f"{types}, {_TYPES}, trust double")
