"""Estimators as one polymorphic table function of SQL.

SELECT * FROM estimate(method => 'gyro', samples => TABLE (SELECT ...) PARTITION BY seq ORDER BY t)

The function is analysed for each call: the method must be a constant that is registered, and the table must have the
streams (columns) that it needs; its output is what the table has besides, with the method's name and its estimates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from trailmark.operators import motion, scan

#: Rows of a partition that are estimated at once.
BLOCK = 4096


@dataclass(frozen=True)
class Backend:
    """An estimator: the columns it needs, those it makes (doubles; health is a string), and step(state, rows) -> (state,
    rows of what it makes), which must give the same however a sequence is cut."""

    needs: tuple[str, ...]
    makes: tuple[str, ...]
    step: Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame]]


BACKENDS: dict[str, Backend] = {}


def register(method: str, backend: Backend) -> None:
    """Adds an estimator for calls made from now on; a name stands for one estimator."""
    if not method or BACKENDS.get(method, backend) != backend:
        raise ValueError(f"{method!r} is no name for another estimator")
    BACKENDS[method] = backend


class Estimate:
    """The table function. A table partitioned by key and ordered by time is read row by row and estimated in blocks."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.backend: Backend | None = None
        self.state: Any = None

    @staticmethod
    def analyze(method: AnalyzeArgument, samples: AnalyzeArgument) -> AnalyzeResult:
        if not samples.isTable:
            raise ValueError("samples must be a table argument")
        if not method.isConstantExpression or method.value not in BACKENDS:
            raise ValueError(f"method must be one of {sorted(BACKENDS)}")
        backend = BACKENDS[method.value]
        if missing := [c for c in backend.needs if c not in samples.dataType.names]:
            raise ValueError(f"{method.value} needs the streams {list(backend.needs)}; the table lacks {missing}")
        kept = [f for f in samples.dataType.fields if f.name not in (*backend.needs, *backend.makes, "method") or f.name == "t"]
        made = [StructField("method", StringType()), *[StructField(c, StringType() if c == "health" else DoubleType()) for c in backend.makes]]
        return AnalyzeResult(schema=StructType([*kept, *made]))

    def eval(self, method: str, samples: Row) -> Iterator[tuple]:
        self.method, self.backend = method, BACKENDS[method]
        self.rows.append(samples)
        if len(self.rows) >= BLOCK:
            yield from self._flush()

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield from self._flush()

    def _flush(self) -> Iterator[tuple]:
        rows = pd.DataFrame([r.asDict() for r in self.rows])
        self.rows = []
        self.state, made = self.backend.step(self.state, rows)
        if list(made.columns) != list(self.backend.makes) or len(made) != len(rows):
            raise ValueError(f"estimator {self.method!r} made {list(made.columns)} of {len(made)} rows")
        names = [c for c in rows.columns if c not in (*self.backend.needs, *self.backend.makes, "method") or c == "t"]
        for kept, new in zip(rows[names].itertuples(index=False), made.itertuples(index=False), strict=True):
            yield (*(None if pd.isna(v) else v for v in kept), self.method, *new)


def _sample_times(state: Any, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Times, and those before them; the first sample's is its own."""
    t = rows["t"].to_numpy(float)
    return t, np.concatenate([[t[0] if state is None else state["t"]], t[:-1]])


def gyro_step(state: Any, rows: pd.DataFrame) -> tuple[Any, pd.DataFrame]:
    """gyro_orientation() over consecutive rows."""
    t, before = _sample_times(state, rows)
    g = rows[["gx", "gy", "gz"]].to_numpy(float)
    angle, size = np.linalg.norm(g, axis=1) * np.maximum(t - before, 0.0), np.abs(g).sum(axis=1)
    some = (angle > 0) & (size > 0)
    turn = np.zeros((len(rows), 4))
    turn[:, 3] = np.where(some, np.cos(angle / 2), 1.0)
    turn[some, :3] = g[some] / size[some, None] * np.sin(angle[some] / 2)[:, None]
    found = scan.running(np.concatenate([[[0.0, 0, 0, 1] if state is None else state["q"]], turn]), scan.turns)[1:]
    return {"t": t[-1], "q": found[-1]}, pd.DataFrame(found, columns=["qx", "qy", "qz", "qw"])


def imu_only_step(state: Any, rows: pd.DataFrame, gravity: float = 9.81, degraded: tuple[float, float] = (5.0, 50.0), lost: tuple[float, float] = (10.0, 100.0)) -> tuple[Any, pd.DataFrame]:
    """strapdown() over consecutive rows."""
    t, before = _sample_times(state, rows)
    samples = rows[motion.IMU].to_numpy(float)
    held = np.concatenate([[np.zeros(6) if state is None else state["sample"]], samples[:-1]])
    dt = np.where(t > before, t - before, 1e-6)
    dt[0] = 0.0 if state is None else dt[0]
    g = held[:, 3:] * dt[:, None]
    angle = np.linalg.norm(g, axis=1)
    k = np.where(angle < 1e-6, 0.5 - angle * angle / 48, np.sin(angle / 2) / np.where(angle > 0, angle, 1.0))
    speed = held[:, :3] * dt[:, None]
    steps = np.column_stack([g * k[:, None], np.cos(angle / 2), speed, 0.5 * speed * dt[:, None], dt])
    first = np.array([[0.0, 0, 0, 1] + [0.0] * 7]) if state is None else state["motion"]
    found = scan.running(np.concatenate([first, steps]), scan.motions)[1:]
    time, down = found[:, 10], np.array([0.0, 0.0, gravity])
    p, v = found[:, 7:10] - 0.5 * down * (time * time)[:, None], found[:, 4:7] - down * time[:, None]
    start = t[0] if state is None else state["start"]
    gone, far = t - start, np.linalg.norm(p, axis=1)
    worst = np.maximum.accumulate(np.maximum(np.select([(gone > lost[0]) | (far > lost[1]), (gone > degraded[0]) | (far > degraded[1])], [2, 1], 0), 0 if state is None else state["worst"]))
    made = pd.DataFrame(np.column_stack([p, v, found[:, :4]]), columns=motion.POSE).assign(health=np.array(["OK", "DEGRADED", "LOST"], object)[worst])
    return {"t": t[-1], "sample": samples[-1], "motion": found[-1:], "start": start, "worst": int(worst[-1])}, made


register("gyro", Backend(("t", "gx", "gy", "gz"), ("qx", "qy", "qz", "qw"), gyro_step))
register("imu_only", Backend(("t", *motion.IMU), (*motion.POSE, "health"), imu_only_step))


def install(spark: SparkSession, name: str = "estimate") -> None:
    """Registers the table function for a session's SQL."""
    spark.udtf.register(name, udtf(Estimate))
