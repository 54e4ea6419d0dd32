"""Structured Streaming forms of the state machines: late measurements, latest values, packets."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def gate_late(stream: DataFrame, arrived: str, measured: str, max_age: float = 0.25) -> DataFrame:
    """Measurements with accepted and reason: those whose time is further than max_age seconds from their arrival are
    marked, not dropped, so that they can be logged."""
    late = F.abs(F.col(arrived).cast("double") - F.col(measured).cast("double")) > max_age
    return stream.withColumn("accepted", ~late).withColumn("reason", F.when(late, "timestamp_gate"))


def packets(stream: DataFrame, keys: list[str], ts: str, width: str, late: str) -> DataFrame:
    """Counts of tumbling event-time windows by key, closed by the watermark."""
    window = F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(*keys, window.alias("win")).agg(F.count("*").alias("n"), F.count_if(F.col("p") > 0).alias("n_pos"))


def timeout(idle: float | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout


def keep(state: GroupState, idle: float | None) -> None:
    """Keeps a key's state until it has had no row for so long."""
    if idle:
        state.setTimeoutDuration(max(1, int(1000 * idle)))


def forward_fill(stream: DataFrame, key: str, t: str = "t", value: str = "value", default: float = 0.0, idle: float | None = None) -> DataFrame:
    """key, t, filled: for each row the latest value at or before it among those seen; a null value asks, others set.

    The state of a key is one time and one value. Rows of a micro-batch are taken in time order; a row older than the
    state doesn't change it, and gets the default, as its own past is gone. With idle, a number of seconds, a key that has
    had no row for that long is forgotten; without it every key is kept for ever.
    """

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_t, last = state.get if state.exists else (float("-inf"), default)
        rows = pd.concat(list(batches)).sort_values([t, value], na_position="last", kind="stable")
        out = []
        for now, v in zip(rows[t], rows[value], strict=True):
            if now < last_t:
                out.append(default if pd.isna(v) else v)
                continue
            if not pd.isna(v):
                last_t, last = float(now), float(v)
            out.append(last)
        state.update((last_t, last))
        keep(state, idle)
        yield pd.DataFrame({key: k[0], t: rows[t].to_numpy(), "filled": out})

    key_type = stream.schema[key].dataType.simpleString()
    return stream.select(key, t, value).groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, {t} double, filled double", "last_t double, last double", "append", timeout(idle))
