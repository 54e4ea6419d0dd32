"""The gated filter as a stream with state: one filter for each key, kept from micro-batch to micro-batch."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from trailmark.operators.fusion import _OUT, _TYPES, FilterConfig, stepper
from trailmark.streaming.latest import keep, timeout


def filter_stream(rows: DataFrame, keys: list[str], config: FilterConfig | None = None, idle: float | None = None) -> DataFrame:
    """What filter_fusion() gives, for a stream of offered() rows: samples and measurements with their trust.

    The state of a key is its filter, the last sample and the measurements that wait for the next one. Rows of a
    micro-batch are taken in time order; a sample older than the state gets a row of kind `late`, and a measurement that is
    too late for it is rejected by the timestamp gate, as any other one. With idle, a number of seconds, a key that has had no
    row for that long is forgotten, and begins anew with its next sample; without it every key is kept for ever.
    """
    step = stepper(keys, config or FilterConfig())

    def run(_: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = pickle.loads(state.get[0]) if state.exists else None
        after, out = step(before, pd.concat(list(batches)).sort_values(["t", "tag", "method"], kind="stable").reset_index(drop=True))
        state.update((pickle.dumps(after),))
        keep(state, idle)
        yield out

    key_types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    assert len(_OUT) == _TYPES.count(",") + 1
    return rows.groupBy(*keys).applyInPandasWithState(run, f"{key_types}, {_TYPES}", "filter binary", "append", timeout(idle))
