"""Writers of trajectories, logs and reports, and checks of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.sources.validators import HEADINGS, HEALTH, MANIFEST_KEYS, NO_FAILURES

#: Fixed: the columns of a trajectory file.
COLUMNS = ["timestamp", "method", "x", "y", "z", "qx", "qy", "qz", "qw", "vx", "vy", "vz", "confidence", "health", "latency_ms"]


def fixed(value: str | Column, places: int = 9) -> Column:
    """A number with that many decimals; empty for null."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", c)).otherwise("")


def write_trajectory(poses: DataFrame, path: str, extra: list[str] | None = None, keys: list[str] | None = None) -> None:
    """Trajectory as CSV: 15 columns and any extra ones, nine decimals, latency three; empty cells for nulls. Keys become folders."""
    named = {"timestamp": fixed("t"), "method": F.col("method"), "health": F.col("health"), "latency_ms": fixed("latency_ms", 3)}
    have = set(poses.columns)
    cells = [named[c].alias(c) if c in named and (c == "timestamp" or c in have) else (fixed(c).alias(c) if c in have else F.lit("").alias(c)) for c in COLUMNS]
    made = poses.select(*keys or [], *cells, *[fixed(c).alias(c) for c in extra or []])
    (made.write.partitionBy(*keys) if keys else made.write).csv(path, header=True, emptyValue="")


def write_tum(poses: DataFrame, path: str) -> int:
    """Space-separated poses of those that are neither LOST nor INVALID; gives how many others were left out."""
    kept = poses.where(~F.col("health").isin("LOST", "INVALID"))
    kept.select(F.concat_ws(" ", *[fixed(c) for c in ("t", "x", "y", "z", "qx", "qy", "qz", "qw")]).alias("value")).write.text(path)
    return poses.where(F.col("health").isin("LOST", "INVALID")).count()


def write_json(report: DataFrame, path: str) -> None:
    """One JSON document for each row; numbers that aren't finite become null, at any depth."""
    from trailmark.sources.reports import json_rows

    json_rows(report).write.text(path)


def write_log(rows: DataFrame, path: str) -> None:
    """Update, weight and error logs as CSV; empty cells for nulls."""
    rows.write.csv(path, header=True, nullValue="", emptyValue="")


def health_counts(poses: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and the count of each of the four states."""
    return poses.groupBy(*keys).agg(*[F.count_if(F.col("health") == h).alias(h.lower()) for h in ("OK", "DEGRADED", "LOST", "INVALID")])


def manifest(poses: DataFrame, details: dict) -> DataFrame:
    """value: a run's manifest as JSON, of details (which must have every key that the check asks for, but for the
    counts) and the number of poses in each state."""
    import json

    if missing := [k for k in MANIFEST_KEYS if k not in details and k != "health_counts"]:
        raise ValueError(f"no {missing[0]} in the manifest's details")
    counts = F.to_json(F.struct(*[F.count_if(F.col("health") == h).alias(h) for h in HEALTH]))
    start = json.dumps(details, allow_nan=False)[:-1]
    return poses.agg(F.concat(F.lit(f'{start}, "health_counts": '), counts, F.lit("}")).alias("value"))


def failure_notes(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, notes for each key of intervals (runs of state, t_first, t_last, n, healthy ones too): the headings that the
    notes' check asks for, poses of each state, and a line for each DEGRADED, LOST or INVALID run in time order, or that there was none."""
    line = F.format_string("- %s: %.3f s to %.3f s (%d poses)", "state", "t_first", "t_last", "n")
    failed = F.col("state").isin(*HEALTH[1:])
    lines = F.transform(F.sort_array(F.collect_list(F.when(failed, F.struct("t_first", line.alias("line"))))), lambda r: r["line"])
    counts = [F.concat(F.lit(f"- {h}: "), F.sum(F.when(F.col("state") == h, F.col("n")).otherwise(0)).cast("string")) for h in HEALTH]
    found = F.when(F.count_if(failed) > 0, F.concat_ws("\n", lines)).otherwise(NO_FAILURES)
    return intervals.groupBy(*keys).agg(F.concat_ws("\n", F.lit(HEADINGS[0]), F.lit(""), F.lit(HEADINGS[1]), *counts, F.lit(""), F.lit(HEADINGS[2]), found).alias("notes"))


def check_run(trajectory: DataFrame, tum: DataFrame, manifest: dict[str, int]) -> DataFrame:
    """check, passed, message: no bad cells, times in order, TUM rows equal to usable poses, health counts as in the manifest."""
    total = trajectory.agg(
        F.count_if(F.col("problem").isNotNull()).alias("bad"), F.count_if(F.col("health").isin("OK", "DEGRADED")).alias("usable"), *[F.count_if(F.col("health") == h).alias(h) for h in manifest],
    ).crossJoin(tum.agg(F.count("*").alias("tum")))  # one row each
    counts = [F.struct(F.lit(f"health {h}").alias("check"), (F.col(h) == n).alias("passed"), F.format_string(f"%d poses, manifest {n}", h).alias("message")) for h, n in manifest.items()]
    first = [
        F.struct(F.lit("trajectory cells").alias("check"), (F.col("bad") == 0).alias("passed"), F.format_string("%d bad rows", "bad").alias("message")),
        F.struct(F.lit("TUM rows").alias("check"), (F.col("tum") == F.col("usable")).alias("passed"), F.format_string("%d rows, %d usable poses", "tum", "usable").alias("message")),
    ]
    return total.select(F.inline(F.array(*first, *counts)))
