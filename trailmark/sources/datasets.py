"""Whole sequences from folders, where references are, and trajectories that other tools made."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.sources import readers
from trailmark.sources.validators import exists

# Files of a generated sequence's folder, names that event times have, gravity of the two kinds of data.
IMU, GROUND_TRUTH, EVENTS, EVENT_TIMES = "imu/imu.csv", "ground_truth/trajectory.csv", "events/events.csv", "metadata/event_timestamps.csv"
EVENT_TIME_COLUMNS = ["t_event_s", "timestamp_s", "timestamp", "t"]
GRAVITY = {"synthetic": -9.81, "mvsec": 9.81}


@dataclass
class Sequence:
    """A sequence's streams by name, those that its folder lacks, and stream, n, t_first, t_last of each."""

    name: str
    gravity: float
    streams: dict[str, DataFrame]
    ranges: DataFrame
    missing: list[str] = field(default_factory=list)


def load_folder(spark: SparkSession, path: str, name: str | None = None, gravity: float = GRAVITY["synthetic"]) -> Sequence:
    """A generated sequence: its IMU, which must be there, and what it has of ground truth and events."""
    path = path.rstrip("/")
    found: dict[str, DataFrame] = {"imu": readers.read_imu(spark, f"{path}/{IMU}")}
    missing = []
    for stream, file, read in (("ground_truth", GROUND_TRUTH, readers.read_ground_truth), ("events", EVENTS, readers.read_events)):
        if exists(spark, f"{path}/{file}"):
            found[stream] = read(spark, f"{path}/{file}")
        else:
            missing.append(stream)
    return Sequence(name or path.rpartition("/")[2], gravity, found, time_ranges(found), missing)


def time_ranges(streams: dict[str, DataFrame]) -> DataFrame:
    """stream, n, t_first, t_last; zeros for a stream without rows."""
    out = None
    for name, rows in streams.items():
        one = rows.agg(F.lit(name).alias("stream"), F.count("*").alias("n"), F.coalesce(F.min("t"), F.lit(0.0)).alias("t_first"), F.coalesce(F.max("t"), F.lit(0.0)).alias("t_last"))
        out = one if out is None else out.unionByName(one)
    return out


def load_sequence(spark: SparkSession, dataset: str, path: str | None = None, name: str | None = None) -> Sequence:
    """A sequence of a known dataset; without a path, 100 samples of a body at rest, 0.01 s apart."""
    if dataset not in GRAVITY:
        raise ValueError(f"unknown dataset {dataset}")
    if path:
        return load_folder(spark, path, name, GRAVITY[dataset])
    rest = {"ax": 0.0, "ay": 0.0, "az": GRAVITY[dataset], "gx": 0.0, "gy": 0.0, "gz": 0.0}
    imu = spark.range(100).select((F.col("id") * 0.01).alias("t"), *[F.lit(v).alias(k) for k, v in rest.items()])
    return Sequence(name or "stationary", GRAVITY[dataset], {"imu": imu}, time_ranges({"imu": imu}), ["ground_truth", "events"])


def pose_rows(trajectory: DataFrame) -> DataFrame:
    """Poses with every column that a pose table has: velocity 0, confidence 1 and health OK where they lack."""
    default = {"vx": 0.0, "vy": 0.0, "vz": 0.0, "confidence": 1.0, "health": "OK"}
    made = [F.coalesce(c, F.lit(v)).alias(c) if c in trajectory.columns else F.lit(v).alias(c) for c, v in default.items()]
    keys = [c for c in trajectory.columns if c not in {*readers.POSE, *default}]
    return trajectory.select(*keys, *readers.POSE, *made)


def ground_truth_path(spark: SparkSession, run: str, explicit: str | None = None) -> str:
    """Where a run's reference is: the path given, or the manifest's input; a folder stands for the trajectory within."""
    found = explicit
    if not found:
        body = spark.read.text(f"{run}/run_manifest.json", wholetext=True)
        found = body.select(F.coalesce(F.get_json_object("value", "$.input"), F.get_json_object("value", "$.config.input"))).first()[0]
        if not found:
            raise ValueError(f"the manifest of {run} names no input")
    if found.endswith((".h5", ".hdf5")):
        raise ValueError(f"{found}: files of that library aren't read here")
    if found.endswith(".csv"):
        return found
    return f"{found.rstrip('/')}/{GROUND_TRUTH}"


def load_reference(spark: SparkSession, path: str) -> DataFrame:
    """A reference trajectory from a project file or a generated sequence's; if neither fits, both reasons are told."""
    problems = []
    for read in (readers.read_trajectory, readers.read_ground_truth):
        try:
            return read(spark, path)
        except ValueError as problem:
            problems.append(f"{read.__name__}: {problem}")
    raise ValueError("; ".join(problems))


def event_frame_times(frames: DataFrame, order: str, events: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """frames with t: the told times where there are as many as frames, else times spread evenly over the events' span,
    else each frame's number."""
    n = frames.count()
    numbered = frames.withColumn("_k", F.row_number().over(Window.orderBy(order)) - 1)  # one sequence's frames, whose order is one
    name = next((c for c in EVENT_TIME_COLUMNS if told is not None and c in told.columns), None)
    if name and told.count() == n:
        times = told.select((F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1).alias("_k"), F.col(name).cast("double").alias("t"))
        return numbered.join(times, "_k").drop("_k")
    if events is not None and n > 1:
        span = events.agg(F.min("t").alias("_a"), F.max("t").alias("_b"))  # one row
        spread = numbered.crossJoin(span).withColumn("t", F.coalesce(F.col("_a") + F.col("_k") * (F.col("_b") - F.col("_a")) / (n - 1), F.col("_k").cast("double")))
        return spread.drop("_k", "_a", "_b")
    return numbered.withColumn("t", F.col("_k").cast("double")).drop("_k")


def import_trajectory(spark: SparkSession, path: str, kind: str = "auto", confidence: float = 0.8, gap: float = 0.5) -> DataFrame:
    """A trajectory that another tool made, as method external. Project files keep their confidence and health; TUM files
    (any suffix but .csv) get this confidence, and DEGRADED after a gap longer than this."""
    if kind not in ("auto", "csv", "tum"):
        raise ValueError(f"unknown format {kind}")
    if kind == "csv" or kind == "auto" and path.lower().endswith(".csv"):
        return readers.read_trajectory(spark, path).withColumn("method", F.lit("external"))
    rows = readers.read_tum(spark, path)
    since = F.col("t") - F.lag("t").over(Window.partitionBy("path").orderBy("t"))
    return rows.withColumns({"method": F.lit("external"), "confidence": F.lit(confidence), "health": F.when(since > gap, "DEGRADED").otherwise("OK"), "latency_ms": F.lit(0.0)})


def load_diagnostics(rows: DataFrame, keys: list[str], wanted: list[str], quarantined: DataFrame | None = None) -> DataFrame:
    """keys, missing, malformed, quarantined: which of the wanted streams a sequence lacks, which have a row with a problem, and
    which were set aside (keys and stream, as unordered_streams() gives them), each list in the alphabet's order.

    rows: keys, stream, problem (null for a good row). A task adds sets of stream names, never rows."""
    found = rows.groupBy(*keys).agg(F.collect_set("stream").alias("_seen"), F.collect_set(F.when(F.col("problem").isNotNull(), F.col("stream"))).alias("_bad"))
    none = F.array().cast("array<string>")
    if quarantined is not None:
        found = found.join(quarantined.groupBy(*keys).agg(F.collect_set("stream").alias("_aside")), keys, "left")
    aside = F.coalesce("_aside", none) if quarantined is not None else none
    return found.select(*keys, F.sort_array(F.array_except(F.array(*map(F.lit, wanted)), "_seen")).alias("missing"), F.sort_array("_bad").alias("malformed"), F.sort_array(aside).alias("quarantined"))


def missing_argument(arguments: dict, required: list[tuple[str, str, str]]) -> str | None:
    """The first argument that another one's value asks for and that isn't there: (selector, its value, what it needs)."""
    return next((f"{selector} {value} needs {needs}" for selector, value, needs in required if arguments.get(selector) == value and not arguments.get(needs)), None)
