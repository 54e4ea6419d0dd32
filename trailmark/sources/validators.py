"""Checks of a run's files. Each gives path and problem, null where the file is valid, one row a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys, headings and headers that files of a run have.
ERROR_VS_TIME = ["timestamp", "est_x", "est_y", "est_z", "gt_aligned_x", "gt_aligned_y", "gt_aligned_z", "error_x", "error_y", "error_z", "error_magnitude", "health", "association_residual"]
ERROR_VS_DISTANCE = ["cumulative_distance", "error_magnitude", "health", "association_residual", "bin_start", "bin_end"]
MANIFEST_KEYS = ["method", "dataset", "sequence", "config", "timestamp_policy", "gravity", "frames", "units", "alignment", "code_version", "status", "health_counts"]
HEALTH = ["OK", "DEGRADED", "LOST", "INVALID"]
METRICS_KEYS = ["status", "config", "metrics", "alignment", "diagnostics", "coverage", "drift_bins"]
HEADINGS = ["# Run Failure Notes", "## Health Summary", "## Detected Degraded/Lost Intervals"]
NO_FAILURES = "No degraded or lost intervals were detected."
#: Strings that stand for numbers that aren't finite, where they aren't a key.
NOT_FINITE = r'(?i)(?<!\\)"(nan|-?inf|-?infinity)"(?!\s*:)'


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def _first(*problems: Column) -> Column:
    return F.coalesce(*problems).alias("problem")


def _missing(keys: Column, wanted: list[str], what: str) -> Column:
    """The first wanted key that isn't there."""
    absent = F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(keys, F.array().cast("array<string>")))
    return F.when(F.size(absent) > 0, F.concat(F.lit(f"{what} has no key "), F.get(absent, F.lit(0))))


def check_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests are JSON objects with all keys, and health_counts with each state."""
    raw, keys = _whole(spark, path), F.json_object_keys("value")
    counts = F.json_object_keys(F.get_json_object("value", "$.health_counts"))
    return raw.select("path", _first(F.when(keys.isNull(), "not a JSON object"), _missing(keys, MANIFEST_KEYS, "manifest"), _missing(counts, HEALTH, "health_counts")))


def check_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics are JSON objects with all keys and finite numbers only, at any depth."""
    raw, keys = _whole(spark, path), F.json_object_keys("value")
    return raw.select("path", _first(F.when(keys.isNull(), "not a JSON object"), _missing(keys, METRICS_KEYS, "metrics"), F.when(F.regexp_like("value", F.lit(NOT_FINITE)), "a value isn't finite")))


def check_failure_notes(spark: SparkSession, notes: str, manifests: str) -> DataFrame:
    """Notes have all headings, and say that there were no failures where the manifest in their folder counts none."""
    def folder(c: str) -> Column:
        return F.regexp_replace(c, "/[^/]*$", "")

    def count(state: str) -> Column:
        return F.coalesce(F.get_json_object("value", f"$.health_counts.{state}").try_cast("long"), F.lit(0))

    failures = _whole(spark, manifests).where(F.json_object_keys("value").isNotNull()).select(folder("path").alias("folder"), sum((count(s) for s in HEALTH[1:]), F.lit(0)).alias("n"))
    joined = _whole(spark, notes).withColumn("folder", folder("path")).join(failures, "folder", "left")
    headings = [F.when(~F.contains("value", F.lit(h)), f"no heading {h}") for h in HEADINGS]
    return joined.select("path", _first(*headings, F.when((F.col("n") == 0) & ~F.contains("value", F.lit(NO_FAILURES)), "no failures are counted, but the notes don't say so")))


def check_headers(spark: SparkSession, path: str, variants: list[str]) -> DataFrame:
    """CSV files have one of the headers and a row at least."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    found = _whole(spark, path).withColumn("lines", lines)
    return found.select("path", _first(F.when(~F.coalesce(F.get("lines", F.lit(0)).isin(*variants), F.lit(False)), "another header"), F.when(F.size("lines") < 2, "no rows")))


def check_error_files(spark: SparkSession, path: str, header: list[str], optional: list[str], text: list[str]) -> DataFrame:
    """Error files: this header, a row at least, a number in every cell that isn't text; optional ones may be empty."""
    found = _whole(spark, path).select("path", F.posexplode_outer(F.split("value", r"\r?\n")).alias("line", "body")).where("line = 0 or trim(body) <> ''")
    row = F.split("body", ",", -1)
    bad = []
    for k, name in enumerate(header):
        cell = F.trim(F.get(row, F.lit(k)))
        value = cell.try_cast("double")
        wrong = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        problem = F.when(~cell.isin(*HEALTH), F.concat(F.lit(f"{name}: "), cell)) if name in text else F.when(wrong & ((cell != "") if name in optional else F.lit(True)), F.concat(F.lit(f"{name}: "), cell))
        bad.append(problem)
    of_line = F.when(F.col("line") == 0, F.when(F.trim("body") != ",".join(header), "another header")).otherwise(F.coalesce(F.when(F.size(row) != len(header), "another number of cells"), *bad))
    worst = found.withColumn("problem", of_line).groupBy("path").agg(F.count_if(F.col("line") > 0).alias("rows"), F.min(F.when(F.col("problem").isNotNull(), F.struct("line", "problem"))).alias("first"))
    told = F.concat(F.lit("line "), (F.col("first.line") + 1).cast("string"), F.lit(": "), F.col("first.problem"))
    return worst.select("path", F.coalesce(told, F.when(F.col("rows") == 0, "no rows")).alias("problem"))


def check_sizes(spark: SparkSession, path: str, more_than: int = 100) -> DataFrame:
    """Files have more than so many bytes; 0 asks for files that aren't empty. Contents aren't read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.when(F.col("length") <= more_than, F.concat(F.lit("only "), "length", F.lit(" bytes"))).alias("problem"))


def check_trajectory_files(spark: SparkSession, path: str) -> DataFrame:
    """Trajectory files: the 15 columns first, a row at least, numbers where they must be (velocity, confidence and latency
    may be empty) and a known health or none. The first problem of each file, by its line."""
    # Fixed: places of cells, and whether they may be empty.
    cells = [(0, "timestamp", False), *[(k, f"position col {k}", False) for k in (2, 3, 4)], *[(k, f"orientation col {k}", False) for k in (5, 6, 7, 8)], *[(k, f"velocity col {k}", True) for k in (9, 10, 11)], (12, "confidence", True), (14, "latency_ms", True)]
    header = "timestamp,method,x,y,z,qx,qy,qz,qw,vx,vy,vz,confidence,health,latency_ms"
    found = _whole(spark, path).select("path", F.posexplode_outer(F.split("value", r"\r?\n")).alias("line", "text")).where("line = 0 or trim(text) <> ''")
    row = F.split("text", ",", -1)

    def number(k: int, label: str, optional: bool) -> Column:
        cell = F.trim(F.get(row, F.lit(k)))
        value = cell.try_cast("double")
        bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when((cell == "") if optional else F.lit(False), None).when(bad, F.concat(F.lit(f"{label} isn't a number: "), cell))

    health = F.trim(F.get(row, F.lit(13)))
    of_row = F.coalesce(F.when(F.size(row) < 15, F.concat(F.size(row).cast("string"), F.lit(" cells"))), *[number(*c) for c in cells], F.when(~health.isin(*HEALTH, ""), F.concat(F.lit("health "), health, F.lit(" is unknown"))))
    of_line = F.when(F.col("line") == 0, F.when(~F.startswith(F.trim("text"), F.lit(header)), "another header")).otherwise(F.concat(F.lit("line "), (F.col("line") + 1).cast("string"), F.lit(": "), of_row))
    judged = found.select("path", "line", of_line.alias("problem"))
    worst = judged.groupBy("path").agg(F.count_if(F.col("line") > 0).alias("rows"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("line"))).alias("problem"))
    return worst.select("path", F.coalesce("problem", F.when(F.col("rows") == 0, "no rows")).alias("problem"))


def check_tum_files(spark: SparkSession, path: str) -> DataFrame:
    """TUM files: lines of eight numbers, one at least."""
    found = _whole(spark, path).select("path", F.posexplode_outer(F.split("value", r"\r?\n")).alias("line", "text")).where("line = 0 or trim(text) <> ''")
    row = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    bad = F.when(F.size(row) != 8, "not eight cells").when(F.exists(row, lambda x: x.try_cast("double").isNull()), "a cell isn't a number")
    judged = found.select("path", "line", (F.trim("text") != "").alias("has"), F.when(F.trim("text") != "", bad).alias("bad"))
    worst = judged.groupBy("path").agg(F.count_if("has").alias("rows"), F.min(F.when(F.col("bad").isNotNull(), F.struct("line", "bad"))).alias("first"))
    problem = F.concat(F.lit("line "), (F.col("first.line") + 1).cast("string"), F.lit(": "), F.col("first.bad"))
    return worst.select("path", F.coalesce(problem, F.when(F.col("rows") == 0, "no rows")).alias("problem"))


def validate_run(spark: SparkSession, path: str, expect_evaluation: bool = True) -> DataFrame:
    """check, passed, message: every check of a run's folder and of how its files agree, a row for each file that is
    checked or missing. The folder holds the fixed names below; those that Spark wrote are folders of parts."""
    trajectory, tum, manifest, notes, log = (f"{path}/{n}" for n in ("estimated_trajectory.csv", "estimated_trajectory_tum.txt", "run_manifest.json", "failure_notes.md", "run.log"))
    matched = [c for c in ERROR_VS_TIME if c.startswith(("gt_aligned_", "error_")) or c == "association_residual"]  # empty where there is no match
    checks = [
        ("trajectory", trajectory, lambda: check_trajectory_files(spark, trajectory)), ("tum", tum, lambda: check_tum_files(spark, tum)), ("manifest", manifest, lambda: check_manifests(spark, manifest)),
        ("failure notes", notes, lambda: check_failure_notes(spark, notes, manifest)), ("log", log, lambda: check_sizes(spark, log, 0)),
    ]
    if expect_evaluation:
        metrics, time_file, distance_file = (f"{path}/{n}" for n in ("metrics.json", "error_vs_time.csv", "error_vs_distance.csv"))
        checks += [("metrics", metrics, lambda: check_metrics(spark, metrics)), ("error vs time", time_file, lambda: check_error_files(spark, time_file, ERROR_VS_TIME, matched, ["health"])), ("error vs distance", distance_file, lambda: check_error_files(spark, distance_file, ERROR_VS_DISTANCE, [], ["health"]))]
    out = None
    there = {name: exists(spark, file) for name, file, _ in checks}
    for name, file, check in checks:
        if there[name]:
            rows = check().select(F.lit(name).alias("check"), F.col("problem").isNull().alias("passed"), F.coalesce("problem", F.lit("valid")).alias("message"))
        else:
            rows = spark.range(1).select(F.lit(name).alias("check"), F.lit(False).alias("passed"), F.lit(f"{file} does not exist").alias("message"))
        out = rows if out is None else out.unionByName(rows)
    if all(there[n] for n in ("trajectory", "tum", "manifest")):
        out = out.unionByName(agreement(spark, trajectory, tum, manifest))
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def agreement(spark: SparkSession, trajectory: str, tum: str, manifest: str) -> DataFrame:
    """Whether the manifest counts the trajectory's health as it is, and the TUM file has a line for each usable pose."""
    health = spark.read.csv(trajectory, header=True, inferSchema=False).agg(*[F.count_if(F.col("health") == h).alias(h) for h in HEALTH])
    lines = spark.read.text(tum).where("trim(value) <> ''").agg(F.count("*").alias("lines"))
    told = _whole(spark, manifest).limit(1).select(*[F.get_json_object("value", f"$.health_counts.{h}").try_cast("long").alias(f"told_{h}") for h in HEALTH])
    one = health.crossJoin(lines).crossJoin(told)  # one row each
    counts = F.coalesce(*[F.when(~F.col(h).eqNullSafe(F.col(f"told_{h}")), F.format_string(f"{h}: %d poses, manifest %s", h, F.col(f"told_{h}").cast("string"))) for h in HEALTH])
    usable = F.col("OK") + F.col("DEGRADED")
    of_tum = F.when(F.col("lines") != usable, F.format_string("%d TUM rows, %d usable poses", "lines", usable))
    rows = [F.struct(F.lit(n).alias("check"), p.isNull().alias("passed"), F.coalesce(p, F.lit("valid")).alias("message")) for n, p in (("health counts", counts), ("TUM rows", of_tum))]
    return one.select(F.inline(F.array(*rows)))


def trajectory_problems(poses: DataFrame) -> DataFrame:
    """The rows of a trajectory that break its constraints, with problem: null or non-finite time, position or orientation, and unknown health."""
    numbers = [F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), f"{c} isn't finite") for c in ("t", "x", "y", "z", "qx", "qy", "qz", "qw")]
    health = F.when(F.col("health").isNotNull() & ~F.col("health").isin(*HEALTH), F.concat(F.lit("unknown health "), "health"))
    return poses.withColumn("problem", F.coalesce(*numbers, health)).where("problem is not null")


def export_metadata_problem(metadata: dict) -> str | None:
    """Why an export's description is invalid: an empty unit, policy, frame or format, or a negative count or tolerance."""
    for name in ("timestamp_unit", "association_policy", "source_frame", "target_frame", "position_units", "orientation_format"):
        if not metadata.get(name):
            return f"{name} must not be empty"
    if (metadata.get("association_tolerance_sec") or 0) < 0:
        return "association_tolerance_sec must not be negative"
    counts = {"tum_filtered_rows": metadata.get("tum_filtered_rows", 0)} | {f"health count {k}": v for k, v in metadata.get("health_counts", {}).items()}
    return next((f"{k} must not be negative" for k, v in counts.items() if v < 0), None)
