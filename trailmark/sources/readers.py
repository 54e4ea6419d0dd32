"""Readers of sensor streams, trajectories and run documents: typed schemas, never inferred ones.

Columns come under several names, the first that a file has wins. Bad cells and rows don't vanish: they go into
`problem`, and strict=True raises on the first one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed: accepted column names, first match wins.
ALIASES = {
    "t": ["timestamp_s", "timestamp", "t"], "x": ["x_m", "x"], "y": ["y_m", "y"], "z": ["z_m", "z"], "vx": ["vx_mps", "vx"], "vy": ["vy_mps", "vy"], "vz": ["vz_mps", "vz"],
    "ax": ["ax_mps2", "ax"], "ay": ["ay_mps2", "ay"], "az": ["az_mps2", "az"], "gx": ["gx_radps", "gx"], "gy": ["gy_radps", "gy"], "gz": ["gz_radps", "gz"], "p": ["polarity", "p"],
}
POSE = ["t", "x", "y", "z", "qx", "qy", "qz", "qw"]
HEALTH = ("OK", "DEGRADED", "LOST", "INVALID")


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False).withColumn("path", F.input_file_name())


def _source(df: DataFrame, name: str) -> str | None:
    return next((a for a in ALIASES.get(name, [name]) if a in df.columns), None)


def _number(df: DataFrame, name: str, default: float | None = None) -> tuple[Column, Column]:
    """The column as a finite double (default for empty cells), and why a cell isn't one."""
    found = _source(df, name)
    if found is None:
        if default is None:
            raise ValueError(f"no column for {name}: {', '.join(ALIASES.get(name, [name]))}")
        return F.lit(default), F.lit(None).cast("string")
    cell = F.trim(F.col(found))
    empty = cell.isNull() | (cell == "")
    value = cell.try_cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    problem = F.when(empty, None if default is not None else F.lit(f"{name}: empty")).when(bad, F.concat(F.lit(f"{name}: "), cell))
    return F.when(empty, F.lit(default).cast("double")).when(~bad, value), problem


def _read(df: DataFrame, required: list[str], optional: dict[str, float], more: list[Column], strict: bool) -> DataFrame:
    made = {n: _number(df, n) for n in required} | {n: _number(df, n, d) for n, d in optional.items()}
    problem = F.coalesce(*[p for _, p in made.values()])
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("bad cell in "), F.col("path"), F.lit(": "), problem)).cast("string"))
    return df.select("path", *[v.alias(n) for n, (v, _) in made.items()], *more, problem.alias("problem"))


def read_imu(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """path, t, ax, ay, az, gx, gy, gz, problem."""
    return _read(_text(spark, path), ["t", "ax", "ay", "az", "gx", "gy", "gz"], {}, [], strict)


def read_events(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """path, t, x, y (int), p (byte), problem."""
    rows = _read(_text(spark, path), ["t", "x", "y", "p"], {}, [], strict)
    return rows.withColumns({"x": F.col("x").cast("int"), "y": F.col("y").cast("int"), "p": F.col("p").cast("int").cast("byte")})


def read_ground_truth(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A pose for each row: a quaternion if the file has one (to length one; none of no length), else one from yaw_deg, else
    the identity. Velocity defaults to 0, confidence to 1, health to OK."""
    df = _text(spark, path)
    health = F.coalesce(F.col("health"), F.lit("OK")) if "health" in df.columns else F.lit("OK")
    quaternion = all(q in df.columns for q in ("qx", "qy", "qz", "qw"))
    required = POSE if quaternion else ["t", "x", "y", "z", *(["yaw_deg"] if "yaw_deg" in df.columns else [])]
    rows = _read(df, required, {"vx": 0.0, "vy": 0.0, "vz": 0.0, "confidence": 1.0}, [health.alias("health")], strict)
    if quaternion:
        return normalised(rows, strict)
    half = F.radians("yaw_deg") / 2 if "yaw_deg" in required else F.lit(0.0)
    return rows.withColumns({"qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(half), "qw": F.cos(half)}).drop("yaw_deg")


def read_trajectory(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A trajectory as write_trajectory writes it: pose and method required; velocity (all three or zeros), confidence (1),
    health (OK) and latency_ms (0) optional."""
    df = _text(spark, path)
    method = F.col("method") if "method" in df.columns else F.lit(None).cast("string")
    health = F.coalesce(F.nullif(F.trim(F.col("health")), F.lit("")), F.lit("OK")) if "health" in df.columns else F.lit("OK")
    rows = _read(df, POSE, {"vx": float("nan"), "vy": float("nan"), "vz": float("nan"), "confidence": 1.0, "latency_ms": 0.0}, [method.alias("method"), health.alias("health")], strict)
    whole = ~(F.isnan("vx") | F.isnan("vy") | F.isnan("vz"))
    rows = rows.withColumns({v: F.when(whole, F.col(v)).otherwise(0.0) for v in ("vx", "vy", "vz")})
    known = F.when(~F.col("health").isin(*HEALTH), F.concat(F.lit("health: "), "health"))
    return normalised(rows.withColumn("problem", F.coalesce("problem", known)), strict)


def read_tum(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """path, line, pose, problem from lines of eight numbers; comments and blank lines are skipped."""
    lines = spark.read.text(path).withColumn("path", F.input_file_name()).withColumn("line", F.trim("value")).where("line <> '' and not startswith(line, '#')")
    cells = F.split("line", r"\s+")
    values = [F.get(cells, F.lit(i)).try_cast("double") for i in range(8)]
    bad = (F.size(cells) != 8) | F.array_contains(F.transform(F.array(*values), lambda v: v.isNull() | F.isnan(v)), True)
    rows = lines.select("path", "line", *[v.alias(n) for v, n in zip(values, POSE, strict=True)], F.when(bad, F.concat(F.lit("line: "), "line")).alias("problem"))
    return _raising(rows, strict)


def normalised(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Quaternions to length one; one of no length is a problem."""
    norm = F.sqrt(sum((F.col(q) * F.col(q) for q in ("qx", "qy", "qz", "qw")), F.lit(0.0)))
    checked = rows.withColumn("problem", F.coalesce("problem", F.when(norm <= 1e-12, "quaternion: no length"))).withColumns({q: F.col(q) / F.nullif(norm, F.lit(0.0)) for q in ("qx", "qy", "qz", "qw")})
    return _raising(checked, strict)


def _raising(rows: DataFrame, strict: bool) -> DataFrame:
    if not strict:
        return rows
    raised = F.raise_error(F.concat(F.lit("bad row in "), F.col("path"), F.lit(": "), F.col("problem"))).cast("string")
    return rows.withColumn("problem", F.when(F.col("problem").isNotNull(), raised))


def unordered_streams(rows: DataFrame, keys: list[str], order: str, t: str = "t") -> DataFrame:
    """Keys whose time decreases somewhere in the given row order: streams to leave out (anti-join)."""
    back = F.col(t) < F.lag(t).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_back", back).groupBy(*keys).agg(F.bool_or(F.coalesce("_back", F.lit(False))).alias("_any")).where("_any").drop("_any")


def time_problems(rows: DataFrame, keys: list[str], order: list[str], strictly: bool = False, t: str = "t") -> DataFrame:
    """Rows whose time is before that of the row before them, or with strictly not after it, in the given order, with problem."""
    last = F.lag(t).over(Window.partitionBy(*keys).orderBy(*order))
    bad = F.col(t) <= last if strictly else F.col(t) < last
    return rows.withColumn("problem", F.when(bad, F.concat(F.lit("time goes back to "), F.col(t).cast("string")))).where("problem is not null")


def read_embeddings(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """All columns, size, and problem: no vector, one of another size than given, or a number in it that isn't finite."""
    e = spark.read.parquet(path).withColumn("size", F.size("embedding"))
    wrong = F.col("size") != size if size else F.lit(False)
    infinite = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return e.withColumn("problem", F.when(F.col("embedding").isNull(), "no vector").when(wrong, F.concat(F.lit("size "), F.col("size").cast("string"))).when(infinite, "a number isn't finite"))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, body: one whole JSON document a file; null where it isn't JSON."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return raw.select("path", F.try_parse_json("value").alias("body"))


def latest_run(spark: SparkSession, path: str, method: str | None = None, sequence: str | None = None) -> DataFrame:
    """The newest run folder with an estimate: path and modification time, from file listings; with a method or sequence,
    of the runs whose manifest names these."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "trajectory*").load(path).select("path", "modificationTime")
    if method or sequence:
        folder = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "/[^/]*$", "")
        told = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "run_manifest.json").text(path, wholetext=True).select("value", F.input_file_name().alias("path")).withColumn("_folder", folder)
        for name, value in (("method", method), ("sequence", sequence)):
            told = told.where(F.get_json_object("value", f"$.{name}") == value) if value else told
        files = files.withColumn("_folder", folder).join(told.select("_folder"), "_folder", "left_semi")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("modified"))
