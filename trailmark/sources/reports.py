"""Artifacts of evaluations and comparisons: the files of a run, of a failed run, and of several runs side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.operators.evaluate import labels
from trailmark.operators.evaluation import AXES, Evaluation, Settings
from trailmark.sources.sinks import COLUMNS, fixed, write_log, write_trajectory
from trailmark.sources.validators import ERROR_VS_DISTANCE, ERROR_VS_TIME

# Names of a run's and a comparison's files.
METRICS, BY_TIME, BY_DISTANCE, ALIGNED = "metrics.json", "error_vs_time.csv", "error_vs_distance.csv", "ground_truth_aligned.csv"
COMPARISON, TABLE, INTERVALS = "metrics_comparison.json", "comparison_table.csv", "failure_intervals.json"


def finite(value: Column, kind: T.DataType) -> Column:
    """The value with every number in it that isn't finite replaced by null, at any depth of structs, arrays and maps."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[finite(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: finite(x, kind.valueType))
    return value


def json_rows(df: DataFrame) -> DataFrame:
    """value: each row as a JSON document without numbers that aren't finite; nulls stay."""
    cells = [finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))


def write_error_vs_time(rows: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """One row for each estimated pose, nine decimals; cells of unmatched poses are empty. Keys become folders."""
    cells = [F.col("t"), *[F.col(a) for a in AXES], *[F.col(f"ref_{a}") for a in AXES], *[F.col(f"error_{a}") for a in AXES], F.col("error"), None, F.col("gap")]
    made = [F.col("health") if c is None else fixed(c) for c in cells]
    _write_csv(rows, [m.alias(n) for m, n in zip(made, ERROR_VS_TIME, strict=True)], path, keys, "t")


def write_error_vs_distance(rows: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """One row for each matched pose; nine decimals, bins two."""
    made = [fixed("distance"), fixed("error"), F.col("health"), fixed("gap"), fixed("bin_start", 2), fixed("bin_end", 2)]
    _write_csv(rows, [m.alias(n) for m, n in zip(made, ERROR_VS_DISTANCE, strict=True)], path, keys, "distance")


def _write_csv(rows: DataFrame, cells: list[Column], path: str, keys: list[str] | None, order: str) -> None:
    parts = keys or []
    dealt = rows.repartition(*parts) if parts else rows.repartitionByRange(order)
    made = dealt.sortWithinPartitions(*parts, order).select(*parts, *cells)
    writer = made.write.partitionBy(*parts) if parts else made.write
    writer.csv(path, header=True, emptyValue="")


def metrics(e: Evaluation, keys: list[str], settings: Settings) -> DataFrame:
    """keys, and a run's report as columns: status, config, metrics, alignment, diagnostics, coverage, failures, drift_bins."""
    def packed(df: DataFrame | None, name: str) -> DataFrame | None:
        return None if df is None else df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))

    ate = e.ate.select(*keys, *[F.col(c).alias(f"ate_{c}") for c in e.ate.columns if c not in keys])
    rpe = e.rpe.select(*keys, *[F.col(c).alias(f"rpe_{c}") for c in e.rpe.columns if c not in keys])
    summary = ate.join(rpe, keys, "left").join(e.drift.drop("final_drift"), keys, "left")
    if e.heading is not None:
        summary = summary.join(e.heading.select(*keys, F.col("mean_deg").alias("heading_error_mean_deg"), F.col("p95_deg").alias("heading_error_p95_deg")), keys, "left")
    marked = e.markers.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("marker").cast("string"), "error")))).alias("error_at_distance_m"))
    bins = e.drift_bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin_start", "bin_end", "median", "iqr", "n"))).alias("drift_bins"))
    out = packed(e.diagnostics, "diagnostics")
    for part in (packed(summary.join(marked, keys, "left"), "metrics"), packed(e.alignment, "alignment"), packed(e.coverage, "coverage"), packed(e.runtime, "runtime"), packed(e.failures, "failures"), bins):
        out = out if part is None else out.join(part, keys, "left")
    for missing in ({"alignment", "runtime"}).difference(out.columns):
        out = out.withColumn(missing, F.lit(None).cast("string"))
    status = F.when(F.col("diagnostics.problem").isNull(), "OK").otherwise("failed").alias("status")
    return out.select(*keys, status, F.col("diagnostics.problem").alias("error_message"), config(settings), "metrics", "alignment", "diagnostics", "coverage", "runtime", "failures", F.coalesce("drift_bins", F.array().cast(out.schema["drift_bins"].dataType)).alias("drift_bins"))


def config(settings: Settings) -> Column:
    made = {"association_tolerance_sec": settings.tolerance, "alignment_policy": settings.alignment, "correct_scale": settings.scale, "rpe_delta_m": settings.step, "drift_bin_width_m": settings.bin_width}
    return F.struct(*[F.lit(v).alias(k) for k, v in made.items()]).alias("config")


def write_evaluation(e: Evaluation, keys: list[str], settings: Settings, path: str) -> None:
    """All files of an evaluation under path: a report for each key, both error files, the matched reference as a trajectory.

    Each file is a job of its own; evaluate with `store`, so that they share one match."""
    json_rows(metrics(e, keys, settings)).write.text(f"{path}/{METRICS}")
    write_error_vs_time(e.error_vs_time, f"{path}/{BY_TIME}", keys)
    write_error_vs_distance(e.error_vs_distance, f"{path}/{BY_DISTANCE}", keys)
    reference = e.matched.select(*keys, F.col("ref_t").alias("t"), F.lit("ground_truth").alias("method"), *[F.col(f"ref_{a}").alias(a) for a in AXES], F.lit("OK").alias("health"))
    write_trajectory(reference, f"{path}/{ALIGNED}", keys=keys)


def write_failed_evaluation(spark: SparkSession, path: str, reason: str, settings: Settings) -> None:
    """The same files for a run that couldn't be evaluated: a report with status failed and the reason, and headers alone."""
    nothing = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    report = spark.range(1).select(
        F.lit("failed").alias("status"), F.lit(reason).alias("reason"), F.lit(reason).alias("error_message"), config(settings), *[nothing.alias(c) for c in ("diagnostics", "coverage", "runtime", "failures", "alignment", "metrics")],
        *[empty.alias(c) for c in ("drift_bins", "error_vs_time", "error_vs_distance")], *[nothing.alias(c) for c in ("aligned_estimate", "aligned_ground_truth")],
    )
    json_rows(report).write.text(f"{path}/{METRICS}")
    for name, header in ((ALIGNED, COLUMNS), (BY_TIME, ERROR_VS_TIME), (BY_DISTANCE, ERROR_VS_DISTANCE)):
        spark.range(1).select(F.lit(",".join(header)).alias("value")).write.text(f"{path}/{name}")


def write_weight_log(rows: DataFrame, path: str, weights: list[str]) -> None:
    """timestamp and the weight columns, nine decimals, in time order; a missing column raises."""
    missing = [w for w in weights if w not in rows.columns]
    if missing:
        raise ValueError(f"no weight columns {', '.join(missing)}")
    _write_csv(rows, [fixed("t").alias("timestamp"), *[fixed(w).alias(w) for w in weights]], path, None, "t")


def write_comparison(runs: DataFrame, intervals: DataFrame, path: str, columns: list[str]) -> None:
    """Files that compare runs (method, run, drift_percent and any others; one row a run): all runs ranked by drift with
    unknown ones last, a table of the given columns, and each run's failure intervals (run, t_first, t_last) by label."""
    known = F.when(~F.isnan("drift_percent") & (F.abs("drift_percent") != float("inf")), F.col("drift_percent"))
    order = F.struct(known.isNull().alias("unknown"), known.alias("drift"), F.col("method"), F.col("run"))
    fields = F.struct(*[c for c in runs.columns]).alias("row")
    ranked = F.sort_array(F.collect_list(F.struct(order.alias("order"), fields)))  # a run is one row: as many as there are runs
    whole = runs.agg(F.count("*").alias("run_count"), ranked.alias("ranked")).select("run_count", F.transform("ranked", lambda r: r["row"]["method"]).alias("ranking_by_drift_percent"), F.transform("ranked", lambda r: r["row"]).alias("runs"))
    json_rows(whole).write.text(f"{path}/{COMPARISON}")
    write_log(runs.repartitionByRange(1, order).sortWithinPartitions(order).select(*columns), f"{path}/{TABLE}")
    spans = intervals.groupBy("run").agg(F.count("*").alias("interval_count"), F.sum(F.col("t_last") - F.col("t_first")).alias("total_duration_sec"), F.sort_array(F.collect_list(F.struct("t_first", "t_last"))).alias("intervals"))
    named = labels(runs.select("method", "run", known.alias("drift")), "method", ["drift", "run"]).join(spans, "run", "left")
    none = F.array().cast(spans.schema["intervals"].dataType)
    json_rows(named.select("label", "run", F.coalesce("interval_count", F.lit(0)).alias("interval_count"), F.coalesce("total_duration_sec", F.lit(0.0)).alias("total_duration_sec"), F.coalesce("intervals", none).alias("intervals"))).write.text(f"{path}/{INTERVALS}")


def write_streams(streams: dict[str, DataFrame], path: str) -> None:
    """Each present stream as CSV under its name, and a manifest of their counts, for tools outside."""
    counts = None
    for name, rows in streams.items():
        write_log(rows, f"{path}/{name}.csv")
        one = rows.agg(F.lit(name).alias("stream"), F.count("*").alias("rows"))
        counts = one if counts is None else counts.unionByName(one)
    if counts is not None:
        json_rows(counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stream", "rows")))).alias("streams"))).write.text(f"{path}/manifest.json")


def run_name(prefix: str, now: Column, taken: list[str]) -> Column:
    """prefix_yyyyMMdd_HHmmss, with the first of -r2, -r3, ... behind it that isn't taken."""
    name = F.concat(F.lit(f"{prefix}_"), F.date_format(now, "yyyyMMdd_HHmmss"))
    names = F.concat(F.array(name), F.transform(F.sequence(F.lit(2), F.lit(len(taken) + 2)), lambda k: F.concat(name, F.lit("-r"), k.cast("string"))))
    return F.get(F.filter(names, lambda n: ~n.isin(*taken)) if taken else names, F.lit(0))
