"""The whole evaluation of estimated trajectories against references: one call, lazily planned frames by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import geometry
from trailmark.operators import asof, evaluate, sequences

AXES = ("x", "y", "z")
QUATERNION = ["qx", "qy", "qz", "qw"]
HEALTHY = ("OK", "DEGRADED")
#: Fewest eligible and fewest matched rows of a key that is evaluated, as an alignment needs them.
LEAST_ROWS = 3


@dataclass(frozen=True)
class Settings:
    """Tolerance of matches in seconds, alignment (se3 or none) and scale, the step of relative errors, bins, markers."""

    tolerance: float = 0.02
    alignment: str = "se3"
    scale: bool = False
    step: float = 1.0
    bin_width: float = 10.0
    markers: tuple[float, ...] = (10.0, 50.0, 100.0)
    bucket: float | None = None

    def __post_init__(self) -> None:
        if self.alignment not in ("se3", "none"):
            raise ValueError("alignment must be se3 or none")
        if min(self.step, self.bin_width) <= 0 or self.tolerance < 0:
            raise ValueError("step and bin_width must be positive, tolerance not negative")


@dataclass(frozen=True)
class Evaluation:
    """Frames by key. summary: every key's counts, problem, errors and drift in one plan. problems: keys that can't be
    evaluated, and why; the other frames leave them out, but for coverage, runtime and failures, which need no reference."""

    summary: DataFrame
    problems: DataFrame
    coverage: DataFrame
    runtime: DataFrame | None
    failures: DataFrame
    diagnostics: DataFrame
    alignment: DataFrame | None
    matched: DataFrame
    ate: DataFrame
    relative: DataFrame
    rpe: DataFrame
    drift: DataFrame
    heading: DataFrame | None
    markers: DataFrame
    drift_bins: DataFrame
    error_vs_time: DataFrame
    error_vs_distance: DataFrame


def with_reference_names(matched: DataFrame, names: list[str]) -> DataFrame:
    return matched.select("*", *[F.col(f"near.{n}").alias(f"ref_{n}") for n in names], F.col("near.ref_idx").alias("ref_idx"), F.col("near.t").alias("ref_t")).drop("near")


def of_good_keys(rows: DataFrame, keys: list[str], matched: Column) -> DataFrame:
    """Rows of keys that have enough matched rows."""
    return rows.withColumn("_many", F.count_if(matched).over(Window.partitionBy(*keys))).where(F.col("_many") >= LEAST_ROWS).drop("_many")


def evaluate_trajectories(estimate: DataFrame, reference: DataFrame, keys: list[str], settings: Settings = Settings(), store: str | None = None) -> Evaluation:
    """estimate: keys, idx (its order), t, x, y, z, health, perhaps qx..qw and latency_ms; reference: keys, ref_idx, t, x, y, z,
    perhaps qx..qw.

    Rows in a state other than OK and DEGRADED aren't matched. Distances run along the eligible rows, as estimated; errors
    are taken after the alignment. Every frame is a plan over the two inputs that matches them once (an alignment takes a
    second look at the match), for all keys at once. With store, a path in a folder that driver and executors share, the
    match is written there first, and all frames read it: for callers that want many of them.
    """
    order, has = ["t", "idx"], [q for q in QUATERNION if q in estimate.columns and q in reference.columns]
    turns = has if len(has) == 4 else []
    pose = [*AXES, *turns]
    # Distances run along the eligible rows alone; the others' own are never read.
    walking = sequences.cumulative_distance(estimate.withColumn("_eligible", F.coalesce(F.col("health").isin(*HEALTHY), F.lit(False))), [*keys, "_eligible"], list(AXES), order)
    eligible = walking.where("_eligible").drop("_eligible")
    near = asof.match_nearest(eligible, reference.select(*keys, "ref_idx", "t", *pose), keys, settings.tolerance, "idx", "ref_idx", bucket=settings.bucket)
    found_any = with_reference_names(near, pose)
    if store is not None:
        found_any.write.mode("overwrite").parquet(store)
        found_any = found_any.sparkSession.read.schema(found_any.schema).parquet(store)
    stats = walking.groupBy(*keys).agg(F.count("*").alias("source_count"), F.count_if("_eligible").alias("eligible_count"), F.max(F.when(F.col("_eligible"), F.col("distance"))).alias("cumulative_distance"))
    stats = stats.join(reference.groupBy(*keys).agg(F.count("*").alias("target_count")), keys, "left")
    # A key is evaluated if it has enough matched rows: the other conditions follow. Its rows carry their number, so that
    # no frame needs the match a second time to know.
    found = of_good_keys(found_any, keys, F.lit(True))

    alignment = None
    if settings.alignment == "se3":
        alignment = evaluate.align(found, keys, settings.scale)
        moved = evaluate.apply_alignment(found, alignment, keys)
        everything = evaluate.apply_alignment(estimate, alignment, keys)
        if turns:
            moved = moved.join(alignment.select(*keys, F.col("q").alias("_turn")), keys, "left")
            turned = geometry.multiply([F.col("_turn")[i] for i in range(4)], [F.col(q) for q in turns])
            moved = moved.withColumns({q: F.when(F.col("_turn").isNull(), F.col(q)).otherwise(v) for q, v in zip(turns, turned, strict=True)}).drop("_turn")
    else:
        moved, everything = found, estimate
    errors = evaluate.errors(moved, AXES)
    made = evaluate.ate(errors if alignment is not None else evaluate.errors(found_any, AXES), keys, order, matched=True)
    if alignment is not None:  # too few rows for an alignment are counted all the same
        made = made.drop("matched_count", "first_matched", "last_matched").join(found_any.groupBy(*keys).agg(*evaluate.matched_rows()), keys, "right")
    problem = F.when(F.col("target_count") == 0, "reference is empty").when(F.col("eligible_count") < LEAST_ROWS, "too few OK or DEGRADED rows").when(F.col("matched_count") < LEAST_ROWS, "too few matched rows")
    whole = stats.join(made, keys, "left").fillna(0, ["target_count", "matched_count"]).withColumn("problem", problem)
    percent = F.when(F.col("cumulative_distance") > 0, 100 * F.col("exact_drift") / F.col("cumulative_distance"))
    numbers = [c for c in made.columns if c not in (*keys, "matched_count", "first_matched", "last_matched", "exact_drift")]
    summary = diagnostics(whole.withColumn("drift_percent", percent)).drop("exact_drift").withColumns({c: F.when(F.col("problem").isNull(), F.col(c)) for c in [*numbers, "drift_percent"]})
    counts = stats.drop("cumulative_distance").join(found_any.groupBy(*keys).agg(*evaluate.matched_rows()), keys, "left").fillna(0, ["target_count", "matched_count"]).withColumn("problem", problem)

    walked = sequences.cumulative_distance(moved.drop("distance"), keys, list(AXES), order)
    relative = evaluate.relative_errors(walked, keys, "distance", settings.step, axes=AXES, quaternion=turns or None)
    e = F.col("error")
    rpe = relative.groupBy(*keys).agg(F.count("*").alias("n_pairs"), *[F.round(v, 6).alias(k) for k, v in {"rmse": F.sqrt(F.avg(e * e)), "mean": F.avg(e), "median": F.median(e), "std": F.stddev_pop(e), "min": F.min(e), "max": F.max(e)}.items()])

    length = eligible.groupBy(*keys).agg(F.max("distance").alias("cumulative_distance"))
    last = errors.groupBy(*keys).agg(F.max_by("error", F.struct(*order)).alias("final_drift"))
    drift = last.join(length, keys).withColumn("drift_percent", F.when(F.col("cumulative_distance") > 0, 100 * F.col("final_drift") / F.col("cumulative_distance")))
    heading = None
    if turns:
        yaw, ref_yaw = (geometry.yaw_degrees(*[F.col(f"{p}{q}") for q in turns]) for p in ("", "ref_"))
        wrapped = F.abs(geometry.wrap_degrees(yaw - ref_yaw))
        heading = moved.groupBy(*keys).agg(F.avg(wrapped).alias("mean_deg"), F.percentile(wrapped, 0.95).alias("p95_deg"))

    w = settings.bin_width
    by_time = everything.join(errors.select(*keys, "idx", *[F.col(f"ref_{a}") for a in AXES], "error", "gap"), [*keys, "idx"], "left")
    by_time = of_good_keys(by_time, keys, F.col("gap").isNotNull()).select(*keys, "idx", "t", *AXES, *[f"ref_{a}" for a in AXES], *[(F.col(a) - F.col(f"ref_{a}")).alias(f"error_{a}") for a in AXES], "error", "health", "gap")
    start = F.floor(F.col("distance") / w) * F.lit(w)
    by_distance = errors.select(*keys, "idx", "distance", "error", "health", "gap", start.alias("bin_start"), (start + w).alias("bin_end"))
    return Evaluation(
        summary=summary, problems=counts.where("problem is not null").select(*keys, "problem"), coverage=evaluate.coverage(estimate, keys, order), runtime=evaluate.runtime(estimate, keys, "latency_ms") if "latency_ms" in estimate.columns else None,
        failures=evaluate.failures(estimate, keys, order), diagnostics=diagnostics(counts), alignment=alignment, matched=errors, ate=evaluate.ate(errors, keys, order), relative=relative, rpe=rpe, drift=drift, heading=heading,
        markers=evaluate.first_reach(errors, keys, "distance", "error", list(settings.markers), order), drift_bins=bins_with_centres(evaluate.drift_bins(errors, keys, "distance", "error", w), w),
        error_vs_time=by_time, error_vs_distance=by_distance,
    )


def diagnostics(counts: DataFrame) -> DataFrame:
    """Counts of a match, with what is unmatched and the share of the larger side that is matched."""
    most = F.greatest("eligible_count", "target_count", F.lit(1))
    return counts.select("*", (F.col("eligible_count") - F.col("matched_count")).alias("unmatched_source_count"), (F.col("target_count") - F.col("matched_count")).alias("unmatched_target_count"), (F.col("matched_count") / most).alias("overlap_sufficiency"))


def bins_with_centres(bins: DataFrame, width: float) -> DataFrame:
    """Drift bins with bin_end and the centre that a plot puts their median at."""
    return bins.withColumns({"bin_end": F.col("bin_start") + width, "centre": F.col("bin_start") + width / 2})


def overlay(error_vs_time: DataFrame, keys: list[str]) -> DataFrame:
    """The matched rows of error_vs_time, as plots of a run over its reference read them."""
    return error_vs_time.where(" and ".join(f"ref_{a} is not null" for a in AXES)).select(*keys, "idx", "t", *AXES, *[f"ref_{a}" for a in AXES])


def heading_arrows(poses: DataFrame, keys: list[str], order: list[str], many: int = 12) -> DataFrame:
    """`many` rows of each key, evenly spaced by place from the first to the last (places cut to whole numbers)."""
    w = Window.partitionBy(*keys)
    rows = poses.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    # Row r is place k of many where k * (n - 1) / (many - 1) is cut to r.
    k = F.ceil(F.col("_r") * F.lit(many - 1) / F.greatest(F.col("_n") - 1, F.lit(1)) - 1e-9)
    return rows.where((k <= many - 1) & (F.floor(k * (F.col("_n") - 1) / (many - 1) + 1e-9) == F.col("_r"))).drop("_r", "_n")
