"""Evaluation of an estimated trajectory against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("OK", "DEGRADED", "LOST", "INVALID")
FAILED = ("LOST", "INVALID")


def errors(matched: DataFrame, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Distance between matched positions, along these axes."""
    square = sum(((F.col(a) - F.col(f"ref_{a}")) * (F.col(a) - F.col(f"ref_{a}")) for a in axes), F.lit(0.0))
    return matched.withColumn("error", F.sqrt(square))


def matched_rows() -> list[Column]:
    """A key's matched rows, and the first and last time of them."""
    return [F.count("*").alias("matched_count"), F.min("t").alias("first_matched"), F.max("t").alias("last_matched")]


def ate(errors: DataFrame, keys: list[str], order: list[str], matched: bool = False) -> DataFrame:
    """Absolute trajectory error of each key, and the error of its last matched row; with matched, also how many there are,
    their first and last times, and that error unrounded (exact_drift)."""
    e = F.col("error")
    made = {"rmse": F.sqrt(F.avg(e * e)), "mean": F.avg(e), "median": F.median(e), "std": F.stddev_pop(e), "min": F.min(e), "max": F.max(e), "final_drift": F.max_by(e, F.struct(*order))}
    more = [*matched_rows(), made["final_drift"].alias("exact_drift")] if matched else []
    return errors.groupBy(*keys).agg(*more, *[F.round(v, 6).alias(k) for k, v in made.items()])


def durations(poses: DataFrame, keys: list[str], order: list[str], t: str = "t") -> DataFrame:
    """Rows with lasts: seconds to the next row; the last repeats the one before in keys of three rows or more and has 0
    in shorter ones."""
    w = Window.partitionBy(*keys).orderBy(*order)
    alone = F.row_number().over(w) <= 2  # only asked of the last row: whether its key has two rows or fewer
    lasts = F.coalesce(F.lead(t).over(w) - F.col(t), F.when(~alone, F.col(t) - F.lag(t).over(w)), F.lit(0.0))
    return poses.withColumn("lasts", lasts)


def coverage(poses: DataFrame, keys: list[str], order: list[str], t: str = "t") -> DataFrame:
    """Seconds in each state and from the first to the last row, and the states' shares of these (0 of none)."""
    timed = durations(poses, keys, order, t)
    seconds = [F.coalesce(F.sum(F.when(F.col("health") == s, F.col("lasts"))), F.lit(0.0)).alias(f"{s.lower()}_s") for s in STATES]
    found = timed.groupBy(*keys).agg(*seconds, (F.max(t) - F.min(t)).alias("total_s"))
    shares = [F.when(F.col("total_s") > 0, F.col(f"{s}_s") / F.col("total_s")).otherwise(0.0).alias(f"{s}_fraction") for s in ("ok", "lost", "invalid")]
    return found.select(*keys, *[F.round(f"{s.lower()}_s", 4).alias(f"{s.lower()}_s") for s in STATES], F.round("total_s", 4).alias("total_s"), *[F.round(x, 6).alias(f"{s}_fraction") for x, s in zip(shares, ("ok", "lost", "invalid"), strict=True)])


def failures(poses: DataFrame, keys: list[str], order: list[str], t: str = "t") -> DataFrame:
    """Rows of each state, failed rows, their share and seconds, and runs of them."""
    failed = F.col("health").isin(*FAILED)
    before = F.coalesce(F.lag(failed).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(False))
    marked = durations(poses, keys, order, t).withColumn("_failed", failed).withColumn("_start", failed & ~before)
    return marked.groupBy(*keys).agg(
        *[F.count_if(F.col("health") == s).alias(f"n_{s.lower()}") for s in STATES], F.count_if("_failed").alias("n_failed"), F.round(F.avg(F.col("_failed").cast("int")), 6).alias("failed_fraction"),
        F.count_if("_start").alias("n_runs"), F.round(F.coalesce(F.sum(F.when(F.col("_failed"), F.col("lasts"))), F.lit(0.0)), 4).alias("failed_s"),
    )


def runtime(poses: DataFrame, keys: list[str], latency: str, t: str = "t") -> DataFrame:
    """Updates, seconds, updates a second; mean, median, exact 95th percentile and maximum of the finite latencies (in
    milliseconds), their sum in seconds, and the real-time factor: seconds by that sum, null without latency or time."""
    x = F.when(~F.isnan(latency) & (F.abs(latency) != float("inf")), F.col(latency))
    made = {"mean": F.avg(x), "median": F.median(x), "p95": F.percentile(x, 0.95), "max": F.max(x)}
    span = F.max(t) - F.min(t)
    found = poses.groupBy(*keys).agg(F.count("*").alias("n"), span.alias("_span"), (F.sum(x) / 1000.0).alias("_busy"), *[F.round(v, 6).alias(f"{k}_{latency}") for k, v in made.items()])
    frequency = F.when(F.col("_span") > 0, (F.col("n") - 1) / F.col("_span")).otherwise(0.0)
    factor = F.when((F.col("_busy") > 0) & (F.col("_span") > 0), F.col("_span") / F.col("_busy"))
    return found.select(*keys, "n", F.round("_span", 4).alias("duration_s"), F.round(frequency, 9).alias("frequency_hz"), *[f"{k}_{latency}" for k in made], F.round("_busy", 6).alias("processing_s"), F.round(factor, 4).alias("real_time_factor"))


def first_reach(poses: DataFrame, keys: list[str], distance: str, value: str, markers: list[float], order: list[str]) -> DataFrame:
    """The value at the first row whose distance reaches each marker; null if none does."""
    named = [F.min_by(value, F.when(F.col(distance) >= m, F.struct(*order))).alias(f"_{i}") for i, m in enumerate(markers)]
    reached = [F.struct(F.lit(m).alias("marker"), F.when(F.col("_far") >= m, F.col(f"_{i}")).alias(value)) for i, m in enumerate(markers)]
    found = poses.groupBy(*keys).agg(F.max(distance).alias("_far"), *named)
    return found.select(*keys, F.inline(F.array(*reached)))


def rank_runs(runs: DataFrame, keys: list[str], drift: str, tie: str) -> DataFrame:
    """Rank by drift, null and non-finite ones last."""
    finite = F.when(~F.isnan(drift) & (F.abs(drift) != float("inf")), F.col(drift))
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(finite.asc_nulls_last(), tie)))


def drift_bins(errors: DataFrame, keys: list[str], distance: str, error: str, width: float) -> DataFrame:
    """keys, bin, bin_start, n, median, iqr: bins of the distance up to the last row's, the last one closed, empty ones kept."""
    last = errors.groupBy(*keys).agg(F.greatest(F.ceil(F.max(distance) / width), F.lit(1)).cast("long").alias("many"))
    binned = errors.join(last, keys).withColumn("bin", F.least(F.floor(F.col(distance) / width), F.col("many") - 1))
    stats = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.median(error).alias("median"), (F.percentile(error, 0.75) - F.percentile(error, 0.25)).alias("iqr"))
    every = last.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("bin"))
    return every.join(stats, [*keys, "bin"], "left").select(*keys, "bin", (F.col("bin") * F.lit(width)).alias("bin_start"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "median", "iqr")


def iqr_band(bins: DataFrame) -> DataFrame:
    """Drift bins with low and high: half the interquartile range to either side of the median, the lower end not below 0."""
    return bins.withColumn("low", F.greatest(F.col("median") - F.col("iqr") / 2, F.lit(0.0))).withColumn("high", F.col("median") + F.col("iqr") / 2)


def improvement(runs: DataFrame, base: str, error: str, by: list[str]) -> DataFrame:
    """by, n, improvement: how much less the error is than the base's, as a share of the base's (at least 1e-6), on average."""
    share = (F.col(base) - F.col(error)) / F.greatest(F.col(base), F.lit(1e-6))
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(share).alias("improvement"))


def relative_errors(matched: DataFrame, keys: list[str], distance: str, delta: float, tolerance: float = 0.1, axes: tuple[str, ...] = ("x", "y", "z"), quaternion: list[str] | None = None) -> DataFrame:
    """Translation error between each row and the one nearest to `delta` further along (within a share of it).

    Found by an as-of join on the distance axis; of equally far rows the first counts, of two equally near the nearer
    one. matched has the axes and ref_ of them; with a quaternion (names of x, y, z, w columns, and ref_ of them) both
    ways are seen from their row's own orientation. Rows that stand still share a distance; idx orders them.
    """
    from trailmark.functions.geometry import rotate_back
    from trailmark.operators.asof import nearest

    own = [*axes, *[f"ref_{a}" for a in axes]]
    turned = [*quaternion, *[f"ref_{q}" for q in quaternion]] if quaternion else []
    ahead = matched.select(*keys, (F.col(distance) + delta).alias("d"), "idx", *[F.col(c).alias(f"a_{c}") for c in [*own, *turned]])
    first = F.min_by(F.struct(*own), "idx").alias("_first")
    there = matched.groupBy(*keys, F.col(distance).alias("d")).agg(first).select(*keys, "d", "_first.*")
    pairs = nearest(ahead, there, keys, "d", tie="prev").where(F.col("gap") <= tolerance * delta)
    ways = [[F.col(f"near.{p}{a}") - F.col(f"a_{p}{a}") for a in axes] for p in ("", "ref_")]
    if quaternion:
        ways = [rotate_back([F.col(f"a_{p}{q}") for q in quaternion], way) for p, way in zip(("", "ref_"), ways, strict=True)]
    square = sum(((x - y) * (x - y) for x, y in zip(*ways, strict=True)), F.lit(0.0))
    return pairs.select(*keys, "idx", F.sqrt(square).alias("error"))


def align(matched: DataFrame, keys: list[str], scale: bool = False) -> DataFrame:
    """keys, n, r (nine numbers by rows), tx, ty, tz, s, q (r as x, y, z, w): the least-squares similarity from x, y, z to ref_x, ref_y, ref_z.

    The sums are one aggregation; a task then decomposes one 3 x 3 matrix for each key. Fewer than three rows, or rows
    on one line, give nulls.
    """
    import numpy as np
    import pandas as pd

    axes = ["x", "y", "z"]
    sums = [F.sum(F.col(a)).alias(a) for a in axes] + [F.sum(F.col(f"ref_{a}")).alias(f"ref_{a}") for a in axes]
    cross = [F.sum(F.col(f"ref_{a}") * F.col(b)).alias(f"c_{a}{b}") for a in axes for b in axes]
    square = F.sum(sum((F.col(a) * F.col(a) for a in axes), F.lit(0.0))).alias("square")
    stats = matched.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *cross, square)

    def quaternion(r: np.ndarray) -> list[float]:
        """x, y, z, w of a rotation matrix, from its largest component."""
        (a, b, c), (d, e, f), (g, h, i) = r
        squares = [1 + a - e - i, 1 - a + e - i, 1 - a - e + i, 1 + a + e + i]
        rows = [[squares[0], b + d, c + g, h - f], [b + d, squares[1], f + h, c - g], [c + g, f + h, squares[2], d - b], [h - f, c - g, d - b, squares[3]]]
        out = np.array(rows[int(np.argmax(squares))])
        return (out / np.linalg.norm(out)).tolist()

    def solve(parts):
        for rows in parts:
            out = []
            for row in rows.to_dict("records"):
                n, p, q = row["n"], np.array([row[a] for a in axes]), np.array([row[f"ref_{a}"] for a in axes])
                p, q = p / n, q / n
                c = np.array([row[f"c_{a}{b}"] for a in axes for b in axes]).reshape(3, 3) / n - np.outer(q, p)
                u, d, vt = np.linalg.svd(c)
                if n < 3 or d[1] <= 1e-12 * max(d[0], 1e-300):
                    out.append([None] * 6)
                    continue
                mirror = np.array([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
                r = u @ np.diag(mirror) @ vt
                s = float((d * mirror).sum() / (row["square"] / n - p @ p)) if scale else 1.0
                out.append([r.ravel().tolist(), *(q - s * r @ p).tolist(), s, quaternion(r)])
            yield pd.concat([rows[[*keys, "n"]].reset_index(drop=True), pd.DataFrame(out, columns=["r", "tx", "ty", "tz", "s", "q"])], axis=1)

    key = ", ".join(f"`{k}` {matched.schema[k].dataType.simpleString()}" for k in keys)
    return stats.mapInPandas(solve, f"{key}, n long, r array<double>, tx double, ty double, tz double, s double, q array<double>")


def apply_alignment(poses: DataFrame, alignment: DataFrame, keys: list[str]) -> DataFrame:
    """Poses with x, y, z moved by their key's alignment; unchanged where it is null."""
    joined = poses.join(alignment.select(*keys, "r", "tx", "ty", "tz", "s"), keys, "left")
    moved = [F.coalesce(F.col(f"t{a}") + F.col("s") * sum((F.col("r")[3 * i + j] * F.col(b) for j, b in enumerate("xyz")), F.lit(0.0)), F.col(a)).alias(a) for i, a in enumerate("xyz")]
    return joined.select(*[c for c in poses.columns if c not in ("x", "y", "z")], *moved)


def labels(runs: DataFrame, method: str, order: list[str]) -> DataFrame:
    """Runs with label: the method, and for its second and later runs the run's name behind it."""
    # Only each method's first run is found, by aggregation, so that no task sorts all runs of a method.
    first = runs.groupBy(method).agg(F.min(F.struct(*order)).alias("_first"))
    joined = runs.join(first, method)
    is_first = F.struct(*order) == F.col("_first")
    return joined.withColumn("label", F.when(is_first, F.col(method)).otherwise(F.format_string("%s (%s)", F.col(method), F.col("run").cast("string")))).drop("_first")
