"""Registered queries of the evaluation, with equal DuckDB SQL: three axes, eligible rows, distances along these.

Alignment is left out here, as SQL has no decomposition of a matrix; tests hold it against numpy.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators import evaluate, evaluation, events
from trailmark.plans.catalogue import PACKET, query

TOLERANCE, BIN, STEP = 21_600.0, 400.0, 300.0
SETTINGS = evaluation.Settings(TOLERANCE, "none", step=STEP, bin_width=BIN, markers=(200.0, 1000.0, 1e9))

SQL_EST = """
est AS (SELECT seq, idx, t, x, y, x * y / 100 AS z, health FROM base WHERE idx % 2 = 1),
ref AS (SELECT seq, idx AS ref_idx, t AS u, x AS ref_x, y AS ref_y, x * y / 100 AS ref_z FROM base WHERE idx % 2 = 0)"""
SQL_EVAL = f"""{SQL_EST},
elig AS (SELECT *, sum(d) OVER (PARTITION BY seq ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS distance FROM (
    SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS d FROM est WHERE health IN ('OK', 'DEGRADED') WINDOW w AS (PARTITION BY seq ORDER BY t, idx))),
prev AS (SELECT e.*, r.u AS pu, r.ref_idx AS pi FROM elig e ASOF LEFT JOIN ref r ON e.seq = r.seq AND e.t > r.u),
both_ AS (SELECT e.*, r.u AS nu, r.ref_idx AS ni FROM prev e ASOF LEFT JOIN ref r ON e.seq = r.seq AND e.t <= r.u),
pick AS (SELECT *, nu IS NULL OR (pu IS NOT NULL AND abs(t - pu) < abs(nu - t)) AS take FROM both_),
hit AS (SELECT *, CASE WHEN take THEN pi ELSE ni END AS ref_idx, abs(t - CASE WHEN take THEN pu ELSE nu END) AS gap FROM pick),
best AS (SELECT * FROM hit WHERE gap <= {TOLERANCE} QUALIFY row_number() OVER (PARTITION BY seq, ref_idx ORDER BY gap, idx) = 1),
m AS (SELECT b.seq, b.idx, b.t, b.x, b.y, b.z, b.health, b.distance, b.gap, r.ref_idx, r.ref_x, r.ref_y, r.ref_z, sqrt((b.x - ref_x) ** 2 + (b.y - ref_y) ** 2 + (b.z - ref_z) ** 2) AS error
    FROM best b JOIN ref r ON b.seq = r.seq AND b.ref_idx = r.ref_idx WHERE b.seq IN (SELECT seq FROM best GROUP BY seq HAVING count(*) >= 3))"""


def streams(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Estimate (odd rows) and reference (even rows) with a third axis."""
    z = (F.col("x") * F.col("y") / 100).alias("z")
    return b.where("idx % 2 = 1").select("seq", "idx", "t", "x", "y", z, "health"), b.where("idx % 2 = 0").select("seq", F.col("idx").alias("ref_idx"), "t", "x", "y", z)


def evaluated(b: DataFrame) -> evaluation.Evaluation:
    return evaluation.evaluate_trajectories(*streams(b), ["seq"], SETTINGS)


def rounded(*names: str, to: int = 6) -> list:
    return [(F.round(n, to) + 0.0).alias(n) for n in names]


SQL_ATE = """ate AS (SELECT seq, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(error), 6) AS mean, round(median(error), 6) AS median, round(stddev_pop(error), 6) AS std, round(min(error), 6) AS min,
    round(max(error), 6) AS max, round(max_by(error, (t, idx)), 6) AS final_drift FROM m GROUP BY seq)"""


@query(f"{SQL_EVAL}, {SQL_ATE} SELECT * FROM ate")
def a13_ate(b: DataFrame) -> DataFrame:
    return evaluated(b).ate


SQL_DRIFT = """walked AS (SELECT seq, max(distance) AS far FROM elig GROUP BY seq),
drift AS (SELECT seq, max_by(error, (t, idx)) AS final_drift, any_value(far) AS far FROM m JOIN walked USING (seq) GROUP BY seq)"""


@query(f"{SQL_EVAL}, {SQL_DRIFT} SELECT seq, round(far, 4) AS cumulative_distance, round(CASE WHEN far > 0 THEN 100 * final_drift / far END, 6) AS drift_percent FROM drift")
def a14_drift_percent(b: DataFrame) -> DataFrame:
    return evaluated(b).drift.select("seq", *rounded("cumulative_distance", to=4), *rounded("drift_percent"))


SQL_BINS = f"""n AS (SELECT seq, greatest(ceil(max(distance) / {BIN}), 1)::BIGINT AS many FROM m GROUP BY seq), bins AS (SELECT seq, unnest(range(many)) AS bin FROM n),
stat AS (SELECT seq, least(floor(distance / {BIN})::BIGINT, many - 1) AS bin, count(*) AS n, median(error) AS median, quantile_cont(error, 0.75) - quantile_cont(error, 0.25) AS iqr FROM m JOIN n USING (seq) GROUP BY ALL)"""


@query(f"""{SQL_EVAL}, {SQL_BINS}
SELECT seq, bin, (bin * {BIN})::DOUBLE AS bin_start, coalesce(stat.n, 0) AS n, round(median, 6) AS median, round(iqr, 6) AS iqr FROM bins LEFT JOIN stat USING (seq, bin)""")
def a16_drift_bins(b: DataFrame) -> DataFrame:
    return evaluated(b).drift_bins.select("seq", "bin", "bin_start", "n", *[F.round(c, 6).alias(c) for c in ("median", "iqr")])


@query(f"{SQL_EVAL}, {SQL_BINS} SELECT seq, bin * {BIN} + {BIN / 2} AS centre, (bin + 1) * {BIN} AS bin_end, round(median, 6) AS median FROM bins JOIN stat USING (seq, bin)")
def v05_bin_centres(b: DataFrame) -> DataFrame:
    """What a drift-over-distance plot draws: centres and medians of the bins that have rows."""
    return evaluated(b).drift_bins.where("median is not null").select("seq", "centre", "bin_end", F.round("median", 6).alias("median"))


@query(f"""{SQL_EVAL},
turned AS (SELECT *, radians(y) AS a, radians(ref_y) AS ra FROM m),
far AS (SELECT *, sum(d) OVER (PARTITION BY seq ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS d FROM turned WINDOW w AS (PARTITION BY seq ORDER BY t, idx))),
there AS (SELECT seq, s AS u, x AS x2, y AS y2, z AS z2, ref_x AS rx2, ref_y AS ry2, ref_z AS rz2 FROM far QUALIFY row_number() OVER (PARTITION BY seq, s ORDER BY idx) = 1),
p AS (SELECT f.*, s + {STEP} AS want, h.u AS pu FROM (SELECT *, s + {STEP} AS w FROM far) f ASOF LEFT JOIN there h ON f.seq = h.seq AND f.w >= h.u),
q AS (SELECT p.*, h.u AS nu FROM p ASOF LEFT JOIN there h ON p.seq = h.seq AND p.want <= h.u),
pick2 AS (SELECT *, CASE WHEN nu IS NULL OR (pu IS NOT NULL AND want - pu <= nu - want) THEN pu ELSE nu END AS u FROM q),
way AS (SELECT k.seq, k.a, k.ra, x2 - x AS dx, y2 - y AS dy, z2 - z AS dz, rx2 - ref_x AS ex, ry2 - ref_y AS ey, rz2 - ref_z AS ez FROM pick2 k JOIN there h ON h.seq = k.seq AND h.u = k.u WHERE abs(want - k.u) <= {STEP * 0.1}),
err AS (SELECT seq, sqrt((dx * cos(a) + dy * sin(a) - ex * cos(ra) - ey * sin(ra)) ** 2 + (dy * cos(a) - dx * sin(a) - ey * cos(ra) + ex * sin(ra)) ** 2 + (dz - ez) ** 2) AS error FROM way)
SELECT seq, count(*) AS n_pairs, round(sqrt(avg(error * error)) / pi(), 5) AS rmse, round(avg(error) / pi(), 5) AS mean, round(median(error) / pi(), 5) AS median, round(max(error) / pi(), 5) AS max FROM err GROUP BY seq""")
def a17_relative_errors(b: DataFrame) -> DataFrame:
    """Relative errors seen from each row's own orientation, here a yaw of y degrees; by pi, so that no figure ends in a half."""
    turn = {"qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(F.radians("y") / 2), "qw": F.cos(F.radians("y") / 2)}
    estimate, reference = (s.withColumns(turn) for s in streams(b))
    relative = evaluation.evaluate_trajectories(estimate, reference, ["seq"], SETTINGS).relative
    e = F.col("error")
    made = {"rmse": F.sqrt(F.avg(e * e)), "mean": F.avg(e), "median": F.median(e), "max": F.max(e)}
    return relative.groupBy("seq").agg(F.count("*").alias("n_pairs"), *[F.round(v / math.pi, 5).alias(k) for k, v in made.items()])


SQL_TIMED = "timed AS (SELECT *, coalesce(lead(t) OVER w - t, CASE WHEN count(*) OVER s > 2 THEN t - lag(t) OVER w END, 0) AS lasts FROM base WINDOW w AS (PARTITION BY seq, px ORDER BY t, idx), s AS (PARTITION BY seq, px))"


@query(f"{SQL_TIMED.replace(', px', ', method')} SELECT seq, method, idx, round(lasts, 6) AS lasts FROM timed")
def a10_durations(b: DataFrame) -> DataFrame:
    return evaluate.durations(b, ["seq", "method"], ["t", "idx"]).select("seq", "method", "idx", F.round("lasts", 6).alias("lasts"))


@query(f"""{SQL_TIMED.replace(', px', '')},
c AS (SELECT seq, coalesce(sum(lasts) FILTER (WHERE health = 'OK'), 0) AS ok_s, coalesce(sum(lasts) FILTER (WHERE health = 'DEGRADED'), 0) AS degraded_s, coalesce(sum(lasts) FILTER (WHERE health = 'LOST'), 0) AS lost_s,
    coalesce(sum(lasts) FILTER (WHERE health = 'INVALID'), 0) AS invalid_s, max(t) - min(t) AS total_s FROM timed GROUP BY seq)
SELECT seq, round(ok_s, 4) AS ok_s, round(degraded_s, 4) AS degraded_s, round(lost_s, 4) AS lost_s, round(invalid_s, 4) AS invalid_s, round(total_s, 4) AS total_s,
       round(CASE WHEN total_s > 0 THEN ok_s / total_s ELSE 0 END, 6) AS ok_fraction, round(CASE WHEN total_s > 0 THEN lost_s / total_s ELSE 0 END, 6) AS lost_fraction, round(CASE WHEN total_s > 0 THEN invalid_s / total_s ELSE 0 END, 6) AS invalid_fraction FROM c""")
def a09_coverage(b: DataFrame) -> DataFrame:
    return evaluate.coverage(b, ["seq"], ["t", "idx"])


@query(f"""{SQL_TIMED.replace(', px', ', method')},
f AS (SELECT *, health IN ('LOST', 'INVALID') AS failed FROM timed), g AS (SELECT *, failed AND NOT coalesce(lag(failed) OVER (PARTITION BY seq, method ORDER BY t, idx), false) AS start FROM f)
SELECT seq, method, count(*) FILTER (WHERE health = 'OK') AS n_ok, count(*) FILTER (WHERE health = 'DEGRADED') AS n_degraded, count(*) FILTER (WHERE health = 'LOST') AS n_lost, count(*) FILTER (WHERE health = 'INVALID') AS n_invalid,
       count(*) FILTER (WHERE failed) AS n_failed, round(avg(failed::INT), 6) AS failed_fraction, count(*) FILTER (WHERE start) AS n_runs, round(coalesce(sum(lasts) FILTER (WHERE failed), 0), 4) AS failed_s FROM g GROUP BY seq, method""")
def a11_failures(b: DataFrame) -> DataFrame:
    return evaluate.failures(b, ["seq", "method"], ["t", "idx"])


@query("""
r AS (SELECT seq, count(*) AS n, max(t) - min(t) AS span, sum(x) / 1000.0 AS busy, round(avg(x), 6) AS mean_x, round(median(x), 6) AS median_x, round(quantile_cont(x, 0.95), 6) AS p95_x, round(max(x), 6) AS max_x FROM base GROUP BY seq)
SELECT seq, n, round(span, 4) AS duration_s, round(CASE WHEN span > 0 THEN (n - 1) / span ELSE 0 END, 9) AS frequency_hz, mean_x, median_x, p95_x, max_x, round(busy, 6) AS processing_s,
       round(CASE WHEN busy > 0 AND span > 0 THEN span / busy END, 4) AS real_time_factor FROM r""")
def a12_runtime(b: DataFrame) -> DataFrame:
    return evaluate.runtime(b, ["seq"], "x")


@query(f"""
span AS (SELECT seq, min(t) AS t0, max(t) AS t1, count(*) AS total, avg((p > 0)::INT) AS positive, greatest(ceil((max(t) - min(t)) / {PACKET}), 1)::BIGINT AS n FROM base GROUP BY seq),
win AS (SELECT seq, unnest(range(n)) AS win FROM span),
hit AS (SELECT b.seq, least(floor((t - t0) / {PACKET})::BIGINT, n - 1) AS win, count(*) AS c FROM base b JOIN span USING (seq) GROUP BY ALL),
rate AS (SELECT seq, min(coalesce(c, 0) / {PACKET}) AS lo, max(coalesce(c, 0) / {PACKET}) AS hi, count(*) FILTER (WHERE c IS NULL) AS empty_windows, count(*) FILTER (WHERE coalesce(c, 0) < 2) AS starved_windows,
    count(*) FILTER (WHERE coalesce(c, 0) > 2) AS overloaded_windows FROM win LEFT JOIN hit USING (seq, win) GROUP BY seq),
pixel AS (SELECT seq, py, count(*) AS c FROM base GROUP BY ALL), hot AS (SELECT seq, count(*) AS active, count(*) FILTER (WHERE c > 2 * a) AS hot FROM (SELECT *, avg(c) OVER (PARTITION BY seq) AS a FROM pixel) GROUP BY seq)
SELECT seq, total, round(positive, 6) AS positive, round(CASE WHEN t1 > t0 THEN total / (t1 - t0) ELSE 0 END, 9) AS mean_rate, round(lo, 9) AS min_rate, round(hi, 9) AS max_rate, empty_windows, starved_windows, overloaded_windows,
       round(active / 48.0, 6) AS active_fraction, round(hot / 48.0, 6) AS hot_fraction FROM span JOIN rate USING (seq) JOIN hot USING (seq)""")
def a05_stream_diag(b: DataFrame) -> DataFrame:
    activity = events.pixel_activity(b, ["seq"], ["py"], 2.0)
    return events.stream_diagnostics(b, ["seq"], PACKET, 1.5 / PACKET, 2.5 / PACKET, activity, 48)


@query(f"""{SQL_EVAL}
SELECT e.seq, e.idx, round(m.ref_x, 6) AS ref_x, round(e.x - m.ref_x, 6) + 0.0 AS error_x, round(e.z - m.ref_z, 6) + 0.0 AS error_z, round(m.error, 6) AS error, round(m.gap, 6) AS gap
FROM est e LEFT JOIN m ON e.seq = m.seq AND e.idx = m.idx WHERE e.seq IN (SELECT seq FROM m)""")
def j16_error_vs_time(b: DataFrame) -> DataFrame:
    return evaluated(b).error_vs_time.select("seq", "idx", F.round("ref_x", 6).alias("ref_x"), *rounded("error_x", "error_z"), *[F.round(c, 6).alias(c) for c in ("error", "gap")])


@query(f"{SQL_EVAL} SELECT seq, idx, round(distance, 4) AS distance, round(error, 6) AS error, health, round(gap, 6) AS gap, floor(distance / {BIN}) * {BIN} AS bin_start, floor(distance / {BIN}) * {BIN} + {BIN} AS bin_end FROM m")
def k05_error_vs_distance(b: DataFrame) -> DataFrame:
    found = evaluated(b).error_vs_distance
    return found.select("seq", "idx", F.round("distance", 4).alias("distance"), F.round("error", 6).alias("error"), "health", F.round("gap", 6).alias("gap"), "bin_start", "bin_end")


@query(f"{SQL_EVAL} SELECT seq, idx, round(t, 4) AS t, round(x, 6) AS x, round(ref_x, 6) AS ref_x, round(ref_z, 6) AS ref_z FROM m")
def v04_overlay(b: DataFrame) -> DataFrame:
    found = evaluation.overlay(evaluated(b).error_vs_time, ["seq"])
    return found.select("seq", "idx", F.round("t", 4).alias("t"), *[F.round(c, 6).alias(c) for c in ("x", "ref_x", "ref_z")])


@query("""
o AS (SELECT seq, idx, row_number() OVER (PARTITION BY seq ORDER BY t, idx) - 1 AS r, count(*) OVER (PARTITION BY seq) AS n FROM base), k AS (SELECT unnest(range(12)) AS k)
SELECT DISTINCT seq, idx FROM o JOIN k ON r = (k * (n - 1)) // 11""")
def v07_heading_arrows(b: DataFrame) -> DataFrame:
    return evaluation.heading_arrows(b, ["seq"], ["t", "idx"]).select("seq", "idx")


@query(f"""{SQL_EVAL}, {SQL_ATE}, {SQL_DRIFT},
c AS (SELECT seq, count(*) AS source_count, count(*) FILTER (WHERE health IN ('OK', 'DEGRADED')) AS eligible_count FROM est GROUP BY seq), r AS (SELECT seq, count(*) AS target_count FROM ref GROUP BY seq),
h AS (SELECT seq, count(*) AS matched_count FROM best GROUP BY seq),
all_ AS (SELECT c.*, coalesce(target_count, 0) AS target_count, coalesce(matched_count, 0) AS matched_count FROM c LEFT JOIN r USING (seq) LEFT JOIN h USING (seq))
SELECT seq, source_count, eligible_count, target_count, matched_count, eligible_count - matched_count AS unmatched_source_count, target_count - matched_count AS unmatched_target_count,
       round(matched_count / greatest(eligible_count, target_count, 1), 6) AS overlap_sufficiency,
       CASE WHEN target_count = 0 THEN 'reference is empty' WHEN eligible_count < 3 THEN 'too few OK or DEGRADED rows' WHEN matched_count < 3 THEN 'too few matched rows' END AS problem,
       rmse, std, round(CASE WHEN far > 0 THEN 100 * drift.final_drift / far END, 6) AS drift_percent FROM all_ LEFT JOIN ate USING (seq) LEFT JOIN drift USING (seq)""")
def x20_evaluation(b: DataFrame) -> DataFrame:
    """The evaluation of all sequences in one call, a row for each."""
    found = evaluated(b).summary
    counts = ["source_count", "eligible_count", "target_count", "matched_count", "unmatched_source_count", "unmatched_target_count"]
    return found.select("seq", *counts, F.round("overlap_sufficiency", 6).alias("overlap_sufficiency"), "problem", "rmse", "std", *rounded("drift_percent"))
