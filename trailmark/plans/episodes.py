"""Registered queries of perturbed estimates, episodes and event cues, with equal DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators import episodes
from trailmark.plans.catalogue import query
from trailmark.plans.motion import rounded, rows_only

DAY = 86_400.0
BIAS = episodes.Perturbation("click", "bias_ramp", 5 * DAY, 15 * DAY, 30.0, (3.0, 4.0, 0.0))
LIE = episodes.Perturbation("view", "confident_bias", 2 * DAY, 9 * DAY, 20.0, (0.0, 0.0, 2.0))
GONE = episodes.Perturbation("click", "dropout", 12 * DAY, 13 * DAY)
NOISE = episodes.Perturbation("click", "noise_burst", 3 * DAY, 20 * DAY, 2.0, seed=17)


def posed(b: DataFrame) -> DataFrame:
    return b.select("seq", "idx", "method", "t", "x", "y", (F.col("x") * F.col("y") / 100).alias("z"), "confidence", "health")


@query(f"""
p AS (SELECT *, least(greatest((t - {BIAS.start}) / {BIAS.end - BIAS.start}, 0), 1) AS r1, least(greatest((t - {LIE.start}) / {LIE.end - LIE.start}, 0), 1) AS r2,
    method = 'click' AND t BETWEEN {BIAS.start} AND {BIAS.end} AS biased, method = 'view' AND t BETWEEN {LIE.start} AND {LIE.end} AS lied, method = 'click' AND t BETWEEN {GONE.start} AND {GONE.end} AS gone FROM base)
SELECT idx, round(CASE WHEN biased THEN x + 30 * r1 * 0.6 ELSE x END, 6) AS x, round(CASE WHEN biased THEN y + 30 * r1 * 0.8 ELSE y END, 6) AS y, round(CASE WHEN lied THEN x * y / 100 + 20 * r2 ELSE x * y / 100 END, 6) AS z,
       round(CASE WHEN gone THEN 0 WHEN biased THEN confidence * 0.6 ELSE confidence END, 6) AS confidence, CASE WHEN gone THEN 'LOST' ELSE health END AS health FROM p""")
def w21_perturbed(b: DataFrame) -> DataFrame:
    """A ramped bias, a confident one and a dropout in turn."""
    found = episodes.perturbed(posed(b), ["seq"], [BIAS, LIE, GONE], ["t", "idx"])
    return found.select("idx", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "confidence")], "health")


@rows_only
def w21_noise(b: DataFrame) -> DataFrame:
    """A noise burst, drawn from its seed for each sequence; tests hold it against the generator itself."""
    found = episodes.perturbed(posed(b), ["seq"], [NOISE], ["t", "idx"])
    return found.select("idx", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "confidence")])


SQL_EPISODES = """
imu AS (SELECT seq, idx, t FROM base WHERE idx % 2 = 0), gt AS (SELECT seq, t AS u, x FROM base WHERE idx % 2 = 1 AND method <> 'click'), est AS (SELECT seq, idx, t, t AS u, x FROM base WHERE method = 'click'),
i_ AS (SELECT seq, min(t) AS a, max(t) AS b FROM imu GROUP BY seq), g_ AS (SELECT seq, min(u) AS c, max(u) AS d FROM gt GROUP BY seq),
span AS (SELECT seq, greatest(a, c) AS t0, least(b, d) AS t1 FROM i_ JOIN g_ USING (seq) WHERE least(b, d) > greatest(a, c)),
num AS (SELECT seq, t0, t1, unnest(range(CASE WHEN t1 - t0 > 432000.0 THEN floor((t1 - t0 - 432000.0 + 1e-9) / 216000.0)::BIGINT ELSE 0 END + 1)) AS win FROM span),
win AS (SELECT seq, win, t0 + win * 216000.0 AS lo, CASE WHEN t1 - t0 > 432000.0 THEN t0 + win * 216000.0 + 432000.0 ELSE t1 END AS hi FROM num),
d1 AS (SELECT i.*, g.u AS pu, g.x AS px_ FROM imu i ASOF LEFT JOIN gt g ON i.seq = g.seq AND i.t >= g.u), d2 AS (SELECT d1.*, g.u AS nu, g.x AS nx_ FROM d1 ASOF LEFT JOIN gt g ON d1.seq = g.seq AND d1.t <= g.u),
dense AS (SELECT seq, idx, t, CASE WHEN pu IS NULL THEN nx_ WHEN nu IS NULL THEN px_ WHEN nu > pu THEN px_ + (t - pu) / (nu - pu) * (nx_ - px_) ELSE px_ END AS ref FROM d2),
s AS (SELECT w.seq, w.win, w.lo, w.hi, d.idx, d.t, d.ref, row_number() OVER k AS r, lead(d.t) OVER k AS nt, lead(d.ref) OVER k AS nref FROM win w JOIN dense d ON d.seq = w.seq AND d.t >= lo AND d.t <= hi WINDOW k AS (PARTITION BY w.seq, w.win ORDER BY d.t)),
start AS (SELECT seq, win, lo, hi, ref, CASE WHEN nt > t THEN (nref - ref) / (nt - t) ELSE 0 END AS v FROM s WHERE r = 1 AND nt IS NOT NULL)"""


def parts(b: DataFrame) -> episodes.Episodes:
    imu, gt, est = b.where("idx % 2 = 0").select("seq", "idx", "t"), b.where("idx % 2 = 1 and method <> 'click'").select("seq", "t", "x"), b.where("method = 'click'").select("seq", "method", "idx", "t", "x")
    return episodes.build_episodes(imu, gt, est, ["seq"], 432_000.0, 216_000.0, ("x",))


@query(f"{SQL_EPISODES} SELECT seq, win, round(lo, 4) AS lo, round(hi, 4) AS hi, round(ref, 6) AS ref_x, round(v, 9) + 0.0 AS vx FROM start")
def w23_episodes(b: DataFrame) -> DataFrame:
    """Windows with the reference's position and velocity at their start."""
    return parts(b).windows.select("seq", "win", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), F.round("ref_x", 6).alias("ref_x"), *rounded("vx", to=9))


@query(f"""{SQL_EPISODES},
a1 AS (SELECT w.seq, w.win, w.lo, e.u AS pu, e.x AS px_ FROM win w ASOF LEFT JOIN est e ON w.seq = e.seq AND w.lo >= e.u), a2 AS (SELECT a1.*, e.u AS nu, e.x AS nx_ FROM a1 ASOF LEFT JOIN est e ON a1.seq = e.seq AND a1.lo <= e.u),
anchor AS (SELECT seq, win, CASE WHEN pu IS NULL THEN nx_ WHEN nu IS NULL THEN px_ WHEN nu > pu THEN px_ + (lo - pu) / (nu - pu) * (nx_ - px_) ELSE px_ END AS at_ FROM a2)
SELECT e.seq, win, e.idx, round(e.x + ref - at_, 6) + 0.0 AS x FROM est e JOIN start USING (seq) JOIN anchor USING (seq, win) WHERE e.t >= lo AND e.t <= hi""")
def w23_rebased(b: DataFrame) -> DataFrame:
    """Estimates of each episode, shifted to agree with the reference at its start."""
    return parts(b).estimates.select("seq", "win", "idx", *rounded("x"))


FOCAL, DEPTH, GAIN, MOST = 200.0, 100.0, 0.5, 40.0


def cues(b: DataFrame) -> DataFrame:
    w = Window.partitionBy("seq").orderBy("t", "idx")
    pairs = b.where("method = 'view'").select("seq", F.col("idx").alias("pair"), F.lag("t").over(w).alias("lo"), F.col("t").alias("hi"), ((F.col("x") - 100) / 10).alias("shift_x"), ((F.col("y") - 20) / 10).alias("shift_y"), "confidence", (F.col("idx") % 7 != 0).alias("valid"), F.when(F.col("idx") % 7 != 0, "ok").otherwise("no_events").alias("reason")).where("lo is not null")
    imu = b.where("idx % 2 = 0").select("seq", "t", ((F.col("x") - 100) * 1e-6).alias("gx"), ((F.col("y") - 20) * 1e-6).alias("gy"))
    half, zero = F.radians("y") / 2, F.lit(0.0)
    trajectory = b.where("idx % 2 = 1").select("seq", "t", "x", "y", (F.col("x") * F.col("y") / 100).alias("z"), zero.alias("qx"), zero.alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))
    return episodes.pair_cues(pairs, imu, trajectory, ["seq"], FOCAL, DEPTH, GAIN, MOST, 0.2, width=DAY)


@query(f"""
imu AS (SELECT seq, t AS u, (x - 100) * 1e-6 AS gx, (y - 20) * 1e-6 AS gy FROM base WHERE idx % 2 = 0), trj AS (SELECT seq, t AS u, x, y, x * y / 100 AS z, radians(y) AS a FROM base WHERE idx % 2 = 1),
pr AS (SELECT seq, idx AS pair, lag(t) OVER w AS lo, t AS hi, (x - 100) / 10 AS sx, (y - 20) / 10 AS sy, confidence, idx % 7 <> 0 AS valid FROM base WHERE method = 'view' WINDOW w AS (PARTITION BY seq ORDER BY t, idx)),
p AS (SELECT *, (lo + hi) / 2 AS mid FROM pr WHERE lo IS NOT NULL), mean AS (SELECT p.seq, pair, avg(gx) AS mx, avg(gy) AS my FROM p JOIN imu i ON i.seq = p.seq AND u >= lo AND u <= hi GROUP BY ALL),
i1 AS (SELECT p.*, i.u AS pu, i.gx AS pgx, i.gy AS pgy FROM p ASOF LEFT JOIN imu i ON p.seq = i.seq AND p.mid >= i.u), i2 AS (SELECT i1.*, i.u AS nu, i.gx AS ngx, i.gy AS ngy FROM i1 ASOF LEFT JOIN imu i ON i1.seq = i.seq AND i1.mid <= i.u),
gyr AS (SELECT seq, pair, CASE WHEN nu IS NULL OR (pu IS NOT NULL AND mid - pu <= nu - mid) THEN pgx ELSE ngx END AS nx_, CASE WHEN nu IS NULL OR (pu IS NOT NULL AND mid - pu <= nu - mid) THEN pgy ELSE ngy END AS ny_ FROM i2),
t1 AS (SELECT p.*, r.u AS pu, r.a AS pa FROM p ASOF LEFT JOIN trj r ON p.seq = r.seq AND p.mid >= r.u), t2 AS (SELECT t1.*, r.u AS nu, r.a AS na FROM t1 ASOF LEFT JOIN trj r ON t1.seq = r.seq AND t1.mid <= r.u),
yaw AS (SELECT seq, pair, CASE WHEN nu IS NULL OR (pu IS NOT NULL AND mid - pu <= nu - mid) THEN pa ELSE na END AS a FROM t2),
ends AS (SELECT seq, pair, k, CASE k WHEN 0 THEN lo ELSE hi END AS t FROM p, (VALUES (0), (1)) v(k)),
e1 AS (SELECT e.*, r.u AS pu, r.x AS ax, r.y AS ay, r.z AS az FROM ends e ASOF LEFT JOIN trj r ON e.seq = r.seq AND e.t >= r.u), e2 AS (SELECT e1.*, r.u AS nu, r.x AS bx, r.y AS by_, r.z AS bz, CASE WHEN r.u > pu THEN (t - pu) / (r.u - pu) ELSE 0 END AS w FROM e1 ASOF LEFT JOIN trj r ON e1.seq = r.seq AND e1.t <= r.u),
pos AS (SELECT seq, pair, k, CASE WHEN pu IS NULL THEN bx WHEN nu IS NULL THEN ax ELSE ax + w * (bx - ax) END AS x, CASE WHEN pu IS NULL THEN by_ WHEN nu IS NULL THEN ay ELSE ay + w * (by_ - ay) END AS y, CASE WHEN pu IS NULL THEN bz WHEN nu IS NULL THEN az ELSE az + w * (bz - az) END AS z FROM e2),
way AS (SELECT seq, pair, max_by(x, k) - min_by(x, k) AS dx, max_by(y, k) - min_by(y, k) AS dy, max_by(z, k) - min_by(z, k) AS dz FROM pos GROUP BY seq, pair),
cam AS (SELECT p.*, a, dx, dy, dz, hi - lo AS dt, -(sx + {FOCAL} * (hi - lo) * coalesce(my, ny_, 0)) * {DEPTH} / {FOCAL} AS vx, -(sy - {FOCAL} * (hi - lo) * coalesce(mx, nx_, 0)) * {DEPTH} / {FOCAL} AS vy
    FROM p LEFT JOIN mean USING (seq, pair) LEFT JOIN gyr USING (seq, pair) LEFT JOIN yaw USING (seq, pair) LEFT JOIN way USING (seq, pair)),
raw AS (SELECT *, {GAIN} * confidence * (vx * cos(a) - vy * sin(a) - dx) AS cx, {GAIN} * confidence * (vx * sin(a) + vy * cos(a) - dy) AS cy, {GAIN} * confidence * (-dz) AS cz FROM cam),
cap AS (SELECT *, CASE WHEN sqrt(cx * cx + cy * cy + cz * cz) > {MOST} THEN {MOST} / sqrt(cx * cx + cy * cy + cz * cz) ELSE 1 END AS s, valid AND dt > 0 AND confidence >= 0.2 AS applied FROM raw WHERE a IS NOT NULL)
SELECT seq, pair, round(CASE WHEN applied THEN cx * s ELSE 0 END, 5) + 0.0 AS cx, round(CASE WHEN applied THEN cy * s ELSE 0 END, 5) + 0.0 AS cy, round(CASE WHEN applied THEN cz * s ELSE 0 END, 5) + 0.0 AS cz, applied,
       CASE WHEN NOT valid THEN 'no_events' WHEN dt <= 0 THEN 'non_positive_dt' WHEN confidence < 0.2 THEN 'low_confidence' ELSE 'ok' END AS reason, round(CASE WHEN NOT valid OR dt <= 0 THEN 0 ELSE confidence END, 6) AS confidence FROM cap""")
def w17_pair_cues(b: DataFrame) -> DataFrame:
    """Corrections of consecutive frames, here of sequences that have a trajectory."""
    found = cues(b).join(b.where("idx % 2 = 1").select("seq").distinct(), "seq", "left_semi")
    return found.select("seq", "pair", *[(F.round(f"correction_{a}", 5) + 0.0).alias(f"c{a}") for a in "xyz"], "applied", "reason", F.round("confidence", 6).alias("confidence"))


@query(f"""
o AS (SELECT seq, t, floor(t / {DAY})::BIGINT AS step, row_number() OVER (PARTITION BY seq ORDER BY t, idx) AS r, (y - 100) * 1e-8 AS gx, (x - 100) * 1e-8 AS gy, (x - 100) * 2e-8 AS gz, t - lag(t) OVER (PARTITION BY seq ORDER BY t, idx) AS dt FROM base WHERE method <> 'error'),
g AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) * coalesce(dt, 0) AS angle, abs(gx) + abs(gy) + abs(gz) AS s FROM o),
d AS (SELECT seq, r, step, CASE WHEN s > 0 THEN gx / s * sin(angle / 2) ELSE 0 END AS dx, CASE WHEN s > 0 THEN gy / s * sin(angle / 2) ELSE 0 END AS dy, CASE WHEN s > 0 THEN gz / s * sin(angle / 2) ELSE 0 END AS dz, CASE WHEN s > 0 THEN cos(angle / 2) ELSE 1 END AS dw FROM g),
walk AS (SELECT seq, r, step, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz, 1.0::DOUBLE AS qw FROM d WHERE r = 1
  UNION ALL SELECT d.seq, d.r, d.step, qw * dx + dw * qx + qy * dz - qz * dy, qw * dy + dw * qy + qz * dx - qx * dz, qw * dz + dw * qz + qx * dy - qy * dx, qw * dw - qx * dx - qy * dy - qz * dz FROM walk JOIN d ON d.seq = walk.seq AND d.r = walk.r + 1),
l AS (SELECT seq, step, max_by({{'x': qx, 'y': qy, 'z': qz, 'w': qw}}, r) AS q FROM walk GROUP BY seq, step),
s AS (SELECT seq, floor(t / {DAY})::BIGINT AS step, max(t) AS t FROM base GROUP BY ALL),
f AS (SELECT seq, step, t, last_value(q IGNORE NULLS) OVER (PARTITION BY seq ORDER BY step ROWS UNBOUNDED PRECEDING) AS q FROM s LEFT JOIN l USING (seq, step))
SELECT seq, step, round(t, 4) AS t, round(coalesce(q.x, 0), 6) + 0.0 AS qx, round(coalesce(q.y, 0), 6) + 0.0 AS qy, round(coalesce(q.z, 0), 6) + 0.0 AS qz, round(coalesce(q.w, 1), 6) + 0.0 AS qw FROM f""")
def w13_estimator_states(b: DataFrame) -> DataFrame:
    """States of a stepwise estimator: a step is a day."""
    step = F.floor(F.col("t") / DAY).alias("step")
    events = b.where("method = 'error'").select("seq", step, "t")
    imu = b.where("method <> 'error'").select("seq", step, "t", *[((F.col(c) - 100) * k).alias(n) for n, c, k in (("gx", "y", 1e-8), ("gy", "x", 1e-8), ("gz", "x", 2e-8))])
    return episodes.estimator_states(events, imu, ["seq"]).select("seq", "step", F.round("t", 4).alias("t"), *rounded("qx", "qy", "qz", "qw"))
