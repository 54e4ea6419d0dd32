"""Registered queries of resampling, windows, motion and geometry, with equal DuckDB SQL where SQL can express them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions import gates, geometry
from trailmark.operators import asof, evaluate, events, motion, sequences
from trailmark.plans.catalogue import BIN, ORACLE_SQL, PACKET, QUERIES, SQL_DIST, SQL_MATCH, base, matches, query

#: Seconds of a part of a sequence: what one task scans.
PART = 864_000.0

SQL_AROUND = """
grid AS (SELECT seq, idx, t FROM base WHERE idx % 2 = 0), src AS (SELECT seq, t AS u, x, y, confidence AS c, health AS h FROM base WHERE idx % 2 = 1),
prev AS (SELECT g.*, s.u AS pu, s.x AS ax, s.y AS ay, s.c AS ac, s.h AS ah FROM grid g ASOF LEFT JOIN src s ON g.seq = s.seq AND g.t >= s.u),
around AS (SELECT g.*, s.u AS nu, s.x AS bx, s.y AS by_, s.c AS bc, s.h AS bh, CASE WHEN s.u > pu THEN (t - pu) / (s.u - pu) ELSE 0 END AS w FROM prev g ASOF LEFT JOIN src s ON g.seq = s.seq AND g.t <= s.u)"""


def rows_only(f):
    """Registers a query that SQL can't express; tests compare it with a plain version."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(base(spark, sf_dir))
    return f


def rounded(*names: str, to: int = 6) -> list:
    return [(F.round(n, to) + 0.0).alias(n) for n in names]


@query(f"""{SQL_AROUND}
SELECT seq, idx, round(CASE WHEN pu IS NULL THEN bx WHEN nu IS NULL THEN ax ELSE ax + w * (bx - ax) END, 6) + 0.0 AS x,
       round(CASE WHEN pu IS NULL OR nu IS NULL THEN 0 ELSE least(greatest(ac + w * (bc - ac), 0), 1) END, 6) + 0.0 AS confidence,
       CASE WHEN pu IS NULL OR nu IS NULL THEN 'INVALID' WHEN t - pu <= nu - t THEN ah ELSE bh END AS health, pu IS NOT NULL AND nu IS NOT NULL AS in_range FROM around""")
def j06_resample(b: DataFrame) -> DataFrame:
    grid, src = b.where("idx % 2 = 0").select("seq", "idx", "t"), b.where("idx % 2 = 1")
    return motion.resample(grid, src, ["seq"], ["x", "y"]).select("seq", "idx", *rounded("x", "confidence"), "health", "in_range")


@query(f"""{SQL_AROUND},
pos AS (SELECT seq, idx, t, CASE WHEN pu IS NULL THEN bx WHEN nu IS NULL THEN ax ELSE ax + w * (bx - ax) END AS x FROM around),
step AS (SELECT *, lead(x) OVER o AS nx, lead(t) OVER o AS nt, lag(x) OVER o AS lx, lag(t) OVER o AS lt FROM pos WINDOW o AS (PARTITION BY seq ORDER BY t, idx))
SELECT seq, idx, round(x, 6) + 0.0 AS x, round(CASE WHEN nt IS NOT NULL THEN (nx - x) / CASE WHEN nt > t THEN nt - t ELSE 1e-9 END WHEN lt IS NOT NULL THEN (x - lx) / CASE WHEN t > lt THEN t - lt ELSE 1e-9 END ELSE 0 END, 6) + 0.0 AS velocity FROM step""")
def j07_reference_sample(b: DataFrame) -> DataFrame:
    grid, src = b.where("idx % 2 = 0").select("seq", "idx", "t"), b.where("idx % 2 = 1")
    at = asof.interpolate(grid, src.select("seq", "t", "x"), ["seq"], ["x"])
    return sequences.velocity(at, ["seq"], "x", ["t", "idx"]).select("seq", "idx", *rounded("x", "velocity"))


@query("""
win AS (SELECT seq, idx AS win, t - 1800 AS lo, t + 1800 AS hi FROM base WHERE method = 'error'), pts AS (SELECT seq, t AS u, x FROM base WHERE method = 'click'),
inside AS (SELECT w.seq, win, avg(x) AS m FROM win w JOIN pts p ON p.seq = w.seq AND u >= lo AND u <= hi GROUP BY ALL),
prev AS (SELECT w.*, (lo + hi) / 2 AS mid, p.u AS pu, p.x AS px_ FROM win w ASOF LEFT JOIN pts p ON w.seq = p.seq AND (lo + hi) / 2 >= p.u),
both_ AS (SELECT w.*, p.u AS nu, p.x AS nx_ FROM prev w ASOF LEFT JOIN pts p ON w.seq = p.seq AND mid <= p.u)
SELECT seq, win, round(coalesce(m, CASE WHEN nu IS NULL OR (pu IS NOT NULL AND abs(mid - pu) <= abs(nu - mid)) THEN px_ ELSE nx_ END), 6) + 0.0 AS x FROM both_ LEFT JOIN inside USING (seq, win)""")
def j11_mean_in_window(b: DataFrame) -> DataFrame:
    windows = b.where("method = 'error'").select("seq", F.col("idx").alias("win"), (F.col("t") - 1800).alias("lo"), (F.col("t") + 1800).alias("hi"))
    return motion.mean_in_windows(b.where("method = 'click'"), windows, ["seq"], "x", 3600.0, "win").select("seq", "win", *rounded("x"))


@query("""
cue AS (SELECT seq, t AS t0, lead(t) OVER o AS t1, x AS correction FROM base WHERE method = 'error' WINDOW o AS (PARTITION BY seq ORDER BY t, idx)),
sums AS (SELECT *, coalesce(sum(correction) OVER (PARTITION BY seq ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cue WHERE t1 IS NOT NULL)
SELECT b.seq, idx, round(coalesce(before + least((t - t0) / (t1 - t0), 1) * correction, 0), 4) + 0.0 AS "offset" FROM base b ASOF LEFT JOIN sums s ON b.seq = s.seq AND b.t > s.t0""")
def j12_ramp_offsets(b: DataFrame) -> DataFrame:
    ahead = F.lead("t").over(Window.partitionBy("seq").orderBy("t", "idx"))
    cues = b.where("method = 'error'").select("seq", F.col("t").alias("t0"), ahead.alias("t1"), F.col("x").alias("correction")).where("t1 is not null")
    return motion.ramp_offsets(b.select("seq", "idx", "t"), cues, ["seq"]).select("seq", "idx", *rounded("offset", to=4))


@query(f"""
ends AS (SELECT seq, idx AS win, k, t + k * {PACKET} AS t FROM base, (SELECT unnest([-1, 1]) AS k) WHERE method = 'error'), src AS (SELECT seq, t AS u, x FROM base WHERE method <> 'error'),
prev AS (SELECT g.*, s.u AS pu, s.x AS ax FROM ends g ASOF LEFT JOIN src s ON g.seq = s.seq AND g.t >= s.u),
both_ AS (SELECT g.*, s.u AS nu, s.x AS bx FROM prev g ASOF LEFT JOIN src s ON g.seq = s.seq AND g.t <= s.u),
made AS (SELECT seq, win, k, CASE WHEN pu IS NULL THEN bx WHEN nu IS NULL THEN ax WHEN nu > pu THEN ax + (t - pu) / (nu - pu) * (bx - ax) ELSE ax END AS x FROM both_)
SELECT seq, win, round(max_by(x, k) - min_by(x, k), 6) + 0.0 AS x FROM made GROUP BY seq, win""")
def j14_displacement(b: DataFrame) -> DataFrame:
    windows = b.where("method = 'error'").select("seq", F.col("idx").alias("win"), (F.col("t") - PACKET).alias("lo"), (F.col("t") + PACKET).alias("hi"))
    return motion.displacement(windows, b.where("method <> 'error'"), ["seq"], "x", "win").select("seq", "win", *rounded("x"))


@query(f"{SQL_MATCH} SELECT seq, idx, ref_idx, round(x, 6) AS x, round(ref_x, 6) AS ref_x FROM matched WHERE health IN ('OK', 'DEGRADED')")
def j15_matched(b: DataFrame) -> DataFrame:
    """Matched rows among those that may be evaluated (F03)."""
    return matches(b).where(F.col("health").isin("OK", "DEGRADED")).select("seq", "idx", "ref_idx", *[F.round(c, 6).alias(c) for c in ("x", "ref_x")])


@query("""
span AS (SELECT seq, min(t) AS t0, max(t) AS t1 FROM base GROUP BY seq),
win AS (SELECT seq, t0, t1, unnest(range(CASE WHEN t1 - t0 > 432000.0 THEN floor((t1 - t0 - 432000.0 + 1e-9) / 216000.0)::BIGINT ELSE 0 END + 1)) AS win FROM span),
bounds AS (SELECT seq, win, t0 + win * 216000.0 AS lo, CASE WHEN t1 - t0 > 432000.0 THEN t0 + win * 216000.0 + 432000.0 ELSE t1 END AS hi FROM win)
SELECT w.seq, win, count(*) AS n, round(avg(x), 6) AS mean_x FROM bounds w JOIN base b ON b.seq = w.seq AND t >= lo AND t <= hi GROUP BY w.seq, win""")
def w03_hopping(b: DataFrame) -> DataFrame:
    windows = motion.hopping(b, ["seq"], 432000.0, 216000.0)
    return asof.in_windows(b.select("seq", "t", "x"), windows, ["seq"], 432000.0).groupBy("seq", "win").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean_x"))


SQL_ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY t, idx) AS r FROM base)"


@query(f"""{SQL_ORDERED},
walk AS (SELECT seq, idx, r, t, 0::BIGINT AS win, t AS start FROM o WHERE r = 1
  UNION ALL SELECT o.seq, o.idx, o.r, o.t, walk.win + (o.t >= start + 86400)::INT, CASE WHEN o.t >= start + 86400 THEN o.t ELSE start END FROM walk JOIN o ON o.seq = walk.seq AND o.r = walk.r + 1)
SELECT seq, idx, win FROM walk""")
def w04_control_windows(b: DataFrame) -> DataFrame:
    return motion.control_windows(b.select("seq", "idx", "t"), ["seq"], 86400.0, ["t", "idx"]).select("seq", "idx", "win")


@query("""
days AS (SELECT seq, floor(t / 86400)::BIGINT AS day, coalesce(avg(confidence) FILTER (WHERE method = 'click'), -1) AS click, coalesce(avg(confidence) FILTER (WHERE method = 'purchase'), -1) AS purchase, coalesce(avg(confidence) FILTER (WHERE method = 'view'), -1) AS view FROM base GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY day) AS r, CASE WHEN click >= purchase AND click >= view THEN 'click' WHEN purchase >= view THEN 'purchase' ELSE 'view' END AS best, greatest(click, purchase, view) AS top FROM days),
walk AS (SELECT seq, day, r, best AS winner FROM o WHERE r = 1
  UNION ALL SELECT o.seq, o.day, o.r, CASE WHEN top > CASE winner WHEN 'click' THEN click WHEN 'purchase' THEN purchase ELSE view END + 0.1 THEN best ELSE winner END FROM walk JOIN o ON o.seq = walk.seq AND o.r = walk.r + 1)
SELECT seq, day, winner FROM walk""")
def w10_hysteresis(b: DataFrame) -> DataFrame:
    names = ["click", "purchase", "view"]
    mean = [F.coalesce(F.avg(F.when(F.col("method") == m, F.col("confidence"))), F.lit(-1.0)).alias(m) for m in names]
    scores = b.groupBy("seq", F.floor(F.col("t") / 86400).alias("day")).agg(*mean)
    return motion.hysteresis_winner(scores, ["seq"], names, ["day"], bucket=100).select("seq", "day", "winner")


def inertial(b: DataFrame) -> DataFrame:
    """Small six-axis samples, one second apart, for each sequence."""
    nth = F.row_number().over(Window.partitionBy("seq").orderBy("t", "idx")).cast("double")
    return b.select("seq", nth.alias("t"), *[((F.col(c) - 100.0) * k).alias(n) for n, c, k in (("ax", "x", 1e-4), ("ay", "y", 1e-4), ("gx", "y", 1e-5), ("gy", "x", 1e-5), ("gz", "x", 2e-5))], (F.lit(9.81) + F.col("y") * 1e-5).alias("az"))


SQL_INERTIAL = "o AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY t, idx) AS r, (x - 100) * 1e-4 AS ax, (y - 100) * 1e-4 AS ay, 9.81 + y * 1e-5 AS az, (y - 100) * 1e-5 AS gx, (x - 100) * 1e-5 AS gy, (x - 100) * 2e-5 AS gz FROM base)"


@query(f"""{SQL_INERTIAL},
g AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS angle FROM o),
d AS (SELECT *, gx * k AS dx, gy * k AS dy, gz * k AS dz, cos(angle / 2) AS dw FROM (SELECT *, CASE WHEN angle < 1e-6 THEN 0.5 - angle * angle / 48 ELSE sin(angle / 2) / angle END AS k FROM g)),
walk AS (SELECT seq, r, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 0.0::DOUBLE AS vz, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz, 1.0::DOUBLE AS qw FROM o WHERE r = 1
  UNION ALL SELECT seq, r + 1, x + vx + 0.5 * wx, y + vy + 0.5 * wy, z + vz + 0.5 * wz, vx + wx, vy + wy, vz + wz, tx / n, ty / n, tz / n, tw / n FROM (
    SELECT *, sqrt(tx * tx + ty * ty + tz * tz + tw * tw) AS n FROM (
      SELECT w.*, (1 - 2 * (qy * qy + qz * qz)) * ax + 2 * (qx * qy - qz * qw) * ay + 2 * (qx * qz + qy * qw) * az AS wx, 2 * (qx * qy + qz * qw) * ax + (1 - 2 * (qx * qx + qz * qz)) * ay + 2 * (qy * qz - qx * qw) * az AS wy,
        2 * (qx * qz - qy * qw) * ax + 2 * (qy * qz + qx * qw) * ay + (1 - 2 * (qx * qx + qy * qy)) * az - 9.81 AS wz, qw * dx + dw * qx + qy * dz - qz * dy AS tx, qw * dy + dw * qy + qz * dx - qx * dz AS ty, qw * dz + dw * qz + qx * dy - qy * dx AS tz, qw * dw - qx * dx - qy * dy - qz * dz AS tw
      FROM walk w JOIN d ON d.seq = w.seq AND d.r = w.r WHERE w.r < (SELECT max(r) FROM o)))),
held AS (SELECT w.* FROM walk w JOIN o ON o.seq = w.seq AND o.r = w.r),
bad AS (SELECT *, max(CASE WHEN r - 1 > 10 OR sqrt(x * x + y * y + z * z) > 100 THEN 2 WHEN r - 1 > 5 OR sqrt(x * x + y * y + z * z) > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY r ROWS UNBOUNDED PRECEDING) AS worst FROM held)
SELECT seq, r::DOUBLE AS t, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(qx, 6) + 0.0 AS qx, round(qy, 6) + 0.0 AS qy, round(qz, 6) + 0.0 AS qz, round(qw, 6) + 0.0 AS qw, CASE worst WHEN 0 THEN 'OK' WHEN 1 THEN 'DEGRADED' ELSE 'LOST' END AS health FROM bad""")
def w11_strapdown(b: DataFrame) -> DataFrame:
    return motion.strapdown(inertial(b), ["seq"], bucket=200.0).select("seq", "t", *rounded("x", "y", "z", "qx", "qy", "qz", "qw"), "health")


@query(f"""{SQL_INERTIAL},
d AS (SELECT seq, r, CASE WHEN s > 0 THEN gx / s * sin(angle / 2) ELSE 0 END AS dx, CASE WHEN s > 0 THEN gy / s * sin(angle / 2) ELSE 0 END AS dy, CASE WHEN s > 0 THEN gz / s * sin(angle / 2) ELSE 0 END AS dz, CASE WHEN s > 0 THEN cos(angle / 2) ELSE 1 END AS dw
    FROM (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS angle, abs(gx) + abs(gy) + abs(gz) AS s FROM o)),
walk AS (SELECT seq, r, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz, 1.0::DOUBLE AS qw FROM o WHERE r = 1
  UNION ALL SELECT d.seq, d.r, qw * dx + dw * qx + qy * dz - qz * dy, qw * dy + dw * qy + qz * dx - qx * dz, qw * dz + dw * qz + qx * dy - qy * dx, qw * dw - qx * dx - qy * dy - qz * dz FROM walk JOIN d ON d.seq = walk.seq AND d.r = walk.r + 1)
SELECT seq, r::DOUBLE AS t, round(qx, 6) + 0.0 AS qx, round(qy, 6) + 0.0 AS qy, round(qz, 6) + 0.0 AS qz, round(qw, 6) + 0.0 AS qw FROM walk""")
def w12_gyro(b: DataFrame) -> DataFrame:
    return motion.gyro_orientation(inertial(b), ["seq"], bucket=200.0).select("seq", "t", *rounded("qx", "qy", "qz", "qw"))


def w14_embedding_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return motion.embedding_signals(e, ["label"], "vec_id", bucket=1000).select("label", "vec_id", *rounded("surprise", "speed", to=5))


QUERIES["w14_embedding_signals"] = w14_embedding_signals
ORACLE_SQL["w14_embedding_signals"] = """
WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS a, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT label, vec_id, round(CASE WHEN b IS NULL THEN 0 ELSE 1 - least(greatest(list_cosine_similarity(a, b), -1), 1) END, 5) + 0.0 AS surprise, round(CASE WHEN b IS NULL THEN 0 ELSE list_distance(a, b) / sqrt(len(a)) END, 5) + 0.0 AS speed FROM e"""


@query("""
v AS (SELECT seq, t AS u, x FROM base WHERE method = 'view'), c AS (SELECT seq, t AS u, x FROM base WHERE method = 'click'), grid AS (SELECT seq, u AS t FROM v UNION SELECT seq, u FROM c),
a AS (SELECT g.*, coalesce(v.x, 0) AS x_0 FROM grid g ASOF LEFT JOIN v ON g.seq = v.seq AND g.t >= v.u)
SELECT a.seq, round(t, 6) AS t, round(x_0, 6) AS x_0, round(coalesce(c.x, 0), 6) AS x_1, round((x_0 + coalesce(c.x, 0)) / 2, 5) AS mean FROM a ASOF LEFT JOIN c ON a.seq = c.seq AND a.t >= c.u""")
def w15_union_grid(b: DataFrame) -> DataFrame:
    streams = [b.where(F.col("method") == m).select("seq", "t", "x") for m in ("view", "click")]
    return motion.union_grid(streams, ["seq"], "x").select("seq", *[F.round(c, 6).alias(c) for c in ("t", "x_0", "x_1")], F.round("mean", 5).alias("mean"))


@query("SELECT seq, idx, last AS prev_idx, round(t - lt, 6) AS dt FROM (SELECT *, lag(idx) OVER w AS last, lag(t) OVER w AS lt FROM base WINDOW w AS (PARTITION BY seq, floor(t / 86400) ORDER BY t, idx)) WHERE last IS NOT NULL")
def w16_pairs(b: DataFrame) -> DataFrame:
    """Consecutive rows of a segment (a day); none across segments."""
    w = Window.partitionBy("seq", F.floor(F.col("t") / 86400)).orderBy("t", "idx")
    return b.select("seq", "idx", F.lag("idx").over(w).alias("prev_idx"), F.round(F.col("t") - F.lag("t").over(w), 6).alias("dt")).where("prev_idx is not null")


@query(f"""{SQL_ORDERED},
g AS (SELECT *, max(CASE WHEN confidence >= 0.15 THEN r END) OVER (PARTITION BY seq ORDER BY r ROWS UNBOUNDED PRECEDING) AS k FROM o),
u AS (SELECT g.seq, g.idx, g.r, coalesce(h.x / pi() * pow(0.95, g.r - g.k), 0) AS used FROM g LEFT JOIN o h ON h.seq = g.seq AND h.r = g.k)
SELECT seq, idx, round(used, 6) + 0.0 AS used, round(sum(used) OVER (PARTITION BY seq ORDER BY r ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS position FROM u""")
def w19_held_velocity(b: DataFrame) -> DataFrame:
    return motion.held_velocity(b.withColumn("v", F.col("x") / math.pi), ["seq"], "v", "confidence", ["t", "idx"]).select("seq", "idx", *rounded("used"), *rounded("position", to=4))


@query("SELECT idx, round((0.45 * least(x / 80.0, 1.0) + 0.40 * confidence + 0.15 * least(y / 120.0, 1.0)) / pi(), 6) AS confidence FROM base")
def w20_pair_confidence(b: DataFrame) -> DataFrame:
    return b.select("idx", F.round(gates.pair_confidence(F.col("x"), F.col("confidence"), F.col("y")) / math.pi, 6).alias("confidence"))


@query("""
j AS (SELECT *, coalesce(-round((x - lag(x) OVER w) / 360.0), 0) AS turns FROM base WINDOW w AS (PARTITION BY seq ORDER BY t, idx)),
u AS (SELECT *, x + 360.0 * sum(turns) OVER (PARTITION BY seq ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS unwrapped FROM j),
d AS (SELECT *, coalesce(lead(unwrapped) OVER w, unwrapped) - coalesce(lag(unwrapped) OVER w, unwrapped) AS du, coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t) AS dt FROM u WINDOW w AS (PARTITION BY seq ORDER BY t, idx))
SELECT seq, idx, round(unwrapped, 4) + 0.0 AS unwrapped, round(CASE WHEN dt > 0 THEN du / dt END, 6) + 0.0 AS gradient FROM d""")
def w25_unwrap_gradient(b: DataFrame) -> DataFrame:
    u = motion.unwrap(b, ["seq"], "x", ["t", "idx"])
    return motion.gradient(u, ["seq"], "unwrapped", ["t", "idx"]).select("seq", "idx", *rounded("unwrapped", to=4), *rounded("gradient"))


@query(f"""
span AS (SELECT seq, min(t) AS t0, greatest(ceil((max(t) - min(t)) / {PACKET * 12}), 1)::BIGINT AS n FROM base GROUP BY seq),
hit AS (SELECT seq, least(floor((t - t0) / {PACKET * 12})::BIGINT, n - 1) AS win, py, any_value(t0) AS t0, count(*) AS c FROM base b JOIN span USING (seq) GROUP BY ALL)
SELECT seq, win, py AS y, round_even(c / max(c) OVER (PARTITION BY seq, win) * 255, 0)::INT AS value, round(t0 + (win + 0.5) * {PACKET * 12}, 4) AS centre FROM hit""")
def a04_frames(b: DataFrame) -> DataFrame:
    return events.frames(b, ["seq"], ["py"], PACKET * 12).select("seq", "win", F.col("py").alias("y"), "value", F.round("centre", 4).alias("centre"))


@query("SELECT method, count(*) AS n, round(min(t), 6) AS t_first, round(max(t), 6) AS t_last, max(px) + 1 AS width, max(py) + 1 AS height, bool_and(t >= 0) AS in_epoch FROM base GROUP BY method")
def a08_stream_ranges(b: DataFrame) -> DataFrame:
    """Time range, count and inferred resolution (A07) of each stream."""
    return b.groupBy("method").agg(F.count("*").alias("n"), F.round(F.min("t"), 6).alias("t_first"), F.round(F.max("t"), 6).alias("t_last"), (F.max("px") + 1).alias("width"), (F.max("py") + 1).alias("height"), F.bool_and(F.col("t") >= 0).alias("in_epoch"))




@rows_only
def a18_align(b: DataFrame) -> DataFrame:
    m = matches(b).select("seq", "x", "y", (F.col("x") * F.col("y") / 100).alias("z"), "ref_x", "ref_y", (F.col("ref_x") * F.col("ref_y") / 100).alias("ref_z"))
    return evaluate.align(m, ["seq"]).select("seq", "n", F.transform("r", lambda v: F.round(v, 6)).alias("r"), *rounded("tx", "ty", "tz", "s"))


@query("SELECT seq, method, round(CASE WHEN sum(x) > 0 THEN sum(py * x) / sum(x) ELSE 0 END, 6) AS cy, round(CASE WHEN sum(x) > 0 THEN sum(px * x) / sum(x) ELSE 0 END, 6) AS cx FROM base GROUP BY seq, method")
def a34_centroid(b: DataFrame) -> DataFrame:
    return events.centroid(b, ["seq", "method"], "x").select("seq", "method", *[F.round(c, 6).alias(c) for c in ("cy", "cx")])


@query("""
s AS (SELECT method, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM base GROUP BY method),
r AS (SELECT method, m * n / (n + 1e-4) AS mean, (1e-4 + v * n + m * m * 1e-4 * n / (n + 1e-4)) / (n + 1e-4) AS variance FROM s)
SELECT idx, round((x - mean) / sqrt(variance + 1e-8), 6) + 0.0 AS normal FROM base JOIN r USING (method)""")
def a35_running_norm(b: DataFrame) -> DataFrame:
    """Values by their stream's running mean and variance, whose first state counts as a ten-thousandth of a row."""
    state = sequences.running_norm(b, ["method"], "x")
    return sequences.normalise(b, state, ["method"], "x").select("idx", (F.round("normal", 6) + 0.0).alias("normal"))


@query(f"""{SQL_ORDERED.replace("t, idx)", "t DESC, idx DESC)")},
walk AS (SELECT seq, idx, r, x / 3 - y / 7 AS a, y / 7 AS v FROM o WHERE r = 1
  UNION ALL SELECT o.seq, o.idx, o.r, o.x / 3 + CASE WHEN o.method = 'error' THEN 0 ELSE 0.99 * v END - o.y / 7 + CASE WHEN o.method = 'error' THEN 0 ELSE 0.99 * 0.95 * a END, o.y / 7 FROM walk JOIN o ON o.seq = walk.seq AND o.r = walk.r + 1)
SELECT seq, idx, round(a, 4) + 0.0 AS advantage FROM walk""")
def a36_gae(b: DataFrame) -> DataFrame:
    rows = b.select("seq", "idx", "t", (F.col("x") / 3).alias("reward"), (F.col("y") / 7).alias("value"), (F.col("method") == "error").alias("done"))
    return motion.discounted_scan(rows, ["seq"], ["t", "idx"], bucket=PART).select("seq", "idx", *rounded("advantage", to=4))


@query("SELECT idx, round(10.0 + degrees(x / 6371000.0), 9) AS lat, round(20.0 + degrees(y / (6371000.0 * cos(radians(10.0)))), 9) AS lon FROM base")
def m02_geodetic(b: DataFrame) -> DataFrame:
    lat, lon = geometry.geodetic(F.col("y"), F.col("x"), 10.0, 20.0)
    return b.select("idx", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("""
f AS (SELECT seq, idx, radians(y) AS yaw, x AS speed, min_by(x, (t, idx)) OVER (PARTITION BY seq) AS x0, x FROM base)
SELECT idx, round(x - x0, 6) + 0.0 AS east, round(sin(yaw / 2), 6) + 0.0 AS qz, round(cos(yaw / 2), 6) + 0.0 AS qw, round(speed * sin(yaw), 6) + 0.0 AS vx, round(speed * cos(yaw), 6) + 0.0 AS vy FROM f""")
def m03_ground_truth(b: DataFrame) -> DataFrame:
    yaw, first = F.radians("y"), F.min_by("x", F.struct("t", "idx")).over(Window.partitionBy("seq"))
    made = b.select("idx", (F.col("x") - first).alias("east"), F.sin(yaw / 2).alias("qz"), F.cos(yaw / 2).alias("qw"), (F.col("x") * F.sin(yaw)).alias("vx"), (F.col("x") * F.cos(yaw)).alias("vy"))
    return made.select("idx", *rounded("east", "qz", "qw", "vx", "vy"))




@query("""SELECT idx, round((floor(y) + px / 60.0 + py / 3600.0) * CASE WHEN method IN ('error', 'click') THEN -1.0 ELSE 1.0 END, 9) + 0.0 AS decimal,
       round(50.0 - py / 48.0 * 2.0, 9) AS lat, round(8.0 + px / 8.0 * 3.0, 9) AS lon, x BETWEEN 10 AND 100 AND y BETWEEN 10 AND 50 AS inside, round(sqrt((x - 5) ** 2 + (y - 6) ** 2), 6) AS far FROM base""")
def m06_map_coordinates(b: DataFrame) -> DataFrame:
    """Degrees, minutes and seconds (M06), pixels to coordinates (M07), containment in an area (F31), waypoint distance (M18)."""
    hemisphere = F.when(F.col("method").isin("error", "click"), "s").otherwise("n")
    lat, lon = geometry.pixel_to_latlon(F.col("px"), F.col("py"), F.lit(50.0), F.lit(48.0), F.lit(8.0), F.lit(11.0), F.lit(8.0), F.lit(48.0))
    far = F.sqrt((F.col("x") - 5) * (F.col("x") - 5) + (F.col("y") - 6) * (F.col("y") - 6))
    decimal = geometry.dms(F.floor("y").cast("double"), F.col("px"), F.col("py"), hemisphere)
    return b.select("idx", (F.round(decimal, 9) + 0.0).alias("decimal"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"), (F.col("x").between(10, 100) & F.col("y").between(10, 50)).alias("inside"), F.round(far, 6).alias("far"))


@query("SELECT idx, round((1.1 * x + 0.1 * y + 5) / (0.0001 * x + 0.0002 * y + 1), 6) AS u, round((0.05 * x + 0.9 * y - 3) / (0.0001 * x + 0.0002 * y + 1), 6) AS v FROM base")
def m08_homography(b: DataFrame) -> DataFrame:
    u, v = geometry.project([F.lit(c) for c in (1.1, 0.1, 5.0, 0.05, 0.9, -3.0, 0.0001, 0.0002, 1.0)], F.col("x"), F.col("y"))
    return b.select("idx", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))




@query("""
n AS (SELECT *, lag(x) OVER w AS l, lead(x) OVER w AS r FROM base WINDOW w AS (PARTITION BY seq ORDER BY t, idx))
SELECT idx, round(CASE WHEN abs(l - 2 * x + r) < 1e-12 THEN 0 ELSE least(greatest(0.5 * (l - r) / (l - 2 * x + r), -0.5), 0.5) END, 6) + 0.0 AS offset_px, CASE WHEN py > 24 THEN py - 48 ELSE py END AS shift FROM n WHERE l IS NOT NULL AND r IS NOT NULL""")
def m10_subpixel(b: DataFrame) -> DataFrame:
    w = Window.partitionBy("seq").orderBy("t", "idx")
    n = b.withColumn("l", F.lag("x").over(w)).withColumn("r", F.lead("x").over(w)).where("l is not null and r is not null")
    return n.select("idx", (F.round(geometry.parabola(F.col("l"), F.col("x"), F.col("r")), 6) + 0.0).alias("offset_px"), geometry.signed_index(F.col("py"), F.lit(48)).cast("int").alias("shift"))


@query("""
h AS (SELECT seq, idx, t, radians(x) / 2 AS a, radians(y) / 2 AS b, confidence AS w FROM base), s AS (SELECT *, CASE WHEN sin(a) * sin(b) + cos(a) * cos(b) < 0 THEN -1.0 ELSE 1.0 END AS sg FROM h),
q AS (SELECT *, (1 - w) * sin(a) + w * sg * sin(b) AS z, (1 - w) * cos(a) + w * sg * cos(b) AS c FROM s)
SELECT idx, round(CASE WHEN sqrt(z * z + c * c) <= 1e-9 THEN 0 ELSE z / sqrt(z * z + c * c) END, 6) + 0.0 AS qz, round(CASE WHEN sqrt(z * z + c * c) <= 1e-9 THEN 1 ELSE c / sqrt(z * z + c * c) END, 6) + 0.0 AS qw FROM q""")
def a27_blend_two(b: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    q = geometry.blend([zero, zero, F.sin(F.radians("x") / 2), F.cos(F.radians("x") / 2)], [zero, zero, F.sin(F.radians("y") / 2), F.cos(F.radians("y") / 2)], F.col("confidence"))
    return b.select("idx", (F.round(q[2], 6) + 0.0).alias("qz"), (F.round(q[3], 6) + 0.0).alias("qw"))
