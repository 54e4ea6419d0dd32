"""Registered queries of motion between frames and of maps, with equal DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import gates, geometry
from trailmark.operators import tracking
from trailmark.plans.catalogue import ORACLE_SQL, QUERIES, query
from trailmark.plans.motion import rounded, rows_only

SIDE = 8
#: Vectors as gray frames of 8 x 8 cells from 0 to 255.
SQL_FRAMES = "f AS (SELECT label, vec_id, list_transform(embedding::DOUBLE[], lambda v: least(greatest(floor((v + 4) * 32), 0), 255)) AS p FROM embeddings)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cells = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.least(F.greatest(F.floor((v + 4) * 32), F.lit(0)), F.lit(255)).cast("double"))
    return e.select("label", "vec_id", cells.alias("pixels"))


def x05_pair_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tracking.texture_pairs(frames(spark, sf_dir), ["label"], "vec_id", SIDE, bucket=1000)
    return made.select("label", "vec_id", "prev_vec_id", "matches", "inliers", *rounded("inlier_ratio", "dx", "dy"))


QUERIES["x05_pair_tracking"] = x05_pair_tracking
ORACLE_SQL["x05_pair_tracking"] = f"""WITH {SQL_FRAMES},
s AS (SELECT label, vec_id, list_sum([abs(p[i + 1] - p[i]) for i in range(1, 65) if i % 8 <> 0]) + list_sum([abs(p[i + 8] - p[i]) for i in range(1, 57)]) AS edges, list_sum(p) AS total, list_sum([p[i] * ((i - 1) % 8) for i in range(1, 65)]) AS sx, list_sum([p[i] * ((i - 1) // 8) for i in range(1, 65)]) AS sy FROM f),
c AS (SELECT *, CASE WHEN total > 1e-9 THEN sx / total ELSE 0 END AS cx, CASE WHEN total > 1e-9 THEN sy / total ELSE 0 END AS cy FROM s),
j AS (SELECT label, vec_id, lag(vec_id) OVER w AS prev_vec_id, floor(least(greatest(least(edges, lag(edges) OVER w) / (64 * 255.0) * 350, 0), 120))::BIGINT AS matches, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy FROM c WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
k AS (SELECT *, CASE WHEN matches > 0 THEN greatest(floor(matches * 0.75), 1) ELSE 0 END::BIGINT AS inliers FROM j WHERE prev_vec_id IS NOT NULL)
SELECT label, vec_id, prev_vec_id, matches, inliers, round(CASE WHEN matches > 0 THEN inliers / matches ELSE 0 END, 6) AS inlier_ratio, round(CASE WHEN matches > 0 THEN dx ELSE 0 END, 6) + 0.0 AS dx, round(CASE WHEN matches > 0 THEN dy ELSE 0 END, 6) + 0.0 AS dy FROM k"""


def point_pairs(b: DataFrame) -> DataFrame:
    """Places of a sequence's rows as points in two views: turned, scaled and shifted, a little off, and some elsewhere."""
    turn, scale = (F.col("seq") % 7) * 0.05, 1 + (F.col("seq") % 3) * 0.1
    off = (F.col("idx") % 5 - 2) * 0.2
    u = scale * (F.cos(turn) * F.col("x") - F.sin(turn) * F.col("y")) + (F.col("seq") % 11 - 5) + off
    v = scale * (F.sin(turn) * F.col("x") + F.cos(turn) * F.col("y")) + (F.col("seq") % 13) - off
    wrong = F.col("method").isin("error", "purchase")
    return b.select("seq", "idx", F.col("x").alias("x0"), F.col("y").alias("y0"), F.when(wrong, F.col("y") * 3 + 50).otherwise(u).alias("x1"), F.when(wrong, F.col("x") * 0.5).otherwise(v).alias("y1"))


@query(f"""
m AS (SELECT seq, idx, x AS x0, y AS y0, CASE WHEN method IN ('error', 'purchase') THEN y * 3 + 50 ELSE (1 + (seq % 3) * 0.1::DOUBLE) * (cos((seq % 7) * 0.05::DOUBLE) * x - sin((seq % 7) * 0.05::DOUBLE) * y) + (seq % 11 - 5) + (idx % 5 - 2) * 0.2::DOUBLE END AS x1,
    CASE WHEN method IN ('error', 'purchase') THEN x * 0.5::DOUBLE ELSE (1 + (seq % 3) * 0.1::DOUBLE) * (sin((seq % 7) * 0.05::DOUBLE) * x + cos((seq % 7) * 0.05::DOUBLE) * y) + (seq % 13) - (idx % 5 - 2) * 0.2::DOUBLE END AS y1 FROM base),
r AS (SELECT m.*, h, ((idx % {tracking.PRIME} * {tracking.FACTOR}) % {tracking.PRIME} + (h * 97 * {tracking.SHIFT}) % {tracking.PRIME}) * {tracking.STEP} % {tracking.PRIME} AS r0,
    ((idx % {tracking.PRIME} * {tracking.FACTOR + 2}) % {tracking.PRIME} + ((h * 97 + 13) * {tracking.SHIFT}) % {tracking.PRIME}) * {tracking.STEP} % {tracking.PRIME} AS r1 FROM m, (SELECT unnest(range(64)) AS h)),
s AS (SELECT seq, h, min_by({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}, (r0, idx)) AS p, min_by({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}, (r1, idx)) AS q FROM r GROUP BY seq, h),
w AS (SELECT *, q.x0 - p.x0 AS dx, q.y0 - p.y0 AS dy, q.x1 - p.x1 AS du, q.y1 - p.y1 AS dv FROM s),
g AS (SELECT seq, h, (dx * du + dy * dv) / (dx * dx + dy * dy) AS a, (dx * dv - dy * du) / (dx * dx + dy * dy) AS b, p FROM w WHERE dx <> 0 OR dy <> 0),
g2 AS (SELECT seq, h, a, b, p.x1 - a * p.x0 + b * p.y0 AS tx, p.y1 - b * p.x0 - a * p.y0 AS ty FROM g),
v AS (SELECT g2.*, (a * x0 - b * y0 + tx - x1) ** 2 + (b * x0 + a * y0 + ty - y1) ** 2 <= 9 AS ok FROM g2 JOIN m USING (seq)),
best AS (SELECT seq, h FROM (SELECT seq, h, count(*) FILTER (WHERE ok) AS n FROM v GROUP BY ALL) WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY n DESC, h) = 1),
one AS (SELECT g2.* FROM g2 JOIN best USING (seq, h)),
u AS (SELECT m.*, a, b, coalesce((a * x0 - b * y0 + tx - x1) ** 2 + (b * x0 + a * y0 + ty - y1) ** 2 <= 9, false) AS ok FROM m LEFT JOIN one USING (seq)),
z AS (SELECT seq, count(*) AS matches, count(*) FILTER (WHERE ok) AS n, avg(x0) FILTER (WHERE ok) AS mx0, avg(y0) FILTER (WHERE ok) AS my0, avg(x1) FILTER (WHERE ok) AS mx1, avg(y1) FILTER (WHERE ok) AS my1, median(x1 - x0) AS fx, median(y1 - y0) AS fy, any_value(a) AS a0, any_value(b) AS b0,
    avg(x0 * x0 + y0 * y0) FILTER (WHERE ok) AS s0, avg(x0 * x1 + y0 * y1) FILTER (WHERE ok) AS s1, avg(x0 * y1 - y0 * x1) FILTER (WHERE ok) AS s2 FROM u GROUP BY seq),
y AS (SELECT *, coalesce(CASE WHEN s0 - mx0 * mx0 - my0 * my0 > 0 THEN (s1 - mx0 * mx1 - my0 * my1) / (s0 - mx0 * mx0 - my0 * my0) END, a0) AS a, coalesce(CASE WHEN s0 - mx0 * mx0 - my0 * my0 > 0 THEN (s2 - mx0 * my1 + my0 * mx1) / (s0 - mx0 * mx0 - my0 * my0) END, b0) AS b FROM z)
SELECT seq, matches, CASE WHEN matches >= 8 AND a IS NOT NULL THEN n ELSE 0 END AS inliers, round(CASE WHEN matches >= 8 AND a IS NOT NULL THEN n ELSE 0 END / matches, 6) AS inlier_ratio,
       round(CASE WHEN matches < 8 THEN 0 WHEN a IS NULL THEN fx ELSE mx1 - a * mx0 + b * my0 END, 5) + 0.0 AS tx, round(CASE WHEN matches < 8 THEN 0 WHEN a IS NULL THEN fy ELSE my1 - b * mx0 - a * my0 END, 5) + 0.0 AS ty,
       round(CASE WHEN matches < 8 OR a IS NULL THEN 0 ELSE sqrt(a * a + b * b) END, 6) AS scale, round(CASE WHEN matches < 8 OR a IS NULL THEN 0 ELSE atan2(b, a) END, 6) + 0.0 AS yaw FROM y""")
def x04_two_view(b: DataFrame) -> DataFrame:
    return tracking.two_view(point_pairs(b), ["seq"], "idx").select("seq", "matches", "inliers", *rounded("inlier_ratio"), *rounded("tx", "ty", to=5), *rounded("scale", "yaw"))


@rows_only
def x08_homography(b: DataFrame) -> DataFrame:
    """Rows of a sequence as points of an image and of a map, most of them seen through one homography; what its inliers are
    worth (F30), and where it puts the image's centre (M08)."""
    w = 0.0005 * F.col("x") + 0.0002 * F.col("y") + 1
    wrong = F.col("method").isin("error", "purchase")
    u, v = (1.1 * F.col("x") + 0.1 * F.col("y") + F.col("seq") % 9) / w, (0.9 * F.col("y") - 0.05 * F.col("x") + 20) / w
    pairs = b.select("seq", "idx", F.col("x").alias("x0"), F.col("y").alias("y0"), F.when(wrong, F.col("y") * 2).otherwise(u + (F.col("idx") % 5 - 2) * 0.1).alias("x1"), F.when(wrong, 300 - F.col("x")).otherwise(v).alias("y1"))
    found = tracking.robust_homography(pairs, ["seq"], "idx")
    cu, cv = geometry.project([F.col(h) for h in tracking.H], F.lit(100.0), F.lit(50.0))
    return found.select("seq", "matches", "inliers", gates.match_confidence(F.col("inliers"), F.col("matches")).alias("confidence"), *[F.round(c, 3).alias(n) for c, n in ((cu, "u"), (cv, "v"))])
