"""Registered queries of vector matching, ego motion and heading scripts, with equal DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import geometry
from trailmark.operators import asof, fusion, matching, sequences
from trailmark.plans.catalogue import ORACLE_SQL, PACKET, QUERIES, query

SQL_PAIRS = """
q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT vec_id AS other, embedding::DOUBLE[] AS u FROM embeddings),
pairs AS (SELECT id, other, sqrt(list_sum(list_transform(list_zip(v, u), lambda p: (p[1] - p[2]) ** 2))) AS d FROM q JOIN r ON id <> other)"""


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The query set (ids divisible by 50) and all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rows.where("id % 50 = 0"), rows


def j18_ratio_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.ratio_matches(*vectors(spark, sf_dir), ratio=0.95)
    return found.select("id", "near", F.round("distance", 6).alias("distance"), F.round("second", 6).alias("second"), "good")


def j19_mutual_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = vectors(spark, sf_dir)
    return matching.mutual_matches(queries, rows.where("id % 50 <> 0")).select("id", "near", F.round("distance", 6).alias("distance"))


QUERIES |= {f.__name__: f for f in (j18_ratio_matches, j19_mutual_matches)}
ORACLE_SQL["j18_ratio_matches"] = f"""WITH {SQL_PAIRS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r, lead(d) OVER (PARTITION BY id ORDER BY d, other) AS second FROM pairs)
SELECT id, other AS near, round(d, 6) AS distance, round(second, 6) AS second, coalesce(d < 0.95 * second, false) AS good FROM ranked WHERE r = 1"""
ORACLE_SQL["j19_mutual_matches"] = f"""WITH {SQL_PAIRS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS a, row_number() OVER (PARTITION BY other ORDER BY d, id) AS b FROM pairs WHERE other % 50 <> 0)
SELECT id, other AS near, round(d, 6) AS distance FROM ranked WHERE a = 1 AND b = 1 ORDER BY d, id LIMIT 250"""


@query(f"""
est AS (SELECT DISTINCT seq, (floor(t / {PACKET}) + 1) * {PACKET} AS t FROM base WHERE idx % 2 = 1), ref AS (SELECT seq, t AS u, x, y FROM base WHERE idx % 2 = 0),
prev AS (SELECT e.*, r.u AS pu, r.x AS ax, r.y AS ay FROM est e ASOF LEFT JOIN ref r ON e.seq = r.seq AND e.t >= r.u),
both_ AS (SELECT e.*, r.u AS nu, r.x AS bx, r.y AS by_, CASE WHEN r.u > pu THEN (t - pu) / (r.u - pu) ELSE 0 END AS w FROM prev e ASOF LEFT JOIN ref r ON e.seq = r.seq AND e.t <= r.u)
SELECT seq, t, round(CASE WHEN pu IS NULL THEN bx WHEN nu IS NULL THEN ax ELSE ax + w * (bx - ax) END, 6) AS x, round(CASE WHEN pu IS NULL THEN by_ WHEN nu IS NULL THEN ay ELSE ay + w * (by_ - ay) END, 6) AS y FROM both_""")
def j17_reference_at_boundaries(b: DataFrame) -> DataFrame:
    ends = b.where("idx % 2 = 1").select("seq", ((F.floor(F.col("t") / PACKET) + 1) * PACKET).cast("double").alias("t")).distinct()
    return asof.interpolate(ends, b.where("idx % 2 = 0").select("seq", "t", "x", "y"), ["seq"], ["x", "y"]).select("seq", "t", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""
step AS (SELECT seq, idx, t, x, y, radians(y) AS a, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(t) OVER w AS nt FROM base WINDOW w AS (PARTITION BY seq ORDER BY t, idx))
SELECT seq, idx, round((nx - x) * cos(a) + (ny - y) * sin(a), 6) AS forward, round((ny - y) * cos(a) - (nx - x) * sin(a), 6) AS "left", round(radians(ny - y), 6) AS rz, round(nt - t, 6) AS dt FROM step WHERE nt IS NOT NULL""")
def w24_ego_motion(b: DataFrame) -> DataFrame:
    poses = b.withColumns({"z": F.lit(0.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(F.radians("y") / 2), "qw": F.cos(F.radians("y") / 2)})
    made = sequences.ego_motion(poses, ["seq"], ["t", "idx"], ["x", "y", "z"], ["qx", "qy", "qz", "qw"])
    return made.select("seq", "idx", *[(F.round(c, 6) + 0.0).alias(c) for c in ("forward", "left", "rz", "dt")])




def _stream(name: str, method: str, left: str) -> str:
    return f"""{name}_p AS (SELECT g.*, s.t AS pt, s.x AS px2, s.confidence AS pc FROM {left} g ASOF LEFT JOIN (SELECT * FROM base WHERE method = '{method}') s ON g.seq = s.seq AND g.t >= s.t),
{name}_n AS (SELECT g.*, s.t AS nt, s.x AS nx2, s.confidence AS nc, CASE WHEN s.t > pt THEN (g.t - pt) / (s.t - pt) ELSE 0 END AS w FROM {name}_p g ASOF LEFT JOIN (SELECT * FROM base WHERE method = '{method}') s ON g.seq = s.seq AND g.t <= s.t),
{name} AS (SELECT * EXCLUDE (pt, px2, pc, nt, nx2, nc, w), CASE WHEN pt IS NULL THEN nx2 WHEN nt IS NULL THEN px2 ELSE px2 + w * (nx2 - px2) END AS {name}_x,
    CASE WHEN pt IS NULL OR nt IS NULL THEN 0 ELSE least(greatest(pc + w * (nc - pc), 0), 1) END AS {name}_c, pt IS NOT NULL AND nt IS NOT NULL AS {name}_in FROM {name}_n)"""


@query(f"""
own AS (SELECT seq, idx, t, x, confidence AS c FROM base WHERE method = 'view'), {_stream("a", "click", "own")}, {_stream("z", "signup", "a")},
weights AS (SELECT *, CASE WHEN a_c >= 0.1 THEN 0.9 * a_c ELSE 0 END AS w1, CASE WHEN z_c >= 0.1 THEN 0.9 * z_c ELSE 0 END AS w2 FROM z),
mixed AS (SELECT *, greatest(w1 + w2, 1) AS scale, least(greatest(0.3 * c + 0.35 * a_c + 0.35 * z_c, 0), 1) AS m FROM weights)
SELECT seq, idx, round(greatest(0, 1 - w1 - w2) * x + w1 / scale * coalesce(a_x, 0) + w2 / scale * coalesce(z_x, 0), 5) AS fused_x,
       round(CASE WHEN a_in OR z_in THEN m ELSE least(m, 0.3) END, 5) AS confidence FROM mixed""")
def a29_three_streams(b: DataFrame) -> DataFrame:
    own, first, second = (b.where(F.col("method") == m) for m in ("view", "click", "signup"))
    fused = fusion.fuse_three(own.select("seq", "idx", "t", "x", "confidence"), first, second, ["seq"], ["x"], (0.9, 0.9))
    return fused.select("seq", "idx", F.round("fused_x", 5).alias("fused_x"), F.round("confidence", 5).alias("confidence"))
