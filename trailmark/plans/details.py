"""Registered queries of parts that larger operators are made of: logs, observations, bands, checks and rotations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import gates, geometry
from trailmark.functions.frames import frame_shift
from trailmark.operators import episodes, evaluate, fusion, sequences
from trailmark.operators.motion import ground_truth
from trailmark.plans.catalogue import ORACLE_SQL, QUERIES, query
from trailmark.plans.episodes import cues
from trailmark.plans.evaluation import SQL_BINS, SQL_EVAL, evaluated
from trailmark.plans.motion import rounded
from trailmark.plans.tracking import SIDE, frames
from trailmark.sources.datasets import load_diagnostics
from trailmark.sources.validators import trajectory_problems

METHODS = ["click", "purchase", "signup", "view"]
STATIC = {"click": 0.5, "purchase": 0.3, "view": 0.2}
DAY = 86_400.0


@query(f"""
log AS (SELECT seq, idx, t, 10 + y * 1e-4 AS lat, 20 + x * 1e-4 AS lon, x * y / 100 AS alt, y AS heading, x AS speed FROM base),
o AS (SELECT seq, min_by({{'lat': lat, 'lon': lon, 'alt': alt}}, (t, idx)) AS o FROM log GROUP BY seq)
SELECT idx, round(radians(lon - o.lon) * cos(radians(o.lat)) * {geometry.EARTH_RADIUS_M}, 3) + 0.0 AS x, round(radians(lat - o.lat) * {geometry.EARTH_RADIUS_M}, 3) + 0.0 AS y, round(alt - o.alt, 5) + 0.0 AS z,
       round(sin(radians(heading) / 2), 6) + 0.0 AS qz, round(cos(radians(heading) / 2), 6) + 0.0 AS qw, round(speed * sin(radians(heading)), 6) + 0.0 AS vx, round(speed * cos(radians(heading)), 6) + 0.0 AS vy FROM log JOIN o USING (seq)""")
def m03_raw_log(b: DataFrame) -> DataFrame:
    """Rows as a log of a flight, and the ground truth built from it."""
    log = b.select("seq", "idx", "t", (10 + F.col("y") * 1e-4).alias("lat"), (20 + F.col("x") * 1e-4).alias("lon"), (F.col("x") * F.col("y") / 100).alias("alt"), F.col("y").alias("heading_deg"), F.col("x").alias("speed"))
    return ground_truth(log, ["seq"], ["t", "idx"]).select("idx", *rounded("x", "y", to=3), *rounded("z", to=5), *rounded("qz", "qw", "vx", "vy"))




@query(f"""
o AS (SELECT seq, floor(t / {DAY})::BIGINT AS step, method, count(*) AS offered, count(*) FILTER (WHERE health IN ('OK', 'DEGRADED') AND confidence >= 0.15) AS accepted, avg(confidence) AS mean_confidence, avg((health = 'DEGRADED')::INT) AS degraded, avg((health IN ('LOST', 'INVALID'))::INT) AS failed, avg(x / 3) AS innovation, avg(y / 3) AS d2, (floor(t / {DAY}) + 1) * {DAY} - max(t) AS age FROM base GROUP BY seq, floor(t / {DAY}), method),
s AS (SELECT seq, floor(t / {DAY})::BIGINT AS step, avg(x) AS sigma, avg(y) AS speed, floor(t / {DAY}) / 40 AS progress, avg(confidence) AS trust FROM base GROUP BY seq, floor(t / {DAY})),
f AS (SELECT s.*, m.i, m.method, CASE WHEN o.method IS NOT NULL THEN [1.0::DOUBLE, mean_confidence, degraded, failed, tanh(innovation / 5), tanh(ln(1 + d2) / 4), least(age / 172800, 1), accepted / offered] END AS seen FROM s, (SELECT unnest(range(4)) AS i, unnest({METHODS}) AS method) m LEFT JOIN o ON o.seq = s.seq AND o.step = s.step AND o.method = m.method),
cells AS (SELECT seq, step, i * 8 + k AS place, coalesce(seen[k + 1], CASE WHEN k = 6 THEN 1 ELSE 0 END) AS value FROM f, (SELECT unnest(range(8)) AS k)
    UNION ALL SELECT seq, step, 32 + k, [tanh(ln(1 + sigma) / 2), tanh(speed / 20), least(greatest(progress, 0), 1), trust][k + 1] FROM s, (SELECT unnest(range(4)) AS k))
SELECT seq, step, place, round(value, 6) + 0.0 AS value FROM cells""")
def m14_observation(b: DataFrame) -> DataFrame:
    """What a policy would see of each day: features of every method, then of the whole."""
    step = F.floor(F.col("t") / DAY).alias("step")
    offers = b.select("seq", step, "method", "t", "confidence", "health", (F.col("health").isin("OK", "DEGRADED") & (F.col("confidence") >= 0.15)).alias("accepted"), (F.col("x") / 3).alias("innovation"), (F.col("y") / 3).alias("d2"))
    ages = offers.groupBy("seq", "step", "method").agg(((F.col("step") + 1) * DAY - F.max("t")).alias("age"))
    stats = fusion.window_stats(offers, ["seq", "step", "method"]).join(ages, ["seq", "step", "method"])
    steps = b.groupBy("seq", step).agg(F.avg("x").alias("sigma"), F.avg("y").alias("speed"), F.avg("confidence").alias("mean_trust")).withColumn("progress", F.col("step") / 40)
    found = fusion.observations(stats, steps, ["seq", "step"], METHODS, staleness=2 * DAY)
    return found.select("seq", "step", F.posexplode("features").alias("place", "value")).select("seq", "step", F.col("place").cast("long").alias("place"), *rounded("value"))


def a30_pair_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of w17_pair_cues, with the share of samples that the pairs cover."""
    from trailmark.plans.catalogue import base

    b = base(spark, sf_dir)
    found = cues(b).join(b.where("idx % 2 = 1").select("seq").distinct(), "seq", "left_semi")
    made = episodes.cue_diagnostics(found, ["seq"], b.where("idx % 2 = 1"), slack=3600.0)
    return made.withColumn("mean_confidence", F.col("mean_confidence") / math.pi).select("seq", "pairs", "applied", "skipped", "invalid", *rounded("mean_confidence", "coverage"))


QUERIES["a30_pair_diagnostics"] = a30_pair_diagnostics
ORACLE_SQL["a30_pair_diagnostics"] = f"""WITH c AS ({ORACLE_SQL['w17_pair_cues']}),
b AS (SELECT user_id AS seq, event_id AS idx, event_type AS method, epoch_us(ts) / 1e6 - 1704067200 AS t FROM events),
v AS (SELECT seq, min(lo) AS lo, max(t) AS hi FROM (SELECT seq, t, lag(t) OVER (PARTITION BY seq ORDER BY t, idx) AS lo FROM b WHERE method = 'view') WHERE lo IS NOT NULL GROUP BY seq),
k AS (SELECT b.seq, avg((t BETWEEN lo - 3600 AND hi + 3600)::INT) AS coverage FROM b JOIN v USING (seq) WHERE idx % 2 = 1 GROUP BY b.seq)
SELECT seq, count(*) AS pairs, count(*) FILTER (WHERE applied) AS applied, count(*) FILTER (WHERE NOT applied AND confidence > 0) AS skipped, count(*) FILTER (WHERE NOT applied AND confidence <= 0) AS invalid, round(avg(confidence) / pi(), 6) AS mean_confidence, round(any_value(coverage), 6) AS coverage FROM c JOIN k USING (seq) GROUP BY seq"""


@query(f"""
m AS (SELECT seq, floor(t / {DAY})::BIGINT AS day, method, avg(confidence) AS c, min(health) AS h FROM base WHERE method <> 'error' GROUP BY ALL),
r AS (SELECT *, greatest(CASE method WHEN 'click' THEN 0.5 WHEN 'purchase' THEN 0.3 WHEN 'view' THEN 0.2 ELSE 0 END * c * CASE h WHEN 'OK' THEN 1 WHEN 'DEGRADED' THEN 0.45 ELSE 0 END, 0) AS raw FROM m),
s AS (SELECT *, sum(raw) OVER (PARTITION BY seq, day) AS total FROM r)
SELECT seq, day, method, round(raw / pi(), 6) AS raw, round(CASE WHEN total > 1e-9 THEN raw / total WHEN method = 'purchase' THEN 1 ELSE 0 END, 6) AS weight FROM s""")
def a19_ensemble_weights(b: DataFrame) -> DataFrame:
    """Weights of each day's methods by their static weight, confidence and health; purchases where all are 0."""
    sampled = b.where("method <> 'error'").groupBy("seq", F.floor(F.col("t") / DAY).alias("day"), "method").agg(F.avg("confidence").alias("confidence"), F.min("health").alias("health"))
    return fusion.ensemble_weights(sampled, ["seq", "day"], STATIC, "purchase").withColumn("raw", F.col("raw") / math.pi).select("seq", "day", "method", *rounded("raw", "weight"))


@query(f"{SQL_EVAL}, {SQL_BINS} SELECT seq, bin, round(greatest(median - iqr / 2, 0), 6) + 0.0 AS low, round(median + iqr / 2, 6) AS high FROM bins JOIN stat USING (seq, bin)")
def v06_iqr_band(b: DataFrame) -> DataFrame:
    return evaluate.iqr_band(evaluated(b).drift_bins).where("median is not null").select("seq", "bin", *rounded("low", "high"))


@query("""
p AS (SELECT seq, method, CASE WHEN x > 150 THEN 'too far' END AS problem, idx < lag(idx) OVER (PARTITION BY seq, method ORDER BY t, idx) AS back FROM base),
a AS (SELECT seq, list(DISTINCT method) AS seen, list(DISTINCT method) FILTER (WHERE problem IS NOT NULL) AS bad, list(DISTINCT method) FILTER (WHERE back) AS aside FROM p GROUP BY seq)
SELECT seq, list_sort(list_filter(['click', 'purchase', 'radar', 'signup'], lambda m: NOT list_contains(seen, m))) AS missing, list_sort(coalesce(bad, [])) AS malformed, list_sort(coalesce(aside, [])) AS quarantined FROM a""")
def a38_load_diagnostics(b: DataFrame) -> DataFrame:
    """Methods as streams: those missing, those with a value too large, and those whose numbers go back in time's order."""
    rows = b.select("seq", F.col("method").alias("stream"), F.when(F.col("x") > 150, "too far").alias("problem"))
    back = sequences.previous(b.select("seq", "method", "t", "idx"), ["seq", "method"], ["t", "idx"], ["idx"]).where("idx < prev.idx")
    return load_diagnostics(rows, ["seq"], ["click", "purchase", "radar", "signup"], back.select("seq", F.col("method").alias("stream")))


@query("""
m AS (SELECT idx, radians(y) AS a, CASE method WHEN 'error' THEN 1.2 WHEN 'click' THEN -1.0 ELSE 1.0 END AS s, method = 'purchase' AS broken, method = 'signup' AS skewed FROM base)
SELECT idx, CASE WHEN broken THEN 'not_finite' WHEN s <> 1 THEN 'determinant' WHEN skewed THEN 'not_orthonormal' END AS problem FROM m""")
def f20_rotations(b: DataFrame) -> DataFrame:
    """Turns about z, some of them stretched, mirrored, skewed or not numbers."""
    a, m = F.radians("y"), F.col("method")
    s = F.when(m == "error", 1.2).when(m == "click", -1.0).otherwise(1.0)
    skew = F.when(m == "signup", 0.5).otherwise(0.0)
    zero = F.lit(0.0)
    corner = F.when(m == "purchase", F.lit(float("nan"))).otherwise(s)
    return b.select("idx", gates.rotation_problem([F.cos(a), -F.sin(a), skew, F.sin(a), F.cos(a), zero, zero, zero, corner]).alias("problem"))


@query(f"""
h AS (SELECT idx, radians(y) AS a, radians(x / 4) AS c, x, y FROM base), w AS (SELECT *, a + c - 2 * pi() * floor((a + c + pi()) / (2 * pi())) AS r FROM h)
SELECT idx, round(x * cos(a) - y * sin(a), 5) + 0.0 AS px, round(x * sin(a) + y * cos(a), 5) + 0.0 AS py, round(r, 6) + 0.0 AS rz, round(degrees(c) - 360 * floor((degrees(c) + 180) / 360), 5) + 0.0 AS yaw FROM w""")
def m17_quaternions(b: DataFrame) -> DataFrame:
    """A place turned about z, the rotation vector of two turns one after the other, and the yaw of one."""
    zero = F.lit(0.0)
    first, second = ([zero, zero, F.sin(F.radians(c) / 2), F.cos(F.radians(c) / 2)] for c in (F.col("y"), F.col("x") / 4))
    px, py, _ = geometry.rotate(first, [F.col("x"), F.col("y"), zero])
    _, _, rz = geometry.rotation_vector(geometry.multiply(first, second))
    made = b.select("idx", px.alias("px"), py.alias("py"), rz.alias("rz"), geometry.yaw_degrees(*second).alias("yaw"))
    return made.select("idx", *rounded("px", "py", to=5), *rounded("rz"), *rounded("yaw", to=5))


@query("""
p AS (SELECT idx, CASE WHEN x > 200 THEN 'NaN'::DOUBLE ELSE x END AS x, CASE WHEN y < 3 THEN NULL ELSE y END AS y, CASE WHEN health = 'LOST' THEN 'GONE' ELSE health END AS health FROM base)
SELECT idx, CASE WHEN isnan(x) THEN 'x isn''t finite' WHEN y IS NULL THEN 'y isn''t finite' ELSE 'unknown health GONE' END AS problem FROM p WHERE isnan(x) OR y IS NULL OR health = 'GONE'""")
def f02_constraints(b: DataFrame) -> DataFrame:
    """Rows of a spoilt trajectory that break its constraints."""
    poses = b.select("idx", "t", F.when(F.col("x") > 200, F.lit(float("nan"))).otherwise(F.col("x")).alias("x"), F.when(F.col("y") >= 3, F.col("y")).alias("y"), F.lit(0.0).alias("z"), *[F.lit(v).alias(q) for q, v in (("qx", 0.0), ("qy", 0.0), ("qz", 0.0), ("qw", 1.0))], F.when(F.col("health") == "LOST", "GONE").otherwise(F.col("health")).alias("health"))
    return trajectory_problems(poses).select("idx", "problem")


def m11_frame_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts by phase correlation between vectors as frames, of each label, one after the other."""
    both = sequences.previous(frames(spark, sf_dir), ["label"], "vec_id", ["pixels"], bucket=1000).where("prev is not null")
    found = both.select("label", "vec_id", frame_shift("prev.pixels", "pixels", F.lit(SIDE), F.lit(SIDE)).alias("s"))
    return found.select("label", "vec_id", *[F.round(f"s.{c}", 5).alias(c) for c in ("dx", "dy", "confidence")], "s.valid", "s.reason")


QUERIES["m11_frame_shifts"] = m11_frame_shifts
