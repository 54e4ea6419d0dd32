"""Registered queries of gates, fusion, run reports and validation, with equal DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import gates
from trailmark.operators import episodes, evaluate, fusion
from trailmark.plans.catalogue import SQL_MATCH, matches, query
from trailmark.plans.motion import PART, inertial, rounded, rows_only

METHODS = ["click", "purchase", "signup"]
STATIC = {"click": 0.5, "purchase": 0.3, "signup": 0.2}
HEALTHY = "health IN ('OK', 'DEGRADED')"
WALK = "w AS (PARTITION BY seq ORDER BY t, idx)"


def ordered() -> Window:
    return Window.partitionBy("seq").orderBy("t", "idx")


@query("SELECT idx, CASE WHEN confidence >= 0.55 THEN 'OK' WHEN confidence >= 0.15 THEN 'DEGRADED' ELSE 'LOST' END AS health FROM base")
def f05_health_from_confidence(b: DataFrame) -> DataFrame:
    return b.select("idx", gates.health_from_confidence(F.col("confidence")).alias("health"))


@query("""
s AS (SELECT *, CASE WHEN confidence >= 0.55 THEN 'OK' WHEN confidence >= 0.15 THEN 'DEGRADED' ELSE 'LOST' END AS other FROM base)
SELECT idx, CASE WHEN list_position(['OK', 'DEGRADED', 'LOST', 'INVALID'], health) >= list_position(['OK', 'DEGRADED', 'LOST', 'INVALID'], other) THEN health ELSE other END AS health,
       round(confidence * CASE health WHEN 'OK' THEN 1 WHEN 'DEGRADED' THEN 0.45 ELSE 0 END / 3, 6) AS weight FROM s""")
def f06_worse_health(b: DataFrame) -> DataFrame:
    """The worse of two labels (F06), and confidence times the health's multiplier (F07)."""
    other, weight = gates.health_from_confidence(F.col("confidence")), F.col("confidence") * gates.multiplier(F.col("health"))
    return b.select("idx", gates.worse(F.col("health"), other).alias("health"), F.round(weight / 3, 6).alias("weight"))


SQL_STEPS = f"steps AS (SELECT *, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS jump FROM base WINDOW {WALK})"


def stepped(b: DataFrame) -> DataFrame:
    w = ordered()
    return b.withColumn("dt", F.col("t") - F.lag("t").over(w)).withColumn("jump", F.col("x") - F.lag("x").over(w))


@query(f"""{SQL_STEPS},
d AS (SELECT *, ((x - 50) ** 2 * (3.0 + py) - 2 * (x - 50) * (y - 50) + (y - 50) ** 2 * (2.0 + px)) / ((2.0 + px) * (3.0 + py) - 1) AS d2 FROM steps)
SELECT seq, idx, CASE WHEN health IN ('LOST', 'INVALID') THEN 'health_gate' WHEN confidence < 0.15 THEN 'confidence_gate' WHEN abs(dt) > 36000 THEN 'timestamp_gate' WHEN abs(jump) / greatest(dt, 1e-3) > 0.01 THEN 'motion_sanity_gate' WHEN d2 > 200 THEN 'mahalanobis_gate' END AS reason FROM d""")
def f13_gate_reason(b: DataFrame) -> DataFrame:
    """The first of the health, confidence, timestamp, motion and Mahalanobis gates (F08-F12) that a row fails."""
    reason = gates.gate_reason(F.col("health"), F.col("confidence"), F.col("dt"), F.abs("jump"), F.col("dt"), max_age=36000.0, max_speed=0.01, d2=distance_squared(), most=200.0)
    return stepped(b).select("seq", "idx", reason.alias("reason"))


def distance_squared():
    zero, one = F.lit(0.0), F.lit(1.0)
    s = [[2.0 + F.col("px"), one, zero], [one, 3.0 + F.col("py"), zero], [zero, zero, one]]
    return gates.mahalanobis_squared([F.col("x") - 50, F.col("y") - 50, zero], s)


@query("""
e AS (SELECT idx, x - 50 AS a, y - 50 AS b, 2.0 + px AS s0, 3.0 + py AS s1 FROM base),
d AS (SELECT idx, (a * a * s1 - 2 * a * b + b * b * s0) / (s0 * s1 - 1) AS d2 FROM e)
SELECT idx, round(d2 / 7, 5) AS d2_seventh, d2 > 16.27 AS rejected FROM d""")
def f12_mahalanobis(b: DataFrame) -> DataFrame:
    d2 = distance_squared()
    return b.select("idx", F.round(d2 / 7, 5).alias("d2_seventh"), (d2 > 16.27).alias("rejected"))


@query("SELECT idx, round((0.05 + (1 - least(greatest(confidence, 0), 1)) * 5.0) / 3, 6) AS sigma_third FROM base")
def f14_sigma(b: DataFrame) -> DataFrame:
    return b.select("idx", F.round(gates.position_sigma(F.col("confidence")) / 3, 6).alias("sigma_third"))


@query(f"""
ages AS (SELECT *, (t - coalesce(last_value(CASE WHEN {HEALTHY} THEN t END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY t, idx ROWS UNBOUNDED PRECEDING), min(t) OVER (PARTITION BY seq))) / 36000 AS age FROM base)
SELECT seq, idx, round(exp(-age), 6) AS confidence, CASE WHEN age <= 0.5 THEN 'OK' WHEN age <= 5 THEN 'DEGRADED' ELSE 'LOST' END AS state FROM ages""")
def f15_trust(b: DataFrame) -> DataFrame:
    """Trust by the age of the last healthy row, in units of ten hours."""
    last = F.last(F.when(F.col("health").isin("OK", "DEGRADED"), F.col("t")), True).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    ages = b.withColumn("age", (F.col("t") - F.coalesce(last, F.min("t").over(Window.partitionBy("seq")))) / 36000)
    confidence, health = gates.trust(F.col("age"))
    return ages.select("seq", "idx", F.round(confidence, 6).alias("confidence"), health.alias("state"))


@query(f"{SQL_STEPS} SELECT seq, idx, CASE WHEN dt > 36000 THEN 'DEGRADED' ELSE 'OK' END AS state FROM steps")
def f16_gap_health(b: DataFrame) -> DataFrame:
    return stepped(b).select("seq", "idx", F.when(F.col("dt") > 36000, "DEGRADED").otherwise("OK").alias("state"))


@query("SELECT idx, least(greatest(px - 2, 0), 4) AS cx, least(greatest(py - 4, 0), 31) AS cy, CASE WHEN p > 0 THEN 1 ELSE 0 END AS polarity, py < 32 AS in_bounds FROM base")
def f17_clamp(b: DataFrame) -> DataFrame:
    """Coordinates clamped into the frame (F17), and whether they were below its upper bound (F18)."""
    cx, cy = gates.into_frame(F.col("px") - 2, F.col("py") - 4, 5, 32)
    return b.select("idx", cx.alias("cx"), cy.alias("cy"), gates.polarity_bit(F.col("p")).alias("polarity"), gates.in_frame(F.col("px"), F.col("py"), 8, 32).alias("in_bounds"))


@query("""
s AS (SELECT seq, idx, t, CASE WHEN t - min(t) OVER (PARTITION BY seq) > 1500000 OR x > 400 THEN 2 WHEN t - min(t) OVER (PARTITION BY seq) > 700000 OR x > 200 THEN 1 ELSE 0 END AS s FROM base)
SELECT seq, idx, ['OK', 'DEGRADED', 'LOST'][1 + max(s) OVER (PARTITION BY seq ORDER BY t, idx ROWS UNBOUNDED PRECEDING)] AS state FROM s""")
def f19_latched_health(b: DataFrame) -> DataFrame:
    """Health that never recovers: the running maximum of the severity."""
    gone = F.col("t") - F.min("t").over(Window.partitionBy("seq"))
    s = b.withColumn("s", F.when((gone > 1_500_000) | (F.col("x") > 400), 2).when((gone > 700_000) | (F.col("x") > 200), 1).otherwise(0))
    worst = F.max("s").over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    return s.select("seq", "idx", F.array(F.lit("OK"), F.lit("DEGRADED"), F.lit("LOST"))[worst].alias("state"))


@query("SELECT idx, CASE WHEN y <= 0 OR py < 12 OR py / y < 0.10 THEN 0 ELSE least(1.0, py / 50.0) END AS confidence FROM base")
def f30_match_confidence(b: DataFrame) -> DataFrame:
    return b.select("idx", gates.match_confidence(F.col("py"), F.col("y")).alias("confidence"))


@query("SELECT seq, count(*) > 0 AS not_empty, bool_and(coalesce(dt >= 0, true)) AS ordered, bool_and(isfinite(x) AND isfinite(y)) AS finite, count(*) FILTER (WHERE " + HEALTHY + ") >= 3 AS enough FROM steps GROUP BY seq".replace("FROM steps", "FROM (SELECT *, t - lag(t) OVER (PARTITION BY seq ORDER BY idx) AS dt FROM base)"))
def f04_preconditions(b: DataFrame) -> DataFrame:
    """What an evaluation needs: rows, times in order of the row number, finite numbers, three rows that may be evaluated."""
    dt = F.col("t") - F.lag("t").over(Window.partitionBy("seq").orderBy("idx"))
    fine = ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") != float("inf")) & (F.abs("y") != float("inf"))
    return b.withColumn("dt", dt).groupBy("seq").agg(
        (F.count("*") > 0).alias("not_empty"), F.bool_and(F.coalesce(F.col("dt") >= 0, F.lit(True))).alias("ordered"), F.bool_and(fine).alias("finite"), (F.count_if(F.col("health").isin("OK", "DEGRADED")) >= 3).alias("enough"),
    )


SQL_BLEND = """
grid AS (SELECT seq, idx, t, m AS method FROM base, (SELECT unnest(['click', 'purchase', 'signup']) AS m) WHERE base.method = 'view'),
src AS (SELECT seq, method, t AS u, x, y, confidence AS c, health AS h FROM base),
prev AS (SELECT g.*, s.u AS pu, s.x AS ax, s.y AS ay, s.c AS ac, s.h AS ah FROM grid g ASOF LEFT JOIN src s ON g.seq = s.seq AND g.method = s.method AND g.t >= s.u),
around AS (SELECT g.*, s.u AS nu, s.x AS bx, s.y AS by_, s.c AS bc, s.h AS bh, CASE WHEN s.u > pu THEN (t - pu) / (s.u - pu) ELSE 0 END AS w FROM prev g ASOF LEFT JOIN src s ON g.seq = s.seq AND g.method = s.method AND g.t <= s.u),
sampled AS (SELECT seq, idx, t, method, CASE WHEN pu IS NULL THEN bx WHEN nu IS NULL THEN ax ELSE ax + w * (bx - ax) END AS x,
    CASE WHEN pu IS NULL OR nu IS NULL THEN 0 ELSE least(greatest(ac + w * (bc - ac), 0), 1) END AS confidence, CASE WHEN pu IS NULL OR nu IS NULL THEN 'INVALID' WHEN t - pu <= nu - t THEN ah ELSE bh END AS health FROM around)"""


def sampled(b: DataFrame) -> DataFrame:
    return fusion.sample_methods(b.where("method = 'view'").select("seq", "idx", "t"), b, ["seq"], METHODS, ["x"])


@query(f"{SQL_BLEND} SELECT seq, idx, method, health FROM sampled")
def j20_health_timeline(b: DataFrame) -> DataFrame:
    return sampled(b).select("seq", "idx", "method", "health")


@query(f"""{SQL_BLEND},
raw AS (SELECT *, CASE method WHEN 'click' THEN 0.5 WHEN 'purchase' THEN 0.3 ELSE 0.2 END * confidence * CASE health WHEN 'OK' THEN 1 WHEN 'DEGRADED' THEN 0.45 ELSE 0 END AS v FROM sampled)
SELECT seq, idx, round(CASE WHEN sum(v) > 1e-9 THEN sum(v * x) / sum(v) ELSE sum(x) FILTER (WHERE method = 'click') END, 5) + 0.0 AS x, round(CASE WHEN sum(v) > 1e-9 THEN sum(v * confidence) / sum(v) ELSE sum(confidence) FILTER (WHERE method = 'click') END, 5) + 0.0 AS confidence FROM raw GROUP BY seq, idx""")
def a25_blend(b: DataFrame) -> DataFrame:
    # Null where the fallback has no row at all, in both engines.
    return fusion.blend(sampled(b), ["seq", "idx"], STATIC, ["x"], "click").select("seq", "idx", *rounded("x", "confidence", to=5))


@query("""
last AS (SELECT seq, floor(t / 86400)::BIGINT AS day, method, max_by(radians(x) / 2, (t, idx)) AS a, max_by(confidence, (t, idx)) AS w FROM base GROUP BY ALL),
sided AS (SELECT *, CASE WHEN sin(a) * sin(first_value(a) OVER o) + cos(a) * cos(first_value(a) OVER o) < 0 THEN -w ELSE w END AS v FROM last WINDOW o AS (PARTITION BY seq, day ORDER BY method)),
s AS (SELECT seq, day, sum(v * sin(a)) AS z, sum(v * cos(a)) AS c FROM sided GROUP BY ALL)
SELECT seq, day, round(CASE WHEN sqrt(z * z + c * c) <= 1e-9 THEN 0 ELSE z / sqrt(z * z + c * c) END, 6) + 0.0 AS qz, round(CASE WHEN sqrt(z * z + c * c) <= 1e-9 THEN 1 ELSE c / sqrt(z * z + c * c) END, 6) + 0.0 AS qw FROM s""")
def a26_quaternion_blend(b: DataFrame) -> DataFrame:
    at = F.struct("t", "idx")
    last = b.groupBy("seq", F.floor(F.col("t") / 86400).alias("day"), "method").agg(F.max_by(F.radians("x") / 2, at).alias("a"), F.max_by("confidence", at).alias("w"))
    rows = last.select("seq", "day", "method", "w", F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin("a").alias("qz"), F.cos("a").alias("qw"))
    return fusion.blend_rotations(rows, ["seq", "day"], "method", "w").select("seq", "day", *rounded("qz", "qw"))


@query(f"""
grid AS (SELECT seq, idx, t, x AS mine FROM base WHERE method = 'view'), src AS (SELECT seq, t AS u, x, confidence AS c FROM base WHERE method = 'click'),
prev AS (SELECT g.*, s.u AS pu, s.x AS ax, s.c AS ac FROM grid g ASOF LEFT JOIN src s ON g.seq = s.seq AND g.t >= s.u),
around AS (SELECT g.*, s.u AS nu, s.x AS bx, s.c AS bc, CASE WHEN s.u > pu THEN (t - pu) / (s.u - pu) ELSE 0 END AS w FROM prev g ASOF LEFT JOIN src s ON g.seq = s.seq AND g.t <= s.u),
s AS (SELECT *, CASE WHEN pu IS NULL THEN bx WHEN nu IS NULL THEN ax ELSE ax + w * (bx - ax) END AS x, CASE WHEN pu IS NULL OR nu IS NULL THEN 0 ELSE least(greatest(ac + w * (bc - ac), 0), 1) END AS c, pu IS NOT NULL AND nu IS NOT NULL AS inside FROM around)
SELECT seq, idx, round(mine + CASE WHEN c >= 0.2 THEN 0.35 * c ELSE 0 END * (x - mine), 5) + 0.0 AS fused_x, round(CASE WHEN inside THEN c ELSE 0.3 END, 6) AS confidence FROM s""")
def a28_correction(b: DataFrame) -> DataFrame:
    fused = fusion.correct_with(b.where("method = 'view'").select("seq", "idx", "t", "x"), b.where("method = 'click'"), ["seq"], ["x"])
    return fused.select("seq", "idx", *rounded("fused_x", to=5), F.round("confidence", 6).alias("confidence"))


def fused(b: DataFrame) -> DataFrame:
    nth = F.row_number().over(ordered()).cast("double")
    given = b.select("seq", (nth - 0.1).alias("t"), "method", ((F.col("x") - 100) / 100).alias("x"), ((F.col("y") - 50) / 100).alias("y"), F.lit(0.0).alias("z"), "confidence", "health")
    return fusion.filter_fusion(inertial(b), given, ["seq"])


@rows_only
def a20_filter_steps(b: DataFrame) -> DataFrame:
    return fused(b).where("kind = 'step'").select("seq", "t", *rounded("x", "y", "z", "confidence", "position_sigma", to=5), "health")


@rows_only
def a20_update_log(b: DataFrame) -> DataFrame:
    """Every offered measurement and why it was rejected (K11 keeps the rejected ones)."""
    return fused(b).where("kind = 'update'").select("seq", F.round("t", 3).alias("t"), "method", "accepted", "reason", *rounded("innovation", "d2", "sigma", to=5))


@rows_only
def a24_step_weights(b: DataFrame) -> DataFrame:
    return fusion.step_weights(fused(b).where("kind = 'update'"), ["seq"]).select("seq", "step_t", "method", F.round("weight", 5).alias("weight"))


SQL_OFFERS = f"offers AS (SELECT seq, floor(t / 86400)::BIGINT AS day, method, confidence, health, {HEALTHY} AND confidence >= 0.15 AS accepted, x / 3 AS innovation FROM base)"


@query(f"""{SQL_OFFERS}
SELECT seq, day, method, count(*) AS offered, count(*) FILTER (WHERE accepted) AS accepted, round(avg(confidence), 6) AS mean_confidence, round(avg((health = 'DEGRADED')::INT), 6) AS degraded_share, round(avg((health IN ('LOST', 'INVALID'))::INT), 6) AS failed_share, round(coalesce(avg(innovation), 0), 6) AS mean_innovation FROM offers GROUP BY ALL""")
def a31_window_stats(b: DataFrame) -> DataFrame:
    accepted = F.col("health").isin("OK", "DEGRADED") & (F.col("confidence") >= 0.15)
    offers = b.select("seq", F.floor(F.col("t") / 86400).alias("day"), "method", "confidence", "health", accepted.alias("accepted"), (F.col("x") / 3).alias("innovation"), F.lit(None).cast("double").alias("d2"))
    stats = fusion.window_stats(offers, ["seq", "day", "method"]).drop("mean_d2")
    return stats.select("seq", "day", "method", "offered", "accepted", *[F.round(c, 6).alias(c) for c in ("mean_confidence", "degraded_share", "failed_share", "mean_innovation")])


@query("""SELECT seq, count(*) FILTER (WHERE confidence >= 0.5) AS applied, count(*) FILTER (WHERE confidence < 0.5 AND confidence > 0.1) AS skipped, count(*) FILTER (WHERE confidence < 0.5 AND confidence <= 0.1) AS invalid, round(avg(confidence), 6) AS mean_confidence FROM base GROUP BY seq""")
def a30_cue_diagnostics(b: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return b.groupBy("seq").agg(F.count_if(c >= 0.5).alias("applied"), F.count_if((c < 0.5) & (c > 0.1)).alias("skipped"), F.count_if((c < 0.5) & (c <= 0.1)).alias("invalid"), F.round(F.avg(c), 6).alias("mean_confidence"))


@query("""
r AS (SELECT seq AS run, min_by(method, (t, idx)) AS method, max(x) AS drift FROM base GROUP BY seq)
SELECT run, CASE WHEN row_number() OVER (PARTITION BY method ORDER BY drift, run) = 1 THEN method ELSE method || ' (' || run || ')' END AS label FROM r""")
def a33_labels(b: DataFrame) -> DataFrame:
    runs = b.groupBy(F.col("seq").alias("run")).agg(F.min_by("method", F.struct("t", "idx")).alias("method"), F.max("x").alias("drift"))
    return evaluate.labels(runs, "method", ["drift", "run"]).select("run", "label")


@query("""
r AS (SELECT seq, avg(x) AS base_error, avg(y) AS error, bool_or(method = 'error') AS perturbed FROM base GROUP BY seq)
SELECT perturbed, count(*) AS n, round(avg((base_error - error) / greatest(base_error, 1e-6)), 6) AS improvement FROM r GROUP BY perturbed""")
def a37_held_out_summary(b: DataFrame) -> DataFrame:
    r = b.groupBy("seq").agg(F.avg("x").alias("base_error"), F.avg("y").alias("error"), F.bool_or(F.col("method") == "error").alias("perturbed"))
    return evaluate.improvement(r, "base_error", "error", ["perturbed"]).select("perturbed", "n", F.round("improvement", 6).alias("improvement"))


@query(f"""{SQL_MATCH},
e AS (SELECT seq, count(*) AS n FROM est GROUP BY seq), r AS (SELECT seq, count(*) AS n FROM ref GROUP BY seq), m AS (SELECT seq, count(*) AS n FROM matched GROUP BY seq)
SELECT e.seq, coalesce(m.n, 0) AS matched, e.n - coalesce(m.n, 0) AS unmatched_source, coalesce(r.n, 0) - coalesce(m.n, 0) AS unmatched_target, round(coalesce(m.n, 0) / greatest(e.n, coalesce(r.n, 0), 1), 6) AS ratio FROM e LEFT JOIN r USING (seq) LEFT JOIN m USING (seq)""")
def a39_sync_invariants(b: DataFrame) -> DataFrame:
    """Matched and unmatched counts of both sides (A39); they add up and the ratio is in 0..1 (F32)."""
    sides = b.groupBy("seq").agg(F.count_if(F.col("idx") % 2 == 1).alias("e"), F.count_if(F.col("idx") % 2 == 0).alias("r")).where("e > 0")
    m = F.coalesce("n", F.lit(0))
    joined = sides.join(matches(b).groupBy("seq").agg(F.count("*").alias("n")), "seq", "left")
    return joined.select("seq", m.alias("matched"), (F.col("e") - m).alias("unmatched_source"), (F.col("r") - m).alias("unmatched_target"), F.round(m / F.greatest("e", "r", F.lit(1)), 6).alias("ratio"))


@query("SELECT seq, idx, row_number() OVER (PARTITION BY seq ORDER BY t, list_position(['click', 'purchase', 'signup', 'view', 'error'], method), idx) AS place FROM base WHERE method <> 'error'")
def t01_merge(b: DataFrame) -> DataFrame:
    """Streams of all methods but one, merged by time, ties by a fixed order of methods (U01)."""
    place = F.create_map(*[F.lit(v) for i, m in enumerate(("click", "purchase", "signup", "view")) for v in (m, i)])[F.col("method")]
    streams = [b.where(F.col("method") == m) for m in ("view", "signup", "click", "purchase")]
    merged = streams[0]
    for s in streams[1:]:
        merged = merged.unionByName(s)
    return merged.select("seq", "idx", F.row_number().over(Window.partitionBy("seq").orderBy("t", place, "idx")).cast("long").alias("place"))


@query("SELECT seq, min_by(idx, (-x, idx)) AS peak, count(*) AS n FROM base GROUP BY seq")
def t04_argmax(b: DataFrame) -> DataFrame:
    """The first of the largest."""
    return b.groupBy("seq").agg(F.min_by("idx", F.struct(-F.col("x"), F.col("idx"))).alias("peak"), F.count("*").alias("n"))


@query("SELECT seq, list_sort(list_filter(['click', 'purchase', 'radar', 'signup'], lambda m: NOT list_contains(list(DISTINCT method), m))) AS missing FROM base GROUP BY seq")
def u02_missing_streams(b: DataFrame) -> DataFrame:
    """Wanted streams that a sequence lacks (U02, A38)."""
    wanted = F.array(*[F.lit(m) for m in ("click", "purchase", "radar", "signup")])
    return b.groupBy("seq").agg(F.sort_array(F.array_except(wanted, F.collect_set("method"))).alias("missing"))


@query("SELECT idx, round(tanh(x / 100), 6) AS squashed, round(ln(1 + y), 6) AS logged, round(least(greatest((x - 100) / 50, -5), 5) / 3, 6) + 0.0 AS clamped FROM base")
def m14_features(b: DataFrame) -> DataFrame:
    return b.select("idx", F.round(F.tanh(F.col("x") / 100), 6).alias("squashed"), F.round(F.log1p("y"), 6).alias("logged"), (F.round(gates.clip((F.col("x") - 100) / 50, -5.0, 5.0) / 3, 6) + 0.0).alias("clamped"))


@query(f"SELECT seq, idx, CASE WHEN lag(x) OVER w IS NOT NULL THEN round(least(greatest((lag(x) OVER w - x) / 100 - 0.05 * (confidence - lag(confidence) OVER w) ** 2, -2), 2) / 3, 6) + 0.0 END AS reward FROM base WINDOW {WALK}")
def m16_reward(b: DataFrame) -> DataFrame:
    found = fusion.rewards(b.withColumn("error", F.col("x") / 100), ["seq"], ["t", "idx"], "error", ["confidence"], bucket=PART)
    return found.select("seq", "idx", (F.round(F.col("reward") / 3, 6) + 0.0).alias("reward"))


@query("SELECT seq, count(*) FILTER (WHERE health = 'OK') AS ok, count(*) FILTER (WHERE health = 'DEGRADED') AS degraded, count(*) FILTER (WHERE health = 'LOST') AS lost, count(*) FILTER (WHERE health = 'INVALID') AS invalid FROM base GROUP BY seq")
def m22_health_counts(b: DataFrame) -> DataFrame:
    """Counts of all four states, zero where there is none (K08, F28)."""
    return b.groupBy("seq").agg(*[F.count_if(F.col("health") == h).alias(h.lower()) for h in ("OK", "DEGRADED", "LOST", "INVALID")])


@query("SELECT seq, floor(t / 86400)::BIGINT AS day, round(avg(confidence) FILTER (WHERE method = 'click'), 6) AS click, round(avg(confidence) FILTER (WHERE method = 'purchase'), 6) AS purchase, round(avg(confidence) FILTER (WHERE method = 'signup'), 6) AS signup FROM base GROUP BY ALL")
def k12_trust_log(b: DataFrame) -> DataFrame:
    """Trust of each method by control step, pivoted."""
    wide = b.groupBy("seq", F.floor(F.col("t") / 86400).alias("day")).pivot("method", METHODS).agg(F.avg("confidence"))
    return wide.select("seq", "day", *[F.round(m, 6).alias(m) for m in METHODS])


@query("""
s AS (SELECT *, least(greatest((t - 1000000) / 500000, 0), 1) AS r FROM base)
SELECT idx, round(CASE WHEN method = 'click' AND t BETWEEN 1000000 AND 1500000 THEN x + 5 * r ELSE x END, 5) AS x, round(CASE WHEN method = 'purchase' AND t BETWEEN 1000000 AND 1500000 THEN 0 WHEN method = 'click' AND t BETWEEN 1000000 AND 1500000 THEN confidence * 0.6 ELSE confidence END / 3, 6) AS confidence FROM s""")
def w21_perturb(b: DataFrame) -> DataFrame:
    """A ramped bias with lowered confidence for one method, a dropout for another, in a closed time window."""
    spoiled = episodes.perturbed(b.withColumns({"y": F.lit(0.0), "z": F.lit(0.0)}), ["seq"], [episodes.Perturbation("click", "bias_ramp", 1e6, 1.5e6, 5.0, (1.0, 0.0, 0.0)), episodes.Perturbation("purchase", "dropout", 1e6, 1.5e6)], ["t", "idx"])
    return spoiled.select("idx", F.round("x", 5).alias("x"), F.round(F.col("confidence") / 3, 6).alias("confidence"))


