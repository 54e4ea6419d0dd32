"""Registered queries of the trajectory and sensor-stream operators over the driver's tables, with equal DuckDB SQL.

base() turns the event table into streams: one sequence for each user, with time, position, confidence, health and
polarity; odd rows serve as estimate, even rows as reference.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions import geometry
from trailmark.operators import asof, evaluate, events, sequences

EPOCH = 1_704_067_200  # 2024-01-01 UTC
TOLERANCE = 3600.0
PACKET = 7200.0
BIN = 500.0

HEALTH = {"view": "OK", "signup": "OK", "click": "DEGRADED", "error": "LOST", "purchase": "INVALID"}

SQL_BASE = f"""
base AS (
    SELECT user_id AS seq, event_id AS idx, event_type AS method, epoch_us(ts) / 1e6 - {EPOCH} AS t, value AS x,
           CAST(json_extract(props, '$.k') AS DOUBLE) AS y, least(value / 100.0, 1.0) AS confidence,
           CASE event_type WHEN 'view' THEN 'OK' WHEN 'signup' THEN 'OK' WHEN 'click' THEN 'DEGRADED' WHEN 'error' THEN 'LOST' ELSE 'INVALID' END AS health,
           CAST(user_id % 8 AS INTEGER) AS px, CAST(event_id % 48 AS INTEGER) AS py, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE -1 END AS p
    FROM events
)"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    health = F.coalesce(F.create_map(*[F.lit(v) for kv in HEALTH.items() for v in kv])[F.col("event_type")], F.lit("INVALID"))
    return e.select(
        F.col("user_id").alias("seq"), F.col("event_id").alias("idx"), F.col("event_type").alias("method"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - EPOCH).alias("t"),
        F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence"), health.alias("health"),
        (F.col("user_id") % 8).cast("int").alias("px"),
        (F.col("event_id") % 48).cast("int").alias("py"), F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(-1).alias("p"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(base(spark, sf_dir))
        more = "" if sql.startswith("SELECT") else ","
        ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {SQL_BASE}{more}\n{sql.strip()}"
        return f

    return register


def halves(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Estimate (odd rows) and reference (even rows)."""
    return b.where("idx % 2 = 1").select("seq", "idx", "t", "x", "y", "health"), b.where("idx % 2 = 0").select("seq", F.col("idx").alias("ref_idx"), "t", F.col("x").alias("ref_x"), F.col("y").alias("ref_y"))


SQL_NEAR = """
est AS (SELECT seq, idx, t, x, y, health FROM base WHERE idx % 2 = 1),
ref AS (SELECT seq, idx AS ref_idx, t AS u, x AS ref_x, y AS ref_y FROM base WHERE idx % 2 = 0),
prev AS (SELECT e.*, r.u AS pu, r.ref_idx AS pi, r.ref_x AS px_, r.ref_y AS py_ FROM est e ASOF LEFT JOIN ref r ON e.seq = r.seq AND e.t > r.u),
both_ AS (SELECT e.*, r.u AS nu, r.ref_idx AS ni, r.ref_x AS nx_, r.ref_y AS ny_ FROM prev e ASOF LEFT JOIN ref r ON e.seq = r.seq AND e.t <= r.u),
near AS (
    SELECT seq, idx, t, x, y, health, take, CASE WHEN take THEN pi ELSE ni END AS ref_idx, CASE WHEN take THEN px_ ELSE nx_ END AS ref_x,
           CASE WHEN take THEN py_ ELSE ny_ END AS ref_y, abs(t - CASE WHEN take THEN pu ELSE nu END) AS gap
    FROM (SELECT *, nu IS NULL OR (pu IS NOT NULL AND abs(t - pu) < abs(nu - t)) AS take FROM both_)
)"""
SQL_MATCH = f"""{SQL_NEAR},
matched AS (SELECT * FROM near WHERE gap <= {TOLERANCE} QUALIFY row_number() OVER (PARTITION BY seq, ref_idx ORDER BY gap, idx) = 1)"""


def matches(b: DataFrame) -> DataFrame:
    est, ref = halves(b)
    found = asof.match_nearest(est, ref, ["seq"], TOLERANCE, "idx", "ref_idx")
    return found.select("seq", "idx", "t", "x", "y", "health", F.col("near.ref_idx").alias("ref_idx"), F.col("near.ref_x").alias("ref_x"), F.col("near.ref_y").alias("ref_y"), "gap")


@query(f"{SQL_MATCH} SELECT seq, idx, ref_idx, round(gap, 6) AS gap FROM matched")
def j01_sync_nearest(b: DataFrame) -> DataFrame:
    return matches(b).select("seq", "idx", "ref_idx", F.round("gap", 6).alias("gap"))


@query(f"""{SQL_MATCH}
SELECT seq, count(*) AS n_matched, round(min(t), 6) AS t_first, round(max(t), 6) AS t_last, round(avg(gap), 6) AS mean_gap FROM matched GROUP BY seq""")
def j01_sync_diagnostics(b: DataFrame) -> DataFrame:
    return matches(b).groupBy("seq").agg(F.count("*").alias("n_matched"), F.round(F.min("t"), 6).alias("t_first"), F.round(F.max("t"), 6).alias("t_last"), F.round(F.avg("gap"), 6).alias("mean_gap"))


SQL_RUNS = """
 marked AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND state IS NOT DISTINCT FROM lag(state) OVER w THEN 0 ELSE 1 END AS start FROM {of} WINDOW w AS (PARTITION BY seq ORDER BY t, idx)),
 numbered AS (SELECT *, sum(start) OVER (PARTITION BY seq ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS run FROM marked)"""


@query(f"""{SQL_MATCH},
flagged AS (SELECT e.seq, e.idx, e.t, m.idx IS NULL AS state FROM est e LEFT JOIN matched m ON e.seq = m.seq AND e.idx = m.idx),
{SQL_RUNS.format(of="flagged")}
SELECT seq, round(min(t), 6) AS t_first, round(max(t), 6) AS t_last, count(*) AS n FROM numbered GROUP BY seq, run HAVING bool_and(state)""")
def j02_unmatched_ranges(b: DataFrame) -> DataFrame:
    found = asof.unmatched_ranges(halves(b)[0], matches(b), ["seq"], "idx")
    return found.select("seq", F.round("t_first", 6).alias("t_first"), F.round("t_last", 6).alias("t_last"), "n")


@query("""
est AS (SELECT seq, idx, t FROM base WHERE idx % 2 = 1), ref AS (SELECT seq, idx AS ref_idx, t AS u FROM base WHERE idx % 2 = 0),
prev AS (SELECT e.*, r.u AS pu, r.ref_idx AS pi FROM est e ASOF LEFT JOIN ref r ON e.seq = r.seq AND e.t >= r.u),
both_ AS (SELECT e.*, r.u AS nu, r.ref_idx AS ni FROM prev e ASOF LEFT JOIN ref r ON e.seq = r.seq AND e.t <= r.u)
SELECT seq, idx, CASE WHEN nu IS NULL OR (pu IS NOT NULL AND abs(t - pu) <= abs(nu - t)) THEN pi ELSE ni END AS ref_idx FROM both_""")
def j03_nearest_prev_tie(b: DataFrame) -> DataFrame:
    est, ref = halves(b)
    return asof.nearest(est, ref, ["seq"], tie="prev", bucket=7 * 86_400.0).select("seq", "idx", F.col("near.ref_idx").alias("ref_idx"))


SQL_LERP = """
est AS (SELECT seq, idx, t FROM base WHERE idx % 2 = 1), ref AS (SELECT seq, t AS u, x, y FROM base WHERE idx % 2 = 0),
prev AS (SELECT e.*, r.u AS pu, r.x AS ax, r.y AS ay FROM est e ASOF LEFT JOIN ref r ON e.seq = r.seq AND e.t >= r.u),
both_ AS (SELECT e.*, r.u AS nu, r.x AS bx, r.y AS by_ FROM prev e ASOF LEFT JOIN ref r ON e.seq = r.seq AND e.t <= r.u),
lerp AS (SELECT *, CASE WHEN nu > pu THEN (t - pu) / (nu - pu) ELSE 0 END AS w FROM both_)"""


@query(f"""{SQL_LERP}
SELECT seq, idx, round(CASE WHEN pu IS NULL THEN bx WHEN nu IS NULL THEN ax ELSE ax + w * (bx - ax) END, 6) AS x,
       round(CASE WHEN pu IS NULL THEN by_ WHEN nu IS NULL THEN ay ELSE ay + w * (by_ - ay) END, 6) AS y, pu IS NOT NULL AND nu IS NOT NULL AS in_range FROM lerp""")
def j04_interp_position(b: DataFrame) -> DataFrame:
    est, ref = b.where("idx % 2 = 1").select("seq", "idx", "t"), b.where("idx % 2 = 0").select("seq", "t", "x", "y")
    return asof.interpolate(est, ref, ["seq"], ["x", "y"]).select("seq", "idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "in_range")


@query(f"""{SQL_LERP},
angles AS (SELECT seq, idx, w, radians(coalesce(ax, bx)) / 2 AS a, radians(coalesce(bx, ax)) / 2 AS b FROM lerp),
dots AS (SELECT *, sin(a) * sin(b) + cos(a) * cos(b) AS dot FROM angles),
arcs AS (SELECT *, acos(least(abs(dot), 1.0)) AS arc, CASE WHEN dot < 0 THEN -1.0 ELSE 1.0 END AS s FROM dots),
parts AS (SELECT *, CASE WHEN sin(arc) < 1e-9 THEN 1 - w ELSE sin((1 - w) * arc) / sin(arc) END AS wa, s * CASE WHEN sin(arc) < 1e-9 THEN w ELSE sin(w * arc) / sin(arc) END AS wb FROM arcs),
made AS (SELECT seq, idx, wa * sin(a) + wb * sin(b) AS z, wa * cos(a) + wb * cos(b) AS w FROM parts)
SELECT seq, idx, round(z / sqrt(z * z + w * w), 6) + 0.0 AS qz, round(w / sqrt(z * z + w * w), 6) + 0.0 AS qw FROM made""")
def j05_slerp(b: DataFrame) -> DataFrame:
    est = b.where("idx % 2 = 1").select("seq", "idx", "t")
    half = F.radians("x") / 2
    ref = b.where("idx % 2 = 0").select("seq", "t", F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))
    return asof.interpolate_rotation(est, ref, ["seq"]).select("seq", "idx", (F.round("qz", 6) + 0.0).alias("qz"), (F.round("qw", 6) + 0.0).alias("qw"))


@query("""
src AS (SELECT seq, idx, t FROM base WHERE method <> 'view'), tgt AS (SELECT seq, t AS u, x FROM base WHERE method = 'view')
SELECT s.seq, idx, round(coalesce(g.x, 0.0), 6) AS x FROM src s ASOF LEFT JOIN tgt g ON s.seq = g.seq AND s.t >= g.u""")
def j08_forward_fill(b: DataFrame) -> DataFrame:
    found = asof.latest(b.where("method <> 'view'").select("seq", "idx", "t"), b.where("method = 'view'").select("seq", "t", "x"), ["seq"], "x")
    return found.select("seq", "idx", F.round("x", 6).alias("x"))


@query("""
src AS (SELECT seq, idx, t FROM base WHERE method = 'click'), tgt AS (SELECT seq, t AS u FROM base WHERE method = 'view')
SELECT s.seq, idx, round(g.u, 6) AS step_t FROM src s ASOF JOIN tgt g ON s.seq = g.seq AND s.t <= g.u""")
def j09_first_step_after(b: DataFrame) -> DataFrame:
    found = asof.first_at_or_after(b.where("method = 'click'").select("seq", "idx", "t"), b.where("method = 'view'").select("seq", "t"), ["seq"])
    return found.select("seq", "idx", F.round("step_t", 6).alias("step_t"))


@query(f"""
win AS (SELECT seq, idx AS win, t - {PACKET} AS lo, t + {PACKET} AS hi FROM base WHERE method = 'error')
SELECT w.seq, win, count(*) AS n, round(avg(e.x), 6) AS mean_x FROM win w JOIN base e ON e.seq = w.seq AND e.t >= lo AND e.t <= hi GROUP BY w.seq, win""")
def j10_events_in_window(b: DataFrame) -> DataFrame:
    windows = b.where("method = 'error'").select("seq", F.col("idx").alias("win"), (F.col("t") - PACKET).alias("lo"), (F.col("t") + PACKET).alias("hi"))
    return asof.in_windows(b.select("seq", "t", "x"), windows, ["seq"], 2 * PACKET).groupBy("seq", "win").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean_x"))




@query(f"""
span AS (SELECT seq, min(t) AS t0, max(t) AS t1, greatest(ceil((max(t) - min(t)) / {PACKET}), 1)::BIGINT AS n FROM base GROUP BY seq),
win AS (SELECT seq, unnest(range(n)) AS win FROM span),
hit AS (SELECT b.seq, least(floor((t - t0) / {PACKET})::BIGINT, n - 1) AS win, count(*) AS n FROM base b JOIN span USING (seq) GROUP BY ALL)
SELECT seq, win, coalesce(hit.n, 0) AS n FROM win LEFT JOIN hit USING (seq, win)""")
def w01_packets(b: DataFrame) -> DataFrame:
    return events.packets(b.select("seq", "t"), ["seq"], PACKET).select("seq", "win", "n")


@query(f"""
hit AS (SELECT seq, floor(t / {PACKET})::BIGINT AS bin, bool_or(p > 0) AS red, bool_or(p <= 0) AS blue FROM base GROUP BY ALL),
top AS (SELECT seq, max(bin) AS n FROM hit GROUP BY seq), bins AS (SELECT seq, unnest(range(n + 1)) AS bin FROM top)
SELECT seq, bin, coalesce(red, false) AS red, coalesce(blue, false) AS blue FROM bins LEFT JOIN hit USING (seq, bin)""")
def w02_render_bins(b: DataFrame) -> DataFrame:
    return events.render_bins(b, ["seq"], PACKET)


@query("""
marked0 AS (SELECT seq, idx, t, health AS state FROM base),
""" + SQL_RUNS.format(of="marked0") + """
SELECT seq, any_value(state) AS state, round(min(t), 6) AS t_first, round(max(t), 6) AS t_last, count(*) AS n FROM numbered GROUP BY seq, run""")
def w05_all_intervals(b: DataFrame) -> DataFrame:
    return asof.runs(b, ["seq"], "health", ["t", "idx"]).select("seq", "state", F.round("t_first", 6).alias("t_first"), F.round("t_last", 6).alias("t_last"), "n")


@query("""
marked0 AS (SELECT seq, idx, t, health AS state FROM base),
""" + SQL_RUNS.format(of="marked0") + """
SELECT seq, any_value(state) AS state, round(min(t), 6) AS t_first, round(max(t), 6) AS t_last, count(*) AS n FROM numbered GROUP BY seq, run HAVING any_value(state) <> 'OK'""")
def w05_failure_intervals(b: DataFrame) -> DataFrame:
    return w05_all_intervals(b).where("state <> 'OK'")


@query("""
steps AS (SELECT seq, idx, t, x, lead(x) OVER w AS nx, lead(t) OVER w AS nt, lag(x) OVER w AS lx, lag(t) OVER w AS lt FROM base WINDOW w AS (PARTITION BY seq ORDER BY t, idx))
SELECT seq, idx, round(CASE WHEN nt IS NOT NULL THEN (nx - x) / CASE WHEN nt > t THEN nt - t ELSE 1e-9 END WHEN lt IS NOT NULL THEN (x - lx) / CASE WHEN t > lt THEN t - lt ELSE 1e-9 END ELSE 0 END, 6) + 0.0 AS vx FROM steps""")
def w06_velocity(b: DataFrame) -> DataFrame:
    return sequences.velocity(b, ["seq"], "x", ["t", "idx"]).select("seq", "idx", (F.round("velocity", 6) + 0.0).alias("vx"))


SQL_DIST = """
step AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS d FROM base WINDOW w AS (PARTITION BY seq ORDER BY t, idx)),
dist AS (SELECT *, sum(d) OVER (PARTITION BY seq ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS distance FROM step)"""


@query(f"{SQL_DIST} SELECT seq, idx, round(distance, 4) AS distance FROM dist")
def w07_cum_distance(b: DataFrame) -> DataFrame:
    return sequences.cumulative_distance(b, ["seq"], ["x", "y"], ["t", "idx"]).select("seq", "idx", F.round("distance", 4).alias("distance"))


@query(f"""{SQL_DIST}, marks AS (SELECT unnest([100.0, 1000.0, 1e9]) AS marker), seqs AS (SELECT DISTINCT seq FROM base),
reached AS (SELECT seq, marker, min_by(x, (t, idx)) AS x FROM dist, marks WHERE distance >= marker GROUP BY ALL)
SELECT seq, marker, round(x, 6) AS x FROM seqs CROSS JOIN marks LEFT JOIN reached USING (seq, marker)""")
def w08_markers(b: DataFrame) -> DataFrame:
    d = sequences.cumulative_distance(b, ["seq"], ["x", "y"], ["t", "idx"])
    return evaluate.first_reach(d, ["seq"], "distance", "x", [100.0, 1000.0, 1e9], ["t", "idx"]).select("seq", "marker", F.round("x", 6).alias("x"))


@query(f"{SQL_DIST} SELECT seq, idx, floor(round(distance, 4) / {BIN}) * {BIN} AS bin_start FROM dist")
def w09_bins(b: DataFrame) -> DataFrame:
    d = sequences.cumulative_distance(b, ["seq"], ["x", "y"], ["t", "idx"])
    return d.select("seq", "idx", (F.floor(F.round("distance", 4) / BIN) * F.lit(BIN)).alias("bin_start"))


@query("SELECT seq, py AS y, count(*) FILTER (WHERE p > 0) AS n_pos, count(*) FILTER (WHERE p <= 0) AS n_neg FROM base GROUP BY seq, py")
def a01_count_frame(b: DataFrame) -> DataFrame:
    return events.count_frame(b, ["seq"], ["py"]).withColumnRenamed("py", "y")


@query(f"last AS (SELECT seq, max(t) AS t_ref FROM base GROUP BY seq) SELECT seq, py AS y, round(exp(-(any_value(t_ref) - max(t)) / {PACKET * 10}), 6) AS surface FROM base JOIN last USING (seq) GROUP BY seq, py")
def a02_time_surface(b: DataFrame) -> DataFrame:
    return events.time_surface(b, ["seq"], ["py"], PACKET * 10).select("seq", F.col("py").alias("y"), F.round("surface", 6).alias("surface"))


@query("n AS (SELECT seq, py, count(*) AS c FROM base GROUP BY ALL) SELECT seq, py AS y, round(c / max(c) OVER (PARTITION BY seq), 6) AS edge FROM n")
def a03_edges(b: DataFrame) -> DataFrame:
    return events.edges(b, ["seq"], ["py"]).select("seq", F.col("py").alias("y"), F.round("edge", 6).alias("edge"))


@query("n AS (SELECT seq, py, count(*) AS c FROM base GROUP BY ALL) SELECT seq, count(*) AS active, count(*) FILTER (WHERE c > 2 * m) AS hot FROM (SELECT *, avg(c) OVER (PARTITION BY seq) AS m FROM n) GROUP BY seq")
def a06_pixel_activity(b: DataFrame) -> DataFrame:
    return events.pixel_activity(b, ["seq"], ["py"], 2.0)




@query("pairs AS (SELECT seq, idx, x - y AS d FROM base) SELECT seq, round(avg(abs(d + 180 - 360 * floor((d + 180) / 360) - 180)), 9) AS mean_deg, round(quantile_cont(abs(d + 180 - 360 * floor((d + 180) / 360) - 180), 0.95), 6) AS p95_deg FROM pairs GROUP BY seq")
def a15_heading(b: DataFrame) -> DataFrame:
    wrapped = F.abs(geometry.wrap_degrees(F.col("x") - F.col("y")))
    return b.groupBy("seq").agg(F.round(F.avg(wrapped), 9).alias("mean_deg"), F.round(F.percentile(wrapped, 0.95), 6).alias("p95_deg"))


@query("total AS (SELECT t, seq, method, confidence, sum(confidence) OVER (PARTITION BY seq, floor(t / 86400)) AS s, idx FROM base) SELECT seq, idx, round(CASE WHEN s > 1e-9 THEN confidence / s ELSE 0 END, 6) AS weight FROM total")
def a19_weights(b: DataFrame) -> DataFrame:
    w = Window.partitionBy("seq", F.floor(F.col("t") / 86400))
    return sequences.normalised_weight(b, "confidence", w).select("seq", "idx", F.round("weight", 6).alias("weight"))


@query("drift AS (SELECT seq, method, max(x) AS drift FROM base GROUP BY seq, method) SELECT seq, method, round(drift, 6) AS drift, row_number() OVER (PARTITION BY seq ORDER BY drift NULLS LAST, method) AS rank FROM drift")
def a32_ranking(b: DataFrame) -> DataFrame:
    drift = b.groupBy("seq", "method").agg(F.max("x").alias("drift"))
    return evaluate.rank_runs(drift, ["seq"], "drift", "method").select("seq", "method", F.round("drift", 6).alias("drift"), F.col("rank").cast("long").alias("rank"))


@query("SELECT idx, round(radians(y - 10.0) * 6371000.0, 2) AS north, round(radians(x - 20.0) * cos(radians(10.0)) * 6371000.0, 2) AS east FROM base")
def m01_enu(b: DataFrame) -> DataFrame:
    east, north = geometry.enu(F.col("y"), F.col("x"), 10.0, 20.0)
    return b.select("idx", F.round(north, 2).alias("north"), F.round(east, 2).alias("east"))


@query("ranked AS (SELECT seq, idx, row_number() OVER (PARTITION BY seq ORDER BY x DESC, idx) AS r FROM base) SELECT seq, idx FROM ranked WHERE r <= 3")
def t02_topk(b: DataFrame) -> DataFrame:
    return sequences.top_k(b, ["seq"], [F.desc("x"), F.asc("idx")], 3).select("seq", "idx")


@query("ranked AS (SELECT seq, idx, row_number() OVER (PARTITION BY seq ORDER BY t, idx) AS r FROM base) SELECT seq, idx, r % 5 = 0 AS held_out FROM ranked")
def t06_holdout(b: DataFrame) -> DataFrame:
    return b.select("seq", "idx", (F.row_number().over(Window.partitionBy("seq").orderBy("t", "idx")) % 5 == 0).alias("held_out"))


@query("span AS (SELECT seq, method, min(t) AS a, max(t) AS z FROM base GROUP BY ALL) SELECT seq, round(max(a), 6) AS t_from, round(min(z), 6) AS t_to FROM span GROUP BY seq HAVING max(a) <= min(z)")
def u03_overlap(b: DataFrame) -> DataFrame:
    span = b.groupBy("seq", "method").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    return span.groupBy("seq").agg(F.round(F.max("a"), 6).alias("t_from"), F.round(F.min("z"), 6).alias("t_to")).where("t_from <= t_to")
