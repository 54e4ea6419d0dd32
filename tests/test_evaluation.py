"""The evaluation against a plain numpy version, aligned and in three dimensions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import asof, evaluate, evaluation
from trailmark.sources import reports, sinks, validators


def turn(axis, angle):
    axis = np.array(axis) / np.linalg.norm(axis)
    return np.array([*(axis * math.sin(angle / 2)), math.cos(angle / 2)])


def matrix(q):
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


@pytest.fixture(scope="module")
def flights(spark):
    """Two flights, a noisy copy of the reference in another frame each, and one of two rows."""
    random = np.random.default_rng(3)
    est, ref = [], []
    for k, seq in enumerate(["a", "b"]):
        t = np.arange(60) * 0.5
        p = np.stack([np.cos(t / 3) * 10, np.sin(t / 3) * 12, t * 0.4], axis=1)
        q = turn([1, 2, 3 + k], 0.7 + k)
        moved = (p - [5, 2, 1]) @ matrix(q).T + random.normal(0, 0.05, p.shape)
        for i in range(60):
            health = "LOST" if 20 <= i < 24 else "INVALID" if i == 40 else "OK" if i % 3 else "DEGRADED"
            est.append((seq, i, float(t[i] + 0.004), *map(float, moved[i]), *map(float, q), health, 0.5 + i))
            ref.append((seq, i, float(t[i]), *map(float, p[i]), 0.0, 0.0, 0.0, 1.0))
    est += [("c", 0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, "OK", 1.0), ("c", 1, 2.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, "LOST", float("nan"))]
    ref += [("c", 0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    names = "t double, x double, y double, z double, qx double, qy double, qz double, qw double"
    return spark.createDataFrame(est, f"seq string, idx long, {names}, health string, latency_ms double"), spark.createDataFrame(ref, f"seq string, ref_idx long, {names}")


def plain(est, ref, settings):
    """The same figures from lists of one flight's rows."""
    ok = [r for r in est if r.health in ("OK", "DEGRADED")]
    p, q = np.array([[r.x, r.y, r.z] for r in ok]), np.array([[r.x, r.y, r.z] for r in ref if any(abs(r.t - e.t) < 0.02 for e in ok)])
    far = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))])
    a, b = p - p.mean(axis=0), q - q.mean(axis=0)
    u, _, v = np.linalg.svd(b.T @ a)
    r = u @ np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(v))]) @ v
    made = a @ r.T + q.mean(axis=0)
    e = np.linalg.norm(made - q, axis=1)
    along = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(made, axis=0), axis=1))])
    turned = [r @ matrix([x.qx, x.qy, x.qz, x.qw]) for x in ok]
    rpe = []
    for i in range(len(made) - 1):
        ahead = along[i + 1 :] - along[i]
        j = int(np.abs(ahead - settings.step).argmin())
        if abs(ahead[j] - settings.step) <= 0.1 * settings.step:
            j += i + 1
            rpe.append(np.linalg.norm(turned[i].T @ (made[j] - made[i]) - (q[j] - q[i])))
    return e, far, np.array(rpe)


def test_evaluation_equals_numpy(spark, flights):
    est, ref = flights
    settings = evaluation.Settings(tolerance=0.02, step=5.0, bin_width=10.0, markers=(10.0, 1e6))
    got = evaluation.evaluate_trajectories(est, ref, ["seq"], settings)
    rows, refs = est.orderBy("seq", "idx").collect(), ref.orderBy("seq", "ref_idx").collect()
    ate, drift, rpe = ({r.seq: r for r in df.collect()} for df in (got.ate, got.drift, got.rpe))
    assert {r.seq: r.problem for r in got.problems.collect()} == {"c": "too few OK or DEGRADED rows"}
    for seq in "ab":
        e, far, relative = plain([r for r in rows if r.seq == seq], [r for r in refs if r.seq == seq], settings)
        assert ate[seq].rmse == pytest.approx(np.sqrt((e**2).mean()), abs=2e-6) and ate[seq].final_drift == pytest.approx(e[-1], abs=2e-6)
        assert drift[seq].cumulative_distance == pytest.approx(far[-1]) and drift[seq].drift_percent == pytest.approx(100 * e[-1] / far[-1])
        assert rpe[seq].n_pairs == len(relative) and rpe[seq].rmse == pytest.approx(np.sqrt((relative**2).mean()), abs=2e-6)
    heading = {r.seq: r.mean_deg for r in got.heading.collect()}
    assert all(h < 1.0 for h in heading.values()) and set(heading) == {"a", "b"}
    bins = got.drift_bins.where("seq = 'a'").orderBy("bin").collect()
    assert sum(b.n for b in bins) == ate["a"].__getitem__("rmse") * 0 + 55 and bins[0].centre == 5.0
    assert got.error_vs_time.count() == 120 and evaluation.overlay(got.error_vs_time, ["seq"]).count() == 110


def test_two_rows_last_as_long_as_the_step(flights):
    est, _ = flights
    lasts = {(r.seq, r.idx): r.lasts for r in evaluate.durations(est.where("seq = 'c' or idx < 1"), ["seq"], ["t", "idx"]).collect()}
    assert lasts["c", 0] == 2.0 and lasts["c", 1] == 0.0 and lasts["a", 0] == 0.0
    run = {r.seq: r for r in evaluate.runtime(est, ["seq"], "latency_ms").collect()}
    assert run["c"].n == 2 and run["c"].max_latency_ms == 1.0 and run["c"].real_time_factor == 2000.0
    failed = {r.seq: r for r in evaluate.failures(est, ["seq"], ["t", "idx"]).collect()}
    assert (failed["a"].n_lost, failed["a"].n_invalid, failed["a"].n_runs) == (4, 1, 2) and failed["a"].failed_s == pytest.approx(2.5)


def test_long_sequences_take_linear_time(spark):
    """One key; a frame that is walked anew for each row would take minutes."""
    import time

    def took(n):
        a, b = (spark.range(n).select(F.lit("a").alias("seq"), F.col("id").alias(name), (F.col("id") * 1.0 + s).alias("t")) for name, s in (("i", 0.3), ("j", 0.0)))
        began = time.time()
        assert asof.nearest(a, b, ["seq"]).where("near.j = i").count() == n
        return time.time() - began

    took(1_000)
    assert took(200_000) < 60


def test_buckets_change_nothing(spark):
    rows = [("ab"[i % 2], i, float((i * 7919) % 1000)) for i in range(300)]
    source = spark.createDataFrame(rows, "seq string, i int, t double")
    target = spark.createDataFrame([(s, j, t + 3.5) for s, j, t in rows if j % 5 == 0], "seq string, j int, t double")
    for tie in ("next", "prev"):
        plain_, bucketed = ({(r.i, r.near.j) for r in asof.nearest(source, target, ["seq"], tie=tie, bucket=b).collect()} for b in (None, 10.0))
        assert plain_ == bucketed
    a, b = (sorted((r.i, r.step_t) for r in asof.first_at_or_after(source, target, ["seq"], bucket=x).collect()) for x in (None, 50.0))
    assert a == b


def test_artifacts(spark, flights, tmp_path):
    est, ref = flights
    settings = evaluation.Settings(tolerance=0.02, step=5.0)
    got = evaluation.evaluate_trajectories(est, ref, ["seq"], settings)
    reports.write_evaluation(got, ["seq"], settings, str(tmp_path / "eval"))
    assert validators.check_metrics(spark, str(tmp_path / "eval/metrics.json")).where("problem is not null").count() in (0, 1)
    body = {r.value for r in spark.read.text(str(tmp_path / "eval/metrics.json")).collect()}
    assert len(body) == 3 and sum('"status":"OK"' in b for b in body) == 2
    times = spark.read.csv(str(tmp_path / "eval/error_vs_time.csv"), header=True)
    assert times.columns[:-1] == reports.ERROR_VS_TIME and times.count() == 120 and times.where("error_magnitude is null").count() == 10
    assert spark.read.csv(str(tmp_path / "eval/error_vs_distance.csv"), header=True).columns[:-1] == reports.ERROR_VS_DISTANCE
    reports.write_failed_evaluation(spark, str(tmp_path / "failed"), "no overlap", settings)
    assert '"reason":"no overlap"' in spark.read.text(str(tmp_path / "failed/metrics.json")).first().value
    assert spark.read.csv(str(tmp_path / "failed/error_vs_time.csv"), header=True).columns == reports.ERROR_VS_TIME
    runs = spark.createDataFrame([("imu", "r1", 5.0, 1), ("imu", "r2", 3.0, 2), ("vo", "r3", float("nan"), 3)], "method string, run string, drift_percent double, n int")
    spans = spark.createDataFrame([("r1", 0.0, 2.0), ("r1", 4.0, 5.0)], "run string, t_first double, t_last double")
    reports.write_comparison(runs, spans, str(tmp_path / "cmp"), ["method", "run", "drift_percent"])
    whole = spark.read.text(str(tmp_path / "cmp/metrics_comparison.json")).first().value
    assert '"ranking_by_drift_percent":["imu","imu","vo"]' in whole and '"drift_percent":null' in whole
    found = [r.value for r in spark.read.text(str(tmp_path / "cmp/failure_intervals.json")).collect()]
    assert any('"label":"imu (r1)"' in f and '"interval_count":2' in f for f in found) and any('"label":"imu","run":"r2"' in f for f in found)
    weights = spark.createDataFrame([(1.0, 0.25)], "t double, w double")
    reports.write_weight_log(weights, str(tmp_path / "weights"), ["w"])
    assert spark.read.csv(str(tmp_path / "weights"), header=True).first().w == "0.250000000"
    with pytest.raises(ValueError):
        reports.write_weight_log(weights, str(tmp_path / "w2"), ["v"])
    reports.write_streams({"imu": weights, "gps": weights.limit(0)}, str(tmp_path / "streams"))
    assert spark.read.text(str(tmp_path / "streams/manifest.json")).first().value == '{"streams":{"gps":0,"imu":1}}'
    named = spark.sql("select timestamp '2026-01-02 03:04:05' as now")
    assert named.select(reports.run_name("run", F.col("now"), ["run_20260102_030405"])).first()[0] == "run_20260102_030405-r2"


def test_run_folder(spark, flights, tmp_path):
    est, _ = flights
    one = est.where("seq = 'a'").withColumn("method", F.lit("imu"))
    path = str(tmp_path)
    sinks.write_trajectory(one, f"{path}/estimated_trajectory.csv")
    assert sinks.write_tum(one, f"{path}/estimated_trajectory_tum.txt") == 5
    counts = one.groupBy().agg(F.to_json(F.struct(*[F.count_if(F.col("health") == h).alias(h) for h in validators.HEALTH]))).first()[0]
    keys = ",".join(f'"{k}":1' for k in validators.MANIFEST_KEYS[:-1])
    spark.createDataFrame([(f'{{{keys},"health_counts":{counts}}}',)], "value string").coalesce(1).write.text(f"{path}/run_manifest.json")
    notes = sinks.failure_notes(asof.runs(one, ["seq"], "health", ["t", "idx"]), ["seq"])
    notes.select("notes").coalesce(1).write.text(f"{path}/failure_notes.md")
    spark.createDataFrame([("started",)], "value string").coalesce(1).write.text(f"{path}/run.log")
    found = {r.check: (r.passed, r.message) for r in validators.validate_run(spark, path, False).collect()}
    assert all(p for p, _ in found.values()), found
    assert {"trajectory", "tum", "manifest", "failure notes", "log", "health counts", "TUM rows"} == set(found)
    missing = {r.check for r in validators.validate_run(spark, path).where("not passed").collect()}
    assert missing == {"metrics", "error vs time", "error vs distance"}
    (tmp_path / "bad.csv").write_text("timestamp,method,x,y,z,qx,qy,qz,qw,vx,vy,vz,confidence,health,latency_ms\n1,m,1,2,3,0,0,0,1,,,,1,FINE,\n")
    (tmp_path / "short.csv").write_text("timestamp,method,x,y,z,qx,qy,qz,qw,vx,vy,vz,confidence,health,latency_ms\n")
    assert validators.check_trajectory_files(spark, str(tmp_path / "bad.csv")).first().problem == "line 2: health FINE is unknown"
    assert validators.check_trajectory_files(spark, str(tmp_path / "short.csv")).first().problem == "no rows"
    (tmp_path / "bad_tum.txt").write_text("0 1 2 3 0 0 0 1\n0 1 2\n")
    assert validators.check_tum_files(spark, str(tmp_path / "bad_tum.txt")).first().problem == "line 2: not eight cells"


def test_constraints(spark):
    rows = spark.createDataFrame([(0.0, 1.0, "OK"), (None, 1.0, "OK"), (1.0, float("inf"), "OK"), (1.0, 1.0, "FINE")], "t double, x double, health string")
    poses = rows.withColumns({c: F.lit(0.0) for c in ("y", "z", "qx", "qy", "qz", "qw")})
    assert sorted(r.problem for r in validators.trajectory_problems(poses).collect()) == ["t isn't finite", "unknown health FINE", "x isn't finite"]
    good = dict(timestamp_unit="s", association_policy="nearest", source_frame="imu", target_frame="world", position_units="m", orientation_format="xyzw")
    assert validators.export_metadata_problem(good) is None
    assert validators.export_metadata_problem(good | {"source_frame": ""}) == "source_frame must not be empty"
    assert validators.export_metadata_problem(good | {"health_counts": {"OK": -1}}) == "health count OK must not be negative"
