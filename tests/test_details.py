"""Parts of larger operators: buckets that change nothing, logs, observations, diagnostics, rewards, bands, late rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import gates
from trailmark.operators import episodes, evaluate, fusion, motion, policy, sequences
from trailmark.sources import datasets
from trailmark.streaming import fusion as streamed
from trailmark.streaming import latest


@pytest.fixture(scope="module")
def tracks(spark):
    rng = random.Random(8)
    rows = [(k, i, round(rng.uniform(0, 100), 4), rng.uniform(-5, 5), rng.random(), rng.choice(("OK", "DEGRADED", "LOST")), "ab"[i % 2]) for k in (1, None, 2) for i in range(80)]
    return spark.createDataFrame(rows, "k int, i int, t double, x double, confidence double, health string, method string").repartition(4)


def same(a, b, key="i"):
    def rows(df):
        return {(r.k, r[key]): [None if v is None else round(v, 9) if isinstance(v, float) else v for v in r] for r in df.collect()}

    left, right = rows(a), rows(b)
    assert left == right and left


@pytest.mark.parametrize("bucket", [7.0, 1000.0])
def test_buckets_give_the_same_rows(spark, tracks, bucket):
    """Null keys, ties of times, buckets without rows."""
    grid, other = tracks.where("i % 3 = 0").select("k", "i", "t"), tracks.where("i % 3 <> 0")
    same(motion.resample(grid, other, ["k"], ["x"]), motion.resample(grid, other, ["k"], ["x"], bucket=bucket))
    cues = spark.createDataFrame([(k, j * 10.0, j * 10.0 + 4, 0.5 * j) for k in (1, 2) for j in range(9)], "k int, t0 double, t1 double, correction double")
    same(motion.ramp_offsets(tracks, cues, ["k"]), motion.ramp_offsets(tracks, cues, ["k"], bucket=bucket))
    same(sequences.running_sum(tracks, ["k"], ["t", "i"], "x"), sequences.running_sum(tracks, ["k"], ["t", "i"], "x", bucket=bucket))
    parts = [tracks.where(F.col("method") == m).select("k", "t", "x") for m in "ab"]
    same(motion.union_grid(parts, ["k"], "x"), motion.union_grid(parts, ["k"], "x", bucket=bucket), key="t")
    windows = grid.select("k", "i", (F.col("t") - 1).alias("lo"), (F.col("t") + 1).alias("hi"))
    same(motion.mean_in_windows(other, windows, ["k"], "x", 2.0, "i"), motion.mean_in_windows(other, windows, ["k"], "x", 2.0, "i", bucket=bucket))
    a, b = (fusion.sample_methods(grid, other, ["k"], ["a", "b"], ["x"], bucket=x) for x in (None, bucket))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    vectors = tracks.withColumn("embedding", F.array("x", "confidence", F.lit(1.0)))
    same(motion.embedding_signals(vectors, ["k"], "i").drop("embedding"), motion.embedding_signals(vectors, ["k"], "i", bucket=bucket).drop("embedding"))
    rewards = [fusion.rewards(tracks, ["k"], ["t", "i"], "x", ["confidence"], bucket=x) for x in (None, bucket)]
    same(*rewards)


def test_rewards_equal_a_loop(tracks):
    got = {r.i: r.reward for r in fusion.rewards(tracks.where("k = 1"), ["k"], ["t", "i"], "x", ["confidence", "x"]).collect()}
    rows = sorted((r.t, r.i, r.x, r.confidence) for r in tracks.where("k = 1").collect())
    assert got[rows[0][1]] is None
    for before, now in zip(rows, rows[1:], strict=False):
        want = before[2] - now[2] - 0.05 * ((now[3] - before[3]) ** 2 + (now[2] - before[2]) ** 2) / 2
        assert got[now[1]] == pytest.approx(max(-2.0, min(2.0, want)))


def test_ground_truth_begins_at_its_first_row(spark):
    rows = [("a", 1.0, 48.0, 11.0, 500.0, 90.0, 3.0), ("a", 0.0, 47.9, 10.9, 480.0, 0.0, 2.0), (None, 0.0, 1.0, 2.0, 3.0, 45.0, 1.0)]
    got = {(r.k, r.t): r for r in motion.ground_truth(spark.createDataFrame(rows, "k string, t double, lat double, lon double, alt double, heading_deg double, speed double"), ["k"], ["t"]).collect()}
    first, second = got["a", 0.0], got["a", 1.0]
    assert (first.x, first.y, first.z, first.vx, first.vy) == (0.0, 0.0, 0.0, 0.0, 2.0)
    assert (second.x, second.y, second.z) == pytest.approx((math.radians(0.1) * math.cos(math.radians(47.9)) * 6_371_000, math.radians(0.1) * 6_371_000, 20.0))
    assert (second.qz, second.qw, second.vx, second.vy) == pytest.approx((math.sqrt(0.5), math.sqrt(0.5), 3.0, 0.0)) and got[None, 0.0].x == 0.0


def test_observations_are_what_a_policy_sees(spark):
    """The frame's features equal those of the loop that the policy run uses; an unseen method is as stale as can be."""
    p = policy.Policy(("a", "b"), ((np.zeros((2, 20)), np.zeros(2)),), np.zeros(20), np.ones(20))
    window = policy._Window(p.methods)
    from types import SimpleNamespace

    offers = [("a", 0.9, "OK", True, 1.5, 2.0), ("a", 0.4, "DEGRADED", False, 3.5, 4.0), ("a", 0.1, "LOST", False, None, None)]
    for m, c, h, ok, e, d2 in offers:
        window.add(SimpleNamespace(method=m, confidence=c, health=h), [ok, None, e], d2)
    fused = SimpleNamespace(cov=np.eye(15) * 4.0, v=np.array([3.0, 4.0, 0.0]))
    want = window.observation(p, fused, {"a": 1.25, "b": 9.0}, 0.5, np.array([0.2, 0.4]), [])
    rows = spark.createDataFrame([(1, *o) for o in offers], "step int, method string, confidence double, health string, accepted boolean, innovation double, d2 double")
    stats = fusion.window_stats(rows, ["step", "method"]).withColumn("age", F.lit(1.25))
    steps = spark.createDataFrame([(1, 2.0, 5.0, 0.5, 0.3), (2, 0.0, 0.0, 2.0, 1.0)], "step int, sigma double, speed double, progress double, mean_trust double")
    got = {r.step: r.features for r in fusion.observations(stats, steps, ["step"], ["b", "a"]).collect()}
    assert got[1] == pytest.approx(want.tolist()) and len(got[1]) == len(p.features)
    assert got[2] == pytest.approx([0, 0, 0, 0, 0, 0, 1, 0] * 2 + [0.0, 0.0, 1.0, 1.0])


def test_ensemble_weights_fall_back(spark):
    rows = [(1, "a", 0.8, "OK"), (1, "b", 0.5, "DEGRADED"), (1, "c", 1.0, "LOST"), (2, "a", 0.0, "OK"), (2, "b", None, "OK"), (2, "c", 0.9, "INVALID")]
    df = spark.createDataFrame(rows, "step int, method string, confidence double, health string")
    got = {(r.step, r.method): (r.raw, r.weight) for r in fusion.ensemble_weights(df, ["step"], {"a": 0.5, "b": 0.5}, "b").collect()}
    raw = [0.4, 0.5 * 0.5 * 0.45]
    assert got[1, "a"] == pytest.approx((raw[0], raw[0] / sum(raw))) and got[1, "b"] == pytest.approx((raw[1], raw[1] / sum(raw))) and got[1, "c"] == (0.0, 0.0)
    assert [got[2, m][1] for m in "abc"] == [0.0, 1.0, 0.0]


def test_cue_diagnostics_count_pairs(spark):
    cues = spark.createDataFrame([("a", 0.0, 1.0, True, 0.9), ("a", 1.0, 2.0, False, 0.1), ("a", 2.0, 3.0, False, 0.0), ("b", 5.0, 6.0, False, 0.0)], "k string, lo double, hi double, applied boolean, confidence double")
    poses = spark.createDataFrame([("a", t) for t in (-1.0, -0.2, 1.5, 3.2)], "k string, t double")
    got = {r.k: r for r in episodes.cue_diagnostics(cues, ["k"], poses).collect()}
    assert tuple(got["a"])[1:] == pytest.approx((3, 1, 1, 1, 1.0 / 3, 0.75)) and (got["b"].invalid, got["b"].coverage) == (1, 0.0)


def test_load_diagnostics_list_streams(spark):
    rows = spark.createDataFrame([("a", "imu", None), ("a", "imu", "t: x"), ("a", "gps", None), ("b", "cam", None)], "k string, stream string, problem string")
    aside = spark.createDataFrame([("a", "gps")], "k string, stream string")
    got = {r.k: tuple(r)[1:] for r in datasets.load_diagnostics(rows, ["k"], ["cam", "gps", "imu"], aside).collect()}
    assert got == {"a": (["cam"], ["imu"], ["gps"]), "b": (["gps", "imu"], [], [])}
    assert datasets.load_diagnostics(rows, ["k"], ["imu"]).where("k = 'a'").first().quarantined == []


def test_bands_and_improvements(spark):
    bins = spark.createDataFrame([(1.0, 4.0), (5.0, 2.0), (None, None)], "median double, iqr double")
    assert [(r.low, r.high) for r in evaluate.iqr_band(bins).where("median is not null").orderBy("median").collect()] == [(0.0, 3.0), (4.0, 6.0)]
    runs = spark.createDataFrame([(2.0, 1.0, True), (4.0, 4.0, True), (0.0, 0.0, False)], "base double, error double, spoilt boolean")
    assert {r.spoilt: (r.n, r.improvement) for r in evaluate.improvement(runs, "base", "error", ["spoilt"]).collect()} == {True: (2, 0.25), False: (1, 0.0)}


def test_events_are_put_into_frames(spark):
    df = spark.createDataFrame([(-3, 5, -1), (9, 99, 1), (2, 0, 0)], "x int, y int, p int")
    x, y = gates.into_frame(F.col("x"), F.col("y"), 4, 8)
    assert [tuple(r) for r in df.select(x, y, gates.in_frame(F.col("x"), F.col("y"), 4, 8), gates.polarity_bit(F.col("p"))).collect()] == [(0, 5, False, 0), (3, 7, False, 1), (2, 0, True, 0)]


def stream_of(spark, frames, path):
    for part in frames:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def test_late_samples_leave_a_row_and_idle_keys_may_go(spark, tmp_path):
    imu = spark.range(40).select(F.lit("a").alias("seq"), (F.col("id") * 0.1).alias("t"), F.lit(0.1).alias("ax"), F.lit(0.0).alias("ay"), F.lit(9.81).alias("az"), F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), F.lit(0.01).alias("gz"))
    none = spark.createDataFrame([], "seq string, t double, method string, x double, y double, z double, confidence double, health string")
    rows = fusion.offered(imu, none, ["seq"])
    late = rows.where("t between 0.95 and 1.25")
    got = drained(spark, streamed.filter_stream(stream_of(spark, [rows.where("t < 3"), late, rows.where("t >= 3")], str(tmp_path / "imu")), ["seq"], idle=3600.0), "late_rows")
    assert [round(r.t, 3) for r in got.where("kind = 'late'").orderBy("t").collect()] == [1.0, 1.1, 1.2] and got.where("kind = 'step'").count() == 40
    want = {round(r.t, 6): round(r.x, 9) for r in fusion.filter_fusion(imu, none, ["seq"]).collect()}
    assert {round(r.t, 6): round(r.x, 9) for r in got.where("kind = 'step'").collect()} == want
    values = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, None)], "seq string, t double, value double")
    assert {r.t: r.filled for r in drained(spark, latest.forward_fill(stream_of(spark, [values], str(tmp_path / "v")), "seq", idle=3600.0), "idle_keys").collect()} == {0.0: 1.0, 1.0: 1.0}
