import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import frames, gates, geometry
from trailmark.operators import episodes, motion

SCHEMA = "seq string, idx long, method string, t double, x double, y double, z double, confidence double, health string"


def test_noise_is_the_generators(spark):
    rows = [(s, i, "vo", float(i), 0.0, 0.0, 0.0, 1.0, "OK") for s in "ab" for i in range(40)]
    burst = episodes.Perturbation("vo", "noise_burst", 5.0, 30.0, 2.0, seed=9)
    found = episodes.perturbed(spark.createDataFrame(rows, SCHEMA), ["seq"], [burst], ["t"]).orderBy("seq", "idx").collect()
    want = np.random.Generator(np.random.PCG64(9)).normal(0, 2.0, (26, 3))
    for s in "ab":
        got = np.array([[r.x, r.y, r.z] for r in found if r.seq == s])
        assert np.allclose(got[5:31], want) and not got[:5].any() and not got[31:].any()
    assert {r.confidence for r in found if 5 <= r.idx <= 30} == {0.7}


def test_draws_have_a_fixed_order():
    one, two = (episodes.draw_perturbations(np.random.default_rng(4), ["a", "b"], 0.0, 100.0, 3) for _ in range(2))
    assert one == two and len(one) == 3
    assert all(20 <= p.end - p.start <= 40 and p.kind in episodes.KINDS for p in one)
    assert episodes.draw_perturbations(np.random.default_rng(4), [], 0.0, 1.0, 2) == []
    with pytest.raises(ValueError):
        episodes.draw_perturbations(np.random.default_rng(4), ["a"], 0.0, 1.0, -1)
    with pytest.raises(ValueError):
        episodes.Perturbation("a", "dropout", 1.0, 1.0)


def test_estimator_states(spark):
    events = spark.createDataFrame([("s", 0, 0.5), ("s", 2, 9.0)], "seq string, step long, t double")
    imu = spark.createDataFrame([("s", 0, float(t), 0.0, 0.0, 0.1) for t in range(3)] + [("s", 1, 4.0, 0.0, 0.0, 0.1)], "seq string, step long, t double, gx double, gy double, gz double")
    found = {r.step: r for r in episodes.estimator_states(events, imu, ["seq"]).collect()}
    assert (found[0].t, found[1].t, found[2].t) == (2.0, 4.0, 9.0)
    assert found[2].qz == found[1].qz > found[0].qz > 0


def test_event_inertial_follows_the_frames(spark):
    """A body at rest whose frames say that it moves is pulled along by the cues."""
    imu = spark.createDataFrame([("s", i * 0.1, 0.0, 0.0, 9.81, 0.0, 0.0, 0.0) for i in range(60)], "seq string, t double, ax double, ay double, az double, gx double, gy double, gz double")
    pairs = spark.createDataFrame([("s", k, k * 0.5, k * 0.5 + 0.5, -2.0, 0.0, 1.0, True, "ok") for k in range(10)], "seq string, pair long, lo double, hi double, shift_x double, shift_y double, confidence double, valid boolean, reason string")
    out = {round(r.t, 1): r for r in episodes.event_inertial(imu, pairs, ["seq"], 100.0, 10.0, gain=1.0).collect()}
    assert out[0.0].x == pytest.approx(0, abs=1e-9) and out[5.0].x == pytest.approx(2.0, abs=1e-6)
    assert out[2.0].confidence == 1.0 and out[5.9].confidence == 0.0
    weak = pairs.withColumn("confidence", F.lit(0.1))
    cue = episodes.pair_cues(weak, imu, motion.strapdown(imu, ["seq"]), ["seq"], 100.0, 10.0).first()
    assert not cue.applied and cue.reason == "low_confidence" and cue.confidence == 0.1


def test_small_helpers():
    assert episodes.feature_names(["a", "b"], ["f"], ["g"]) == ["a.f", "b.f", "global.g"]
    assert episodes.trust_of([2.0, -1.0], ["a", "b"]) == {"a": 1.0, "b": 0.0}
    with pytest.raises(ValueError):
        episodes.trust_of({"c": 1.0}, ["a"])
    with pytest.raises(ValueError):
        episodes.feature_names(["b", "a"], [], [])


def test_rotations(spark):
    q = [0.18, -0.36, 0.54, 0.74]
    q = [v / sum(x * x for x in q) ** 0.5 for v in q]
    x, y, z, w = q
    m = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]
    one = spark.range(1)
    turned = one.select(*geometry.rotate([F.lit(v) for v in q], [F.lit(1.0), F.lit(2.0), F.lit(3.0)])).first()
    assert np.allclose(turned, np.array(m).reshape(3, 3) @ [1, 2, 3])
    problem = one.select(gates.rotation_problem([F.lit(v) for v in m]).alias("ok"), gates.rotation_problem([F.lit(2 * v) for v in m]).alias("big"), gates.rotation_problem([F.lit(float("nan"))] * 9).alias("nan")).first()
    assert problem.ok is None and problem.big == "determinant" and problem.nan == "not_finite"
    assert frames is not None
