import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import motion, scan


def parts_of(df):
    """Tasks that have rows of a frame."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(6)
    rows = [(k, float(i), rng.uniform(-1, 1), rng.uniform(-2, 2), rng.random() < 0.1) for k in (1, 2, None) for i in range(1 if k == 2 else 400)]
    return rows, spark.createDataFrame(rows, "k int, t double, reward double, value double, done boolean").repartition(5)


@pytest.mark.parametrize("bucket", [None, 7.0, 100.0, 1e6])
def test_discounted_scan_equals_a_loop(walk, bucket):
    rows, df = walk
    got = {(r.k, r.t): r.advantage for r in motion.discounted_scan(df, ["k"], ["t"], bucket=bucket).collect()}
    assert len(got) == len(rows)
    for k in (1, 2, None):
        ahead = after = 0.0
        for _, t, reward, value, done in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]):
            if done:
                ahead = after = 0.0
            ahead = reward + 0.99 * after - value + 0.99 * 0.95 * ahead
            after = value
            assert got[k, t] == pytest.approx(ahead, abs=1e-9)


@pytest.mark.parametrize("bucket", [None, 9.0, 1e6])
def test_hysteresis_equals_a_loop(spark, bucket):
    """Ties, nulls and margins."""
    rng = random.Random(2)
    rows = [(k, i, *(rng.choice((None, 0.0, 0.1, 0.2, 0.35, 0.5)) for _ in range(3))) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, day long, b double, a double, c double").repartition(3)
    got = {(r.k, r.day): r.winner for r in motion.hysteresis_winner(df, ["k"], ["b", "a", "c"], ["day"], bucket=bucket).collect()}
    for k in range(3):
        state = None
        for _, day, b, a, c in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            scores = {n: -math.inf if v is None else v for n, v in (("a", a), ("b", b), ("c", c))}
            best = max(sorted(scores), key=lambda n: scores[n])
            if state is None or scores[best] > scores[state] + 0.1:
                state = best
            assert got[k, day] == state


def imu_rows(n, seed=4):
    rng = random.Random(seed)
    out, t = [], 0.0
    for _ in range(n):
        out.append((t, *(rng.gauss(0, 0.5) for _ in range(2)), 9.81 + rng.gauss(0, 0.5), *(rng.gauss(0, 0.3) for _ in range(3))))
        t += rng.choice((0.01, 0.02, 0.0))
    return out


def plain_strapdown(rows):
    """One step after the other."""
    out, state = [], None
    for t, *s in rows:
        if state is None:
            p, v, q, worst, start = np.zeros(3), np.zeros(3), np.array([0.0, 0, 0, 1]), 0, t
        else:
            p, v, q, last, before, worst = state
            dt = t - last if t > last else 1e-6
            a = motion.matrix(q) @ before[:3] - (0, 0, 9.81)
            p, v, q = p + v * dt + 0.5 * a * dt * dt, v + a * dt, motion.quat_mul(q, motion.rotvec(before[3:] * dt))
            far = np.linalg.norm(p)
            worst = max(worst, 2 if t - start > 10 or far > 100 else 1 if t - start > 5 or far > 50 else 0)
        out.append((t, [*p, *v, *q], ("OK", "DEGRADED", "LOST")[worst]))
        state = (p, v, q, t, np.array(s), worst)
    return out


@pytest.mark.parametrize("bucket", [None, 0.5, 3.0])
def test_strapdown_equals_steps(spark, bucket):
    rows = sorted({r[0]: r for r in imu_rows(1500)}.values())
    df = spark.createDataFrame([("a", *r) for r in rows] + [(None, *r) for r in rows[:700]], "k string, t double, ax double, ay double, az double, gx double, gy double, gz double").repartition(4)
    got = {(r.k, r.t): r for r in motion.strapdown(df, ["k"], bucket=bucket).collect()}
    assert len(got) == len(rows) + 700
    for k, some in (("a", rows), (None, rows[:700])):
        for t, pose, health in plain_strapdown(some):
            r = got[k, t]
            assert [r[c] for c in motion.POSE] == pytest.approx(pose, abs=1e-7) and r.health == health


def test_one_sequence_is_many_tasks(spark):
    """With a bucket one key's rows come out of many tasks, the same as without."""
    df = spark.createDataFrame([(1, *r) for r in sorted({r[0]: r for r in imu_rows(3000)}.values())], "k int, t double, ax double, ay double, az double, gx double, gy double, gz double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        whole, parted = (motion.gyro_orientation(df, ["k"], bucket=b) for b in (None, 2.0))
        assert parts_of(whole) == 1 and parts_of(parted) >= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert np.array(sorted(map(tuple, whole.collect()))) == pytest.approx(np.array(sorted(map(tuple, parted.collect()))), abs=1e-9)


def test_operations_are_associative():
    rng = np.random.default_rng(3)
    q = rng.normal(size=(3, 50, 4))
    q /= np.linalg.norm(q, axis=2, keepdims=True)
    motions = np.concatenate([q, rng.normal(size=(3, 50, 6)), rng.random((3, 50, 1))], axis=2)
    for combine, (a, b, c) in ((scan.turns, q), (scan.motions, motions), (scan.affine, rng.normal(size=(3, 50, 2))), (scan.paths, rng.integers(0, 4, (3, 50, 4)).astype(float))):
        assert combine(combine(a, b), c) == pytest.approx(combine(a, combine(b, c)), abs=1e-9)
        whole = scan.running(a, combine)
        step = a[:1]
        for i in range(1, len(a)):
            step = combine(step, a[i : i + 1])
            assert whole[i] == pytest.approx(step[0], abs=1e-8)


def test_batches_and_neighbours_change_nothing():
    """Sequences of many lengths, cut anywhere, give the same bits as each alone."""
    rng = np.random.default_rng(7)
    sequences = [rng.normal(size=(n, 2)) for n in (1, 31, 32, 33, 2, 400, 64, 5)]
    alone = [scan.Runner([1.0, 0.0], scan.affine).feed(x, np.arange(len(x)) == 0) for x in sequences]
    every, starts = np.concatenate(sequences), np.concatenate([np.arange(len(x)) == 0 for x in sequences])
    for size in (1, 7, 64, 1000):
        runner = scan.Runner([1.0, 0.0], scan.affine)
        parts = [runner.feed(every[i : i + size], starts[i : i + size]) for i in range(0, len(every), size)]
        assert np.array_equal(np.concatenate(parts), np.concatenate(alone))
    for x, found in zip(sequences, alone, strict=True):
        assert found == pytest.approx(scan.running(x, scan.affine), abs=1e-9)


def test_no_rows(spark, walk):
    for bucket in (None, 5.0):
        assert motion.discounted_scan(walk[1].limit(0), ["k"], ["t"], bucket=bucket).collect() == []
