import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import tracking
from trailmark.operators.sequences import previous


def rank(match_id, h, place, seed):
    p = tracking.PRIME
    return ((match_id % p * (tracking.FACTOR + 2 * place)) % p + ((h * 97 + place * 13 + seed) * tracking.SHIFT) % p) * tracking.STEP % p


def matches(rng, n, outliers, turn=0.2, scale=1.1, tx=7.0, ty=-3.0, noise=0.3):
    """id, x0, y0, x1, y1 of one pair of views, a share of them elsewhere."""
    out = []
    for i in range(n):
        x, y = rng.uniform(0, 300), rng.uniform(0, 200)
        u = scale * (math.cos(turn) * x - math.sin(turn) * y) + tx + rng.uniform(-noise, noise)
        v = scale * (math.sin(turn) * x + math.cos(turn) * y) + ty + rng.uniform(-noise, noise)
        if i < outliers * n:
            u, v = rng.uniform(0, 300), rng.uniform(0, 200)
        out.append((i * 7 + 3, x, y, u, v))
    rng.shuffle(out)
    return out


def plain_two_view(rows, rule):
    """The same draws by loops: inliers, a, b, tx, ty of the fit."""
    best = None
    for h in range(rule.samples):
        p, q = (min(rows, key=lambda r: (rank(r[0], h, k, rule.seed), r))[1:] for k in (0, 1))
        a0, a1 = complex(p[0], p[1]), complex(q[0], q[1])
        if a0 == a1:
            continue
        turn = (complex(q[2], q[3]) - complex(p[2], p[3])) / (a1 - a0)
        shift = complex(p[2], p[3]) - turn * a0
        inside = [r for r in rows if abs(turn * complex(r[1], r[2]) + shift - complex(r[3], r[4])) <= rule.threshold]
        if best is None or len(inside) > len(best):
            best = inside
    z, w = np.array([complex(r[1], r[2]) for r in best]), np.array([complex(r[3], r[4]) for r in best])
    turn = ((z - z.mean()).conj() * (w - w.mean())).sum() / (abs(z - z.mean()) ** 2).sum()
    shift = w.mean() - turn * z.mean()
    return len(best), turn.real, turn.imag, shift.real, shift.imag


def test_two_views_equal_loops_and_recover_the_motion(spark):
    rng, rows = random.Random(4), {k: None for k in range(12)}
    for k in rows:
        rows[k] = matches(rng, 20 + 10 * k, 0.4, turn=0.1 * k - 0.5, scale=0.8 + 0.05 * k, tx=k, ty=-2.0 * k)
    df = spark.createDataFrame([(k, *r) for k, v in rows.items() for r in v], "k int, id long, x0 double, y0 double, x1 double, y1 double").repartition(5)
    rule = tracking.Consensus()
    for r in tracking.two_view(df, ["k"], "id", rule).collect():
        n, a, b, tx, ty = plain_two_view(rows[r.k], rule)
        assert (r.matches, r.inliers) == (len(rows[r.k]), n) and r.inlier_ratio == pytest.approx(n / r.matches)
        assert (r.scale, r.yaw, r.tx, r.ty) == pytest.approx((math.hypot(a, b), math.atan2(b, a), tx, ty), abs=1e-6)
        assert r.inlier_ratio >= 0.55
        assert (r.scale, r.yaw) == pytest.approx((0.8 + 0.05 * r.k, 0.1 * r.k - 0.5), abs=0.02) and (r.tx, r.ty) == pytest.approx((r.k, -2.0 * r.k), abs=3.0)


@pytest.mark.parametrize(("samples", "seed"), [(1, 0), (5, -3), (64, 0), (130, 9)])
def test_draws_are_the_matches_of_least_rank(spark, samples, seed):
    """One match, two, many; negative ids, ids that lie on one place of the circle, repeated ids."""
    rng, p = random.Random(samples), tracking.PRIME
    ids = {0: [5], 1: [-1, 2**62], 2: [3, 3 + p, 3 - p, 3 + 2 * p], 3: [7, 7, 7, 8], 4: [rng.randrange(-(2**63), 2**63) for _ in range(50)], None: list(range(700))}
    rows = [(k, i, rng.random(), rng.random(), rng.random(), rng.random()) for k, v in ids.items() for i in v]
    df = spark.createDataFrame(rows, "place int, id long, x0 double, y0 double, x1 double, y1 double").repartition(3)
    rule = tracking.Consensus(samples=samples, seed=seed)
    got = {(r["place"], r.h): r for r in tracking.draw_samples(df, ["place"], "id", 3, rule).collect()}
    assert set(got) == {(k, h) for k in ids for h in range(samples)}
    for (k, h), r in got.items():
        for place in range(3):
            assert tuple(r[f"s{place}"]) == min((x[1:] for x in rows if x[0] == k), key=lambda x: (rank(x[0], h, place, seed), x))


def most_memory(spark, df):
    """MB of memory of the task that took most."""
    context, group = spark.sparkContext, f"memory {random.random()}"
    context.setJobGroup(group, "")
    df.write.format("noop").mode("overwrite").save()
    context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    store, tracker, most = context._jsc.sc().statusStore(), context.statusTracker(), 0
    for stage in {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}:
        tasks = store.taskList(stage, 0, 1000)
        most = max([most, *[tasks.apply(i).taskMetrics().get().peakExecutionMemory() for i in range(tasks.size())]])
    return most / 1e6


def test_draws_do_not_repeat_matches(spark):
    """60,000 matches of 900 keys in one task: 64 rows of each would be sorted at once."""
    x = [(F.col("id") * p % 1009).cast("double").alias(c) for c, p in zip(tracking.POINTS, (17, 29, 41, 53), strict=True)]
    df = spark.range(0, 60_000, 1, 1).select((F.col("id") % 900).alias("k"), "id", *x)
    assert 0 < most_memory(spark, tracking.draw_samples(df, ["k"], "id", 2, tracking.Consensus())) < 250


def test_views_with_too_little_to_go_by(spark):
    """Few matches, one place only, nulls, no rows, repeated rows, null keys."""
    rows = [("few", i, 1.0 * i, 2.0, 3.0, 4.0) for i in range(7)] + [("one place", i, 5.0, 5.0, 8.0 + i, 1.0) for i in range(9)]
    rows += [("null", None, 1.0, 1.0, 1.0, 1.0), ("null", 1, None, 1.0, 1.0, 1.0)] + [(None, i % 9, 1.0 * (i % 9), 2.0 * (i % 9) ** 2, 1.0 * (i % 9) + 4, 2.0 * (i % 9) ** 2 + 1) for i in range(18)]
    df = spark.createDataFrame(rows, "k string, id long, x0 double, y0 double, x1 double, y1 double")
    got = {r.k: r for r in tracking.two_view(df, ["k"], "id").collect()}
    assert (got["few"].matches, got["few"].inliers, got["few"].tx, got["few"].yaw) == (7, 0, 0.0, 0.0)
    assert (got["one place"].inliers, got["one place"].tx, got["one place"].ty, got["one place"].scale) == (0, 7.0, -4.0, 0.0)
    assert "null" not in got
    assert tracking.two_view(df.limit(0), ["k"], "id").collect() == []
    homographies = {r.k: r for r in tracking.robust_homography(df, ["k"], "id").collect()}
    assert homographies["one place"].h0 is None and homographies["one place"].inliers == 0 and "null" not in homographies


TRUE = np.array([[1.1, 0.05, 12.0], [-0.03, 0.95, -7.0], [2e-4, -1e-4, 1.0]])


def seen_through(h, x, y):
    u, v, w = (h @ [x, y, 1.0]).tolist()
    return u / w, v / w


def plain_homography(rows, rule):
    best = None
    for h in range(rule.samples):
        points = [min(rows, key=lambda r: (rank(r[0], h, k, rule.seed), r))[1:] for k in range(4)]
        lines = [line for x, y, u, v in points for line in ([x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v])]
        _, d, vt = np.linalg.svd(np.array(lines))
        if d[7] <= 1e-9 * d[0]:
            continue
        m = vt[8].reshape(3, 3)
        inside = [r for r in rows if math.dist(seen_through(m, r[1], r[2]), r[3:]) <= rule.threshold]
        if best is None or len(inside) > len(best):
            best = inside
    return best


def test_homographies_equal_loops_and_recover_the_map(spark):
    rng, rule, rows = random.Random(8), tracking.Consensus(samples=128, threshold=5.0, least=4), {}
    for k in range(6):
        rows[k] = []
        for i in range(15 + 12 * k):
            x, y = rng.uniform(0, 400), rng.uniform(0, 300)
            u, v = seen_through(TRUE, x, y) if i >= 0.4 * (15 + 12 * k) else (rng.uniform(0, 400), rng.uniform(0, 300))
            rows[k].append((i * 5 + 1, x, y, u + rng.uniform(-0.2, 0.2), v + rng.uniform(-0.2, 0.2)))
    df = spark.createDataFrame([(k, *r) for k, v in rows.items() for r in v], "k int, id long, x0 double, y0 double, x1 double, y1 double").repartition(4)
    for r in tracking.robust_homography(df, ["k"], "id", rule).collect():
        assert (r.matches, r.inliers) == (len(rows[r.k]), len(plain_homography(rows[r.k], rule))) and r.inliers >= r.matches - math.ceil(0.4 * r.matches)
        made = np.array([r[h] for h in tracking.H]).reshape(3, 3)
        for x, y in ((0, 0), (400, 0), (200, 150), (400, 300)):
            assert seen_through(made, x, y) == pytest.approx(seen_through(TRUE, x, y), abs=2.0)


def test_direct_transform_by_svd(spark):
    """The null vector of summed normal equations is that of the stacked equations; fewer than four matches give nulls."""
    rng, rows = random.Random(1), []
    for k, n in enumerate((3, 4, 5, 40)):
        for _ in range(n):
            x, y = rng.uniform(0, 1000), rng.uniform(0, 1000)
            rows.append((k, x, y, *(c + rng.uniform(-1, 1) * (k == 3) for c in seen_through(TRUE, x, y))))
    got = {r.k: r for r in tracking.direct_transform(spark.createDataFrame(rows, "k int, x0 double, y0 double, x1 double, y1 double"), ["k"]).collect()}
    assert got[0].h0 is None and got[0].n == 3
    for k in (1, 2):
        assert [got[k][h] for h in tracking.H] == pytest.approx(TRUE.ravel().tolist(), abs=1e-5)
    p = np.array([r[1:] for r in rows if r[0] == 3])

    def centred(points):
        c, s = points.mean(0), math.sqrt(2 / points.var(0).sum())
        return (points - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    (a, t0), (b, t1) = centred(p[:, :2]), centred(p[:, 2:])
    lines = [line for (x, y), (u, v) in zip(a, b, strict=True) for line in ([x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v])]
    want = np.linalg.inv(t1) @ np.linalg.svd(np.array(lines))[2][8].reshape(3, 3) @ t0
    assert [got[3][h] for h in tracking.H] == pytest.approx((want / want[2, 2]).ravel().tolist(), rel=1e-6, abs=1e-9)


def plain_texture(before, now):
    edges = [sum(np.abs(np.diff(f, axis=a)).sum() for a in (0, 1)) for f in (before, now)]
    n = int(np.clip(min(edges) / (before.size * 255.0) * 350.0, 0, 120))

    def centre(f):
        ys, xs = np.indices(f.shape)
        return np.array([(xs * f).sum(), (ys * f).sum()]) / f.sum() if f.sum() > 1e-9 else np.zeros(2)

    inliers = max(int(n * 0.75), 1) if n else 0
    return (n, inliers, *((centre(now) - centre(before)) if n else (0.0, 0.0)))


@pytest.mark.parametrize("bucket", [None, 3, 1000])
def test_texture_pairs_equal_numpy(spark, bucket):
    """Frames with and without texture, black ones, null ones, and gaps between buckets."""
    rng = np.random.default_rng(2)
    shapes = [rng.integers(0, 256, (6, 5)).astype(float), rng.integers(0, 3, (6, 5)).astype(float), np.full((6, 5), 9.0), np.zeros((6, 5)), np.tile([0.0, 255.0, 0, 255, 0], (6, 1))]
    frames = {(k, i * 2 + 20 * (i > 4)): shapes[int(rng.integers(0, 5))] for k in range(3) for i in range(9)}
    frames[0, 100] = None
    df = spark.createDataFrame([(k, i, None if f is None else f.ravel().tolist()) for (k, i), f in frames.items()], "k int, i long, pixels array<double>").repartition(4)
    got = {(r.k, r.i): r for r in tracking.texture_pairs(df, ["k"], "i", 5, bucket=bucket).collect()}
    order = {k: sorted(i for j, i in frames if j == k) for k in range(3)}
    assert set(got) == {(k, i) for k, v in order.items() for i in v[1:]}
    for (k, i), r in got.items():
        before = order[k][order[k].index(i) - 1]
        assert r.prev_i == before
        a, b = frames[k, before], frames[k, i]
        want = plain_texture(a, b) if a is not None and b is not None else (0, 0, 0.0, 0.0)
        assert (r.matches, r.inliers, r.dx, r.dy) == pytest.approx(want, abs=1e-9)
        assert r.inlier_ratio == pytest.approx(want[1] / want[0] if want[0] else 0.0) and r.yaw == 0.0


def test_previous_row_over_buckets(spark):
    """Gaps, null keys and a lone row; the same with and without buckets."""
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 3, float(i * i), i) for i in range(40)] + [(9, 1.0, 99)], "k int, t double, v int").repartition(3)
    one = {r.v: r.p for r in previous(df, ["k"], "t", ["v"]).select("v", F.col("prev.v").alias("p")).collect()}
    for bucket in (0.5, 50.0, 1e9):
        assert {r.v: r.p for r in previous(df, ["k"], "t", ["v"], bucket).select("v", F.col("prev.v").alias("p")).collect()} == one
    assert one[99] is None and one[30] == 27
