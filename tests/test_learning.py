from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailmark.functions import frames
from trailmark.operators import fusion, motion, plugins, policy, sampling


def test_patches_are_area_means(spark):
    """A frame four times as large is the mean of its blocks; patches have mean 0 and deviation 1; flat ones are 0."""
    rng = np.random.default_rng(1)
    small = rng.integers(0, 256, (32, 32)).astype(float)
    large = np.kron(small, np.ones((4, 4)))
    assert frames.overlap_weights(128, 32) @ large @ frames.overlap_weights(128, 32).T == pytest.approx(small)
    assert frames.overlap_weights(7, 5).sum(axis=1) == pytest.approx(np.ones(5)) and frames.overlap_weights(5, 7).sum(axis=1) == pytest.approx(np.ones(7))
    rows = [(0, small.ravel().tolist(), 32, 32), (1, large.ravel().tolist(), 128, 128), (2, [5.0] * 64, 8, 8), (3, None, 8, 8), (4, [], 0, 0), (5, (small / 255).ravel().tolist(), 32, 32)]
    df = spark.createDataFrame(rows, "i int, p array<double>, h int, w int")
    got = {r.i: r.x for r in df.select("i", frames.frame_patches()("p", "h", "w").alias("x")).collect()}
    assert np.array(got[0]).shape == (16, 64) and np.array(got[1]) == pytest.approx(np.array(got[0])) and np.array(got[5]) == pytest.approx(np.array(got[0]))
    tile = small[8:16, 16:24].ravel() / 255
    assert got[0][6] == pytest.approx(((tile - tile.mean()) / (tile.std() + 1e-6)).tolist())
    assert np.abs(got[2]).max() == 0 and got[3] is None and got[4] is None
    with pytest.raises(Exception, match="expected 9 x 8"):
        spark.createDataFrame([([1.0] * 64,)], "p array<double>").select(frames.frame_patches()("p", F.lit(9), F.lit(8))).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_each_row_once_an_epoch(spark, n):
    rows = spark.range(n).select(F.col("id").alias("rank"))
    got = sampling.minibatches(rows, n, 7, 3, seed=n).collect()
    batches = {}
    for e in range(3):
        mine = [r for r in got if r.epoch == e]
        assert sorted(r["rank"] for r in mine) == list(range(n)) and sorted(r.place for r in mine) == list(range(n))
        sizes = Counter(r.batch for r in mine)
        assert all(sizes[b] == min(7, n - 7 * b) for b in sizes)
        batches[e] = tuple(r["rank"] for r in sorted(mine, key=lambda r: r.place))
    if n > 50:
        assert len(set(batches.values())) == 3
        for order in batches.values():  # neighbours are parted, and no place is favoured
            assert abs(np.corrcoef(order, range(n))[0, 1]) < 0.25 and sum(abs(a - b) == 1 for a, b in zip(order, order[1:], strict=False)) < 0.1 * n
    again = sampling.minibatches(rows.repartition(5), n, 7, 3, seed=n)
    assert {(r["rank"], r.epoch, r.batch) for r in again.collect()} == {(r["rank"], r.epoch, r.batch) for r in got}


def test_ranks_need_no_global_sort(spark):
    df = spark.createDataFrame([(float(i * i % 1009),) for i in range(504)], "v double").distinct().repartition(6)
    got = {r.v: r["rank"] for r in sampling.ranked(df, "v", 50.0).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))}


def test_draws_with_replacement(spark):
    rows = spark.range(50).select(F.col("id").alias("rank"))
    got = sampling.draws(rows, 50, 20, 300, seed=1).collect()
    each, total = Counter(), Counter()
    for r in got:
        each[r.batch] += r.times
        total[r["rank"]] += r.times
    assert set(each.values()) == {20} and len(each) == 300 and len(total) == 50
    assert 70 <= min(total.values()) and max(total.values()) <= 175  # 120 on average
    assert max(r.times for r in got) >= 2


IMU = "seq int, t double, ax double, ay double, az double, gx double, gy double, gz double, note string"


@pytest.fixture(scope="module")
def imu(spark):
    rng = np.random.default_rng(4)
    rows = [(s, i * 0.1, *map(float, rng.normal(0, 0.2, 2)), 9.81, *map(float, rng.normal(0, 0.2, 3)), f"n{i}") for s in (1, 2) for i in range(300)]
    return spark.createDataFrame(rows, IMU).repartition(4)


def test_estimators_from_sql(spark, imu, monkeypatch):
    """Both estimators equal the library's, in one block and in many; other columns stay."""
    plugins.install(spark)
    call = "SELECT * FROM estimate(method => '{}', samples => TABLE({{df}}) PARTITION BY seq ORDER BY t)"
    for method, want, columns in (("gyro", motion.gyro_orientation(imu, ["seq"]), ["qx", "qy", "qz", "qw"]), ("imu_only", motion.strapdown(imu, ["seq"]), [*motion.POSE, "health"])):
        rows = {(r.seq, r.t): r for r in spark.sql(call.format(method), df=imu).collect()}
        assert len(rows) == 600 and {r.method for r in rows.values()} == {method} and rows[1, 0.0].note == "n0"
        for r in want.collect():
            made = rows[r.seq, r.t]
            assert [made[c] for c in columns if c != "health"] == pytest.approx([r[c] for c in columns if c != "health"], abs=1e-8)
            assert "health" not in columns or made.health == r.health
    pieces = pd.DataFrame([r.asDict() for r in imu.where("seq = 1").orderBy("t").collect()])
    for step in (plugins.gyro_step, plugins.imu_only_step):
        whole, parts, state = step(None, pieces)[1], [], None
        for i in range(0, 300, 37):
            state, out = step(state, pieces[i : i + 37].reset_index(drop=True))
            parts.append(out)
        assert pd.concat(parts).reset_index(drop=True).drop(columns="health", errors="ignore").to_numpy() == pytest.approx(whole.drop(columns="health", errors="ignore").to_numpy(), abs=1e-9)


def test_estimators_are_checked_before_they_run(spark, imu):
    plugins.install(spark)
    for sql, said in (
        ("SELECT * FROM estimate(method => 'nothing', samples => TABLE({df}) PARTITION BY seq ORDER BY t)", "method must be one of"),
        ("SELECT * FROM estimate(method => 'imu_only', samples => TABLE(SELECT seq, t, gx, gy, gz FROM {df}) PARTITION BY seq ORDER BY t)", "lacks \\['ax', 'ay', 'az'\\]"),
        ("SELECT * FROM estimate(method => 'gyro', samples => 5)", "table argument"),
    ):
        with pytest.raises(Exception, match=said):
            spark.sql(sql, df=imu).schema
    with pytest.raises(ValueError, match="another estimator"):
        plugins.register("gyro", plugins.Backend(("t",), ("x",), plugins.gyro_step))
    liar = plugins.Estimate()
    liar.method, liar.backend, liar.rows = "liar", plugins.Backend(("t",), ("x",), lambda s, rows: (s, rows[["t"]])), [SimpleNamespace(asDict=lambda: {"t": 1.0})]
    with pytest.raises(ValueError, match="made"):
        list(liar.terminate())


def small_policy(methods=("a", "b"), period=0.5, **more):
    size, rng = len(methods) * 8 + 4 + 3 * more.get("signals", False), np.random.default_rng(9)
    layers = ((rng.normal(0, 0.5, (6, size)), rng.normal(0, 0.1, 6)), (rng.normal(0, 1.0, (len(methods), 6)), np.zeros(len(methods))))
    return policy.Policy(methods, layers, rng.normal(0, 0.1, size), rng.uniform(0.5, 1.5, size), period=period, **more)


def plain_run(imu, offers, p, config, signals=None):
    """The closed loop, one window after the other; trusts by step, and updates."""
    t = [r[0] for r in imu]
    bounds, start = [], 0
    while start <= len(t) - 2:
        end = start
        while end < len(t) - 2 and t[end + 1] < t[start] + p.period:
            end += 1
        bounds.append((start, end))
        start = end + 1
    f, due = fusion._Filter(config, t[0]), sorted(offers, key=lambda m: (m.t, m.method))
    trusts, accepted, logs, updates = p.trusts(p.first_observation()), dict.fromkeys(p.methods, t[0]), [], []
    for k, (first, last) in enumerate(bounds):
        seen = {m: [] for m in p.methods}
        for i in range(first, last + 1):
            f.predict(np.array(imu[i][1:]), max(t[i + 1] - f.now, 1e-6))
            f.now = t[i + 1]
            while due and due[0].t <= t[i + 1]:
                m = due.pop(0)
                d2 = policy._plain_d2(f, m)
                v = f.offer(m, trusts[p.methods.index(m.method)], p.least_trust)
                seen[m.method].append((m, v, d2))
                if v[0]:
                    accepted[m.method] = m.t
                updates.append((round(m.t, 6), m.method, v[0], v[1], round(trusts[p.methods.index(m.method)], 9)))
        end = t[last + 1]
        logs += [(round(end, 6), m, round(x, 9)) for m, x in zip(p.methods, trusts, strict=True)]
        obs = []
        for m in p.methods:
            s = seen[m]
            compared = [(v[2], d) for _, v, d in s if v[2] is not None]
            mean = lambda x: sum(x) / len(x) if x else 0.0
            obs += [float(bool(s)), mean([x.confidence for x, *_ in s]), mean([x.health == "DEGRADED" for x, *_ in s]), mean([x.health in ("LOST", "INVALID") for x, *_ in s]), np.tanh(mean([c[0] for c in compared]) / 5.0), np.tanh(np.log1p(mean([c[1] for c in compared])) / 4), min((end - accepted[m]) / 5.0, 1.0), mean([v[0] for _, v, _ in s])]
        obs += [np.tanh(np.log1p(np.sqrt(np.trace(f.cov[:3, :3]) / 3)) / 2), np.tanh(np.linalg.norm(f.v) / 20), (k + 1) / len(bounds), trusts.mean()]
        if p.signals:
            obs += [float(np.tanh(x)) for x in signals(end)]
        trusts = p.trusts(np.array(obs))
    return logs, updates


def offers_of(seed, n=60):
    rng = np.random.default_rng(seed)
    return [SimpleNamespace(t=round(float(rng.uniform(0.0, 29.8)), 3), method="ab"[int(rng.integers(2))], x=float(rng.normal(0, 1)), y=0.0, z=0.0, confidence=float(rng.uniform(0, 1)), health=("OK", "DEGRADED", "LOST")[int(rng.integers(3))]) for _ in range(n)]


@pytest.mark.parametrize("signals", [False, True])
def test_policy_runs_equal_a_plain_loop(spark, imu, signals):
    config = fusion.FilterConfig(max_age=0.5)
    p = small_policy(signals=signals)
    all_offers = {1: offers_of(1), 2: offers_of(2)}
    offers = spark.createDataFrame([(s, m.t, m.method, m.x, m.y, m.z, m.confidence, m.health) for s, v in all_offers.items() for m in v], "seq int, t double, method string, x double, y double, z double, confidence double, health string")
    samples = imu.withColumns({c: F.sin(F.col("t") * (i + 1)) for i, c in enumerate(policy.OF_SIGNALS)}) if signals else imu
    got = policy.policy_fusion(samples, offers, ["seq"], p, config).collect()
    for s in (1, 2):
        rows = sorted((r.t, r.ax, r.ay, r.az, r.gx, r.gy, r.gz) for r in imu.where(F.col("seq") == s).collect())
        logs, updates = plain_run(rows, all_offers[s], p, config, lambda t: [np.sin(t * (i + 1)) for i in range(3)])
        mine = [r for r in got if r.seq == s]
        assert sorted((round(r.t, 6), r.method, round(r.trust, 9)) for r in mine if r.kind == "trust") == sorted(logs)
        assert sorted((round(r.t, 6), r.method, r.accepted, str(r.reason), round(r.trust, 9)) for r in mine if r.kind == "update") == sorted((t, m, a, str(w), x) for t, m, a, w, x in updates)
        assert sum(r.kind == "step" for r in mine) == 300
        assert len({x for *_, x in logs}) > 20  # the loop is closed: trusts change from step to step
    assert policy.policy_fusion(samples.limit(0), offers, ["seq"], p, config).collect() == []


def test_policies_of_another_layout_are_refused(spark, imu):
    offers = spark.createDataFrame([(1, 1.0, "c", 0.0, 0.0, 0.0, 0.9, "OK")], "seq int, t double, method string, x double, y double, z double, confidence double, health string")
    with pytest.raises(Exception, match="none of the policy's"):
        policy.policy_fusion(imu, offers, ["seq"], small_policy()).collect()
    with pytest.raises(ValueError, match="samples lack"):
        policy.policy_fusion(imu, offers, ["seq"], small_policy(signals=True))
    good = small_policy()
    for change in ({"methods": ("a", "b", "c")}, {"mean": good.mean[:-1]}, {"layers": good.layers[:1]}, {"layers": good.layers[::-1]}, {"period": 0.0}, {"methods": ("b", "a")}):
        with pytest.raises(ValueError):
            policy.Policy(**{**good.__dict__, **change})


def test_policies_are_read_from_tables(spark):
    p = small_policy()
    rows = [("mean", 0, i, 0, float(v)) for i, v in enumerate(p.mean)] + [("var", 0, i, 0, float(v)) for i, v in enumerate(p.var)]
    for k, (w, b) in enumerate(p.layers):
        rows += [("weight", k, i, j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])] + [("bias", k, i, 0, float(v)) for i, v in enumerate(b)]
    df = spark.createDataFrame(rows, "part string, layer int, row int, column int, value double")
    read = policy.read_policy(df, ["a", "b"], period=0.5)
    x = np.random.default_rng(1).normal(size=20)
    assert read.trusts(x).tolist() == p.trusts(x).tolist() and read.features[0] == "a.available" and read.features[-1] == "global.prev_mean_trust"
    with pytest.raises(ValueError, match="gaps"):
        policy.read_policy(df.where("not (part = 'weight' and row = 1 and column = 3)"), ["a", "b"])
