import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import evaluate, fusion, motion
from trailmark.plans import catalogue, evaluation, fusion as fusion_plans, motion as motion_plans  # noqa: F401

SF = "/root/testdata/sf0.001"


def imu(spark, n=101, dt=0.01):
    return spark.range(n).select(F.lit("a").alias("seq"), (F.col("id") * dt).alias("t"), *[F.lit(v).alias(k) for k, v in (("ax", 0.0), ("ay", 0.0), ("az", 9.81), ("gx", 0.0), ("gy", 0.0), ("gz", 0.0))])


def test_strapdown_at_rest_and_latched_health(spark):
    rows = motion.strapdown(imu(spark, 1301), ["seq"]).orderBy("t").collect()
    assert max(abs(v) for r in rows for v in (r.x, r.y, r.z, r.vx, r.vy, r.vz)) < 1e-9
    assert (rows[0].health, rows[700].health, rows[1300].health) == ("OK", "DEGRADED", "LOST")


def test_strapdown_turns(spark):
    turning = imu(spark, 101).withColumn("gz", F.lit(np.pi / 2)).withColumn("ax", F.lit(0.0))
    last = motion.strapdown(turning, ["seq"]).orderBy(F.desc("t")).first()
    assert (last.qz, last.qw) == pytest.approx((np.sqrt(0.5), np.sqrt(0.5)))


def test_filter_follows_measurements_and_names_the_first_gate(spark):
    given = [("a", 0.1 * i, "rgb", 0.0, 0.0, 0.0, 0.9, "OK") for i in range(1, 9)]
    given += [("a", 0.5, "bad", 100.0, 0.0, 0.0, 0.9, "OK"), ("a", 0.55, "lost", 0.0, 0.0, 0.0, 0.9, "LOST"), ("a", 0.6, "weak", 0.0, 0.0, 0.0, 0.1, "OK"), ("a", 5.0, "after", 0.0, 0.0, 0.0, 0.9, "OK")]
    m = spark.createDataFrame(given, "seq string, t double, method string, x double, y double, z double, confidence double, health string")
    out = fusion.filter_fusion(imu(spark), m, ["seq"]).cache()
    reasons = {r.method: r.reason for r in out.where("kind = 'update'").collect()}
    assert reasons == {"rgb": None, "bad": "motion_sanity_gate", "lost": "health_gate", "weak": "confidence_gate"}
    steps = out.where("kind = 'step'").orderBy("t").collect()
    assert len(steps) == 101 and abs(steps[-1].x) < 1e-6
    assert fusion.filter_fusion(imu(spark), m.withColumn("trust", F.lit(0.0)), ["seq"]).where("accepted").count() == 0
    trusted = fusion.filter_fusion(imu(spark), m.withColumn("trust", F.lit(1.0)), ["seq"])
    assert sorted(map(str, trusted.collect())) == sorted(map(str, out.collect()))
    assert fusion.step_weights(out.where("kind = 'update'"), ["seq"]).where("abs(weight - 1) > 1e-12").count() == 0


def test_alignment_recovers_a_turn(spark):
    points = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 1)]
    rows = [("a", float(x), float(y), float(z), float(-y + 1), float(x + 2), float(z + 3)) for x, y, z in points] + [("line", float(i), 0.0, 0.0, float(i), 0.0, 0.0) for i in range(3)]
    m = spark.createDataFrame(rows, "seq string, x double, y double, z double, ref_x double, ref_y double, ref_z double")
    found = evaluate.align(m, ["seq"])
    by = {r.seq: r for r in found.collect()}
    assert (by["a"].tx, by["a"].ty, by["a"].tz) == pytest.approx((1, 2, 3)) and by["line"].r is None
    moved = evaluate.apply_alignment(m, found, ["seq"]).where("seq = 'a'")
    assert moved.where("abs(x - ref_x) + abs(y - ref_y) + abs(z - ref_z) > 1e-9").count() == 0


def test_gyro_keeps_the_clock_and_batches_do_not_matter(spark):
    turning = imu(spark, 50).withColumn("gz", F.lit(0.3))
    whole = sorted(map(tuple, motion.gyro_orientation(turning, ["seq"]).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, motion.gyro_orientation(turning, ["seq"]).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert whole[0][2:] == (0.0, 0.0, 0.0, 1.0) and whole[-1][4] == pytest.approx(np.sin(0.3 * 0.49 / 2))


@pytest.mark.parametrize("name", ["j06_resample", "w04_control_windows", "w10_hysteresis", "a16_drift_bins", "a25_blend", "a36_gae", "f13_gate_reason", "k12_trust_log"])
def test_queries_equal_their_sql(spark, name):
    import os

    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f[:-8]} AS FROM '{SF}/{f}'")
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    wanted = db.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, wanted))


def test_many_filters_at_once_equal_one_by_one(spark):
    """Every measurement meets its sequence's samples however the shuffle's partitions are merged (before, rows of both
    sides were dealt apart and no update was left), and each filter is what it is alone."""
    from trailmark.plans import catalogue
    from trailmark.plans import fusion as plans
    from trailmark.plans.motion import inertial

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        b = catalogue.base(spark, "/root/testdata/sf0.1")
        kinds = {r.kind: r["count"] for r in plans.fused(b).groupBy("kind").count().collect()}
        assert kinds == {"step": 100_000, "update": 100_000}
        small = catalogue.base(spark, "/root/testdata/sf0.001")
        found = plans.fused(small).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    nth = F.row_number().over(plans.ordered()).cast("double")
    given = small.select("seq", (nth - 0.1).alias("t"), "method", ((F.col("x") - 100) / 100).alias("x"), ((F.col("y") - 50) / 100).alias("y"), F.lit(0.0).alias("z"), "confidence", "health")
    rows = fusion.offered(inertial(small), given, ["seq"]).toPandas()
    step = fusion.stepper(["seq"], fusion.FilterConfig())
    for seq, own in rows.groupby("seq"):
        want = step(None, own.sort_values(["t", "tag", "method"], kind="stable").reset_index(drop=True))[1].sort_values(["kind", "t"])
        got = found[found["seq"] == seq].sort_values(["kind", "t"])
        for c in ("t", "step_t", "innovation", "d2", "sigma", "x", "y", "z", "qx", "qw", "confidence", "position_sigma"):
            assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-7, atol=1e-9, equal_nan=True), c
        for c in ("accepted", "reason", "health", "method"):
            assert [None if x is None or x != x else x for x in got[c]] == [None if x is None or x != x else x for x in want[c]], c
