import pytest
from pyspark.sql import functions as F

from trailmark.sources import readers, sinks
from trailmark.streaming import latest

ROWS = [("m", 0.0, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0, "OK"), ("m", 0.5, 1.5, 2.0, 3.0, 0.0, 0.0, 0.6, 0.8, "LOST"), ("m", 1.0, 2.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0, "DEGRADED")]
SCHEMA = "method string, t double, x double, y double, z double, qx double, qy double, qz double, qw double, health string"


def test_trajectory_round_trip_and_checks(spark, tmp_path):
    poses = spark.createDataFrame(ROWS, SCHEMA)
    sinks.write_trajectory(poses, f"{tmp_path}/csv")
    sinks.write_tum(poses, f"{tmp_path}/tum")
    back = readers.read_trajectory(spark, f"{tmp_path}/csv")
    assert sorted(map(tuple, back.select(*poses.columns).collect())) == sorted(ROWS)
    assert back.where("confidence = 1 and vx = 0 and latency_ms = 0").count() == 3
    tum = readers.read_tum(spark, f"{tmp_path}/tum")
    assert [r.t for r in tum.orderBy("t").collect()] == [0.0, 1.0]
    checks = sinks.check_run(back, tum, {"OK": 1, "DEGRADED": 1, "LOST": 1, "INVALID": 0})
    assert checks.where("not passed").count() == 0 and checks.count() == 6
    assert sinks.check_run(back, tum, {"OK": 2}).where("not passed").count() == 1


def test_aliases_defaults_and_bad_cells(spark, tmp_path):
    (tmp_path / "gt.csv").write_text("timestamp_s,x_m,y_m,z_m,yaw_deg,vx_mps\n0,1,2,3,90,\n1,1,2,3,0,4\n")
    rows = readers.read_ground_truth(spark, str(tmp_path / "gt.csv")).orderBy("t").collect()
    assert (round(rows[0].qz, 6), rows[0].vx, rows[1].vx, rows[0].health) == (0.707107, 0.0, 4.0, "OK")
    (tmp_path / "imu.csv").write_text("t,ax,ay,az,gx,gy,gz\n0,1,2,3,4,5,6\n1,nan,2,3,4,5,6\n2,x,2,3,4,5,6\n")
    soft = readers.read_imu(spark, str(tmp_path / "imu.csv"), strict=False)
    assert [r.problem for r in soft.orderBy("t").collect()] == [None, "ax: nan", "ax: x"]
    with pytest.raises(Exception, match="bad cell"):
        readers.read_imu(spark, str(tmp_path / "imu.csv")).collect()
    (tmp_path / "tum.txt").write_text("# a comment\n\n0 1 2 3 0 0 0 1\n1 2 3\n")
    assert [r.problem for r in readers.read_tum(spark, str(tmp_path / "tum.txt"), strict=False).orderBy("t").collect()] == [None, "line: 1 2 3"]


def test_unordered_streams(spark):
    rows = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 0.0), ("b", 0, 1.0), ("b", 1, 0.5)], "seq string, i int, t double")
    assert [r.seq for r in readers.unordered_streams(rows, ["seq"], "i").collect()] == ["b"]


def test_notes(spark):
    runs = spark.createDataFrame([("a", "OK", 0.0, 1.0, 2), ("a", "LOST", 2.0, 3.0, 4), ("a", "DEGRADED", 1.0, 1.5, 1)], "seq string, state string, t_first double, t_last double, n long")
    notes = sinks.failure_notes(runs, ["seq"]).first().notes
    assert notes.endswith("## Detected Degraded/Lost Intervals\n- DEGRADED: 1.000 s to 1.500 s (1 poses)\n- LOST: 2.000 s to 3.000 s (4 poses)")
    assert notes.startswith("# Run Failure Notes\n\n## Health Summary\n- OK: 2\n- DEGRADED: 1\n- LOST: 4\n- INVALID: 0\n")
    assert sinks.failure_notes(runs.where("state = 'OK'"), ["seq"]).first().notes.endswith("No degraded or lost intervals were detected.")


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, None), ("a", 2.0, 5.0), ("a", 3.0, None), ("b", 1.0, None)], "seq string, t double, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq string, t double, value double").parquet(f"{tmp_path}/in")
    query = latest.forward_fill(stream, "seq").writeStream.format("memory").queryName("filled").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("filled").collect())) == [("a", 0.0, 1.0), ("a", 1.0, 1.0), ("a", 2.0, 5.0), ("a", 3.0, 5.0), ("b", 1.0, 0.0)]
    late = latest.gate_late(spark.createDataFrame([(1.0, 0.9), (1.0, 0.5)], "a double, m double"), "a", "m")
    assert [(r.accepted, r.reason) for r in late.orderBy(F.desc("m")).collect()] == [(True, None), (False, "timestamp_gate")]
