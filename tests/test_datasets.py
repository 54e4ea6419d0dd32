import pytest
from pyspark.sql import functions as F

from trailmark.sources import datasets, readers, sinks
from trailmark.streaming import latest


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("sequence")
    for name, text in (
        ("imu/imu.csv", "timestamp_s,ax_mps2,ay,az,gx,gy,gz_radps\n0,0,0,9.8,0,0,0\n0.01,0,0,9.8,0,0,0.1\n"),
        ("ground_truth/trajectory.csv", "t,x_m,y_m,z_m,yaw_deg\n0,1,2,3,90\n1,1,2,4,90\n"),
        ("events/events.csv", "t,x,y,polarity\n0.5,1,2,1\n1.5,3,4,-1\n"),
    ):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return root


def test_folder(spark, folder):
    s = datasets.load_sequence(spark, "synthetic", str(folder), "one")
    assert s.missing == [] and s.gravity == -9.81 and s.name == "one"
    assert {r.stream: (r.n, r.t_first, r.t_last) for r in s.ranges.collect()} == {"imu": (2, 0.0, 0.01), "ground_truth": (2, 0.0, 1.0), "events": (2, 0.5, 1.5)}
    events = s.streams["events"].orderBy("t").collect()
    assert [(r.x, r.y, r.p) for r in events] == [(1, 2, 1), (3, 4, -1)]
    rest = datasets.load_sequence(spark, "mvsec")
    assert rest.streams["imu"].count() == 100 and rest.missing == ["ground_truth", "events"]
    with pytest.raises(ValueError):
        datasets.load_sequence(spark, "other")


def test_references(spark, folder, tmp_path):
    (tmp_path / "run_manifest.json").write_text(f'{{"input": "{folder}"}}')
    path = datasets.ground_truth_path(spark, str(tmp_path))
    assert path == f"{folder}/ground_truth/trajectory.csv" and datasets.ground_truth_path(spark, str(tmp_path), "a.csv") == "a.csv"
    assert datasets.load_reference(spark, path).count() == 2
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="read_trajectory.*read_ground_truth"):
        datasets.load_reference(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError):
        datasets.ground_truth_path(spark, str(tmp_path), "x.h5")


def test_event_frame_times(spark):
    frames = spark.createDataFrame([(f"f{k}",) for k in range(3)], "name string")
    events = spark.createDataFrame([(1.0,), (5.0,)], "t double")
    told = spark.createDataFrame([(0.1,), (0.2,), (0.4,)], "timestamp double")
    times = lambda *a: [r.t for r in datasets.event_frame_times(frames, "name", *a).orderBy("name").collect()]
    assert times(events, told) == [0.1, 0.2, 0.4] and times(events, told.limit(2)) == [1.0, 3.0, 5.0] and times() == [0.0, 1.0, 2.0]


def test_external_trajectories(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# t x y z q\n0 1 2 3 0 0 0 1\n0.2 1 2 3 0 0 0 1\n1.0 1 2 3 0 0 0 2\n")
    found = datasets.import_trajectory(spark, str(tmp_path / "t.txt")).orderBy("t").collect()
    assert [r.health for r in found] == ["OK", "OK", "DEGRADED"] and {(r.method, r.confidence) for r in found} == {("external", 0.8)}
    rows = datasets.pose_rows(spark.createDataFrame([(0.0,) * 7 + (1.0, "v")], "t double, x double, y double, z double, qx double, qy double, qz double, qw double, method string")).first()
    assert (rows.method, rows.vx, rows.confidence, rows.health) == ("v", 0.0, 1.0, "OK")
    assert datasets.missing_argument({"method": "external"}, [("method", "external", "path")]) == "method external needs path"
    assert datasets.missing_argument({"method": "imu"}, [("method", "external", "path")]) is None


def test_other_readers(spark, tmp_path):
    e = readers.read_embeddings(spark, "/root/testdata/sf0.001/embeddings.parquet")
    assert e.where("size <> array_size(embedding)").count() == 0
    (tmp_path / "a.json").write_text('{"x": [1, 2]}')
    (tmp_path / "b.json").write_text("{")
    bodies = {r.path[-6:]: r.n for r in readers.read_json_documents(spark, str(tmp_path)).select("path", F.col("body").isNull().alias("n")).collect()}
    assert bodies == {"a.json": False, "b.json": True}
    for k, name in enumerate(("one", "two")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "trajectory.csv").write_text("t\n")
        import os

        os.utime(tmp_path / name / "trajectory.csv", (1000 + k, 1000 + k))
    assert readers.latest_run(spark, str(tmp_path)).first().path.endswith("two/trajectory.csv")
    counts = sinks.health_counts(spark.createDataFrame([("a", "OK"), ("a", "LOST")], "seq string, health string"), ["seq"]).first()
    assert (counts.ok, counts.lost, counts.invalid) == (1, 1, 0)
    sinks.write_log(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "log"))
    assert {r.value for r in spark.read.text(str(tmp_path / "log")).collect()} == {"a,b", "1,"}
    assert latest is not None
