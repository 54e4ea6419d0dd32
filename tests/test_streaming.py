"""Streams against the batch forms, in several micro-batches."""

from pyspark.sql import functions as F

from trailmark.operators import fusion
from trailmark.sources import readers, sinks, validators
from trailmark.streaming import fusion as streamed
from trailmark.streaming import latest


def drained(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def parts(spark, frames, path):
    """A stream that gets one file of each frame in turn."""
    for k, part in enumerate(frames):
        part.coalesce(1).write.mode("append").parquet(path)
        assert k >= 0
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_filter_stream_equals_batch(spark, tmp_path):
    imu = spark.range(60).select(F.lit("a").alias("seq"), (F.col("id") * 0.1).alias("t"), F.lit(0.1).alias("ax"), F.lit(0.0).alias("ay"), F.lit(9.81).alias("az"), F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), F.lit(0.01).alias("gz"))
    measured = spark.range(12).select(F.lit("a").alias("seq"), (F.col("id") * 0.5 + 0.05).alias("t"), F.lit("vo").alias("method"), F.lit(0.2).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.9).alias("confidence"), F.when(F.col("id") == 3, "LOST").otherwise("OK").alias("health"), F.when(F.col("id") == 5, 0.0).otherwise(1.0).alias("trust"))
    want = fusion.filter_fusion(imu, measured, ["seq"]).collect()
    rows = fusion.offered(imu, measured, ["seq"])
    stream = parts(spark, [rows.where("t < 2"), rows.where("t >= 2 and t < 4"), rows.where("t >= 4")], str(tmp_path / "rows"))
    got = drained(spark, streamed.filter_stream(stream, ["seq"]), "filtered").collect()
    key = lambda r: (r.kind, r.t, r.step_t)
    assert sorted(got, key=key) == sorted(want, key=key) and {r.reason for r in got if r.kind == "update"} == {None, "health_gate", "policy_gate"}


def test_late_rows_and_latest_values(spark, tmp_path):
    one = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, None)], "seq string, t double, value double")
    two = spark.createDataFrame([("a", 2.0, None), ("a", 3.0, 5.0), ("a", 4.0, None)], "seq string, t double, value double")
    found = drained(spark, latest.forward_fill(parts(spark, [one, two], str(tmp_path / "fill")), "seq"), "filled")
    assert {r.t: r.filled for r in found.collect()} == {0.0: 1.0, 1.0: 1.0, 2.0: 1.0, 3.0: 5.0, 4.0: 5.0}
    late = spark.createDataFrame([(1, 10.0, 9.9), (2, 10.0, 9.0)], "i int, arrived double, measured double")
    gated = drained(spark, latest.gate_late(parts(spark, [late], str(tmp_path / "late")), "arrived", "measured"), "gated")
    assert {r.i: r.reason for r in gated.collect()} == {1: None, 2: "timestamp_gate"}


def test_packets_close_with_the_watermark(spark, tmp_path):
    made = [spark.createDataFrame([("a", s, 1) for s in seconds], "seq string, s int, p int").select("seq", F.timestamp_seconds("s").alias("ts"), "p") for seconds in ([1, 2, 11], [60])]
    found = drained(spark, latest.packets(parts(spark, made, str(tmp_path / "events")), ["seq"], "ts", "10 seconds", "5 seconds"), "packets")
    assert sorted((r.win.start.second % 60, r.n, r.n_pos) for r in found.collect()) == [(0, 2, 2), (10, 1, 1)]


def test_time_and_shape_problems(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 1.0), ("a", 4, 0.5)], "path string, line int, t double")
    assert [r.line for r in readers.time_problems(rows, ["path"], ["line"]).collect()] == [4]
    assert sorted(r.line for r in readers.time_problems(rows, ["path"], ["line"], strictly=True).collect()) == [3, 4]
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [float("nan"), 1.0])], "vec_id int, embedding array<double>").write.parquet(str(tmp_path / "e"))
    assert {r.vec_id: r.problem for r in readers.read_embeddings(spark, str(tmp_path / "e"), 2).collect()} == {1: None, 2: "size 1", 3: "no vector", 4: "a number isn't finite"}


def test_manifests_and_error_files(spark, tmp_path):
    poses = spark.createDataFrame([("OK",), ("LOST",)], "health string")
    details = {k: "x" for k in validators.MANIFEST_KEYS if k != "health_counts"}
    sinks.manifest(poses, details).coalesce(1).write.text(str(tmp_path / "run_manifest.json"))
    assert validators.check_manifests(spark, str(tmp_path / "run_manifest.json")).first().problem is None
    header = ["cumulative_distance", "error_magnitude", "health"]
    for name, body, want in (("a", "1.0,2.0,OK", None), ("b", "1.0,,OK", "line 2: error_magnitude: "), ("c", "1.0,nan,OK", "line 2: error_magnitude: nan"), ("d", "1,2,FINE", "line 2: health: FINE"), ("e", "", "no rows")):
        (tmp_path / name).write_text(",".join(header) + "\n" + body + "\n")
        assert validators.check_error_files(spark, str(tmp_path / name), header, [], ["health"]).first().problem == want, name
    assert validators.check_error_files(spark, str(tmp_path / "b"), header, ["error_magnitude"], ["health"]).first().problem is None
    for k, method in enumerate(("imu", "vo")):
        folder = tmp_path / "runs" / method
        folder.mkdir(parents=True)
        (folder / "trajectory.csv").write_text("t\n")
        (folder / "run_manifest.json").write_text(f'{{"method": "{method}"}}')
    assert readers.latest_run(spark, str(tmp_path / "runs"), method="imu").first().path.endswith("imu/trajectory.csv")
