import json

import duckdb
import numpy as np
import pytest

from trailmark.functions import frames

from trailmark.plans import catalogue, episodes, matching as plans  # noqa: F401
from trailmark.sources import validators

SF = "/root/testdata/sf0.001"
NAMES = ["a29_three_streams", "j17_reference_at_boundaries", "j18_ratio_matches", "j19_mutual_matches", "w17_pair_cues", "w23_rebased", "w24_ego_motion"]


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, name):
    found = catalogue.QUERIES[name](spark, SF)
    with duckdb.connect() as db:
        for table in ("events", "embeddings"):
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = db.sql(f"SELECT {', '.join(f'"{c}"' for c in found.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and want


def test_blocks_do_not_change_matches(spark, monkeypatch):
    whole = plans.j18_ratio_matches(spark, SF).collect()
    monkeypatch.setattr("trailmark.operators.matching.QUERY_BLOCK", 4)
    monkeypatch.setattr("trailmark.operators.matching.ROW_BLOCK", 90)
    assert sorted(plans.j18_ratio_matches(spark, SF).collect()) == sorted(whole)


def problems(df):
    return {r.path.rpartition("/")[2]: r.problem for r in df.collect()}


def test_file_checks(spark, tmp_path):
    health = dict.fromkeys(validators.HEALTH, 0)
    manifest = dict.fromkeys(validators.MANIFEST_KEYS, "x") | {"health_counts": health}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "good.json").write_text(json.dumps(manifest))
    (tmp_path / "m" / "key.json").write_text(json.dumps({k: v for k, v in manifest.items() if k != "units"}))
    (tmp_path / "m" / "state.json").write_text(json.dumps(manifest | {"health_counts": {"OK": 1}}))
    (tmp_path / "m" / "bad.json").write_text("{")
    found = problems(validators.check_manifests(spark, f"{tmp_path}/m"))
    assert found["good.json"] is None and "units" in found["key.json"] and "DEGRADED" in found["state.json"] and found["bad.json"]

    metrics = dict.fromkeys(validators.METRICS_KEYS, {"nan": 1.0})
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "good.json").write_text(json.dumps(metrics))
    (tmp_path / "x" / "deep.json").write_text(json.dumps(metrics | {"drift_bins": [{"a": ["-Inf"]}]}))
    (tmp_path / "x" / "nan.json").write_text(json.dumps(metrics | {"status": float("nan")}))
    found = problems(validators.check_metrics(spark, f"{tmp_path}/x"))
    assert found["good.json"] is None and found["deep.json"] and found["nan.json"]

    for name, text in (("a", "\n".join([*validators.HEADINGS, validators.NO_FAILURES])), ("b", "\n".join(validators.HEADINGS)), ("c", "# Run Failure Notes")):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / f"{name}.md").write_text(text)
        (tmp_path / "runs" / name / "run_manifest.json").write_text(json.dumps(manifest))
    found = problems(validators.check_failure_notes(spark, f"{tmp_path}/runs/*/*.md", f"{tmp_path}/runs/*/run_manifest.json"))
    assert found["a.md"] is None and "say so" in found["b.md"] and "Health" in found["c.md"]

    (tmp_path / "e.csv").write_text("t,e\n0,1\n")
    (tmp_path / "n.csv").write_text("t,e\n")
    found = problems(validators.check_headers(spark, f"{tmp_path}/*.csv", ["t,e", "t,e,h"]))
    assert found == {"e.csv": None, "n.csv": "no rows"}
    assert [r.problem for r in validators.check_sizes(spark, f"{tmp_path}/e.csv").collect()] == ["only 8 bytes"]


def test_frame_shift(spark):
    scene = np.random.default_rng(3).random((96, 96)) ** 4
    cut = lambda dx, dy: scene[16 - dy : 80 - dy, 16 - dx : 80 - dx].ravel().tolist()
    wanted = [(0, 0), (3, 0), (0, -4), (5, 2), (-6, -3), (10, -7)]
    rows = [(i, cut(0, 0), cut(*d), 64, 64) for i, d in enumerate(wanted)]
    rows += [(6, [0.0] * 64, [1.0] * 64, 8, 8), (7, [1.0] * 4, [1.0] * 4, 2, 2), (8, [float("nan")] * 64, [1.0] * 64, 8, 8), (9, None, [1.0] * 64, 8, 8)]
    found = spark.createDataFrame(rows, "i int, a array<double>, b array<double>, h int, w int").select("i", frames.frame_shift("a", "b", "h", "w").alias("s")).select("i", "s.*").orderBy("i").collect()
    assert all(abs(r.dx - dx) < 0.5 and abs(r.dy - dy) < 0.5 and r.valid and 0 < r.confidence <= 1 for r, (dx, dy) in zip(found, wanted))
    assert [r.reason for r in found[6:]] == ["empty_frame", "frame_too_small", "non_finite_frame", "empty_frame"] and not any(r.valid for r in found[6:])


def test_three_rotations(spark):
    """Turns about one axis blend to a turn between them; a weight of 0 leaves the inertial one."""
    from pyspark.sql import functions as F

    from trailmark.functions import geometry
    from trailmark.operators import fusion

    def turn(degrees):
        half = np.radians(degrees) / 2
        return [F.lit(x) for x in (0.0, 0.0, float(np.sin(half)), float(np.cos(half)))]

    def yaw(*weights):
        q = fusion.fuse_three_rotations(turn(10), turn(30), [-x for x in turn(40)], [F.lit(w) for w in weights])
        return spark.range(1).select(geometry.yaw_degrees(*q)).first()[0]

    assert yaw(1.0, 0.0, 0.0) == pytest.approx(10)
    assert yaw(0.5, 0.5, 0.0) == pytest.approx(20)
    assert yaw(0.0, 0.5, 0.5) == pytest.approx(35)


def test_a_block_holds_few_distances_at_once():
    import tracemalloc

    import numpy as np

    from trailmark.operators import matching

    rng = np.random.default_rng(0)
    ids, there = np.arange(300), rng.normal(size=(40_000, 8))
    tracemalloc.start()
    found = matching._nearest(ids, there[:300] + 0.01, np.arange(40_000) + 1_000_000, there, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["other"].tolist() == (ids + 1_000_000).tolist()
    assert peak < 40e6 and matching.ROW_BLOCK <= 10_000
