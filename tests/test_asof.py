from trailmark.operators import asof, events, sequences


def series(spark, times, name):
    rows = [("a", i, float(t)) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, f"seq string, {name} int, t double")


def matched(spark, source, target, tolerance):
    found = asof.match_nearest(series(spark, source, "i"), series(spark, target, "j"), ["seq"], tolerance, "i", "j")
    return sorted((r.i, r.near.j) for r in found.collect())


def test_exact_and_tolerance(spark):
    assert matched(spark, [0, 1, 2, 3], [0, 1, 2, 3], 0.1) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert matched(spark, [0, 1.05, 2, 3.2], [0, 1, 2, 3], 0.1) == [(0, 0), (1, 1), (2, 2)]


def test_each_target_keeps_its_closest_source(spark):
    assert matched(spark, [0.9, 1.01, 1.1], [1.0], 0.5) == [(1, 0)]
    assert matched(spark, [], [1.0], 0.5) == []


def test_ties(spark):
    source, target = series(spark, [1.0], "i"), series(spark, [0.5, 1.5], "j")
    assert asof.nearest(source, target, ["seq"]).first().near.j == 1
    assert asof.nearest(source, target, ["seq"], tie="prev").first().near.j == 0


def test_interpolation_clamps(spark):
    target = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 4.0)], "seq string, t double, x double")
    found = asof.interpolate(series(spark, [-1, 1, 3], "i"), target, ["seq"], ["x"])
    assert sorted((r.i, r.x, r.in_range) for r in found.collect()) == [(0, 0.0, False), (1, 2.0, True), (2, 4.0, False)]


def test_packets_keep_empty_windows_and_close_the_last(spark):
    e = spark.createDataFrame([("a", t) for t in (0.0, 0.01, 0.02, 0.049, 0.05, 0.1)], "seq string, t double")
    assert sorted((r.win, r.n) for r in events.packets(e, ["seq"], 0.05).collect()) == [(0, 4), (1, 2)]
    gap = spark.createDataFrame([("a", 0.0), ("a", 0.21)], "seq string, t double")
    assert sorted((r.win, r.n) for r in events.packets(gap, ["seq"], 0.1).collect()) == [(0, 1), (1, 0), (2, 1)]


def test_lone_row_has_no_velocity(spark):
    one = spark.createDataFrame([("a", 0.0, 5.0)], "seq string, t double, x double")
    assert sequences.velocity(one, ["seq"], "x", ["t"]).first().velocity == 0
