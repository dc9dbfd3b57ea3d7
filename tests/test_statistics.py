"""Operators on particles, runs and values against plain Python."""

from rimeframe.operators import statistics as S


def test_residual_keeps_every_row(spark):
    """Rows that share a number, and those without a key, are rows of the result, too: each once."""
    rows = [(1, 7, 1.0), (1, 7, 3.0), (1, 8, 2.0), (None, 9, 5.0), (None, 9, 1.0)]
    p = spark.createDataFrame(rows, "k long, i long, w double")
    got = sorted((tuple(r) for r in S.resample_residual(p, ["k"], "i", "w").select("k", "i", "copies", "w").collect()), key=str)
    assert got == sorted([(1, 7, 0, 0.5), (1, 7, 1, 0.5), (1, 8, 1, 0.0), (None, 9, 1, 5 * 2 / 6 - 1), (None, 9, 0, 2 / 6)], key=str)


def test_runs_over_buckets(spark):
    """Runs that go over the bounds of buckets, and missing values, are numbered as in one order; no window takes a key."""
    from pyspark.sql import functions as F

    from rimeframe.operators import lines as L

    rng = __import__("random").Random(4)
    rows = [(k, i, rng.choice([True, True, True, False, None])) for k in (1, 2, None) for i in range(80)]
    t = spark.createDataFrame(rows, "k int, i int, m boolean")
    want, last, n = {}, {}, {}
    for k, i, m in rows:
        n[k] = n.get(k, -1) + (k not in last or last[k] != m)
        last[k] = m
        want[k, i] = n[k]
    for bucket in (None, F.floor(F.col("i") / 7)):
        assert {(r["k"], r["i"]): r["run"] for r in L.mask_runs(t, ["k"], ["i"], "m", bucket).collect()} == want


def test_nearest_without_an_order_of_all(spark):
    from rimeframe.plans import time as P

    plan = P.sorted_nearest(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_lines_make_no_row_a_vertex(spark):
    from rimeframe.plans import match as P

    plan = P.lines_predicted(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_small_tables_are_dealt_out(spark):
    """Work on each row of a table of one split is not one task."""
    from rimeframe.plans import camera, io, match

    for query in (camera.cam_unproject, camera.cam_undistort, match.matches_predicted, match.lines_predicted, io.scan_agisoft_xml, io.scan_svg, io.svg_elements, io.sink_camera_json, io.scan_exif, io.sink_exif):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, query


def test_agisoft_terms(spark):
    """Missing, empty, nested and repeated terms as XPath has them, from one parse."""
    from rimeframe.sources import reports as P

    texts = ["<calibration><f>1.5</f><f>2</f><k1/><x><k2>9</k2></x><width> 7 </width><p1>-<b>2</b></p1></calibration>", "<other><f>1</f></other>", None]
    files = spark.createDataFrame(list(zip("abc", texts)), "path string, content string")
    got = {r["path"]: (r["width"], r["height"], r["f"], r["k1"], r["k2"], r["p1"]) for r in P.agisoft_xml(files).collect()}
    assert got == {"a": (7, 0, 1.5, 0.0, 0.0, -2.0), "b": (0, 0, 0.0, 0.0, 0.0, 0.0), "c": (None, None, 0.0, 0.0, 0.0, 0.0)}
    assert "xpath" not in P.agisoft_xml(files)._jdf.queryExecution().executedPlan().toString()


def test_fits_share_their_passes(spark):
    """One pass a step for all cameras, and no rows kept."""
    from rimeframe.plans import match as P

    calls, real = [], P.K.sums_by_group
    P.K.sums_by_group = lambda *a: calls.append(len(a[4])) or real(*a)
    try:
        rows = P.cameras_fit(spark, "/root/testdata/sf0.001").collect()
    finally:
        P.K.sums_by_group = real
    assert len(rows) == 5 and calls[0] == 5 and len(calls) <= 13
    assert not spark.sparkContext._jsc.getPersistentRDDs()
