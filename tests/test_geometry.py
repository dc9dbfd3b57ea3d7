import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rimeframe.functions import camera as C
from rimeframe.functions import grid as R
from rimeframe.operators import calibration as K
from rimeframe.operators import lines as L
from rimeframe.operators import rasters as O
from rimeframe.operators import tracking as T
from rimeframe.operators.undistort import bend


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def cam(**values):
    base = dict.fromkeys(C.CAMERA, 0.0) | {"nx": 100.0, "ny": 100.0, "fx": 100.0, "fy": 100.0}
    return {n: F.lit(float(v)) for n, v in (base | values).items()}


def test_camera_looks_north_and_level(spark):
    u, v, d = C.project(cam(), (F.lit(0.0), F.lit(10.0), F.lit(0.0)))
    r = one(spark, u=u, v=v, d=d)
    assert (r.u, r.v, r.d) == pytest.approx((50, 50, 10))


def test_behind_is_null(spark):
    u, v, _ = C.project(cam(), (F.lit(0.0), F.lit(-10.0), F.lit(0.0)))
    r = one(spark, u=u, v=v)
    assert r.u is None and r.v is None


@pytest.mark.parametrize("values", [{}, {"k1": 0.1}, {"k1": -0.1}, {"k1": 0.1, "k2": 0.02, "p1": 0.001}, {"yaw": 5, "pitch": 2, "roll": 3, "k1": -0.05, "cx": 3}])
def test_there_and_back(spark, values):
    grid = [(u, v) for u in range(0, 101, 20) for v in range(0, 101, 20)]
    df = spark.createDataFrame([(float(u), float(v)) for u, v in grid], "u double, v double")
    c = cam(**values)
    ray = C.unproject(c, F.col("u"), F.col("v"))
    df = df.withColumns(dict(zip(("a", "b", "c"), ray)))
    u, v, _ = C.project(c, tuple(map(F.col, ("a", "b", "c"))), directions=True)
    got = df.select("u", "v", u.alias("x"), v.alias("y")).collect()
    assert max(max(abs(r.u - r.x), abs(r.v - r.y)) for r in got) < 1e-9


@pytest.mark.parametrize("k1", [2.0, -2.0, 0.3])
def test_strong_radial_closed_form(spark, k1):
    x = np.linspace(0, 0.3, 13)
    big = x + k1 * x**3
    df = spark.createDataFrame([(float(b), float(a)) for a, b in zip(x, big)], "big double, x double")
    ux, uy = C.undistort_k1(F.lit(k1), F.col("big") * 0.6, F.col("big") * 0.8)
    got = df.select("x", ux.alias("a"), uy.alias("b")).collect()
    assert all(abs(np.hypot(r.a, r.b) - r.x) < 1e-12 for r in got)


def test_snapping_pulls_the_far_edge_in(spark):
    g = R.of(4, 4, (0.0, 4.0), (4.0, 0.0))
    xs = [(0.0, 0.5), (1.0, 1.5), (1.49, 1.5), (4.0, 3.5)]
    for x, want in xs:
        sx, _ = R.snapped(g, F.lit(x), F.lit(1.0))
        assert one(spark, x=sx).x == want


def test_circle_has_its_corners(spark):
    df = spark.createDataFrame([(1, 0, 0, 3)], "k int, x int, y int, r int")
    cells = {(r.x, r.y) for r in L.bresenham_circles(df).collect()}
    assert {(3, 0), (0, 3), (-3, 0), (0, -3)} <= cells
    assert {(y, x) for x, y in cells} == cells and all(2.4 < np.hypot(x, y) < 3.6 for x, y in cells)
    least = L.bresenham_circles(spark.createDataFrame([(1, 0, 0, 1)], "k int, x int, y int, r int")).collect()
    assert {(r.x, r.y) for r in least} == {(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)} - {(0, 0)}


def test_lines_in_all_directions(spark):
    ends = [(a, b) for a in range(-4, 5) for b in range(-4, 5)]
    df = spark.createDataFrame([(i, 0, 0, a, b) for i, (a, b) in enumerate(ends)], "k long, x0 long, y0 long, x1 long, y1 long")
    rows = L.bresenham_lines(df, "k").collect()
    for i, (a, b) in enumerate(ends):
        cells = sorted((r.t, r.x, r.y) for r in rows if r.k == i)
        assert cells[0][1:] == (0, 0) and cells[-1][1:] == (a, b) and len(cells) == max(abs(a), abs(b)) + 1


def test_spline_is_exact_for_cubics():
    i, j = np.mgrid[0:9, 0:7]
    surface = lambda r, c: 1 + 2 * r - c + 0.3 * r * c + 0.05 * r**3 - 0.02 * c**3
    rng = np.random.default_rng(1)
    r, c = rng.uniform(0, 8, 50), rng.uniform(0, 6, 50)
    assert np.allclose(T.spline_sample(surface(i, j).astype(float), r, c), surface(r, c))


@pytest.mark.parametrize("method", ["systematic", "stratified", "residual", "choice"])
def test_resampling_keeps_the_count_and_the_mean(method):
    rng = np.random.default_rng(2)
    w = rng.random(500)
    w[::7] = 0
    drawn = np.concatenate([T.resample(w, method, rng) for _ in range(40)])
    share = np.bincount(drawn, minlength=500) / len(drawn)
    assert len(drawn) == 20_000 and share[::7].sum() == 0 and np.abs(share - w / w.sum()).max() < 2e-3


def test_solver_finds_a_camera():
    rng = np.random.default_rng(3)
    x = rng.uniform(-0.4, 0.4, (300, 2))
    truth = np.array([-0.12, 0.05, 0.001])

    def sums(p):
        def residual(q):
            return np.stack(bend([q[0], q[1], 0, 0, 0, 0, q[2], 0], x[:, 0], x[:, 1]), 1) - np.stack(bend([truth[0], truth[1], 0, 0, 0, 0, truth[2], 0], x[:, 0], x[:, 1]), 1)

        r = residual(p).ravel()
        jac = np.stack([(residual(p + d).ravel() - residual(p - d).ravel()) / 2e-6 for d in np.eye(3) * 1e-6], 1)
        return jac.T @ jac, jac.T @ r, float(r @ r)

    fit, cost = K.levenberg_marquardt(sums, np.zeros(3))
    assert np.allclose(fit, truth, atol=1e-8) and cost < 1e-18


def test_subsets_are_different_and_no_more_than_there_are():
    subsets = K.ransac_subsets(5, 2, 100, seed=1)
    assert len(subsets) == 10 and len({tuple(s) for s in subsets}) == 10


def test_gaussian_of_a_constant_with_holes(spark):
    rows = [(0, r, c, None if (r + c) % 5 == 0 else 7.0) for r in range(6) for c in range(8)]
    cells = spark.createDataFrame(rows, "raster_id long, row long, col long, z double")
    got = O.gaussian_filter(cells, 1.0, 8, 6, fill=True).collect()
    assert len(got) == 48 and all(abs(r.z - 7.0) < 1e-12 for r in got)


def test_viewshed_of_a_wall(spark):
    rows = [(0, r, c, 5.0 if c == 6 else 0.0, 4, 4, 1.0) for r in range(9) for c in range(12)]
    cells = spark.createDataFrame(rows, "raster_id long, row long, col long, z double, eye_row long, eye_col long, eye_z double")
    seen = {(r.row, r.col): r.visible for r in O.viewshed_rings(cells, 1.0).collect()}
    assert seen[4, 6] and not seen[4, 9] and seen[4, 2]


def test_ransac_of_any_model():
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 10, 120)
    y = 2 * x - 1 + rng.normal(0, 0.01, 120)
    y[::4] += rng.uniform(3, 20, 30)

    class Line:
        size = 120

        def fit(self, index):
            return np.polyfit(x[index], y[index], 1)

        def errors(self, params, index):
            return np.abs(np.polyval(params, x[index]) - y[index])

    params, inliers = K.ransac(Line(), 2, 0.1, 50, 40, seed=1)
    assert np.allclose(params, [2, -1], atol=0.02) and set(inliers) == set(range(120)) - set(range(0, 120, 4))


def test_tracks_with_a_plugged_in_model_and_reduction(spark):
    import pandas as pd

    class Still(T.Motion):
        def start(self, n, rng):
            p = np.zeros((n, 6))
            p[:, :2] = self.of("x", "y") + rng.normal(0, 0.5, (n, 2))
            return p

    y, x = np.mgrid[0:60, 0:60]
    image = (50 * np.sin(x / 2.3) * np.cos(y / 3.1) + 20 * np.sin(x / 5 + y / 2)).tolist()
    rows = [(k, s, float(s), 0, 0, image if k == 1 else image[:9], "still", 3, {"x": 30.0, "y": 30.0}) for k in (1, 2) for s in range(3)]
    frames = spark.createDataFrame(pd.DataFrame(rows, columns=["track", "step", "t", "row0", "col0", "pixels", "kind", "seed", "params"]), "track long, step int, t double, row0 int, col0 int, pixels array<array<double>>, kind string, seed long, params map<string,double>")
    got = T.track(frames, lambda p: p[:, :2], particles=200, models={"still": Still}, reduce=lambda p, w: p[:, 0].max()).collect()
    good = [r for r in got if r.track == 1]
    assert len(good) == 3 and all(abs(r.x - 30) < 0.3 and len(r.cov) == 36 and r.reduced >= r.x and r.error is None for r in good)
    assert [r.error is not None for r in got if r.track == 2] == [True]


def test_rounding_is_that_of_sql(spark):
    """Halves, what decimal digits show as halves, neighbours of halves, and values that are no numbers or too large."""
    import duckdb

    from rimeframe.plans.roles import rounded

    values = [k / 2e4 for k in range(-3001, 3001)] + [math.nextafter(k / 2e4, s * 9) for k in range(-201, 201) for s in (-1, 1)]
    values += [0.49999999999999994e-4, 1e11 + 0.00005, 5e15, -7e300, 1.5e308, -1.5e308, 5e-324, math.inf, -math.inf, math.nan, None]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = [r.y for r in rows.select("i", rounded(F.col("x"), 4).alias("y")).orderBy("i").collect()]
    want = [r[0] for r in duckdb.execute("SELECT round(x, 4) + 0.0 FROM (SELECT unnest(range(len($1))) AS i, unnest($1::DOUBLE[]) AS x) ORDER BY i", [values]).fetchall()]
    assert list(map(repr, got)) == list(map(repr, want))


@pytest.mark.parametrize("name", ["cam_project", "filter_inframe_infront"])
def test_many_rows_are_not_rounded_by_decimal_digits(spark, name):
    from rimeframe import plans

    rows = plans.queries()[name](spark, "/root/testdata/sf0.001")
    assert "round(" not in rows._jdf.queryExecution().executedPlan().toString()
