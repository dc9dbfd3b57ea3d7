"""Raster files, image resampling between cameras, whole matching pipelines, and the data behind plots."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import camera as C
from ..operators import cameras as O
from ..operators import matching as M
from ..operators import rasters as R
from ..operators import tracking as K
from ..sources import rasters as S
from ..sources import reports as P
from . import match, raster
from .roles import CAM, cameras, r6, sql6, table
from .raster import C as CELLS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _written(spark, sf) -> str:
    path = S.scratch(spark, "rasters")
    h = spark.createDataFrame([(i, raster.NX, raster.NY, 0.0, 100.0, 33.0, 0.0, "EPSG:32606") for i in range(3)], "raster_id long, nx int, ny int, x0 double, x1 double, y0 double, y1 double, crs string")
    S.write(raster.cells(spark, sf).select("raster_id", "row", "col", "z"), h, path, tile=8)
    return path


@query(f"WITH {CELLS} SELECT raster_id, row, col, z FROM cells")
def sink_raster_write(spark, sf):
    return S.window(spark, _written(spark, sf)).select(F.col("raster_id").cast("long").alias("raster_id"), "row", "col", "z")


@query(f"WITH {CELLS} SELECT row, col, z FROM cells WHERE raster_id = 2 AND row >= 2 AND row < 9 AND col >= 10 AND col < 30")
def scan_raster_read(spark, sf):
    return S.window(spark, _written(spark, sf), (2, 9), (10, 30), raster_id=2).select("row", "col", "z")


@query(f"WITH {CELLS} SELECT raster_id, row // 3 AS row, col // 3 AS col, z FROM cells WHERE row % 3 = 0 AND col % 3 = 0")
def scan_raster_open(spark, sf):
    """A third of the resolution."""
    return S.window(spark, _written(spark, sf), every=3).select(F.col("raster_id").cast("long").alias("raster_id"), "row", "col", "z")


@query("SELECT i AS raster_id, 50 AS nx, 11 AS ny, 100.0::DOUBLE / 50 AS dx, 'EPSG:32606' AS crs FROM range(0, 3) t(i)")
def scan_grid_read(spark, sf):
    return S.headers(spark, _written(spark, sf)).select("raster_id", "nx", "ny", ((F.col("x1") - F.col("x0")) / F.col("nx")).alias("dx"), "crs")


@query(f"WITH {CELLS} SELECT raster_id, row, list(z ORDER BY col)[1] AS first, len(list(z)) AS n FROM cells GROUP BY ALL")
def sink_image_write(spark, sf):
    """Cells packed into rows of pixels, written and read back."""
    rows = raster.cells(spark, sf).groupBy("raster_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "z"))), lambda x: x["z"]).alias("values"))
    back = S.checkpoint(rows, "image")
    return back.select("raster_id", "row", F.col("values")[0].alias("first"), F.size("values").cast("long").alias("n"))


@query("SELECT p_partkey AS pk, p_retailprice AS price FROM part")
def io_pickle(spark, sf):
    """A checkpoint of intermediate results."""
    return S.checkpoint(table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), F.col("p_retailprice").alias("price")), "parts")


@query(f"WITH {CELLS} SELECT raster_id, count(*) AS n, {sql6('(max(col) + 1) * 2.0::DOUBLE')} AS width, {sql6('(max(row) + 1) * 3.0::DOUBLE')} AS height FROM cells GROUP BY 1")
def raster_properties(spark, sf):
    c = raster.cells(spark, sf)
    return c.groupBy("raster_id").agg(F.count("*").alias("n"), r6((F.max("col") + 1) * 2.0).alias("width"), r6((F.max("row") + 1) * 3.0).alias("height"))


@query("SELECT p_partkey AS pk, " + sql6("2 + 3 * x - 0.5 * y + 0.01 * x * x * x") + " AS value FROM (SELECT p_partkey, (p_retailprice - 900) / 10.0::DOUBLE AS x, p_size / 6.0::DOUBLE AS y FROM part)")
def raster_sample_cubic(spark, sf):
    """Order 3: a bicubic spline over a raster kept as one tile a group."""

    @F.pandas_udf("double")
    def run(y: pd.Series, x: pd.Series) -> pd.Series:
        i, j = np.mgrid[0:10, 0:11]
        return pd.Series(K.spline_sample((2 + 3 * j - 0.5 * i + 0.01 * j**3).astype(float), y.to_numpy(float), x.to_numpy(float)))

    return table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), r6(run(F.col("p_size") / 6.0, (F.col("p_retailprice") - 900) / 10.0)).alias("value"))


def _target_pixels(spark, sf):
    """Pixel centres of each camera at a tenth of its size, and where the same camera turned by two degrees has them."""
    cam = C.camera()
    small = cameras(spark, sf)
    p = O.image_grid(small, 20.0).where("u < nx AND v < ny").withColumns({"u": F.col("u") + 10.0, "v": F.col("v") + 10.0})
    ray = C.unproject(cam, F.col("u"), F.col("v"))
    p = p.withColumns(dict(zip(("rx", "ry", "rz"), ray)))
    su, sv, _ = C.project({**cam, "yaw": F.col("yaw") + 2.0}, tuple(map(F.col, ("rx", "ry", "rz"))), directions=True)
    return p.withColumns({"su": su, "sv": sv})


def _resampled(spark, sf):
    """Every camera's target pixels with the source's value there; the source is a plane 0.5 u + 0.25 v, sampled bilinearly."""
    from ..functions import grid as G

    g = G.of(100, 75, (0.0, 400.0), (0.0, 300.0))
    cells = spark.range(7500).select(F.floor(F.col("id") / 100).cast("long").alias("row"), (F.col("id") % 100).alias("col"))
    x, y = G.centre(g, F.col("row"), F.col("col"))
    p = _target_pixels(spark, sf).select(F.monotonically_increasing_id().alias("pid"), "cam_id", "u", "v", F.col("su").alias("x"), F.col("sv").alias("y"))
    got = R.sample(S.checkpoint(p, "pixels"), cells.withColumn("z", 0.5 * x + 0.25 * y), g)
    return got.withColumn("expected", 0.5 * F.col("x") + 0.25 * F.col("y"))


@query()
def image_project(spark, sf):
    """Images resampled into cameras at the same place.

    Returns the resampled value and the plane's own value there; they agree wherever the source covers the target."""
    value = F.col("value")
    return _resampled(spark, sf).select("cam_id", "u", "v", r6(value, 4).alias("value"), r6(F.when(value.isNotNull(), F.col("expected")), 4).alias("expected"))


@query(f"WITH {CAM} SELECT cam_id, 300::BIGINT AS pixels, true AS covered, true AS close FROM cam")
def project_images(spark, sf):
    """All images at once: target pixels of each, and whether the source covers half of them at least and agrees there."""
    error = F.abs(F.col("value") - F.col("expected"))
    return _resampled(spark, sf).groupBy("cam_id").agg(F.count("*").alias("pixels"), (2 * F.count("value") >= F.count("*")).alias("covered"), (F.max(error) < 1e-6).alias("close"))


@query(f"WITH {match._NN}, back AS (SELECT img_i, img_j, kp_j, arg_min(kp_i, (d, kp_i)) AS kp_i FROM d GROUP BY 1, 2, 3), k AS (SELECT img_i, img_j FROM nn JOIN back USING (img_i, img_j, kp_i, kp_j) WHERE r = 1 AND d / d2 < 0.98) SELECT img, count(*) AS matches FROM (SELECT img_i AS img FROM k UNION ALL SELECT img_j FROM k) GROUP BY 1")
def keypoint_matcher(spark, sf):
    """From keypoints to points matched for each image, with the matches kept as a table in between."""
    matches = S.checkpoint(M.match_keypoints(match.keypoints(spark, sf), match.image_pairs(spark, sf), max_ratio=0.98, mutual=True), "matches")
    edges = matches.groupBy("img_i", "img_j").agg(F.count("*").alias("size"))
    return M.per_image(edges).select("img", "matches")


@query(f"WITH {match._M} SELECT m_id, img_i, img_j, count(*) AS n, max(w) AS w FROM m GROUP BY ALL")
def matches_to_type(spark, sf):
    """Matches as rows of another kind: without error and distance, equal ones together."""
    return match.matches(spark, sf).groupBy("m_id", "img_i", "img_j").agg(F.count("*").alias("n"), F.max("w").alias("w"))


@query(f"WITH {CAM} SELECT cam_id, {sql6('avg(fx) OVER ()')} AS f_group, {sql6('fx - avg(fx) OVER ()')} AS f_own FROM cam")
def cameras_params(spark, sf):
    """A parameter shared by a group of cameras is their mean; what is left is each one's own."""
    c = cameras(spark, sf)
    mean = F.avg("fx").over(Window.partitionBy(F.lit(0)))
    return c.select("cam_id", r6(mean).alias("f_group"), r6(F.col("fx") - mean).alias("f_own"))


@query("SELECT user_id AS track, event_id, " + sql6("epoch_us(ts) / 3.6e9 - 473352", 5) + " AS u, value AS v, " + sql6("(lead(value) OVER w - value) * 2") + " AS dv, event_type = 'click' AS selected FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def sink_plots(spark, sf):
    """The table behind a quiver plot: position, scaled step to the next point, selected or not."""
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 473352
    step = F.lead("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - F.col("value")
    return table(spark, sf, "events").select(F.col("user_id").alias("track"), "event_id", r6(hours, 5).alias("u"), F.col("value").alias("v"), r6(step * 2).alias("dv"), (F.col("event_type") == "click").alias("selected"))


@query("SELECT user_id AS observer, count(*) AS images FROM events GROUP BY 1")
def image_cache(spark, sf):
    """Rows kept in memory between two uses, then released."""
    e = table(spark, sf, "events").select("user_id", "event_id").persist()
    e.count()
    out = S.checkpoint(e.groupBy(F.col("user_id").alias("observer")).agg(F.count("*").alias("images")), "cache")
    e.unpersist()
    return out


@query(f"WITH {CELLS} SELECT raster_id, row, col, z FROM cells")
def raster_copy(spark, sf):
    """A DataFrame is its own copy: what is derived from it leaves it as it was."""
    c = raster.cells(spark, sf).select("raster_id", "row", "col", "z")
    c.withColumn("z", F.lit(0.0))
    return c


@query("SELECT page_id, split_part(regexp_extract(url || CASE WHEN page_id % 2 = 0 THEN '/a.tar.gz' ELSE '' END, '([^/]*)$', 1), '.', 1) AS name FROM pages")
def strip_path(spark, sf):
    """The last component of a path without its extensions."""
    path = F.concat("url", F.when(F.col("page_id") % 2 == 0, "/a.tar.gz").otherwise(""))
    return table(spark, sf, "pages").select("page_id", P.bare_name(path).alias("name"))


@query(f"WITH {CAM}, {match._CTRL} SELECT cam_id, {sql6('any_value(fx) * radians(1.0::DOUBLE) / count(*)')} AS scale FROM cam JOIN ctrl USING (cam_id) GROUP BY 1")
def cameras_scales_build(spark, sf):
    """The scale of each camera's view direction, shared by the controls that depend on it."""
    dep = match._controls(spark, sf).join(cameras(spark, sf).select("cam_id", "fx"), "cam_id")
    return dep.groupBy("cam_id").agg(r6(F.first("fx") * F.radians(F.lit(1.0)) / F.count("*")).alias("scale"))
