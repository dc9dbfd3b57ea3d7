"""Camera operators on DataFrames.

Points are the large side and keep their partitioning; cameras are a dimension.  Whether it is broadcast is left to the
optimizer, which knows its size; points meet every camera because each camera sees every point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import camera as C


def unpushed(condition: Column) -> Column:
    """A filter condition that stays above the projection whose columns it uses.

    Pushed below, it would carry a copy of the whole projection, distortion polynomial and all, once for every use.
    """
    return F.when(F.rand(0) < 2.0, condition)


def project_points(points: DataFrame, cameras: DataFrame, xyz: tuple[str, str, str], cone: bool = True) -> DataFrame:
    """Points seen by each camera, with u, v, depth and in_frame.  ``cone``: only within 45 degrees of the axis."""
    cam = C.camera()
    # The rotation is worked out on the camera side, so each point costs nine products and no trigonometry.
    turns = C.rotation(cam)
    names = [[f"_r{i}{j}" for j in range(3)] for i in range(3)]
    cameras = cameras.withColumns({names[i][j]: turns[i][j] for i in range(3) for j in range(3)})
    far = points.crossJoin(cameras)
    a, b, c = C.times([[F.col(n) for n in row] for row in names], C.offset(cam, tuple(F.col(n) for n in xyz)))
    far = far.withColumns({"_a": a, "_b": b, "depth": c}).where("depth > 0")
    if cone:
        far = far.where("abs(_a) < depth AND abs(_b) < depth")
    far = far.withColumns({"_x": F.col("_a") / F.col("depth"), "_y": F.col("_b") / F.col("depth")})
    u, v = C.to_pixels(cam, *C.distort(cam, F.col("_x"), F.col("_y")))
    far = far.withColumns({"u": u, "v": v}).withColumn("in_frame", C.inframe(cam, F.col("u"), F.col("v")))
    return far.drop("_a", "_b", "_x", "_y", *sum(names, []))


def pixel_means(projected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of a column for each pixel (row, col) of the frame; points on the far border count to the last pixel."""
    seen = projected.where(unpushed(F.col("in_frame")))
    row = F.least(F.floor("v"), F.col("ny") - 1).cast("long")
    col = F.least(F.floor("u"), F.col("nx") - 1).cast("long")
    return seen.withColumns({"row": row, "col": col}).groupBy(*keys, "row", "col").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def paint_tiles(projected: DataFrame, keys: list[str], tile: str, value: str) -> DataFrame:
    """Image of a tiled surface: cells of a tile average into a pixel, and of several tiles the one with the highest number
    wins.  The mean is taken before tiles meet, so both aggregations combine on the map side."""
    means = pixel_means(projected, [*keys, tile], value)
    return means.groupBy(*keys, "row", "col").agg(F.max_by("mean", tile).alias("value"), F.max(tile).alias("tile"), F.sum("n").alias("n"))


def border_points(cameras: DataFrame, step: int) -> DataFrame:
    """Points along the image border, clockwise from the upper left corner, each corner once: edge, i, u, v."""
    nx, ny = F.col("nx"), F.col("ny")

    def count(n: Column) -> Column:
        return F.greatest(F.floor(n / step), F.lit(1)).cast("int")

    parts = []
    for e, (n, u, v) in enumerate(
        [
            (nx, lambda t: t * F.col("nx"), lambda t: F.lit(0.0)),
            (ny, lambda t: F.col("nx"), lambda t: t * F.col("ny")),
            (nx, lambda t: F.col("nx") * (1.0 - t), lambda t: F.col("ny")),
            (ny, lambda t: F.lit(0.0), lambda t: F.col("ny") * (1.0 - t)),
        ]
    ):
        side = cameras.withColumns({"n": count(n)}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("edge", F.lit(e))
        t = F.col("i") / F.col("n")
        parts.append(side.withColumns({"u": u(t) + 0.0, "v": v(t) + 0.0}).drop("n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def image_grid(cameras: DataFrame, step: float) -> DataFrame:
    """Points of a regular grid over the image, both borders included."""
    u = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.col("nx") / step).cast("int")), lambda i: i * F.lit(step)))
    v = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.col("ny") / step).cast("int")), lambda i: i * F.lit(step)))
    return cameras.withColumn("u", u).withColumn("v", v)


def view_boxes(cameras: DataFrame, step: int, distance: float) -> DataFrame:
    """Box around the camera and its border rays cut at a depth."""
    ray = C.unproject(C.camera(), F.col("u"), F.col("v"), directions=False, distance=F.lit(distance))
    rays = border_points(cameras, step).select("cam_id", "x", "y", "z", *[r.alias(f"r{n}") for r, n in zip(ray, "xyz")])
    stats = [f(g(f"r{n}"), F.first(n)).alias(f"{n}_{k}") for n in "xyz" for k, f, g in (("min", F.least, F.min), ("max", F.greatest, F.max))]
    return rays.groupBy("cam_id").agg(*stats)


def reversible(cameras: DataFrame) -> DataFrame:
    """Whether the distorted centre row and column never fall back, so that distortion can be undone: one point a pixel."""
    cam = C.camera()
    out = None
    for axis in "xy":
        n, half = F.col(f"n{axis}"), F.col(f"n{axis}") / (2.0 * F.col(f"f{axis}"))
        points = cameras.select("*", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("i"))
        at = half * (2.0 * F.col("i") / (n - 1.0) - 1.0)
        bent = C.distort(cam, at, F.lit(0.0))[0] if axis == "x" else C.distort(cam, F.lit(0.0), at)[1]
        part = points.select("cam_id", "i", F.lit(axis).alias("axis"), bent.alias("w"))
        out = part if out is None else out.unionByName(part)
    before = F.lag("w").over(Window.partitionBy("cam_id", "axis").orderBy("i"))
    return out.withColumn("up", F.coalesce(F.col("w") >= before, F.lit(True))).groupBy("cam_id").agg(F.bool_and("up").alias("reversible"))
