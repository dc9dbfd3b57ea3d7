"""Rasters as cell tables: raster_id, row, col, z.

A cell finds its neighbours by key: sampling joins the four cells around a point, windows run along a row or a column, and
separable filters explode each cell to the few cells it reaches and aggregate.  Nothing gathers a raster in one task, except
the kernels that walk a whole raster (``viewshed_rings``), which take one raster a group.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid as R
from .lines import bresenham_circles


def sample(points: DataFrame, cells: DataFrame, g: R.Grid, order: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Points (x, y) with ``value``: of the nearest cell (order 0) or bilinear between four cell centres (order 1).

    Each point asks for its cells by key, so the join is an equi-join and its result is added up for each point.  NULL
    outside the cell centres, or where a needed cell is missing.  ``points`` has a unique ``pid``."""
    keys = keys or []
    row, col = R.rowcol(g, F.col("x"), F.col("y"))
    if not order:
        r, c = R.rowcol(g, F.col("x"), F.col("y"), snap=True)
        asked = points.withColumns({"row": r, "col": c})
        inside = R.inbounds(g, F.col("x"), F.col("y"))
        return asked.join(cells.select(*keys, "row", "col", F.col("z").alias("value")), [*keys, "row", "col"], "left").withColumn("value", F.when(inside, F.col("value"))).drop("row", "col")
    inside = (row >= 0) & (col >= 0) & (row <= g["ny"] - 1) & (col <= g["nx"] - 1)
    low_r, low_c = F.least(F.floor(row), g["ny"] - 2).cast("long"), F.least(F.floor(col), g["nx"] - 2).cast("long")
    fr, fc = row - low_r, col - low_c
    corners = F.array(
        *[
            F.struct((low_r + i).alias("row"), (low_c + j).alias("col"), ((fr if i else 1.0 - fr) * (fc if j else 1.0 - fc)).alias("w"))
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    asked = points.where(inside).select("pid", *keys, F.explode(corners).alias("k")).select("pid", *keys, "k.row", "k.col", "k.w").where("w <> 0")
    found = asked.join(cells.select(*keys, "row", "col", "z"), [*keys, "row", "col"], "left")
    value = found.groupBy("pid").agg(F.sum(F.col("w") * F.col("z")).alias("value"), F.count(F.when(F.col("z").isNull(), 1)).alias("gaps"))
    return points.join(value.select("pid", F.when(F.col("gaps") == 0, F.col("value")).alias("value")), "pid", "left")


def gradient(cells: DataFrame, dx: float, dy: float, raster: str = "raster_id") -> DataFrame:
    """dz/dx and dz/dy: central differences, one-sided at the border, as windows along rows and columns."""

    def slope(line: str, order: str, d: float) -> Column:
        w = Window.partitionBy(raster, line).orderBy(order)
        before, after = F.lag("z").over(w), F.lead("z").over(w)
        return F.when(before.isNull(), (after - F.col("z")) / d).when(after.isNull(), (F.col("z") - before) / d).otherwise((after - before) / (2 * d))

    return cells.withColumn("dzdx", slope("row", "col", dx)).withColumn("dzdy", slope("col", "row", dy))


def hillshade(cells: DataFrame, dx: float, dy: float, azimuth: float = 315.0, altitude: float = 45.0, raster: str = "raster_id") -> DataFrame:
    """Light from a direction on the surface, rescaled to 0 .. 1 over each raster."""
    a, b = math.radians(90 - azimuth), math.radians(altitude)
    light = (math.cos(a) * math.cos(b), math.sin(a) * math.cos(b), math.sin(b))
    lit = gradient(cells, dx, dy, raster)
    norm = F.sqrt(F.col("dzdx") * F.col("dzdx") + F.col("dzdy") * F.col("dzdy") + 1.0)
    lit = lit.withColumn("shade", (-F.col("dzdx") * light[0] - F.col("dzdy") * light[1] + light[2]) / norm)
    ends = lit.groupBy(raster).agg(F.min("shade").alias("_a"), F.max("shade").alias("_b"))
    return lit.join(ends, raster).withColumn("shade", (F.col("shade") - F.col("_a")) / F.when(F.col("_b") > F.col("_a"), F.col("_b") - F.col("_a"))).drop("_a", "_b")


def maximum_filter(cells: DataFrame, radius: int, raster: str = "raster_id") -> DataFrame:
    """Greatest value in a square window, along rows and then along columns; cells need not be complete."""

    def along(df: DataFrame, axis: str, other: str) -> DataFrame:
        reach = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
        return df.withColumn("_k", reach).groupBy(raster, other, (F.col(axis) + F.col("_k")).alias(axis)).agg(F.max("z").alias("z"))

    wide = along(along(cells.select(raster, "row", "col", "z"), "col", "row"), "row", "col")
    return cells.drop("z").join(wide, [raster, "row", "col"])


def _spread(cells: DataFrame, axis: str, n: int, weights: list[float], raster: str) -> DataFrame:
    """One pass of a separable filter: every cell gives its weighted value to the cells it reaches; what falls beyond
    the border is mirrored back in."""
    radius = len(weights) // 2
    reach = F.array(*[F.struct(F.lit(k - radius).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    out = cells.withColumn("_r", F.explode(reach)).withColumn("_t", F.col(axis) + F.col("_r.k"))
    # A target beyond the border is the mirror of one inside; a cell near the border thus also gives through the mirror.
    other = "col" if axis == "row" else "row"
    direct = out.where((F.col("_t") >= 0) & (F.col("_t") < n))
    low = out.withColumn("_t", -1 - F.col(axis) - F.col("_r.k")).where((F.col("_t") >= 0) & (F.col("_t") < n))
    high = out.withColumn("_t", 2 * n - 1 - F.col(axis) - F.col("_r.k")).where((F.col("_t") >= 0) & (F.col("_t") < n))
    both = direct.unionByName(low).unionByName(high)
    return both.groupBy(raster, F.col("_t").alias(axis), other).agg(*[F.sum(F.col(c) * F.col("_r.w")).alias(c) for c in ("a", "m")])


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_filter(cells: DataFrame, sigma: float, nx: int, ny: int, raster: str = "raster_id", fill: bool = False) -> DataFrame:
    """Smoothed values; missing cells weigh nothing, and stay missing unless ``fill``."""
    weights = gaussian_weights(sigma)
    both = cells.select(raster, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.coalesce("z", F.lit(0.0)).alias("a"), F.col("z").isNotNull().cast("double").alias("m"))
    out = _spread(_spread(both, "row", ny, weights, raster), "col", nx, weights, raster)
    out = out.select(raster, "row", "col", (F.col("a") / F.when(F.col("m") > 1e-12, F.col("m"))).alias("smooth"))
    keep = cells.select(raster, "row", "col", F.col("z").alias("_z"))
    return out.join(keep, [raster, "row", "col"], "right").select(raster, "row", "col", (F.col("smooth") if fill else F.when(F.col("_z").isNotNull(), F.col("smooth"))).alias("z"))


def median_highpass(cells: DataFrame, radius: int = 2, raster: str = "raster_id") -> DataFrame:
    """Value minus the median of the square window around it (cut at the border)."""
    k = F.sequence(F.lit(-radius), F.lit(radius))
    near = cells.withColumn("_i", F.explode(k)).withColumn("_j", F.explode(k)).select(raster, (F.col("row") + F.col("_i")).alias("row"), (F.col("col") + F.col("_j")).alias("col"), F.col("z").alias("_n"))
    medians = near.groupBy(raster, "row", "col").agg(F.median("_n").alias("_m"))
    return cells.join(medians, [raster, "row", "col"]).withColumn("z", F.col("z") - F.col("_m")).drop("_m")


def interpolate(before: DataFrame, after: DataFrame, share: Column, gap: Column) -> DataFrame:
    """Cells between two rasters (row, col, z, s): linear mean and the sigma that grows with the distance in time.

    ``share`` is where between the two the instant lies, ``gap`` its distance to the nearer one in units of theirs."""
    b = after.select("row", "col", F.col("z").alias("z1"), F.col("s").alias("s1"))
    dz = F.col("z1") - F.col("z")
    z = F.col("z") + dz * share
    var = F.col("s") * F.col("s") + share * share * (F.col("s") * F.col("s") + F.col("s1") * F.col("s1")) + F.pow(dz * gap / 3.0, F.lit(2.0))
    return before.join(b, ["row", "col"]).select("row", "col", z.alias("z"), F.sqrt(var).alias("s"))


def resample(cells: DataFrame, source: R.Grid, target: R.Grid, nx: int, ny: int, raster: str = "raster_id") -> DataFrame:
    """Values of each raster at the cell centres of another grid."""
    spark = cells.sparkSession
    t = spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("long").alias("trow"), (F.col("id") % nx).alias("tcol"), F.col("id").alias("pid"))
    x, y = R.centre(target, F.col("trow"), F.col("tcol"))
    t = t.crossJoin(cells.select(raster).distinct()).withColumn("pid", F.struct("pid", raster))
    out = sample(t.withColumns({"x": x, "y": y}), cells, source, keys=[raster])
    return out.select(raster, F.col("trow").alias("row"), F.col("tcol").alias("col"), F.col("value").alias("z"))


def fill_circles(cells: DataFrame, circles: DataFrame, value: float, raster: str = "raster_id") -> DataFrame:
    """``cells`` with the insides of circles (raster, x, y, r in cells) set to a value: of each row what lies between the
    outermost cells of the rasterised circle."""
    ring = bresenham_circles(circles.select(F.struct(raster, "x", "y", "r").alias("k"), "x", "y", "r"))
    rows = ring.groupBy("k", "y").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    filled = rows.select(F.col(f"k.{raster}").alias(raster), F.col("y").cast("long").alias("row"), F.explode(F.sequence(F.col("low").cast("long"), F.col("high").cast("long"))).alias("col")).distinct()
    return cells.join(filled.withColumn("_in", F.lit(True)), [raster, "row", "col"], "left").withColumn("z", F.when(F.col("_in"), F.lit(value)).otherwise(F.col("z"))).drop("_in")


def polygon_mask(cells: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (x, y) inside polygons (edges xa, ya, xb, yb; holes are further rings), by the parity of crossings.

    An edge meets only the rows of cells between its ends, through an equi-join on the row number."""
    ring = edges.where("ya <> yb").withColumn("row", F.explode(F.sequence(F.col("row_a"), F.col("row_b"))))
    met = cells.join(ring, "row").where((F.least("ya", "yb") <= F.col("y")) & (F.col("y") < F.greatest("ya", "yb")))
    at = F.col("xa") + (F.col("y") - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))
    inside = met.where(at > F.col("x")).groupBy(*keys, "row", "col").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return inside.drop("n")


def horizon(cells: DataFrame, rays: DataFrame, height: float, raster: str = "raster_id") -> DataFrame:
    """For each raster and ray (ray, t, row, col, distance from the eye; t = 0 is the eye) the first cell with the greatest slope seen
    from ``height`` above the origin cell; none if no valid cell lies behind it."""
    seen = rays.join(cells.select(raster, "row", "col", "z"), ["row", "col"])
    eye = seen.where("t = 0").select(raster, "ray", (F.col("z") + height).alias("eye"))
    slope = (F.col("z") - F.col("eye")) / F.col("distance")
    out = seen.where("t > 0").join(eye, [raster, "ray"]).where("z IS NOT NULL").withColumn("slope", slope)
    best = out.groupBy(raster, "ray").agg(F.max(F.struct(F.col("slope"), (-F.col("t")).alias("back"), "row", "col")).alias("b"), F.max("t").alias("last"))
    return best.where("-b.back < last").select(raster, "ray", F.col("b.row").alias("row"), F.col("b.col").alias("col"), F.col("b.slope").alias("slope"))


def visible_along_rays(cells: DataFrame, rays: DataFrame, height: float, raster: str = "raster_id") -> DataFrame:
    """Cells of each raster whose slope from the eye exceeds that of all nearer cells of their ray: a viewshed by rays, which spreads over
    the cluster.  (``viewshed_rings`` is the ring-by-ring discretisation.)"""
    seen = rays.join(cells.select(raster, "row", "col", "z"), ["row", "col"])
    eye = seen.where("t = 0").select(raster, "ray", (F.col("z") + height).alias("eye"))
    out = seen.where("t > 0").join(eye, [raster, "ray"]).withColumn("slope", (F.col("z") - F.col("eye")) / F.col("distance"))
    before = F.max("slope").over(Window.partitionBy(raster, "ray").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("_b", before).where("_b IS NULL OR slope > _b").select(raster, "row", "col").distinct()


def viewshed_rings(cells: DataFrame, d: float, raster: str = "raster_id") -> DataFrame:
    """Visibility from an eye (columns eye_row, eye_col, eye_z of each raster): cells in rings of one cell's width, each
    compared with the greatest slope so far, interpolated by heading on the ring before.

    Ring follows ring, so a raster is one group; rasters spread over the cluster."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        dr, dc = pdf["row"] - pdf["eye_row"], pdf["col"] - pdf["eye_col"]
        dist = np.hypot(dr, dc).to_numpy() * d
        heading = np.arctan2(dr, dc).to_numpy()
        ring = (dist / d + 0.5).astype(int)
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (pdf["z"] - pdf["eye_z"]).to_numpy(float) / dist
        order = np.lexsort((heading, ring))
        seen = np.zeros(len(pdf), bool)
        top_h = top_s = None
        for k in range(1, int(ring.max(initial=0)) + 1):
            mine = order[np.searchsorted(ring[order], k) : np.searchsorted(ring[order], k, "right")]
            mine = mine[~np.isnan(slope[mine])]
            if not len(mine):
                continue
            if top_h is None:
                seen[mine] = True
                top_s = slope[mine]
            else:
                before = np.interp(heading[mine], top_h, top_s, period=2 * np.pi)
                seen[mine] = slope[mine] > before
                top_s = np.maximum(slope[mine], before)
            top_h = heading[mine]
        return pd.DataFrame({raster: pdf[raster], "row": pdf["row"], "col": pdf["col"], "visible": seen})

    return cells.groupBy(raster).applyInPandas(run, f"{raster} long, row long, col long, visible boolean")


def tiles(cells: DataFrame, size: tuple[int, int], overlap: int, nx: int, ny: int) -> DataFrame:
    """Cells with every tile (tile_row, tile_col) they belong to; tiles share ``overlap`` cells with those behind them.

    ``size`` is rows and columns of a tile."""

    def of(axis: str, n: int, step: int) -> Column:
        last = max(0, math.ceil(n / step) - 1)
        own = F.least(F.floor(F.col(axis) / step), F.lit(last)).cast("long")
        extends = (F.pmod(F.col(axis), F.lit(step)) < overlap) & (own > 0)
        return F.when(extends, F.array(own, own - 1)).otherwise(F.array(own))

    return cells.withColumn("tile_row", F.explode(of("row", ny, size[0]))).withColumn("tile_col", F.explode(of("col", nx, size[1])))


def squared_differences(image: DataFrame, template: DataFrame, height: int, width: int) -> DataFrame:
    """Mean squared difference of a template (trow, tcol, t) laid at every place (row, col) of an image where it fits."""
    met = image.crossJoin(template).withColumns({"r0": F.col("row") - F.col("trow"), "c0": F.col("col") - F.col("tcol")})
    sums = met.groupBy("image_id", F.col("r0").alias("row"), F.col("c0").alias("col")).agg(F.sum(F.pow(F.col("z") - F.col("t"), F.lit(2.0))).alias("s"), F.count("*").alias("n"))
    return sums.where(F.col("n") == height * width).select("image_id", "row", "col", (F.col("s") / (height * width)).alias("sse"))
