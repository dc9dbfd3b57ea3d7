"""Lines: integer lines and circles, lengths, interpolation, clipping, runs of a mask.

A line's vertices are rows; windows run within a line, so lines spread over the cluster and a line's own vertices are the
unit of work, as they are of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions import geometry as G


def bresenham_lines(lines: DataFrame, key: str) -> DataFrame:
    """Cells between (x0, y0) and (x1, y1), in closed form: t steps along the longer axis."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    flat = F.abs(dx) >= F.abs(dy)
    major = F.when(flat, F.abs(dx)).otherwise(F.abs(dy))
    cells = lines.withColumns({"_major": major, "_minor": F.when(flat, dy).otherwise(dx), "_flat": flat}).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_major"))))
    along = F.col("t") * F.when(F.when(F.col("_flat"), dx).otherwise(dy) < 0, -1).otherwise(1)
    across = G.minor_offset(F.col("t"), F.col("_major"), F.col("_minor"))
    x = F.col("x0") + F.when(F.col("_flat"), along).otherwise(across)
    y = F.col("y0") + F.when(F.col("_flat"), across).otherwise(along)
    return cells.select(key, "t", x.cast("long").alias("x"), y.cast("long").alias("y"))


def bresenham_circles(circles: DataFrame) -> DataFrame:
    """Cells of the ring of radius r around (x, y), each once: k, x, y.

    The midpoint rule keeps, i steps along one axis, the greatest j with i*i + j*j - j <= r*r on the other; an octant has
    (sqrt(2) * (r - 1) + 4) / 2 steps, rounded down."""
    r = F.col("r")
    size = F.floor((F.sqrt(F.lit(2.0)) * (r - 1) + 4) / 2).cast("int")
    steps = circles.withColumn("i", F.explode(F.sequence(F.lit(0), size - 1)))
    steps = steps.withColumn("j", F.floor(0.5 + F.sqrt(r * r - F.col("i") * F.col("i") + 0.25)).cast("int"))
    around = F.array(*[F.struct((sa * F.col(a)).alias("dx"), (sb * F.col(b)).alias("dy")) for a, b in (("i", "j"), ("j", "i")) for sa in (1, -1) for sb in (1, -1)])
    return steps.select("k", "x", "y", F.explode(around).alias("d")).select("k", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y")).distinct()


def cumulative_length(vertices: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.coalesce(G.distance([F.col("x"), F.col("y")], [F.lag("x").over(w), F.lag("y").over(w)]), F.lit(0.0))
    return vertices.withColumn("_step", step).withColumn("s", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def interpolate_lines(vertices: DataFrame, keys: list[str], order: list[str], every: float) -> DataFrame:
    """Points at multiples of ``every`` along each line: ``at``, x, y.  Each edge makes its own points; nothing is joined."""
    w = Window.partitionBy(*keys).orderBy(*order)
    edges = cumulative_length(vertices, keys, order).withColumns({"_s": F.lead("s").over(w), "_x": F.lead("x").over(w), "_y": F.lead("y").over(w)}).where("_s > s")
    first, last = F.ceil(F.col("s") / every), F.ceil(F.col("_s") / every) - 1
    points = edges.where(last >= first).withColumn("_k", F.explode(F.sequence(first, last)))
    t = (F.col("_k") * every - F.col("s")) / (F.col("_s") - F.col("s"))
    return points.select(*keys, (F.col("_k") * every).alias("at"), (F.col("x") + (F.col("_x") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("_y") - F.col("y")) * t).alias("y"))


def clip_lines(vertices: DataFrame, keys: list[str], order: list[str], xlim: tuple[float, float], ylim: tuple[float, float]) -> DataFrame:
    """The part of each edge inside the box, from (xa, ya) to (xb, yb); ``vid`` is the edge's first vertex."""
    w = Window.partitionBy(*keys).orderBy(*order)
    edges = vertices.withColumns({"_x": F.lead("x").over(w), "_y": F.lead("y").over(w)}).where("_x IS NOT NULL")
    box = [tuple(map(F.lit, xlim)), tuple(map(F.lit, ylim))]
    t0, t1 = G.ray_box([F.col("x"), F.col("y")], [F.col("_x") - F.col("x"), F.col("_y") - F.col("y")], box)
    edges = edges.withColumns({"_a": F.greatest(t0, F.lit(0.0)), "_b": F.least(t1, F.lit(1.0)), "_hit": t0.isNotNull()}).where("_hit AND _a < _b")

    def at(t: str) -> list[Column]:
        return [F.col(c) + (F.col(f"_{c}") - F.col(c)) * F.col(t) for c in "xy"]

    (xa, ya), (xb, yb) = at("_a"), at("_b")
    return edges.select(*keys, "vid", xa.alias("xa"), ya.alias("ya"), xb.alias("xb"), yb.alias("yb"))


def scale_between(w: Column, h: Column, new_w: Column, new_h: Column) -> Column:
    """A scale that rounds both sizes to the new ones: the middle of the intervals' intersection, NULL if it is empty."""
    low = F.greatest((new_w - 0.5) / w, (new_h - 0.5) / h)
    high = F.least((new_w + 0.5) / w, (new_h + 0.5) / h)
    return F.when(low < high, (low + high) / 2.0)


def nearest_vertex(points: DataFrame, ident: str, lines: DataFrame, key: str) -> DataFrame:
    """Distance ``d`` of each point (ident, u, v) to the nearest vertex of each line: ident, key, d.

    Lines (key, x, y) are a dimension, such as one a camera, and are held whole; points meet them in Arrow batches, so that no
    row is made of a point and a vertex."""
    own = lines.where("x IS NOT NULL AND y IS NOT NULL").select(key, "x", "y").toPandas()
    held = [(k, g["x"].to_numpy(float), g["y"].to_numpy(float)) for k, g in own.groupby(key, sort=True)]
    schema = T.StructType([points.schema[ident], lines.schema[key], T.StructField("d", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            u, v = pdf["u"].to_numpy(float), pdf["v"].to_numpy(float)
            for k, x, y in held:
                d = np.empty(len(u))
                step = max(1, (1 << 18) // len(x))
                for at in range(0, len(u), step):
                    dx, dy = u[at : at + step, None] - x, v[at : at + step, None] - y
                    d[at : at + step] = np.sqrt((dx * dx + dy * dy).min(axis=1))
                yield pd.DataFrame({ident: pdf[ident], key: k, "d": d})

    return points.select(ident, "u", "v").mapInPandas(run, schema)


def mask_runs(rows: DataFrame, keys: list[str], order: list[str], mask: str, bucket: Column | None = None) -> DataFrame:
    """Rows with the number of the run of equal mask values they are in, from 0.

    ``bucket`` grows with the order; with it windows run inside buckets, and over one row a bucket, which says where the
    bucket's first run goes on with the last one before it."""
    marked = rows.withColumn("_b", F.lit(0) if bucket is None else bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    change = F.when(F.col(mask).eqNullSafe(F.lag(mask).over(w)) | (F.row_number().over(w) == 1), 0).otherwise(1)
    inside = marked.withColumn("_change", change).withColumn("_run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if bucket is None:
        return inside.withColumn("run", F.col("_run")).drop("_b", "_change", "_run")
    value = F.struct(F.struct(*order).alias("o"), F.col(mask).alias("m"))
    ends = inside.groupBy(*keys, "_b").agg(F.sum("_change").alias("_n"), F.min_by(value, value["o"])["m"].alias("_first"), F.max_by(value, value["o"])["m"].alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_b")
    anew = F.when(F.col("_first").eqNullSafe(F.lag("_last").over(over)) | (F.row_number().over(over) == 1), 0).otherwise(1)
    ends = ends.withColumn("_anew", anew)
    before = F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("_anew").over(over.rowsBetween(Window.unboundedPreceding, 0))
    starts = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_bb"), before.alias("_start"))
    same = F.col("_b").eqNullSafe(F.col("_bb"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return inside.join(starts, same).withColumn("run", F.col("_start") + F.col("_run")).drop("_b", "_bb", "_change", "_run", "_start", *[f"_{k}" for k in keys])
