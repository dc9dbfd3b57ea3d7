"""The parts that the synthetic tables play in the queries, as DataFrames and as SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """Rows dealt out anew, before much work on each: a small table lies in one or two splits, which would be all the tasks.

    As many parts as there are cores, by number: adaptive execution would join small ones into one again."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *key)


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + 0.0


def rounded(c: Column, digits: int) -> Column:
    """As ``r6``, for many doubles: worked out as SQL does, round(c * m) / m with halves away from zero, not by way of decimal
    digits, which takes some ten times as long.  ``c`` is named several times, so it should be a column or cheap."""
    m = 10.0**digits
    y = c * m
    r = F.rint(y)
    return F.when(F.abs(y) < math.inf, F.when(F.abs(y - r) == 0.5, y + F.signum(y) * 0.5).otherwise(r) / m).otherwise(c) + 0.0


def sql6(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def cameras(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    """Five cameras, one for each region: the first has k1 alone, the others all kinds of distortion."""
    k = F.col("r_regionkey").cast("double")
    values = {
        "x": -60.0 + 5.0 * k, "y": -20.0 + 3.0 * k, "z": 2.0 + k, "yaw": 75.0 + 4.0 * k, "pitch": -3.0 + k, "roll": -2.0 + k,
        "nx": F.lit(400.0), "ny": F.lit(300.0), "fx": 300.0 + 10.0 * k, "fy": 310.0 + 10.0 * k, "cx": 1.5 * k, "cy": -1.0 * k,
        "k1": -0.05 + 0.02 * k, "k2": 0.01 * k, "k3": 0.002 * k, "k4": 0.005 * k, "k5": 0.001 * k, "k6": 0.0005 * k, "p1": 0.001 * k, "p2": -0.002 * k,
    }
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("cam_id"), *[v.alias(prefix + n) for n, v in values.items()])


#: CTEs: cam (the cameras), rot (with r11 .. r33).
CAM = """cam AS (SELECT r_regionkey AS cam_id, -60.0::DOUBLE + 5.0 * r_regionkey AS x, -20.0::DOUBLE + 3.0 * r_regionkey AS y, 2.0::DOUBLE + r_regionkey AS z,
  75.0::DOUBLE + 4.0 * r_regionkey AS yaw, -3.0::DOUBLE + r_regionkey AS pitch, -2.0::DOUBLE + r_regionkey AS roll, 400.0::DOUBLE AS nx, 300.0::DOUBLE AS ny,
  300.0::DOUBLE + 10.0 * r_regionkey AS fx, 310.0::DOUBLE + 10.0 * r_regionkey AS fy, 1.5::DOUBLE * r_regionkey AS cx, -1.0::DOUBLE * r_regionkey AS cy,
  -0.05::DOUBLE + 0.02::DOUBLE * r_regionkey AS k1, 0.01::DOUBLE * r_regionkey AS k2, 0.002::DOUBLE * r_regionkey AS k3, 0.005::DOUBLE * r_regionkey AS k4, 0.001::DOUBLE * r_regionkey AS k5,
  0.0005::DOUBLE * r_regionkey AS k6, 0.001::DOUBLE * r_regionkey AS p1, -0.002::DOUBLE * r_regionkey AS p2 FROM region),
trig AS (SELECT *, cos(radians(yaw)) AS ca, sin(radians(yaw)) AS sa, cos(radians(pitch)) AS cb, sin(radians(pitch)) AS sb, cos(radians(roll)) AS cc, sin(radians(roll)) AS sc FROM cam),
rot AS (SELECT *, ca * cc + sa * sb * sc AS r11, ca * sb * sc - cc * sa AS r12, -cb * sc AS r13, cc * sa * sb - ca * sc AS r21, sa * sc + ca * cc * sb AS r22, -cb * cc AS r23,
  cb * sa AS r31, ca * cb AS r32, sb AS r33 FROM trig)"""


def world_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points: ok, ln, px, py, pz."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"),
        (F.col("l_extendedprice") / 1000.0 - 50.0).alias("px"), (F.col("l_quantity") - 25.0).alias("py"), (F.col("l_discount") * 100.0 - 5.0).alias("pz"),
    )


PTS = "pts AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_extendedprice / 1000.0::DOUBLE - 50.0::DOUBLE AS px, l_quantity - 25.0::DOUBLE AS py, l_discount * 100.0::DOUBLE - 5.0::DOUBLE AS pz FROM lineitem)"


def image_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as image points: pk, u, v."""
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), (F.col("p_retailprice") * 4.0 - 3600.0).alias("u"), (F.col("p_size") * 5.5).alias("v"))
    return spread(points, "pk", "u", "v")


UVS = "uvs AS (SELECT p_partkey AS pk, p_retailprice * 4.0::DOUBLE - 3600.0::DOUBLE AS u, p_size * 5.5::DOUBLE AS v FROM part)"

#: CTEs over CAM and PTS: in camera axes (a, b, c), normalised (xx, yy), distorted (dx, dy), pixels (u, v).
PROJECTED = f"""{CAM}, {PTS},
axes AS (SELECT ok, ln, px, py, pz, rot.*, r11 * (px - x) + r12 * (py - y) + r13 * (pz - z) AS a, r21 * (px - x) + r22 * (py - y) + r23 * (pz - z) AS b,
  r31 * (px - x) + r32 * (py - y) + r33 * (pz - z) AS c FROM pts, rot),
norm AS (SELECT *, a / c AS xx, b / c AS yy, a / c * (a / c) + b / c * (b / c) AS r2 FROM axes WHERE c > 0 AND abs(a) < c AND abs(b) < c),
bent AS (SELECT *, xx * (1 + r2 * (k1 + r2 * (k2 + r2 * k3))) / (1 + r2 * (k4 + r2 * (k5 + r2 * k6))) + 2 * xx * yy * p1 + p2 * (r2 + 2 * xx * xx) AS dx,
  yy * (1 + r2 * (k1 + r2 * (k2 + r2 * k3))) / (1 + r2 * (k4 + r2 * (k5 + r2 * k6))) + p1 * (r2 + 2 * yy * yy) + 2 * xx * yy * p2 AS dy FROM norm),
pix AS (SELECT *, dx * fx + nx / 2 + cx AS u, dy * fy + ny / 2 + cy AS v FROM bent)"""
