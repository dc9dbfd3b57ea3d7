"""Raster queries.  The surface is the mean price of line items in 50 x 11 cells of quantity and discount, for each return
flag; rasters over time are its sums for each year."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import grid as R
from ..operators import rasters as O
from .roles import r6, sql6, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


NX, NY = 50, 11
GRID = R.of(NX, NY, (0.0, 100.0), (33.0, 0.0))  # cells 2 wide and -3 high
C = """means AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS k, round(l_discount * 100)::BIGINT AS r, (l_quantity - 1)::BIGINT AS c, round(avg(l_extendedprice) / 1000 + 0.000000012::DOUBLE, 6) AS m FROM lineitem GROUP BY ALL),
cells AS (SELECT i // 550 AS raster_id, i % 550 // 50 AS row, i % 50 AS col, coalesce(m, 30.0::DOUBLE) AS z FROM range(0, 1650) t(i) LEFT JOIN means ON k = i // 550 AND r = i % 550 // 50 AND c = i % 50)"""


def cells(spark, sf):
    """Mean prices, 30 where there are none.  The small number added keeps halves from being rounded either way by the
    last bit of a sum."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    t = table(spark, sf, "lineitem")
    t = t.groupBy(flag.cast("long").alias("raster_id"), F.round(F.col("l_discount") * 100).cast("long").alias("row"), (F.col("l_quantity") - 1).cast("long").alias("col"))
    means = t.agg(F.round(F.avg("l_extendedprice") / 1000 + 0.000000012, 6).alias("z"))
    lattice = spark.range(1650).select(F.expr("id div 550").alias("raster_id"), F.expr("id % 550 div 50").alias("row"), (F.col("id") % 50).alias("col"))
    return lattice.join(means, ["raster_id", "row", "col"], "left").withColumn("z", F.coalesce("z", F.lit(30.0)))


def _out(df, names=("z",), digits=6):
    return df.select("raster_id", "row", "col", *[r6(F.col(n), digits).alias(n) for n in names])


@query("SELECT floor(l_quantity / 5)::BIGINT AS row, floor(round(l_discount * 100))::BIGINT AS col, " + sql6("avg(l_extendedprice)", 7) + " AS price, " + sql6("avg(l_tax)") + " AS tax, count(*) AS n FROM lineitem GROUP BY ALL")
def rasterize_points(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).alias("row"), F.floor(F.round(F.col("l_discount") * 100)).cast("long").alias("col"))
    return t.agg(r6(F.avg("l_extendedprice"), 7).alias("price"), r6(F.avg("l_tax")).alias("tax"), F.count("*").alias("n"))


@query(f"WITH {C}, p AS (SELECT p_size % 11 AS row, p_partkey % 50 AS col, avg(p_retailprice) AS m FROM part GROUP BY ALL) SELECT raster_id, c.row, c.col, {sql6('coalesce(p.m, z)', 7)} AS z FROM cells c LEFT JOIN p ON p.row = c.row AND p.col = c.col")
def raster_rasterize(spark, sf):
    """Points burnt into an existing raster: the mean where there are points, the old value elsewhere."""
    p = table(spark, sf, "part").groupBy((F.col("p_size") % 11).cast("long").alias("row"), (F.col("p_partkey") % 50).alias("col")).agg(F.avg("p_retailprice").alias("m"))
    return _out(cells(spark, sf).join(p, ["row", "col"], "left").withColumn("z", F.coalesce("m", "z")), digits=7)


@query(f"WITH {C} SELECT raster_id, min(z) AS z0, max(z) AS z1 FROM cells GROUP BY 1")
def raster_zlim(spark, sf):
    return cells(spark, sf).groupBy("raster_id").agg(F.min("z").alias("z0"), F.max("z").alias("z1"))


@query(f"WITH {C} SELECT row, col, {sql6('avg(z)')} AS z FROM cells GROUP BY ALL HAVING count(*) = 3")
def average_rasters(spark, sf):
    m = cells(spark, sf).groupBy("row", "col").agg(F.avg("z").alias("z"), F.count("*").alias("k")).where("k = 3")
    return m.select("row", "col", r6(F.col("z")).alias("z"))


@query(f"WITH {C} SELECT raster_id, row, col, CASE WHEN z BETWEEN 20 AND 32 THEN z END AS z FROM cells WHERE row BETWEEN 2 AND 7 AND col BETWEEN 10 AND 29")
def raster_crop(spark, sf):
    c = R.cropped(GRID, F.lit(20.0), F.lit(60.0), F.lit(9.0), F.lit(27.0))
    kept = cells(spark, sf).where((F.col("row") >= c["row0"]) & (F.col("row") < c["row1"]) & (F.col("col") >= c["col0"]) & (F.col("col") < c["col1"]))
    return kept.select("raster_id", "row", "col", F.when(F.col("z").between(20, 32), F.col("z")).alias("z"))


@query(f"WITH {C} SELECT raster_id, (row - 1) // 2 AS row, (col - 5) // 3 AS col, z FROM cells WHERE row >= 1 AND (row - 1) % 2 = 0 AND col BETWEEN 5 AND 39 AND (col - 5) % 3 = 0")
def raster_getitem(spark, sf):
    """Every second row from 1, every third column from 5 to 39."""
    kept = cells(spark, sf).where("row >= 1 AND pmod(row - 1, 2) = 0 AND col BETWEEN 5 AND 39 AND pmod(col - 5, 3) = 0")
    return kept.select("raster_id", F.expr("(row - 1) div 2").alias("row"), F.expr("(col - 5) div 3").alias("col"), "z")


@query(f"WITH {C} SELECT raster_id, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM cells WHERE z > 34 GROUP BY 1")
def filter_valid_nan(spark, sf):
    """Extent of the cells that have data."""
    d = cells(spark, sf).withColumn("z", F.when(F.col("z") > 34, F.col("z"))).where("z IS NOT NULL")
    return d.groupBy("raster_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))


_SP = "pt AS (SELECT p_partkey AS pid, p_retailprice - 900.0::DOUBLE AS x, p_size * 0.65::DOUBLE AS y FROM part)"


def sample_points(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("pid"), (F.col("p_retailprice") - 900.0).alias("x"), (F.col("p_size") * 0.65).alias("y"))


def _everywhere(spark, sf):
    """The sample points in every raster."""
    rasters = cells(spark, sf).select("raster_id").distinct()
    p = sample_points(spark, sf).crossJoin(rasters)
    return p.withColumns({"part": F.col("pid"), "pid": F.struct("pid", "raster_id")})


@query(
    f"""WITH {C}, {_SP}, rc AS (SELECT pid, (33 - y) / 3 - 0.5 AS r, x / 2 - 0.5 AS c FROM pt), lo AS (SELECT *, least(floor(r), 9)::BIGINT AS r0, least(floor(c), 48)::BIGINT AS c0 FROM rc WHERE r >= 0 AND c >= 0 AND r <= 10 AND c <= 49),
o AS (SELECT * FROM cells), v AS (SELECT pid, a.raster_id, (1 - (r - r0)) * (1 - (c - c0)) * a.z + (1 - (r - r0)) * (c - c0) * b.z + (r - r0) * (1 - (c - c0)) * d.z + (r - r0) * (c - c0) * e.z AS value
  FROM lo JOIN o a ON a.row = r0 AND a.col = c0 JOIN o b ON b.raster_id = a.raster_id AND b.row = r0 AND b.col = c0 + 1 JOIN o d ON d.raster_id = a.raster_id AND d.row = r0 + 1 AND d.col = c0 JOIN o e ON e.raster_id = a.raster_id AND e.row = r0 + 1 AND e.col = c0 + 1)
SELECT raster_id, pid, {sql6('value', 11)} AS value FROM pt CROSS JOIN (SELECT DISTINCT raster_id FROM cells) LEFT JOIN v USING (pid, raster_id)"""
)
def raster_sample(spark, sf):
    return O.sample(_everywhere(spark, sf), cells(spark, sf), GRID, keys=["raster_id"]).select("raster_id", F.col("part").alias("pid"), r6(F.col("value"), 11).alias("value"))


@query(f"WITH {C}, {_SP} SELECT r.raster_id, pid, z AS value FROM pt CROSS JOIN (SELECT DISTINCT raster_id FROM cells) r LEFT JOIN cells ON cells.raster_id = r.raster_id AND row = least(floor((33 - y) / 3), 10) AND col = least(floor(x / 2), 49)")
def raster_sample_nearest(spark, sf):
    return O.sample(_everywhere(spark, sf), cells(spark, sf), GRID, order=0, keys=["raster_id"]).select("raster_id", F.col("part").alias("pid"), "value")


_RES = f"""{C}, o AS (SELECT * FROM cells), t AS (SELECT r AS row, c AS col, (33 - (24 - (r + 0.5::DOUBLE) * 1.5)) / 3 - 0.5 AS fr, (10 + (c + 0.5::DOUBLE) * 2.5) / 2 - 0.5 AS fc FROM range(0, 8) a(r), range(0, 24) b(c)),
lo AS (SELECT *, floor(fr)::BIGINT AS r0, floor(fc)::BIGINT AS c0 FROM t)
SELECT a.raster_id, lo.row, lo.col, {sql6('(1 - (fr - r0)) * (1 - (fc - c0)) * a.z + (1 - (fr - r0)) * (fc - c0) * b.z + (fr - r0) * (1 - (fc - c0)) * d.z + (fr - r0) * (fc - c0) * e.z', 11)} AS z
FROM lo JOIN o a ON a.row = r0 AND a.col = c0 JOIN o b ON b.raster_id = a.raster_id AND b.row = r0 AND b.col = c0 + 1 JOIN o d ON d.raster_id = a.raster_id AND d.row = r0 + 1 AND d.col = c0 JOIN o e ON e.raster_id = a.raster_id AND e.row = r0 + 1 AND e.col = c0 + 1"""


@query(f"WITH {_RES}")
def raster_resample(spark, sf):
    target = R.of(24, 8, (10.0, 70.0), (24.0, 12.0))
    return O.resample(cells(spark, sf), GRID, target, 24, 8).select("raster_id", "row", "col", r6(F.col("z"), 11).alias("z"))


@query(
    f"""WITH {C}, o AS (SELECT * FROM cells), t AS (SELECT r AS row, c AS col, (r + 0.5::DOUBLE) * 11 / 22 - 0.5 AS fr, (c + 0.5::DOUBLE) * 50 / 100 - 0.5 AS fc FROM range(0, 22) a(r), range(0, 100) b(c)),
lo AS (SELECT *, least(floor(fr), 9)::BIGINT AS r0, least(floor(fc), 48)::BIGINT AS c0 FROM t WHERE fr >= 0 AND fr <= 10 AND fc >= 0 AND fc <= 49),
v AS (SELECT a.raster_id, lo.row, lo.col, (1 - (fr - r0)) * (1 - (fc - c0)) * a.z + (1 - (fr - r0)) * (fc - c0) * b.z + (fr - r0) * (1 - (fc - c0)) * d.z + (fr - r0) * (fc - c0) * e.z AS z
FROM lo JOIN o a ON a.row = r0 AND a.col = c0 JOIN o b ON b.raster_id = a.raster_id AND b.row = r0 AND b.col = c0 + 1 JOIN o d ON d.raster_id = a.raster_id AND d.row = r0 + 1 AND d.col = c0 JOIN o e ON e.raster_id = a.raster_id AND e.row = r0 + 1 AND e.col = c0 + 1)
SELECT raster_id, t.row, t.col, {sql6('z', 11)} AS z FROM t CROSS JOIN (SELECT DISTINCT raster_id FROM cells) LEFT JOIN v USING (raster_id, row, col)"""
)
def raster_resize(spark, sf):
    """Twice the size, bilinear; NULL outside the outermost centres."""
    return O.resample(cells(spark, sf), GRID, R.of(100, 22, (0.0, 100.0), (33.0, 0.0)), 100, 22).select("raster_id", "row", "col", r6(F.col("z"), 11).alias("z"))


@query(f"WITH {C} SELECT raster_id, row, col, (col + 0.5::DOUBLE) * 2 + 10 AS x, 33 - (row + 0.5::DOUBLE) * 3 - 4 AS y, {sql6('z + 100')} AS z FROM cells")
def raster_shift(spark, sf):
    x, y = R.centre(R.shifted(GRID, F.lit(10.0), F.lit(-4.0)), F.col("row"), F.col("col"))
    return cells(spark, sf).select("raster_id", "row", "col", x.alias("x"), y.alias("y"), r6(F.col("z") + 100).alias("z"))


_GRAD = f"""{C}, gr AS (SELECT *, CASE WHEN col = 0 THEN (lead(z) OVER h - z) / 2 WHEN col = 49 THEN (z - lag(z) OVER h) / 2 ELSE (lead(z) OVER h - lag(z) OVER h) / 4 END AS dzdx,
  CASE WHEN row = 0 THEN (lead(z) OVER v - z) / -3 WHEN row = 10 THEN (z - lag(z) OVER v) / -3 ELSE (lead(z) OVER v - lag(z) OVER v) / -6 END AS dzdy FROM cells WINDOW h AS (PARTITION BY raster_id, row ORDER BY col), v AS (PARTITION BY raster_id, col ORDER BY row))"""


@query(f"WITH {_GRAD} SELECT raster_id, row, col, {sql6('dzdx', 9)} AS dzdx, {sql6('dzdy', 9)} AS dzdy FROM gr")
def raster_gradient(spark, sf):
    return _out(O.gradient(cells(spark, sf), 2.0, -3.0), ("dzdx", "dzdy"), 9)


_L = (math.cos(math.radians(-225)) * math.cos(math.radians(45)), math.sin(math.radians(-225)) * math.cos(math.radians(45)), math.sin(math.radians(45)))


@query(f"WITH {_GRAD}, s AS (SELECT *, (-dzdx * {_L[0]!r}::DOUBLE - dzdy * {_L[1]!r}::DOUBLE + {_L[2]!r}::DOUBLE) / sqrt(dzdx * dzdx + dzdy * dzdy + 1) AS s FROM gr) SELECT raster_id, row, col, {sql6('(s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w)')} AS shade FROM s WINDOW w AS (PARTITION BY raster_id)")
def raster_hillshade(spark, sf):
    return _out(O.hillshade(cells(spark, sf), 2.0, -3.0), ("shade",))


@query(f"WITH {C} SELECT a.raster_id, a.row, a.col, max(b.z) AS z FROM cells a JOIN cells b ON a.raster_id = b.raster_id AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY ALL")
def maximum_filter(spark, sf):
    return cells(spark, sf).transform(lambda c: O.maximum_filter(c, 2)).select("raster_id", "row", "col", "z")


_W = O.gaussian_weights(1.5)
_WSQL = "wt AS (SELECT unnest(range(-6, 7)) AS k, unnest([" + ", ".join(f"{w!r}::DOUBLE" for w in _W) + "]) AS w)"
#: Direct convolution with mirrored borders; every seventh cell counts as missing.
_GAUSS = f"""{C}, {_WSQL}, mz AS (SELECT raster_id, row, col, CASE WHEN (row * 50 + col) % 7 <> 0 THEN z END AS z FROM cells),
r1 AS (SELECT raster_id, row, col, k, w, CASE WHEN row + k < 0 THEN -1 - (row + k) WHEN row + k > 10 THEN 21 - (row + k) ELSE row + k END AS rr FROM mz, wt),
v1 AS (SELECT r1.raster_id, r1.row, r1.col, sum(w * coalesce(mz.z, 0)) AS a, sum(w * (mz.z IS NOT NULL)::INT) AS m FROM r1 JOIN mz ON mz.raster_id = r1.raster_id AND mz.row = rr AND mz.col = r1.col GROUP BY ALL),
r2 AS (SELECT raster_id, row, col, k, w, CASE WHEN col + k < 0 THEN -1 - (col + k) WHEN col + k > 49 THEN 99 - (col + k) ELSE col + k END AS cc FROM mz, wt),
v2 AS (SELECT r2.raster_id, r2.row, r2.col, sum(w * a) AS a, sum(w * m) AS m FROM r2 JOIN v1 ON v1.raster_id = r2.raster_id AND v1.row = r2.row AND v1.col = cc GROUP BY ALL)"""


@query(f"WITH {_GAUSS} SELECT raster_id, row, col, CASE WHEN z IS NOT NULL THEN {sql6('a / m')} END AS z FROM v2 JOIN mz USING (raster_id, row, col)")
def gaussian_filter(spark, sf):
    holes = cells(spark, sf).withColumn("z", F.when((F.col("row") * 50 + F.col("col")) % 7 != 0, F.col("z")))
    return _out(O.gaussian_filter(holes, 1.5, NX, NY))


@query(f"WITH {_GAUSS.replace('CASE WHEN (row * 50 + col) % 7 <> 0 THEN z END AS z FROM cells', 'max(z) OVER (PARTITION BY raster_id, col ORDER BY row RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS z FROM (SELECT raster_id, row, col, max(z) OVER (PARTITION BY raster_id, row ORDER BY col RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS z FROM cells)')} SELECT raster_id, row, col, {sql6('a / m')} AS z FROM v2")
def fill_crevasses(spark, sf):
    """Maximum, then smoothed."""
    return _out(O.gaussian_filter(O.maximum_filter(cells(spark, sf), 1), 1.5, NX, NY))


@query(f"WITH {C} SELECT a.raster_id, a.row, a.col, {sql6('any_value(a.z) - median(b.z)', 9)} AS z FROM cells a JOIN cells b ON a.raster_id = b.raster_id AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY ALL")
def median_highpass(spark, sf):
    return _out(O.median_highpass(cells(spark, sf)), digits=9)


#: The rings of radius 4 around cells (row, col) = (5, 25), (1, 2) and (9, 48) as a fixed picture: half widths by row from the centre.
_DISC = "disc AS (SELECT * FROM (VALUES (-4, 2), (-3, 3), (-2, 4), (-1, 4), (0, 4), (1, 4), (2, 4), (3, 3), (4, 2)) t(d, half), (VALUES (0, 5, 25), (1, 1, 2), (2, 9, 48)) c(raster_id, r, k))"


@query(f"WITH {C}, {_DISC} SELECT cells.raster_id, cells.row, cells.col, CASE WHEN d IS NOT NULL THEN -1.0 ELSE z END AS z FROM cells LEFT JOIN disc ON cells.raster_id = disc.raster_id AND cells.row = r + d AND abs(cells.col - k) <= half")
def fill_circle(spark, sf):
    """A rasterised circle filled from border to border, in each raster another one; what leaves the raster is cut."""
    circles = spark.createDataFrame([(0, 25, 5, 4), (1, 2, 1, 4), (2, 48, 9, 4)], "raster_id long, x int, y int, r int")
    return O.fill_circles(cells(spark, sf), circles, -1.0).select("raster_id", "row", "col", "z")


@query(f"WITH {C}, t AS (SELECT *, unnest(CASE WHEN row % 4 < 1 AND row // 4 > 0 THEN [row // 4, row // 4 - 1] ELSE [row // 4] END) AS tr FROM cells) SELECT raster_id, row, col, tr AS tile_row, unnest(CASE WHEN col % 16 < 1 AND col // 16 > 0 THEN [col // 16, col // 16 - 1] ELSE [col // 16] END) AS tile_col FROM t")
def raster_tile_indices(spark, sf):
    return O.tiles(cells(spark, sf), (4, 16), 1, NX, NY).select("raster_id", "row", "col", "tile_row", "tile_col")


@query(f"WITH {C} SELECT raster_id, row, col, row - 3 AS r, col - 12 AS c, z FROM cells WHERE row >= 3 AND row < 8 AND col >= 12 AND col < 27")
def tile_extract(spark, sf):
    """The box of an image around a pixel, snapped to whole pixels."""
    box = R.snap_box(R.of(NX, NY, (0.0, 50.0), (0.0, 11.0)), F.lit(19.7), F.lit(5.4), F.lit(15.0), F.lit(5.0))
    c = cells(spark, sf).withColumns({n: v.cast("long") for n, v in box.items()}).where("row >= top AND row < bottom AND col >= left AND col < right")
    return c.select("raster_id", "row", "col", (F.col("row") - F.col("top")).alias("r"), (F.col("col") - F.col("left")).alias("c"), "z")


@query("SELECT p_partkey AS pk, CASE WHEN ok THEN l END AS \"left\", CASE WHEN ok THEN t END AS top FROM (SELECT *, l >= 0 AND t >= 0 AND l + 15 <= 400 AND t + 15 <= 300 AS ok FROM (SELECT p_partkey, floor(p_retailprice * 4.0::DOUBLE - 3600.0::DOUBLE - 7.5 + 0.5)::BIGINT AS l, floor(p_size * 5.5::DOUBLE - 7.5 + 0.5)::BIGINT AS t FROM part))")
def tile_box(spark, sf):
    box = R.snap_box(R.of(400, 300, (0.0, 400.0), (0.0, 300.0)), F.col("p_retailprice") * 4.0 - 3600.0, F.col("p_size") * 5.5, F.lit(15.0), F.lit(15.0))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), box["left"].cast("long").alias("left"), box["top"].cast("long").alias("top"))


_TS = "ts AS (SELECT (year(o_orderdate) - 1995)::BIGINT AS raster_id, o_custkey % 11 AS row, o_orderkey % 50 AS col, avg(o_totalprice) / 10000 AS z, 1.0::DOUBLE + (o_custkey % 11) * 0.1::DOUBLE AS s FROM orders GROUP BY ALL)"


@query(
    f"""WITH {_TS}, g AS (SELECT a.row, a.col, a.z AS z0, b.z AS z1, a.s AS s0, b.s AS s1 FROM ts a JOIN ts b ON a.row = b.row AND a.col = b.col WHERE a.raster_id = 2 AND b.raster_id = 3)
SELECT row, col, {sql6('z0 + (z1 - z0) * 0.3 + 0.000000011::DOUBLE')} AS z, {sql6('sqrt(s0 * s0 + 0.3 * 0.3 * (s0 * s0 + s1 * s1) + pow((z1 - z0) * 0.3 / 3, 2))')} AS s FROM g"""
)
def raster_interpolate(spark, sf):
    """Between the rasters of the third and fourth year, three tenths on."""
    o = table(spark, sf, "orders").groupBy((F.year("o_orderdate") - 1995).cast("long").alias("raster_id"), (F.col("o_custkey") % 11).alias("row"), (F.col("o_orderkey") % 50).alias("col"))
    o = o.agg((F.avg("o_totalprice") / 10000).alias("z")).withColumn("s", 1.0 + F.col("row") * 0.1)
    got = O.interpolate(o.where("raster_id = 2"), o.where("raster_id = 3"), F.lit(0.3), F.lit(0.3))
    return got.select("row", "col", r6(F.col("z") + 0.000000011).alias("z"), r6(F.col("s")).alias("s"))


_POLY = "poly AS (SELECT n_nationkey AS pid, 5.0::DOUBLE + n_nationkey * 3 AS x, 4.0::DOUBLE + n_regionkey * 5 AS y FROM nation), ring AS (SELECT pid, x AS xa, y AS ya, x + 18 AS xb, y + 3 AS yb FROM poly UNION ALL SELECT pid, x + 18, y + 3, x + 10, y + 12 FROM poly UNION ALL SELECT pid, x + 10, y + 12, x, y FROM poly UNION ALL SELECT pid, x + 8, y + 4, x + 11, y + 4 FROM poly UNION ALL SELECT pid, x + 11, y + 4, x + 11, y + 7 FROM poly UNION ALL SELECT pid, x + 11, y + 7, x + 8, y + 7 FROM poly UNION ALL SELECT pid, x + 8, y + 7, x + 8, y + 4 FROM poly)"


@query(
    f"""WITH {_POLY}, cc AS (SELECT r AS row, c AS col, (c + 0.5::DOUBLE) * 2 AS x, 33 - (r + 0.5::DOUBLE) * 3 AS y FROM range(0, 11) a(r), range(0, 50) b(c))
SELECT pid, row, col FROM cc JOIN ring ON least(ya, yb) <= cc.y AND cc.y < greatest(ya, yb) AND xa + (cc.y - ya) * (xb - xa) / (yb - ya) > cc.x GROUP BY ALL HAVING count(*) % 2 = 1"""
)
def polygon_mask(spark, sf):
    """Triangles with a square hole."""
    p = table(spark, sf, "nation").select(F.col("n_nationkey").alias("pid"), (5.0 + F.col("n_nationkey") * 3).alias("x"), (4.0 + F.col("n_regionkey") * 5).alias("y"))
    outer, hole = [(0, 0), (18, 3), (10, 12)], [(8, 4), (11, 4), (11, 7), (8, 7)]
    pairs = [(r[i], r[(i + 1) % len(r)]) for r in (outer, hole) for i in range(len(r))]
    edge = F.explode(F.array(*[F.struct(*[(F.col(c) + v).alias(n) for c, v, n in (("x", a[0], "xa"), ("y", a[1], "ya"), ("x", b[0], "xb"), ("y", b[1], "yb"))]) for a, b in pairs]))
    ring = p.select("pid", edge.alias("e")).select("pid", "e.*")
    low, high = R.rowcol(GRID, F.lit(1.0), F.greatest("ya", "yb"))[0], R.rowcol(GRID, F.lit(1.0), F.least("ya", "yb"))[0]
    ring = ring.withColumns({"row_a": F.greatest(F.floor(low), F.lit(0)).cast("long"), "row_b": F.least(F.ceil(high), F.lit(NY - 1)).cast("long")}).where("row_a <= row_b")
    c = spark.range(NX * NY).select(F.floor(F.col("id") / NX).cast("long").alias("row"), (F.col("id") % NX).alias("col"))
    x, y = R.centre(GRID, F.col("row"), F.col("col"))
    return O.polygon_mask(c.withColumns({"x": x, "y": y}), ring, ["pid"]).select("pid", "row", "col")


#: Rays to the right edge: from the cell in row 5, column 0 to each row of the last column, in steps of one column.
_RAY = "rays AS (SELECT r AS ray, t, floor(5 + (r - 5) * t / 49.0::DOUBLE + 0.5)::BIGINT AS row, t AS col, sqrt(pow(2 * t, 2) + pow(3 * (r - 5) * t / 49.0::DOUBLE, 2)) AS distance FROM range(0, 11) a(r), range(0, 50) b(t))"


def _rays(spark):
    t, r = F.col("t"), F.col("ray")
    g = spark.range(11 * 50).select(F.floor(F.col("id") / 50).cast("long").alias("ray"), (F.col("id") % 50).alias("t"))
    across = (r - 5) * t / 49.0
    return g.select("ray", "t", F.floor(5 + across + 0.5).cast("long").alias("row"), t.alias("col"), F.sqrt(F.pow(2.0 * t, F.lit(2.0)) + F.pow(3.0 * across, F.lit(2.0))).alias("distance"))


_SEEN = f"{C}, {_RAY}, eye AS (SELECT raster_id, z + 2 AS eye FROM cells WHERE row = 5 AND col = 0), sl AS (SELECT raster_id, ray, t, row, col, (z - eye) / distance AS slope FROM rays JOIN cells USING (row, col) JOIN eye USING (raster_id) WHERE t > 0)"


@query(f"WITH {_SEEN}, b AS (SELECT *, row_number() OVER (PARTITION BY raster_id, ray ORDER BY slope DESC, t) AS k, max(t) OVER (PARTITION BY raster_id, ray) AS last FROM sl) SELECT raster_id, ray, row, col, {sql6('slope')} AS slope FROM b WHERE k = 1 AND t < last")
def horizon(spark, sf):
    return O.horizon(cells(spark, sf), _rays(spark), 2.0).select("raster_id", "ray", "row", "col", r6(F.col("slope")).alias("slope"))


@query(f"WITH {_SEEN}, b AS (SELECT *, max(slope) OVER (PARTITION BY raster_id, ray ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sl) SELECT DISTINCT raster_id, row, col FROM b WHERE m IS NULL OR slope > m")
def viewshed_rays(spark, sf):
    return O.visible_along_rays(cells(spark, sf), _rays(spark), 2.0)


@query()
def viewshed(spark, sf):
    """Ring by ring, for each raster."""
    c = cells(spark, sf)
    eye = c.where("row = 5 AND col = 25").select("raster_id", F.lit(5).cast("long").alias("eye_row"), F.lit(25).cast("long").alias("eye_col"), (F.col("z") + 2.0).alias("eye_z"))
    return O.viewshed_rings(c.join(eye, "raster_id").select("raster_id", "row", "col", "z", "eye_row", "eye_col", "eye_z"), 2.0)


@query(f"WITH {_SEEN}, b AS (SELECT *, max(slope) OVER (PARTITION BY raster_id, ray ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sl), v AS (SELECT DISTINCT raster_id, row, col FROM b WHERE m IS NULL OR slope > m) SELECT r.raster_id, p_partkey AS pid, EXISTS (SELECT 1 FROM v WHERE v.raster_id = r.raster_id AND v.row = p_size % 11 AND v.col = p_partkey % 50) AS valid FROM part, (SELECT DISTINCT raster_id FROM cells) r")
def viewshed_validity(spark, sf):
    """Particles in cells that can be seen."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("pid"), (F.col("p_size") % 11).cast("long").alias("row"), (F.col("p_partkey") % 50).alias("col"))
    seen = O.visible_along_rays(cells(spark, sf), _rays(spark), 2.0).withColumn("valid", F.lit(True))
    p = p.crossJoin(cells(spark, sf).select("raster_id").distinct())
    return p.join(seen, ["raster_id", "row", "col"], "left").select("raster_id", "pid", F.coalesce("valid", F.lit(False)).alias("valid"))


@query("WITH RECURSIVE d(r) AS (SELECT 1) SELECT c_custkey AS ck, floor(sqrt(pow(c_nationkey - 12, 2) + pow(c_acctbal / 1000, 2)) + 0.5)::BIGINT AS ring, row_number() OVER (ORDER BY floor(sqrt(pow(c_nationkey - 12, 2) + pow(c_acctbal / 1000, 2)) + 0.5), atan2(c_nationkey - 12, c_acctbal / 1000), c_custkey)::INT AS place FROM customer")
def sort_rings(spark, sf):
    """Cells in order of ring and heading; the place is counted inside rings plus the sizes of the rings before."""
    from pyspark.sql import Window

    a, b = (F.col("c_nationkey") - 12).cast("double"), F.col("c_acctbal") / 1000
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("ck"), F.floor(F.sqrt(a * a + b * b) + 0.5).alias("ring"), F.atan2(a, b).alias("heading"))
    sizes = t.groupBy("ring").agg(F.count("*").alias("n"))
    starts = sizes.select("ring", F.coalesce(F.sum("n").over(Window.orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("ring").orderBy("heading", "ck"))
    return t.withColumn("k", inside).join(starts, "ring").select("ck", "ring", (F.col("start") + F.col("k")).cast("int").alias("place"))


@query(
    f"""WITH {C}, tm AS (SELECT row - 2 AS trow, col - 20 AS tcol, z AS t FROM cells WHERE raster_id = 0 AND row BETWEEN 2 AND 4 AND col BETWEEN 20 AND 24)
SELECT raster_id AS image_id, row - trow AS row, col - tcol AS col, {sql6('sum(pow(z - t, 2)) / 15')} AS sse FROM cells, tm GROUP BY ALL HAVING count(*) = 15"""
)
def template_match_sse(spark, sf):
    c = cells(spark, sf)
    t = c.where("raster_id = 0 AND row BETWEEN 2 AND 4 AND col BETWEEN 20 AND 24").select((F.col("row") - 2).alias("trow"), (F.col("col") - 20).alias("tcol"), F.col("z").alias("t"))
    return O.squared_differences(c.select(F.col("raster_id").alias("image_id"), "row", "col", "z"), t, 3, 5).withColumn("sse", r6(F.col("sse")))
