"""Grid, box, ray and line queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import grid as R
from ..operators import lines as L
from .roles import CAM, r6, sql6, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: A grid of 21 x 10 cells, x from -50 to 55, y from 25 down to -25; cells are 5 wide and -5 high.
GRID = R.of(21, 10, (-50.0, 55.0), (25.0, -25.0))
U, V = "(x + 50) / 5.0::DOUBLE", "(25 - y) / 5.0::DOUBLE"
P = "p AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_extendedprice / 1000.0::DOUBLE - 50.0::DOUBLE AS x, l_quantity - 25.0::DOUBLE AS y FROM lineitem)"


def points(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), (F.col("l_extendedprice") / 1000.0 - 50.0).alias("x"), (F.col("l_quantity") - 25.0).alias("y"))


def _pair(spark, sf, pair, names, digits=6):
    return points(spark, sf).select("ok", "ln", *[r6(c.cast("double"), digits).alias(n) for c, n in zip(pair, names)])


def _xy():
    return F.col("x"), F.col("y")


@query(f"WITH {P} SELECT ok, ln, {sql6(U)} AS u, {sql6(V)} AS v FROM p")
def grid_xyz_to_uv(spark, sf):
    return _pair(spark, sf, R.to_uv(GRID, *_xy()), ("u", "v"))


@query(f"WITH {P} SELECT ok, ln, {sql6('x')} AS x, {sql6('y')} AS y FROM p")
def grid_uv_to_xyz(spark, sf):
    u, v = R.to_uv(GRID, *_xy())
    return _pair(spark, sf, R.from_uv(GRID, u, v), ("x", "y"))


@query("SELECT s_suppkey AS sk, -50 + (s_suppkey % 21 + 0.5::DOUBLE) * 5 AS x, 25 - (s_suppkey // 21 + 0.5::DOUBLE) * 5 AS y FROM supplier")
def grid_rowcol_to_xy(spark, sf):
    x, y = R.centre(GRID, F.floor(F.col("s_suppkey") / 21), F.col("s_suppkey") % 21)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sk"), x.alias("x"), y.alias("y"))


@query(f"WITH {P} SELECT ok, ln, {sql6(f'{V} - 0.5')} AS row, {sql6(f'{U} - 0.5')} AS col, least(floor({V}), 9)::BIGINT AS r, least(floor({U}), 20)::BIGINT AS c FROM p")
def grid_xy_to_rowcol(spark, sf):
    row, col = R.rowcol(GRID, *_xy())
    r, c = R.rowcol(GRID, *_xy(), snap=True)
    return points(spark, sf).select("ok", "ln", r6(row).alias("row"), r6(col).alias("col"), r.alias("r"), c.alias("c"))


@query("SELECT s_suppkey AS sk, s_suppkey // 21 AS row, s_suppkey % 21 AS col, s_suppkey AS idx FROM supplier")
def grid_idx(spark, sf):
    row, col = R.from_idx(GRID, F.col("s_suppkey"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sk"), row.alias("row"), col.alias("col"))
    return s.withColumn("idx", R.idx(GRID, F.col("row"), F.col("col")))


@query(
    f"WITH {P} SELECT ok, ln, -50 + (least(floor({U}), 20) + 0.5::DOUBLE) * 5 AS cx, 25 - (least(floor({V}), 9) + 0.5::DOUBLE) * 5 AS cy, -50 + floor({U} + 0.5) * 5 AS ex, 25 - floor({V} + 0.5) * 5 + 0.0 AS ey FROM p"
)
def grid_snap_xy(spark, sf):
    cx, cy = R.snapped(GRID, *_xy())
    ex, ey = R.snapped(GRID, *_xy(), edges=True)
    return points(spark, sf).select("ok", "ln", cx.alias("cx"), cy.alias("cy"), ex.alias("ex"), (ey + 0.0).alias("ey"))


@query(
    f"""WITH {P}, b AS (SELECT ok, ln, floor({U} - 1.5 + 0.5) AS l, floor({V} - 1.5 + 0.5) AS t FROM p)
SELECT ok, ln, CASE WHEN ok_ THEN l::BIGINT END AS "left", CASE WHEN ok_ THEN t::BIGINT END AS top, CASE WHEN ok_ THEN l::BIGINT + 3 END AS "right", CASE WHEN ok_ THEN t::BIGINT + 3 END AS bottom
FROM (SELECT *, l >= 0 AND t >= 0 AND l + 3 <= 21 AND t + 3 <= 10 AS ok_ FROM b)"""
)
def grid_snap_box(spark, sf):
    box = R.snap_box(GRID, *_xy(), F.lit(3.0), F.lit(3.0))
    return points(spark, sf).select("ok", "ln", *[c.cast("long").alias(n) for n, c in box.items()])


@query(f"WITH {P} SELECT ok, ln, x * 2 BETWEEN -50 AND 55 AND y * 2 BETWEEN -25 AND 25 AS inside FROM p")
def grid_inbounds(spark, sf):
    return points(spark, sf).select("ok", "ln", R.inbounds(GRID, *(c * 2 for c in _xy())).alias("inside"))


_GRIDS = "g AS (SELECT n_nationkey AS grid_id, 10 + n_nationkey AS nx, 8 + n_regionkey AS ny, n_nationkey * 10.0::DOUBLE AS x0, n_nationkey * 10.0::DOUBLE + 50 AS x1, 40.0::DOUBLE + n_regionkey AS y0, 0.0::DOUBLE AS y1 FROM nation)"


def grids(spark, sf):
    k, g = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, sf, "nation").select(k.alias("grid_id"), (10 + k).alias("nx"), (8 + g).alias("ny"), (k * 10.0).alias("x0"), (k * 10.0 + 50).alias("x1"), (40.0 + g).alias("y0"), F.lit(0.0).alias("y1"))


@query(f"WITH {_GRIDS} SELECT grid_id, floor(nx * 0.37::DOUBLE + 0.5)::BIGINT AS nx, floor(ny * 0.37::DOUBLE + 0.5)::BIGINT AS ny, x0, x1 FROM g")
def grid_resize(spark, sf):
    g = R.resized(R.grid(), F.lit(0.37))
    return grids(spark, sf).select("grid_id", g["nx"].cast("long").alias("nx"), g["ny"].cast("long").alias("ny"), "x0", "x1")


@query(f"WITH {_GRIDS} SELECT grid_id, x0 + 3.5 AS x0, x1 + 3.5 AS x1, y0 - 2 AS y0, y1 - 2 AS y1 FROM g")
def grid_shift(spark, sf):
    g = R.shifted(R.grid(), F.lit(3.5), F.lit(-2.0))
    return grids(spark, sf).select("grid_id", *[g[n].alias(n) for n in ("x0", "x1", "y0", "y1")])


#: Grids that are equal, and that differ in one axis, one limit or one size.
_ALIKE = """g AS (SELECT n_nationkey AS grid_id, 10 + n_nationkey % 2 AS nx, 8 + n_nationkey % 3 // 2 AS ny, n_nationkey % 5 // 4 * 10.0::DOUBLE AS x0, 50.0::DOUBLE AS x1, 40.0::DOUBLE AS y0,
  CASE WHEN n_nationkey = 7 THEN 1.0 ELSE 0.0 END::DOUBLE AS y1 FROM nation)"""


@query(f"WITH {_ALIKE} SELECT a.grid_id AS a, b.grid_id AS b FROM g a JOIN g b ON a.grid_id < b.grid_id AND (a.nx, a.ny, a.x0, a.x1, a.y0, a.y1) = (b.nx, b.ny, b.x0, b.x1, b.y0, b.y1)")
def grid_equal(spark, sf):
    """Pairs of equal grids."""
    k = F.col("n_nationkey")
    limits = {"x0": F.floor(k % 5 / 4) * 10.0, "x1": F.lit(50.0), "y0": F.lit(40.0), "y1": F.when(k == 7, 1.0).otherwise(0.0)}
    g = table(spark, sf, "nation").select(k.alias("grid_id"), (10 + k % 2).alias("nx"), (8 + F.floor(k % 3 / 2)).alias("ny"), *[v.alias(n) for n, v in limits.items()])
    a, b = (g.select(*[F.col(c).alias(f"{side}_{c}") for c in g.columns]) for side in "ab")
    return a.join(b, R.equal(R.grid("a_"), R.grid("b_")) & (F.col("a_grid_id") < F.col("b_grid_id"))).select(F.col("a_grid_id").alias("a"), F.col("b_grid_id").alias("b"))


@query(
    f"""WITH {_GRIDS}, s AS (SELECT *, (x1 - x0) / nx AS dx, (y1 - y0) / ny AS dy FROM g), t AS (SELECT *, (x0 + 7.3::DOUBLE - x0) / dx AS a, (x0 + 33.1::DOUBLE - x0) / dx AS b, (5.5::DOUBLE - y0) / dy AS c, (21.0::DOUBLE - y0) / dy AS d FROM s)
SELECT grid_id, floor(greatest(least(c, d), 0))::BIGINT AS row0, ceil(least(greatest(c, d), ny))::BIGINT AS row1, floor(greatest(least(a, b), 0))::BIGINT AS col0, ceil(least(greatest(a, b), nx))::BIGINT AS col1 FROM t"""
)
def grid_crop_extent(spark, sf):
    c = R.cropped(R.grid(), F.col("x0") + 7.3, F.col("x0") + 33.1, F.lit(5.5), F.lit(21.0))
    return grids(spark, sf).select("grid_id", *[c[n].alias(n) for n in ("row0", "row1", "col0", "col1")])


def _box():
    return [(F.lit(-10.0), F.lit(20.0)), (F.lit(-5.0), F.lit(12.0))]


@query(f"WITH {P} SELECT ok, ln, x BETWEEN -10 AND 20 AND y BETWEEN -5 AND 12 AS inside FROM p")
def box_in(spark, sf):
    return points(spark, sf).select("ok", "ln", G.in_box([*_xy()], _box()).alias("inside"))


@query(f"WITH {_GRIDS}, b AS (SELECT n_regionkey AS r, max(x0) AS x0, min(x1) AS x1, max(y1) AS y0, min(y0) AS y1 FROM g JOIN nation ON n_nationkey = grid_id GROUP BY 1) SELECT r, x0, x1, y0, y1, x0 < x1 AND y0 < y1 AS ok FROM b")
def box_intersect(spark, sf):
    g = grids(spark, sf).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("grid_id"))
    b = g.groupBy(F.col("n_regionkey").alias("r")).agg(F.max("x0").alias("x0"), F.min("x1").alias("x1"), F.max("y1").alias("y0"), F.min("y0").alias("y1"))
    return b.withColumn("ok", F.expr("x0 < x1 AND y0 < y1"))


@query(f"WITH {P} SELECT ln, {sql6('min(x)')} AS x0, {sql6('max(x)')} AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY ln")
def box_bounding(spark, sf):
    return points(spark, sf).groupBy("ln").agg(r6(F.min("x")).alias("x0"), r6(F.max("x")).alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query(f"WITH {_GRIDS} SELECT grid_id, i, x, y FROM g, LATERAL (VALUES (0, x0, y0), (1, x1, y0), (2, x1, y1), (3, x0, y1), (4, x0, y0)) t(i, x, y)")
def box_to_polygon(spark, sf):
    ring = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    corners = F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in ring])
    return grids(spark, sf).select("grid_id", F.posexplode(corners).alias("i", "c")).select("grid_id", "i", "c.x", "c.y")


@query(f"WITH {_GRIDS} SELECT grid_id, 'x' AS axis, x0 AS low, x1 AS high FROM g UNION ALL SELECT grid_id, 'y', y1, y0 FROM g")
def box_unravel(spark, sf):
    """A flat box (x min, y min, x max, y max) as one row for each axis."""
    flat = F.array("x0", "y1", "x1", "y0")
    b = grids(spark, sf).select("grid_id", flat.alias("b"))
    return b.select("grid_id", F.expr("stack(2, 'x', b[0], b[2], 'y', b[1], b[3]) AS (axis, low, high)"))


@query(f"WITH {_GRIDS} SELECT grid_id, i * 4.0::DOUBLE AS x, j * 4.0::DOUBLE AS y FROM g, range(0, 100) a(i), range(0, 100) b(j) WHERE i * 4 BETWEEN x0 AND x1 AND j * 4 BETWEEN y1 AND y0")
def box_to_grid(spark, sf):
    """Multiples of 4 inside each box."""
    x = F.sequence(F.ceil(F.col("x0") / 4.0), F.floor(F.col("x1") / 4.0))
    y = F.sequence(F.ceil(F.col("y1") / 4.0), F.floor(F.col("y0") / 4.0))
    return grids(spark, sf).withColumn("i", F.explode(x)).withColumn("j", F.explode(y)).select("grid_id", (F.col("i") * 4.0).alias("x"), (F.col("j") * 4.0).alias("y"))


@query(f"WITH {_GRIDS} SELECT grid_id, r::INT AS row, c::INT AS col, {sql6('x0 + (c + 0.5::DOUBLE) * ((x1 - x0) / nx)')} AS x, {sql6('y0 + (r + 0.5::DOUBLE) * ((y1 - y0) / ny)')} AS y FROM g, range(0, 20) a(r), range(0, 40) b(c) WHERE r < ny AND c < nx")
def grid_to_points(spark, sf):
    cells = grids(spark, sf).withColumn("row", F.explode(F.sequence(F.lit(0), (F.col("ny") - 1).cast("int")))).withColumn("col", F.explode(F.sequence(F.lit(0), (F.col("nx") - 1).cast("int"))))
    x, y = R.centre(R.grid(), F.col("row"), F.col("col"))
    return cells.select("grid_id", "row", "col", r6(x).alias("x"), r6(y).alias("y"))


_RAYS = "rays AS (SELECT o_orderkey AS k, (o_totalprice / 5000.0::DOUBLE) - 50 AS ox, (o_custkey % 80) - 40.0::DOUBLE AS oy, (o_orderkey % 7) - 3.0::DOUBLE AS dx, (o_orderkey % 5) - 2.0::DOUBLE AS dy FROM orders)"


def rays(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 5000.0 - 50).alias("ox"), (F.col("o_custkey") % 80 - 40.0).alias("oy"), (F.col("o_orderkey") % 7 - 3.0).alias("dx"), (F.col("o_orderkey") % 5 - 2.0).alias("dy")
    )


_SLAB = f"""{_RAYS}, s AS (SELECT *, CASE WHEN dx <> 0 THEN least((-10 - ox) / dx, (20 - ox) / dx) ELSE '-inf'::DOUBLE END AS n1, CASE WHEN dx <> 0 THEN greatest((-10 - ox) / dx, (20 - ox) / dx) ELSE 'inf'::DOUBLE END AS f1,
  CASE WHEN dy <> 0 THEN least((-5 - oy) / dy, (12 - oy) / dy) ELSE '-inf'::DOUBLE END AS n2, CASE WHEN dy <> 0 THEN greatest((-5 - oy) / dy, (12 - oy) / dy) ELSE 'inf'::DOUBLE END AS f2,
  (dx <> 0 OR ox BETWEEN -10 AND 20) AND (dy <> 0 OR oy BETWEEN -5 AND 12) AS ok FROM rays),
h AS (SELECT k, CASE WHEN ok AND greatest(n1, n2) <= least(f1, f2) AND least(f1, f2) >= 0 THEN greatest(n1, n2) END AS t0, CASE WHEN ok AND greatest(n1, n2) <= least(f1, f2) AND least(f1, f2) >= 0 THEN least(f1, f2) END AS t1 FROM s)"""
def _ray():
    return [F.col("ox"), F.col("oy")], [F.col("dx"), F.col("dy")]


@query(f"WITH {_SLAB} SELECT k, {sql6('t0')} AS t0, {sql6('t1')} AS t1 FROM h WHERE t0 IS NOT NULL AND t0 > '-inf'::DOUBLE")
def ray_box(spark, sf):
    t0, t1 = G.ray_box(*_ray(), _box())
    return rays(spark, sf).select("k", t0.alias("t0"), t1.alias("t1")).where(F.col("t0").isNotNull() & (F.col("t0") > float("-inf"))).select("k", r6(F.col("t0")).alias("t0"), r6(F.col("t1")).alias("t1"))


@query(f"WITH {_SLAB} SELECT k, {sql6('CASE WHEN t0 > 0 AND t0 < 1 THEN t0 WHEN t1 > 0 AND t1 < 1 THEN t1 END')} AS t FROM h")
def edge_box(spark, sf):
    t = G.edge_box(_ray()[0], [o + d for o, d in zip(*_ray())], _box())
    return rays(spark, sf).select("k", r6(t).alias("t"))


_PLANES = "pl AS (SELECT n_nationkey AS pk, n_nationkey - 12.0::DOUBLE AS a, n_regionkey - 2.0::DOUBLE AS b, 1.0::DOUBLE AS c, n_nationkey * 2.0::DOUBLE AS d FROM nation)"


@query(
    f"""WITH {_PLANES}, t AS (SELECT pk, (d - (a * 1.5 + b * -2.5 + c * 3.5)) / nullif(CASE WHEN abs(a * 0.6::DOUBLE + b * 0.8::DOUBLE - c * 0.5) < 1e-14 THEN 0 ELSE a * 0.6::DOUBLE + b * 0.8::DOUBLE - c * 0.5 END, 0) AS t FROM pl)
SELECT pk, CASE WHEN t >= 0 THEN {sql6('1.5 + 0.6::DOUBLE * t')} END AS x, CASE WHEN t >= 0 THEN {sql6('-2.5 + 0.8::DOUBLE * t')} END AS y, CASE WHEN t >= 0 THEN {sql6('3.5 - 0.5 * t')} END AS z FROM t"""
)
def ray_plane(spark, sf):
    """One ray and many planes a x + b y + c z = d, each given by three of its points."""
    k = table(spark, sf, "nation").select(F.col("n_nationkey").alias("pk"), (F.col("n_nationkey") - 12.0).alias("a"), (F.col("n_regionkey") - 2.0).alias("b"), (F.col("n_nationkey") * 2.0).alias("d"))
    a, b, d, zero, one = F.col("a"), F.col("b"), F.col("d"), F.lit(0.0), F.lit(1.0)
    plane = [[zero, zero, d], [one, zero, d - a], [zero, one, d - b]]
    hit = G.ray_plane([F.lit(1.5), F.lit(-2.5), F.lit(3.5)], [F.lit(0.6), F.lit(0.8), F.lit(-0.5)], plane)
    return k.select("pk", *[r6(h).alias(n) for h, n in zip(hit, "xyz")])


@query(f"WITH {_RAYS}, t AS (SELECT *, (8.00002333::DOUBLE - (ox + 2 * oy)) / nullif(dx + 2 * dy, 0) AS t FROM rays) SELECT k, CASE WHEN t >= 0 THEN {sql6('ox + dx * t', 4)} END AS x, CASE WHEN t >= 0 THEN {sql6('oy + dy * t', 4)} END AS y FROM t")
def rays_plane(spark, sf):
    """Many rays and the plane x + 2 y = 8.00002333, where no hit lies halfway between two rounded values."""
    zero, d = F.lit(0.0), 8.00002333
    plane = [[F.lit(d), zero, zero], [zero, F.lit(d / 2), zero], [F.lit(d), zero, F.lit(1.0)]]
    hit = G.ray_plane([*_ray()[0], zero], [*_ray()[1], zero], plane)
    return rays(spark, sf).select("k", r6(hit[0], 4).alias("x"), r6(hit[1], 4).alias("y"))


@query("SELECT o_orderkey AS k, t::BIGINT AS t, CASE WHEN dx >= dy THEN t ELSE m END::BIGINT AS x, CASE WHEN dx >= dy THEN m ELSE t END::BIGINT AS y FROM (SELECT o_orderkey, o_orderkey % 13 AS dx, o_custkey % 9 AS dy, t, CASE WHEN o_orderkey % 13 = 0 AND o_custkey % 9 = 0 THEN 0 ELSE greatest(ceil((t * least(o_orderkey % 13, o_custkey % 9) - greatest(o_orderkey % 13, o_custkey % 9) // 2)::DOUBLE / greatest(o_orderkey % 13, o_custkey % 9, 1)), 0) END AS m FROM orders, range(0, 13) r(t) WHERE t <= greatest(o_orderkey % 13, o_custkey % 9))")
def bresenham_line(spark, sf):
    lines = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), (F.col("o_orderkey") % 13).alias("x1"), (F.col("o_custkey") % 9).alias("y1"))
    return L.bresenham_lines(lines, "k").select("k", "t", "x", "y")


@query(
    """WITH RECURSIVE s(k, r, n, x, y, f) AS (SELECT n_nationkey::INT, n_nationkey::INT + 1, floor((sqrt(2) * n_nationkey + 4) / 2)::INT, 0, n_nationkey::INT + 1, -n_nationkey::INT FROM nation UNION ALL
  SELECT k, r, n, x + 1, CASE WHEN f > 0 THEN y - 1 ELSE y END, CASE WHEN f > 0 THEN f - 2 * y + 2 + 2 * x + 3 ELSE f + 2 * x + 3 END FROM s WHERE x < n - 1)
SELECT DISTINCT k, a * u AS x, b * v AS y FROM (SELECT k, x AS u, y AS v FROM s UNION ALL SELECT k, y, x FROM s), (VALUES (1), (-1)) t(a), (VALUES (1), (-1)) w(b)"""
)
def bresenham_circle(spark, sf):
    return L.bresenham_circles(table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.lit(0).alias("x"), F.lit(0).alias("y"), (F.col("n_nationkey") + 1).cast("int").alias("r")))


#: Paths: events of a user in time, x the hour, y the value.
_PATHS = "path AS (SELECT user_id AS line, event_id AS vid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts - TIMESTAMP '2024-01-01') / 3600000000.0::DOUBLE AS x, value AS y FROM events)"


def paths(spark, sf):
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 3.6e9
    return table(spark, sf, "events").select(F.col("user_id").alias("line"), F.col("event_id").alias("vid"), "ts", hours.alias("x"), F.col("value").alias("y"))


_CUM = f"{_PATHS}, seg AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM path WINDOW w AS (PARTITION BY line ORDER BY i)), cum AS (SELECT *, sum(d) OVER (PARTITION BY line ORDER BY i) AS s FROM seg)"


@query(f"WITH {_CUM} SELECT line, vid, {sql6('s')} AS s FROM cum")
def line_cumlength(spark, sf):
    return L.cumulative_length(paths(spark, sf), ["line"], ["ts", "vid"]).select("line", "vid", r6(F.col("s")).alias("s"))


@query(f"WITH {_CUM}, e AS (SELECT *, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM cum WINDOW w AS (PARTITION BY line ORDER BY i)) SELECT line, k * 500.0::DOUBLE AS at, {sql6('x + (x1 - x) * (k * 500.0 - s) / (s1 - s)')} AS x, {sql6('y + (y1 - y) * (k * 500.0 - s) / (s1 - s)')} AS y FROM e, range(0, 100) r(k) WHERE s1 > s AND k * 500 >= s AND k * 500 < s1")
def line_interpolate(spark, sf):
    out = L.interpolate_lines(paths(spark, sf), ["line"], ["ts", "vid"], 500.0)
    return out.select("line", "at", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(
    f"""WITH {_PATHS}, n AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM path WINDOW w AS (PARTITION BY line ORDER BY i)),
s AS (SELECT *, CASE WHEN x1 <> x THEN least((100 - x) / (x1 - x), (500 - x) / (x1 - x)) ELSE '-inf'::DOUBLE END AS n1, CASE WHEN x1 <> x THEN greatest((100 - x) / (x1 - x), (500 - x) / (x1 - x)) ELSE 'inf'::DOUBLE END AS f1,
  CASE WHEN y1 <> y THEN least((20 - y) / (y1 - y), (60 - y) / (y1 - y)) ELSE '-inf'::DOUBLE END AS n2, CASE WHEN y1 <> y THEN greatest((20 - y) / (y1 - y), (60 - y) / (y1 - y)) ELSE 'inf'::DOUBLE END AS f2,
  (x1 <> x OR x BETWEEN 100 AND 500) AND (y1 <> y OR y BETWEEN 20 AND 60) AS ok FROM n WHERE x1 IS NOT NULL),
c AS (SELECT *, greatest(n1, n2, 0) AS a, least(f1, f2, 1) AS b FROM s WHERE ok)
SELECT line, vid, {sql6('x + (x1 - x) * a')} AS xa, {sql6('y + (y1 - y) * a')} AS ya, {sql6('x + (x1 - x) * b')} AS xb, {sql6('y + (y1 - y) * b')} AS yb FROM c WHERE a < b"""
)
def line_clip_box(spark, sf):
    """The pieces of every path inside a box."""
    out = L.clip_lines(paths(spark, sf), ["line"], ["ts", "vid"], (100.0, 500.0), (20.0, 60.0))
    return out.select("line", "vid", *[r6(F.col(c)).alias(c) for c in ("xa", "ya", "xb", "yb")])


@query("SELECT p_partkey AS pk, floor(w * 0.37::DOUBLE + 0.5)::BIGINT AS new_w, floor(h * 0.37::DOUBLE + 0.5)::BIGINT AS new_h, true AS ok FROM (SELECT *, 400 + p_size * 7 AS w, 300 + p_size * 5 AS h FROM part)")
def scale_from_size(spark, sf):
    """A scale found from two sizes gives the new size again."""
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), (400 + F.col("p_size") * 7).alias("w"), (300 + F.col("p_size") * 5).alias("h"))
    s = s.withColumns({"new_w": F.floor(F.col("w") * 0.37 + 0.5), "new_h": F.floor(F.col("h") * 0.37 + 0.5)})
    found = L.scale_between(F.col("w"), F.col("h"), F.col("new_w"), F.col("new_h"))
    same = (F.floor(F.col("w") * found + 0.5) == F.col("new_w")) & (F.floor(F.col("h") * found + 0.5) == F.col("new_h"))
    return s.select("pk", "new_w", "new_h", F.coalesce(same, F.lit(False)).alias("ok"))


@query("SELECT l_returnflag AS flag, r AS run, count(*) AS n, min(l_orderkey) AS first_ok, max(l_orderkey) AS last_ok FROM (SELECT *, sum(CASE WHEN big IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey) - 1 AS r FROM (SELECT *, lag(big) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey) AS before FROM (SELECT l_returnflag, l_orderkey, sum(l_quantity) > 60 AS big FROM lineitem GROUP BY ALL))) WHERE big GROUP BY ALL")
def split_by_mask(spark, sf):
    """Runs of consecutive orders of over 60 items, for each return flag."""
    totals = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_orderkey").agg((F.sum("l_quantity") > 60).alias("big"))
    out = L.mask_runs(totals, ["l_returnflag"], ["l_orderkey"], "big", F.floor(F.col("l_orderkey") / 65536)).where("big")
    return out.groupBy(F.col("l_returnflag").alias("flag"), "run").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_ok"), F.max("l_orderkey").alias("last_ok"))


_DIST = "sqrt(pow(a.s_acctbal / 100 - b.n_nationkey * 4.0::DOUBLE, 2) + pow(a.s_nationkey - b.n_regionkey, 2))"


@query(f"SELECT a.s_suppkey AS sk, b.n_nationkey AS nk, {sql6(_DIST)} AS d FROM supplier a, nation b")
def pairwise_distance(spark, sf):
    a, b = table(spark, sf, "supplier"), table(spark, sf, "nation")
    d = G.distance([F.col("s_acctbal") / 100, F.col("s_nationkey").cast("double")], [F.col("n_nationkey") * 4.0, F.col("n_regionkey").cast("double")])
    return a.crossJoin(b).select(F.col("s_suppkey").alias("sk"), F.col("n_nationkey").alias("nk"), r6(d).alias("d"))


@query(f"SELECT a.s_suppkey AS sk, min_by(b.n_nationkey, ({_DIST}, b.n_nationkey)) AS nearest, {sql6(f'min({_DIST})')} AS d FROM supplier a, nation b GROUP BY 1")
def cdist_argmin(spark, sf):
    a, b = table(spark, sf, "supplier"), table(spark, sf, "nation")
    d = G.distance([F.col("s_acctbal") / 100, F.col("s_nationkey").cast("double")], [F.col("n_nationkey") * 4.0, F.col("n_regionkey").cast("double")])
    best = F.min(F.struct(d.alias("d"), F.col("n_nationkey").alias("k")))
    return a.crossJoin(b).groupBy(F.col("s_suppkey").alias("sk")).agg(best.alias("b")).select("sk", F.col("b.k").alias("nearest"), r6(F.col("b.d")).alias("d"))
