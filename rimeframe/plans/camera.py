"""Camera queries: projection, its inverse, distortion, image frames, view boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera as C
from ..operators import cameras as O
from ..operators import undistort as U
from .roles import CAM, PROJECTED, PTS, UVS, cameras, image_points, r6, rounded, sql6, table, world_points

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _projected(spark, sf):
    return O.project_points(world_points(spark, sf), cameras(spark, sf), ("px", "py", "pz"))


@query(f"WITH {PROJECTED} SELECT cam_id, ok, ln, {sql6('u', 4)} AS u, {sql6('v', 4)} AS v, {sql6('c')} AS depth FROM pix")
def cam_project(spark, sf):
    return _projected(spark, sf).select("cam_id", "ok", "ln", rounded(F.col("u"), 4).alias("u"), rounded(F.col("v"), 4).alias("v"), rounded(F.col("depth"), 6).alias("depth"))


@query(f"WITH {PROJECTED} SELECT cam_id, ok, ln, {sql6('u', 4)} AS u, {sql6('v', 4)} AS v FROM pix WHERE u BETWEEN 0 AND nx AND v BETWEEN 0 AND ny")
def filter_inframe_infront(spark, sf):
    return _projected(spark, sf).where(O.unpushed(F.col("in_frame"))).select("cam_id", "ok", "ln", rounded(F.col("u"), 4).alias("u"), rounded(F.col("v"), 4).alias("v"))


@query(
    f"WITH {PROJECTED} SELECT cam_id, least(floor(v), ny - 1)::BIGINT AS row, least(floor(u), nx - 1)::BIGINT AS col, {sql6('avg(c)')} AS mean, count(*) AS n FROM pix "
    "WHERE u BETWEEN 0 AND nx AND v BETWEEN 0 AND ny GROUP BY ALL"
)
def cam_rasterize(spark, sf):
    return O.pixel_means(_projected(spark, sf), ["cam_id"], "depth").withColumn("mean", r6(F.col("mean")))


@query(
    f"""WITH {PROJECTED}, t AS (SELECT cam_id, (floor((px + 50) / 27) + 4 * floor((py + 25) / 13))::BIGINT AS tile, least(floor(v), ny - 1)::BIGINT AS row, least(floor(u), nx - 1)::BIGINT AS col, avg(pz) AS m, count(*) AS n
  FROM pix WHERE u BETWEEN 0 AND nx AND v BETWEEN 0 AND ny GROUP BY ALL)
SELECT cam_id, row, col, {sql6('max_by(m, tile)')} AS value, max(tile) AS tile, sum(n)::BIGINT AS n FROM t GROUP BY ALL"""
)
def project_dem(spark, sf):
    seen = _projected(spark, sf).withColumn("tile", (F.floor((F.col("px") + 50) / 27) + 4 * F.floor((F.col("py") + 25) / 13)).cast("long"))
    return O.paint_tiles(seen, ["cam_id"], "tile", "pz").withColumn("value", r6(F.col("value")))


@query(f"WITH {CAM}, {PTS} SELECT ok, ln, cam_id, {sql6('r31 * (px - x) + r32 * (py - y) + r33 * (pz - z)')} AS depth, r31 * (px - x) + r32 * (py - y) + r33 * (pz - z) > 0 AS infront FROM pts, rot")
def cam_infront(spark, sf):
    cam, p = C.camera(), tuple(map(F.col, ("px", "py", "pz")))
    return world_points(spark, sf).crossJoin(cameras(spark, sf)).select("ok", "ln", "cam_id", r6(C.depth(cam, p)).alias("depth"), C.infront(cam, p).alias("infront"))


@query(f"WITH {CAM}, {UVS} SELECT cam_id, pk, u + 40 * cam_id - 80 BETWEEN 0 AND nx AND v + 10 * cam_id BETWEEN 0 AND ny AS inframe FROM uvs, cam")
def cam_inframe(spark, sf):
    inside = C.inframe(C.camera(), F.col("u") + 40 * F.col("cam_id") - 80, F.col("v") + 10 * F.col("cam_id"))
    return image_points(spark, sf).crossJoin(cameras(spark, sf)).select("cam_id", "pk", inside.alias("inframe"))


@query(f"WITH {CAM} SELECT cam_id, " + ", ".join(f"{sql6(f'r{i}{j}', 9)} AS r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)) + " FROM rot")
def cam_rotation(spark, sf):
    m = C.rotation(C.camera())
    return cameras(spark, sf).select("cam_id", *[r6(m[i][j], 9).alias(f"r{i + 1}{j + 1}") for i in range(3) for j in range(3)])


def _turned(i: int, j: int, angle: str) -> str:
    """The matrix element with one angle changed by plus and minus a little: a derivative that shares no formula."""
    h = 1e-3
    parts = []
    for sign in (1, -1):
        a = {n: f"({n} + {sign * h})" if n == angle else n for n in ("yaw", "pitch", "roll")}
        ca, cb, cc, sa, sb, sc = (f"{f}(radians({a[n]}))" for f in ("cos", "sin") for n in ("yaw", "pitch", "roll"))
        parts.append([[f"{ca}*{cc}+{sa}*{sb}*{sc}", f"{ca}*{sb}*{sc}-{cc}*{sa}", f"-{cb}*{sc}"], [f"{cc}*{sa}*{sb}-{ca}*{sc}", f"{sa}*{sc}+{ca}*{cc}*{sb}", f"-{cb}*{cc}"], [f"{cb}*{sa}", f"{ca}*{cb}", sb]][i][j])
    return f"(({parts[0]}) - ({parts[1]})) / {2 * h}::DOUBLE"


@query(
    f"WITH {CAM} SELECT cam_id, "
    + ", ".join(f"{sql6(_turned(i, j, a), 5)} AS d{i + 1}{j + 1}_{a}" for i in range(3) for j in range(3) for a in ("yaw", "pitch", "roll"))
    + " FROM cam"
)
def cam_rotation_prime(spark, sf):
    m = C.rotation_prime(C.camera())
    return cameras(spark, sf).select("cam_id", *[r6(m[i][j][k], 5).alias(f"d{i + 1}{j + 1}_{a}") for i in range(3) for j in range(3) for k, a in enumerate(("yaw", "pitch", "roll"))])


_NORM = f"{CAM}, {UVS}, norm AS (SELECT pk, cam.*, (u - nx / 2 - cx) / fx AS xx, (v - ny / 2 - cy) / fy AS yy FROM uvs, cam), sq AS (SELECT *, xx * xx + yy * yy AS r2 FROM norm)"
_BENT = """bent AS (SELECT *, xx * (1 + r2 * (k1 + r2 * (k2 + r2 * k3))) / (1 + r2 * (k4 + r2 * (k5 + r2 * k6))) + 2 * xx * yy * p1 + p2 * (r2 + 2 * xx * xx) AS dx,
  yy * (1 + r2 * (k1 + r2 * (k2 + r2 * k3))) / (1 + r2 * (k4 + r2 * (k5 + r2 * k6))) + p1 * (r2 + 2 * yy * yy) + 2 * xx * yy * p2 AS dy FROM sq)"""


def _normal(spark, sf):
    x, y = C.from_pixels(C.camera(), F.col("u"), F.col("v"))
    return image_points(spark, sf).crossJoin(cameras(spark, sf)).withColumns({"xx": x, "yy": y})


@query(f"WITH {_NORM}, {_BENT} SELECT cam_id, pk, {sql6('dx', 9)} AS x, {sql6('dy', 9)} AS y FROM bent")
def cam_distort(spark, sf):
    x, y = C.distort(C.camera(), F.col("xx"), F.col("yy"))
    return _normal(spark, sf).select("cam_id", "pk", r6(x, 9).alias("x"), r6(y, 9).alias("y"))


#: Undistortion is checked by what it undoes: the undistorted points are distorted again and compared with the originals.
def _back(spark, sf, solve, k1_only: bool = False):
    points = _normal(spark, sf)
    if k1_only:
        points = points.withColumns({n: F.lit(0.0) for n in C.CAMERA[13:]}).withColumn("k1", F.when(F.col("k1") == 0, 0.02).otherwise(F.col("k1")))
    cam = C.camera()
    solved = solve(points, cam)
    x, y = C.distort(cam, F.col("sx"), F.col("sy"))
    return solved.select("cam_id", "pk", r6(x, 8).alias("x"), r6(y, 8).alias("y"))


_ORIGINAL = f"WITH {_NORM} SELECT cam_id, pk, {sql6('xx', 8)} AS x, {sql6('yy', 8)} AS y FROM sq"


@query(_ORIGINAL)
def cam_undistort_k1(spark, sf):
    def solve(p, cam):
        x, y = C.undistort_k1(F.col("k1"), F.col("xx"), F.col("yy"))
        return p.withColumns({"sx": x, "sy": y})

    return _back(spark, sf, solve, k1_only=True)


@query(
    f"""WITH RECURSIVE {_NORM}, it(cam_id, pk, i, a, b) AS (SELECT cam_id, pk, 0, xx, yy FROM sq UNION ALL
  SELECT it.cam_id, it.pk, i + 1, (xx - 2 * a * b * p1 - p2 * (a * a + b * b + 2 * a * a)) / ((1 + (a * a + b * b) * (k1 + (a * a + b * b) * (k2 + (a * a + b * b) * k3))) / (1 + (a * a + b * b) * (k4 + (a * a + b * b) * (k5 + (a * a + b * b) * k6)))),
    (yy - p1 * (a * a + b * b + 2 * b * b) - 2 * a * b * p2) / ((1 + (a * a + b * b) * (k1 + (a * a + b * b) * (k2 + (a * a + b * b) * k3))) / (1 + (a * a + b * b) * (k4 + (a * a + b * b) * (k5 + (a * a + b * b) * k6))))
  FROM it JOIN sq USING (cam_id, pk) WHERE i < 20)
SELECT cam_id, pk, {sql6('a', 9)} AS x, {sql6('b', 9)} AS y FROM it WHERE i = 20"""
)
def cam_undistort_oulu(spark, sf):
    p = _normal(spark, sf).withColumn("s", U.fixed_point(C.camera(), F.col("xx"), F.col("yy")))
    return p.select("cam_id", "pk", r6(F.col("s.x"), 9).alias("x"), r6(F.col("s.y"), 9).alias("y"))


@query(_ORIGINAL)
def cam_undistort_regulafalsi(spark, sf):
    return _back(spark, sf, lambda p, cam: p.withColumn("s", U.false_position(cam, F.col("xx"), F.col("yy"))).withColumns({"sx": F.col("s.x"), "sy": F.col("s.y")}))


@query(f"WITH {_NORM} SELECT cam_id, pk, {sql6('xx', 8)} AS x, {sql6('yy', 8)} AS y, true AS close FROM sq")
def cam_undistort_lookup(spark, sf):
    """Distorted again, the points looked up lie within 1e-5 of the originals: linear cells are good to some 1e-6."""
    p = _normal(spark, sf).withColumn("s", U.by_lookup(C.camera(), F.col("xx"), F.col("yy")))
    x, y = C.distort(C.camera(), F.col("s.x"), F.col("s.y"))
    close = (F.abs(x - F.col("xx")) < 1e-5) & (F.abs(y - F.col("yy")) < 1e-5)
    return p.select("cam_id", "pk", r6(F.col("xx"), 8).alias("x"), r6(F.col("yy"), 8).alias("y"), close.alias("close"))


@query(_ORIGINAL)
def cam_undistort(spark, sf):
    def solve(p, cam):
        x, y = C.undistort(cam, F.col("xx"), F.col("yy"))
        return p.withColumns({"sx": x, "sy": y})

    return _back(spark, sf, solve)


@query(f"WITH {CAM}, {UVS} SELECT cam_id, pk, {sql6('u')} AS u, {sql6('v')} AS v FROM uvs, cam")
def cam_unproject(spark, sf):
    """Pixels to world points 25 units deep and back: the original pixels."""
    cam = C.camera()
    p = image_points(spark, sf).crossJoin(cameras(spark, sf))
    world = C.unproject(cam, F.col("u"), F.col("v"), directions=False, distance=F.lit(25.0))
    p = p.withColumns(dict(zip(("wx", "wy", "wz"), world)))
    u, v, _ = C.project(cam, tuple(map(F.col, ("wx", "wy", "wz"))))
    return p.select("cam_id", "pk", r6(u).alias("u"), r6(v).alias("v"))


@query(
    f"""WITH {CAM}, e AS (SELECT cam_id, axis, i, CASE axis WHEN 'x' THEN nx / (2 * fx) * (2.0::DOUBLE * i / (nx - 1) - 1) ELSE ny / (2 * fy) * (2.0::DOUBLE * i / (ny - 1) - 1) END AS w, cam.* EXCLUDE (cam_id) FROM cam, range(0, 400) t(i), (VALUES ('x'), ('y')) a(axis) WHERE axis = 'x' OR i < ny),
d AS (SELECT *, w * w AS r2 FROM e),
f AS (SELECT cam_id, axis, i, w * (1 + r2 * (k1 + r2 * (k2 + r2 * k3))) / (1 + r2 * (k4 + r2 * (k5 + r2 * k6))) + CASE axis WHEN 'x' THEN p2 ELSE p1 END * 3 * r2 AS q FROM d)
SELECT cam_id, bool_and(up) AS reversible FROM (SELECT cam_id, coalesce(q >= lag(q) OVER (PARTITION BY cam_id, axis ORDER BY i), true) AS up FROM f) GROUP BY cam_id"""
)
def cam_reversible(spark, sf):
    return O.reversible(cameras(spark, sf))


@query(
    f"""WITH {CAM}, s AS (SELECT *, floor(0.37::DOUBLE * nx + 0.5) AS mx, floor(0.37::DOUBLE * ny + 0.5) AS my FROM cam)
SELECT cam_id, mx AS nx, my AS ny, {sql6('fx * (mx / nx)')} AS fx, {sql6('fy * (my / ny)')} AS fy, {sql6('cx * (mx / nx)')} AS cx, {sql6('cy * (my / ny)')} AS cy FROM s"""
)
def cam_resize(spark, sf):
    c = C.resized(C.camera(), F.lit(0.37))
    return cameras(spark, sf).select("cam_id", *[c[n].cast("double").alias(n) for n in ("nx", "ny")], *[r6(c[n]).alias(n) for n in ("fx", "fy", "cx", "cy")])


@query(f"WITH {CAM} SELECT cam_id, x, fx, " + ", ".join(f"0.0::DOUBLE AS {n}" for n in ["cx", "cy", *C.RADIAL, *C.TANGENTIAL]) + " FROM cam")
def cam_idealize(spark, sf):
    c = C.idealized(C.camera())
    return cameras(spark, sf).select("cam_id", *[c[n].alias(n) for n in ("x", "fx", "cx", "cy", *C.RADIAL, *C.TANGENTIAL)])


@query(f"WITH {CAM} SELECT cam_id, {sql6('fx * 23.6::DOUBLE / nx')} AS fmm_x, {sql6('fy * 15.8::DOUBLE / ny')} AS fmm_y, {sql6('cx * 23.6::DOUBLE / nx')} AS cmm_x, {sql6('cy * 15.8::DOUBLE / ny')} AS cmm_y FROM cam")
def cam_mm_pixels(spark, sf):
    return cameras(spark, sf).select("cam_id", *[r6(c).alias(n) for n, c in C.millimetres(C.camera(), F.lit(23.6), F.lit(15.8)).items()])


_SPH = "s AS (SELECT c_custkey AS ck, (c_acctbal + 1000) * 0.03::DOUBLE AS azimuth, (c_nationkey - 12) * 6.5::DOUBLE AS altitude, 10 + c_nationkey::DOUBLE AS distance FROM customer)"
_XYZ = ", ".join(f"{sql6(e)} AS {n}" for n, e in (("dx", "distance * cos(radians(altitude)) * sin(radians(azimuth))"), ("dy", "distance * cos(radians(altitude)) * cos(radians(azimuth))"), ("dz", "distance * sin(radians(altitude))")))


def _spherical(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ck"), ((F.col("c_acctbal") + 1000) * 0.03).alias("azimuth"), ((F.col("c_nationkey") - 12) * 6.5).alias("altitude"), (10 + F.col("c_nationkey").cast("double")).alias("distance")
    )


@query(f"WITH {_SPH} SELECT ck, {_XYZ} FROM s")
def cam_spherical_to_xyz(spark, sf):
    d = C.spherical_to_xyz(F.col("azimuth"), F.col("altitude"), F.col("distance"))
    return _spherical(spark, sf).select("ck", *[r6(c).alias(n) for c, n in zip(d, ("dx", "dy", "dz"))])


@query(f"WITH {_SPH} SELECT ck, {sql6('azimuth')} AS azimuth, {sql6('altitude')} AS altitude, {sql6('distance')} AS distance FROM s")
def cam_xyz_to_spherical(spark, sf):
    """There and back."""
    s = _spherical(spark, sf).where("ck >= 0")
    s = s.withColumns(dict(zip(("dx", "dy", "dz"), C.spherical_to_xyz(F.col("azimuth"), F.col("altitude"), F.col("distance")))))
    return s.select("ck", *[r6(c).alias(n) for c, n in zip(C.xyz_to_spherical(F.col("dx"), F.col("dy"), F.col("dz")), ("azimuth", "altitude", "distance"))])


_EDGES = """edges AS (SELECT cam.*, e AS edge, i, CASE e WHEN 0 THEN i / m * nx WHEN 1 THEN nx WHEN 2 THEN nx * (1 - i / m) ELSE 0.0 END AS u, CASE e WHEN 0 THEN 0.0 WHEN 1 THEN i / m * ny WHEN 2 THEN ny ELSE ny * (1 - i / m) END AS v
  FROM (SELECT cam_id AS cid, e, ceil(CASE WHEN e % 2 = 0 THEN nx ELSE ny END / 50)::DOUBLE AS m FROM cam, range(0, 4) t(e)) JOIN cam ON cam_id = cid, range(0, 8) s(i) WHERE i < m)"""


@query(f"WITH {CAM}, {_EDGES} SELECT cam_id, edge::INT AS edge, i::INT AS i, {sql6('u')} AS u, {sql6('v')} AS v FROM edges")
def cam_edges(spark, sf):
    return O.border_points(cameras(spark, sf), 50).select("cam_id", "edge", "i", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


@query(f"WITH {CAM} SELECT cam_id, u * 20.0::DOUBLE AS u, v * 20.0::DOUBLE AS v FROM cam, range(0, 21) a(u), range(0, 16) b(v)")
def cam_grid(spark, sf):
    return O.image_grid(cameras(spark, sf), 20.0).select("cam_id", "u", "v")


def _rays_at(points: str) -> str:
    """CTEs from ``pp`` (cam_id, i, u, v): undistorted by enough fixed-point steps, turned, at a depth of 100."""
    radial = "((1 + (a * a + b * b) * (k1 + (a * a + b * b) * (k2 + (a * a + b * b) * k3))) / (1 + (a * a + b * b) * (k4 + (a * a + b * b) * (k5 + (a * a + b * b) * k6))))"
    return f"""{CAM}, {points}, st AS (SELECT pp.i, pp.u, pp.v, rot.*, (pp.u - nx / 2 - cx) / fx AS xx, (pp.v - ny / 2 - cy) / fy AS yy FROM pp JOIN rot USING (cam_id)),
it(cam_id, i, u, v, s, a, b) AS (SELECT cam_id, i, u, v, 0, xx, yy FROM st UNION ALL SELECT cam_id, it.i, it.u, it.v, s + 1, (xx - 2 * a * b * p1 - p2 * (a * a + b * b + 2 * a * a)) / {radial}, (yy - p1 * (a * a + b * b + 2 * b * b) - 2 * a * b * p2) / {radial}
  FROM it JOIN st USING (cam_id, i) WHERE s < 100),
ray AS (SELECT cam_id, it.i, x, y, z, x + 100 * (r11 * a + r21 * b + r31) AS rx, y + 100 * (r12 * a + r22 * b + r32) AS ry, z + 100 * (r13 * a + r23 * b + r33) AS rz FROM it JOIN rot USING (cam_id) WHERE s = 100)"""


_BORDER = "pp AS (SELECT cam_id, row_number() OVER (PARTITION BY cam_id) AS i, u, v FROM (SELECT cam_id, i::DOUBLE AS u, unnest([0.0::DOUBLE, ny]) AS v FROM cam, range(0, 401) t(i) UNION ALL SELECT cam_id, unnest([0.0::DOUBLE, nx]), i::DOUBLE FROM cam, range(0, 301) t(i)))"
_BOX = ", ".join(f"{sql6(f'{f}({g}(r{n}), any_value({n}))', 4)} AS {n}_{k}" for n in "xyz" for k, f, g in (("min", "least", "min"), ("max", "greatest", "max")))


@query(f"WITH RECURSIVE {_rays_at(_BORDER)} SELECT cam_id, {_BOX} FROM ray GROUP BY 1")
def cam_viewbox(spark, sf):
    box = O.view_boxes(cameras(spark, sf), 1, 100.0)
    return box.select("cam_id", *[r6(F.col(c), 4).alias(c) for c in box.columns[1:]])


_LEVEL = "pp AS (SELECT cam_id, i, i * nx AS u, ny / 2 + cy AS v FROM cam, range(0, 2) t(i))"


@query(f"WITH RECURSIVE {_rays_at(_LEVEL)} SELECT cam_id, i::INT + 1 AS i, {sql6('rx', 4)} AS x, {sql6('ry', 4)} AS y FROM ray UNION ALL SELECT cam_id, unnest([0, 3])::INT, {sql6('x', 4)}, {sql6('y', 4)} FROM cam")
def cam_viewpoly(spark, sf):
    """The field of view from above: camera, left and right ray of the principal row at 100 units, camera."""
    cam = C.camera()
    level = F.col("ny") / 2.0 + F.col("cy")
    left, right = (C.unproject(cam, u, level, directions=False, distance=F.lit(100.0)) for u in (F.lit(0.0), F.col("nx")))
    ring = [(F.col("x"), F.col("y")), left[:2], right[:2], (F.col("x"), F.col("y"))]
    points = F.array(*[F.struct(r6(a, 4).alias("x"), r6(b, 4).alias("y")) for a, b in ring])
    return cameras(spark, sf).select("cam_id", F.posexplode(points).alias("i", "p")).select("cam_id", "i", "p.x", "p.y")


@query(f"SELECT c_custkey AS ck, {sql6('(c_acctbal * c_acctbal) * (0.13::DOUBLE - 1) / (2 * 6.3781e6)', 9)} AS dz FROM customer")
def elevation_correction(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("ck"), r6(C.elevation_correction(F.col("c_acctbal") * F.col("c_acctbal")), 9).alias("dz"))


@query(
    f"""WITH {CAM}, q AS (SELECT *, (fx + fy) / 2 AS f, (nx + ny) / 12 * (sqrt(2::DOUBLE) + ln(1 + sqrt(2::DOUBLE))) AS px FROM cam), m AS (SELECT *, px / f AS m FROM q)
SELECT cam_id, 1.0::DOUBLE AS x, {sql6('degrees(2 * atan(nx / (2 * fx))) / nx')} AS yaw, {sql6('degrees(2 * atan(ny / (2 * fy))) / ny')} AS pitch, {sql6('1 / (2 * px * sin(radians(0.5::DOUBLE)))')} AS roll, 2.0::DOUBLE AS nx,
  {sql6('1 / m')} AS fx, 1.0::DOUBLE AS cx, {sql6('1 / (pow(m, 3) * f * sqrt(2::DOUBLE))')} AS k1, {sql6('1 / (pow(m, 5) * f * pow(2::DOUBLE, 1.5))')} AS k2, {sql6('(1 + k5 * pow(m, 4)) / (pow(m, 5) * f * pow(2::DOUBLE, 1.5))')} AS k5, {sql6('1 / (sqrt(5::DOUBLE) * m * m * f)')} AS p1 FROM m"""
)
def camera_scales(spark, sf):
    s = C.scales(C.camera())
    return cameras(spark, sf).select("cam_id", *[r6(s[n]).alias(n) if n not in ("x", "nx", "cx") else s[n].alias(n) for n in ("x", "yaw", "pitch", "roll", "nx", "fx", "cx", "k1", "k2", "k5", "p1")])


@query(
    f"""WITH {CAM}, b AS (SELECT cam_id, n, lo, hi FROM cam, LATERAL (VALUES ('x', NULL::DOUBLE, NULL::DOUBLE), ('yaw', NULL, NULL), ('nx', 0, NULL), ('fx', 0, NULL), ('cx', -nx / 2, nx / 2), ('cy', -ny / 2, ny / 2),
  ('k1', -(fx + fy) / 8000, (fx + fy) / 8000), ('k2', -(fx + fy) / 16000, (fx + fy) / 16000), ('k6', -(fx + fy) / 8000, (fx + fy) / 8000), ('p2', -(fx + fy) / 80000, (fx + fy) / 80000)) t(n, lo, hi))
SELECT cam_id, n AS name, {sql6('lo')} AS low, {sql6('hi')} AS high FROM b"""
)
def camera_bounds(spark, sf):
    bounds = C.default_bounds(C.camera())
    none = F.lit(None).cast("double")
    rows = [F.struct(F.lit(n).alias("name"), (none if bounds[n][0] is None else r6(bounds[n][0])).alias("low"), (none if bounds[n][1] is None else r6(bounds[n][1])).alias("high")) for n in ("x", "yaw", "nx", "fx", "cx", "cy", "k1", "k2", "k6", "p2")]
    return cameras(spark, sf).select("cam_id", F.explode(F.array(*rows)).alias("b")).select("cam_id", "b.*")
