"""Matching, control and calibration queries.  Embeddings are keypoints, their label the image."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from ..functions import camera as C
from ..functions import vendors as V
from ..operators import calibration as K
from ..operators import cameras as O
from ..operators import lines as L
from ..operators import matching as M
from ..sources import rasters as S
from .roles import CAM, PROJECTED, UVS, cameras, image_points, r6, sql6, table, world_points

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def keypoints(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("label").alias("img"), F.col("vec_id").alias("kp"), F.col("embedding").alias("descriptor"), (F.col("vec_id") % 400).cast("double").alias("u"), (F.col("vec_id") % 300).cast("double").alias("v"))


def image_pairs(spark, sf):
    i = table(spark, sf, "embeddings").select(F.col("label").alias("img_i")).distinct()
    return i.crossJoin(i.select((F.col("img_i") + 1).alias("img_j"))).where("img_j = img_i + 1").join(i.select(F.col("img_i").alias("img_j")), "img_j", "left_semi")


_D = "d AS (SELECT a.label AS img_i, b.label AS img_j, a.vec_id AS kp_i, b.vec_id AS kp_j, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2)))) AS d FROM embeddings a JOIN embeddings b ON b.label = a.label + 1)"
_NN = f"{_D}, nn AS (SELECT *, row_number() OVER w AS r, lead(d) OVER w AS d2 FROM d WINDOW w AS (PARTITION BY img_i, img_j, kp_i ORDER BY d, kp_j))"


@query(f"WITH {_NN} SELECT img_i, img_j, kp_i, kp_j, {sql6('d')} AS d1, {sql6('d2')} AS d2 FROM nn WHERE r = 1")
def topk_2nn(spark, sf):
    got = M.match_keypoints(keypoints(spark, sf), image_pairs(spark, sf))
    return got.select("img_i", "img_j", "kp_i", "kp_j", r6(F.col("d1")).alias("d1"), r6(F.col("d2")).alias("d2"))


@query(
    f"""WITH {_NN}, back AS (SELECT img_i, img_j, kp_j, arg_min(kp_i, (d, kp_i)) AS kp_i FROM d GROUP BY 1, 2, 3)
SELECT nn.img_i, nn.img_j, nn.kp_i, nn.kp_j, {sql6('d2 / d')} AS weight FROM nn JOIN back USING (img_i, img_j, kp_i, kp_j) WHERE r = 1 AND d / d2 < 0.98 AND sqrt(pow(kp_i % 400 - kp_j % 400, 2) + pow(kp_i % 300 - kp_j % 300, 2)) < 250"""
)
def match_keypoints(spark, sf):
    got = M.match_keypoints(keypoints(spark, sf), image_pairs(spark, sf), max_ratio=0.98, mutual=True, max_distance=250.0)
    return got.select("img_i", "img_j", "kp_i", "kp_j", r6(F.col("weight")).alias("weight"))


@query("SELECT vec_id AS kp, i::INT AS i, " + sql6("sign(x) * sqrt(abs(x) / (s + 1e-7))") + " AS d FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS s FROM embeddings)")
def detect_keypoints(spark, sf):
    """Root-normalised descriptors; detection itself needs an image library and is left to a plugged-in function."""
    k = keypoints(spark, sf).select("kp", F.posexplode(M.root_sift(F.col("descriptor"))).alias("i", "d"))
    return k.select("kp", "i", r6(F.col("d")).alias("d"))


#: Matches: line items between the image of the supplier and that of the part's remainder.
_M = "m AS (SELECT l_suppkey % 20 AS img_i, l_suppkey % 20 + 1 + l_partkey % 3 AS img_j, l_orderkey * 8 + l_linenumber AS m_id, l_quantity AS w, l_discount * 100 AS error, l_extendedprice / 1000 AS distance FROM lineitem)"


def matches(spark, sf):
    t, i = table(spark, sf, "lineitem"), F.col("l_suppkey") % 20
    return t.select(i.alias("img_i"), (i + 1 + F.col("l_partkey") % 3).alias("img_j"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("m_id"), F.col("l_quantity").alias("w"), (F.col("l_discount") * 100).alias("error"), (F.col("l_extendedprice") / 1000).alias("distance"))


@query(f"WITH {_M}, b AS (SELECT *, row_number() OVER (PARTITION BY img_i, img_j ORDER BY w DESC, m_id, error, distance) AS k FROM m) SELECT img_i, img_j, m_id, w FROM b WHERE k <= 40 AND w >= 10 AND error <= 7.5 AND distance <= 80")
def filter_matches(spark, sf):
    got = M.filter_matches(matches(spark, sf).withColumn("o", F.struct("m_id", "error", "distance")), ["img_i", "img_j"], 40, 10.0, 7.5, 80.0, order="o")
    return got.select("img_i", "img_j", "m_id", "w")


@query(f"WITH {_M}, b AS (SELECT *, row_number() OVER (PARTITION BY img_i, img_j ORDER BY w DESC, m_id, error, distance) AS k FROM m) SELECT img_i, img_j, m_id, w FROM b WHERE k <= 5")
def topk_matches(spark, sf):
    got = M.filter_matches(matches(spark, sf).withColumn("o", F.struct("m_id", "error", "distance")), ["img_i", "img_j"], 5, order="o")
    return got.select("img_i", "img_j", "m_id", "w")


_E = f"{_M}, e AS (SELECT img_i, img_j, count(*) FILTER (w > 45) AS size FROM m GROUP BY ALL)"


def edges(spark, sf):
    return matches(spark, sf).groupBy("img_i", "img_j").agg(F.count_if(F.col("w") > 45).alias("size"))


@query(f"WITH {_E} SELECT img, sum(size)::BIGINT AS matches FROM (SELECT img_i AS img, size FROM e UNION ALL SELECT img_j, size FROM e) GROUP BY 1")
def matches_per_image(spark, sf):
    return M.per_image(edges(spark, sf)).select("img", "matches")


@query(f"WITH {_E} SELECT img, count(*) FILTER (size > 0) AS images FROM (SELECT img_i AS img, size FROM e UNION ALL SELECT img_j, size FROM e) GROUP BY 1")
def images_per_image(spark, sf):
    return M.per_image(edges(spark, sf)).select("img", "images")


def _images(spark):
    return spark.range(23).select(F.col("id").alias("img"), F.col("id").alias("n"))


@query(f"WITH {_E}, s AS (SELECT img_i AS img, sum(size) AS size FROM e GROUP BY 1) SELECT i AS img FROM range(0, 23) t(i) LEFT JOIN s ON img = i WHERE i < 22 AND coalesce(size, 0) < 240")
def match_breaks(spark, sf):
    return M.breaks(edges(spark, sf), _images(spark), 240)


@query(f"WITH {_E}, k AS (SELECT * FROM e WHERE img_i % 4 <> 1 AND img_j % 4 <> 1 AND size > 0), x AS (SELECT DISTINCT img FROM (SELECT img_i AS img FROM k UNION ALL SELECT img_j FROM k)) SELECT img, row_number() OVER (ORDER BY img)::INT - 1 AS \"new\" FROM x")
def drop_images(spark, sf):
    images, _ = M.drop_images(edges(spark, sf), _images(spark), _images(spark).where("img % 4 = 1"))
    return images


_CTRL = "ctrl AS (SELECT n_nationkey AS control, n_regionkey AS cam_id FROM nation WHERE n_name < 'NATION_2')"


def _controls(spark, sf):
    return table(spark, sf, "nation").where("n_name < 'NATION_2'").select(F.col("n_nationkey").alias("control"), F.col("n_regionkey").alias("cam_id"))


@query(f"WITH {CAM}, {_CTRL} SELECT control, cam_id FROM ctrl WHERE cam_id IN (SELECT cam_id FROM cam WHERE k1 < 0.02)")
def control_cams(spark, sf):
    """Controls that refer to one of the cameras to be fitted."""
    return _controls(spark, sf).join(cameras(spark, sf).where("k1 < 0.02"), "cam_id", "left_semi").select("control", "cam_id")


@query(f"WITH {CAM}, {_CTRL} SELECT cam_id FROM cam WHERE cam_id NOT IN (SELECT cam_id FROM ctrl WHERE control % 2 = 0)")
def cams_minus_controls(spark, sf):
    """Cameras that no control refers to."""
    return cameras(spark, sf).join(_controls(spark, sf).where("control % 2 = 0"), "cam_id", "left_anti").select("cam_id")


_RES = f"{PROJECTED}, ob AS (SELECT *, u + (ok % 7 - 3) * 0.25::DOUBLE AS ou, v + (ln % 5 - 2) * 0.5::DOUBLE AS ov FROM pix WHERE u BETWEEN 0 AND nx AND v BETWEEN 0 AND ny)"


def _observed(spark, sf):
    p = O.project_points(world_points(spark, sf), cameras(spark, sf), ("px", "py", "pz")).where(O.unpushed(F.col("in_frame")))
    return p.withColumns({"ou": F.col("u") + (F.col("ok") % 7 - 3) * 0.25, "ov": F.col("v") + (F.col("ln") % 5 - 2) * 0.5})


@query(f"WITH {_RES} SELECT cam_id, ok, ln, {sql6('u - ou', 9)} AS du, {sql6('v - ov', 9)} AS dv FROM ob")
def points_residuals(spark, sf):
    return _observed(spark, sf).select("cam_id", "ok", "ln", r6(F.col("u") - F.col("ou"), 9).alias("du"), r6(F.col("v") - F.col("ov"), 9).alias("dv"))


@query(f"WITH {_RES} SELECT cam_id, count(*) AS n, {sql6('avg(sqrt(pow(u - ou, 2) + pow(v - ov, 2)))')} AS mean_error, {sql6('max(sqrt(pow(u - ou, 2) + pow(v - ov, 2)))')} AS max_error FROM ob GROUP BY 1")
def cameras_errors(spark, sf):
    e = F.hypot(F.col("u") - F.col("ou"), F.col("v") - F.col("ov"))
    return _observed(spark, sf).groupBy("cam_id").agg(F.count("*").alias("n"), r6(F.avg(e)).alias("mean_error"), r6(F.max(e)).alias("max_error"))


@query(f"WITH {_RES} SELECT cam_id, {sql6('sqrt(sum((1 + ln % 3) * (pow(u - ou, 2) + pow(v - ov, 2))))', 4)} AS cost FROM ob GROUP BY 1")
def cameras_residuals(spark, sf):
    """Root of the weighted sum of squares over all controls of a camera."""
    du, dv = F.col("u") - F.col("ou"), F.col("v") - F.col("ov")
    return _observed(spark, sf).groupBy("cam_id").agg(r6(F.sqrt(F.sum((1 + F.col("ln") % 3) * (du * du + dv * dv))), 4).alias("cost"))


_SCALE = "floor(0.5::DOUBLE * nx + 0.5) / nx"


@query(f"WITH {CAM}, {UVS} SELECT cam_id, pk, {sql6(f'u * ({_SCALE})')} AS u, {sql6('v * (floor(0.5::DOUBLE * ny + 0.5) / ny)')} AS v FROM uvs, cam")
def points_resize(spark, sf):
    c = C.resized(C.camera(), F.lit(0.5))
    p = image_points(spark, sf).crossJoin(cameras(spark, sf))
    return p.select("cam_id", "pk", r6(F.col("u") * (c["nx"] / F.col("nx"))).alias("u"), r6(F.col("v") * (c["ny"] / F.col("ny"))).alias("v"))


@query(f"WITH {CAM}, {UVS} SELECT cam_id, pk, {sql6('u / 2')} AS ui, {sql6('v / 2')} AS vi, {sql6('(nx - u) / 2')} AS uj, {sql6('(ny - v) / 2')} AS vj FROM uvs, cam")
def matches_resize(spark, sf):
    c = C.resized(C.camera(), F.lit(0.5))
    sx, sy = c["nx"] / F.col("nx"), c["ny"] / F.col("ny")
    p = image_points(spark, sf).crossJoin(cameras(spark, sf))
    return p.select("cam_id", "pk", r6(F.col("u") * sx).alias("ui"), r6(F.col("v") * sy).alias("vi"), r6((F.col("nx") - F.col("u")) * sx).alias("uj"), r6((F.col("ny") - F.col("v")) * sy).alias("vj"))


def _turned(spark, sf):
    """Each camera and the same one turned by two degrees: a pixel of the first seen by the second."""
    cam = C.camera()
    p = image_points(spark, sf).crossJoin(cameras(spark, sf))
    ray = C.unproject(cam, F.col("u"), F.col("v"))
    p = p.withColumns(dict(zip(("rx", "ry", "rz"), ray)))
    other = {**cam, "yaw": F.col("yaw") + 2.0}
    u, v, _ = C.project(other, tuple(map(F.col, ("rx", "ry", "rz"))), directions=True)
    return p.withColumns({"uj": u, "vj": v}), other


@query(f"WITH {CAM}, {UVS} SELECT cam_id, pk, {sql6('u', 5)} AS u, {sql6('v', 5)} AS v FROM uvs, cam")
def matches_predicted(spark, sf):
    """There and back again: the pixel predicted in the turned camera, predicted in the first."""
    p, other = _turned(spark, sf)
    ray = C.unproject(other, F.col("uj"), F.col("vj"))
    p = p.withColumns(dict(zip(("sx", "sy", "sz"), ray)))
    u, v, _ = C.project(C.camera(), tuple(map(F.col, ("sx", "sy", "sz"))), directions=True)
    return p.select("cam_id", "pk", r6(u, 5).alias("u"), r6(v, 5).alias("v"))


@query(f"WITH {CAM}, {UVS}, t AS (SELECT cam_id, pk, (u - nx / 2 - cx) / fx AS x, (v - ny / 2 - cy) / fy AS y FROM uvs, cam) SELECT cam_id, pk, {sql6('x / sqrt(x * x + y * y + 1)')} AS x, {sql6('y / sqrt(x * x + y * y + 1)')} AS y, {sql6('1 / sqrt(x * x + y * y + 1)')} AS z FROM t")
def rotation_matches(spark, sf):
    """Matches as unit rays in camera axes (of ideal cameras)."""
    x, y = C.from_pixels(C.camera(), F.col("u"), F.col("v"))
    p = image_points(spark, sf).crossJoin(cameras(spark, sf)).withColumns({"a": x, "b": y})
    n = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + 1.0)
    return p.select("cam_id", "pk", r6(F.col("a") / n).alias("x"), r6(F.col("b") / n).alias("y"), r6(1.0 / n).alias("z"))


@query(f"WITH {CAM}, {UVS}, s AS (SELECT cam_id, k, -60.0::DOUBLE + k AS x, 120 + 0.5::DOUBLE * k AS y FROM cam, range(0, 400) t(k)) SELECT uvs.pk, cam_id, {sql6('min(sqrt(pow(u - x, 2) + pow(v - y, 2)))')} AS d FROM uvs, s GROUP BY ALL")
def lines_predicted(spark, sf):
    """Distance of image points to the nearest vertex of each camera's densified line."""
    line = cameras(spark, sf).select("cam_id", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("k")).select("cam_id", (F.col("k") - 60.0).alias("x"), (120 + F.col("k") * 0.5).alias("y"))
    near = L.nearest_vertex(image_points(spark, sf), "pk", line, "cam_id")
    return near.groupBy("pk", "cam_id").agg(r6(F.min("d")).alias("d"))


@query()
def lines_project(spark, sf):
    """World lines in the image: vertices in order, those behind the camera end a piece."""
    k = F.explode(F.sequence(F.lit(0), F.lit(199))).alias("k")
    line = table(spark, sf, "region").select(F.col("r_regionkey").alias("line"), k).select("line", "k", (F.col("k") * 0.5 - 70).alias("px"), (F.col("line") * 6.0 - 20).alias("py"), F.lit(0.0).alias("pz"))
    seen = O.project_points(line, cameras(spark, sf), ("px", "py", "pz"))
    inside = L.mask_runs(seen.select("cam_id", "line", "k", "u", "v", "in_frame"), ["cam_id", "line"], ["k"], "in_frame").where("in_frame")
    return inside.select("cam_id", "line", "run", "k", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


@query("SELECT p_partkey AS pk, " + sql6("((2.5 * x - 1.5) * x + 0.25) * x + 3") + " AS y FROM (SELECT *, p_size / 10.0::DOUBLE AS x FROM part)")
def polyval(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), r6(K.polynomial(F.col("p_size") / 10.0, [2.5, -1.5, 0.25, 3.0])).alias("y"))


@query("SELECT " + sql6("regr_slope(l_extendedprice, l_quantity)", 4) + " AS a, " + sql6("regr_intercept(l_extendedprice, l_quantity)", 4) + " AS b FROM lineitem")
def polyfit(spark, sf):
    t = table(spark, sf, "lineitem")
    a, b = K.polynomial_fit(t, "l_quantity", "l_extendedprice", 1)
    return spark.createDataFrame([(round(float(a), 4) + 0.0, round(float(b), 4) + 0.0)], "a double, b double")


@query("SELECT least(iterations, comb) AS n FROM (SELECT 30 AS iterations, 8 * 7 // 2 AS comb)")
def ransac_samples(spark, sf):
    subsets = K.ransac_subsets(8, 2, 30, seed=5)
    return spark.createDataFrame([(len({tuple(s) for s in subsets}),)], "n int")


@query("SELECT 2.0::DOUBLE AS a, -3.0::DOUBLE AS b, true AS close")
def ransac(spark, sf):
    """A line through parts, of which every fourth is far off: the robust fit finds the line."""
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("x"))
    y = 2.0 * F.col("x") - 3.0 + F.when(F.col("i") % 4 == 0, 40.0 + F.col("i") % 17).otherwise((F.col("i") % 3 - 1) * 0.001)
    t = t.withColumn("y", y)
    (a, b), _ = K.ransac_line(t, "i", "x", "y", 3, 0.5, 100, 40, 3, t.count())
    return spark.createDataFrame([(float(round(a, 2)), float(round(b, 2)), bool(abs(a - 2) < 1e-3 and abs(b + 3) < 1e-2))], "a double, b double, close boolean")


# ---- fitting


#: What a row of an observation holds; the rest of a camera is the same for all its rows.
_SEEN = ["px", "py", "pz", "u", "v"]


def _seen_kernel(known: dict):
    """Residuals of pixels under a camera (of ``known``, by group) whose view direction is the parameter vector, in numpy."""

    def kernel(group, data: np.ndarray, p: np.ndarray) -> np.ndarray:
        d, k = dict(zip(_SEEN, data.T)), known[group]
        (c0, c1, c2), (s0, s1, s2) = np.cos(np.radians(p[:3])), np.sin(np.radians(p[:3]))
        r = np.array([[c0 * c2 + s0 * s1 * s2, c0 * s1 * s2 - c2 * s0, -c1 * s2], [c2 * s0 * s1 - c0 * s2, s0 * s2 + c0 * c2 * s1, -c1 * c2], [c1 * s0, c0 * c1, s1]])
        off = np.stack([d["px"] - k["x"], d["py"] - k["y"], d["pz"] - k["z"]])
        a, b, c = r @ off
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y = np.where(c > 0, a / c, np.nan), np.where(c > 0, b / c, np.nan)
        from ..operators.undistort import bend

        bx, by = bend([k[n] for n in ("k1", "k2", "k3", "k4", "k5", "k6", "p1", "p2")], x, y)
        return np.column_stack([bx * k["fx"] + k["nx"] / 2 + k["cx"] - d["u"], by * k["fy"] + k["ny"] / 2 + k["cy"] - d["v"]])

    return kernel


@query(f"WITH {CAM} SELECT cam_id, {sql6('yaw', 4)} AS yaw, {sql6('pitch', 4)} AS pitch, {sql6('roll', 4)} AS roll FROM cam")
def cameras_fit(spark, sf):
    """View directions found again from projected points, starting two degrees off; all cameras in the same passes."""
    seen = O.project_points(world_points(spark, sf), cameras(spark, sf), ("px", "py", "pz")).where(O.unpushed(F.col("in_frame"))).select("cam_id", "px", "py", "pz", "u", "v")
    known = {r["cam_id"]: r.asDict() for r in cameras(spark, sf).collect()}
    start = {k: np.array([c["yaw"] + 2.0, c["pitch"] + 2.0, c["roll"] + 2.0]) for k, c in known.items()}
    fits = K.levenberg_marquardt_groups(lambda at: K.sums_by_group(seen, "cam_id", _SEEN, _seen_kernel(known), at, np.full(3, 1e-4)), start, steps=12)
    return spark.createDataFrame([(k, *[round(float(x), 4) + 0.0 for x in fits[k]]) for k in known], "cam_id int, yaw double, pitch double, roll double")


@query()
def observer_cameras_fit(spark, sf):
    """View directions of images from the rays of their matches, the first held fixed: turns of about a degree recovered."""
    cam = C.camera()
    base = image_points(spark, sf).crossJoin(cameras(spark, sf).where("cam_id = 1"))
    ray = C.unproject(cam, F.col("u"), F.col("v"))
    base = base.withColumns(dict(zip(("px", "py", "pz"), ray)))
    turns = [(0.0, 0.0, 0.0), (1.0, -0.5, 0.25), (-0.75, 0.5, 1.0)]
    turn = F.explode(F.array(*[F.struct(F.lit(i).alias("img"), *[F.lit(t).alias(n) for n, t in zip(("yaw", "pitch", "roll"), angles)]) for i, angles in enumerate(turns)])).alias("t")
    rows = base.select("*", turn)
    turned = {**cam, **{n: F.col(n) + F.col(f"t.{n}") for n in ("yaw", "pitch", "roll")}}
    u, v, _ = C.project(turned, tuple(map(F.col, ("px", "py", "pz"))), directions=True)
    # The rays are worked out once: every pass of the fit reads them.
    rows = S.checkpoint(rows.select(F.col("t.img").alias("img"), "px", "py", "pz", u.alias("u"), v.alias("v")), "rays")
    k = cameras(spark, sf).where("cam_id = 1").first().asDict()
    start = np.array([k["yaw"], k["pitch"], k["roll"]])
    known = {i: {**k, "x": 0.0, "y": 0.0, "z": 0.0} for i in range(len(turns))}
    fits = K.levenberg_marquardt_groups(lambda at: K.sums_by_group(rows, "img", _SEEN, _seen_kernel(known), at, np.full(3, 1e-4)), {i: start for i in known}, steps=8)
    return spark.createDataFrame([(i, *[round(float(a - b), 4) + 0.0 for a, b in zip(fits[i], start)]) for i in known], "img int, yaw double, pitch double, roll double")


# ---- cameras of other programs


_UNIT = "pt AS (SELECT p_partkey AS pk, (p_retailprice - 950) / 100.0::DOUBLE AS x, (p_size - 25) / 80.0::DOUBLE AS y FROM part), r AS (SELECT *, x * x + y * y AS q FROM pt)"


def _unit(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), ((F.col("p_retailprice") - 950) / 100.0).alias("x"), ((F.col("p_size") - 25) / 80.0).alias("y"))


def _k(**values):
    return {n: F.lit(float(v)) for n, v in values.items()}


@query(
    f"""WITH {_UNIT}, d AS (SELECT pk, x * (1 + q * (-0.1 + q * (0.05 + q * (0.01 - 0.002 * q)))) + 0.001 * (q + 2 * x * x) + 2 * -0.0005 * x * y AS a, y * (1 + q * (-0.1 + q * (0.05 + q * (0.01 - 0.002 * q)))) - 0.0005 * (q + 2 * y * y) + 2 * 0.001 * x * y AS b FROM r)
SELECT pk, {sql6('2144 + 12.5 + a * (3600 + 1.5) + b * -0.7')} AS u, {sql6('1424 - 8.25 + b * 3600')} AS v FROM d"""
)
def agisoft_project(spark, sf):
    k = _k(width=4288, height=2848, f=3600, cx=12.5, cy=-8.25, b1=1.5, b2=-0.7, k1=-0.1, k2=0.05, k3=0.01, k4=-0.002, p1=0.001, p2=-0.0005)
    u, v = V.agisoft(k, F.col("x"), F.col("y"))
    return _unit(spark, sf).select("pk", r6(u).alias("u"), r6(v).alias("v"))


@query(
    f"""WITH {_UNIT}, d AS (SELECT pk, x * (1 + q * (-0.1 + q * (0.05 + q * 0.01))) + 2 * 0.001 * x * y - 0.0005 * (q + 2 * x * x) AS a, y * (1 + q * (-0.1 + q * (0.05 + q * 0.01))) + 0.001 * (q + 2 * y * y) + 2 * -0.0005 * x * y AS b FROM r)
SELECT pk, {sql6('3600 * (a + 0.0003 * b) + 2150.5')} AS u, {sql6('3610 * b + 1420.5')} AS v FROM d"""
)
def matlab_project(spark, sf):
    k = _k(fx=3600, fy=3610, cx=2150, cy=1420, alpha=0.0003, k1=-0.1, k2=0.05, k3=0.01, p1=0.001, p2=-0.0005)
    u, v = V.matlab(k, F.col("x"), F.col("y"))
    return _unit(spark, sf).select("pk", r6(u).alias("u"), r6(v).alias("v"))


@query(
    f"""WITH {_UNIT}, s AS (SELECT *, (1 + q * (-0.1 + q * (0.05 + q * 0.01))) / (1 + q * (0.02 + q * (0.003 + q * 0.0004))) AS f FROM r),
d AS (SELECT pk, x * f + 2 * 0.001 * x * y - 0.0005 * (q + 2 * x * x) + q * (0.0002 + q * 0.0001) AS a, y * f + 0.001 * (q + 2 * y * y) + 2 * -0.0005 * x * y + q * (-0.0003 + q * 0.00005) AS b FROM s)
SELECT pk, {sql6('3600 * a + 2150')} AS u, {sql6('3610 * b + 1420')} AS v FROM d"""
)
def opencv_project(spark, sf):
    k = _k(fx=3600, fy=3610, cx=2150, cy=1420, k1=-0.1, k2=0.05, k3=0.01, k4=0.02, k5=0.003, k6=0.0004, p1=0.001, p2=-0.0005, s1=0.0002, s2=0.0001, s3=-0.0003, s4=0.00005)
    u, v = V.opencv(k, F.col("x"), F.col("y"))
    return _unit(spark, sf).select("pk", r6(u).alias("u"), r6(v).alias("v"))


@query(
    """WITH p AS (SELECT p_partkey AS pk, (p_retailprice - 900) * 42 * 23.6::DOUBLE / 4288 - 11.9 AS x, 7.8 - p_size * 55 * 15.8::DOUBLE / 2848 AS y FROM part), r AS (SELECT *, x * x + y * y AS q FROM p),
d AS (SELECT pk, x + x * q * (0.0001 + q * (-0.000002 + q * 0.00000001)) + 0.00001 * (q + 2 * x * x) + 2 * -0.00002 * x * y AS a, y + y * q * (0.0001 + q * (-0.000002 + q * 0.00000001)) - 0.00002 * (q + 2 * y * y) + 2 * 0.00001 * x * y AS b FROM r)
SELECT pk, """
    + sql6("a / 20.5")
    + " AS x, "
    + sql6("-b / 20.5")
    + " AS y FROM d"
)
def photomodeler_unproject(spark, sf):
    k = _k(format_w=23.6, format_h=15.8, width=4288, height=2848, xp=11.9, yp=7.8, focal=20.5, k1=1e-4, k2=-2e-6, k3=1e-8, p1=1e-5, p2=-2e-5)
    x, y = V.photomodeler(k, (F.col("p_retailprice") - 900) * 42, F.col("p_size") * 55)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), r6(x).alias("x"), r6(y).alias("y"))


@query(
    f"""WITH {_UNIT}, s AS (SELECT *, (1 + q * (-0.1 + q * 0.05)) AS f FROM r), a AS (SELECT pk, x * f * 3600 + 2144 AS u, y * f * 3600 + 1424 AS v, x * (f + 0.01 * q * q * q) * 3600 + 2144 AS u2, y * (f + 0.01 * q * q * q) * 3600 + 1424 AS v2 FROM s)
SELECT pk, {sql6('u - u2')} AS du, {sql6('v - v2')} AS dv FROM a"""
)
def converter_residuals(spark, sf):
    """A camera with two radial terms against one of another program with three."""
    native = {n: F.lit(0.0) for n in C.CAMERA} | _k(nx=4288, ny=2848, fx=3600, fy=3600, k1=-0.1, k2=0.05)
    other = _k(width=4288, height=2848, f=3600, cx=0, cy=0, b1=0, b2=0, k1=-0.1, k2=0.05, k3=0.01, k4=0, p1=0, p2=0)
    u, v = C.to_pixels(native, *C.distort(native, F.col("x"), F.col("y")))
    u2, v2 = V.agisoft(other, F.col("x"), F.col("y"))
    return _unit(spark, sf).select("pk", r6(u - u2).alias("du"), r6(v - v2).alias("dv"))


@query("SELECT -0.1::DOUBLE AS k1, 0.05::DOUBLE AS k2, 0.01::DOUBLE AS k3")
def converter_optimize(spark, sf):
    """Radial terms of the native camera fitted to those of another program: linear, so one pass and one solve."""
    other = _k(width=4288, height=2848, f=3600, cx=0, cy=0, b1=0, b2=0, k1=-0.1, k2=0.05, k3=0.01, k4=0, p1=0, p2=0)
    x, y = F.col("x"), F.col("y")
    u, v = V.agisoft(other, x, y)
    r2 = x * x + y * y
    rows = _unit(spark, sf)
    residuals = [x * 3600.0 + 2144.0 - u, y * 3600.0 + 1424.0 - v]
    jac = [[w * r2 * 3600.0, w * r2 * r2 * 3600.0, w * r2 * r2 * r2 * 3600.0] for w in (x, y)]
    a, b, _, _ = K.normal_equations(rows, residuals, jac)
    fit = -np.linalg.solve(a, b)
    return spark.createDataFrame([tuple(round(float(f), 6) + 0.0 for f in fit)], "k1 double, k2 double, k3 double")


PARAMETERS = ["x", "y", "z", "yaw", "pitch", "roll", "nx", "ny", "fx", "fy", "cx", "cy", "k1", "k2", "k3", "k4", "k5", "k6", "p1", "p2"]


def parameter_mask(chosen: dict[str, bool | int | list[int]]) -> list[bool]:
    """Which of a camera's 20 numbers a choice such as {"viewdir": True, "k": [0, 1]} frees."""
    groups = {"xyz": range(0, 3), "viewdir": range(3, 6), "imgsz": range(6, 8), "f": range(8, 10), "c": range(10, 12), "k": range(12, 18), "p": range(18, 20)}
    out = [False] * 20
    for name, which in chosen.items():
        members = list(groups[name])
        picked = members if which is True else [members[which]] if isinstance(which, int) and which is not False else [members[i] for i in which] if which else []
        for i in picked:
            out[i] = True
    return out


@query("SELECT i::INT AS i, i IN (3, 4, 5, 8, 12, 13) AS free FROM range(0, 20) t(i)")
def parse_params(spark, sf):
    return spark.createDataFrame(list(enumerate(parameter_mask({"viewdir": True, "f": 0, "k": [0, 1]}))), "i int, free boolean")


@query(f"WITH {CAM}, {_CTRL} SELECT DISTINCT control, cam_id * 3 + p AS param FROM ctrl JOIN cam USING (cam_id), range(0, 3) t(p)")
def cameras_sparsity(spark, sf):
    """Which parameters (three view angles of its camera) each control depends on."""
    dep = _controls(spark, sf).join(cameras(spark, sf).select("cam_id"), "cam_id")
    return dep.select("control", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda p: (F.col("cam_id") * 3 + p).cast("long"))).alias("param")).distinct()


@query(
    """WITH cams AS (SELECT n_nationkey AS cam_id, 400 + n_nationkey % 7 // 6 AS nx, CASE WHEN n_nationkey % 3 = 0 THEN ['viewdir'] ELSE [] END AS params FROM nation),
g AS (SELECT n_regionkey AS group_id, n_nationkey AS cam_id, CASE WHEN n_regionkey % 2 = 0 THEN ['f', 'k'] ELSE ['p'] END AS params FROM nation UNION ALL SELECT 10 + n_nationkey % 2, n_nationkey, ['k'] FROM nation WHERE n_nationkey < 4),
c AS (SELECT s_suppkey AS control, s_suppkey % 23 AS cam_id FROM supplier), sh AS (SELECT cam_id, group_id, unnest(params) AS p FROM g)
SELECT 'image sizes' AS error, group_id::BIGINT AS id FROM g JOIN cams USING (cam_id) WHERE list_contains(g.params, 'f') GROUP BY group_id HAVING count(DISTINCT nx) > 1
UNION ALL SELECT DISTINCT 'groups overlap', a.cam_id::BIGINT FROM sh a JOIN sh b ON a.cam_id = b.cam_id AND a.p = b.p AND a.group_id < b.group_id
UNION ALL SELECT DISTINCT 'not in controls', cam_id::BIGINT FROM (SELECT cam_id FROM cams WHERE len(params) > 0 UNION SELECT cam_id FROM g) WHERE cam_id NOT IN (SELECT cam_id FROM c)"""
)
def cameras_validate(spark, sf):
    """Cameras and groups that a fit could not handle, of one camera a nation in groups by region, and two groups more."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    n, words = table(spark, sf, "nation"), lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    cams = n.select(k.alias("cam_id"), (400 + F.floor(k % 7 / 6)).alias("nx"), F.lit(300).alias("ny"), F.when(k % 3 == 0, words("viewdir")).otherwise(words()).alias("params"))
    groups = n.select(r.alias("group_id"), k.alias("cam_id"), F.when(r % 2 == 0, words("f", "k")).otherwise(words("p")).alias("params"))
    groups = groups.unionByName(n.where(k < 4).select((10 + k % 2).alias("group_id"), k.alias("cam_id"), words("k").alias("params")))
    controls = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("control"), (F.col("s_suppkey") % 23).alias("cam_id"))
    return K.inconsistencies(cams, groups, controls)
