"""Source and sink queries: reports, camera files, EXIF, SVG.  Files are composed from table rows, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import exif as E
from ..sources import reports as P
from ..sources import svg as S
from .roles import r6, spread, sql6, table, cameras

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _files(spark, sf, template: str, name: str = "p_partkey"):
    """One file a part, with its price and size in the places of {a} and {b}."""
    parts = template.replace("{b}", "{a}").split("{a}")
    order = [c for c in template.replace("{a}", "\0a").replace("{b}", "\0b").split("\0")[1:]]
    pieces = [F.lit(parts[0])]
    for mark, text in zip(order, parts[1:]):
        pieces += [F.col("p_retailprice" if mark[0] == "a" else "p_size").cast("string"), F.lit(text)]
    rows = spread(table(spark, sf, "part").select(name, "p_retailprice", "p_size"), name, "p_retailprice", "p_size")
    return rows.select(F.col(name).cast("string").alias("path"), F.concat(*pieces).alias("content"))


def _key(column: str = "path"):
    return F.col(column).cast("long").alias("pk")



@query("SELECT p_partkey AS pk, 4288 AS width, 2848 AS height, p_retailprice AS f, p_size::DOUBLE AS cx, -0.5::DOUBLE AS cy, 0.0::DOUBLE AS b1, -0.012::DOUBLE AS b2, p_size::DOUBLE AS k1, 0.0::DOUBLE AS k4 FROM part")
def scan_agisoft_xml(spark, sf):
    f = _files(spark, sf, "<calibration><projection>frame</projection><width>4288</width><height>2848</height><f>{a}</f><cx>{b}</cx><cy>-5e-1</cy><b2>-.012</b2><k1>{b}</k1></calibration>")
    return P.agisoft_xml(f).select(_key(), "width", "height", "f", "cx", "cy", "b1", "b2", "k1", "k4")


@query("SELECT p_partkey AS pk, p_retailprice AS fx, p_retailprice + 0.0 AS fy, p_size::DOUBLE AS cx, 1420.5::DOUBLE AS cy, p_size::DOUBLE AS k1, -0.25::DOUBLE AS k2, 0.001::DOUBLE AS p1, 0.0::DOUBLE AS k3, 0.0::DOUBLE AS s4 FROM part")
def scan_opencv_xml(spark, sf):
    f = _files(
        spark, sf, "<opencv_storage><camera_matrix type_id='m'><rows>3</rows><data>{a} 0. {b} 0. {a} 1420.5 0. 0. 1.</data></camera_matrix><distortion_coefficients><data>\n{b} -2.5e-01 1e-3 -.002</data></distortion_coefficients></opencv_storage>"
    )
    return P.opencv_xml(f).select(_key(), "fx", "fy", "cx", "cy", "k1", "k2", "p1", "k3", "s4")


@query("SELECT p_partkey AS pk, 4288 AS width, 2848 AS height, p_retailprice AS fx, 3610.25::DOUBLE AS fy, p_size::DOUBLE AS cx, 0.0003::DOUBLE AS alpha, -0.1::DOUBLE AS k1, 0.0::DOUBLE AS k3, " + sql6("p_size / 3.0::DOUBLE") + " AS fx_sigma FROM part")
def scan_matlab_report(spark, sf):
    f = _files(
        spark, sf, "% Focal length:\nfc = [ {a} ; 3610.25 ];\n\ncc = [ {b} ; 1420.5 ];\nalpha_c = 3e-4;\nkc = [ -0.1 ; 0.05 ; 0.001 ; -0.0005 ; 0.0 ];\nfc_error = [ {b} ; 1.5 ];\ncc_error = [ 1 ; 2 ];\nalpha_c_error = 0.0;\nkc_error = [ 0.1 ; 0.1 ; 0.1 ; 0.1 ; 0 ];\nnx = 4288;\nny = 2848;\n"
    )
    return P.matlab_report(f).select(_key(), "width", "height", "fx", "fy", "cx", "alpha", "k1", "k3", r6(F.col("fx_sigma")).alias("fx_sigma"))


@query("SELECT p_partkey AS pk, p_retailprice AS focal, 0.25::DOUBLE AS focal_sigma, p_size::DOUBLE AS xp, -0.0001::DOUBLE AS k1, 0.0::DOUBLE AS k2 FROM part")
def scan_photomodeler_report(spark, sf):
    f = _files(
        spark, sf, "Camera Calibration\n  Focal Length\n    Value: {a} mm\n    Deviation: Focal: 0.25 mm\n  Xp - principal point x\n    Value: {b} mm\n  Yp - principal point y\n    Value: 7.8 mm\n  K1 - radial distortion 1\n    Value: -1.0e-004\n    Deviation: K1: 2.0e-6\n"
    )
    return P.photomodeler_report(f).select(_key(), "focal", "focal_sigma", "xp", "k1", "k2")


@query("SELECT p_partkey AS pk, p_retailprice AS x, 0.0::DOUBLE AS yaw, 100.0::DOUBLE AS nx, p_size::DOUBLE AS f, -0.5::DOUBLE AS k1, 0.0::DOUBLE AS k2, 0.13::DOUBLE AS refraction FROM part")
def scan_camera_json(spark, sf):
    f = _files(spark, sf, '{"xyz": [{a}, 2, 3], "viewdir": null, "f": [{b}], "k": [-0.5, null], "correction": {"radius": 6.3781E6, "refraction": 0.13}}')
    c = f.select(_key(), P.camera_json(F.col("content")).alias("c"))
    return c.select("pk", F.col("c.xyz")[0].alias("x"), F.col("c.viewdir")[0].alias("yaw"), F.col("c.imgsz")[0].alias("nx"), F.col("c.f")[0].alias("f"), F.col("c.k")[0].alias("k1"), F.col("c.k")[1].alias("k2"), F.col("c.correction.refraction").alias("refraction"))


@query("SELECT p_partkey AS pk, p_retailprice AS x, true AS same FROM part")
def sink_camera_json(spark, sf):
    """To JSON and back."""
    f = _files(spark, sf, '{"xyz": [{a}, 2, 3], "f": [{b}, {b}]}')
    c = f.select(_key(), P.camera_json(F.col("content")).alias("c"))
    back = c.withColumn("d", P.camera_json(P.camera_to_json(F.col("c"))))
    return back.select("pk", F.col("d.xyz")[0].alias("x"), ((F.col("c.k") == F.col("d.k")) & (F.col("c.f") == F.col("d.f"))).alias("same"))


@query("SELECT event_id, (json_extract(props, '$.k'))::INT AS k, CASE WHEN event_type IN ('click', 'view') THEN 'JPEG' END AS driver FROM events")
def io_json(spark, sf):
    e = table(spark, sf, "events")
    name = F.concat(F.lit("a/b.c/"), F.col("event_type"), F.when(F.col("event_type").isin("click", "view"), F.lit(".JPG")).otherwise(F.lit(".xyz")))
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), P.driver_of(name).alias("driver"))


@query("SELECT url, CASE WHEN page_id % 3 = 0 THEN 'GTiff' WHEN page_id % 3 = 1 THEN 'PNG' END AS driver, 'img' || page_id AS name FROM pages")
def scan_driver_infer(spark, sf):
    path = F.concat(F.lit("/data.d/img"), F.col("page_id").cast("string"), F.element_at(F.array(F.lit(".a.TIF"), F.lit(".png"), F.lit(".zip")), (F.col("page_id") % 3 + 1).cast("int")))
    return table(spark, sf, "pages").select("url", P.driver_of(path).alias("driver"), P.bare_name(path).alias("name"))


@query("SELECT n_nationkey AS nk, n_nationkey % 3 <> 2 AS valid FROM nation")
def scan_crs(spark, sf):
    crs = F.element_at(F.array(F.concat(F.lit("EPSG:326"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")), F.lit("+proj=utm +zone=6"), F.col("n_name")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("nk"), P.valid_crs(crs).alias("valid"))


@query("SELECT s_suppkey AS sk, CASE s_suppkey % 3 WHEN 0 THEN 23.6::DOUBLE WHEN 1 THEN 22.2 END AS sensor_w, CASE s_suppkey % 3 WHEN 0 THEN 15.8::DOUBLE WHEN 1 THEN 14.8 END AS sensor_h FROM supplier")
def exif_sensor_lookup(spark, sf):
    make = F.element_at(F.array(F.lit("NIKON CORPORATION "), F.lit("Canon"), F.lit("None")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    model = F.element_at(F.array(F.lit("NIKON D200"), F.lit(" Canon EOS 40D"), F.lit("X")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return P.with_sensor(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sk"), make.alias("make"), model.alias("model"))).select("sk", "sensor_w", "sensor_h")


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) + CASE WHEN event_type = 'view' THEN INTERVAL '28 hundredths' ELSE INTERVAL 0 SECOND END END AS t FROM events".replace("INTERVAL '28 hundredths'", "INTERVAL 280 MILLISECONDS"))
def exif_datetime(spark, sf):
    text = F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).otherwise(F.lit("0000:00:00 bad"))
    return table(spark, sf, "events").select("event_id", E.timestamp(text, F.when(F.col("event_type") == "view", F.lit("28 "))).alias("t"))


@query("SELECT p_partkey AS pk, CASE WHEN p_size % 5 > 0 THEN " + sql6("(p_retailprice * 10)::BIGINT / (p_size % 5)::DOUBLE") + " END AS q FROM part")
def exif_rational(spark, sf):
    text = F.concat_ws("/", F.round(F.col("p_retailprice") * 10).cast("long").cast("string"), (F.col("p_size") % 5).cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), r6(E.rational(text)).alias("q"))


def _made(spark, sf):
    """JPEG files with EXIF of image size, time and exposure taken from the parts."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            blocks = [
                E.jpeg_with(
                    E.build(
                        {
                            "0th": {"Make": "NIKON CORPORATION", "Model": "NIKON D200"},
                            "Exif": {"PixelXDimension": 100 + int(s), "PixelYDimension": 80, "ExposureTime": (1, int(s)), "FNumber": (80, 10), "FocalLength": (round(p * 10), 10), "DateTimeOriginal": "2014:10:13 02:03:36", "SubSecTimeOriginal": "28"},
                        }
                    )
                )
                for s, p in zip(pdf["p_size"], pdf["p_retailprice"])
            ]
            yield pd.DataFrame({"path": pdf["path"], "content": blocks})

    rows = spread(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_size", "p_retailprice"), "path")
    return rows.mapInPandas(run, "path string, content binary")


@query("SELECT p_partkey AS pk, 'NIKON D200' AS model, 9 AS tags, (100 + p_size)::VARCHAR AS nx FROM part")
def scan_exif(spark, sf):
    t = E.read_tags(_made(spark, sf))
    e = F.col("exif")
    return t.select(_key(), E.tag(e, "0th", "Model").alias("model"), (F.size(e["0th"]) + F.size(e["Exif"])).alias("tags"), E.tag(e, "Exif", "PixelXDimension").alias("nx"))


@query("SELECT p_partkey AS pk, 100 + p_size AS nx, 80 AS ny, TIMESTAMP '2014-10-13 02:03:36.28' AS ts, " + sql6("1 / p_size::DOUBLE") + " AS exposure, 8.0::DOUBLE AS aperture, p_retailprice AS fmm, 'NIKON CORPORATION' AS make FROM part")
def exif_fields(spark, sf):
    f = E.fields(E.read_tags(_made(spark, sf)))
    return f.select(_key(), "nx", "ny", "ts", r6(F.col("exposure")).alias("exposure"), "aperture", r6(F.col("fmm")).alias("fmm"), "make")


@query("SELECT p_partkey AS pk, true AS same FROM part")
def sink_exif(spark, sf):
    """Written blocks are read back: whole, rational and text values survive."""
    t = E.fields(E.read_tags(_made(spark, sf)))
    return t.select(_key(), ((F.col("aperture") == 8.0) & (F.col("ny") == 80) & (F.col("model") == "NIKON D200")).alias("same"))


@query("SELECT p_partkey AS pk, CASE WHEN p_size % 2 = 0 THEN 400 ELSE 100 + p_size END::INT AS nx, CASE WHEN p_size % 2 = 0 THEN 300 ELSE 80 END::INT AS ny, TIMESTAMP '2014-10-13 02:03:36.28' AS ts FROM part")
def scan_image_init(spark, sf):
    """Images from files: size from the camera where one is given, else from the file's tags; time from the tags."""
    tags = E.fields(E.read_tags(_made(spark, sf))).select(_key(), F.col("nx").alias("tag_nx"), F.col("ny").alias("tag_ny"), "ts")
    given = table(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("pk"), (F.col("p_partkey") % 5).cast("int").alias("cam_id"))
    cams = given.join(cameras(spark, sf).select("cam_id", "nx", "ny"), "cam_id")
    return tags.join(cams, "pk", "left").select("pk", F.coalesce("nx", "tag_nx").cast("int").alias("nx"), F.coalesce("ny", "tag_ny").cast("int").alias("ny"), "ts")


# ---- drawings


@query("SELECT p_partkey AS pk, i::INT AS i, CASE i WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN -p_retailprice WHEN 2 THEN 0.5 ELSE 150.0 END AS x FROM part, range(0, 4) t(i)")
def svg_coord_parse(spark, sf):
    text = F.concat(F.col("p_size").cast("string"), F.lit("-"), F.col("p_retailprice").cast("string"), F.lit(",.5 1.5E+2"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), F.posexplode(S.numbers(text)).alias("i", "x"))


@query("SELECT p_partkey AS pk, " + sql6("(2 * p_size + 10) * 3 + 0.5 * p_retailprice * 3") + " AS x, " + sql6("(p_retailprice - p_size) * -1 + 4") + " AS y FROM part")
def svg_transform(spark, sf):
    steps = F.lit("matrix(2 -1 0.5 1 10 0) scale(3,-1), translate(0 4)")
    p = S.transformed(steps, F.col("p_size"), F.col("p_retailprice"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), p.alias("p")).select("pk", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


_RING = "{b},0 {a},{b} 3,{a} {b},0"


@query("SELECT p_partkey AS pk, least(p_size, 3)::DOUBLE AS x0, 0.0::DOUBLE AS y0, p_retailprice AS x1, p_retailprice AS y1 FROM part")
def svg_bbox(spark, sf):
    f = _files(spark, sf, _RING).select(_key(), S.bounds(S.pairs(F.col("content"))).alias("b"))
    return f.select("pk", "b.*")


@query("SELECT p_partkey AS pk, true AS ring, false AS open FROM part")
def svg_closed(spark, sf):
    f = _files(spark, sf, _RING)
    p = S.pairs(F.col("content"))
    return f.select(_key(), S.closed(p).alias("ring"), S.closed(F.slice(p, 1, 3)).alias("open"))


@query("SELECT p_partkey AS pk, i::INT AS vertex, CASE i WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 + p_size WHEN 2 THEN 1.0 + p_size ELSE 1.0 END::DOUBLE AS x, CASE i WHEN 0 THEN 2.0 WHEN 1 THEN 2.0 WHEN 2 THEN p_retailprice ELSE 2.0 END AS y FROM part, range(0, 4) t(i)")
def svg_path_parse(spark, sf):
    f = _files(spark, sf, '<svg><path d="M1,2h{b} C 0 0 5 5 -1 -1 V{a}Z"/></svg>'.replace(" C 0 0 5 5 -1 -1", ""))
    return S.read_vertices(f).select(_key("file"), "vertex", "x", "y")


_DOC = '<svg xmlns="http://www.w3.org/2000/svg"><g id="layer" transform="translate(10,0)"><polygon points="0,0 {b},0 {b},{a}" transform="scale(2)"/><line x1="1" y1="2" x2="{b}" y2="4"/></g><rect x="1" y="1" width="{b}" height="2"/></svg>'


@query(
    """SELECT p_partkey AS pk, e::INT AS elem, count(*) AS n, sum(x) AS sx, round(sum(y), 6) + 0.0 AS sy FROM (
  SELECT p_partkey, 0 AS e, unnest([10, 10 + 2 * p_size, 10 + 2 * p_size, 10])::DOUBLE AS x, unnest([0, 0, 2 * p_retailprice, 0]) AS y FROM part UNION ALL
  SELECT p_partkey, 1, unnest([11, 10 + p_size])::DOUBLE, unnest([2, 4])::DOUBLE FROM part UNION ALL
  SELECT p_partkey, 2, unnest([1, 1 + p_size, 1 + p_size, 1, 1])::DOUBLE, unnest([1, 1, 3, 3, 1])::DOUBLE FROM part) GROUP BY ALL"""
)
def scan_svg(spark, sf):
    v = S.read_vertices(_files(spark, sf, _DOC))
    return v.groupBy(_key("file"), "elem").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), r6(F.sum("y")).alias("sy"))


@query("SELECT p_partkey AS pk, unnest(['layer/polygon', 'layer/line', 'rect']) AS name, unnest([4, 2, 5])::BIGINT AS n FROM part")
def svg_elements(spark, sf):
    v = S.read_vertices(_files(spark, sf, _DOC))
    return v.groupBy(_key("file"), F.concat_ws("/", "path").alias("name")).agg(F.count("*").alias("n"))


@query("SELECT n_regionkey AS file, count(*) AS n, sum(n_nationkey)::DOUBLE AS sx FROM nation GROUP BY 1")
def sink_svg(spark, sf):
    """Written and read back."""
    v = table(spark, sf, "nation").select(F.col("n_regionkey").alias("file"), F.lit(0).alias("elem"), F.col("n_nationkey").alias("vertex"), F.col("n_nationkey").cast("double").alias("x"), F.lit(1.5).alias("y"))
    back = S.read_vertices(S.write_documents(v).select(F.col("file").cast("string").alias("path"), "content"))
    return back.groupBy(F.col("file").cast("int").alias("file")).agg(F.count("*").alias("n"), F.sum("x").alias("sx"))
