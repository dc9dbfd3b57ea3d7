"""Calibration reports and camera files of other programs, as DataFrames of one row a file.

Files are read whole (``text`` with ``wholetext``); values come out by XPath and regular expressions, so parsing stays in the
JVM and a folder of a million reports is read like any other table.  XML with many terms is parsed once a file, by expat in
Arrow batches, since each XPath parses it anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def number(text: Column, pattern: str) -> Column:
    """The first number behind a pattern, NULL if there is none."""
    return F.nullif(F.regexp_extract(text, pattern + f"({_NUMBER})", 1), F.lit("")).cast("double")


def _terms(text: str, root: str) -> dict[str, str]:
    """Texts of the elements right below the root, the first of each name; none if the root has another name."""
    out: dict[str, str] = {}
    path: list[str] = []

    def start(name: str, _: dict) -> None:
        path.append(name)
        if len(path) == 2 and path[0] == root and name not in out:
            out[name] = ""
            parts.clear()
            open_.append(name)

    def end(name: str) -> None:
        if len(path) == 2 and open_:
            out[open_.pop()] = "".join(parts)
        path.pop()

    parts: list[str] = []
    open_: list[str] = []
    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: parts.append(data) if open_ else None
    parser.Parse(text, True)
    return out


def agisoft_xml(files: DataFrame) -> DataFrame:
    """width, height, f, cx, cy, b1, b2, k1 .. k4, p1, p2 of calibration files; missing terms are 0.

    A file is parsed once for all its terms; broken ones are an error."""
    sizes, names = ["width", "height"], ["f", "cx", "cy", "b1", "b2", "k1", "k2", "k3", "k4", "p1", "p2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [None if text is None else _terms(text, "calibration") for text in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"]} | {n: [None if t is None else t.get(n, "") for t in found] for n in sizes + names})

    terms = files.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{n} string" for n in sizes + names))
    whole = lambda n: F.when(F.col(n).isNotNull(), F.when(F.col(n).rlike(r"^\s*-?(\d+\.?\d*|\.\d+)\s*$"), F.col(n).cast("double").cast("int")).otherwise(0))
    value = lambda n: F.coalesce(F.nullif(F.col(n), F.lit("")).cast("double"), F.lit(0.0))
    return terms.select("path", *[whole(n).alias(n) for n in sizes], *[value(n).alias(n) for n in names])


def opencv_xml(files: DataFrame) -> DataFrame:
    """fx, fy, cx, cy and k1, k2, p1, p2, k3 .. k6, s1 .. s4 from the matrix and coefficient nodes; missing terms are 0."""

    def listed(node: str) -> Column:
        return F.transform(F.regexp_extract_all(F.xpath_string("content", F.lit(f"//{node}/data")), F.lit(f"({_NUMBER})")), lambda x: x.cast("double"))

    m, d = F.col("m"), F.col("d")
    order = ["k1", "k2", "p1", "p2", "k3", "k4", "k5", "k6", "s1", "s2", "s3", "s4"]
    return files.withColumns({"m": listed("camera_matrix"), "d": listed("distortion_coefficients")}).select(
        "path", m[0].alias("fx"), m[4].alias("fy"), m[2].alias("cx"), m[5].alias("cy"), *[F.coalesce(F.get(d, F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(order)]
    )


def matlab_report(files: DataFrame) -> DataFrame:
    """Focal lengths, principal point, skew, distortion and size, with sigmas (a third of the reported errors)."""

    def vector(name: str) -> Column:
        inside = F.regexp_extract("content", rf"(?m)^\s*{name}\s*=\s*\[([^\]]*)\]", 1)
        return F.transform(F.regexp_extract_all(inside, F.lit(f"({_NUMBER})")), lambda x: x.cast("double"))

    def scalar(name: str) -> Column:
        return number(F.col("content"), rf"(?m)^\s*{name}\s*=\s*")

    v = files.withColumns({n: vector(n) for n in ("fc", "cc", "kc", "fc_error", "cc_error", "kc_error")})
    out = {"fx": F.col("fc")[0], "fy": F.col("fc")[1], "cx": F.col("cc")[0], "cy": F.col("cc")[1], "alpha": scalar("alpha_c")}
    out |= {n: F.get(F.col("kc"), F.lit(i)) for i, n in enumerate(("k1", "k2", "p1", "p2", "k3"))}
    out |= {"fx_sigma": F.col("fc_error")[0] / 3, "fy_sigma": F.col("fc_error")[1] / 3, "cx_sigma": F.col("cc_error")[0] / 3, "cy_sigma": F.col("cc_error")[1] / 3, "alpha_sigma": scalar("alpha_c_error") / 3}
    out |= {f"{n}_sigma": F.get(F.col("kc_error"), F.lit(i)) / 3 for i, n in enumerate(("k1", "k2", "p1", "p2", "k3"))}
    return v.select("path", scalar("nx").cast("int").alias("width"), scalar("ny").cast("int").alias("height"), *[c.alias(n) for n, c in out.items()])


def photomodeler_report(files: DataFrame) -> DataFrame:
    """Focal length, principal point, format size, radial and tangential terms with deviations; missing ones are 0."""
    labels = {"focal": "Focal Length", "xp": "Xp", "yp": "Yp", "format_w": "Fw", "format_h": "Fh", "k1": "K1", "k2": "K2", "k3": "K3", "p1": "P1", "p2": "P2"}
    out = []
    for name, label in labels.items():
        part = F.regexp_extract("content", rf"(?ms)^\s*{label}\b(.*?)(?=^\s*(?:Focal Length|Xp|Yp|Fw|Fh|K1|K2|K3|P1|P2)\b|\z)", 1)
        out.append(F.coalesce(number(part, r"Value:\s*"), F.lit(0.0)).alias(name))
        out.append(F.coalesce(number(part, r"Deviation:[^:]*:\s*"), F.lit(0.0)).alias(f"{name}_sigma"))
    return files.select("path", *out)


CAMERA_JSON = T.StructType(
    [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("xyz", "viewdir", "imgsz", "f", "c", "k", "p", "sensorsz")]
    + [T.StructField("correction", T.StructType([T.StructField("radius", T.DoubleType()), T.StructField("refraction", T.DoubleType())]))]
)


def camera_json(json: Column) -> Column:
    """A camera struct from JSON text; missing groups become zeros, short lists are filled up."""
    c = F.from_json(json, CAMERA_JSON)

    def filled(name: str, n: int, default: float = 0.0) -> Column:
        # Not a lambda: in one, the text would be parsed for every element.
        return F.array(*[F.coalesce(F.get(c[name], F.lit(i)), F.lit(default)) for i in range(n)]).alias(name)

    return F.struct(filled("xyz", 3), filled("viewdir", 3), filled("imgsz", 2, 100.0), filled("f", 2, 1.0), filled("c", 2), filled("k", 6), filled("p", 2), c["sensorsz"].alias("sensorsz"), c["correction"].alias("correction"))


def camera_to_json(camera: Column) -> Column:
    return F.to_json(camera)


#: Sensor sizes in millimetres by make and model.
SENSORS = [
    ("NIKON CORPORATION NIKON D2X", 23.7, 15.7),
    ("NIKON CORPORATION NIKON D200", 23.6, 15.8),
    ("NIKON CORPORATION NIKON D300S", 23.6, 15.8),
    ("NIKON E8700", 8.8, 6.6),
    ("Canon Canon EOS 20D", 22.5, 15.0),
    ("Canon Canon EOS 40D", 22.2, 14.8),
]


def with_sensor(images: DataFrame) -> DataFrame:
    """Images (make, model) with sensor_w, sensor_h; NULL for bodies not listed."""
    table = images.sparkSession.createDataFrame(SENSORS, "body string, sensor_w double, sensor_h double")
    return images.join(F.broadcast(table), F.concat(F.trim("make"), F.lit(" "), F.trim("model")) == F.col("body"), "left").drop("body")


def driver_of(path: Column) -> Column:
    """Format by the file name's suffix, NULL if unknown."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin("tif", "tiff"), "GTiff").when(suffix.isin("jpg", "jpeg"), "JPEG").when(suffix == "png", "PNG").when(suffix == "parquet", "parquet")


def bare_name(path: Column) -> Column:
    """File name without folders and suffixes."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^([^.]*)", 1)


def valid_crs(crs: Column) -> Column:
    """Whether a string looks like an EPSG number, a PROJ string or well-known text."""
    return crs.rlike(r"^\d{4,6}$|^(?i:epsg):\d+$|\+proj=|^(?:PROJCS|GEOGCS|PROJCRS|GEOGCRS|LOCAL_CS)\[")
