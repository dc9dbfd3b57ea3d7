import pytest
from pyspark.sql import functions as F

from rimeframe.sources import exif, reports, svg


def test_exif_round_trip_and_damage():
    tags = {"0th": {"Make": "NIKON CORPORATION", "Orientation": 1}, "Exif": {"ExposureTime": (1, 80), "PixelXDimension": 800, "SubSecTimeOriginal": "28"}}
    data = exif.jpeg_with(exif.build(tags))
    got = exif.parse(data)
    assert got["0th"]["Make"] == "NIKON CORPORATION" and got["Exif"]["ExposureTime"] == "0.0125" and got["Exif"]["PixelXDimension"] == "800"
    for cut in range(0, len(data), 3):
        exif.parse(data[:cut])
    assert exif.parse(b"") == {}
    with pytest.raises(ValueError):
        exif.build({"0th": {"Nonsense": 1}})


def test_times(spark):
    rows = [("2014:10:13 02:03:36", "28"), ("2014:10:13 02:03:36.5", None), ("bad", None), (None, "1")]
    df = spark.createDataFrame(rows, "t string, s string")
    got = [str(r[0]) if r[0] else None for r in df.select(exif.timestamp(F.col("t"), F.col("s"))).collect()]
    assert got == ["2014-10-13 02:03:36.280000", "2014-10-13 02:03:36.500000", None, None]


def test_paths_in_both_cases():
    assert svg.path_vertices("M1 2 L3 4 H5 V6 Z") == [(1, 2), (3, 4), (5, 4), (5, 6), (1, 2)]
    assert svg.path_vertices("m1,2l2,2h2v2z") == [(1, 2), (3, 4), (5, 4), (5, 6), (1, 2)]
    assert svg.path_vertices("M0,0C1,1,2,2,3,3S4,4,5,5Q6,6,7,7T8,8A1,1,0,0,1,9,9") == [(0, 0), (3, 3), (5, 5), (7, 7), (8, 8), (9, 9)]


def test_groups_transforms_and_errors(spark):
    doc = '<svg><g id="a" transform="translate(10)"><line x1="0" y1="0" x2="1" y2="2" transform="scale(2)"/></g></svg>'
    df = spark.createDataFrame([("x", doc), ("y", "<svg><g>")], "path string, content string")
    rows = svg.read_vertices(df).collect()
    good = [(r.path, r.x, r.y) for r in rows if r.error is None]
    assert good == [(["a", "line"], 10.0, 0.0), (["a", "line"], 12.0, 4.0)] and sum(r.error is not None for r in rows) == 1


def test_numbers_without_separators(spark):
    assert spark.range(1).select(svg.numbers(F.lit("1-2.5.5e1+3"))).first()[0] == [1.0, -2.5, 5.0, 3.0]


def test_formats(spark):
    df = spark.createDataFrame([("/a/b.c/x.y.TIF",), ("z",)], "p string")
    got = df.select(reports.driver_of(F.col("p")).alias("d"), reports.bare_name(F.col("p")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("GTiff", "x"), (None, "z")]
