"""Vector drawings: SVG files to vertices in image coordinates, and back.

Attributes and coordinate lists are parsed by Column expressions; whole documents, which nest groups and transforms, by one
generator function a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def numbers(text: Column) -> Column:
    """All numbers of a coordinate list; signs and second decimal points separate, too."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})")), lambda x: x.cast("double"))


def pairs(text: Column) -> Column:
    """Points of a coordinate list; a trailing single number is left out."""
    n = numbers(text)
    return F.transform(F.when(F.size(n) >= 2, F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.get(n, 2 * i).alias("x"), F.get(n, 2 * i + 1).alias("y")))


def transformed(transform: Column, x: Column, y: Column) -> Column:
    """A point under a list of matrix, scale and translate, applied from left to right."""
    steps = F.regexp_extract_all(transform, F.lit(r"((?:matrix|scale|translate)\s*\([^)]*\))"))

    def one(p: Column, step: Column) -> Column:
        v = numbers(F.regexp_extract(step, r"\(([^)]*)\)", 1))
        g = lambda i, d: F.coalesce(F.get(v, F.lit(i)), d)
        zero = F.lit(0.0)
        kind = F.substring(step, 1, 1)
        nx = F.when(kind == "m", g(0, zero) * p["x"] + g(2, zero) * p["y"] + g(4, zero)).when(kind == "s", g(0, zero) * p["x"]).otherwise(p["x"] + g(0, zero))
        ny = F.when(kind == "m", g(1, zero) * p["x"] + g(3, zero) * p["y"] + g(5, zero)).when(kind == "s", g(1, g(0, zero)) * p["y"]).otherwise(p["y"] + g(1, zero))
        return F.struct(nx.alias("x"), ny.alias("y"))

    return F.aggregate(steps, F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")), one)


def bounds(points: Column) -> Column:
    """Box around an array of points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def closed(points: Column) -> Column:
    return (F.size(points) > 2) & (F.element_at(points, 1) == F.element_at(points, -1))


def path_vertices(d: str) -> list[tuple[float, float]]:
    """End points of a path's commands, absolute; of curves only the ends are kept."""
    out: list[tuple[float, float]] = []
    x = y = sx = sy = 0.0
    #: Numbers a command takes; the last two are its end.
    takes = {"M": 2, "L": 2, "T": 2, "S": 4, "Q": 4, "C": 6, "A": 7, "H": 1, "V": 1}
    for command, rest in re.findall(r"([MLHVCSQTAZmlhvcsqtaz])([^MLHVCSQTAZmlhvcsqtaz]*)", d):
        upper, relative = command.upper(), command.islower()
        if upper == "Z":
            x, y = sx, sy
            out.append((x, y))
            continue
        values = [float(v) for v in re.findall(NUMBER, rest)]
        n = takes[upper]
        for k, i in enumerate(range(0, len(values) - n + 1, n)):
            v = values[i : i + n]
            if upper == "H":
                x = v[0] + (x if relative else 0)
            elif upper == "V":
                y = v[0] + (y if relative else 0)
            else:
                x, y = v[-2] + (x if relative else 0), v[-1] + (y if relative else 0)
            if upper == "M" and not k:
                sx, sy = x, y
            out.append((x, y))
    return out


def _apply(points: list[tuple[float, float]], transform: str | None) -> list[tuple[float, float]]:
    for kind, inside in re.findall(r"(matrix|scale|translate)\s*\(([^)]*)\)", transform or ""):
        v = [float(n) for n in re.findall(NUMBER, inside)]
        if kind == "matrix" and len(v) == 6:
            points = [(v[0] * x + v[2] * y + v[4], v[1] * x + v[3] * y + v[5]) for x, y in points]
        elif kind == "scale" and v:
            points = [(v[0] * x, v[-1] * y) for x, y in points]
        elif kind == "translate" and v:
            points = [(x + v[0], y + (v[1] if len(v) > 1 else 0.0)) for x, y in points]
    return points


def document_vertices(text: str) -> Iterator[tuple[list[str], int, int, float, float]]:
    """(path of names, element, vertex, x, y) of a document's lines and shapes.  Names are ids, else tags."""
    root = ElementTree.fromstring(text)
    count = 0

    def own(e, tag: str) -> list[tuple[float, float]] | None:
        a = lambda n: float(re.match(NUMBER, e.get(n, "0"))[0])
        if tag in ("polyline", "polygon"):
            v = [float(n) for n in re.findall(NUMBER, e.get("points", ""))]
            p = list(zip(v[::2], v[1::2]))
            return p + p[:1] if tag == "polygon" else p
        if tag == "line":
            return [(a("x1"), a("y1")), (a("x2"), a("y2"))]
        if tag == "circle":
            return [(a("cx"), a("cy"))]
        if tag in ("rect", "image"):
            x, y, w, h = a("x"), a("y"), a("width"), a("height")
            ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
            return ring + ring[:1] if tag == "rect" else ring
        return path_vertices(e.get("d", "")) if tag == "path" else None

    def walk(e, names: list[str], transforms: list[str | None]) -> Iterator:
        nonlocal count
        tag = e.tag.rpartition("}")[2]
        name = e.get("id") or tag
        points = own(e, tag)
        if points is not None:
            for t in [e.get("transform"), *reversed(transforms)]:
                points = _apply(points, t)
            for i, (x, y) in enumerate(points):
                yield [*names, name], count, i, x, y
            count += 1
        elif tag in ("svg", "g"):
            for child in e:
                yield from walk(child, names if tag == "svg" else [*names, name], [*transforms, e.get("transform")])

    yield from walk(root, [], [])


def read_vertices(files: DataFrame) -> DataFrame:
    """``file, path, elem, vertex, x, y`` from rows with path and content; broken documents give one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(file, *v, None) for v in document_vertices(content)]
                except ElementTree.ParseError as e:
                    rows.append((file, [], None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["file", "path", "elem", "vertex", "x", "y", "error"])

    return files.select("path", "content").mapInPandas(run, "file string, path array<string>, elem int, vertex int, x double, y double, error string")


def write_documents(vertices: DataFrame) -> DataFrame:
    """One document a file from polylines (file, elem, vertex, x, y); a file's vertices are one text in the end."""
    point = F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string"))
    lines = vertices.groupBy("file", "elem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vertex", point.alias("p")))), lambda v: v["p"]), " ").alias("points"))
    tags = F.concat(F.lit('<polyline points="'), F.col("points"), F.lit('"/>'))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem", tags.alias("t")))), lambda v: v["t"]), "")
    return lines.groupBy("file").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), body, F.lit("</svg>")).alias("content"))
