"""Regular grids as Column expressions.

A grid is columns nx, ny (cells) and outer limits x0, x1, y0, y1 in either direction; rows and columns count cell centres,
so the outer corner is (-0.5, -0.5).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = ["nx", "ny", "x0", "x1", "y0", "y1"]
Grid = Mapping[str, Column]


def grid(prefix: str = "") -> dict[str, Column]:
    return {n: F.col(prefix + n) for n in GRID}


class Fixed(Mapping):
    """A grid of known numbers; Columns are made when they are asked for, so it can be built before a session is."""

    def __init__(self, *numbers: float):
        self.numbers = dict(zip(GRID, numbers))

    def __getitem__(self, name: str) -> Column:
        return F.lit(self.numbers[name])

    def __iter__(self):
        return iter(self.numbers)

    def __len__(self) -> int:
        return len(self.numbers)


def of(nx: int, ny: int, xlim: tuple[float, float], ylim: tuple[float, float]) -> Fixed:
    return Fixed(nx, ny, float(xlim[0]), float(xlim[1]), float(ylim[0]), float(ylim[1]))


def cell(g: Grid) -> tuple[Column, Column]:
    """Signed cell sizes."""
    return (g["x1"] - g["x0"]) / g["nx"], (g["y1"] - g["y0"]) / g["ny"]


def bounds(g: Grid) -> tuple[Column, Column, Column, Column]:
    """x min, x max, y min, y max."""
    return F.least(g["x0"], g["x1"]), F.greatest(g["x0"], g["x1"]), F.least(g["y0"], g["y1"]), F.greatest(g["y0"], g["y1"])


def to_uv(g: Grid, x: Column, y: Column) -> tuple[Column, Column]:
    """Cells from the first outer corner."""
    dx, dy = cell(g)
    return (x - g["x0"]) / dx, (y - g["y0"]) / dy


def from_uv(g: Grid, u: Column, v: Column) -> tuple[Column, Column]:
    dx, dy = cell(g)
    return u * dx + g["x0"], v * dy + g["y0"]


def centre(g: Grid, row: Column, col: Column) -> tuple[Column, Column]:
    return from_uv(g, col + 0.5, row + 0.5)


def rowcol(g: Grid, x: Column, y: Column, snap: bool = False) -> tuple[Column, Column]:
    """Fractional row and column of a point, or those of its cell."""
    if snap:
        sx, sy = snapped(g, x, y)
        u, v = to_uv(g, sx, sy)
        return F.floor(v).cast("long"), F.floor(u).cast("long")
    u, v = to_uv(g, x, y)
    return v - 0.5, u - 0.5


def idx(g: Grid, row: Column, col: Column) -> Column:
    return row * g["nx"] + col


def from_idx(g: Grid, i: Column) -> tuple[Column, Column]:
    return F.floor(i / g["nx"]).cast("long"), F.pmod(i, g["nx"]).cast("long")


def equal(a: Grid, b: Grid) -> Column:
    """Whether two grids have the same cells: sizes and outer limits."""
    return reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[n]) for n in GRID))


def inbounds(g: Grid, x: Column, y: Column) -> Column:
    xa, xb, ya, yb = bounds(g)
    return (x >= xa) & (x <= xb) & (y >= ya) & (y <= yb)


def snapped(g: Grid, x: Column, y: Column, edges: bool = False) -> tuple[Column, Column]:
    """The nearest cell centre (points on an edge go to the higher index, those on the far edge to the last cell), or
    the nearest edge."""
    u, v = to_uv(g, x, y)
    if edges:
        return from_uv(g, F.floor(u + 0.5), F.floor(v + 0.5))

    def one(w: Column, n: Column) -> Column:
        return F.floor(F.when(w == n, w - 1.0).otherwise(w)) + 0.5

    return from_uv(g, one(u, g["nx"]), one(v, g["ny"]))


def snap_box(g: Grid, x: Column, y: Column, width: Column, height: Column) -> dict[str, Column]:
    """A box of whole cells of that size around the point, as columns left, top, right, bottom in cells; NULL where it
    leaves the grid."""
    u, v = to_uv(g, x, y)
    left, top = F.floor(u - width / 2.0 + 0.5), F.floor(v - height / 2.0 + 0.5)
    ok = (left >= 0) & (top >= 0) & (left + width <= g["nx"]) & (top + height <= g["ny"])
    return {"left": F.when(ok, left), "top": F.when(ok, top), "right": F.when(ok, left + width), "bottom": F.when(ok, top + height)}


def resized(g: Grid, scale: Column) -> dict[str, Column]:
    return {**g, "nx": F.floor(g["nx"] * scale + 0.5), "ny": F.floor(g["ny"] * scale + 0.5)}


def shifted(g: Grid, dx: Column, dy: Column) -> dict[str, Column]:
    return {**g, "x0": g["x0"] + dx, "x1": g["x1"] + dx, "y0": g["y0"] + dy, "y1": g["y1"] + dy}


def cropped(g: Grid, xa: Column, xb: Column, ya: Column, yb: Column) -> dict[str, Column]:
    """Range of rows and columns (end exclusive) of the cells that touch the box, and the limits they span."""
    dx, dy = cell(g)

    def axis(a: Column, b: Column, start: Column, step: Column, n: Column) -> tuple[Column, Column]:
        p, q = (a - start) / step, (b - start) / step
        low, high = F.greatest(F.least(p, q), F.lit(0.0)), F.least(F.greatest(p, q), n.cast("double"))
        return F.floor(low).cast("long"), F.ceil(high).cast("long")

    c0, c1 = axis(xa, xb, g["x0"], dx, g["nx"])
    r0, r1 = axis(ya, yb, g["y0"], dy, g["ny"])
    x0, y0 = from_uv(g, c0, r0)
    x1, y1 = from_uv(g, c1, r1)
    return {"row0": r0, "row1": r1, "col0": c0, "col1": c1, "x0": x0, "x1": x1, "y0": y0, "y1": y1}
