"""Boxes, rays and planes as Column expressions.  NULL stands for "no intersection"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PARALLEL = 1e-14


def in_box(point: list[Column], box: list[tuple[Column, Column]]) -> Column:
    """Whether a point lies in a box, border included, in any number of dimensions."""
    return reduce(lambda a, b: a & b, ((p >= lo) & (p <= hi) for p, (lo, hi) in zip(point, box)))


def ray_box(origin: list[Column], direction: list[Column], box: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Ray parameters at which a ray enters and leaves a box; an origin inside enters at 0 or less.  NULL on a miss."""
    near, far, ok = [], [], F.lit(True)
    for o, d, (lo, hi) in zip(origin, direction, box):
        a, b = (lo - o) / F.when(d != 0, d), (hi - o) / F.when(d != 0, d)
        near.append(F.coalesce(F.least(a, b), F.lit(float("-inf"))))
        far.append(F.coalesce(F.greatest(a, b), F.lit(float("inf"))))
        ok = ok & ((d != 0) | ((o >= lo) & (o <= hi)))
    enter, leave = F.greatest(*near), F.least(*far)
    hit = ok & (enter <= leave) & (leave >= 0)
    return F.when(hit, enter), F.when(hit, leave)


def edge_box(a: list[Column], b: list[Column], box: list[tuple[Column, Column]]) -> Column:
    """Parameter strictly between 0 and 1 at which the segment from a to b first crosses the box; NULL where it doesn't."""
    enter, leave = ray_box(a, [q - p for p, q in zip(a, b)], box)
    return F.when((enter > 0) & (enter < 1), enter).when((leave > 0) & (leave < 1), leave)


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda p, q: p + q, (x * y for x, y in zip(a, b)))


def ray_plane(origin: list[Column], direction: list[Column], plane: list[list[Column]]) -> list[Column]:
    """Where a ray meets the plane through three points; NULL if parallel or behind."""
    normal = cross([b - a for a, b in zip(plane[0], plane[1])], [c - a for a, c in zip(plane[0], plane[2])])
    rate = dot(normal, direction)
    t = dot(normal, [p - o for p, o in zip(plane[0], origin)]) / F.when(F.abs(rate) >= PARALLEL, rate)
    return [F.when(t >= 0, o + d * t) for o, d in zip(origin, direction)]


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(reduce(lambda p, q: p + q, ((x - y) * (x - y) for x, y in zip(a, b))))


def minor_offset(t: Column, major: Column, minor: Column) -> Column:
    """Steps along the minor axis after t steps along the major one, on an integer line."""
    return F.when(major == 0, 0).otherwise(
        F.greatest(F.ceil((t * F.abs(minor) - F.floor(major / 2)) / F.when(major != 0, major)), F.lit(0)) * F.signum(minor.cast("double"))
    ).cast("long")
