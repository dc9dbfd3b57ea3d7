"""Camera models of other programs, as Column expressions: undistorted camera coordinates to pixels, or back.

``k`` maps parameter names to Columns; sizes are width and height in pixels.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column

K = Mapping[str, Column]


def agisoft(k: K, x: Column, y: Column) -> tuple[Column, Column]:
    """Four radial terms, tangential terms in the order of that program, affinity b1 and skew b2."""
    r2 = x * x + y * y
    radial = 1.0 + r2 * (k["k1"] + r2 * (k["k2"] + r2 * (k["k3"] + r2 * k["k4"])))
    xd = x * radial + k["p1"] * (r2 + 2.0 * x * x) + 2.0 * k["p2"] * x * y
    yd = y * radial + k["p2"] * (r2 + 2.0 * y * y) + 2.0 * k["p1"] * x * y
    return k["width"] * 0.5 + k["cx"] + xd * (k["f"] + k["b1"]) + yd * k["b2"], k["height"] * 0.5 + k["cy"] + yd * k["f"]


def matlab(k: K, x: Column, y: Column) -> tuple[Column, Column]:
    """Skew alpha, radial k1, k2, k3; pixel centres are whole numbers there, so half a pixel is added."""
    r2 = x * x + y * y
    radial = 1.0 + r2 * (k["k1"] + r2 * (k["k2"] + r2 * k["k3"]))
    xd = x * radial + 2.0 * k["p1"] * x * y + k["p2"] * (r2 + 2.0 * x * x)
    yd = y * radial + k["p1"] * (r2 + 2.0 * y * y) + 2.0 * k["p2"] * x * y
    return k["fx"] * (xd + k["alpha"] * yd) + k["cx"] + 0.5, k["fy"] * yd + k["cy"] + 0.5


def opencv(k: K, x: Column, y: Column) -> tuple[Column, Column]:
    """Rational radial, tangential and thin prism terms."""
    r2 = x * x + y * y
    radial = (1.0 + r2 * (k["k1"] + r2 * (k["k2"] + r2 * k["k3"]))) / (1.0 + r2 * (k["k4"] + r2 * (k["k5"] + r2 * k["k6"])))
    xd = x * radial + 2.0 * k["p1"] * x * y + k["p2"] * (r2 + 2.0 * x * x) + r2 * (k["s1"] + r2 * k["s2"])
    yd = y * radial + k["p1"] * (r2 + 2.0 * y * y) + 2.0 * k["p2"] * x * y + r2 * (k["s3"] + r2 * k["s4"])
    return k["fx"] * xd + k["cx"], k["fy"] * yd + k["cy"]


def photomodeler(k: K, u: Column, v: Column) -> tuple[Column, Column]:
    """Pixels to undistorted camera coordinates: millimetres, y upwards, distortion given in the inverse direction."""
    xm = u * k["format_w"] / k["width"] - k["xp"]
    ym = k["yp"] - v * k["format_h"] / k["height"]
    r2 = xm * xm + ym * ym
    radial = r2 * (k["k1"] + r2 * (k["k2"] + r2 * k["k3"]))
    xc = xm + xm * radial + k["p1"] * (r2 + 2.0 * xm * xm) + 2.0 * k["p2"] * xm * ym
    yc = ym + ym * radial + k["p2"] * (r2 + 2.0 * ym * ym) + 2.0 * k["p1"] * xm * ym
    return xc / k["focal"], -yc / k["focal"]
