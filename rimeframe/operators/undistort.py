"""Undistortion kernels over Arrow batches, where a fold of Column expressions is slower or cannot be written.

All work on columns x, y of normalised image coordinates beside the camera's coefficients and return the undistorted ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COEFFS = ["k1", "k2", "k3", "k4", "k5", "k6", "p1", "p2"]
_SCHEMA = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def bend(k: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r2, xy = x * x + y * y, 2 * x * y
    scale = (1 + r2 * (k[0] + r2 * (k[1] + r2 * k[2]))) / (1 + r2 * (k[3] + r2 * (k[4] + r2 * k[5])))
    return x * scale + xy * k[6] + k[7] * (r2 + 2 * x * x), y * scale + k[6] * (r2 + 2 * y * y) + xy * k[7]


@F.pandas_udf(_SCHEMA)
def _fixed_point(x: pd.Series, y: pd.Series, k1: pd.Series, k2: pd.Series, k3: pd.Series, k4: pd.Series, k5: pd.Series, k6: pd.Series, p1: pd.Series, p2: pd.Series) -> pd.DataFrame:
    x0, y0 = x.to_numpy(float), y.to_numpy(float)
    k = [s.to_numpy(float) for s in (k1, k2, k3, k4, k5, k6, p1, p2)]
    a, b = x0.copy(), y0.copy()
    for _ in range(20):
        r2, ab = a * a + b * b, 2 * a * b
        scale = (1 + r2 * (k[0] + r2 * (k[1] + r2 * k[2]))) / (1 + r2 * (k[3] + r2 * (k[4] + r2 * k[5])))
        a, b = (x0 - ab * k[6] - k[7] * (r2 + 2 * a * a)) / scale, (y0 - k[6] * (r2 + 2 * b * b) - ab * k[7]) / scale
    return pd.DataFrame({"x": a, "y": b})


@F.pandas_udf(_SCHEMA)
def _false_position(x: pd.Series, y: pd.Series, k1: pd.Series, k2: pd.Series, k3: pd.Series, k4: pd.Series, k5: pd.Series, k6: pd.Series, p1: pd.Series, p2: pd.Series) -> pd.DataFrame:
    """Along the ray through the point, the radius whose distortion comes nearest to it, by bracketing secants."""
    x0, y0 = x.to_numpy(float), y.to_numpy(float)
    k = [s.to_numpy(float) for s in (k1, k2, k3, k4, k5, k6, p1, p2)]
    target = np.hypot(x0, y0)
    ux, uy = np.divide(x0, target, out=np.zeros_like(x0), where=target > 0), np.divide(y0, target, out=np.zeros_like(y0), where=target > 0)
    shift_x, shift_y = np.zeros_like(x0), np.zeros_like(y0)
    a = b = None
    for _ in range(12):  # the tangential part is small: settle the radius, then correct the direction
        goal = np.hypot(x0 - shift_x, y0 - shift_y)
        ux, uy = np.divide(x0 - shift_x, goal, out=np.zeros_like(x0), where=goal > 0), np.divide(y0 - shift_y, goal, out=np.zeros_like(y0), where=goal > 0)
        zero = np.zeros_like(x0)
        radial = [*k[:6], zero, zero]

        def miss(r: np.ndarray) -> np.ndarray:
            return np.hypot(*bend(radial, ux * r, uy * r)) - goal

        low, high = np.zeros_like(goal), 2 * goal + 1e-3
        f_low, f_high = miss(low), miss(high)
        for _ in range(100):
            den = f_high - f_low
            mid = np.where(den != 0, high - f_high * (high - low) / np.where(den != 0, den, 1), (low + high) / 2)
            mid = np.clip(mid, low, high)
            f_mid = miss(mid)
            same = np.sign(f_mid) == np.sign(f_high)
            f_low = np.where(same, f_low / 2, f_high)
            low = np.where(same, low, high)
            high, f_high = mid, f_mid
            if np.nanmax(np.abs(f_mid), initial=0) < 1e-15:
                break
            swap = low > high
            low, high = np.where(swap, high, low), np.where(swap, low, high)
            f_low, f_high = np.where(swap, f_high, f_low), np.where(swap, f_low, f_high)
        a, b = ux * high, uy * high
        r2, ab = a * a + b * b, 2 * a * b
        shift_x, shift_y = ab * k[6] + k[7] * (r2 + 2 * a * a), k[6] * (r2 + 2 * b * b) + ab * k[7]
    return pd.DataFrame({"x": a, "y": b})


def _arguments(cam: dict[str, Column], x: Column, y: Column) -> list[Column]:
    return [x, y, *[cam[n] for n in _COEFFS]]


def fixed_point(cam: dict[str, Column], x: Column, y: Column) -> Column:
    """Struct x, y after 20 fixed-point steps (``functions.camera.undistort_oulu`` without the interpreted fold)."""
    return _fixed_point(*_arguments(cam, x, y))


def false_position(cam: dict[str, Column], x: Column, y: Column) -> Column:
    return _false_position(*_arguments(cam, x, y))


def by_lookup(cam: dict[str, Column], x: Column, y: Column, density: int = 256) -> Column:
    """Struct x, y by linear interpolation in a distorted lattice.

    A lattice over twice the extent of the points is distorted; each cell gives two triangles; a point is undone inside the
    triangle that holds it, which a few walks over the lattice find.  Rows of one camera come together in a batch.
    """

    @F.pandas_udf(_SCHEMA)
    def run(x: pd.Series, y: pd.Series, k1: pd.Series, k2: pd.Series, k3: pd.Series, k4: pd.Series, k5: pd.Series, k6: pd.Series, p1: pd.Series, p2: pd.Series) -> pd.DataFrame:
        k = np.column_stack([s.to_numpy(float) for s in (k1, k2, k3, k4, k5, k6, p1, p2)])
        out = np.full((len(x), 2), np.nan)
        points = np.column_stack([x.to_numpy(float), y.to_numpy(float)])
        cams, which = np.unique(k, axis=0, return_inverse=True)
        for c, coeffs in enumerate(cams):
            mine = np.flatnonzero(which.ravel() == c)
            p = points[mine]
            reach = 1.5 * max(1e-6, float(np.abs(p).max()))
            axis = np.linspace(-reach, reach, density + 1)
            gx, gy = np.meshgrid(axis, axis)
            bx, by = bend(list(coeffs), gx, gy)
            step = axis[1] - axis[0]
            at = p.copy()
            for _ in range(30):  # walk: where is the point in the cell it is thought to lie in
                i = np.clip(((at + reach) / step).astype(int), 0, density - 1)
                col, row = i[:, 0], i[:, 1]
                frac = (at + reach) / step - i
                lower = frac.sum(1) <= 1
                ox, oy = np.where(lower, col, col + 1), np.where(lower, row, row + 1)
                sx, sy = np.where(lower, 1, -1), np.where(lower, 1, -1)
                e1 = np.column_stack([bx[oy, ox + sx] - bx[oy, ox], by[oy, ox + sx] - by[oy, ox]])
                e2 = np.column_stack([bx[oy + sy, ox] - bx[oy, ox], by[oy + sy, ox] - by[oy, ox]])
                d = p - np.column_stack([bx[oy, ox], by[oy, ox]])
                det = e1[:, 0] * e2[:, 1] - e1[:, 1] * e2[:, 0]
                s = (d[:, 0] * e2[:, 1] - d[:, 1] * e2[:, 0]) / det
                t = (e1[:, 0] * d[:, 1] - e1[:, 1] * d[:, 0]) / det
                new = np.column_stack([axis[ox] + s * sx * step, axis[oy] + t * sy * step])
                new = np.clip(new, -reach, reach)
                done = np.abs(new - at).max(initial=0) < 1e-15
                at = new
                if done:
                    break
            out[mine] = at
        return pd.DataFrame({"x": out[:, 0], "y": out[:, 1]})

    return run(*_arguments(cam, x, y))
