"""Particle-filter motion tracking: one group a track, tracks spread over the cluster.

A track never needs whole images: ``patches`` joins each track's window with the image rows it crosses and slices them, so
what reaches a track's group is a bounded patch for each frame.  ``track`` then runs the filter in numpy for each track, with
random numbers from the track's own seed, and records an error for a track that fails without stopping the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- splines


def spline_weights(n: int, at: np.ndarray) -> np.ndarray:
    """Weights (len(at), n) of the interpolating cubic spline through values at 0 .. n - 1 with not-a-knot ends (of lower
    degree for fewer than four values)."""
    at = np.asarray(at, float)
    if n == 1:
        return np.ones((len(at), 1))
    if n < 4:
        nodes = np.arange(n)
        return np.stack([np.prod([(at - m) / (j - m) for m in nodes if m != j], axis=0) for j in nodes], axis=1)
    # Second derivatives m: the usual three-term relation inside, equal third derivatives across the second and last but one.
    a, rhs = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = 1, 4, 1
        rhs[i, i - 1 : i + 2] = 6, -12, 6
    a[0, :3] = 1, -2, 1
    a[-1, -3:] = 1, -2, 1
    second = np.linalg.solve(a, rhs)
    k = np.clip(np.floor(at).astype(int), 0, n - 2)
    t = at - k
    out = np.zeros((len(at), n))
    rows = np.arange(len(at))
    out[rows, k] += 1 - t
    out[rows, k + 1] += t
    return out + (((1 - t) ** 3 - (1 - t)) / 6)[:, None] * second[k] + ((t**3 - t) / 6)[:, None] * second[k + 1]


def spline_sample(tile: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Bivariate cubic spline through a tile's cell centres, at points in cells."""
    return np.einsum("qi,ij,qj->q", spline_weights(tile.shape[0], rows), tile, spline_weights(tile.shape[1], cols))


def spline_shift(tile: np.ndarray, drow: float, dcol: float) -> np.ndarray:
    """A tile sampled half a cell or less beside its centres."""
    return spline_weights(tile.shape[0], np.arange(tile.shape[0]) + drow) @ tile @ spline_weights(tile.shape[1], np.arange(tile.shape[1]) + dcol).T


# ---- templates


def window_median(tile: np.ndarray, radius: int = 2) -> np.ndarray:
    padded = np.pad(tile, radius, mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, (2 * radius + 1, 2 * radius + 1)), axis=(2, 3))


def prepare(tile: np.ndarray, histogram: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """A tile with mean 0 and variance 1, matched to a template's distribution, less its local median."""
    spread = tile.std()
    tile = (tile - tile.mean()) / (spread if spread > 0 else 1.0)
    values, counts = np.unique(tile, return_counts=True)
    own = (values, np.cumsum(counts) / tile.size)
    if histogram is not None:
        tile = np.interp(own[1][np.searchsorted(values, tile)], histogram[1], histogram[0])
    return tile - window_median(tile), own


def squared_difference(search: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Mean squared difference of a template at every place of a search tile."""
    views = np.lib.stride_tricks.sliding_window_view(search, template.shape)
    return ((views - template) ** 2).mean(axis=(2, 3))


# ---- motion models: functions of (parameters, random numbers); p is an (n, 6) array of positions and velocities


class Motion:
    """Constant velocity.  Parameters (all optional but x, y): z, sigmas sx, sy, velocity vx, vy, vz with svx, svy, svz,
    acceleration ax, ay, az with sax, say, saz, surface uncertainty dem_sigma; ``dem`` gives heights at (x, y)."""

    def __init__(self, params: dict, dem=None):
        self.params = params
        self.dem = dem or (lambda x, y: np.full(len(x), params.get("z", 0.0)))

    def of(self, *names: str) -> np.ndarray:
        return np.array([float(self.params.get(n) or 0.0) for n in names])

    def start(self, n: int, rng: np.random.Generator) -> np.ndarray:
        p = np.zeros((n, 6))
        p[:, :2] = self.of("x", "y")
        p[:, 3:] = self.of("svx", "svy", "svz") * rng.standard_normal((n, 3))
        return p

    def evolve(self, p: np.ndarray, dt: float, rng: np.random.Generator) -> None:
        p[:, :3] += dt * p[:, 3:]

    def nll(self, p: np.ndarray) -> np.ndarray | None:
        return None


class Cartesian(Motion):
    def _place(self, n: int, rng: np.random.Generator) -> np.ndarray:
        p = np.zeros((n, 6))
        p[:, :2] = self.of("x", "y") + self.of("sx", "sy") * rng.standard_normal((n, 2))
        p[:, 2] = self.dem(p[:, 0], p[:, 1]) + self.of("dem_sigma")[0] * rng.standard_normal(n)
        return p

    def velocity(self, n: int, rng: np.random.Generator) -> np.ndarray:
        return self.of("vx", "vy", "vz") + self.of("svx", "svy", "svz") * rng.standard_normal((n, 3))

    def acceleration(self, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return self.of("ax", "ay", "az") + self.of("sax", "say", "saz") * rng.standard_normal((len(p), 3))

    def start(self, n: int, rng: np.random.Generator) -> np.ndarray:
        p = self._place(n, rng)
        p[:, 3:] = self.velocity(n, rng)
        return p

    def evolve(self, p: np.ndarray, dt: float, rng: np.random.Generator) -> None:
        a = self.acceleration(p, rng)
        p[:, :3] += dt * p[:, 3:] + 0.5 * a * dt**2
        p[:, 3:] += dt * a

    def nll(self, p: np.ndarray) -> np.ndarray | None:
        sigma = self.of("dem_sigma")[0]
        return None if not sigma else (self.dem(p[:, 0], p[:, 1]) - p[:, 2]) ** 2 / (2 * sigma**2)


class Cylindrical(Cartesian):
    """Velocity (vr, vth, vz) and acceleration (ar, ath, az) by radius and angle."""

    def velocity(self, n: int, rng: np.random.Generator) -> np.ndarray:
        v = self.of("vr", "vth", "vz") + self.of("svr", "svth", "svz") * rng.standard_normal((n, 3))
        return np.column_stack([v[:, 0] * np.cos(v[:, 1]), v[:, 0] * np.sin(v[:, 1]), v[:, 2]])

    def acceleration(self, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        a = self.of("ar", "ath", "az") + self.of("sar", "sath", "saz") * rng.standard_normal((len(p), 3))
        speed = np.hypot(p[:, 3], p[:, 4])
        along = np.divide(p[:, 3:5], speed[:, None], out=np.zeros((len(p), 2)), where=speed[:, None] > 0)
        return np.column_stack([a[:, 0] * along[:, 0] - p[:, 4] * a[:, 1], a[:, 0] * along[:, 1] + p[:, 3] * a[:, 1], a[:, 2]])


class _Tangent:
    """Stays at its offset from the surface, which walks with slope_sigma for each unit of way."""

    def evolve(self, p: np.ndarray, dt: float, rng: np.random.Generator) -> None:
        a = self.acceleration(p, rng)[:, :2]
        way = dt * p[:, 3:5] + 0.5 * a * dt**2
        offset = p[:, 2] - self.dem(p[:, 0], p[:, 1]) + self.of("slope_sigma")[0] * rng.standard_normal(len(p)) * np.hypot(way[:, 0], way[:, 1])
        p[:, :2] += way
        p[:, 2] = self.dem(p[:, 0], p[:, 1]) + offset
        p[:, 3:5] += dt * a

    def velocity(self, n: int, rng: np.random.Generator) -> np.ndarray:
        v = super().velocity(n, rng)
        v[:, 2] = 0.0
        return v

    def nll(self, p: np.ndarray) -> None:
        return None


class TangentCartesian(_Tangent, Cartesian):
    pass


class TangentCylindrical(_Tangent, Cylindrical):
    pass


MODELS = {"base": Motion, "cartesian": Cartesian, "cylindrical": Cylindrical, "tangent_cartesian": TangentCartesian, "tangent_cylindrical": TangentCylindrical}


def resample(weights: np.ndarray, method: str, rng: np.random.Generator) -> np.ndarray:
    """Indices of the particles drawn: systematic, stratified, residual or choice."""
    n = len(weights)
    share = weights / weights.sum()
    if method == "residual":
        copies = np.floor(n * share).astype(int)
        kept = np.repeat(np.arange(n), copies)
        left = n * share - copies
        rest = n - len(kept)
        return np.concatenate([kept, rng.choice(n, rest, p=left / left.sum())]) if rest else kept
    if method == "choice":
        return rng.choice(n, n, p=share)
    u = rng.random() if method == "systematic" else rng.random(n)
    return np.minimum(np.searchsorted(np.cumsum(share), (np.arange(n) + u) / n), n - 1)


# ---- the filter


def patches(tracks: DataFrame, image_rows: DataFrame, reach: int) -> DataFrame:
    """``track, step, t, row0, col0, pixels`` (list of rows) around each track's start (u, v) in every frame.

    ``image_rows`` has step, t, row and values (one row of pixels).  The join is by row number; a patch is as high as
    the window, so grouping it is bounded."""
    top, left = (F.floor(F.col(c)).cast("int") - reach for c in ("v", "u"))
    windows = tracks.select("track", F.greatest(top, F.lit(0)).alias("row0"), F.greatest(left, F.lit(0)).alias("col0"), F.explode(F.sequence(F.greatest(top, F.lit(0)), top + 2 * reach)).alias("row"))
    met = windows.join(image_rows, "row").select("track", "step", "t", "row0", "col0", "row", F.slice("values", F.col("col0") + 1, 2 * reach + 1).alias("values"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row", "values"))), lambda x: x["values"])
    return met.groupBy("track", "step", "t", "row0", "col0").agg(lines.alias("pixels"))


TRACK_SCHEMA = (
    "track long, step int, t double, x double, y double, z double, vx double, vy double, vz double, sx double, sy double, sz double, svx double, svy double, svz double, "
    "cov array<double>, reduced double, error string"
)


def track(frames: DataFrame, to_pixels, particles: int = 500, tile: int = 15, sigma: float = 0.3, method: str = "systematic", dem=None, models: dict | None = None, reduce=None) -> DataFrame:
    """Tracks from patches joined with their models: columns of ``patches`` plus kind, seed and params (map of numbers).

    ``to_pixels(points)`` maps an (n, 3) array to columns u, v.  Steps are frames in time; the template is cut at the
    first; weights come from the squared difference around each particle.  Weights are gathered with the particles and
    are not reset.  ``models`` adds motion models by kind; ``reduce(particles, weights)`` gives a number for each step.
    Results are means, sigmas (sx ..) and the 6 x 6 covariance, row by row."""
    known = MODELS | (models or {})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        rows, error = [], None
        first = pdf.iloc[0]
        try:
            rng = np.random.default_rng(int(first["seed"]))
            model = known[first["kind"]](dict(first["params"]), dem)
            p, w, template, before = None, np.ones(particles), None, None
            for _, f in pdf.iterrows():
                image = np.stack([np.asarray(r, float) for r in f["pixels"]])
                if p is None:
                    p = model.start(particles, rng)
                else:
                    model.evolve(p, f["t"] - before, rng)
                before = f["t"]
                corner = np.array([f["col0"], f["row0"]], float)
                half = tile // 2
                if template is None:
                    at = to_pixels(np.average(p[:, :3], axis=0, weights=w)[None])[0] - corner
                    c, r = np.floor(at).astype(int)
                    if min(r - half, c - half) < 0 or r + half >= image.shape[0] or c + half >= image.shape[1]:
                        raise ValueError("the template leaves the image")
                    cut, histogram = prepare(image[r - half : r + half + 1, c - half : c + half + 1])
                    template = (cut, histogram, at - (np.array([c, r]) + 0.5))
                else:
                    uv = to_pixels(p[:, :3]) - corner - template[2]
                    low = np.floor(uv.min(axis=0)).astype(int) - half - 2
                    high = np.ceil(uv.max(axis=0)).astype(int) + half + 3
                    if (low < 0).any() or high[0] > image.shape[1] or high[1] > image.shape[0]:
                        error = "particles too close to the border, frame skipped"
                    else:
                        search, _ = prepare(image[low[1] : high[1], low[0] : high[0]], template[1])
                        sse = squared_difference(search, template[0])
                        cost = spline_sample(sse, uv[:, 1] - low[1] - half - 0.5, uv[:, 0] - low[0] - half - 0.5) / (2 * sigma**2)
                        more = model.nll(p)
                        total = cost if more is None else cost + more
                        w = np.exp(-total) + 1e-300
                        drawn = resample(w, method, rng)
                        p, w = p[drawn], w[drawn]
                mean = np.average(p, axis=0, weights=w)
                off = p - mean
                cov = (off * w[:, None]).T @ off / w.sum()
                reduced = None if reduce is None else float(reduce(p, w))
                rows.append((first["track"], int(f["step"]), float(f["t"]), *mean, *np.sqrt(np.maximum(np.diag(cov), 0)), cov.ravel().tolist(), reduced, error))
        except Exception as e:  # one track's failure is a value of its own
            rows.append((first["track"], -1, np.nan, *[np.nan] * 12, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TRACK_SCHEMA.split(", ")])

    return frames.groupBy("track").applyInPandas(run, TRACK_SCHEMA)
