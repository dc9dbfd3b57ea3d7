"""Calibration: residuals as rows, their sums over the cluster, and small solvers on the driver.

The driver only ever holds parameters and normal equations (their size is the number of parameters), never residuals.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_equations(rows: DataFrame, residuals: list[Column], jacobian: list[list[Column]], weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """J'J, J'r, r'r and the number of rows, in one aggregation; rows with a missing residual are left out."""
    n = len(jacobian[0])
    w = F.lit(1.0) if weight is None else weight
    sums = []
    for i in range(n):
        sums += [F.sum(sum((w * row[i] * row[j] for row in jacobian[1:]), w * jacobian[0][i] * jacobian[0][j])).alias(f"a{i}_{j}") for j in range(i, n)]
        sums.append(F.sum(sum((w * row[i] * r for row, r in zip(jacobian[1:], residuals[1:])), w * jacobian[0][i] * residuals[0])).alias(f"b{i}"))
    sums.append(F.sum(sum((w * r * r for r in residuals[1:]), w * residuals[0] * residuals[0])).alias("c"))
    got = rows.agg(*sums, F.count(residuals[0]).alias("n")).first()
    a = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = got[f"a{i}_{j}"] or 0.0
    return a, np.array([got[f"b{i}"] or 0.0 for i in range(n)]), float(got["c"] or 0.0), int(got["n"])


def sums_by_group(rows: DataFrame, group: str, columns: list[str], kernel: Callable[[object, np.ndarray, np.ndarray], np.ndarray], params: dict, step: np.ndarray) -> dict:
    """J'J, J'r and r'r for each group of ``params``, of a numpy residual function (group, data, params) -> (rows, k), with
    differences for the Jacobian: one pass for all groups.

    Each partition gives one row of sums a group; rows of other groups are left out, and nothing is kept in memory."""
    n = len(step)
    size = n * n + n + 1

    def run(batches):
        totals = {g: np.zeros(size) for g in params}
        for pdf in batches:
            of, every = pdf[group].to_numpy(), pdf[columns].to_numpy(float)
            for g, p in params.items():
                data = every[of == g]
                if not len(data):
                    continue
                base = kernel(g, data, p)
                ok = ~np.isnan(base).any(axis=1)
                data, base = data[ok], base[ok].ravel()
                jac = np.empty((len(base), n))
                for i in range(n):
                    moved, back = p.copy(), p.copy()
                    moved[i] += step[i]
                    back[i] -= step[i]
                    jac[:, i] = (kernel(g, data, moved).ravel() - kernel(g, data, back).ravel()) / (2 * step[i])
                jac = np.nan_to_num(jac)
                totals[g] += np.concatenate([(jac.T @ jac).ravel(), jac.T @ base, [base @ base]])
        yield pd.DataFrame({"g": np.repeat(np.arange(len(params)), size), "k": np.tile(np.arange(size), len(params)), "s": np.concatenate(list(totals.values()))})

    got = rows.select(group, *columns).where(F.col(group).isin(list(params))).mapInPandas(run, "g long, k long, s double").groupBy("g", "k").agg(F.sum("s").alias("s")).collect()
    flat = np.zeros((len(params), size))
    for r in got:
        flat[r["g"], r["k"]] = r["s"]
    return {g: (f[: n * n].reshape(n, n), f[n * n : -1], f[-1]) for g, f in zip(params, flat)}


def levenberg_marquardt_groups(sums: Callable[[dict], dict], start: dict, steps: int = 30, tolerance: float = 1e-12, least: float = 1e-9) -> dict:
    """As ``levenberg_marquardt``, of many groups (key: start) side by side: ``sums`` gives those of all groups that are not
    done, by key, in one pass.  A group is also done once its parameters move by less than ``least``."""
    x = {k: v.astype(float).copy() for k, v in start.items()}
    state, damp, left = sums(x), {k: 1e-3 for k in x}, set(x)
    for _ in range(steps):
        moves = {}
        for k in sorted(left):
            a, b, _ = state[k]
            try:
                moves[k] = -np.linalg.solve(a + damp[k] * np.diag(np.maximum(np.diag(a), 1e-12)), b)
            except np.linalg.LinAlgError:
                damp[k] *= 10
        if not moves:
            continue
        new = sums({k: x[k] + m for k, m in moves.items()})
        for k, m in moves.items():
            cost = state[k][2]
            if new[k][2] < cost:
                done = cost - new[k][2] <= tolerance * max(cost, 1e-30) or np.abs(m).max() < least
                x[k], state[k], damp[k] = x[k] + m, new[k], max(damp[k] / 10, 1e-12)
            else:
                damp[k] *= 10
                done = damp[k] > 1e12 or np.abs(m).max() < least
            if done:
                left.discard(k)
        if not left:
            break
    return x


def levenberg_marquardt(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, float]], start: np.ndarray, bounds: np.ndarray | None = None, steps: int = 30, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """Damped Gauss-Newton within bounds; ``sums`` gives J'J, J'r and r'r at a point (one pass over the data each)."""
    x = start.astype(float).copy()
    a, b, cost = sums(x)
    damp = 1e-3
    for _ in range(steps):
        scale = np.maximum(np.diag(a), 1e-12)
        try:
            move = -np.linalg.solve(a + damp * np.diag(scale), b)
        except np.linalg.LinAlgError:
            damp *= 10
            continue
        new = x + move
        if bounds is not None:
            new = np.clip(new, bounds[:, 0], bounds[:, 1])
        na, nb, ncost = sums(new)
        if ncost < cost:
            done = cost - ncost <= tolerance * max(cost, 1e-30)
            x, a, b, cost, damp = new, na, nb, ncost, max(damp / 10, 1e-12)
            if done:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    return x, cost


def inconsistencies(cameras: DataFrame, groups: DataFrame, controls: DataFrame) -> DataFrame:
    """What would make a fit of cameras go wrong: rows (error, id).

    ``cameras``: cam_id, nx, ny, params (names of its own free parameters); ``groups``: group_id, cam_id, params (names that
    its cameras share); ``controls``: control, cam_id.  Errors are "no controls" (no id), "image sizes" (a group that shares f
    or c among images of different sizes), "groups overlap" (a camera in two groups that share a parameter) and
    "not in controls" (a camera with free parameters that no control sees)."""
    none = controls.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no controls").alias("error"), F.lit(None).cast("long").alias("id"))
    joined = groups.join(cameras.select("cam_id", "nx", "ny"), "cam_id").where(F.arrays_overlap("params", F.array(F.lit("f"), F.lit("c"))))
    sizes = joined.groupBy("group_id").agg(F.count_distinct("nx", "ny").alias("n")).where("n > 1").select(F.lit("image sizes").alias("error"), F.col("group_id").cast("long").alias("id"))
    shared = groups.select("cam_id", "group_id", F.explode("params").alias("p")).groupBy("cam_id", "p").agg(F.count_distinct("group_id").alias("n")).where("n > 1")
    overlap = shared.select(F.lit("groups overlap").alias("error"), F.col("cam_id").cast("long").alias("id")).distinct()
    free = cameras.where(F.size("params") > 0).select("cam_id").unionByName(groups.where(F.size("params") > 0).select("cam_id")).distinct()
    unseen = free.join(controls, "cam_id", "left_anti").select(F.lit("not in controls").alias("error"), F.col("cam_id").cast("long").alias("id"))
    return none.unionByName(sizes).unionByName(overlap).unionByName(unseen)


def polynomial_fit(rows: DataFrame, x: str, y: str, degree: int) -> np.ndarray:
    """Coefficients, highest power first, from sums of powers."""
    powers = [F.sum(F.pow(F.col(x), F.lit(float(k)))).alias(f"s{k}") for k in range(2 * degree + 1)]
    mixed = [F.sum(F.pow(F.col(x), F.lit(float(k))) * F.col(y)).alias(f"t{k}") for k in range(degree + 1)]
    got = rows.agg(*powers, *mixed).first()
    a = np.array([[got[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    return np.linalg.solve(a, np.array([got[f"t{i}"] for i in range(degree + 1)]))[::-1]


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """Horner's scheme, highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + float(c)
    return out


def ransac_subsets(size: int, n: int, iterations: int, seed: int) -> list[list[int]]:
    """Different n-subsets of 0 .. size - 1, at most as many as there are."""
    from math import comb

    rng = np.random.default_rng(seed)
    wanted, out = min(iterations, comb(size, n)), set()
    while len(out) < wanted:
        out.add(tuple(sorted(rng.choice(size, n, replace=False).tolist())))
    return [list(s) for s in sorted(out)]


def ransac(model, n: int, max_error: float, min_inliers: int, iterations: int, seed: int) -> tuple[np.ndarray | None, np.ndarray]:
    """Robust fit of any model with ``size``, ``fit(index)`` and ``errors(params, index)``, on the driver.

    A sample's fit is accepted if more than ``min_inliers`` errors lie below ``max_error``; it is fitted again to them, and
    the least mean error wins.  Gives its parameters and the index of all errors up to ``max_error``."""
    best, params, everything = float("inf"), None, np.arange(model.size)
    for sample in ransac_subsets(model.size, n, iterations, seed):
        trial = model.fit(np.array(sample))
        inside = everything[model.errors(trial, everything) < max_error]
        if len(inside) <= min_inliers:
            continue
        trial = model.fit(inside)
        mean = float(np.mean(model.errors(trial, inside)))
        if mean < best:
            best, params = mean, trial
    inliers = everything[model.errors(params, everything) <= max_error] if params is not None else everything[:0]
    return params, inliers


def ransac_line(rows: DataFrame, ident: str, x: str, y: str, n: int, max_error: float, min_inliers: int, iterations: int, seed: int, size: int) -> tuple[list[float], float]:
    """A robust line: every subset's fit is scored in one pass over all rows; the accepted fit (more than ``min_inliers``
    within ``max_error``) of least mean error after a refit wins.  ``ident`` numbers the rows from 0."""
    spark = rows.sparkSession
    subsets = ransac_subsets(size, n, iterations, seed)
    samples = spark.createDataFrame([(k, i) for k, s in enumerate(subsets) for i in s], "trial int, member long")
    slope, cut = F.regr_slope(y, x), F.regr_intercept(y, x)
    fits = rows.join(samples, F.col(ident) == F.col("member")).groupBy("trial").agg(slope.alias("a"), cut.alias("b")).dropna()
    scored = rows.crossJoin(F.broadcast(fits)).where(F.abs(F.col(x) * F.col("a") + F.col("b") - F.col(y)) < max_error)
    refit = scored.groupBy("trial").agg(F.count("*").alias("k"), slope.alias("a"), cut.alias("b")).where(F.col("k") > min_inliers)
    error = F.abs(F.col(x) * F.col("a") + F.col("b") - F.col(y))
    judged = rows.crossJoin(F.broadcast(refit.select("trial", "a", "b"))).where(error <= max_error).groupBy("trial", "a", "b").agg(F.avg(error).alias("e"))
    best = judged.orderBy("e", "trial").first()
    return ([best["a"], best["b"]], best["e"]) if best else ([], float("inf"))
