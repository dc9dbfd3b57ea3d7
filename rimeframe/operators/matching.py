"""Keypoint matching, match filters and the match graph.

The keypoints of an image are dealt into blocks by a hash of their number, and each two blocks of an image pair are one group:
a matrix product names the candidates, and only those within its rounding error of the two nearest are worked out exactly.  So
every descriptor is compared with every other one of its pair, a group's memory is that of two blocks, and a pair with many
keypoints is many tasks' work.  What leaves a group is two rows a keypoint and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keypoints of a block, on average; rows whose distances are held at once; candidates worked out at once.
BLOCK, ROWS, EXACT = 4096, 512, 1 << 16


def root_sift(descriptor: Column) -> Column:
    """Square root of the L1-normalised descriptor."""
    total = F.aggregate(descriptor, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return F.transform(descriptor, lambda x: F.signum(x.cast("double")) * F.sqrt(F.abs(x.cast("double")) / (total + 1e-7)))


def _descriptors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors as rows of numbers and which of them are there; shorter ones are filled up with missing numbers."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = pc.list_flatten(column)
    there = np.arange(size.max(initial=0)) < size[:, None]
    values, ok = np.zeros(there.shape), there.copy()
    ok[there] = pc.is_valid(flat).to_numpy()
    values[there] = pc.fill_null(pc.cast(flat, pa.float64()), 0.0).to_numpy()
    return values, ok


def _widened(values: np.ndarray, ok: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    more = ((0, 0), (0, n - values.shape[1]))
    return np.pad(values, more), np.pad(ok, more)


def _exact(x: np.ndarray, y: np.ndarray, ok_x: np.ndarray | None, ok_y: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of rows i of x and j of y, summed in order over numbers that both have, and whether there are any."""
    d, known = np.empty(len(i)), np.ones(len(i), bool)
    for at in range(0, len(i), EXACT):
        ii, jj = i[at : at + EXACT], j[at : at + EXACT]
        square = (x[ii] - y[jj]) ** 2
        if ok_x is not None:
            both = ok_x[ii] & ok_y[jj]
            square[~both] = 0.0
            known[at : at + EXACT] = both.any(axis=1)
        d[at : at + EXACT] = np.sqrt(np.cumsum(square, axis=1)[:, -1]) if square.shape[1] else 0.0
    return d, known


def _first(group: np.ndarray, d: np.ndarray, known: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Places of the n first of each group by distance, then rank; unknown distances come last."""
    order = np.lexsort((rank, d, ~known, group))
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[place < n]


def nearest_of_blocks(x: np.ndarray, y: np.ndarray, ok_x: np.ndarray, ok_y: np.ndarray, rank_x: np.ndarray, rank_y: np.ndarray, back: bool) -> tuple[tuple, tuple]:
    """The two nearest rows of y of each row of x, and (``back``) the nearest row of x of each row of y: i, j, d, known."""
    n = max(x.shape[1], y.shape[1], 1)
    (x, ok_x), (y, ok_y) = _widened(x, ok_x, n), _widened(y, ok_y, n)
    with np.errstate(over="ignore", invalid="ignore"):
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    # A product tells candidates apart only where all numbers are there and finite; else all pairs are worked out.
    plain = bool(ok_x.all() and ok_y.all() and np.isfinite(xx).all() and np.isfinite(yy).all())
    mask = (None, None) if plain else (ok_x, ok_y)
    there, again = [], []
    rows = ROWS if plain else max(1, min(ROWS, 8 * EXACT // max(len(y), 1)))
    for at in range(0, len(x), rows):
        part = x[at : at + rows]
        if plain:
            far = xx[at : at + rows, None] + yy - 2.0 * (part @ y.T)
            # Far above the rounding of the product, and above that of the root, which can make distances equal.
            slack = 1e-12 * (xx[at : at + rows, None].max() + yy.max())
            if back:
                near = np.nonzero(far <= far.min(axis=0) + slack)
            first = far.argmin(axis=1)
            line = np.arange(len(part))
            least = far[line, first]
            far[line, first] = np.inf
            second = far.min(axis=1)
            far[line, first] = least
            i, j = np.nonzero(far <= (np.where(np.isfinite(second), second, least) + slack)[:, None])
        else:
            i, j = (k.ravel() for k in np.indices((len(part), len(y))))
            near = i, j
        i = i + at
        d, known = _exact(x, y, *mask, i, j)
        keep = _first(i, d, known, rank_y[j], 2)
        there.append((i[keep], j[keep], d[keep], known[keep]))
        if back:
            i, j = near[0] + at, near[1]
            d, known = _exact(x, y, *mask, i, j)
            keep = _first(j, d, known, rank_x[i], 1)
            again.append((i[keep], j[keep], d[keep], known[keep]))
    out = tuple(np.concatenate(c) for c in zip(*there))
    if not back:
        return out, ()
    i, j, d, known = (np.concatenate(c) for c in zip(*again))
    keep = _first(j, d, known, rank_x[i], 1)
    return out, (i[keep], j[keep], d[keep], known[keep])


def _blocks(keypoints: DataFrame) -> DataFrame:
    """How many blocks each image has."""
    return keypoints.groupBy("img").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))


def candidates(keypoints: DataFrame, image_pairs: DataFrame, back: bool, apart: bool) -> DataFrame:
    """For each two blocks of an image pair: rows (img_i, img_j, back, own, other, d[, apart]) with the two nearest right
    keypoints of each left one and, with ``back``, the nearest left one of each right one."""
    extra = ["u", "v"] if apart else []
    n = _blocks(keypoints)
    pairs = image_pairs.select("img_i", "img_j").join(n.select(F.col("img").alias("img_i"), F.col("n").alias("n_i")), "img_i")
    pairs = pairs.join(n.select(F.col("img").alias("img_j"), F.col("n").alias("n_j")), "img_j")
    sides = []
    for me, it in ("ij", "ji"):
        k = keypoints.select(F.col("img").alias(f"img_{me}"), "kp", "descriptor", *[F.col(c).cast("double").alias(c) for c in extra])
        own, all_others = F.pmod(F.xxhash64("kp"), F.col(f"n_{me}")).cast("int"), F.explode(F.sequence(F.lit(0), F.col(f"n_{it}") - 1))
        met = pairs.join(k, f"img_{me}").withColumn(f"b_{me}", own).withColumn(f"b_{it}", all_others)
        sides.append(met.select("img_i", "img_j", "b_i", "b_j", F.lit(me == "j").alias("right"), "kp", "descriptor", *extra))
    types = {f.name: f.dataType for f in keypoints.schema} | {f.name: f.dataType for f in image_pairs.schema}
    fields = [("img_i", types["img_i"]), ("img_j", types["img_j"]), ("back", T.BooleanType()), ("own", types["kp"]), ("other", types["kp"]), ("d", T.DoubleType())] + ([("apart", T.DoubleType())] if apart else [])
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(t: pa.Table) -> pa.Table:
        left, right = t.filter(pc.invert(t["right"])), t.filter(t["right"])
        if not left.num_rows or not right.num_rows:
            return pa.table({f: t[f if f in ("img_i", "img_j") else "kp"].slice(0, 0) for f, _ in fields[:2]} | {"back": pa.array([], pa.bool_()), "own": t["kp"].slice(0, 0), "other": t["kp"].slice(0, 0)} | {f: pa.array([], pa.float64()) for f, _ in fields[5:]})
        (x, ok_x), (y, ok_y) = _descriptors(left["descriptor"]), _descriptors(right["descriptor"])
        ranks = [np.argsort(np.argsort(k.to_numpy(zero_copy_only=False) if k.null_count == 0 else k.fill_null(0).to_numpy(zero_copy_only=False), kind="stable"), kind="stable") for k in (c["kp"].combine_chunks() for c in (left, right))]
        out = []
        for side, (i, j, d, known) in enumerate(r for r in nearest_of_blocks(x, y, ok_x, ok_y, *ranks, back) if r):
            li, rj = left.take(pa.array(i)), right.take(pa.array(j))
            own, other = (rj["kp"], li["kp"]) if side else (li["kp"], rj["kp"])
            columns = {"img_i": li["img_i"], "img_j": li["img_j"], "back": pa.array(np.full(len(i), bool(side))), "own": own, "other": other, "d": pa.array(d, mask=~known)}
            if apart:
                du, dv = (pc.subtract(li[c], rj[c]) for c in "uv")
                columns["apart"] = pc.sqrt(pc.add(pc.multiply(du, du), pc.multiply(dv, dv)))
            out.append(pa.table(columns))
        return pa.concat_tables(out)

    spark = keypoints.sparkSession
    keys = ["img_i", "img_j", "b_i", "b_j"]
    # A number of partitions: small ones, which adaptive execution would join into few, are much work.
    met = sides[0].unionByName(sides[1]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    return met.groupBy(*keys).applyInArrow(run, schema)


def match_keypoints(keypoints: DataFrame, image_pairs: DataFrame, max_ratio: float | None = None, mutual: bool = False, max_distance: float | None = None) -> DataFrame:
    """Matches of keypoints (img, kp, descriptor[, u, v]) between the images of each pair (img_i, img_j).

    Keeps a match if its distance is below ``max_ratio`` times the second best, if each is the other's nearest
    (``mutual``), and if both lie within ``max_distance`` pixels.  Weight is the inverse ratio."""
    near = candidates(keypoints, image_pairs, mutual, max_distance is not None)
    more = ["apart"] if max_distance is not None else []
    side = ["img_i", "img_j", "back", "own"]
    order = Window.partitionBy(*side).orderBy(F.asc_nulls_last("d"), "other")
    near = near.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    best = near.groupBy(*side).agg(F.min(F.struct("_r", "other", "d", *more)).alias("b"), F.max(F.when(F.col("_r") == 2, F.col("d"))).alias("d2"))
    kp_i, kp_j = (F.when(F.col("back"), F.col(a)).otherwise(F.col(b)) for a, b in (("b.other", "own"), ("own", "b.other")))
    out = best.select("img_i", "img_j", "back", kp_i.alias("kp_i"), kp_j.alias("kp_j"), F.col("b.d").alias("d1"), "d2", *[F.col(f"b.{c}").alias(c) for c in more])
    if mutual:  # both directions name the same pair: two rows of one group, so the distances are worked out once
        there = F.max(F.when(~F.col("back"), F.struct("d1", "d2", *more))).alias("f")
        out = out.groupBy("img_i", "img_j", "kp_i", "kp_j").agg(there, F.bool_or("back").alias("back")).where("f IS NOT NULL AND back").select("img_i", "img_j", "kp_i", "kp_j", "f.*")
    else:
        out = out.drop("back")
    out = out.withColumn("ratio", F.col("d1") / F.when(F.col("d2") > 0, F.col("d2")))
    if max_ratio is not None:
        out = out.where(F.col("ratio") < max_ratio)
    if max_distance is not None:
        out = out.where(F.col("apart") < max_distance).drop("apart")
    return out.withColumn("weight", F.when(F.col("d1") > 0, F.col("d2") / F.col("d1")).when(F.col("d2") > 0, F.lit(float("inf"))))


def filter_matches(matches: DataFrame, pair: list[str], n_best: int | None = None, min_weight: float | None = None, max_error: float | None = None, max_distance: float | None = None, order: str = "m_id") -> DataFrame:
    """The n best by weight, then by weight, error and distance, in this order."""
    if n_best is not None:
        best = F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("w"), order))
        matches = matches.withColumn("_k", best).where(F.col("_k") <= n_best).drop("_k")
    for limit, ok in ((min_weight, lambda x: F.col("w") >= x), (max_error, lambda x: F.col("error") <= x), (max_distance, lambda x: F.col("distance") <= x)):
        if limit is not None:
            matches = matches.where(ok(limit))
    return matches


def per_image(edges: DataFrame) -> DataFrame:
    """Total matched points of each image and the number of images it has any with; edges are img_i, img_j, size."""
    ends = edges.select(F.explode(F.array("img_i", "img_j")).alias("img"), "size")
    return ends.groupBy("img").agg(F.sum("size").alias("matches"), F.count_if(F.col("size") > 0).alias("images"))


def breaks(edges: DataFrame, images: DataFrame, least: int) -> DataFrame:
    """Images (img, n: places from 0) that start no chain to the next ones: fewer than ``least`` points in all, and not
    the last."""
    starts = edges.groupBy(F.col("img_i").alias("img")).agg(F.sum("size").alias("size"))
    last = images.agg(F.max("n").alias("last"))
    return images.join(starts, "img", "left").crossJoin(last).where((F.col("n") < F.col("last")) & (F.coalesce("size", F.lit(0)) < least)).select("img")


def drop_images(edges: DataFrame, images: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images without ``gone`` and without those left unmatched, numbered anew, and the edges between them."""
    kept = edges.join(gone.select(F.col("img").alias("img_i")), "img_i", "left_anti").join(gone.select(F.col("img").alias("img_j")), "img_j", "left_anti").where("size > 0")
    matched = kept.select(F.explode(F.array("img_i", "img_j")).alias("img")).distinct()
    left = images.join(matched, "img", "left_semi")
    # Numbered by counting smaller places, in one small table.
    place = F.row_number().over(Window.orderBy("n")) - 1
    return left.withColumn("new", place).select("img", "new"), kept
