"""Moments, sums of normals, distributions and resampling.

Sums of normals need only sums of w, w m, w s and (w s)^2, so any number of runs combine in one partial and one final
aggregation.  Distributions over a whole column are first reduced to distinct values with counts; a running sum over many
values is a sum inside buckets plus a running sum over the buckets' totals, so no window takes a whole column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_normals(mean: Column, sigma: Column, weight: Column | None = None, rho: float = 0.0, normalize: bool = True, ignore_null: bool = True) -> tuple[Column, Column]:
    """Aggregates: mean and sigma of the weighted sum of normals with pairwise correlation rho.

    A missing value is left out or, without ``ignore_null``, makes the result missing."""
    w = F.lit(1.0) if weight is None else weight
    there = mean.isNotNull() & sigma.isNotNull()
    w, a = F.when(there, w), F.when(there, w * sigma)
    total, m = F.sum(w), F.sum(w * mean)
    var = (1.0 - rho) * F.sum(a * a) + rho * F.sum(a) * F.sum(a)
    over = F.when(total != 0, total) if normalize else F.lit(1.0)
    whole = F.lit(True) if ignore_null else F.bool_and(there)
    return F.when(whole, m / over), F.when(whole, F.sqrt(var) / F.abs(over))


def weighted_moments(rows: DataFrame, keys: list[str], values: list[str], weight: str) -> DataFrame:
    """Weighted mean, biased sigma and biased covariance of each pair of columns, from one pass over centred values."""
    total = rows.groupBy(*keys).agg(F.sum(weight).alias("_w"), *[(F.sum(F.col(weight) * F.col(v)) / F.sum(weight)).alias(f"mean_{v}") for v in values])
    centred = rows.join(total, keys)
    d = {v: F.col(v) - F.col(f"mean_{v}") for v in values}
    out = []
    for i, a in enumerate(values):
        out += [(F.sum(F.col(weight) * d[a] * d[b]) / F.sum(weight)).alias(f"cov_{a}_{b}") for b in values[i:]]
    means = [F.first(f"mean_{v}").alias(f"mean_{v}") for v in values]
    got = centred.groupBy(*keys).agg(*means, *out)
    return got.withColumns({f"sigma_{v}": F.sqrt(f"cov_{v}_{v}") for v in values})


def distribution(rows: DataFrame, keys: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """Distinct values with their share of values at or below: keys, value, q.

    ``bucket`` grows with the value; with it a key's values are summed up bucket by bucket instead of in one window."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    if bucket is None:
        bucket = F.lit(0)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return running_sum(counts, keys, value, "n", "_c", bucket).join(totals, keys).select(*keys, value, (F.col("_c") / F.col("_t")).alias("q"))


def match_distribution(rows: DataFrame, value: str, source: DataFrame, target: DataFrame) -> DataFrame:
    """Values mapped through their own distribution onto the target's, linear in between and clamped at both ends.

    ``source`` and ``target`` are distributions (value, q) of one partition key ``part`` each.  The target's steps and the
    quantiles asked for are put in one order and each takes the steps on both sides: no range join.
    """
    ask = source.select("part", "q", F.col(value).alias("v"), F.lit(1).alias("side"), F.lit(None).cast("struct<q:double,v:double>").alias("t"))
    steps = target.select("part", "q", F.lit(None).cast("double").alias("v"), F.lit(0).alias("side"), F.struct(F.col("q"), F.col(value).alias("v")).alias("t"))
    upto = Window.partitionBy("part").orderBy("q", "side").rowsBetween(Window.unboundedPreceding, 0)
    back_to = Window.partitionBy("part").orderBy(F.desc("q"), F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
    both = ask.unionByName(steps).withColumns({"low": F.last("t", True).over(upto), "high": F.last("t", True).over(back_to)})
    share = (F.col("q") - F.col("low.q")) / (F.col("high.q") - F.col("low.q"))
    out = F.when(F.col("low").isNull(), F.col("high.v")).when(F.col("high").isNull(), F.col("low.v")).otherwise(F.col("low.v") + share * (F.col("high.v") - F.col("low.v")))
    return both.where("side = 1").select("part", F.col("v").alias(value), out.alias("matched"))


def running_sum(rows: DataFrame, keys: list[str], order: str, value: str, name: str, bucket: Column) -> DataFrame:
    """Sum of a column up to each row in order.  ``bucket`` grows with ``order``; windows run inside buckets, and over one
    row a bucket."""
    marked = rows.withColumn("_b", bucket)
    totals = marked.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_bb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("_b") == F.col("_bb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return marked.withColumn("_in", inside).join(starts, same).withColumn(name, F.col("_start") + F.col("_in")).drop("_b", "_bb", "_start", "_in", *[f"_{k}" for k in keys])


def _slots(cum: DataFrame, keys: list[str], ident: str, first: Column, last: Column) -> DataFrame:
    """One row for each draw from ``first`` to ``last`` (integers, inclusive) that a particle covers."""
    return cum.where(last >= first).select(*keys, F.explode(F.sequence(first, last)).alias("draw"), ident)


def resample_systematic(particles: DataFrame, keys: list[str], ident: str, weight: str, u: float, bucket: Column) -> DataFrame:
    """Draws i = 0 .. n - 1 at (i + u) / n of the cumulative weight: each particle covers a range of draws, so the search
    is arithmetic on its own row."""
    cum = running_sum(particles, keys, ident, weight, "_cum", bucket)
    total = particles.groupBy(*keys).agg(F.sum(weight).alias("_t"), F.count("*").alias("_n"))
    cum = cum.join(total, keys)
    high, low = F.col("_cum") / F.col("_t"), (F.col("_cum") - F.col(weight)) / F.col("_t")
    # cum_prev < (i + u) / n <= cum
    first = F.greatest(F.floor(low * F.col("_n") - u) + 1, F.lit(0))
    last = F.least(F.floor(high * F.col("_n") - u), F.col("_n") - 1)
    return _slots(cum, keys, ident, first, last)


def resample_at(particles: DataFrame, draws: DataFrame, keys: list[str], ident: str, weight: str) -> DataFrame:
    """Draws with given positions (keys, draw, position in 0 .. 1): the first particle whose cumulative share reaches it.

    Particles and draws are put in one order, and a draw takes the next particle.  Stratified draws have position
    (i + u_i) / n, multinomial ones any.
    """
    w = Window.partitionBy(*keys)
    share = F.sum(weight).over(w.orderBy(ident).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(w)
    ends = particles.select(*keys, share.alias("_p"), F.lit(1).alias("_side"), F.col(ident).alias("_id"), F.lit(None).cast("long").alias("draw"))
    asks = draws.select(*keys, F.col("position").alias("_p"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_id"), F.col("draw").cast("long").alias("draw"))
    order = w.orderBy(F.desc("_p"), F.desc("_side"), F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    return ends.unionByName(asks).withColumn(ident, F.last("_id", True).over(order)).where("_side = 0").select(*keys, "draw", ident)


def resample_residual(particles: DataFrame, keys: list[str], ident: str, weight: str) -> DataFrame:
    """Particles with whole ``copies`` floor(n w) and, as their weight, what is left of n w.

    Both come from one sum, added up in order, so that they agree whichever way the rows came."""
    w = Window.partitionBy(*keys).orderBy(ident, weight).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    expected = F.col(weight) * F.count("*").over(w) / F.sum(weight).over(w)
    rows = particles.withColumn("_e", expected).withColumn("copies", F.floor("_e").cast("int"))
    return rows.withColumn(weight, F.col("_e") - F.col("copies")).drop("_e")
