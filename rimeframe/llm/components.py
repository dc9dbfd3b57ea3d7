"""Connected components of an edge table, by alternating large-star and small-star steps.

Links stay in tables: every step is two aggregations and joins, staged in the shared folder; the driver sees one number
a step; steps end when all edges are stars, of which no step would change one.  No step gathers a node's neighbours in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store


def _stars(edges: DataFrame) -> bool:
    """Whether each node either has one edge, to a root, or is a root, which has none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x")).select("x.*")
    each = ends.groupBy("node").agg(F.sum("up").alias("edges"), F.min("up").alias("root"))
    return not each.agg(F.max(F.expr("edges > 1 OR edges = 1 AND root = 0")).alias("other")).first()["other"]


def components(store: Store, edges: DataFrame, name: str = "cc") -> DataFrame:
    """``node, root`` for each node of ``edges`` (u, v longs) that is not itself a root; root is its component's least node.

    A staged table named ``name`` and a number; the caller drops it with its store.
    """
    now = store.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    step = 0
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = store.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{name}l{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        new = store.keep(small.distinct(), f"{name}{step + 1}")
        store.drop(f"{name}l{step}", f"{name}{step}")
        step, now = step + 1, new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
