"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the expected number of copies of each of its documents: a whole part that every
document gets, and a fractional part shared by all.  Pivotal rounding settles the fractions: two parties meet, and
probability mass moves at random from one to the other until one of them is integral; the other goes on with the rest.
Mass is counted in words, so the words of those that met stay the same while every expectation stays what it was.

A source's documents are split into groups of about FAN.  In a group the largest open document meets the pool of all
smaller ones, again and again, which leaves the fraction of the smallest document.  The pool is one party of a pair: its
documents share one fraction, and mass that it gains or loses changes that fraction for all of them, just as a branch of a
reduction tree stands for what is below it.  A step keeps the mean of both parties, so by induction each document keeps its
expectation.  It isn't the law of documents drawn in pairs: where a pool becomes integral its documents go together, which
can only be the smallest of a group.  In exchange the miss of a group is a part of its smallest document; documents drawn in
pairs by size leave any of them open, which on sources of 50 documents missed targets by up to 29 % against 0.5 %.
These residuals meet in pairs, group
by group, in a reduction tree, until each source has one, which a last draw settles.  Draws come from a hash of the seed and
the document, so reruns agree.

Edge cases: a null text has size 0; a source without words has target 0 and its documents are taken 0 times; documents without words get the whole part only; null is
a source of its own, last in order; rows repeated with one doc_id are documents of their own for the rounding; a null
doc_id is allowed; other columns are ignored; an empty table gives no rows.  Any number of sources is allowed: their table is
numbered, capped and reshared by aggregations, of which the driver sees two sums a round.
"""

from __future__ import annotations

import math
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Store

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
FAN = 2000
SEED = 7
#: Up to so many sources their table is broadcast.
BROADCAST_SOURCES = 50_000


def numbered(store: Store, sources: DataFrame) -> DataFrame:
    """``sources`` (distinct ``source``) with ``id``: its place by code point, null last, from 0."""
    order = F.asc_nulls_last("source")
    ranged = sources.repartitionByRange(order).sortWithinPartitions(order)
    ranged = store.keep(ranged.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "ranged")
    parts = ranged.groupBy("part").agg(F.min("place").alias("low"), F.count("*").alias("n"))  # a row for each partition
    start = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", (start - F.col("low")).alias("shift"))
    return ranged.join(F.broadcast(starts), "part").select((F.col("place") + F.col("shift")).alias("id"), *sources.columns)


def plan(store: Store, sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``id, name, source_size, target, whole, part`` of ``sources`` (distinct ``source``, ``source_size``): words wanted are
    shares of all words by weight, at most ``most`` times the source, the excess reshared; whole and part are the target
    over the size.

    A source is capped where its share by the level (words left over weights left) is above.  Capping raises the level, so
    rounds go on until nothing changes; sums and comparisons are exact.
    """
    exact = lambda c: c.cast("decimal(38,0)")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("id") % len(weights) + 1).cast("int"))
    rows = store.keep(numbered(store, sources).withColumns({"w": exact(weight), "s": exact(F.col("source_size"))}), "plan")

    def above(rest: int, left: int) -> Column:
        return F.lit(Decimal(rest)) * F.col("w") > F.lit(Decimal(most * left)) * F.col("s") if left else F.lit(True)

    total, left = (int(x or 0) for x in rows.agg(F.sum("s"), F.sum("w")).first())
    rest = total
    while left:
        capped = above(rest, left)
        taken, open_ = (int(x or 0) for x in rows.agg(F.sum(F.when(capped, F.col("s"))), F.sum(F.when(~capped, F.col("w")))).first())
        if (total - most * taken, open_) == (rest, left):
            break
        rest, left = total - most * taken, open_
    capped, share, size = above(rest, left), F.lit(Decimal(rest)) * F.col("w"), F.lit(Decimal(left or 1)) * F.col("s")
    over = F.when(F.col("s") > 0, share % F.when(F.col("s") > 0, size))
    words = F.col("s") > 0
    return rows.select(
        "id", F.col("source").alias("name"), "source_size",
        F.when(capped, most * F.col("s").cast("double")).otherwise(share.cast("double") / float(left or 1)).alias("target"),
        F.when(~words, 0).when(capped, most).otherwise(((share - over) / F.when(words, size)).cast("int")).alias("whole"),
        F.when(~words | capped, 0.0).otherwise(over.cast("double") / F.when(words, size).cast("double")).alias("part"),
    )


def settle_pool(keys: list[str], sizes: list[int], fraction: float, seed: int) -> list[float]:
    """Documents in order of falling size that share one fraction; each meets the pool of those behind it.

    The two possible moves of words between document and pool are each the largest in its direction, and are drawn so that
    the fractions keep their mean.  One of both is integral afterwards; if it is the pool, the document keeps what is left.
    """
    import xxhash

    out, pool, p = [], float(sum(sizes)), fraction
    for i, (key, size) in enumerate(zip(keys[:-1], sizes)):
        pool -= size
        up, down = min((1.0 - p) * size, p * pool), min(p * size, (1.0 - p) * pool)
        draw = xxhash.xxh64_intdigest(key, seed) / 2.0**64
        moved = up if draw * (up + down) < down else -down
        own, rest = p + moved / size, p - moved / pool
        own, rest = (0.0 if x < 1e-9 else 1.0 if x > 1.0 - 1e-9 else x for x in (own, rest))
        out.append(own)
        if rest in (0.0, 1.0):
            return [*out, *[rest] * (len(keys) - i - 1)]
        p = rest
    return [*out, p]


def settle(rows: list[tuple], seed: int) -> list[float]:
    """Sequential pivotal rounding of rows (key, size, probability) in their order; all but one become 0 or 1.

    Mass is counted in words.  Moving m words from one document to the other keeps their expected words as they were;
    the two possible moves, each the largest in its direction, are drawn so that both probabilities keep their mean.
    """
    import xxhash

    out = [p for _, _, p in rows]
    held = -1
    for i in range(len(rows)):
        if not 0.0 < out[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b, size_a, size_b = out[held], out[i], rows[held][1], rows[i][1]
        up = min((1.0 - a) * size_a, b * size_b)  # from i to the held one
        down = min(a * size_a, (1.0 - b) * size_b)
        draw = xxhash.xxh64_intdigest(f"{rows[held][0]}|{rows[i][0]}", seed) / 2.0**64
        moved = up if draw * (up + down) < down else -down
        for k, p in ((held, a + moved / size_a), (i, b - moved / size_b)):
            out[k] = 0.0 if p < 1e-9 else 1.0 if p > 1.0 - 1e-9 else p
        held = next((k for k in (held, i) if 0.0 < out[k] < 1.0), -1)
    return out


_KIND = "doc_id long, size long, id long, chunk long, p double"


def _level(rows: DataFrame, keys: list[str], seed: int, pool: bool = False) -> DataFrame:
    """Every group of ``keys`` settled; at most one row of a group keeps a fraction."""

    def run(table: pa.Table) -> pa.Table:
        doc, size, p = (table.column(c).to_pylist() for c in ("doc_id", "size", "p"))
        order = sorted(range(len(doc)), key=lambda i: (-size[i], doc[i] is None, doc[i] or 0))
        names, sizes = [f"{doc[i]}:{k}" for k, i in enumerate(order)], [size[i] for i in order]
        new = settle_pool(names, sizes, p[0], seed) if pool else settle(list(zip(names, sizes, [p[i] for i in order])), seed)
        back = [0.0] * len(doc)
        for i, q in zip(order, new):
            back[i] = q
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(back, pa.float64()))

    return rows.groupBy(*keys).applyInArrow(run, _KIND)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` for every row of ``docs`` (doc_id, text, source)."""
    store = Store(docs.sparkSession, "mixing")
    sized = store.keep(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size")), "sized")
    sources = store.keep(plan(store, sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "sources")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    rows = sized.join(sources, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "size", "id", F.col("part").alias("p"))
    whole = rows.where("size = 0 OR p = 0").select("doc_id", "size", "id", F.lit(0).cast("long").alias("chunk"), F.lit(0.0).alias("p"))
    rows = rows.where("size > 0 AND p > 0")
    counts = rows.groupBy("id").agg(F.ceil(F.count("*") / FAN).alias("chunks"))
    counts = store.keep(counts, "counts")
    widest = counts.agg(F.max("chunks")).first()[0] or 1
    grouped = rows.join(counts, "id").select("doc_id", "size", "id", F.pmod(F.xxhash64("doc_id", "size"), F.col("chunks")).alias("chunk"), "p")
    now, settled, level = store.keep(_level(grouped, ["id", "chunk"], seed, pool=True), "level0"), [whole], 0
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    while True:
        settled.append(now.where(~open_))
        rest = now.where(open_)
        level += 1
        if widest > 1:
            widest = math.ceil(widest / FAN)
            rest = rest.withColumn("chunk", F.floor(F.col("chunk") / FAN))
            now = store.keep(_level(rest, ["id", "chunk"], seed + level), f"level{level}")
        else:
            now = store.keep(_level(rest, ["id"], seed + level), f"level{level}")
            break
    draw = F.xxhash64("doc_id", "size", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    last = draw < F.col("p")
    settled.append(now.withColumn("p", F.when(open_, last.cast("double")).otherwise(F.col("p"))))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return store.done(
        out.join(sources, "id").select("doc_id", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))
    )


def repeat_by_mix(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as many times as the mix takes it (none, one or more); the columns as they were."""
    taken = mix(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    taken = taken.select(F.col("doc_id").alias("mixed_doc"), F.sequence(F.lit(1), "copies").alias("mixed_times")).hint("merge")
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(taken["mixed_doc"])).select(*[docs[c] for c in docs.columns], F.explode(taken["mixed_times"]).alias("mixed_time"))
    return joined.select(*joined.columns[:-1]) if "mixed_time" not in docs.columns else joined.drop(joined["mixed_time"])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
