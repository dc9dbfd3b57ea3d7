"""Sharding by histogram sort (DataFrame functions only).

Documents are ordered by (hash of the text, hash of the doc_id).  Splitters between shards are found by counting: each
round sums the exact bytes of the rows below every probe, over all partitions, and places finer probes only inside the
key ranges that still hold a splitter, until the range is within tolerance.  Then one exchange deals the rows.  A round
sends at most ``shards * 2**BITS`` sums to the driver, whatever the input.

The law is ``bytes``: each shard gets nearly the same number of bytes.  Equal texts have equal keys and stay together
unless their group exceeds ``GROUP_SHARE`` of a shard; larger groups are split by the hash of the doc_id, so a text that
makes up a third of the table is spread over a third of the shards.

Edge cases: a null text has no bytes and counts ``OVERHEAD``; rows repeated with one doc_id cannot be told apart and may
not be split; an empty table gives no rows; a null doc_id hashes like any other value.  Other columns are ignored by
``assign_shards`` and carried by ``deal``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Store

OVERHEAD = 16
BITS = 12
TOLERANCE = 0.0005
GROUP_SHARE = 0.01
ROWS_PER_TASK = 5000


def _prefix(name: str, bits: int) -> Column:
    return F.shiftright(F.col(name), 64 - bits)


def _rounds() -> list[int]:
    return [*range(BITS, 64, BITS), 64]


def splitters(keys: DataFrame, shards: int) -> tuple[list[tuple[int, int]], int]:
    """``shards - 1`` keys (h1, h2), each the first key of the next shard, and the number of rows.

    ``keys`` has h1, h2 (longs, ordered by value) and size.
    """
    head = keys.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total, rows = int(head["bytes"] or 0), int(head["rows"])
    if not rows or shards < 2:
        return [], rows
    ideal = total / shards
    goal = {k: k * ideal for k in range(1, shards)}
    found: dict[int, tuple[int, int]] = {}
    low = -(1 << 63)

    def search(part: DataFrame, column: str, wanted: dict[int, int], settle) -> dict[int, tuple[int, int, int, int]]:
        """wanted: splitter -> bytes below the part.  Gives those that fall on one key: it, bytes below, its bytes, rows."""
        close, single = max(1.0, TOLERANCE * ideal), {}
        ranges: dict[int, tuple[int | None, int]] = {k: (None, below) for k, below in wanted.items()}
        done_bits = 0
        for bits in _rounds():
            if not ranges:
                break
            rows_in = part
            if done_bits:
                rows_in = rows_in.where(_prefix(column, done_bits).isin(sorted({p for p, _ in ranges.values()})))
            sums = rows_in.groupBy(_prefix(column, bits).alias("p")).agg(
                F.sum("size").alias("b"), F.min(column).alias("least"), F.max(column).alias("most"), F.count("*").alias("n")
            )
            ordered = sorted((int(r["p"]), int(r["b"]), int(r["least"]), int(r["most"]), int(r["n"])) for r in sums.collect())
            rest = {}
            for k, (prefix, at) in ranges.items():
                mine = [x for x in ordered if not done_bits or x[0] >> (bits - done_bits) == prefix]
                for p, b, least, most, n in mine:
                    if at + b < goal[k] and p != mine[-1][0]:
                        at += b
                    elif least == most:
                        single[k] = (least, at, b, n)
                        break
                    elif b <= close:
                        settle(k, (p if goal[k] - at <= at + b - goal[k] else p + 1) << (64 - bits))
                        break
                    else:
                        rest[k] = (p, at)
                        break
            ranges, done_bits = rest, bits
        return single

    def first(k: int, value: int) -> None:
        found[k] = (value, low)

    # Where one text's group covers a goal, a small group stays whole and a large one is cut by h2.
    groups = search(keys, "h1", dict.fromkeys(goal, 0), first)
    for value, size, n in {(v, b, n) for v, _, b, n in groups.values()}:
        inside = {k: below for k, (v, below, _, _) in groups.items() if v == value}
        if n == 1 or size <= GROUP_SHARE * ideal:
            for k, below in inside.items():
                found[k] = (value if goal[k] - below <= below + size - goal[k] else value + 1, low)
            continue

        def second(k: int, v2: int, v1: int = value) -> None:
            found[k] = (v1, v2)

        for k, (v2, below, b, _) in search(keys.where(F.col("h1") == value), "h2", inside, second).items():
            found[k] = (value, v2 if goal[k] - below <= below + b - goal[k] else v2 + 1)
    out = [found[k] for k in sorted(found)]
    return sorted(out), rows


def shard_of(cuts: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below a row's key."""
    top = (1 << 63) - 1
    out = F.lit(0)
    for v1, v2 in cuts:
        if v1 > top:
            continue
        over = F.col("h1") > F.lit(v1)
        if v2 <= top:
            over = over | ((F.col("h1") == F.lit(v1)) & (F.col("h2") >= F.lit(v2)))
        out = out + over.cast("int")
    return out


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64("doc_id", F.lit("shard")).alias("h2"),
    )


def assign_shards(docs: DataFrame, shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, h1, h2, shard, slot``: the shard of every row and its place there, from 0 without gaps.

    Places follow the hash of the doc_id: rows are counted for each (shard, slice of that hash) in one aggregation, the
    counts are added up over the slices, and rows are numbered inside a slice only.  Slices hold about ``ROWS_PER_TASK``
    rows, so no task takes a whole shard.
    """
    store = Store(docs.sparkSession, "shards")
    keys = store.keep(keyed(docs), "keys")
    cuts, rows = splitters(keys, shards)
    slices = max(8, math.ceil(rows / shards / ROWS_PER_TASK))
    dealt = keys.withColumn("shard", shard_of(cuts)).withColumn("slice", F.pmod("h2", F.lit(slices)))
    counts = dealt.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = store.keep(counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    place = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("h2", "doc_id", "h1"))
    numbered = dealt.withColumn("place", place)
    return store.done(
        numbered.join(starts, ["shard", "slice"]).select(
            "doc_id", "size", "text_crc32", "h1", "h2", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot")
        )
    )


def deal(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` with a column ``shard``, moved once so that each shard is one partition of the result.

    A column of the input that is called ``shard`` is replaced.
    """
    store = Store(docs.sparkSession, "deal")
    keys = store.keep(keyed(docs), "keys")
    cuts, _ = splitters(keys, shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2 = F.xxhash64(text), F.xxhash64("doc_id", F.lit("shard"))
    over = F.lit(0)
    top = (1 << 63) - 1
    for v1, v2 in cuts:
        if v1 <= top:
            over = over + ((h1 > F.lit(v1)) | ((h1 == F.lit(v1)) & (h2 >= F.lit(min(v2, top))))).cast("int")
    store.drop("keys")
    return docs.withColumn("shard", over).repartitionByRange(shards, "shard")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    placed = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
