"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

Texts are compared after all of ``[\\x20\\x09-\\x0D]`` is deleted.  Each normalised text is cut into chunks whose ends
depend on the content: at least ``MIN_CHUNK`` characters, then up to the next punctuation mark, ``MAX_CHUNK`` at most.
A chunk's identifier is its 64-bit hash; a text's recipe is the ordered list of identifiers.  The pass that cuts the chunks
also takes a proof of each: 120 bits of its SHA-256.  All chunks are deduplicated to identifiers, by minimum and maximum of
the proofs; an identifier that stands for two contents is followed, in the recipes that hold it, by the proofs at those
places, so that equal lists mean equal texts, not merely equal hashes.  No text leaves the task that reads it: recipes,
identifiers and proofs are what is shuffled, whatever is broadcast or not.

Edge cases: a null text counts as empty; empty texts are equal to each other.  Rows repeated with one doc_id are told
apart by their texts, and each counts in ``group_size``; of such rows of one group all or none are kept.  A null doc_id never
becomes ``keep_id`` unless the whole group has none.  Other columns of the input, whatever their names, are left alone.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Store, without_ids

MIN_CHUNK, MAX_CHUNK = 256, 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def chunks(norm: Column) -> Column:
    """Content-defined pieces; joined they give ``norm`` again."""
    cut = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:[.,;:!?]|\z)|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(norm, F.lit(cut), F.lit(0))


def proof(chunk: Column) -> list[Column]:
    """120 bits of a chunk's SHA-256, as two longs."""
    digits = F.sha2(chunk, 256)
    return [F.conv(F.substring(digits, 1 + 15 * i, 15), 16, 10).cast("long").alias(f"p{i}") for i in range(2)]


def find_copies(docs: DataFrame, chunk_id: Callable[[Column], Column] = lambda chunk: F.xxhash64(chunk)) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs`` (doc_id, text).

    ``chunk_id`` maps a chunk to a long; any function gives right results, a weak one only costs more comparisons.
    """
    store = Store(docs.sparkSession, "exact-dedup")
    text = F.coalesce("text", F.lit(""))
    cut = store.keep(
        docs.select("doc_id", F.length(text).alias("points"), normalised(F.col("text")).alias("norm")).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "points", F.sha2("norm", 256).alias("text_sha256"),
            F.transform(chunks(F.col("norm")), lambda x: F.struct(chunk_id(x).alias("id"), *proof(x))).alias("chunks"),
        ),
        "cut",
    )
    recipes = cut.select("row", "doc_id", "points", "text_sha256", F.col("chunks.id").alias("recipe"))
    # Deduplicate chunks first (equal identifiers meet on the map side), then see whether one has two contents.
    ends = [f(c).alias(f"{n}_{c}") for c in ("p0", "p1") for f, n in ((F.min, "low"), (F.max, "high"))]
    contents = cut.select(F.explode("chunks").alias("c")).select("c.*").groupBy("id").agg(*ends)
    clashing = store.keep(contents.where("low_p0 < high_p0 OR low_p1 < high_p1").select("id"), "clashing")
    if clashing.isEmpty():
        verified = recipes.withColumn("variants", F.lit(None).cast("array<struct<place: int, p0: bigint, p1: bigint>>"))
    else:
        places = cut.select("row", F.posexplode("chunks").alias("place", "c")).select("row", "place", "c.*")
        # The clashing places of a text, in order: bounded by the text's own number of chunks.
        listed = places.join(clashing, "id", "left_semi").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "p0", "p1"))).alias("variants"))
        verified = store.keep(recipes.join(listed, "row", "left"), "verified")
    # Longest original first, then the smallest doc_id: a struct's order, so one partial and one final aggregation.
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "points", F.bitwise_not("doc_id").alias("other")))
    same = F.struct("recipe", "variants")
    groups = store.keep(
        verified.groupBy(same.alias("same")).agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1").select(
            "same", "group_size", F.bitwise_not("best.other").alias("keep_id")
        ),
        "groups",
    )
    verified = verified.withColumn("same", same).drop("recipe", "variants")
    out = verified.join(groups, "same", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))), F.lit(False)).alias("kept"),
        "text_sha256",
    )
    return store.done(out)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``find_copies`` does not keep; all columns as they were.  Rows without a doc_id stay.

    Nulls, empty and long texts, ties and repeated rows as in ``find_copies``; an empty table stays empty.
    """
    store = Store(docs.sparkSession, "exact-dropped")
    return without_ids(docs, store.keep(find_copies(docs).where("NOT kept").select("doc_id").distinct(), "gone"))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return find_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
