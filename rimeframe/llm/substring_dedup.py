"""Substring dedup over words by difference-cover anchors.

A word is removed if a window of 50 consecutive words that covers it also starts in a document with a smaller doc_id.

Anchors are windows of 20 words that begin, in their document, at a place whose remainder modulo 31 lies in a perfect
difference cover of 6 residues.  For any two places there is a shift below 31 that brings both onto the cover, so two equal
windows of 50 words always share an anchor at the same offset (30 + 20 = 50).  Anchor hashes are counted; those of a single
document are dropped.  Around each shared anchor the 50-word windows that hold it are the only candidates; the match is
extended by hashing them whole (128 bits), and each hash's smallest doc_id decides.  Counting and deciding are
aggregations, so a passage that a third of all documents share is combined before it is shuffled.  Texts are dealt by doc_id
once, into a bucketed table; anchors and windows come to them there, and no text is shuffled again.  Whole copies are found
first by the hash of their words: all but the smallest doc_id lose every word and need no windows.

Edge cases: null and empty texts have no words; texts under 50 words lose nothing; rows repeated with one doc_id don't
remove each other's words, since neither doc_id is smaller, and different texts with one doc_id are judged each; rows without a doc_id are not compared and lose nothing; other
columns are ignored; an empty table gives no rows.  Long texts are one value of one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import slices, words_of
from ._store import Store
from ._windows import covered, distinct_pairs, runs, window_hashes

WINDOW = 50
#: A perfect difference set modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Texts are dealt into buckets of about so many bytes of the files, at most Spark's bound on their number.
BUCKET_BYTES, MAX_BUCKETS = 64 << 20, 100_000


def cover_mask(period: int = PERIOD, cover: tuple[int, ...] = COVER) -> np.ndarray:
    if len({(a - b) % period for a in cover for b in cover}) != period:
        raise ValueError("not a difference cover")
    out = np.zeros(period, bool)
    out[list(cover)] = True
    return out


class Run:
    """The words of a slice's documents, one behind the other."""

    def __init__(self, part: pa.RecordBatch):
        import xxhash

        self.words = [words_of(t) for t in part.column("text").to_pylist()]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        n = int(self.ends[-1])
        self.values = np.fromiter((xxhash.xxh64_intdigest(x) for w in self.words for x in w), np.uint64, n)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.within = np.arange(n) - self.starts[self.row]
        self.left = self.ends[self.row] - np.arange(n)  # words from here to the document's end

    def windows(self, length: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places of whole windows, and the hashes of all."""
        hashes = window_hashes(self.values, length, which)
        return np.flatnonzero(self.left[: len(hashes)] >= length), hashes

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors and their hashes."""
        at, hashes = self.windows(WINDOW - PERIOD + 1)
        at = at[cover_mask()[self.within[at] % PERIOD]]
        return at, hashes[at]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _profile(batches):
    for part in slices(batches):
        run = Run(part)
        at, hashes = run.anchors()
        row = run.row[at]
        one = distinct_pairs(row, hashes)
        ends = np.searchsorted(row[one], np.arange(len(run.words) + 1))
        yield _batch(
            doc_id=part.column("doc_id").cast(pa.int64()),
            n_words=pa.array([len(w) for w in run.words], pa.int64()),
            whole=pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in run.words], pa.string()),
            anchors=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(hashes[one])),
        )


def _candidates(batches):
    """Windows of 50 words that hold a shared anchor: two hashes for each, one row for each distinct one of a document."""
    for part in slices(batches):
        run = Run(part)
        at, hashes = run.anchors()
        shared = np.zeros(len(run.values) + 1, np.int32)
        hits = part.column("anchors")
        offsets, values = hits.offsets.to_numpy(), hits.values.to_numpy(zero_copy_only=False)
        row = run.row[at]
        own = np.searchsorted(row, np.arange(len(run.words) + 1))
        for i in range(len(run.words)):
            a, b = own[i], own[i + 1]
            ok = np.isin(hashes[a:b].view(np.int64), values[offsets[i] : offsets[i + 1]])
            shared[at[a:b][ok]] = 1
        count = np.concatenate([[0], np.cumsum(shared)])
        places, first = run.windows(WINDOW)
        # a window at i holds the anchors that begin at i .. i + PERIOD - 1
        places = places[count[places + PERIOD] > count[places]]
        second = window_hashes(run.values, WINDOW, 1)
        doc = part.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
        row, first, second = run.row[places], first[places], second[places]
        one = distinct_pairs(row, first, second)
        yield _batch(doc_id=pa.array(doc[row[one]]), k1=_signed(first[one]), k2=_signed(second[one]))


def _removals(batches):
    """The words left of documents with removed windows (their first hashes in ``windows``)."""
    for part in slices(batches):
        run = Run(part)
        places, first = run.windows(WINDOW)
        first = first[places].view(np.int64) if len(places) else np.empty(0, np.int64)
        own = np.searchsorted(run.row[places], np.arange(len(run.words) + 1))
        hits = part.column("windows").to_pylist()
        out = []
        for i, words in enumerate(run.words):
            a, b = own[i], own[i + 1]
            starts = places[a:b][np.isin(first[a:b], np.array(hits[i], np.int64))] - run.starts[i]
            gone = covered(starts, WINDOW, len(words))
            begin, end = runs(gone)
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            out.append((hashlib.sha256(b" ".join(words)).hexdigest(), int(gone.sum()), kept.decode(), list(zip(begin.tolist(), end.tolist()))))
        whole, removed, kept, spans = zip(*out)
        yield _batch(
            doc_id=part.column("doc_id").cast(pa.int64()), whole=pa.array(whole, pa.string()), n_removed=pa.array(removed, pa.int64()), kept=pa.array(kept, pa.string()),
            spans=pa.array([[{"begin": b, "end": e} for b, e in s] for s in spans], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
        )


def _buckets(docs: DataFrame) -> int:
    """So many that one holds about BUCKET_BYTES of the table's files, but no fewer than the session's partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES), MAX_BUCKETS)


def find_repeats(docs: DataFrame, store: Store) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles (``doc_id, n_words, whole``), whole copies (``doc_id, whole``) and changed documents (``doc_id, whole,
    n_removed, kept, spans``: the words left, joined by spaces, and the places removed).

    Texts are dealt by doc_id once, as a bucketed table; the joins that bring anchors and windows to them move only those.
    """
    texts = docs.select("doc_id", "text")
    read = store.keep(texts.mapInArrow(_profile, "doc_id long, n_words long, whole string, anchors array<long>"), "read")
    comparable = read.where(f"n_words >= {WINDOW} AND doc_id IS NOT NULL")
    owner = comparable.groupBy("whole").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    owner = store.keep(owner.select(F.col("whole").alias("same"), "first"), "owner")
    copies = comparable.select("doc_id", "whole").join(owner, F.col("whole") == F.col("same")).where("doc_id > first")
    # Not made distinct here: that would put an aggregation behind the exchange of a hot ``whole``, which then can't be split.
    copies = store.keep(copies.select("doc_id", "whole"), "copies").distinct()
    fresh = store.keep(comparable.join(copies, ["doc_id", "whole"], "left_anti").select("doc_id", "anchors"), "fresh")
    profile = store.keep(read.drop("anchors"), "profile")
    store.drop("read")
    anchors = fresh.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = store.keep(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "shared")
    hits = store.keep(anchors.join(shared, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors")), "hits")
    store.drop("shared", "fresh")
    # A text of WINDOW words has at least as many characters and a white space between each two.
    dealt = texts.where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * WINDOW - 1)).withColumn("doc_id", F.col("doc_id").cast("long"))
    dealt = store.keep_bucketed(dealt, "texts", "doc_id", _buckets(docs))
    windows = store.keep(dealt.join(hits, "doc_id").mapInArrow(_candidates, "doc_id long, k1 long, k2 long"), "windows")
    store.drop("hits")
    first = store.keep(windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("k1", "k2", "first"), "first")
    later = windows.join(first, ["k1", "k2"]).where("first < doc_id").groupBy("doc_id").agg(F.collect_list("k1").alias("windows"))
    later = store.keep(later, "later")
    store.drop("windows", "first")
    changed = dealt.join(later, "doc_id").mapInArrow(
        _removals, "doc_id long, whole string, n_removed long, kept string, spans array<struct<begin: long, end: long>>"
    )
    return profile, copies, changed


EMPTY = hashlib.sha256(b"").hexdigest()


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    store = Store(spark, "substring-dedup")
    profile, copies, changed = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), store)
    digest = changed.select("doc_id", "whole", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["doc_id", "whole"])
    digest = store.keep(digest, "digest")
    out = profile.join(digest, ["doc_id", "whole"], "left").join(copies.withColumn("copy", F.lit(True)), ["doc_id", "whole"], "left")
    gone = F.coalesce("copy", F.lit(False)) & (F.col("n_words") >= WINDOW)
    return store.done(
        out.select(
            "doc_id", "n_words",
            F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(gone, EMPTY).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        )
    )
