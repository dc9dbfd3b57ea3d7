"""Suffix-array dedup over bytes with a run-length index.

A byte is removed if a string of 50 bytes that covers it also starts in a document with a smaller doc_id.

A global index would need every document in one place; here the content itself says where strings meet.  The minimizer of a
50-byte window is its 24-byte string of least hash, leftmost among equals, so equal windows have equal minimizers.
Minimizers are counted, those of one document are dropped.  Neighbouring windows with one minimizer form a segment of at
most 76 bytes, and segments are dealt by minimizer: all occurrences of a window meet in one shard.  Equal segments are
combined before the shuffle (least and greatest doc_id).  A task takes its shards one after the other.  Segments that share
the bytes on neither side of the minimizer with another one hold no window of another one and are left out.  Those that
another one's documents could lose bytes to are the reference texts: a run-length index (``run_length_index.py``) is built
over them.  Every segment that could lose something is streamed through it, whether it is a reference itself or not; its
matching statistics tell for each place with a match of 50 bytes the least doc_id that has it.  Marks of neighbouring windows
make up the removed runs.  The way back to the documents is a join on the segment.

A shard of over HOT segments, such as the ends of a passage that a third of all documents share, is split by more of what
its windows hold: by the bytes around the minimizer, as many as the window has on each side in whole eights, then, where
that leaves over HOT again, by the whole window.  Equal windows still meet, a segment becomes at most 10, then 35 pieces,
and no shard is left that more machines wouldn't shorten.  Pieces go through the same index.

Whole copies are found first by the hash of their bytes: all but the smallest doc_id lose every byte and need no index.

Edge cases: null and empty texts have no bytes; texts under 50 bytes lose nothing; rows repeated with one doc_id don't
remove each other's bytes; rows without a doc_id are not compared and lose nothing; other columns are ignored; an empty
table gives no rows.  Texts may hold any character, NUL included, and any length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import slices
from ._store import Store
from .run_length_index import RunLengthIndex, words_at

WINDOW, GRAM = 50, 24
#: Reference texts of one index, and texts of one pass over windows.
INDEX_BYTES, SLICE = 1 << 19, 1 << 17
#: Of the bytes a window has beside its minimizer, at least so many stand on one side.
SIDE = (WINDOW - GRAM) // 2
#: Shards are split by what stands around the minimizer's first bytes.
ANCHOR = 16
#: Shards of more segments, which fill half an index, are split, by so many bytes at a time around the minimizer.
HOT, QUANTA = INDEX_BYTES // (2 * (2 * WINDOW - GRAM)), (8, 1)


def grams(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM (24) bytes from each place, of an array of bytes: three words of eight, mixed."""
    n = len(text)
    if n < GRAM:
        return np.empty(0, np.uint64)
    word = words_at(text)
    out = word[: n - 23] * np.uint64(0x9E3779B97F4A7C15)
    out += word[8 : n - 15] * np.uint64(0xC2B2AE3D27D4EB4F)
    out += word[16 : n - 7] * np.uint64(0x165667B19E3779F9)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x7FB5D329728EA185)
    out ^= out >> np.uint64(29)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span < width:
        by = min(span, width - span)
        values, span = np.minimum(values[by:], values[:-by]), span + by
    return values


def leftmost_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` hashes in sequence, the leftmost among equals."""
    bits = np.uint64(len(hashes).bit_length())
    low = np.uint64((1 << int(bits)) - 1)
    at = (_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), width) & low).astype(np.int64)
    for i in np.flatnonzero(hashes[at] != _least(hashes, width)).tolist():  # two agreed in all but the low bits
        at[i] = i + np.argmin(hashes[i : i + width])
    return at


def _bytes(part: pa.RecordBatch) -> list[bytes]:
    return [b or b"" for b in part.column("text").cast(pa.binary()).to_pylist()]


class Run:
    """The bytes of a slice's documents, one behind the other, cut into segments of one minimizer."""

    def __init__(self, part: pa.RecordBatch):
        self.texts = _bytes(part)
        counts = np.array([len(t) for t in self.texts], np.int64)
        self.joined = b"".join(self.texts)
        ends = np.cumsum(counts)
        self.doc_start = ends - counts
        n = len(self.joined)
        hashes = grams(np.frombuffer(self.joined, np.uint8))
        width = WINDOW - GRAM + 1
        if len(hashes) < width:
            self.row = self.first = self.last = self.gram = np.empty(0, np.int64)
            self.minimizer = np.empty(0, np.uint64)
            return
        at = leftmost_least(hashes, width)  # the minimizer's place, by the window's
        row = np.repeat(np.arange(len(counts)), counts)
        valid = np.flatnonzero(ends[row[: len(at)]] - np.arange(len(at)) >= WINDOW)
        at, row = at[valid], row[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        self.first = valid[new]
        self.last = valid[np.append(np.flatnonzero(new)[1:] - 1, len(valid) - 1)] if len(valid) else valid
        self.row = row[new]
        self.minimizer = hashes[at[new]]
        self.gram = at[new] - self.first


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)


def _profile(batches):
    for part in slices(batches):
        texts = _bytes(part)
        yield _batch(
            doc_id=part.column("doc_id").cast(pa.int64()), n_bytes=pa.array([len(t) for t in texts], pa.int64()), whole=pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
        )


def _distinct_minimizers(batches):
    """The documents of each slice, and rows and values of their distinct minimizers."""
    for part in slices(batches, limit=SLICE):
        run = Run(part)
        order = np.lexsort((run.minimizer, run.row))
        row, value = run.row[order], run.minimizer[order]
        new = np.ones(len(order), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        yield part, row[new], value[new].view(np.int64)


def _minimizers(batches):
    for part, row, value in _distinct_minimizers(batches):
        yield _batch(doc_id=pa.array(_ids(part)[row]), minimizer=pa.array(value))


def _minimizer_values(batches):
    for _, _, value in _distinct_minimizers(batches):
        yield _batch(minimizer=pa.array(value))


def _pieces(joined: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary array of the pieces of a byte array that begin at ``first``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(joined[at])])


def _segments(batches):
    """Segments with a shared minimizer, its place in each, and the byte where each starts."""
    for part in slices(batches, limit=SLICE):
        run = Run(part)
        hits = part.column("minimizers")
        offsets, values = hits.offsets.to_numpy(), hits.values.to_numpy(zero_copy_only=False)
        own = np.searchsorted(run.row, np.arange(len(run.texts) + 1))
        minimizer = run.minimizer.view(np.int64)
        shared = np.zeros(len(minimizer), bool)
        for i in range(len(run.texts)):
            a, b = int(own[i]), int(own[i + 1])
            shared[a:b] = np.isin(minimizer[a:b], values[offsets[i] : offsets[i + 1]])
        first, row = run.first[shared], run.row[shared]
        yield _batch(
            shard=pa.array(minimizer[shared]), doc_id=pa.array(_ids(part)[row]), segment=_pieces(np.frombuffer(run.joined, np.uint8), first, run.last[shared] - first + WINDOW),
            gram=pa.array(run.gram[shared].astype(np.int32)), start=pa.array((first - run.doc_start[row]).astype(np.int32)),
        )


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def roles(shard: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows, in order of (shard, first), are references, and which are streamed: a reference's least document is smaller
    than some document of another row of the shard; a streamed row has a document that isn't the shard's least."""
    new = np.concatenate([[True], shard[1:] != shard[:-1]])
    begin = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    order = np.lexsort((last, of))
    end = np.append(begin[1:], len(shard)) - 1
    top = order[end]
    other = last[top][of]
    second = last[order[np.maximum(end - 1, 0)]]
    other[top] = np.where(end > begin, second, np.iinfo(np.int64).min)
    return first < other, last > first[begin][of]


def _indexed(part: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of whole shards, through one index: the least owner of each window, where some is below ``last``."""
    segments = part.column("segment").to_pylist()
    first, last = part.column("first").to_numpy(), part.column("last").to_numpy()
    reference, streamed = (np.flatnonzero(x) for x in roles(part.column("shard").to_numpy(), first, last))
    windows = np.array([len(segments[i]) for i in streamed], np.int64) - WINDOW + 1
    wide = int(windows.max(initial=0))
    owner = np.repeat(first[streamed][:, None], wide, axis=1)
    if len(reference) and len(streamed):
        index = RunLengthIndex([segments[i] for i in reference], first[reference], WINDOW)
        found = index.stream([segments[i] for i in streamed], every=False)[1][:, :wide]
        owner = np.where((found >= 0) & (found < owner), found, owner)
    inside = np.arange(wide)[None, :] < windows[:, None]
    useful = (inside & (owner < last[streamed][:, None])).any(axis=1)
    rows = pa.array(streamed[useful])
    return _batch(shard=part.column("shard").take(rows), segment=part.column("segment").take(rows), owners=_lists(owner[inside & useful[:, None]], windows[useful]))


def partnered(rows: pa.RecordBatch, shard: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which rows may share a window with another one of their shard: those whose SIDE bytes before or behind the minimizer
    another one has, too, since a shared window reaches that far on one side.  Rows without ``gram``: all of shards of several."""

    def repeated(at: np.ndarray, key: np.ndarray) -> np.ndarray:
        order = at[np.lexsort((key[at], shard[at]))]
        same = (shard[order[1:]] == shard[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
        return order[(np.append(False, same) | np.append(same, False))[: len(order)]]

    out = np.zeros(len(shard), bool)
    if "gram" not in rows.schema.names:
        out[repeated(np.arange(len(shard)), np.zeros(len(shard)))] = True
        return out
    begin = np.cumsum(sizes) - sizes
    gram = rows.column("gram").to_numpy()
    word = words_at(np.frombuffer(b"".join(rows.column("segment").to_pylist()), np.uint8))
    for at, place in ((np.flatnonzero(gram >= SIDE), gram - SIDE), (np.flatnonzero(gram + GRAM + SIDE <= sizes), gram + GRAM)):
        key = np.zeros(len(shard), np.uint64)
        start = (begin + place)[at]
        key[at] = word[start] * np.uint64(0x9E3779B97F4A7C15) + word[start + SIDE - 8] * np.uint64(0xC2B2AE3D27D4EB4F)
        out[repeated(at, key)] = True
    return out


def _owners(batches):
    """Rows (shard, segment, gram, first, last) in order of shard, as (shard, segment, owners)."""

    def done(rows: pa.RecordBatch):
        shard = rows.column("shard").to_numpy()
        sizes = pc.binary_length(rows.column("segment")).to_numpy().astype(np.int64)
        many = partnered(rows, shard, sizes)
        # A segment that shares no window with another one needs no index.
        first, last = rows.column("first").to_numpy(), rows.column("last").to_numpy()
        alone = np.flatnonzero(~many & (first < last))
        windows = sizes[alone] - WINDOW + 1
        at = pa.array(alone)
        yield _batch(shard=rows.column("shard").take(at), segment=rows.column("segment").take(at), owners=_lists(np.repeat(first[alone], windows), windows))
        rows, sizes, shard = rows.filter(pa.array(many)), sizes[many], shard[many]
        if not len(shard):
            return
        # Whole shards together, to about INDEX_BYTES for each index.
        ends = np.append(np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard))
        total = np.cumsum(sizes)[ends - 1]
        start = 0
        while start < len(shard):
            before = int(total[np.searchsorted(ends, start, "right") - 1]) if start else 0
            k = max(np.searchsorted(total, before + INDEX_BYTES, "right") - 1, np.searchsorted(ends, start, "right"))
            yield _indexed(rows.slice(start, int(ends[k]) - start))
            start = int(ends[k])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("segment"))).as_py()
        if size < INDEX_BYTES:
            continue
        whole = pa.concat_batches(held)
        shard = whole.column("shard").to_numpy()
        border = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on in the next batch
        if border:
            yield from done(whole.slice(0, border))
        held = [whole.slice(border)]
        size = pc.sum(pc.binary_length(held[0].column("segment"))).as_py()
    if held:
        yield from done(pa.concat_batches(held))


def _split(quantum: int):
    """Segments cut where the bytes around the minimizer, ``quantum`` at a time as far as a window has them, change."""

    def run(batches):
        import xxhash

        for batch in batches:
            out = []
            for number, segment, gram, first, last in zip(*(batch.column(c).to_pylist() for c in ("number", "segment", "gram", "first", "last"))):
                windows, begin = len(segment) - WINDOW + 1, 0
                while begin < windows:
                    before = gram - begin
                    after = WINDOW - ANCHOR - before
                    left, right = before // quantum * quantum, after // quantum * quantum
                    end = min(windows, begin + min(before - left, quantum - 1 - (after - right)) + 1)
                    key = xxhash.xxh64_intdigest(segment[gram - left : gram + ANCHOR + right] + bytes([left, right])) - (1 << 63)
                    out.append((number, begin, key, segment[begin : end - 1 + WINDOW], before, first, last))
                    begin = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PIECE)], names=["number", "at", "shard", "segment", "gram", "first", "last"])

    return run


_PIECE = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64())


def least_owners(store: Store, distinct: DataFrame, quanta: tuple[int, ...] = QUANTA) -> DataFrame:
    """``shard, segment, at, owners`` of ``distinct`` (shard, segment, gram, first, last): the least owner of each window from
    the segment's byte ``at`` on.  Rows whose windows are all their own are left out."""
    level = len(QUANTA) - len(quanta)

    def indexed(rows: DataFrame) -> DataFrame:
        dealt = rows.select("shard", "segment", "gram", "first", "last").repartition("shard").sortWithinPartitions("shard", "first")
        return dealt.mapInArrow(_owners, "shard long, segment binary, owners array<long>").select("shard", "segment", F.lit(0).alias("at"), "owners")

    if not quanta:
        return indexed(distinct)
    hot = store.keep(distinct.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("shard"), f"hot{level}")
    if hot.isEmpty():
        return indexed(distinct)
    numbered = store.keep(distinct.join(hot, "shard", "left_semi").withColumn("number", F.monotonically_increasing_id()), f"numbered{level}")
    pieces = numbered.select("number", "segment", "gram", "first", "last").mapInArrow(_split(quanta[0]), "number long, at int, shard long, segment binary, gram int, first long, last long")
    pieces = store.keep(pieces, f"pieces{level}")
    finer = store.keep(pieces.groupBy("shard", "segment").agg(F.min("gram").alias("gram"), F.min("first").alias("first"), F.max("last").alias("last")), f"finer{level}")
    inner = least_owners(store, finer, quanta[1:]).withColumnRenamed("at", "inner")
    back = pieces.select("number", "at", "shard", "segment").join(inner, ["shard", "segment"]).select("number", (F.col("at") + F.col("inner")).alias("at"), "owners")
    back = store.keep(numbered.select("number", "shard", "segment").join(back, "number").select("shard", "segment", "at", "owners"), f"back{level}")
    store.drop(f"numbered{level}", f"pieces{level}", f"finer{level}")
    return indexed(distinct.join(hot, "shard", "left_anti")).unionByName(back)


def _marks(batches):
    """Rows (doc_id, start, owners): the byte ranges covered by windows that a smaller doc_id has."""
    for batch in batches:
        owners = batch.column("owners")
        doc, start = _ids(batch), batch.column("start").to_numpy()
        counts = np.diff(owners.offsets.to_numpy())
        values = owners.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(doc)), counts)
        bad = values < doc[row]
        border = np.zeros(len(values) + 1, bool)
        border[np.cumsum(counts)] = border[0] = True
        opens = np.flatnonzero(bad & (border[:-1] | ~np.append(False, bad[:-1])))
        closes = np.flatnonzero(bad & (border[1:] | ~np.append(bad[1:], False))) + 1
        which, first = row[opens], np.cumsum(counts) - counts
        yield _batch(
            doc_id=pa.array(doc[which]), begin=pa.array((start[which] + opens - first[which]).astype(np.int32)), end=pa.array((start[which] + closes - first[which] - 1 + WINDOW).astype(np.int32))
        )


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that byte ranges, in any order, cover."""
    order = np.argsort(begin)
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))[: len(begin)]
    return begin[new], end[np.append(new[1:], len(end)) - 1] if len(new) else end


def _removals(batches):
    for part in slices(batches):
        texts, marks = _bytes(part), part.column("marks")
        offsets = marks.offsets.to_numpy()
        begin, end = (marks.values.field(c).to_numpy() for c in ("begin", "end"))
        removed, kept, begins, ends = [], [], [], []
        for text, i, j in zip(texts, offsets[:-1], offsets[1:]):
            ok = end[i:j] <= len(text)
            a, b = _merged(begin[i:j][ok], end[i:j][ok])
            removed.append(int((b - a).sum()))
            kept.append(b"".join([text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)])]))
            begins.append(a)
            ends.append(b)
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (begins, ends)], names=["begin", "end"])
        bounds = np.concatenate([[0], np.cumsum([len(a) for a in begins])]).astype(np.int32)
        yield _batch(
            doc_id=part.column("doc_id").cast(pa.int64()), whole=pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), n_removed=pa.array(removed, pa.int64()),
            kept=pa.array(kept, pa.binary()), spans=pa.ListArray.from_arrays(pa.array(bounds), spans),
        )


def find_repeats(docs: DataFrame, store: Store) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles (``doc_id, n_bytes, whole``), whole copies (``doc_id``) and changed documents (``doc_id, whole, n_removed,
    kept, spans``: the bytes left and the byte ranges removed)."""
    texts = docs.select("doc_id", "text")
    profile = store.keep(texts.mapInArrow(_profile, "doc_id long, n_bytes long, whole string"), "profile")
    owner = profile.where(f"n_bytes >= {WINDOW} AND doc_id IS NOT NULL").groupBy("whole").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    owner = store.keep(owner.select(F.col("whole").alias("same"), "first"), "owner")
    copies = store.keep(profile.join(owner, F.col("whole") == F.col("same")).where("doc_id > first").select("doc_id").distinct(), "copies")
    fresh = texts.where("doc_id IS NOT NULL").join(copies, "doc_id", "left_anti")
    minimizers = fresh.mapInArrow(_minimizers, "doc_id long, minimizer long")
    values = fresh.select("text").mapInArrow(_minimizer_values, "minimizer long")
    shared = store.keep(values.groupBy("minimizer").agg(F.count("*").alias("n")).where("n > 1").select("minimizer"), "shared")
    hits = store.keep(minimizers.join(shared.hint("shuffle_hash"), "minimizer", "left_semi").groupBy("doc_id").agg(F.collect_list("minimizer").alias("minimizers")), "hits")
    store.drop("shared")
    segments = store.keep(texts.join(hits, "doc_id").mapInArrow(_segments, "shard long, doc_id long, segment binary, gram int, start int"), "segments")
    store.drop("hits")
    distinct = store.keep(segments.groupBy("shard", "segment").agg(F.min("gram").alias("gram"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "distinct")
    owners = store.keep(least_owners(store, distinct), "owners")
    store.drop("distinct")
    joined = segments.select("shard", "segment", "doc_id", "start").join(owners.hint("shuffle_hash"), ["shard", "segment"])
    marks = joined.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "owners").mapInArrow(_marks, "doc_id long, begin int, end int")
    marks = store.keep(marks.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("marks")), "marks")
    store.drop("segments", "owners")
    changed = texts.join(marks, "doc_id").mapInArrow(_removals, "doc_id long, whole string, n_removed long, kept binary, spans array<struct<begin: long, end: long>>")
    return profile, copies, changed


EMPTY = hashlib.sha256(b"").hexdigest()


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    store = Store(spark, "suffix-dedup")
    profile, copies, changed = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), store)
    digest = changed.select("doc_id", "whole", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["doc_id", "whole"])
    digest = store.keep(digest, "digest")
    out = profile.join(digest, ["doc_id", "whole"], "left").join(copies.withColumn("copy", F.lit(True)), "doc_id", "left")
    gone = F.coalesce("copy", F.lit(False)) & (F.col("n_bytes") >= WINDOW)
    return store.done(
        out.select(
            "doc_id", "n_bytes",
            F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(gone, EMPTY).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        )
    )
