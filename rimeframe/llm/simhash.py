"""SimHash near-dedup by the generalised pigeonhole principle.

The 64 bits are split into m parts.  If two fingerprints differ in at most tau bits and the parts' thresholds add up to
tau - m + 1, then some part differs in at most its own threshold.  Correlated bits go into the same part; the number of
parts and the thresholds come from a dynamic program over estimated costs, computed from the bit counts of all
fingerprints: signatures to shuffle, and pairs that will meet by chance.  Each fingerprint is filed under its exact value
in every part and probes all values within the part's threshold; pairs that meet are verified on all 64 bits inside the
join, so only links leave it.  Equal fingerprints are one node; copies are never expanded into pairs.  Linked nodes form
components (``components.py``).

Edge cases: a null or empty text has fingerprint zero and is linked like any other; a text of fewer words than a shingle
is one shingle; rows repeated with one doc_id get equal answers; rows without doc_id keep their fingerprint and have a
component_id only through documents with one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import slices
from ._shingles import shingles, word_hashes
from ._store import BROADCAST_IDS, Store, with_ids, without_ids
from .components import components

BITS = 64
SEED = 42
#: Parts are planned for at least so many fingerprints, so that a small input runs the plan of a large one.
PLAN_FOR = 1_000_000
#: Cost of one signature row against one pair that meets by chance, for the dynamic program.
SIGNATURE_COST, PAIR_COST = 1.0, 0.02

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle of the text with A-Z lower-cased."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :])), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes.  Signed 64-bit."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        rows = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, fp`` for every row of ``docs``."""

    def run(batches):
        for part in slices(batches):
            values = [fingerprint(shingle_hashes(t, shingle)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j set: 64 x 64 sums over all of them."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = ((values[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            total += bits.T @ bits
            n += len(values)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i * BITS + j, -1)), pa.array(np.append(total[i, j].astype(np.int64), n))], names=["ij", "c"])

    out = np.zeros((BITS, BITS))
    n = 0
    for r in nodes.select("fp").mapInArrow(run, "ij long, c long").groupBy("ij").agg(F.sum("c").alias("c")).collect():
        if r["ij"] < 0:
            n = int(r["c"])
        else:
            i, j = divmod(r["ij"], BITS)
            out[i, j] = out[j, i] = r["c"]
    return n, out


def plan_parts(n: int, both: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """The parts (lists of bits) and their thresholds; -1 means that a part need not be probed."""
    share, real, n = np.diag(both) / max(n, 1), max(n, 1), max(n, PLAN_FOR)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    corr = np.abs(both / real - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    differ = 2 * share * (1 - share)

    def grouped(m: int) -> list[list[int]]:
        left, parts = set(range(BITS)), []
        for k in range(m):
            want = (BITS + m - 1 - k) // m
            part = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
            left.remove(part[0])
            while len(part) < want:
                nxt = max(left, key=lambda b: (corr[b, part].sum(), -b))
                part.append(nxt)
                left.remove(nxt)
            parts.append(sorted(part))
        return parts

    def close(bits: list[int], most: int) -> list[float]:
        """The chance that two fingerprints differ in at most t of these bits, for t up to most."""
        dist = np.zeros(len(bits) + 1)
        dist[0] = 1
        for b in bits:
            dist[1:] = dist[1:] * (1 - differ[b]) + dist[:-1] * differ[b]
            dist[0] *= 1 - differ[b]
        return np.cumsum(dist)[: most + 1].tolist()

    best: tuple[float, list] = (math.inf, [])
    for m in range(1, tau + 2):
        parts, total = grouped(m), tau - m + 1
        # cost[t + 1] of a part at threshold t; states of the program are sums of thresholds, shifted by parts so far
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in parts:
            chance = close(bits, min(tau, len(bits)))
            new: dict[int, tuple[float, list[int]]] = {}
            for done, (cost, chosen) in states.items():
                probes = 0
                for t in range(-1, min(tau, 4, len(bits))+ 1):
                    extra = 0.0
                    if t >= 0:
                        probes += math.comb(len(bits), t)
                        extra = SIGNATURE_COST * n * (1 + probes) + PAIR_COST * n * n / 2 * chance[t] * 2
                    if done + t > total + m:
                        break
                    key, value = done + t, cost + extra
                    if key not in new or value < new[key][0]:
                        new[key] = (value, [*chosen, t])
            states = new
        if total in states and states[total][0] < best[0]:
            best = (states[total][0], list(zip(parts, states[total][1])))
    return [x for x in best[1] if x[1] >= 0]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _probe(part: int, key: Column):
    return lambda flip: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(flip).alias("key"))


def links(nodes: DataFrame, parts: list[tuple[list[int], int]], tau: int, similarity: float | None = None, beyond: int = -1) -> DataFrame:
    """``a, b`` (ids, a < b) of nodes whose fingerprints differ in at most tau bits, and in more than ``beyond``.

    ``nodes`` has distinct ``id`` and ``fp``.  With ``similarity`` also ``class`` and ``size``: only pairs of two classes whose
    sizes allow that similarity.
    """
    extra = ["class", "size"] if similarity else []
    filed, probing = [], []
    for i, (bits, t) in enumerate(parts):
        mask = sum(1 << b for b in bits)
        flips = [_signed(sum(1 << b for b in c)) for r in range(t + 1) for c in combinations(bits, r)]
        key = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        filed.append(F.struct(F.lit(i).alias("part"), key.alias("key")))
        probing.append(F.transform(F.array(*[F.lit(x) for x in flips]), _probe(i, key)))

    def side(name: str, keys: Column) -> DataFrame:
        columns = [F.col("id").alias(name), F.col("fp").alias(f"{name}_fp"), *[F.col(c).alias(f"{name}_{c}") for c in extra]]
        return nodes.select(*columns, F.explode(keys).alias("k")).select("*", "k.part", "k.key").drop("k")

    left, right = side("a", F.flatten(F.array(*probing))), side("b", F.array(*filed))
    near = (left["part"] == right["part"]) & (left["key"] == right["key"]) & (left["a"] < right["b"])
    if similarity:
        low, high = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
        near = near & (left["a_class"] != right["b_class"]) & (low >= similarity * high)
    differ = left["a_fp"].bitwiseXOR(right["b_fp"])
    near = near & F.bit_count(differ).between(beyond + 1, tau)
    # A pair that meets in several parts counts in the first only.
    for i, (bits, t) in enumerate(parts[:-1]):
        mask = _signed(sum(1 << b for b in bits))
        near = near & ((left["part"] <= i) | (F.bit_count(differ.bitwiseAND(F.lit(mask))) > t))
    return left.join(right, near).select("a", "b")


def find_near(docs: DataFrame, shingle: int = 3, tau: int = 3) -> DataFrame:
    """``doc_id, fp, component_id``: components of documents whose fingerprints are linked at tau or fewer bits."""
    store = Store(docs.sparkSession, "simhash")
    prints = store.keep(fingerprints(docs, shingle), "prints")
    nodes = store.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    n, both = bit_counts(nodes)
    if n:
        near = store.keep(links(nodes.select(F.col("fp").alias("id"), "fp"), plan_parts(n, both, tau), tau), "links")
        ends = nodes.select(F.col("fp").alias("a"), F.col("rep").alias("u"))
        edges = near.join(ends, "a").select("u", "b").join(nodes.select(F.col("fp").alias("b"), F.col("rep").alias("v")), "b").select("u", "v").dropna()
        roots = components(store, edges)
        final = store.keep(nodes.join(roots, nodes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "final")
    else:
        final = nodes.select("fp", F.col("rep").alias("component_id"))
    return store.done(prints.join(final, "fp").select("doc_id", "fp", "component_id"))


#: Bits at which candidates are sought, one level after the other.
LEVELS = (3, 5, 7)
#: Shingles are counted in runs of so many; those that FEW documents of a run have are added up, at most FREQUENT are used.
RUN, FEW, FREQUENT = 250_000, 5, 200_000
#: A prefix is longer by one shingle for each so many of the set, and may do without that many times DROPPED of them.
SPREAD, DROPPED = 10, 0.4
#: Longs of a set's parities, and least hashes of a set, in as many orders.
WORDS, LEAST = 8, 4


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that many documents have, rarest first.  They stand last in the order of shingles, which makes for fewer
    candidates; any order gives the same pairs.  All documents are counted."""

    def run(batches):
        held, size = [], 0

        def counted():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[c >= FEW].view(np.int64)), pa.array(c[c >= FEW])], names=["h", "c"])

        for part in slices(batches):
            for t in part.column("text").to_pylist():
                own = np.unique(shingles(word_hashes(t), words))
                held.append(own)
                size += len(own)
                if size >= RUN:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counted = docs.select("doc_id", "text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    rows = counted.orderBy(F.desc("c"), "h").limit(FREQUENT).collect()
    return np.array([r["h"] for r in rows[::-1]], np.int64).view(np.uint64)


def prefix(own: np.ndarray, last: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set ``own`` in the order of shingles: by hash, but those of ``last`` (sorted) at the end
    by their rank.  The prefixes of two sets of at least that similarity share 1 + size // SPREAD shingles of the smaller."""
    if not len(own):
        return own
    most = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1 + len(own) // SPREAD
    if len(last):
        at = np.minimum(np.searchsorted(last, own), len(last) - 1)
        late = last[at] == own
        own = np.concatenate([own[~late], own[late][np.argsort(rank[at[late]])]])
    return own[:most]


def dropped(size: Column) -> Column:
    """How many shingles of its prefix a set may do without: two similar ones, whose sizes differ by a quarter at most, still
    share 1 + k - d - e of the 1 + k that they had, where d and e are at most 0.4 and 0.5 k."""
    return F.floor(DROPPED * F.floor(size / SPREAD)).cast("long")


def parities(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls to each of 64 * WORDS bits; two sets differ in at least as many shingles as
    their parities differ in bits."""
    counts = np.bincount((own % np.uint64(BITS * WORDS)).astype(np.int64), minlength=BITS * WORDS)
    return np.packbits(counts.astype(np.uint8) & 1).view(np.int64)


def least(own: np.ndarray) -> np.ndarray:
    """The least hash of a set in LEAST orders; two sets agree in each with the chance of their similarity."""
    if not len(own):
        return own
    return np.array([(own * np.uint64(xxhash.xxh64_intdigest(b"order%d" % i, SEED) | 1)).min() for i in range(LEAST)], np.uint64)


def can_be_alike(similarity: float) -> Column:
    """Whether the sizes and parities of two sets, in columns ``a_...`` and ``b_...``, allow that similarity."""
    odd = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _PARITIES), F.lit(0))
    sizes = F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size")
    return sizes & (odd <= (1 - similarity) / (1 + similarity) * (F.col("a_size") + F.col("b_size")) + 1e-6)


def to_the_first(nodes: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` (ids, a < b): each node with the first of those that share its fingerprint, or a least hash in one order, if
    sizes and parities allow that similarity.  At most 1 + LEAST pairs a node, which join most of a dense group."""
    own = ["id", "size", *_PARITIES]
    keys = F.concat(F.array(F.struct(F.lit(-1).alias("order"), F.col("fp").alias("key"))), F.transform("least", lambda x, i: F.struct(i.alias("order"), x.alias("key"))))
    each = nodes.select(*own, F.explode(keys).alias("k")).select(*own, "k.*")
    first = each.groupBy("order", "key").agg(F.min(F.struct(*own)).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = first.select("order", "key", *[F.col(f"f.{c}").alias("a" if c == "id" else f"a_{c}") for c in own])
    each = each.select("order", "key", *[F.col(c).alias("b" if c == "id" else f"b_{c}") for c in own])
    return each.join(first, ["order", "key"]).where((F.col("a") < F.col("b")) & can_be_alike(similarity)).select("a", "b").distinct()


_PARITIES = [f"parity{i}" for i in range(WORDS)]
_SKETCH = "doc_id long, fp long, sig long, size long, prefix array<long>, least array<long>, " + ", ".join(f"{x} long" for x in _PARITIES)


def _sketches(shingle: int, words: int, similarity: float, late: np.ndarray):
    rank = np.argsort(late)
    last = late[rank]

    def run(batches):
        for part in slices(batches):
            fp, sig, size, first, low, odd = [], [], [], [], [], []
            for t in part.column("text").to_pylist():
                hashes = word_hashes(t)
                own = np.unique(shingles(hashes, words))
                fp.append(fingerprint(shingles(hashes, shingle)))
                sig.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
                size.append(len(own))
                first.append(prefix(own, last, rank, similarity).view(np.int64))
                low.append(least(own).view(np.int64))
                odd.append(parities(own))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in (fp, sig, size)), pa.array(first, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64())), *map(pa.array, np.array(odd).T.copy())],
                names=["doc_id", "fp", "sig", "size", "prefix", "least", *_PARITIES],
            )

    return run


def with_classes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """``nodes`` (distinct ``id``) with the ``class`` that ``groups`` (``id, class``, staged) says.

    Most nodes are a group of their own.  The others are counted; up to half of BROADCAST_IDS (16 MB) they are broadcast, and
    no node moves with its sketches; beyond, both sides meet by id.
    """
    joined = groups.where("id <> class")
    if joined.count() <= BROADCAST_IDS // 2:
        joined = F.broadcast(joined)
    return nodes.join(joined, "id", "left").withColumn("class", F.coalesce("class", "id"))


def meetings(store: Store, nodes: DataFrame, similarity: float, beyond: int) -> DataFrame:
    """``a, b`` (ids, a < b) of nodes of two classes: all that have at least that similarity and whose fingerprints differ in
    more than ``beyond`` bits, and some that are less alike.

    ``nodes`` has distinct ``id`` and what ``_sketches`` gives.  Two such sets share shingles of their prefixes, and their
    parities differ in few bits.  Shingles in the prefixes of one class only are left out first, then each set does without
    the shingles of its prefix that most others have, as many as it may.
    """
    each = nodes.select("id", "size", "class", F.explode("prefix").alias("key"))
    keys = each.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n"))
    keys = store.keep(keys.where("low < high").select("key", "n"), "keys")
    listed = each.select("id", "size", "key").join(keys, "key").groupBy("id").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"))
    rarest = F.slice(F.col("keys.key"), F.lit(1), F.greatest(F.size("keys") - dropped(F.col("size")), F.lit(0)).cast("int"))
    chosen = store.keep(listed.select("id", F.explode(rarest).alias("key")), "chosen")
    own = ["id", "fp", "class", "size", *_PARITIES]
    rows = store.keep(chosen.join(nodes.select(*own), "id"), "rows")
    left, right = (rows.select("key", *[F.col(c).alias(s if c == "id" else f"{s}_{c}") for c in own]) for s in "ab")
    low, high = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    near = (left["key"] == right["key"]) & (left["a"] < right["b"]) & (left["a_class"] != right["b_class"]) & (low >= similarity * high)
    near = near & (F.bit_count(left["a_fp"].bitwiseXOR(right["b_fp"])) > beyond)
    odd = sum((F.bit_count(left[f"a_{c}"].bitwiseXOR(right[f"b_{c}"])) for c in _PARITIES), F.lit(0))
    near = near & (odd <= (1 - similarity) / (1 + similarity) * (left["a_size"] + right["b_size"]) + 1e-6)
    left_over = F.floor(low / SPREAD) - dropped(low) - dropped(high)
    met = left.join(right, near).select("a", "b", left_over.alias("more")).groupBy("a", "b", "more").agg(F.count("*").alias("n"))
    return met.where("n > more").select("a", "b")


def _sets(words: int):
    def run(batches):
        for part in slices(batches):
            sets = [np.unique(shingles(word_hashes(t), words)).view(np.int64) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


def near_groups(docs: DataFrame, store: Store, shingle: int = 3, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, root`` for every row of ``docs``: groups of documents linked by a Jaccard similarity of their sets of
    ``words``-word shingles of at least ``similarity``; root is the group's smallest doc_id.

    Candidates are fingerprints within LEVELS[-1] bits, then all pairs of ``meetings``, so that no pair is lost.  The closest
    are sought and verified first; documents that are in one group already are not compared again, so that a large group
    costs links, not pairs.  Equal sets are one node.

    Edge cases: null and empty texts have the empty set and are one group; texts of fewer words than a shingle are one
    shingle; rows repeated with one doc_id share what the first of their groups says; a row without doc_id gets the root of
    its equals, null if they have none; ties go to the smaller doc_id; an empty table gives no rows.
    """
    prints = store.keep(docs.select("doc_id", "text").mapInArrow(_sketches(shingle, words, similarity, frequent(docs, words)), _SKETCH), "sketches")
    same = [F.min(c).alias(c) for c in ("fp", *_PARITIES)]
    nodes = store.keep(prints.groupBy("sig", "size").agg(F.min("doc_id").alias("id"), *same, F.first("prefix").alias("prefix"), F.first("least").alias("least")), "sets")
    known = nodes.where("id IS NOT NULL")
    n, both = bit_counts(known)
    repeated = not prints.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    groups = known.select("id", F.col("id").alias("class"))
    done = -1
    facts = known.select("id", "size", *_PARITIES)
    for level, tau in enumerate((0, *LEVELS, BITS) if n else ()):
        if tau == BITS:
            pairs = meetings(store, with_classes(known, groups), similarity, done)
        elif not tau:
            pairs = to_the_first(known, similarity)
        else:
            # Nearer pairs of two groups have been verified before, and failed.
            pairs = store.keep(links(with_classes(known, groups), plan_parts(n, both, tau), tau, similarity, done), f"linked{level}")
            for side in "ab":
                pairs = pairs.join(facts.select(*[F.col(c).alias(side if c == "id" else f"{side}_{c}") for c in facts.columns]), side)
            pairs = pairs.where(can_be_alike(similarity)).select("a", "b")
            done = tau
        pairs = store.keep(pairs, f"pairs{level}")
        ends = store.keep(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), f"ends{level}")
        sets = with_ids(docs.select("doc_id", "text"), ends).mapInArrow(_sets(words), "id long, shingles array<long>")
        sets = store.keep(sets.dropDuplicates(["id"]) if repeated else sets, f"shingles{level}")
        held = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        held = held.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select(F.col("a").alias("u"), F.col("b").alias("v"))
        # Links of the same two groups are one.
        for end in "uv":
            held = held.join(groups.select(F.col("id").alias(end), F.col("class").alias(f"{end}_class")), end)
        held = store.keep(held.select(F.col("u_class").alias("u"), F.col("v_class").alias("v")).distinct(), f"held{level}")
        store.drop(f"linked{level}", f"pairs{level}", f"ends{level}", f"shingles{level}")
        roots = components(store, held, f"cc{level}_")
        groups = groups.join(roots, F.col("class") == F.col("node"), "left").select("id", F.coalesce("root", "class").alias("class"))
        groups = store.keep(groups, f"groups{level}")
    final = nodes.join(groups, "id", "left").select("sig", "size", F.col("class").alias("root"))
    return store.done(prints.join(final, ["sig", "size"]).select("doc_id", "root"), "near_groups")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of ``near_groups``; all columns as they were, whatever their names.  Rows
    without a doc_id stay; edge cases as there."""
    groups = near_groups(docs, Store(docs.sparkSession, "near-copies"))
    store = Store(docs.sparkSession, "near-dropped")
    return without_ids(docs, store.keep(groups.where("doc_id <> root").select("doc_id").distinct(), "gone"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_near(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
