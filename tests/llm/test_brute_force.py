"""Operators against plain versions on small tables, with heavy repeats."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rimeframe.llm import exact_dedup, license_scan, line_quality, mixing, quality_classifier, sharding, simhash, substring_dedup, suffix_dedup
from rimeframe.llm._store import Store
from rimeframe.llm.run_length_index import RunLengthIndex
from rimeframe.llm.sentencepiece_codec import Codec, tokenize


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with shared passages, whole and near copies, stuttering lines, a hot passage and a hot source."""
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfkmt" for b in "aeiou" for c in ("n", "r", "st", "é")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passages, hot = [text(rng.randint(55, 90)) for _ in range(4)], text(60)
    docs = []
    for i in range(160):
        body = text(rng.randint(5, 150))
        if i % 3 == 0:
            body = f"{text(rng.randint(0, 9))} {hot} {body}"
        if i % 5 == 0:
            body += "\n" + rng.choice(passages)
        if i % 11 == 0 and docs:
            w = docs[rng.randrange(len(docs))][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            body = " ".join(w)
        if i % 13 == 0 and docs:
            body = docs[rng.randrange(len(docs))][1]
        if i % 17 == 0:
            body += "\n" + "so " * 80
        docs.append((i, body))
    rng.shuffle(docs)
    rows = [(i, t, "en", "s0" if i % 3 == 0 else f"s{i % 4}", len(t)) for i, t in docs]
    return dict(docs), spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.fixture(scope="module")
def folder(corpus, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    corpus[1].write.parquet(f"{root}/documents.parquet")
    return root


def removed(units, length, firsts, doc):
    gone = np.zeros(len(units), bool)
    for k in range(len(units) - length + 1):
        if firsts[tuple(units[k : k + length])] < doc:
            gone[k : k + length] = True
    return gone


@pytest.mark.parametrize("op, of", [(substring_dedup.op1_substring_dedup, lambda t: t.encode().split()), (suffix_dedup.op8_suffix_dedup, lambda t: list(t.encode()))])
def test_repeats(spark, corpus, folder, op, of):
    docs = {i: of(t) for i, t in corpus[0].items()}
    firsts = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - 49):
            firsts.setdefault(tuple(docs[i][k : k + 50]), i)
    for r in op(spark, folder).collect():
        gone = removed(docs[r.doc_id], 50, firsts, r.doc_id)
        kept = [u for u, g in zip(docs[r.doc_id], gone) if not g]
        joined = b" ".join(kept) if op is substring_dedup.op1_substring_dedup else bytes(kept)
        assert r.n_removed == gone.sum() and r.kept_sha256 == hashlib.sha256(joined).hexdigest()


def test_difference_cover_meets_every_pair():
    mask = substring_dedup.cover_mask()
    for i in range(31):
        for j in range(31):
            assert any(mask[(i + d) % 31] and mask[(j + d) % 31] for d in range(31))
    with pytest.raises(ValueError):
        substring_dedup.cover_mask(31, (0, 1, 2, 3, 4, 5))


def test_index_on_patterns_of_its_own_and_others():
    rng = random.Random(1)
    for _ in range(60):
        length, base = rng.choice([3, 8, 20]), "".join(rng.choices("ab\0c", k=200))
        texts = list({base[a : a + rng.randint(1, 60)].encode() for a in [rng.randrange(140) for _ in range(20)]})
        owners = np.array([rng.randrange(30) for _ in texts])
        index = RunLengthIndex(texts, owners, length)
        patterns = [base[a : a + 40].encode() + b"z" + base[b : b + 20].encode() for a, b in [(rng.randrange(150), rng.randrange(150)) for _ in range(5)]]
        sizes, owner = index.stream(patterns)
        for k, p in enumerate(patterns):
            for i in range(len(p)):
                best = max((n for n in range(len(p) - i + 1) if any(p[i : i + n] in t for t in texts)), default=0)
                want = min((int(o) for t, o in zip(texts, owners) if p[i : i + length] in t), default=-1) if best >= length else -1
                assert sizes[k, i] == best and owner[k, i] == want
        assert (index.stream(patterns, every=False)[1] == owner).all()


def shards(rng, n=60):
    """Rows (shard, segment, first, last) in order of shard and first, whose segments share strings within a shard."""
    rows = []
    for shard in range(n):
        base = bytes(rng.choices(b"abcd\0", k=120))
        segments = {base[a : a + rng.randint(50, 84)] for a in [rng.randrange(60) for _ in range(rng.randint(1, 6))]}
        rows += sorted(((shard, s, f := rng.randrange(30), f + rng.choice((0, 0, 3))) for s in segments if len(s) >= 50), key=lambda r: r[2])
    return rows


def test_others_are_streamed_through_the_references(monkeypatch):
    made = []

    class Watched(RunLengthIndex):
        def __init__(self, texts, *more):
            super().__init__(texts, *more)
            self.texts = set(texts)

        def stream(self, patterns, every=True):
            out = super().stream(patterns, every)
            made.append((self.jumps, len(set(patterns) - self.texts)))
            return out

    monkeypatch.setattr(suffix_dedup, "RunLengthIndex", Watched)
    rows = shards(random.Random(2))
    part = suffix_dedup._batch(**{c: pa.array(v, t) for (c, t), v in zip((("shard", pa.int64()), ("segment", pa.binary()), ("first", pa.int64()), ("last", pa.int64())), zip(*rows))})
    got = {(s, t): o for b in suffix_dedup._owners([part]) for s, t, o in zip(*(b.column(c).to_pylist() for c in ("shard", "segment", "owners")))}
    for shard, segment, first, last in rows:
        want = [min(r[2] for r in rows if r[0] == shard and segment[k : k + 50] in r[1]) for k in range(len(segment) - 49)]
        assert got.get((shard, segment), want) == want and ((shard, segment) in got) == (min(want) < last)
    assert made and all(jumps > 0 and others > 0 for jumps, others in made)


def segment_rows(rows):
    types = (("shard", pa.int64()), ("segment", pa.binary()), ("gram", pa.int32()), ("first", pa.int64()), ("last", pa.int64()))
    return suffix_dedup._batch(**{c: pa.array(v, t) for (c, t), v in zip(types, zip(*rows))})


def test_small_batches_share_an_index(monkeypatch):
    """Indexes are as large as INDEX_BYTES says, however few rows a batch brings."""
    made = []

    class Watched(RunLengthIndex):
        def __init__(self, texts, *more):
            made.append(len(texts))
            super().__init__(texts, *more)

    monkeypatch.setattr(suffix_dedup, "RunLengthIndex", Watched)
    rows = segment_rows([(shard, s, 0, f, e) for shard, s, f, e in shards(random.Random(4))]).drop_columns(["gram"])
    got = [[r for b in suffix_dedup._owners(batches) for r in b.to_pylist()] for batches in ([rows], [rows.slice(i, 1) for i in range(rows.num_rows)])]
    assert sorted(map(repr, got[0])) == sorted(map(repr, got[1])) and len(made) == 2


def test_segments_without_a_shared_side_are_not_indexed(monkeypatch):
    """Segments that have only the minimizer in common are left out of the index; all that share a window are not."""
    made = []

    class Watched(RunLengthIndex):
        def __init__(self, texts, *more):
            made.extend(texts)
            super().__init__(texts, *more)

        def stream(self, patterns, every=True):
            made.extend(patterns)
            return super().stream(patterns, every)

    monkeypatch.setattr(suffix_dedup, "RunLengthIndex", Watched)
    rng, rows, width = random.Random(5), [], suffix_dedup.WINDOW - suffix_dedup.GRAM
    for shard in range(300):
        bases = [bytes(rng.choices(range(256), k=2 * width + suffix_dedup.GRAM)) for _ in range(2)]
        anchor, segments = bases[0][width : -width], {}
        for _ in range(rng.randint(2, 5)):
            base = rng.choice(bases)
            before, behind = rng.randint(0, width), rng.randint(0, width)
            if before + behind >= width:
                segments[base[width - before : width] + anchor + base[-width:][:behind]] = before
        rows += sorted(((shard, s, g, f := rng.randrange(30), f + rng.choice((0, 0, 3))) for s, g in segments.items()), key=lambda r: r[3])
    got = {(r["shard"], r["segment"]): r["owners"] for b in suffix_dedup._owners([segment_rows(rows)]) for r in b.to_pylist()}
    for shard, segment, _, first, last in rows:
        windows = [segment[k : k + 50] for k in range(len(segment) - 49)]
        others = [r for r in rows if r[0] == shard and r[1] != segment]
        want = [min([first, *(r[3] for r in others if w in r[1])]) for w in windows]
        assert got.get((shard, segment), want) == want and ((shard, segment) in got) == (min(want) < last)
    partners = {s for shard, s, *_ in rows for r in rows if r[0] == shard and r[1] != s and any(s[k : k + 50] in r[1] for k in range(len(s) - 49))}
    short = [r for r in rows if r[2] + suffix_dedup.GRAM + 13 > len(r[1])], [r for r in rows if r[2] < 13]
    for some in (*short, rows[:1]):  # none with a whole side before the minimizer, or behind it
        assert not some or [*suffix_dedup._owners([segment_rows(some)])]
    assert len(partners) < len({r[1] for r in rows}) and set(made) < {r[1] for r in rows}


def test_removed_ranges_are_merged():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(0, 60)
        pairs = [(a, a + rng.randint(1, 12)) for a in (rng.randrange(60) for _ in range(n // 8))]
        gone = {i for a, b in pairs for i in range(a, b)}
        begin, end = suffix_dedup._merged(*(np.array([p[i] for p in pairs], np.int32) for i in (0, 1)))
        assert begin.tolist() == sorted(i for i in gone if i - 1 not in gone) and end.tolist() == sorted(i + 1 for i in gone if i + 1 not in gone)


def test_minimizers_are_the_leftmost_of_the_least():
    rng = np.random.default_rng(3)
    for most in (3, 50, 1 << 60):
        x = rng.integers(0, most, 300, dtype=np.uint64)
        assert suffix_dedup.leftmost_least(x, 35).tolist() == [i + int(np.argmin(x[i : i + 35])) for i in range(266)]


@pytest.mark.parametrize("quantum", [1, 8])
def test_pieces_hold_every_window_once(quantum):
    rng = random.Random(quantum)
    rows = []
    for n in range(200):
        gram = rng.randint(0, 34)
        rows.append((n, bytes(rng.choices(b"ab", k=rng.randint(50, gram + 50))), gram, n, n))
    part = suffix_dedup._batch(number=[r[0] for r in rows], segment=[r[1] for r in rows], gram=[r[2] for r in rows], first=[r[3] for r in rows], last=[r[4] for r in rows])
    windows, shard = Counter(), {}
    for b in suffix_dedup._split(quantum)([part]):
        for number, at, key, piece, gram in zip(*(b.column(c).to_pylist() for c in ("number", "at", "shard", "segment", "gram"))):
            for k in range(len(piece) - 49):
                windows[number, at + k] += 1
                assert piece[k : k + 50] == rows[number][1][at + k : at + k + 50] and at + gram == rows[number][2]
                assert shard.setdefault((piece[k : k + 50], gram - k), key) == key
    assert windows == Counter((n, k) for n, s, *_ in rows for k in range(len(s) - 49))


@pytest.mark.parametrize("hot", [1, 4])
def test_hot_shards_are_split(spark, corpus, folder, monkeypatch, hot):
    want = sorted(map(tuple, suffix_dedup.op8_suffix_dedup(spark, folder).collect()))
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert sorted(map(tuple, suffix_dedup.op8_suffix_dedup(spark, folder).collect())) == want


def test_sharding_law(spark, corpus, folder):
    rows = sharding.op2_sharding(spark, folder).collect()
    size = Counter()
    for r in rows:
        text = corpus[0][r.doc_id]
        assert r.size == len(text.encode()) + 16
        size[r.shard] += r.size
    ideal, most = sum(size.values()) / 40, max(r.size for r in rows)
    assert set(size) <= set(range(40)) and max(abs(v - ideal) for v in size.values()) <= most
    for s in size:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


@pytest.mark.parametrize("share", [0.0, 0.4])
def test_sharding_of_a_hot_text(spark, share):
    n = 4000
    rows = [(i, "the same text " * 3 if i < share * n else f"text {i} " * (1 + i % 7)) for i in range(n)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r.b for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 8


def test_dealt_rows_lie_in_one_partition_each(spark, corpus):
    dealt = sharding.deal(corpus[1], 4).withColumn("p", F.spark_partition_id())
    places = dealt.select("shard", "p").distinct().collect()
    assert len({r.p for r in places}) == len(places) == len({r.shard for r in places})


@pytest.mark.parametrize("fan", [3, 2000])
def test_mixing(spark, corpus, monkeypatch, fan):
    monkeypatch.setattr(mixing, "FAN", fan)
    rows = mixing.mix(corpus[1]).collect()
    again = mixing.mix(corpus[1].repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    sources = {r.doc_id: r.source for r in corpus[1].collect()}
    taken, target, own = Counter(), {}, Counter()
    for r in rows:
        taken[sources[r.doc_id]] += r.copies * r.size
        own[sources[r.doc_id]] += r.size
        target[sources[r.doc_id]] = r.target
    assert abs(sum(target.values()) - sum(own.values())) < 1e-6
    most = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= most and target[s] <= 3 * own[s] + 1e-9 for s in target)


def targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, out = set(order), {}
    while open_:
        share = Fraction(sum(sizes.values()) - sum(out.values()), sum(weight[s] for s in open_))
        above = {s for s in open_ if share * weight[s] > most * sizes[s]}
        if not above:
            return out | {s: share * weight[s] for s in open_}
        out |= {s: Fraction(most * sizes[s]) for s in above}
        open_ -= above
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 100, None: 5}, {f"s{i % 7}é{i}": (i * 7919) % 5000 + (0 if i % 9 else 10**9) for i in range(60)} | {"": 0, "\ud7ff": 3, "\U00010000": 8, "\uffff": 9}, {"x": 0}])
def test_targets_reshare_what_is_capped(spark, sizes):
    rows = mixing.plan(Store(spark, "test"), spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = targets(sizes)
    assert [r.name for r in sorted(rows, key=lambda r: r.id)] == sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    assert sorted(r.id for r in rows) == list(range(len(sizes))) and all(r.target == pytest.approx(float(want[r.name]), rel=1e-14) for r in rows)
    assert all(r.whole + r.part == pytest.approx(float(want[r.name] / sizes[r.name]) if sizes[r.name] else 0) and 0 <= r.part < 1 and r.whole <= 3 for r in rows)


def test_rounding_keeps_expectations():
    keys, sizes = [f"k{i}" for i in range(40)], sorted((random.Random(3).randint(1, 500) for _ in range(40)), reverse=True)
    out = np.array([mixing.settle_pool(keys, sizes, 0.3, seed) for seed in range(3000)])
    assert np.abs(out.mean(0) - 0.3).max() < 0.05 and np.abs((out * sizes).sum(1) / sum(sizes) - 0.3).max() < 1e-6
    assert ((out > 0) & (out < 1)).sum(1).max() <= 1
    pairs = [(f"k{i}", sizes[i], 0.1 + 0.02 * i) for i in range(40)]
    out = np.array([mixing.settle(pairs, seed) for seed in range(3000)])
    assert np.abs(out.mean(0) - [p for _, _, p in pairs]).max() < 0.05 and ((out > 0) & (out < 1)).sum(1).max() <= 1


def test_license_scan_against_all_pairs(spark):
    rng = random.Random(4)
    sentences = [t for _, _, t in license_scan.TEMPLATES]
    vocabulary = sorted({w for t in sentences for w in t.split()} | {f"x{i}" for i in range(40)})
    rows = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 560))
        if i % 2:
            sentence = rng.choice(sentences).split()
            for _ in range(rng.randint(0, 4)):
                sentence[rng.randrange(len(sentence))] = "zzz"
            at = rng.randint(0, len(words))
            words[at:at] = sentence
        rows.append((i, rng.choice([" ", "-", ".\n"]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
        share = {}  # of each family and label
        for s in range(0, max(len(words) - 100, 1), 100):
            block = {*zip(words[s : s + 200], words[s + 1 : s + 200])}
            for family, label, sentence in license_scan.TEMPLATES:
                own = {*zip(sentence.split(), sentence.split()[1:])}
                if len(block & own) >= 0.8 * len(own):
                    share[family, label] = max(share.get((family, label), 0), len(block & own) / len(own))
        labels = {l for (f, l), x in share.items() if x == max(y for (g, _), y in share.items() if f == g)}
        best = max(share.values(), default=0.0)
        hits = [(k, name) for p, name in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert r.n_words == len(words) and r.n_base == len(hits)
        assert r.first_word == min((k for k, _ in hits), default=None) and r.last_word == max((k for k, _ in hits), default=None)
        assert set(filter(None, r.labels.split(","))) == labels | {n for _, n in hits}
        assert r.score == pytest.approx(1.0 if hits else best)


def test_repeated_words():
    rng = random.Random(6)
    for _ in range(300):
        words = rng.choices("abc", k=rng.randint(0, 25))
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        marked = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
        assert line_quality.repeated_words(words) == len(marked)


def test_lines():
    good = "This is a plain sentence that ends well."
    bad = ["Home | About | Shop | Contact |", "BUY!! NOW!! CHEAP!! STUFF!!", "a### b$$$ c%%%", "Read more", "go go go go go go now", "Click here to see it."]
    text = "\n".join([good] * 1 + bad + ["Another line of prose, with enough words to count for something here."])
    judged = line_quality.judge(text)
    assert judged[9].split("\n") == [good, "Another line of prose, with enough words to count for something here."]


def test_simhash_components(spark, corpus, folder):
    rows = {r.doc_id: r for r in simhash.op7_simhash(spark, folder).collect()}
    ids = sorted(rows)
    prints = np.array([int(rows[i].fingerprint, 16) for i in ids], np.uint64)
    for i, f in zip(ids, prints):
        assert int(f) == simhash.fingerprint(simhash.shingle_hashes(corpus[0][i], 3)) % (1 << 64)
    root = list(range(len(ids)))
    for _ in ids:  # labels spread until they rest
        new = [min(root[j] for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= 3)) for i in range(len(ids))]
        if new == root:
            break
        root = new
    assert all(rows[ids[i]].component_id == ids[root[i]] for i in range(len(ids)))


@pytest.mark.parametrize("tau", [3, 5, 8])
def test_no_link_is_lost(spark, tau):
    rng = np.random.default_rng(tau)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = set(base.tolist())
    for b in base:
        for _ in range(6):
            flips = rng.choice(64, rng.integers(1, tau + 3), replace=False)
            values.add(int(b) ^ int(sum(1 << int(f) for f in flips)))
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    n, both = simhash.bit_counts(nodes)
    parts = simhash.plan_parts(n, both, tau)
    got = {(r.a, r.b) for r in simhash.links(nodes.select(F.col("fp").alias("id"), "fp"), parts, tau).collect()}
    x = np.array(signed)
    want = {(int(a), int(b)) for a in x for b in x if a < b and bin((int(a) ^ int(b)) & ((1 << 64) - 1)).count("1") <= tau}
    assert got == want and sum(t + 1 for _, t in parts) == tau + 1


def test_near_copies_leave_one_of_each_group(spark, corpus):
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in corpus[0].items()}
    kept = sorted(r.doc_id for r in simhash.drop_near_copies(corpus[1]).select("doc_id").collect())
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    group = {i: i for i in sets}
    for _ in sets:
        new = {i: min(group[j] for j in sets if similar(i, j)) for i in sets}
        if new == group:
            break
        group = new
    assert set(kept) >= set(group.values())  # none goes that has no near copy
    caught = 1 - (len(kept) - len(set(group.values()))) / max(1, len(sets) - len(set(group.values())))
    assert caught >= 0.8


def test_no_near_copy_stays(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfghjklmnpqrstvwxz" for b in ("an", "el", "ir", "ot", "um")]
    texts = {}
    for i in range(240):  # isolated pairs, and some chains of three
        w = rng.choices(words, k=rng.choice((9, 30, 100, 150, 400, 1500)))
        for j in range(2 + (i % 10 == 0)):
            texts[1000 * j + i] = " ".join(w)
            for _ in range(max(1, len(w) // 50)):
                w[rng.randrange(len(w))] = "changed"
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    prints = {i: simhash.fingerprint(simhash.shingle_hashes(t, 3)) for i, t in texts.items()}
    alike = [(a, b) for a in texts for b in texts if a < b and a % 1000 == b % 1000 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(((prints[a] ^ prints[b]) & ((1 << 64) - 1)).bit_count() > simhash.LEVELS[-1] for a, b in alike) >= 10
    root = {i: i for i in texts}
    for _ in range(3):
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == sorted(set(root.values()))


def test_a_dense_group_costs_links_not_pairs(spark, monkeypatch):
    """Of n texts that are all alike, some n links are staged, and all of them but one go."""
    staged, keep = {}, Store.keep

    def counted(self, df, label, *more):
        out = keep(self, df, label, *more)
        staged[label] = out.count()
        return out

    monkeypatch.setattr(Store, "keep", counted)
    rng, n = random.Random(8), 150
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(n):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(400)] = f"x{i}"
        texts.append((i, " ".join(words)))
    kept = simhash.drop_near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [0]
    assert sum(c for k, c in staged.items() if k.startswith(("pairs", "held"))) < (2 + 2 * simhash.LEAST) * n


def test_least_hashes_agree_with_the_chance_of_similarity():
    rng = np.random.default_rng(4)
    same = 0
    for _ in range(500):
        x = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        same += (simhash.least(x[:100]) == simhash.least(x[10:])).sum()  # 90 of 120 in both
    assert abs(same / (500 * simhash.LEAST) - 0.75) < 0.05 and not len(simhash.least(x[:0]))


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab .,\n", k=rng.choice([0, 5, 700, 3000]))) for _ in range(40)]
    rows = [(i, (t if rng.random() < 0.5 else t.replace(" ", "  "))) for i, t in enumerate(texts * 3)]
    extra = {"chunk_id": (lambda c: F.pmod(F.xxhash64(c), F.lit(3)))} if weak else {}
    got = {r.doc_id: r for r in exact_dedup.find_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **extra).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(t.split())].append((-len(t), i))
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(members), i == keep)
            assert got[i].text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_agenda_equals_the_library():
    with open(model(), "rb") as f:
        codec = Codec(f.read())
    rng = random.Random(9)
    bits = ["a", "e", " ", "▁", "th", "\n", "é", "日", "🙂", "1", "<s>", "  ", "in", "\x00", "\r", "tion", "ﬁ"]
    texts = ["", " ", "▁", "<unk>", "x" * 3000, " " * 50 + "a" + " " * 17, "�"] + ["".join(rng.choices(bits, k=rng.randint(1, 80))) for _ in range(2000)]
    ids, wrong = codec.encode(texts)
    assert not wrong and ids == codec.library.encode(texts)
    assert [codec.decode(i) for i in ids] == codec.library.decode(ids)
    odd = [[rng.randrange(0, 400) for _ in range(15)] for _ in range(500)]
    assert [codec.decode(i) for i in odd] == [codec.library.decode(i) for i in odd]


def test_differences_are_remembered():
    with open(model(), "rb") as f:
        codec = Codec(f.read())
    codec.merge = lambda unit, merge=codec.merge: (0,) if unit == "▁nation" else merge(unit)
    assert [codec.encode(t)[1] for t in (["a nation"], ["a nation again"], ["a"])] == [1, 1, 0]


def test_risk_falls_along_its_gradient(monkeypatch):
    """The fit's risk, written out plainly, is lower than where it starts and flat where it ends."""
    rng = np.random.default_rng(5)
    pos, web = rng.normal(0, 1, (300, 4)), np.concatenate([rng.normal(0, 1, (300, 4)), rng.normal(1.2, 1, (300, 4))])

    def risk(m):
        f = lambda x: np.tanh(np.clip((x - m["mean"]) / m["std"], -8, 8) @ m["params"][0] + m["params"][1]) @ m["params"][2] + m["params"][3]
        negative = np.log1p(np.exp(f(web))).mean() - m["prior"] * np.log1p(np.exp(f(pos))).mean()
        return m["prior"] * np.log1p(np.exp(-f(pos))).mean() + max(0.0, negative)

    values = []
    for epochs in (0, 50, 400):
        monkeypatch.setattr(quality_classifier, "EPOCHS", epochs)
        values.append(risk(quality_classifier.fit(pos, web, 0.5)))
    assert values[0] > values[1] >= values[2] - 1e-3
    model = quality_classifier.fit(pos, web, 0.5)
    good, bad = quality_classifier.apply(model, rng.normal(0, 1, (500, 4))), quality_classifier.apply(model, rng.normal(1.2, 1, (500, 4)))
    assert np.mean(good[:, None] > bad[None, :]) > 0.85  # noisy classes that overlap


def test_tokens_of_a_table(spark, corpus):
    import sentencepiece

    truth = sentencepiece.SentencePieceProcessor(model_file=model())
    for r in tokenize(corpus[1], model()).collect():
        assert r.ids == truth.encode(corpus[0][r.doc_id]) and r.decoded == truth.decode(r.ids) and r.checked


def test_every_text_is_held_against_the_library(spark, tmp_path):
    """A model that composes characters splits a text otherwise than its units, which only the whole text shows."""
    import sentencepiece

    rng = random.Random(1)
    words = ["".join(rng.choices("aeiostnr", k=rng.randint(2, 6))) for _ in range(300)]
    lines = [" ".join(rng.choices(words, k=12)) for _ in range(400)] + ["\u00e9a \u00e9 e\u00e9"] * 50
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(lines), model_prefix=str(tmp_path / "nfkc"), model_type="bpe", vocab_size=420, byte_fallback=True, normalization_rule_name="nfkc",
        remove_extra_whitespaces=False, minloglevel=2,
    )
    path = str(tmp_path / "nfkc.model")
    truth = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["e\u0301", lines[0] * 3, "a e\u0301 b", lines[1]]
    rows = {r.doc_id: r for r in tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path).collect()}
    assert [rows[i].ids for i in range(4)] == truth.encode(texts)
    with open(path, "rb") as f:
        own, wrong = Codec(f.read()).encode(texts)
    assert not wrong and [rows[i].checked for i in range(4)] == [a == b for a, b in zip(own, truth.encode(texts))] == [False, True, False, True]


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(["sun", "moon", "river", "stone", "light"]) + rng.choice(["", "s", "ing"]) for _ in range(60)]
        good = rng.random() < 0.8
        text = ". ".join(" ".join(words[k : k + 8]) for k in range(0, 60, 8)) + "." if good else rng.choice([" | ".join(words), "!! ".join(words).upper(), " ".join(words[:2] * 30)])
        rows.append((i, text))
        labels.append((i, int(good)))
    got = quality_classifier.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [(r.predicted, labels[r.doc_id][1]) for r in got if r.held_out]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_corpus_statistics_cover_all_rows(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["sun", "Moon", "river.", "9", "a | b"]) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1500)], "doc_id long, quality int")
    models, counted = [], []
    fit, least = quality_classifier.fit, quality_classifier.least_ratio
    monkeypatch.setattr(quality_classifier, "SAMPLE", 100)
    monkeypatch.setattr(quality_classifier, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    monkeypatch.setattr(quality_classifier, "least_ratio", lambda p, u: counted.append((p.sum(), u.sum())) or least(p, u))
    held = {r.doc_id for r in quality_classifier.score(docs, labels).collect() if r.held_out}
    x = {i: quality_classifier.features(t) for i, t in enumerate(texts) if i not in held}
    both = np.array([*x.values(), *(v for i, v in x.items() if i % 2)])
    assert np.allclose(models[0]["mean"], both.mean(0), atol=1e-5) and np.allclose(models[0]["std"], both.std(0), atol=1e-3)
    assert np.sum(counted, 0).tolist() == [sum(i % 2 for i in x), len(x)]


def test_prior():
    rng = np.random.default_rng(11)
    pos = rng.normal(0, 1, (4000, 3))
    web = np.concatenate([rng.normal(0, 1, (2800, 3)), rng.normal(4, 1, (1200, 3))])
    assert abs(quality_classifier.estimate_prior(pos, rng.permutation(web)) - 0.7) < 0.06
