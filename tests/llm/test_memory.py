"""What is held at a time, and what is sent."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from rimeframe.llm import sentencepiece_codec, simhash
from rimeframe.llm._store import Store
from rimeframe.llm.sentencepiece_codec import tokenize


def test_a_run_of_text_takes_little_memory():
    """Words that come again and again: beside the table of units only lists and strings of one run of text are held."""
    words = [f"word{i}" for i in range(500)]
    texts = [" ".join(random.Random(i).choices(words, k=250)) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    frame = SimpleNamespace(select=lambda *columns: SimpleNamespace(mapInArrow=lambda run, schema: run))
    run = tokenize(frame, public_tokenizers.path("piece_bpe_32k.model"))
    rows = sum(out.num_rows for out in run(iter([batch.slice(0, 10)])))
    tracemalloc.start()
    try:
        rows += sum(out.num_rows for out in run(iter([batch.slice(10)])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts) and sum(map(len, texts)) > 3e6 and peak < 30e6


def test_the_pipeline_encodes_in_small_batches(spark, monkeypatch):
    """A partition of 3000 rows does not come to Python in one batch."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[batch.num_rows]] * batch.num_rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    monkeypatch.setattr(corpus_pipeline.sentencepiece_codec, "tokenize", lambda docs, path: docs.select("doc_id").mapInArrow(sizes, "doc_id long, ids array<int>"))
    rows = corpus_pipeline.encode(spark, spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "'a b' AS text"), "").collect()
    assert len(rows) == 3000 and max(r.ids[0] for r in rows) <= 1000


def shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_sketches_stay_where_they_are(spark, monkeypatch):
    """Nodes get their classes without moving, with their prefixes, to those that are in a group."""
    seen = []

    def met(call):
        return lambda *args: seen.append(next(x for x in args if hasattr(x, "columns"))) or call(*args)

    monkeypatch.setattr(simhash, "links", met(simhash.links))
    monkeypatch.setattr(simhash, "meetings", met(simhash.meetings))
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(5000)], k=80)) for _ in range(40)]
    texts += [f"{t} end" for t in texts[:5]]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        roots = {r.doc_id: r.root for r in simhash.near_groups(docs, Store(spark, "near")).collect()}
        plans = [x._jdf.queryExecution().sparkPlan().toString() for x in seen]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert roots == {i: i % 40 for i in range(45)}
    assert len(plans) == len(simhash.LEVELS) + 1 and not any("SortMergeJoin" in x or "ShuffledHashJoin" in x for x in plans)


def test_near_copies_shuffle_no_text(spark):
    """Few words, but long ones: two of 300 texts are alike, and no text is dealt out to find the two, however many ids there are."""
    rng = random.Random(2)
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200)) for _ in range(60)] for _ in range(299)]
    texts = [" ".join(w) for w in [*words, [*words[0][:-1], "changed"]]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        roots = {r.doc_id: r.root for r in simhash.near_groups(docs, Store(spark, "near")).collect()}
        sent = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert roots == {i: i for i in range(299)} | {299: 0}
    assert 0 < sent < sum(map(len, texts)) / 2


def test_the_library_reads_a_text_once(monkeypatch):
    """Units are merged by the agenda alone, many at a time as well as one by one; the library gets the whole texts."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    read, real = [], codec.library
    codec.library = SimpleNamespace(encode=lambda texts, **options: read.extend(texts) or real.encode(texts, **options))
    monkeypatch.setattr(sentencepiece_codec, "codec", lambda model: codec)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("aeiou日▁é\ntnsr🙂<1", k=rng.randint(1, 30))) for _ in range(50)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    frame = SimpleNamespace(select=lambda *columns: SimpleNamespace(mapInArrow=lambda run, schema: run))
    rows = [r for out in tokenize(frame, public_tokenizers.path("piece_bpe_32k.model"))(iter([batch])) for r in out.to_pylist()]
    assert read == texts and [r["ids"] for r in rows] == real.encode(texts) and all(r["checked"] for r in rows)
    units = list(set().union(*map(codec.split, texts)))
    assert len(units) > sentencepiece_codec.MANY
    assert codec.merge_all(units) == [np.array(codec.merge(u), np.int32).tobytes() for u in units]
