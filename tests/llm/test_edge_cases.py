"""Nulls, empty and long texts, repeats, empty tables and clashing columns, for every operator and stage."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rimeframe.llm import exact_dedup, license_scan, line_quality, mixing, quality_classifier, queries, sharding, simhash, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"w{i}" for i in range(70))
LONG = " ".join(f"v{i % 997}" for i in range(30_000))
ROWS = [
    (0, None, "en", "a", 0), (1, "", None, None, None), (2, " \t\n", "en", "a", 3), (3, "one two", "en", "b", 7), (4, PASSAGE, "en", "a", 1), (5, PASSAGE, "en", "b", 1),
    (6, "Start here. " + PASSAGE + " and go on.", "en", "c", 1), (7, LONG, "en", "a", 1), (8, "x" * 100_000, "en", "c", 1), (None, "no number at all", "en", "a", 1),
    (9, "Héllo wörld 日本語 🙂 ▁ <s> \x00 end.", "fr", None, 1), (10, "twice told tale", "en", "a", 1), (10, "twice told tale", "en", "a", 1), (11, "Released under the MIT License.", "en", "a", 1),
    (12, "a b c d", "en", "b", 1),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    extras = ["kept", "size", "shard", "h1", "fp", "row", "tokens", "anchor", "whole", "recipe", "mixed_doc", "id", "class", "x", "score", "TEXT2"]
    wide = docs.withColumns({c: F.lit("clash") for c in extras})
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (7, 0, 1), (6, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {}
    for name, df in (("plain", docs), ("wide", wide), ("empty", docs.limit(0))):
        df.write.parquet(f"{root}/{name}/documents.parquet")
        (labels if name != "empty" else labels.limit(0)).write.parquet(f"{root}/{name}/labels.parquet")
        out[name] = f"{root}/{name}"
    return out


OPS = sorted(queries.queries())


@pytest.mark.parametrize("name", OPS)
def test_edge_rows(spark, tables, name):
    got = queries.queries()[name](spark, tables["plain"]).collect()
    assert len(got) == len(ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", OPS)
def test_clashing_columns_change_nothing(spark, tables, name):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = (sorted(queries.queries()[name](spark, tables[t]).collect(), key=key) for t in ("plain", "wide"))
    assert a == b


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, tables, name):
    df = queries.queries()[name](spark, tables["empty"])
    assert df.count() == 0 and "doc_id" in df.columns


@pytest.mark.parametrize("table", ["plain", "wide", "empty"])
def test_pipeline_stages(spark, tables, table):
    docs = spark.read.parquet(f"{tables[table]}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, tables[table])
        rows = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns, name
            docs = spark.createDataFrame(rows, before.schema)
    if table == "empty":
        assert not rows


def test_clean_rows_without_id_pass_the_pipeline(spark, tables):
    texts = ["The quick brown fox jumps over the lazy dog near the old river bank today.", "Seven tall ships sailed past the quiet harbour while the grey gulls cried above them."]
    rows = [(None, texts[0], "en", "a", 1), (None, "one two", "en", "a", 7), (None, texts[1], "en", "a", 1), (20, PASSAGE + ".", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, tables["plain"]).collect(), SCHEMA)
        assert sorted(r.text for r in docs.collect() if r.doc_id is None) == sorted(texts), name
    for name, stage in corpus_pipeline.STAGES[3:]:
        docs = stage(spark, docs, tables["plain"])
    docs.collect()


def test_pipeline_run(spark, tables):
    got = corpus_pipeline.run(spark, tables["plain"])
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    assert all(r.n_tokens == len(r.ids) for r in got.collect())


def test_whole_copies_lose_everything(spark, tables):
    for op, unit in ((substring_dedup.op1_substring_dedup, 70), (suffix_dedup.op8_suffix_dedup, len(PASSAGE))):
        rows = {r.doc_id: r for r in op(spark, tables["plain"]).collect()}
        assert rows[4].n_removed == 0 and rows[5].n_removed == unit and rows[5].kept_sha256 == hashlib.sha256(b"").hexdigest()
        assert rows[6].n_removed >= unit and rows[10].n_removed == 0 and rows[None].n_removed == 0


def test_repeats_of_rows_that_share_an_id(spark, tmp_path):
    """Each text is judged by itself: a copy under an id takes nothing from the id's other text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, f"{b} {a}"), (5, c), (7, f"{c} end"), (-(1 << 63), c), (None, a)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.op1_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(3, 60, 0), (5, 60, 60), (5, 120, 60), (5, 60, 60), (7, 61, 60), (-(1 << 63), 60, 0), (None, 60, 0)], key=str)


def test_exact_groups(spark, tables):
    rows = {r.doc_id: r for r in exact_dedup.find_copies(spark.read.parquet(f"{tables['plain']}/documents.parquet")).collect()}
    assert rows[2].kept and rows[2].group_size == 3 and rows[0].keep_id == 2  # white space only: the longest stays
    assert rows[10].group_size == 2 and rows[5].keep_id == 4


def test_exact_dedup_of_odd_ids(spark):
    least = -(1 << 63)
    rows = [(least, "same text"), (5, "same  text"), (None, "same    text"), (7, "x"), (None, "y"), (least, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.find_copies(docs).collect()]
    want = [(least, 5, 3, False), (5, 5, 3, True), (None, 5, 3, False), (7, 7, 1, True), (None, None, 1, True), (least, least, 1, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(r.text for r in exact_dedup.drop_copies(docs.where("doc_id <> 5 OR doc_id IS NULL")).collect()) == ["same    text", "same text", "x", "y", "z"]


@pytest.mark.parametrize("op", ["op9_exact_dedup", "op3_mixing"])
def test_texts_stay_where_they_are(spark, tmp_path, op):
    """What is written to shuffles does not hold the texts, even where Spark may not broadcast."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(map(str, rng.integers(0, 1 << 60, 300).tolist()))) for i in range(300)]
    docs = spark.createDataFrame(rows + [(i + 300, t + " ") for i, t in rows], "doc_id long, text string").withColumns({"source": F.lit("a"), "lang": F.lit("en"), "n_chars": F.length("text")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before, old = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queries.queries()[op](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert 0 < shuffled(spark) - before < 0.5 * sum(len(t) for _, t in rows)


def test_substring_dedup_deals_texts_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(map(str, rng.integers(1 << 59, 1 << 60, n).tolist()))
    shared = text(60)
    rows = [(i, f"{text(400)} {shared} {text(400)}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before, old = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = substring_dedup.op1_substring_dedup(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sum(r.n_removed for r in got) == 60 * 199
    assert 0 < shuffled(spark) - before < 1.5 * sum(len(t) for _, t in rows)


def shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_quality_of_nothing(spark, tables):
    rows = {r.doc_id: r for r in line_quality.op5_line_quality(spark, tables["plain"]).collect()}
    assert rows[0].base_failed and rows[0].n_words == 0 and not rows[1].kept and rows[4].kept


def test_license_rows(spark, tables):
    rows = {r.doc_id: r for r in license_scan.op4_license_scan(spark, tables["plain"]).collect()}
    assert (rows[11].base_labels, rows[11].labels, rows[11].first_word, rows[11].score) == ("mit", "mit,mit-notice", 3, 1.0)
    assert rows[0].n_words == 0 and rows[0].first_word is None and rows[0].labels == ""


def test_licenses_are_told_apart(spark):
    gnu = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    want = {
        "Shared as CC BY-SA 4.0.": "cc-by,cc-by-sa-4.0", "Shared as CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "CC BY 4.0": "cc-by,cc-by-4.0", "It is released under the same license as before.": "",
        "It was released under the Apache license.": "apache", "Licensed under the Apache License, Version 2.0": "apache,apache-2.0", "Released under the MIT license.": "mit,mit-notice",
        gnu.format("program", ""): "gpl,gpl-notice", gnu.format("library", "Lesser "): "lgpl-notice", gnu.format("program", "Affero "): "agpl-notice",
        "This wor\u212a is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0", "This w or\u212a is licensed under a creative commons attribution ShareAli\u212ae 4.0": "",
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    assert {list(want)[r.doc_id]: r.labels for r in license_scan.scan(docs).collect()} == want


def test_empty_texts_share_a_fingerprint(spark, tables):
    rows = {r.doc_id: r for r in simhash.op7_simhash(spark, tables["plain"]).collect()}
    assert rows[0].fingerprint == "0" * 16 and rows[0].component_id == rows[1].component_id == rows[2].component_id == 0


def test_mix_takes_nothing_of_nothing(spark, tables):
    rows = {r.doc_id: r for r in mixing.op3_mixing(spark, tables["plain"]).collect()}
    assert rows[0].taken == 0 and all(r.taken <= 3 * r.size for r in rows.values())


def test_shards_hold_every_row(spark, tables):
    got = sharding.op2_sharding(spark, tables["plain"]).collect()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_scores_without_labels(spark, tables):
    docs = spark.read.parquet(f"{tables['plain']}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}


def test_nothing_to_learn_from():
    assert len(quality_classifier.features(None)) == quality_classifier.N_FEATURES == len(quality_classifier.features("a b."))
    assert np.isfinite(quality_classifier.features("x" * 10_000)).all()
