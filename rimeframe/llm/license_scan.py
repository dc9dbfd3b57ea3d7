"""License scans (DataFrame functions only).

Base labels come from phrases that stand in the text word for word.  The method is an exact set-similarity join between
text blocks (BLOCK words, a new one every STRIDE) and the templates, which are license notices and the sentences by which
texts refer to a license.  Tokens are pairs of neighbouring words, so their order counts: a block meets a template when it
contains at least THRESHOLD of the template's distinct pairs.  Notices that read alike form a family; of a family's
templates that a document meets, only those with the largest share give their label.

One pass over the texts finds the phrases, the template words of each document, and keeps the text of those documents
that hold enough words of some template.  Pairs are ordered from rare to frequent by the document frequency, over all
documents, of the rarer of their words.  In that order a block that meets the threshold must share a pair with the first
``|T| - need + 1`` pairs of the template (prefix filter); it must have ``need`` template pairs at all (length filter);
and from the places of the shared pair enough must be left on both sides (positional filter).  What passes is verified
by intersecting the sets.  Templates and their vocabulary are parameters of fixed size and are broadcast; nothing else is.

Edge cases: a null text is empty: no words, no places, no labels, score 0; places of base phrases are null where there is
none; rows repeated with one doc_id, or without one, are scanned one by one, since no join goes by doc_id; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ._store import Store

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Family, label and words of public license notices, and of short references to a license.
TEMPLATES = (
    ("apache", "apache-2.0", "licensed under the apache license version 2 0"),
    ("apache", "apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "bsd-notice", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc", "cc-by-4.0", "cc by 4 0"),
    ("cc", "cc-by-nc-4.0", "cc by nc 4 0"),
    ("cc", "cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    ("cc", "cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    ("cc", "cc-by-nd-4.0", "cc by nd 4 0"),
    ("cc", "cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc", "cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc", "cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc", "cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gnu", "agpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gnu", "gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gnu", "lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("gnu", "gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gnu", "gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "mit-notice", "licensed under the mit license"),
    ("mit", "mit-notice", "released under the mit license"),
    ("mit", "mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "mit-notice", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mpl", "mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unlicense-notice", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8
BLOCK, STRIDE = 200, 100

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # of a text whose A-Z are not lower-cased yet
_PHRASES = "(?i)(?<!W)(?:".replace("W", _WORD) + "|".join(p.replace(" ", f"{_GAP}+") for p in BASE) + f")(?!{_WORD})"


def _pieces(text: Column) -> Column:
    """What stands between the gaps: the words, with an empty piece where the text begins or ends with a gap."""
    return F.split(text, f"{_GAP}+", -1)


def _words(text: Column) -> Column:
    return F.array_remove(_pieces(text), "")


def _count(pieces: Column) -> Column:
    """The number of words among pieces."""
    outer = (F.element_at(pieces, 1) == "").cast("int") + (F.element_at(pieces, -1) == "").cast("int")
    return F.size(pieces) - F.least(outer, F.size(pieces))


def pairs_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def template_sets(templates) -> list[tuple[str, str, list[str], int]]:
    """(family, label, distinct pairs of words, how many of them a block needs) of every template."""
    out = []
    for family, label, sentence in templates:
        pairs = pairs_of(sentence.split())
        if not pairs or len(sentence.split()) > STRIDE + 1:
            raise ValueError(f"a template has 2 to {STRIDE + 1} words: {sentence[:40]}")
        out.append((family, label, pairs, math.ceil(THRESHOLD * len(pairs))))
    return out


def _lower(text: Column) -> Column:
    """A-Z lower-cased, as far as words of ASCII letters can tell: of all other letters only the Kelvin sign has one of them
    for its lower case, and becomes another letter beyond them instead."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e5")))


def _tokens(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row of ``docs``."""
    spark = docs.sparkSession
    sets = template_sets(templates)
    vocabulary = sorted({w for _, _, pairs, _ in sets for p in pairs for w in p.split()})
    store = Store(spark, "license-scan")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.regexp_extract_all(F.col("text"), F.lit(_PHRASES), F.lit(0))
    pieces = F.split("text", _PHRASES, -1)
    some = F.size("found") > 0
    def named(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, name in BASE.items():
            out = F.when(F.lower(x).startswith(phrase.split()[0]), name).otherwise(out)
        return out

    read = (
        docs.select("doc_id", text.alias("text"))
        .withColumn("pieces", _pieces(_lower(F.col("text"))))
        .select("doc_id", "text", _count(F.col("pieces")).cast("long").alias("n_words"), F.array_intersect("pieces", _tokens(vocabulary)).alias("tokens"))
        .withColumn("found", F.when(F.array_contains("tokens", "license") | F.array_contains("tokens", "cc") if {"license", "cc"} <= set(vocabulary) else F.lit(True), found).otherwise(F.array().cast("array<string>")))
    )
    likely = F.lit(False)
    for _, _, pairs, need in sets:
        words = sorted({w for p in pairs for w in p.split()})  # a missing pair lacks two words at most
        likely = likely | (F.size(F.array_intersect("tokens", _tokens(words))) >= len(words) - 2 * (len(pairs) - need))
    base = store.keep(
        read.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "tokens",
            F.size("found").cast("long").alias("n_base"),
            F.when(some, _count(_pieces(F.element_at(pieces, 1)))).cast("long").alias("first_word"),
            F.when(some, F.col("n_words") - _count(_pieces(F.element_at(pieces, -1))) - _count(_pieces(F.element_at("found", -1)))).cast("long").alias("last_word"),
            F.array_distinct(F.transform("found", named)).alias("base"),
            F.when(likely, F.col("text")).alias("text"),
        ),
        "base",
    )
    frequency = {r["t"]: r["n"] for r in base.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    order = sorted({p for _, _, pairs, _ in sets for p in pairs}, key=lambda p: (min(frequency.get(w, 0) for w in p.split()), p))
    place = {p: i for i, p in enumerate(order)}
    prefixes = []
    for k, (_, _, pairs, need) in enumerate(sets):
        ranked = sorted(pairs, key=place.__getitem__)
        prefixes += [Row(token=p, template=k, i=i, size=len(ranked), need=need) for i, p in enumerate(ranked[: len(ranked) - need + 1])]
    prefix = F.broadcast(spark.createDataFrame(prefixes, "token string, template int, i int, size int, need int"))
    words = F.col("words")
    blocks = (
        base.where("text IS NOT NULL")
        .select("row", _words(_lower(F.col("text"))).alias("words"))
        .select("row", F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)).alias("pairs"))
        .select("row", "pairs", F.explode(F.sequence(F.lit(1), F.greatest(F.size("pairs") + 1 - (BLOCK - STRIDE), F.lit(1)), F.lit(STRIDE))).alias("start"))
        # Intersecting with the ordered vocabulary first puts a block's pairs into the global order.
        .select("row", "start", F.array_intersect(_tokens(order), F.slice("pairs", F.col("start"), BLOCK - 1)).alias("tokens"))
    )
    least = min(need for *_, need in sets)
    candidates = (
        blocks.where(F.size("tokens") >= least)
        .select("row", "start", "tokens", F.posexplode("tokens").alias("j", "token"))
        .join(prefix, "token")
        .where((F.size("tokens") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("i") - 1, F.size("tokens") - F.col("j") - 1) >= F.col("need")))
        .select("row", "start", "template", "tokens")
        .dropDuplicates(["row", "start", "template"])
    )
    members = [Row(template=k, family=f, label=l, members=t, need=n) for k, (f, l, t, n) in enumerate(sets)]
    members = F.broadcast(spark.createDataFrame(members, "template int, family string, label string, members array<string>, need int"))
    verified = (
        candidates.join(members, "template")
        .withColumn("shared", F.size(F.array_intersect("tokens", "members")))
        .where("shared >= need")
        .groupBy("row", "family", "label")
        .agg(F.max(F.col("shared") / F.size("members")).alias("share"))
        .groupBy("row", "family")
        .agg(F.collect_list(F.struct("share", "label")).alias("labels"), F.max("share").alias("best"))
        .select("row", "best", F.transform(F.filter("labels", lambda x: x["share"] == F.col("best")), lambda x: x["label"]).alias("labels"))
        .groupBy("row")
        .agg(F.flatten(F.collect_list("labels")).alias("more"), F.max("best").alias("best"))
    )
    out = base.drop("text", "tokens").join(verified.withColumnRenamed("row", "match"), F.col("row") == F.col("match"), "left")
    none = F.array().cast("array<string>")
    return store.done(
        out.select(
            "doc_id", "n_words", "n_base", "first_word", "last_word",
            F.array_join(F.array_sort("base"), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
            F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        )
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    hits = " UNION ALL ".join(
        f"SELECT doc_id, i, '{name}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) - {len(p.split()) - 2})) AS i FROM t) WHERE w[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p, name in BASE.items()
    )
    rows = ", ".join(f"({i}, '{f}', '{l}', '{t}')" for i, (f, l, t) in enumerate(TEMPLATES))
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '{word}') AS w FROM documents),
hits AS ({hits}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY doc_id),
sentences(k, family, label, sentence) AS (VALUES {rows}),
templates AS (SELECT k, family, label, {pairs.format("v")} AS members FROM (SELECT *, string_split(sentence, ' ') AS v FROM sentences)),
blocks AS (SELECT doc_id, {pairs.format("v")} AS b FROM (SELECT doc_id, w[s:s + {BLOCK - 1}] AS v FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {BLOCK - STRIDE}, 1) + 1, {STRIDE})) AS s FROM t))),
shared AS (SELECT doc_id, family, label, len(list_intersect(b, members)) / len(members) AS share FROM blocks, templates WHERE len(list_intersect(b, members)) >= {THRESHOLD} * len(members)),
best AS (SELECT doc_id, max(share) AS score FROM shared GROUP BY doc_id),
every_label AS (SELECT doc_id, label FROM shared QUALIFY share = max(share) OVER (PARTITION BY doc_id, family) UNION SELECT doc_id, label FROM hits),
all_labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM every_label GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM t LEFT JOIN base USING (doc_id) LEFT JOIN all_labels USING (doc_id) LEFT JOIN best USING (doc_id)
"""


ORACLE = _oracle()
