"""Quality rules, line first.

Every line is judged by itself: navigation (menu bars), symbols, shouting, capitals, stuttering, boilerplate phrases,
fragments without closing punctuation, and lines equal to an earlier line of the text.  Failing lines are removed; then a
document that lost more than half of its words is rejected.  Documents of under 10 words, or with over a fifth of their
words in repeated 5-word windows, are rejected whatever their lines.

Edge cases: a null text has no words, so it is rejected and its cleaned text is empty; repeated rows give repeated rows;
any doc_id, null included, is passed through; other columns are not read; an empty table gives no rows.  Texts of any
length are one value of one row, in Arrow slices of about 2 MB.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import slices

#: A line of at most PHRASE_WORDS words with one of these fails.
PHRASES = (
    "accept all cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "follow us on", "forgot your password",
    "lorem ipsum", "privacy policy", "read more", "sign in", "sign up", "skip to content", "subscribe to our", "terms of service", "terms of use", "use of cookies",
)
PHRASE_WORDS = 20
MIN_WORDS = 10
WINDOW = 5
MAX_REPEATED = 20  # percent of words
MAX_LOST = 50  # percent of words
CLOSING = ".!?:;…\"'”’»)]"

_WS = " \t\n\x0b\x0c\r"
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)))
_UPPER = re.compile("[A-Z]")
_LOWER = re.compile("[a-z]")
_LOWERED = {c: c + 32 for c in range(65, 91)}


def line_fails(line: str, words: list[str]) -> bool:
    """Whether a line with at least one word fails by itself."""
    n = len(words)
    pipes = line.count("|")
    if pipes >= 2 and 5 * pipes >= n:
        return True
    symbols = sum(map(line.count, "#*$%&<>"))
    if symbols >= 3 and 3 * symbols >= n:
        return True
    bangs = line.count("!!")
    if bangs >= 3 and 3 * bangs >= n:
        return True
    if n < 3 and line.rstrip(_WS)[-1] not in CLOSING:
        return True
    if n >= 5:
        same = sum(map(str.__eq__, words, words[1:]))
        if same >= 4 and 3 * same >= n:
            return True
        upper = len(_UPPER.findall(line))
        if upper >= 10 and 10 * upper > 7 * (upper + len(_LOWER.findall(line))):
            return True
    return n <= PHRASE_WORDS and bool(_PHRASE.search(line.translate(_LOWERED)))


_SPLIT = re.compile(f"[^{_WS}]+")


def repeated_words(words: list) -> int:
    """Words in windows of WINDOW words that stand twice or more in the text."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + WINDOW - max(i, end)
            end = i + WINDOW
    return total


def judge(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, n_lost_words, base_failed, kept, cleaned."""
    text = text or ""
    n_words = word_chars = dup = bad = lost = 0
    all_words: list[str] = []
    seen: set[str] = set()
    good = []
    for line in text.split("\n"):
        words = _SPLIT.findall(line)
        if not words:
            good.append(line)
            continue
        all_words += words
        n_words += len(words)
        again = line in seen
        seen.add(line)
        dup += again
        if again or line_fails(line, words):
            bad += 1
            lost += len(words)
        else:
            good.append(line)
    word_chars = len(text) - sum(map(text.count, _WS))
    symbols = sum(map(text.count, "#*$%&|<>"))
    repeated = repeated_words(all_words)
    failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEATED * n_words
    kept = not failed and 100 * lost <= MAX_LOST * n_words
    return n_words, word_chars, symbols, dup, repeated, bad, lost, failed, kept, "\n".join(good)


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "n_lost_words")


def clean(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts of ``judge``, ``base_failed, kept`` and ``cleaned`` (the text without failing lines)."""

    def run(batches):
        for part in slices(batches):
            columns = list(zip(*map(judge, part.column("text").to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.bool_()), pa.array(columns[8], pa.bool_()), pa.array(columns[9], pa.string())],
                names=["doc_id", *_LONGS, "base_failed", "kept", "cleaned"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + "".join(f"{x} long, " for x in _LONGS) + "base_failed boolean, kept boolean, cleaned string")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without rejected documents, their texts without failing lines; the columns as they were.

    The rules run inside one pass over the rows, so no join brings verdict and document together.  A column n_chars is
    set to the length of the cleaned text.  Rows without doc_id are judged like any other.
    """
    names = docs.columns
    kind = docs.schema

    def run(batches):
        for part in slices(batches):
            judged = [judge(t) for t in part.column("text").to_pylist()]
            keep = [i for i, j in enumerate(judged) if j[8]]
            if not keep:
                continue
            rows = part.take(pa.array(keep, pa.int64()))
            texts = [judged[i][9] for i in keep]
            columns = [
                pa.array(texts, pa.string()) if n == "text" else pa.array([len(t) for t in texts], pa.int64()).cast(rows.schema.field(n).type) if n == "n_chars" else rows.column(i)
                for i, n in enumerate(names)
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, kind)


def op5_line_quality(spark, sf_dir: str) -> DataFrame:
    return clean(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *_LONGS, "base_failed", "kept")


_W = r"[\x20\x09-\x0D]"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pieces AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS ix FROM d),
lined AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM pieces),
lines AS (SELECT *, len(w) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY ix) > 1 AS again FROM lined WHERE len(w) > 0),
measured AS (
  SELECT *, len(line) - len(replace(line, '|', '')) AS pipes, len(regexp_extract_all(line, '[#*$%&<>]')) AS symbols,
    len(regexp_extract_all(line, '!!')) AS bangs, len(regexp_extract_all(line, '[A-Z]')) AS upper_n, len(regexp_extract_all(line, '[a-z]')) AS lower_n,
    len(list_filter(range(1, n), lambda i: w[i] = w[i + 1])) AS same, right(regexp_replace(line, '{_W}+$', ''), 1) AS last
  FROM lines),
judged AS (
  SELECT *, again OR (pipes >= 2 AND 5 * pipes >= n) OR (symbols >= 3 AND 3 * symbols >= n) OR (bangs >= 3 AND 3 * bangs >= n)
    OR (n < 3 AND NOT contains('{CLOSING.replace("'", "''")}', last)) OR (n >= 5 AND same >= 4 AND 3 * same >= n)
    OR (n >= 5 AND upper_n >= 10 AND 10 * upper_n > 7 * (upper_n + lower_n))
    OR (n <= {PHRASE_WORDS} AND regexp_matches(line, '(?i){"|".join(PHRASES)}')) AS bad
  FROM measured),
by_lines AS (
  SELECT doc_id, sum(n) AS n_words, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(n) FILTER (bad), 0) AS n_lost_words
  FROM judged GROUP BY doc_id),
texts AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
windows AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS k FROM texts WHERE len(w) >= {WINDOW}),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id),
joined AS (
  SELECT texts.doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '{_W}+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_bad_lines, 0)::BIGINT AS n_bad_lines, coalesce(n_lost_words, 0)::BIGINT AS n_lost_words
  FROM texts LEFT JOIN by_lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * n_lost_words <= {MAX_LOST} * n_words AS kept
FROM joined
"""
