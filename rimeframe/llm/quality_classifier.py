"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled 1; everything else is web text whose label is not looked at.  A small network minimises the
non-negative unbiased risk ``pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])`` with the logistic loss; where the second
term falls below zero, the step goes against it instead.  The class prior pi is estimated first: a logistic regression
tells positives from web text on one half of the rows, and on the other half the least ratio of both shares above a
threshold is an upper bound of pi that is reached where there are no negatives; the halves then change places.

Scores depend on the text alone: on counts of words, lines, repeats, symbols, capitals and punctuation.  Only rows whose
crc32(doc_id) mod 3 is not 1 are learnt from.  Of these, means, deviations and the shares behind the prior cover all rows;
gradients use at most about SAMPLE positives and SAMPLE web texts, drawn by the hash of the doc_id.  Scoring covers every row.

Edge cases: a null text scores like the empty one; without positives or web text to learn from every score is the prior
0.5; rows repeated with one doc_id get equal scores; a row without doc_id is scored, not learnt from and not held out; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import slices
from ._store import Store

SAMPLE = 20_000
HIDDEN, EPOCHS, RATE, SEED = 16, 400, 0.02, 11

_WS = " \t\n\x0b\x0c\r"
_WORD = re.compile(f"[^{_WS}]+")
_UPPER, _LOWER, _DIGIT = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[a-zß-öø-ÿ]"), re.compile("[0-9]")
N_FEATURES = 20
#: Moments are added up in steps of 1 / UNIT, so that they don't depend on the order; scores are counted in so many bins.
UNIT, BINS = 1 << 20, 4096


def features(text: str | None) -> list[float]:
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    lines = [s for x in text.split("\n") if (s := x.strip(_WS))]
    chars = sum(map(len, words))
    upper, lower = len(_UPPER.findall(text)), len(_LOWER.findall(text))
    same = sum(map(str.__eq__, words, words[1:]))
    distinct = len(set(words))
    triples = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 1
    count = text.count
    return [
        1.0,
        np.log(n),
        np.log(len(lines)),
        chars / n,
        max(map(len, words)) ** 0.5,
        distinct / n,
        triples / max(n - 2, 1),
        same / n,
        1 - len(set(lines)) / len(lines),
        sum(x[-1] in ".!?…\"'”»" for x in lines) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines),
        min(1.0, count("|") / n),
        min(3.0, sum(map(count, "#*$%&<>")) / n),
        min(2.0, count("!") / n),
        min(1.0, count(".") / n),
        min(1.0, count(",") / n),
        min(1.0, count("?") / n),
        upper / max(1, upper + lower),
        len(_DIGIT.findall(text)) / chars,
        min(1.0, (count("http") + count("@") + count("{") + count("=")) / n),
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` (array of N_FEATURES doubles) for every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for part in slices(batches):
            x = [features(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _standard(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate([x, y])
    return both.mean(0), both.std(0) + 1e-6


def _scaled(x: np.ndarray, standard: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip((x - standard[0]) / standard[1], -8, 8)


def direction(pos: np.ndarray, web: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a logistic regression that tells scaled positives from scaled web text."""
    w, b = np.zeros(pos.shape[1]), 0.0
    for _ in range(steps):
        gp, gu = _sigmoid(pos @ w + b) - 1, _sigmoid(web @ w + b)
        w -= 0.3 * (pos.T @ gp / len(pos) + web.T @ gu / len(web) + 1e-3 * w)
        b -= 0.3 * (gp.mean() + gu.mean())
    return w


def bins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """How many scaled rows score in each of BINS equal parts of all possible scores."""
    most = 8 * np.abs(w).sum() + 1e-9
    at = np.clip(((x @ w + most) * (BINS / (2 * most))).astype(np.int64), 0, BINS - 1)
    return np.bincount(at, minlength=BINS)


def least_ratio(pos: np.ndarray, web: np.ndarray) -> float | None:
    """The least ratio of the shares of ``web`` and ``pos`` (counts by bin) from a bin on, at quantiles of ``pos``."""
    if min(pos.sum(), web.sum()) < 2:
        return None
    below = np.cumsum(pos) / pos.sum()
    levels = np.searchsorted(below, np.linspace(0.0, 0.7, 71), "right")
    share_p, share_u = (np.cumsum(c[::-1])[::-1][levels] / c.sum() for c in (pos, web))
    return float((share_u / np.maximum(share_p, 1e-9)).min())


def _prior(ratios: list[float | None]) -> float:
    known = [r for r in ratios if r is not None]
    return float(np.clip(np.mean(known), 0.02, 0.98)) if known else 0.5


def estimate_prior(pos: np.ndarray, web: np.ndarray, steps: int = 300) -> float:
    """The share of positives in ``web``."""
    standard = _standard(pos, web)
    pos, web = _scaled(pos, standard), _scaled(web, standard)
    if min(len(pos), len(web)) < 4:
        return 0.5
    ways = [direction(pos[k::2], web[k::2], steps) for k in range(2)]
    return _prior([least_ratio(bins(pos[1 - k :: 2], w), bins(web[1 - k :: 2], w)) for k, w in enumerate(ways)])


def fit(pos: np.ndarray, web: np.ndarray, prior: float | None = None, standard: tuple[np.ndarray, np.ndarray] | None = None) -> dict:
    """The network that minimises the non-negative risk (full batches, Adam)."""
    prior = estimate_prior(pos, web) if prior is None else prior
    mean, std = _standard(pos, web) if standard is None else standard
    pos, web = _scaled(pos, (mean, std)), _scaled(web, (mean, std))
    rng = np.random.default_rng(SEED)
    d = pos.shape[1]
    params = [rng.normal(0, 0.3, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    def grads(x: np.ndarray, slope) -> list[np.ndarray]:
        """Gradients of the mean of a loss whose derivative by the score is ``slope``."""
        h = np.tanh(x @ params[0] + params[1])
        s = slope(h @ params[2] + params[3]) / len(x)
        back = s[:, None] * params[2] * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ s, np.array([s.sum()])]

    def risk_negative() -> float:
        gu = np.tanh(web @ params[0] + params[1]) @ params[2] + params[3]
        gp = np.tanh(pos @ params[0] + params[1]) @ params[2] + params[3]
        return float(np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())

    for step in range(1, EPOCHS + 1):
        as_pos = grads(pos, lambda z: _sigmoid(z) - 1)
        as_neg = grads(pos, _sigmoid)
        web_neg = grads(web, _sigmoid)
        negative = [u - prior * p for u, p in zip(web_neg, as_neg)]
        total = [prior * p + n for p, n in zip(as_pos, negative)] if risk_negative() >= 0 else [-n for n in negative]
        for i, g in enumerate(total):
            g = g + 1e-4 * params[i]
            m, v = moments[i]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            params[i] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"mean": mean, "std": std, "params": params, "prior": prior}


def apply(model: dict, x: np.ndarray) -> np.ndarray:
    x = _scaled(x, (model["mean"], model["std"]))
    a, b, c, d = model["params"]
    return _sigmoid(np.tanh(x @ a + b) @ c + d)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def _added(rows: DataFrame, count, size: int) -> np.ndarray:
    """The sum over all batches of ``rows`` of an array of ``size`` whole numbers."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                c = count(batch)
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], names=["i", "c"])

    out = np.zeros(size, np.int64)
    for r in rows.mapInArrow(run, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).collect():
        out[r["i"]] = r["c"]
    return out


def moments(rows: DataFrame) -> np.ndarray:
    """The number of ``rows``, and the sums of their features and of the squares, in steps of 1 / UNIT."""

    def count(batch):
        x = _rows(batch)
        return np.concatenate([[len(x)], np.rint(x * UNIT).astype(np.int64).sum(0), np.rint(x * x * UNIT).astype(np.int64).sum(0)])

    return _added(rows.select("x"), count, 1 + 2 * N_FEATURES)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; ``labels`` has doc_id and quality."""
    store = Store(docs.sparkSession, "quality")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    known = store.keep(with_features(docs), "features")
    learn = known.where(rest != 1).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(2)))
    trusted = labels.where("quality = 1").select("doc_id").distinct()
    groups = (store.keep(learn.join(trusted, "doc_id", "left_semi"), "trusted"), learn)
    sums = [moments(rows) for rows in groups]

    def sampled(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > SAMPLE:
            rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
        got = np.array([[*r["x"], r["half"]] for r in rows.collect()], float).reshape(-1, N_FEATURES + 1)
        got = rng.permutation(got[np.lexsort(got.T)] if len(got) else got)
        return got[:, :-1], got[:, -1]

    rng = np.random.default_rng(SEED)
    (pos, pos_half), (web, web_half) = (sampled(rows, int(c[0])) for rows, c in zip(groups, sums))
    model = None
    if len(pos) > 1 and len(web) > 1:
        n, first, second = (x.astype(float) for x in np.split(sums[0] + sums[1], [1, 1 + N_FEATURES]))
        mean = first / UNIT / n
        standard = mean, np.sqrt(np.maximum(second / UNIT / n - mean * mean, 0)) + 1e-6
        p, u = _scaled(pos, standard), _scaled(web, standard)
        # ways[k] comes from half 1 - k, and half k is counted by it
        ways = [direction(p[pos_half != k], u[web_half != k]) if (pos_half != k).any() and (web_half != k).any() else None for k in range(2)]

        def count(batch):
            x, half = _scaled(_rows(batch), standard), batch.column("half").to_numpy()
            return np.concatenate([np.zeros(BINS, np.int64) if w is None else bins(x[half == k], w) for k, w in enumerate(ways)])

        counts = [_added(rows.select("x", "half"), count, 2 * BINS).reshape(2, BINS) for rows in groups]
        model = fit(pos, web, _prior([least_ratio(counts[0][k], counts[1][k]) for k in range(2)]), standard)

    def run(batches):
        for batch in batches:
            x = _rows(batch)
            p = apply(model, x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    scored = known.mapInArrow(run, "doc_id long, score double")
    return store.done(scored.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
