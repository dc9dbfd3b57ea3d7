"""Keypoint matching in blocks against the plain product of both images."""

import math

import numpy as np

from rimeframe.operators import matching as M


def brute(left, right):
    """For each left keypoint its distances to all right ones, in order; missing numbers don't count."""

    def far(x, y):
        both = [(a - b) ** 2 for a, b in zip(x or [], y or []) if a is not None and b is not None]
        total = 0.0
        for b in both:
            total += b
        return math.sqrt(total) if both else None

    return {k: sorted(((far(x, y), j) for j, y in right), key=lambda p: (p[0] is None, p[0] or 0.0, p[1])) for k, x in left}


def tables(spark, sizes, odd=False):
    rng = np.random.default_rng(3)
    rows = []
    for img, n in enumerate(sizes):
        few = rng.integers(0, 3, (n, 8)).astype(float).tolist()  # many equal distances, and copies
        rows += [(img, 1000 * img + k, v) for k, v in enumerate(few)]
    if odd:
        rows[3], rows[60] = (0, 3, None), (*rows[60][:2], rows[60][2][:5])
        rows[61] = (*rows[61][:2], [None, *rows[61][2][1:]])
        rows[5] = (0, 5, [])
    k = spark.createDataFrame(rows, "img int, kp long, descriptor array<float>")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(len(sizes) - 1)], "img_i int, img_j int")
    return rows, k, pairs


def check(spark, sizes, odd=False):
    rows, k, pairs = tables(spark, sizes, odd)
    images = [[(r[1], r[2]) for r in rows if r[0] == i] for i in range(len(sizes))]
    want, mutual = {}, set()
    for i in range(len(sizes) - 1):
        there, back = brute(images[i], images[i + 1]), brute(images[i + 1], images[i])
        want |= {kp: (b[0][1], b[0][0], b[1][0] if len(b) > 1 else None) for kp, b in there.items()}
        mutual |= {(kp, b[0][1]) for kp, b in there.items() if back[b[0][1]][0][1] == kp}
    got = {r["kp_i"]: (r["kp_j"], r["d1"], r["d2"]) for r in M.match_keypoints(k, pairs).collect()}
    assert got == want
    both = M.match_keypoints(k, pairs, mutual=True).collect()
    assert len(both) == len(mutual) and {(r["kp_i"], r["kp_j"]) for r in both} == mutual


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 20)
    monkeypatch.setattr(M, "ROWS", 7)
    check(spark, [50, 70, 1])


def test_missing_numbers(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 20)
    check(spark, [50, 70], odd=True)


def test_no_row_for_each_pair_of_keypoints(spark):
    """No operator of the plan, but the one that compares two blocks, makes a row of two keypoints."""
    _, k, pairs = tables(spark, [50, 70])
    plan = M.match_keypoints(k, pairs, mutual=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "zip_with" not in plan
