import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnish.llm import negatives
from burnish.llm.negatives import Vectors, angles, directions, hard_negatives, score_bounds

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, modulus, positives=5, keep=3):
    """Every anchor against every row, in whole numbers."""
    own = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for a, label, v in own:
        if a % modulus:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, other, w in own if i != a)
        for s, i, _ in [t for t in scored if t[2] == label][:positives]:
            fits = [t for t in scored if t[2] != label and 50 * -s <= 100 * -t[0] <= 95 * -s]
            out += [(a, i, r + 1, t[1], -s, -t[0]) for r, t in enumerate(fits[:keep])]
    return sorted(out)


def found(rows_df, modulus):
    return sorted(map(tuple, hard_negatives(rows_df, F.col("vec_id") % modulus == 0).collect()))


def clustered(n, seed, scale=1.0, width=6):
    """Vectors around a few directions, so that angles tell something."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 1, (5, width))
    return [
        (i, [float(x) for x in scale * (centres[i % 5] + draw.normal(0, 0.15, width)) * draw.uniform(0.5, 2)], int(draw.integers(0, 3)))
        for i in range(n)
    ]


@pytest.mark.parametrize("scale", [0.02, 1.0, 3e3, 3e5, 1e6])
def test_against_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 5)
    monkeypatch.setattr(negatives, "WINDOW", 4)
    rows = clustered(220, 3, scale)
    rows[11] = (11, rows[12][1], rows[12][2])  # ties
    rows[13] = (13, rows[12][1], (rows[12][2] + 1) % 3)
    rows[30] = (30, None, 1)
    rows[31] = (31, [1.0, None], 1)
    rows[32] = (32, [1.0, float("nan")], 1)
    rows[33] = (33, [float("inf")], 1)
    rows[34] = (34, [0.5 * scale, -0.5 * scale], 1)
    rows[35] = (35, [], 1)
    rows[40] = (40, rows[40][1], None)
    rows[42] = (42, [0.0] * 6, 2)
    rows.append((None, [0.1] * 6, 1))
    vectors = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as V", "2 as `Label`", "3 as `a.b`")
    wanted = brute(rows, 7)
    assert wanted and found(vectors, 7) == wanted


def test_a_label_with_a_third_of_all_rows_and_repeated_vectors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 30)
    monkeypatch.setattr(negatives, "WINDOW", 8)
    rows = [(i, v, 0 if i % 3 == 0 else i) for i, v, _ in clustered(160, 5)]
    rows += [(200 + i, rows[0][1], 0 if i % 2 else 1) for i in range(60)]
    assert found(spark.createDataFrame(rows, SCHEMA), 10) == brute(rows, 10)


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = clustered(60, 9)
    rows.append(rows[3])  # candidate twice
    got = found(spark.createDataFrame(rows, SCHEMA), 20)
    assert got == brute(rows, 20)
    rows.append(rows[20])  # an anchor twice: its rows come twice
    again = found(spark.createDataFrame(rows, SCHEMA), 20)
    assert sum(r[0] == 20 for r in again) == 2 * sum(r[0] == 20 for r in brute(rows[:-1], 20))


def test_few_rows_and_none(spark):
    vectors = spark.createDataFrame([(0, [1.0], 1), (1, [0.9], 1), (2, [0.8], 2), (3, [0.1], 2)], SCHEMA)
    assert found(vectors, 50) == [(0, 1, 1, 2, 256 * 230, 256 * 204)]
    assert found(vectors.where("vec_id < 2"), 50) == []  # no other label
    assert found(vectors.where("vec_id <> 1"), 50) == []  # no positive
    assert found(vectors.where("vec_id > 0"), 50) == []  # no anchor
    assert found(vectors.where("false"), 50) == []


def test_scores_beyond_long_raise(spark):
    vectors = spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], SCHEMA)
    with pytest.raises(ValueError):
        found(vectors, 50)


def test_bounds_hold_and_tell_something():
    draw = np.random.default_rng(2)
    vectors = np.asarray([v for _, v, _ in clustered(400, 1, 50.0)]).round()
    own, norms = angles(vectors, directions(vectors, 8))
    anchors = draw.choice(400, 20, replace=False)
    low, high = score_bounds(own[anchors], own[anchors], norms[anchors], own, own, norms, norms)
    exact = vectors[anchors] @ vectors.T
    assert (low <= exact).all() and (exact <= high).all()
    # Most pairs are known to be far below the anchor's own norm.
    assert (high < 0.5 * norms[anchors][:, None] * norms[None, :]).mean() > 0.3


def test_references_of_no_or_zero_vectors():
    assert directions(np.zeros((0, 3)), 4).shape == (0, 3)
    assert directions(np.zeros((5, 3)), 4).shape == (0, 3)
    assert Vectors(3, 0.0, directions(np.zeros((5, 3)), 4)).stored == "<i2"
