import numpy as np
import pytest
from pyspark.sql import functions as F

from burnish.llm import topk
from burnish.llm.topk import Block, nearest


def brute(rows, k, modulus):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = [int(np.floor(64 * x)) for x in v]
    out = []
    for q, v in whole.items():
        if q % modulus == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.2, 40.0, 4e4])
def test_against_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(0, scale, 9)]) for i in range(150)]
    rows[11] = (11, rows[10][1])  # a tie
    rows[30] = (30, None)
    rows[31] = (31, [1.0, None, 2.0])
    rows[32] = (32, [1.0, float("nan")])
    rows[33] = (33, [float("inf")])
    rows[34] = (34, [0.5, -0.5])
    rows[35] = (35, [])
    rows.append((None, [0.1] * 9))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as V", "2 as `Embedding`")
    found = nearest(vectors, F.col("vec_id") % 5 == 0, k=6)
    assert sorted(map(tuple, found.collect())) == brute(rows, 6, 5)


def test_fewer_candidates_than_asked_and_none(spark):
    rows = [(0, [0.5]), (1, [0.25]), (20, [-1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, nearest(vectors, F.col("vec_id") % 20 == 0).collect())) == brute(rows, 20, 20)
    assert nearest(vectors.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(vectors.where("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("component", [1e30, -1e30, 4e7])
def test_scores_beyond_long_raise(spark, component):
    rows = [(0, [component] * 4), (1, [1.0] * 4)]
    with pytest.raises(ValueError):
        nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)


def test_stops_early_and_stays_exact():
    draw = np.random.default_rng(1)
    vectors = draw.integers(-40, 40, (500, 16))
    vectors[:20] += 200  # members that stand out
    queries = vectors[:3]
    block = Block(vectors, np.float64)
    own = np.zeros((3, 500), bool)
    for query, (at, scores) in zip(queries, block.search(queries, 5, own), strict=True):
        exact = vectors @ query
        assert len(at) < 500 and set(np.argsort(-exact, kind="stable")[:5]) <= set(at.tolist()) and (exact[at] == scores).all()
