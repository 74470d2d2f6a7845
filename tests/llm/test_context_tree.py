import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnish.llm.common import bucket_of
from burnish.llm.context_tree import estimated, log_gamma, scored


def brute_model(texts, depth):
    """Log10 probability of a text by the tree's own definition, node by node."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for text in texts:
        data = bytes(depth) + text.encode()
        for i in range(depth, len(data)):
            for k in range(8):
                node, bit = (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    context = data[i - d : i]
                    counts[context, node][bit] += 1
                    if d < depth:
                        children[context, node].add(data[i - d - 1 : i])

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(context, node):
        if (context, node) not in memo:
            own = kt(*counts[context, node]) if (context, node) in counts else 0.0
            below = sum(weighted(c, node) for c in children.get((context, node), ()))
            memo[context, node] = own if len(context) == depth else math.log(0.5 * math.exp(own) + 0.5 * math.exp(below))
        return memo[context, node]

    def predicted(context, node, bit, history):
        a, b = counts.get((context, node), (0, 0))
        guess = ((b if bit else a) + 0.5) / (a + b + 1)
        if len(context) == depth:
            return guess
        weight = 0.5 * math.exp(kt(a, b) - weighted(context, node))
        return weight * guess + (1 - weight) * predicted(history[len(history) - len(context) - 1 :], node, bit, history)

    def score(text):
        data, total = bytes(depth) + text.encode(), 0.0
        for i in range(depth, len(data)):
            for k in range(8):
                total += math.log10(predicted(b"", (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1, data[i - depth : i]))
        return total

    return score


def check(found, rows, out, model):
    learned = Counter()
    for i, text in rows:
        if not out(i):
            learned.update((text or "").encode().lower().split())
            learned["end"] += 1
    n, v = sum(learned.values()), len(learned)
    texts = Counter((i, text) for i, text in rows)
    assert len(found) == len(rows)
    for i, text in texts:
        tokens = [*(text or "").encode().lower().split(), "end"]
        base = sum(math.log10((learned[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        same = [r for r in found if r["doc_id"] == i and r["n_tokens"] == len(tokens) and math.isclose(r["base_score"], base, abs_tol=1e-6)]
        assert same and all(
            r["held_out"] == out(i)
            and r["n_known"] == sum(learned[t] > 0 for t in tokens)
            and r["train_tokens"] == n
            and math.isclose(r["score"], model(text or ""), rel_tol=1e-4, abs_tol=1e-4)
            for r in same
        ), (i, text)


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(["abab abab", "abc", "", None, "Abab é", "zz zz zz", "the cat", "the cat sat", "q"] * 3)]
    rows += [(100, "new words here"), (101, "é"), (None, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as `Text`", "2 as block", "3 as kind")
    out = lambda i: i is not None and i % 5 == 0
    found = scored(docs, F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))).collect()
    check(found, rows, out, brute_model([t or "" for i, t in rows if not out(i)], 3))


def test_nothing_learned_and_nothing_asked(spark):
    rows = [(1, "ab"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in scored(docs, F.lit(True)).collect()}
    assert math.isclose(found[1]["score"], 16 * math.log10(0.5), rel_tol=1e-5) and found[2]["score"] == 0
    assert found[1]["train_tokens"] == 0 and found[1]["n_known"] == 0
    assert scored(docs.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("depth", [0, 4, 9])
def test_a_depth_that_cannot_be_packed_raises(spark, depth):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    with pytest.raises(ValueError):
        scored(docs, F.lit(False), depth=depth)


def test_log_gamma():
    x = np.asarray([0.5, 1, 1.5, 7.9, 8, 100.5, 1e9])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)
    assert estimated(np.zeros(1), np.zeros(1))[0] == pytest.approx(0, abs=1e-9)


def test_learning_shortens_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = bucket_of(F.col("doc_id"), 10) == 0
    found = scored(docs, out).where("held_out").agg(F.avg("bits_per_byte")).first()[0]
    assert found < 3


def test_odd_rows(spark, odd_docs):
    assert scored(odd_docs, bucket_of(F.col("doc_id"), 10) == 0).count() == 9
