import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from burnish.llm import quality
from burnish.llm.common import bucket_of, utf8
from burnish.llm.quality import FEATURES, Model, learn, measured, measurements, pair_tree, scored, shallow_tree
from burnish.llm.queries import QUERIES


def plain(text):
    """The same numbers, text by text."""
    words = text.replace("\t", " ").replace("\r", " ").replace("\n", " \n ").split(" ")
    lines = [[w for w in line.split(" ") if w] for line in text.replace("\t", " ").split("\n")]
    lines = [line for line in lines if line]
    words = [w for line in lines for w in line]
    data, n = text.encode(), len(words)
    low = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    signs, upper = b".,;:?!'\"()-", sum(65 <= b <= 90 for b in data)
    lower, digits = sum(97 <= b <= 122 for b in data), sum(48 <= b <= 57 for b in data)
    wide, plain_signs = sum(b >= 128 for b in data), sum(b in signs for b in data)
    spaces = sum(b in b" \t\n\v\f\r" for b in data)
    solid = len(data) - spaces
    odd = solid - upper - lower - digits - wide - plain_signs

    def share(a, b):
        return a / max(b, 1)

    def distinct(k):
        own = [tuple(low[i : i + k]) for i in range(max(n - k + 1, min(n, 1)))]
        return share(len(set(own)), len(own))

    return {
        "words": np.log1p(n), "word_length": share(solid, n), "longest_word": np.log1p(max((len(w.encode()) for w in words), default=0)),
        "upper": share(upper, upper + lower), "capitals": share(sum("A" <= w[0] <= "Z" for w in words), n), "digits": share(digits, solid),
        "plain_signs": share(plain_signs, solid), "odd_signs": share(odd, solid), "letters": share(upper + lower + wide, solid + spaces),
        "not_ascii": share(wide, solid),
        "no_letter": share(sum(not any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words), n),
        "ends_sentence": share(sum(w[-1] in ".?!" for w in words), n),
        "ends_oddly": share(sum(ord(w[-1]) < 128 and not w[-1].isalnum() and w[-1].encode() not in [bytes([b]) for b in signs] for w in words), n),
        "same_as_before": share(sum(a == b for a, b in zip(low, low[1:], strict=False)), n), "distinct": share(len(set(low)), n),
        "commonest": share(max((low.count(w) for w in set(low)), default=0), n), "distinct_threes": distinct(3), "distinct_eights": distinct(8),
        "line_words": np.log1p(share(n, len(lines))), "lines_ending": share(sum(line[-1][-1] in ".?!" for line in lines), len(lines)),
    }


TEXTS = [
    "", "  \n\t ", "one", "One two, three.\nOne two, three.\n\nx | y | 12 3.4%", "É é ÀB straße 日本語 ok!", "a " * 50 + "b",
    "HELLO!! HELLO!! yes? no...", "word" * 5000, "\n".join(f"line {i} of many." for i in range(300)),
]


def test_measurements_are_those_of_a_plain_count():
    data, offsets = utf8(pa.array(TEXTS))
    for row, text in zip(measurements(data, offsets), TEXTS, strict=True):
        want = plain(text)
        for name, value in zip(FEATURES, row, strict=True):
            assert value == pytest.approx(want[name], abs=1e-12), (name, text[:40])


def test_shallow_tree_is_the_best_of_its_kind():
    draw = np.random.default_rng(0)
    g, h = draw.normal(0, 3, 9), draw.uniform(1, 5, 9)

    def gain(parts):
        return sum(g[a:b].sum() ** 2 / (h[a:b].sum() + quality.SMOOTH) for a, b in parts)

    # The first cut is the best single one.
    best = max(range(1, 9), key=lambda c: gain([(0, c), (c, 9)]))
    values = shallow_tree(g, h)
    assert values[best - 1] != values[best] and len(set(values)) <= 4
    for v in set(values):
        own = values == v
        assert v == pytest.approx(g[own].sum() / (h[own].sum() + quality.SMOOTH))


def test_pair_tree_sees_what_no_single_feature_shows():
    g = np.asarray([[5.0, -5.0], [-5.0, 5.0]])
    gain, values = pair_tree(g, np.ones((2, 2)))
    assert gain > 0 and (np.sign(values) == np.sign(g)).all()


def test_model_learns_an_interaction():
    draw = np.random.default_rng(4)
    x = np.zeros((4000, len(FEATURES)))
    x[:, 2], x[:, 5] = draw.uniform(0, 1, (2, 4000))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = Model().fit(x, y)
    assert (2, 5) in model.pairs
    own = model.scores(model.parts(x))
    assert ((own >= 0.5) == y).mean() > 0.9
    assert len(model.names()) == model.parts(x[:1]).shape[1]
    # A score is the logistic of the start and the tables' entries, each of which can be read off.
    row = x[7]
    total = sum(v for name, above, to, v in model.terms() if above < row[FEATURES.index(name)] <= to)
    total += sum(model.parts(x[7:8])[0, len(FEATURES) :]) + model.start
    assert own[7] == pytest.approx(1 / (1 + np.exp(-total)))


def test_held_out_accuracy(spark, sf_dir):
    found = QUERIES["op12_quality"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found.count() == docs.count()
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95


def test_held_out_labels_and_other_columns_change_nothing(spark, sf_dir, odd_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    teach = bucket_of(F.col("doc_id"), 3) != 1
    measures = measured(docs)
    a = learn(measures, labels, teach)
    turned = labels.withColumn("quality", F.when(teach, F.col("quality")).otherwise(1 - F.col("quality")))
    b = learn(measures, turned.select(F.lit(1).alias("Quality_"), "*"), teach)
    assert a.terms() == b.terms() and a.start == b.start


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (6, None), (None, 1), (7, 5)], "doc_id long, quality int")
    measures = measured(odd_docs)
    model = learn(measures, labels)
    rows = scored(measures, model).collect()
    assert len(rows) == odd_docs.count()
    assert [r.score for r in rows if r.doc_id == 2] == [r.score for r in rows if r.doc_id == 3] == [r.score for r in rows if r.doc_id == 5]
    assert scored(measured(no_docs), model).count() == 0
    # Nothing, or one label only, to learn from.
    assert {r.score for r in scored(measures, learn(measures, labels.where("false"))).collect()} == {0.5}
    assert {(r.score, r.predicted) for r in scored(measures, learn(measures, labels.where("quality = 1"))).collect()} == {(1.0, 1)}
    assert {(r.score, r.weakest) for r in scored(measures, learn(measures, labels.where("doc_id = 4"))).collect()} == {(0.0, None)}


def test_an_id_with_many_texts_and_labels_without_texts_stay_bounded(spark):
    docs = spark.range(3000).selectExpr("if(id % 2 = 0, 1L, id) as doc_id", "concat('word ', id, if(id % 4 = 0, '!!', '')) as text")
    labels = spark.range(20_000).selectExpr("id as doc_id", "int(id % 3 = 0) as quality")
    measures = measured(docs)
    model = learn(measures, labels, examples=500)
    assert scored(measures, model).count() == 3000
