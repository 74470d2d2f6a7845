from collections import Counter, defaultdict
from math import log2

import numpy as np
import pyarrow as pa
import pytest

from burnish.llm import language_id
from burnish.llm.common import bucket_of, grams, utf8
from burnish.llm.language_id import Trees, drawn_grams, identified, learn

from .conftest import long_text


def brute(texts, asked, order):
    seen = defaultdict(Counter)
    for text in texts:
        data = bytes(order) + text.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen[data[i - k : i]][data[i]] += 1
    data, bits = bytes(order) + asked.encode(), 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            context = seen.get(data[i - k : i])
            if context is None:
                continue
            total = sum(context.values()) + len(context)
            if data[i] in context:
                bits -= log2(context[data[i]] / total)
                break
            bits -= log2(len(context) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_against_brute_force():
    learned = {"a": ["abc abd", "éa x", "", "hello hello"], "b": ["zzz", "abcabc abcabc"]}
    asked = ["abd z", "", "é", "hello", "qqq", "abcabc", "x" * 50]
    names = sorted(learned)
    counts = [np.unique(grams(*utf8(pa.array(learned[n])), 3), return_counts=True) for n in names]
    lengths = Trees(names, 3, counts).lengths(*utf8(pa.array(asked)))
    wanted = [[brute(learned[n], text, 3) for n in names] for text in asked]
    assert np.allclose(lengths, wanted, atol=1e-3)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = bucket_of(docs["doc_id"], 4) == 2
    found = identified(docs, learn(docs.where(~out))).join(docs.where(out).select("doc_id", "lang"), "doc_id").collect()
    assert found and sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_sample_is_bounded_and_still_good(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small, whole = learn(docs, sample_bytes=20_000), learn(docs)
    assert sum(map(len, small.costs)) < sum(map(len, whole.costs))
    found = identified(docs, small).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.9


def test_language_of_few_long_documents_is_learned(spark):
    long, short = long_text(40_000), "Ein kurzer Satz über den grünen Hügel."
    for ids in ([1, 2, 3], [None, None, None], [7, 8, 9], [10**9, 5, 77]):
        rows = [(i, f"{k} {long}", "en") for k, i in enumerate(ids)] + [(100 + i, f"{short} {i}", "de") for i in range(20)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        trees = learn(docs, sample_bytes=20_000)
        assert trees.languages == ["de", "en"]
        assert all(r["lang_pred"] == "en" for r in identified(docs.where("lang = 'en'"), trees).collect())


def test_sample_holds_about_its_bytes_whatever_the_lengths(spark, monkeypatch):
    asked = []
    monkeypatch.setattr("burnish.llm.language_id.Trees", lambda names, order, counts: asked.append([n.sum() for _, n in counts]))
    text = long_text(40_000)
    many = [(i, text[1000 * i : 1000 * (i + 1)], "en") for i in range(len(text) // 1000)]
    for rows in (many, [(1, text, "en")], [(1, text, "en"), *many]):
        learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=60_000)
        assert 50_000 < asked[-1][0] < 70_000
    learn(spark.createDataFrame(many[:3], "doc_id long, text string, lang string"), sample_bytes=60_000)
    assert asked[-1] == [3000]


def test_drawn_passages_count_what_the_whole_text_counts():
    texts = ["é hello hello", "", "abcabcabc" * 9, "x"]
    data, offsets = utf8(pa.array(texts))
    every = [list(range(max(1, -(-len(t.encode()) // 5)))) for t in texts]
    whole = drawn_grams(data, offsets, [None] * 4, 5, 3)
    assert (whole == grams(data, offsets, 3)).all() and (drawn_grams(data, offsets, every, 5, 3) == whole).all()
    some = drawn_grams(data, offsets, [[1], [], [16], [0]], 5, 3)
    assert (some == np.concatenate([whole[5:10], whole[14 + 80 : 14 + 81], whole[-1:]])).all()
    assert len(drawn_grams(data, offsets, [[], [], [], []], 5, 3)) == 0


def test_odd_rows(spark, odd_docs, no_docs):
    rows = identified(odd_docs, learn(odd_docs)).collect()
    assert len(rows) == 9
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert found[1][0] == "en" and found[6][0] == "fr"
    assert found[2] == found[3] == found[5] == found[7] == ("und", 0.0)
    nothing = identified(odd_docs, learn(no_docs)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert identified(no_docs, learn(no_docs)).count() == 0


def test_more_languages_than_can_be_broadcast_raise(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 5)
    docs = spark.range(30).selectExpr("id as doc_id", "concat('text ', id) as text", "string(id % 6) as lang")
    with pytest.raises(ValueError):
        learn(docs)
    assert learn(docs.where("lang <> '5'")).languages == list("01234")
