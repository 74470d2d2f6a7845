import random
import re
from collections import Counter
from math import isclose, log1p

import numpy as np
import pyarrow as pa
import pytest

from burnish.llm import decontaminate
from burnish.llm.common import Words, utf8
from burnish.llm.decontaminate import B, Index, K1, contaminated, flagged, halves, indexes

from .conftest import long_text


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_words_and_hashes():
    texts = ["Hello, World! don't", "", "  ", "é à—b “q” «r» a b", "A" * 70_000 + " zz zz", "x\n\ny 12"]
    found = Words(*utf8(pa.array([t.lower() for t in texts])), spaced=False)
    cut = [[bytes(found.data[a:b]).decode() for a, b in zip(found.starts[found.text == i], found.ends[found.text == i])] for i in range(6)]
    assert cut == [words(t) for t in texts]
    same = {}
    for a, b, h in zip(found.starts, found.ends, found.hashes.tolist()):
        assert same.setdefault(bytes(found.data[a:b]), h) == h
    assert len(set(same.values())) == len(same)


def test_scores_against_plain_bm25(spark, sf_dir):
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    index = Index(list(range(len(items))), items)
    split = [words(t) for t in items]
    mean, df = sum(map(len, split)) / len(split), Counter(w for t in split for w in set(t))
    for doc in docs:
        own = set(words(doc))
        found = Words(*utf8(pa.array([doc.lower()])), spaced=False)
        terms = index.term_numbers(found.hashes)
        terms = np.unique(terms[terms >= 0])
        _, at, scores = index.hits(np.zeros(len(terms), np.int64), terms, 1, 0.2)
        got = dict(zip(at.tolist(), scores.tolist(), strict=True))
        for i, t in enumerate(split):
            weight = {
                w: log1p((len(split) - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(t) / mean))
                for w, n in Counter(t).items()
            }
            share = sum(v for w, v in weight.items() if w in own) / sum(weight.values())
            assert (i in got) == (share >= 0.2) and (i not in got or isclose(got[i], share))


def test_planted_items_are_found_and_nothing_else(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = {r["item_id"]: [shingles(h) for h in halves(r["text"])] for r in items.collect()}
    wanted = set()
    for r in docs.collect():
        own = shingles(r["text"])
        wanted |= {(r["doc_id"], i) for i, hs in parts.items() if all(len(h & own) >= 0.8 * len(h) for h in hs if len(next(iter(h))) == 5)}
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()}
    assert found == {w for w in wanted if w in found or any(len(next(iter(h))) < 5 for h in parts[w[1]])} and found
    hits = {r["doc_id"] for r in flagged(docs, items).where("hits > 0").collect()}
    assert hits == {d for d, _ in found}


def test_every_item_is_found_with_any_one_word_changed(spark, sf_dir):
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index, hay = Index(list(range(len(items))), items), long_text(300)
    for i, item in enumerate(items):
        cut = re.split(r"([^\W_]+)", item)
        sizes = [len(words(h)) for h in halves(item)]
        texts = []
        for j in range(1, len(cut), 2):
            # A half of one or two words is held whole or not at all.
            if sizes[0 if j // 2 < sizes[0] else 1] > 2:
                texts += [f"{hay} {''.join(cut[:j])}{new}{''.join(cut[j + 1 :])} {hay}" for new in ("zzqx", "", f"zzqx {cut[j]}")]
        found = index.search(*utf8(pa.array([t.lower() for t in texts])), decontaminate.COVERED, decontaminate.OVERLAP)
        assert {f[0] for f in found if f[1] == i} == set(range(len(texts)))
        assert all(min(f[3:]) > 0.5 for f in found)


def test_half_an_item_or_scattered_words_are_no_hit():
    question, answer = "Which of the seven green hills did the old cat cross first.", "It crossed the one by the river."
    index = Index([1], [f"{question} {answer}"])
    scattered = " ".join(f"{w} and" for w in words(f"{question} {answer}"))
    two_gone = f"{question} It crossed the other near the river."
    texts = [f"{question} Nobody knows.", scattered, two_gone, f"{question.replace('green', 'red')} {answer}"]
    found = index.search(*utf8(pa.array([t.lower() for t in texts])), 0.3, decontaminate.OVERLAP)
    assert [f[0] for f in found] == [3] and found[0][3:] == (1 - 1 / 12, 1.0)
    # The longest item with words put in, across any border of windows.
    item = long_text(300)
    edited = " ".join(w + " new" * (i % 10 == 0) for i, w in enumerate(item.split()))
    texts = ["other " * n + edited + " other" * 2000 for n in range(0, 400, 50)]
    found = Index([1], [item]).search(*utf8(pa.array(texts)), decontaminate.COVERED, decontaminate.OVERLAP)
    assert [f[0] for f in found] == list(range(8))


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_long_texts_edges_and_several_indexes(spark, most, monkeypatch):
    monkeypatch.setattr(decontaminate.indexes, "__defaults__", ("item_id", "text", most))
    question, answer = "Which of the seven green hills did the old cat cross first.", "It crossed the one by the river."
    items = spark.createDataFrame(
        [(1, f"{question} {answer}"), (2, None), (3, ""), (4, "..."), (5, "two words"), (6, f"{question} {answer}")], "item_id long, text string"
    )
    hay = long_text(9000)
    rows = [
        (1, f"{hay} {question.upper()}\n{answer} {hay}"),
        (2, f"{hay} {question} {hay} {answer}"),
        (3, f"{question} {hay}"),
        (4, None),
        (5, ""),
        (6, f"{question} - {answer}"),
        (6, f"{question} - {answer}"),
        (7, "here are two words to find"),
        (None, f"{question} {answer}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as `Text`", "2 as item_id", "3 as hits")
    found = sorted((r["doc_id"] or 0, r["item_id"]) for r in contaminated(docs, items).collect())
    assert found == sorted([(d, i) for d in (0, 1, 6, 6) for i in (1, 6)] + [(7, 5)])
    assert sorted((r["doc_id"] or 0, r["hits"]) for r in flagged(docs, items).collect()) == sorted(
        [(0, 2), (1, 2), (2, 0), (3, 0), (4, 0), (5, 0), (6, 2), (6, 2), (7, 1)]
    )
    assert contaminated(docs.where("false"), items).count() == 0
    assert contaminated(docs, items.where("false")).count() == 0
    assert flagged(docs, items.where("false")).where("hits = 0").count() == 9


def test_scores_do_not_depend_on_what_shares_an_index(spark):
    """Items with many words in common, near the threshold: one index, several, and one per item say the same."""
    draw = random.Random(5)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    texts = [" ".join(draw.choices(common, k=9) + draw.sample(rare, 5)) + ". " + " ".join(draw.choices(common, k=4)) + "." for _ in range(30)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame(
        [(i, " ".join(w for w in t.split() if draw.random() < 0.8)) for i, t in enumerate(texts)], "doc_id long, text string"
    )
    found = []
    for most in (1 << 20, 700, 60):
        own = list(indexes(items, most=most))
        assert (len(own) > 1) == (most < 1 << 20) and sum(len(i.ids) for i in own) == 30
        batch = utf8(pa.array([r["text"] for r in docs.collect()]))
        found.append(sorted((f[0], i.ids[f[1]], round(f[2], 9)) for i in own for f in i.search(*batch, 0.5, 0.0)))
    assert found[0] == found[1] == found[2] and len(found[0]) > 20
    # One index of all items by itself has the same totals.
    alone = Index(list(range(30)), texts)
    assert sorted((f[0], alone.ids[f[1]], round(f[2], 9)) for f in alone.search(*batch, 0.5, 0.0)) == found[0]
