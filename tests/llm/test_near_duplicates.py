import random
import re

import numpy as np
import pytest

from burnish.llm import near_duplicates as module
from burnish.llm.components import components
from burnish.llm.near_duplicates import BANDS, ROWS, estimates, near_duplicates, registers


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def planted(seed):
    """Exact copies, chains of small edits, and a large group of near copies around the threshold."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(1, 90))) for _ in range(120)]
    for _ in range(80):
        words = draw.choice(texts).split()
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append(" ".join(words).upper() if draw.random() < 0.2 else "  ".join(words))
    base = draw.choices(vocabulary, k=140)
    for _ in range(150):
        words = base[:]
        for _ in range(draw.randint(0, 9)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append(" ".join(words))
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(2000, None), (2001, ""), (2002, " \n "), (2003, "Ab"), (2004, "aB"), (2005, "É x"), (2006, "é x")]


@pytest.mark.parametrize(("k", "percent", "chunk"), [(3, 85, 1 << 14), (5, 80, 900)])
def test_against_brute_force(spark, k, percent, chunk, monkeypatch):
    monkeypatch.setattr(module, "CHUNK_SHINGLES", chunk)
    rows = planted(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as `Text`", "2 as node", "3 as root", "4 as bands")
    assert sorted(map(tuple, near_duplicates(docs, k, percent).collect())) == brute(rows, k, percent)


def test_estimates_follow_the_similarity():
    draw = np.random.default_rng(0)
    for similarity in (0.3, 0.8, 0.95):
        size = 2000
        common = int(size * 2 * similarity / (1 + similarity))
        for extra in (0, 400):
            values = draw.integers(0, 2**63, 2 * size + extra - common, dtype=np.int64).astype(np.uint64)
            one, two = np.sort(values[:size]), np.sort(values[size - common :])
            sketches = registers(np.concatenate([one, two]), np.asarray([0, len(one), len(one) + len(two)]))
            true = common / (len(one) + len(two) - common)
            got = estimates(sketches[:1], sketches[1:], np.asarray([len(one)]), np.asarray([len(two)]))[0]
            assert abs(got - true) < 0.12


def test_registers_merge_by_maximum():
    draw = np.random.default_rng(1)
    a, b = (draw.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) for n in (300, 50))
    both = registers(np.concatenate([a, b, a, b]), np.asarray([0, 300, 350, 700]))
    assert both.shape == (3, BANDS * ROWS) and (np.maximum(both[0], both[1]) == both[2]).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 5), (5, 7), (9, 9), (1, 200), (200, 3), (3, 160)]
    found = components(spark.createDataFrame(chain, "a long, b long"), "test").collect()
    wanted = {i: 1 for i in [*range(100, 161), 1, 3, 200]} | {5: 5, 7: 5}
    assert {r["node"]: r["root"] for r in found} == wanted and len(found) == len(wanted)
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == 9 and sum(r["doc_id"] == 1 and r["kept"] for r in rows) == 2
    assert all(r["kept"] for r in rows)
    assert near_duplicates(no_docs).count() == 0


def test_two_texts_under_one_id_keep_both_their_links(spark):
    draw = random.Random(3)
    a, b = (" ".join(f"w{draw.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (9, a), (7, "quite other words here"), (7, b + " more")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, 3, 85).collect())
        assert found == [(1, 58, 1, True), (1, 58, 1, True), (2, 59, 1, False), (3, 59, 1, False), (7, 2, 7, True), (7, 59, 1, False), (9, 58, 1, False)]
