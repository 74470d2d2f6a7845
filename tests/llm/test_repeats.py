import hashlib
import random

import numpy as np
import pytest

from burnish.llm import common, repeats
from burnish.llm.repeats import deduplicated, refined, repeated


def brute(rows, length):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        runs = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((-1 if i is None else i, len(data), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def planted():
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdeé", k=draw.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(draw.choices(words, k=draw.randint(10, 60))) for _ in range(20)]
    texts = []
    for _ in range(250):
        kind = draw.random()
        if kind < 0.2 and texts:
            text = draw.choice(texts)
        elif kind < 0.4 and texts:
            letters = list(draw.choice(texts) or "x")
            for _ in range(3):
                letters[draw.randrange(len(letters))] = draw.choice("xyz")
            text = "".join(letters)
        else:
            parts = [draw.choice(passages) if draw.random() < 0.4 else " ".join(draw.choices(words, k=draw.randint(1, 30))) for _ in range(draw.randint(0, 6))]
            text = " ".join(parts)
        texts.append(text)
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    rows += [(5000, None), (5001, ""), (5002, "a" * 700), (5003, "ab" * 300), (5004, "a" * 150), (5005, "\0" * 300 + "x"), (5006, "\0" * 250)]
    rows += [(6000 + i, passages[0][:80] + str(i * 7919) + " ".join(draw.choices(words, k=20))) for i in range(300)]
    return rows + [(6001, "same id"), (None, texts[9]), (None, texts[9]), (7, texts[2]), (7, texts[2])]


@pytest.mark.parametrize("frequent", [256, 3])
def test_against_brute_force(spark, frequent, monkeypatch):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.selectExpr("*", "1 as `Text`", "2 as block", "3 as `key`", "4 as at")
    found = [(-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in deduplicated(docs).collect()]
    assert sorted(found) == brute(rows, 100)


def test_kept_bytes(spark):
    text = "".join(random.Random(7).choices("abcdefgh", k=400))
    docs = spark.createDataFrame([(1, text), (2, "x" + text + "y")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in deduplicated(docs, kept=True).collect()}
    assert bytes(found[1]["kept"]).decode() == text and bytes(found[2]["kept"]) == b"xy"


def test_refined_orders_and_common_prefixes():
    draw = random.Random(1)
    texts = [bytes(draw.choices(b"ab", k=16)) for _ in range(200)]
    keys = np.asarray([draw.randint(0, 2) for _ in texts])
    order, prefix = refined(keys, np.frombuffer(b"".join(texts), np.uint8).reshape(-1, 16))
    assert [(keys[i], texts[i]) for i in order] == sorted((k, t) for k, t in zip(keys, texts, strict=True))
    for n in range(1, len(order)):
        a, b = order[n - 1], order[n]
        same = next((j for j in range(16) if texts[a][j] != texts[b][j]), 16)
        assert prefix[n] == (-1 if keys[a] != keys[b] else same)


def test_single_span_is_not_repeated():
    one = np.ones(1, np.int64)
    assert repeated(one, [b"x" * 100], one * 0, one, one, 100).tolist() == [0]


def test_odd_rows(spark, odd_docs, no_docs):
    assert deduplicated(odd_docs).count() == 9
    assert deduplicated(no_docs).count() == 0


def test_blocks_hold_bytes_not_rows(spark, monkeypatch):
    """More text gives more blocks, and a few long texts among many short ones do not share one."""
    monkeypatch.setattr(common, "BLOCK_BYTES", 50_000)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 500)
    draw = random.Random(6)
    rows = [(i, "".join(draw.choices("abcdefgh ", k=60_000 if i % 50 == 0 else 40))) for i in range(600)]
    rows += [(700 + i, rows[50 * i][1][:5000]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert common.blocks_for(docs) > 12
    found = sorted((r[0], *r[1:5]) for r in deduplicated(docs).collect())
    assert found == brute(rows, 100)
