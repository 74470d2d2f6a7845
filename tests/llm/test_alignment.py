import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from burnish.llm import alignment
from burnish.llm.alignment import Chunk, Tokenizers, alignments, linked_pairs, window_cuts, windowed
from burnish.llm.queries import QUERIES, vocabulary_path

PATHS = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def paths():
    return tuple(vocabulary_path(p) for p in PATHS)


@pytest.fixture(scope="module")
def opened(paths):
    return Tokenizers(*paths).opened()


def plain(opened, text):
    """Ids of a text, its groups as text and its links, by sets of ends over the whole text."""
    if not text:
        return [], [], "", []
    a, b = opened.a.encode(" " + text, add_special_tokens=False).ids, opened.b.encode(text)
    whole = b" " + text.encode()
    if any(b"".join(side.spelt[i] for i in ids) != whole for side, ids in ((opened.side_a, a), (opened.side_b, b))):
        return [], [], "", []
    ends_a = np.cumsum([len(opened.side_a.spelt[i]) for i in a]).tolist()
    ends_b = np.cumsum([len(opened.side_b.spelt[i]) for i in b]).tolist()
    shared = sorted(set(ends_a) & set(ends_b))
    groups, links, at, bt = [], [], 0, 0
    for end in shared:
        to_a, to_b = ends_a.index(end, at) + 1, ends_b.index(end, bt) + 1
        groups.append(",".join(map(str, a[at:to_a])) + "|" + ",".join(map(str, b[bt:to_b])))
        links.append((a[to_a - 1], b[to_b - 1]))
        at, bt = to_a, to_b
    return a, b, ";".join(groups), links


def wanted(opened, docs):
    done = [(i, *plain(opened, text)) for i, text in docs]
    counts = Counter(link for *_, links in done for link in links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, a, b, groups, links in done:
        sha = hashlib.sha256(groups.encode()).hexdigest() if a else ""
        own = sum(counts[k] == best[k[1]] for k in links)
        out.append((i, len(a), len(b), len(links), len(links), own, sum(counts[k] for k in links), sha))
    return sorted(out, key=str), counts, best


ODD = [
    "", " ", "  a  b ", "\n", "a▁b", "▁", "<|endoftext|> x <s></s> <0x0A> <unk>", "tab\tand blank", "naïve café 日本語 🙂🙃 é",
    "1234567890" * 30, "a" * 3000, "\x00\x01\x7f", "foo bar\r\nbaz  qux   ", "don't we'll I'VE", "﻿mark", "=" * 200, "x ▁ y",
]


def test_odd_texts(opened):
    chunk = Chunk(opened)
    chunk.add(list(range(len(ODD))), ODD)
    per_doc, groups_of, links, sizes = chunk.windows()
    for ids_a, ids_b, own, text in zip(*chunk.ids, per_doc, ODD, strict=True):
        a, b, groups, _ = plain(opened, text)
        assert (ids_a.tolist(), ids_b.tolist(), ";".join(groups_of[w] for w in own)) == (a, b, groups), text
    assert not len(chunk.ids[0][4])  # the sign itself turns into a space


def test_encoding_by_ranks_is_that_of_the_file(paths, opened):
    assert opened.by_rank  # merges are in the order of ids, every token is its own encoding
    draw = random.Random(8)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for _ in range(300):
        text = "".join(draw.choices(every[:0x3000], k=draw.randrange(30)) + draw.choices(" \n'aZ1.", k=20) + draw.choices(every, k=5))
        assert opened.by_rank.encode_ordinary(text) == opened.a.encode(text, add_special_tokens=False).ids
    plain_file = Tokenizers(*paths)
    plain_file.ranked = False
    assert plain_file.opened().encoded(ODD) == opened.encoded(ODD)


def test_anchors_are_shared_ends(opened):
    text = "The quick (brown) fox's naïve re-run 12 34  of  unbelievable things"
    a, b, _, _ = plain(opened, text)
    cuts = window_cuts(np.asarray(a), np.asarray(b), opened.side_a, opened.side_b, [0], [0])
    ends = [np.cumsum(side.sizes[ids]) for ids, side in ((a, opened.side_a), (b, opened.side_b))]
    assert len(cuts[0]) > 5
    for i, j in zip(*(c[1:] for c in cuts), strict=True):
        assert ends[0][i - 1] == ends[1][j - 1]


def test_a_window_is_aligned_once(opened):
    chunk = Chunk(opened)
    chunk.add([0, 1, 2], ["the cat sät on the mat and the cat run-on", "", "the cat"])
    per_doc, groups, links, sizes = chunk.windows()
    assert len(set(groups)) == len(groups) == len(sizes) < len(per_doc[0])
    assert sorted(set(per_doc[0].tolist())) == list(range(len(groups))) and not len(per_doc[1])
    assert per_doc[2].tolist() == per_doc[0][:2].tolist()
    # A group's link is the last id of either side.
    last = [tuple(int(part.split(",")[-1]) for part in g.split("|")) for own in groups for g in own.split(";")]
    assert last == [(x >> 32, x & 0xFFFFFFFF) for x in links.tolist()]
    assert sizes.tolist() == [own.count(";") + 1 for own in groups]


def test_equal_sums_are_told_apart(monkeypatch):
    monkeypatch.setattr(alignment, "mixed", lambda x: x * np.uint64(0) + np.uint64(1))
    ids = np.asarray([5, 6, 5, 6, 7, 8, 5, 7], np.int32)
    sides = [(ids, np.asarray([0, 2, 4, 6])), (ids[:4], np.asarray([0, 1, 2, 3]))]
    number, some = alignment.window_numbers(sides)
    assert number.tolist() == [0, 1, 2, 3]  # equal on one side only
    assert some.tolist() == [0, 1, 2, 3]
    sides[1] = (np.asarray([1, 1, 1, 2], np.int32), sides[1][1])
    number, some = alignment.window_numbers(sides)
    assert number.tolist() == [0, 0, 1, 2] and some.tolist() == [0, 2, 3]


def test_stretches_encode_as_the_whole(opened, monkeypatch):
    draw = random.Random(5)
    letters = ["a", "b", "Z", "é", "日", "1", "23", ".", ",", "'s", "-", "\n", "\t", " ", "  ", " ", " ", " the", " of"]
    batch = ["".join(draw.choices(letters, k=400)) for _ in range(60)]
    whole = opened.encoded(batch)
    monkeypatch.setattr(alignment, "STRETCH", 12)
    assert max(len(opened.stretches(t)) for t in batch) > 5
    assert opened.encoded(batch) == whole


def test_against_plain_alignment(spark, paths, opened, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 600)
    draw = random.Random(2)
    words = "the of and running naïve tokens Tokenizers 2024 ünder re-enter (x) don't".split()
    docs = [(i, " ".join(draw.choices(words, k=draw.randrange(0, 40)))) for i in range(80)]
    docs += [(100 + i, t) for i, t in enumerate(ODD)] + [(3, docs[3][1]), (500, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as Text", "2 as chunk", "3 as `n.a`", "4 as pairs")
    found = alignments(df.repartition(5), *paths)
    want, counts, best = wanted(opened, [(i, t or "") for i, t in docs])
    assert sorted(map(tuple, found.collect()), key=str) == want
    pairs = linked_pairs(windowed(df, *paths)).collect()
    assert {(p.a_id, p.b_id): p.n for p in pairs} == dict(counts)
    assert all(p.best == (p.n == best[p.b_id]) for p in pairs)


def test_odd_rows(spark, paths, opened, odd_docs, no_docs):
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    assert sorted(map(tuple, alignments(odd_docs, *paths).collect()), key=str) == wanted(opened, rows)[0]
    assert alignments(no_docs, *paths).count() == 0


def test_whole_table(spark, sf_dir, opened):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op11_alignment"](spark, sf_dir).collect()
    assert sorted(map(tuple, found), key=str) == wanted(opened, [(r.doc_id, r.text or "") for r in docs])[0]
