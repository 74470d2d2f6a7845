import random
import re

import numpy as np

from burnish.llm.pii import CARD, FEATURES, PHONE, Forest, found_spans, learn, listed, luhn, mask, redacted, search

IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute(text):
    number = lambda m: re.sub(r"[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(number(m)) <= 19 and luhn(number(m))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(number(m)) <= 15]
    return sorted(out)


def test_base_spans_against_whole_text_patterns(spark, sf_dir):
    draw = random.Random(2)
    texts = ["".join(draw.choices("01239+().- @ab.-_%5é", k=draw.randint(0, 60))) for _ in range(4000)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text in texts:
        assert search(text).base == brute(text)


def test_very_long_digits():
    text = f"x {'9' * 6000}.1.1.1 {'0' * 6000}7.1.1.255 y"
    assert [s[0] for s in search(text).base] == [1] and search("1" * 200_000).base == []


def card(draw):
    digits = "4" + "".join(draw.choices("0123456789", k=14))
    return digits + next(d for d in "0123456789" if luhn(digits + d))


def lessons():
    draw, rows = random.Random(4), []
    for i in range(400):
        phone = f"+1 ({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)}"
        kinds = [phone, card(draw), f"bob.{i}@mail{i % 9}.example.com", ".".join(str(draw.randint(1, 250)) for _ in range(4))]
        rows.append((i, f"words before {kinds[i % 4]} words after and {draw.randint(1, 99999)} more"))
    return rows


def test_trees_find_what_greedy_matches_hide(spark):
    rows = lessons()
    number = card(random.Random(9))
    hidden = f"call +1 (366) 555-9807 {number} now"
    rows += [(1000, hidden), (1001, "pay 1234567 or 20240101 12 30 45"), (1002, None), (1003, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in found_spans(docs, learn(docs)).collect()}
    assert found[1000]["base"] == "" and found[1000]["spans"] == f"card:23:{23 + len(number)},phone:5:22"
    assert found[1001]["spans"] == found[1002]["spans"] == found[1003]["spans"] == ""
    assert all(found[i]["spans"] == found[i]["base"] != "" for i in range(400))
    clean = {r["doc_id"]: r["redacted"] for r in redacted(docs, learn(docs)).collect()}
    assert clean[1000] == "call [PHONE] [CARD] now" and clean[1002] is None and clean[1003] == ""


def test_thresholds_hold_for_the_natural_mix():
    # Of the high proposals 99 % are right in a balanced sample, 95 % where wrong ones are five times as common.
    rows = np.zeros((10_000, len(FEATURES)))
    rows[:, 1] = np.arange(10_000) // 5 % 2
    labels = rows[:, 1].astype(int)
    odd = np.arange(10_000) // 10 % 100 == 7
    labels[odd] = 1 - labels[odd]
    assert Forest().fit(rows, labels).thresholds[0] < 1
    assert Forest().fit(rows, labels, (0.2, 0.2)).thresholds == Forest().fit(rows, labels).thresholds
    assert Forest().fit(rows, labels, (0.2, 1.0)).thresholds[0] == np.inf


def test_examples_weigh_as_much_as_there_are(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Forest, "fit", lambda self, rows, labels, shares: seen.append((np.bincount(labels), shares)) or self)
    texts = [f"mail a{i}@b.org now {i % 256}.1.2.3 or {i}.{i}.{300 + i}.{i} and 1 2 3 4 5 6 7 8 9 {1000 + i} {2000 + i}" for i in range(60)]
    for ids in (range(60), [None] * 60):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        learn(docs)
        learn(docs, examples=20)
    (every, whole), (few, shares) = seen[:2]
    assert whole == (1.0, 1.0) and few.tolist() == [10, 10] and every.min() > 10 and 0 < max(shares) < 1
    # The shares are those of all proposals, with and without ids.
    for (every, _), (few, shares) in (seen[:2], seen[2:]):
        assert [round(n / share) for n, share in zip(few, shares)] == every.tolist()


def test_mask_joins_overlaps():
    assert mask("abcdefgh", [(0, 1, 4), (1, 2, 6)]) == "a[EMAIL]gh"
    assert listed([(3, 5, 9), (0, 7, 8), (0, 1, 2)]) == "email:1:2,email:7:8,phone:5:9"


def test_odd_rows(spark, odd_docs, no_docs):
    rows = found_spans(odd_docs, learn(odd_docs)).collect()
    assert len(rows) == 9 and {r["spans"] for r in rows} == {""}
    assert found_spans(no_docs, learn(no_docs)).count() == 0
    assert found_spans(odd_docs, Forest()).count() == 9


def test_few_rows_leave_the_executors(spark, monkeypatch):
    taken = []
    fit = lambda self, rows, labels, shares: taken.append(len(rows)) or self
    monkeypatch.setattr(Forest, "fit", fit)
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('a', id, '@b.org or ', id, ' 12 34 56 78 90 12 34') as text")
    tops = []
    order = type(docs).limit
    monkeypatch.setattr(type(docs), "limit", lambda self, n: tops.append(self.count()) or order(self, n))
    learn(docs.repartition(16), examples=200)
    assert taken == [200] and all(100 <= n < 240 for n in tops)


def test_added_spans_are_those_of_a_plain_choice():
    """The spans a forest adds, chosen by trying the best proposal first against all kept before."""
    draw = random.Random(11)
    rows, labels = [], []
    for _, text in lessons():
        found = search(text, lessons=True)
        rows += found.rows
        labels += found.labels
    keep = [i for i, label in enumerate(labels) if label >= 0]
    forest = Forest().fit(np.asarray([rows[i] for i in keep], float), np.asarray([labels[i] for i in keep]))
    assert sum(np.isfinite(list(forest.thresholds.values()))) >= 3
    added = 0
    for n in range(300):
        parts = [f"+1 (366) 555-{draw.randint(1000, 9999)}", card(draw), "10.0.0.7", f"x{n}@a.example.org", str(draw.randint(0, 10**9))]
        text = "see " + draw.choice([" ", "", ", "]).join(draw.choices(parts, k=4)) + " end"
        found = search(text)
        scores = forest.score(np.asarray(found.rows, float)) if found.rows else []
        order = sorted(
            (i for i, s in enumerate(scores) if s >= forest.thresholds[found.proposed[i][0]]),
            key=lambda i: (-scores[i], found.proposed[i][1] - found.proposed[i][2], found.proposed[i]),
        )
        kept = []
        for i in order:
            kind, start, end = found.proposed[i]
            if all(end <= s or e <= start for _, s, e in kept) and all(end <= s or e <= start for _, s, e in found.base):
                kept.append((kind, start, end))
        assert sorted(forest.added(found)) == sorted(kept)
        added += len(kept)
    assert added > 20


def proposals_of(rows):
    found = [search(text or "", lessons=True) for _, text in rows]
    every = [(row, label) for f in found for row, label in zip(f.rows, f.labels, strict=True) if label >= 0]
    return [row for row, _ in every], [label for _, label in every]


def test_sums_over_all_lessons_give_the_trees_of_a_plain_fit(spark, monkeypatch):
    monkeypatch.setattr("burnish.llm.pii.CELLS", 100)  # several tasks
    rows, labels = proposals_of(lessons())
    lesson = [([float(x) for x in row], label, i) for i, (row, label) in enumerate(zip(rows, labels, strict=True))]
    got = Forest().fit_all(spark.createDataFrame(lesson, "row array<double>, label int, drawn long").repartition(5))
    plain = Forest().fit(np.asarray(rows, float), np.asarray(labels))
    assert all(np.array_equal(a, b) for a, b in zip(got.edges, plain.edges, strict=True))
    assert np.allclose(got.score(np.asarray(rows, float)), plain.score(np.asarray(rows, float)))
    assert np.allclose(list(got.thresholds.values()), list(plain.thresholds.values())) and np.isfinite(got.thresholds[2])


def test_all_proposals_are_lessons_however_many(spark, monkeypatch):
    monkeypatch.setattr("burnish.llm.pii.EXAMPLES", 50)
    monkeypatch.setattr(Forest, "fit", lambda *given: 1 / 0)
    seen, whole = [], Forest.fit_all
    monkeypatch.setattr(Forest, "fit_all", lambda self, df: seen.append(df.groupBy("label").count().collect()) or whole(self, df))
    rows, number = lessons(), card(random.Random(9))
    rows += [(1000, f"call +1 (366) 555-9807 {number} now"), (1001, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in found_spans(docs, learn(docs)).collect()}
    assert found[1000] == f"card:23:{23 + len(number)},phone:5:22"
    _, labels = proposals_of(rows)
    assert dict(seen[0]) == {0: labels.count(0), 1: labels.count(1)}


def test_all_lessons_of_one_kind_or_too_few(spark):
    none = [0.0] * len(FEATURES)
    for lesson in ([], [(none, 1, 0)], [(none, 1, i) for i in range(50)], [(none, i % 2, i) for i in range(8)]):
        forest = Forest().fit_all(spark.createDataFrame(lesson, "row array<double>, label int, drawn long"))
        assert not forest.trees and set(forest.thresholds.values()) == {np.inf}
