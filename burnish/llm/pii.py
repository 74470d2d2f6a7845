"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Base rules find e-mail addresses, IP addresses, card and phone numbers: leftmost matches, each kind for
itself, kept if they pass their check. A greedy match that swallows a neighbour fails its check and hides
what it holds. So high-recall generators propose every reading of the digit groups and address parts
around: overlapping spans with wrong starts and ends among them. Gradient-boosted trees score them by
format and context. Spans at or above a threshold, set per kind on examples the trees have not seen, are
added where they touch no base span; of overlapping ones the best stays.

The trees learn from the base rules: a proposal equal to a base span is right, another one is wrong.
Proposals inside matches that failed their check are left out of the lessons, since they are what the
model is for. All proposals of all texts are lessons. Up to ``EXAMPLES`` of them the driver takes as they are; of more,
Spark counts the equal ones, and what a tree's cuts and the thresholds need of them is summed up by jobs.

Defined results: null and empty texts have no spans. Offsets count code points, ends are exclusive.
Rows repeat as given; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import bounded_batches, only, result, texts
from burnish.session import settle

# Fixed values of the base rules, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Same matches as [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), in linear time: a match starts where a run of digits does.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

EXAMPLES = 20_000  # proposals that the driver takes, at most; of more it gets sums only
CELLS = 50_000  # distinct lessons in one task, about
PRECISION = 0.98  # share of right spans, on unseen examples, that a threshold must reach
TREES, DEPTH, RATE, BINS = 30, 3, 0.3, 32

Span = tuple[int, int, int]  # kind, start, end

# Whatever a number of any kind can consist of, from its first digit on.
_RUN = re.compile(r"\+?[0-9][+0-9().\x20-]*")
_GROUP = re.compile(r"[0-9]+")
_OTHER_AT = re.compile(r"\x20?(?:\(at\)|\[at\]|\x20@\x20)\x20?", re.IGNORECASE)
_OTHER_DOT = re.compile(r"\x20?(?:\(dot\)|\[dot\])\x20?", re.IGNORECASE)
_LABEL, _DOT = re.compile(r"[A-Za-z0-9-]+"), re.compile(r"\.")
_MARKS = r"[@0-9]|[(\[][aA][tT][)\]]"
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_GROUP.findall(text))


def base_emails(text: str) -> list[tuple[int, int]]:
    """Same matches as the base pattern: looks only around each @."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_LETTERS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", at + 1)
    return found


def base_numbers(run: str, offset: int) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans in a run of digits and separators, and the matches that failed their check."""
    spans, failed = [], []
    for m in IP.finditer(run):
        if all(len(p) <= 3 and int(p) <= 255 for p in (part.lstrip("0") or "0" for part in m[0].split("."))):
            spans.append((1, offset + m.start(), offset + m.end()))
        else:
            failed.append((offset + m.start(), offset + m.end()))
    for m in CARD.finditer(run):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, offset + m.start(), offset + m.end()))
        elif len(digits) > 19:
            failed.append((offset + m.start(), offset + m.end()))
    for m in PHONE.finditer(run):
        if 8 <= len(_digits(m[0])) <= 15:
            spans.append((3, offset + m.start(), offset + m.end()))
        else:
            failed.append((offset + m.start(), offset + m.end()))
    return spans, failed


def number_proposals(run: str, offset: int) -> list[Span]:
    """Every reading of the digit groups of a run as an IP address, a card or a phone number."""
    groups = [m.span() for m in _GROUP.finditer(run)]
    out: list[Span] = []
    for i, (start, end) in enumerate(groups):
        total = j = 0
        card, dotted = True, True
        while i + j < len(groups):
            left, right = groups[i + j]
            total += right - left
            if j:
                gap = run[groups[i + j - 1][1] : left]
                card &= gap in (" ", "-")
                dotted &= gap == "."
            if total > 19:
                break
            if dotted and j == 3:
                out.append((1, offset + start, offset + right))
            if card and total >= 13:
                out.append((2, offset + start, offset + right))
            if 7 <= total <= 15:
                out.append((3, offset + start, offset + right))
                if start and run[start - 1] in "+(":
                    out.append((3, offset + start - 1, offset + right))
            j += 1
    return out


def email_proposals(text: str) -> list[tuple[int, int, str]]:
    """Every reading around an @ or a spelt-out one: start, end, the address in plain spelling."""
    out = []
    marks = [(m, m + 1) for m in _places(text, "@")]
    if "(" in text or "[" in text or " @ " in text:
        marks += [m.span() for m in _OTHER_AT.finditer(text)]
    for left, right in marks:
        start = left
        while start > 0 and text[start - 1] in _LOCAL_LETTERS:
            start -= 1
        if start == left:
            continue
        end, plain = right, ""
        while label := _LABEL.match(text, end):
            plain += label[0]
            end = label.end()
            if "." in plain:
                out.append((start, end, text[start:left] + "@" + plain))
            dot = _DOT.match(text, end) or _OTHER_DOT.match(text, end)
            if not dot:
                break
            plain += "."
            end = dot.end()
    return out


def _places(text: str, mark: str) -> Iterator[int]:
    at = text.find(mark)
    while at >= 0:
        yield at
        at = text.find(mark, at + 1)


# What the trees see of a span.
FEATURES = (
    "kind", "digits", "length", "groups", "longest", "shortest", "luhn", "largest", "plus", "opens", "balanced",
    "joined_before", "joined_after", "word_before", "word_after", "labels", "last_label", "leading_zero",
)


def features(text: str, kind: int, start: int, end: int, plain: str | None = None) -> list[float]:
    """Format and context of one proposal, in the order of ``FEATURES``."""
    span = plain or text[start:end]
    groups = _GROUP.findall(span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[max(0, start - 1) : start], text[end : end + 2]
    name = "" if kind else span.rpartition("@")[2]
    labels = name.split(".")
    return [
        kind, len(digits), len(span), len(groups), max(sizes), min(sizes),
        float(kind == 2 and luhn(digits)), float(max(map(int, groups))) if kind == 1 else -1.0,
        float(span[0] == "+"), float(span[0] == "("), float(span.count("(") == span.count(")")),
        float(before.isdigit() or before == "."),
        float(after[:1].isdigit() or (after[:1] in (".-" if kind != 2 else "-") and after[1:2].isalnum())),
        float(before.isalpha()), float(after[:1].isalpha()),
        len(labels) if not kind else 0, (len(labels[-1]) if labels[-1].isalpha() else -1) if not kind else 0,
        float(bool(groups) and groups[0][0] == "0"),
    ]


@dataclass
class Findings:
    """Base spans of a text; proposals that are none, with features; proposals for lessons, with labels."""

    base: list[Span]
    proposed: list[Span]
    rows: list[list[float]]
    labels: list[int]  # 1 right, 0 wrong, -1 unknown; of all proposals, base spans included


def search(text: str, lessons: bool = False) -> Findings:
    """Base spans and proposals of a whole text."""
    found = Findings([], [], [], [])
    failed: list[tuple[int, int]] = []  # matches that failed their check
    proposals: list[tuple[int, int, int, str | None]] = []
    if "@" in text:
        found.base += [(0, *span) for span in base_emails(text)]
    if "@" in text or _OTHER_AT.search(text):
        proposals += [(0, *p) for p in email_proposals(text)]
    for m in _RUN.finditer(text):
        run = m[0]
        if len(run) < 7:
            continue
        spans, dropped = base_numbers(run, m.start())
        found.base += spans
        failed += dropped
        proposals += [(*p, None) for p in number_proposals(run, m.start())]
    found.base.sort()
    base, taken, wrong = set(found.base), Cover([s[1:] for s in found.base]), Cover(failed)
    for kind, start, end, plain in proposals:
        is_base = (kind, start, end) in base
        if not lessons and (is_base or taken.touches(start, end)):
            continue
        found.proposed.append((kind, start, end))
        found.rows.append(features(text, kind, start, end, plain))
        if lessons:
            found.labels.append(1 if is_base else -1 if wrong.touches(start, end) else 0)
    return found


class Cover:
    """Tells whether a span touches any of the given ones."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.ends = list(accumulate((e for _, e in spans), max))

    def touches(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


class Forest:
    """Gradient-boosted trees for a yes or no, and a threshold per kind."""

    def __init__(self) -> None:
        self.edges: list[np.ndarray] = []
        self.start = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, bin, leaf values
        self.thresholds = {kind: np.inf for kind in range(len(KINDS))}

    def _binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edges, rows[:, j], "left") for j, edges in enumerate(self.edges)], 1)

    def fit(self, rows: np.ndarray, labels: np.ndarray, shares: tuple[float, float] = (1.0, 1.0)) -> Forest:
        """Learn on four fifths of the examples, set the thresholds on the rest.

        ``shares``: how much of the wrong and of the right proposals the examples are. Thresholds hold for all.
        """
        own = np.arange(len(rows)) % 5 != 4
        x, y = rows[own], labels[own].astype(float)
        if len(y) < 20 or not 0 < y.mean() < 1:
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        bins = self._binned(x)
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        sums = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-sums))
            tree, step = self._grow(bins, y - p, p * (1 - p))
            self.trees.append(tree)
            sums += step
        score, kind, truth = self.score(rows[~own]), rows[~own][:, 0], labels[~own]
        for k in self.thresholds:
            s, t = score[kind == k], truth[kind == k]
            order = np.argsort(-s, kind="stable")
            weight = 1 / np.asarray(shares)[t[order]]
            right = np.cumsum(t[order] * weight) / np.cumsum(weight)
            # Only where the next score differs does a threshold cut there.
            cuts = np.flatnonzero((right >= PRECISION) & np.append(np.diff(s[order]) < 0, True)) if len(s) else []
            if len(cuts):
                self.thresholds[k] = max(float(s[order][cuts[-1]]), 0.5)
        return self

    @staticmethod
    def _grow(bins: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[tuple, np.ndarray]:
        node = np.zeros(len(bins), np.int64)
        chosen, cuts = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS)
        for depth in range(DEPTH):
            _choose(depth, _sums(depth, bins, node, gradient, weight), chosen, cuts)
            node = 2 * node + 1 + (bins[np.arange(len(bins)), chosen[node]] > cuts[node])
        leaf = node - (2**DEPTH - 1)
        g, h = (np.bincount(leaf, v, 2**DEPTH) for v in (gradient, weight))
        values = RATE * g / (h + 1)
        return (chosen, cuts, values), values[leaf]

    def fit_all(self, lessons: DataFrame) -> Forest:
        """Learn as ``fit`` does, from any number of lessons: ``row``, ``label``, and ``drawn``, which sets a fifth apart.

        Equal rows become one with counts; then each level of a tree is one job, whose tasks hand in sums of a fixed size.
        """
        own = F.pmod("drawn", F.lit(5)) != 4
        counts = [F.count_if(F.col("label") == label).alias(name) for label, name in ((1, "right"), (0, "wrong"))]
        lessons = settle(lessons.groupBy("row", own.alias("own")).agg(*counts), "lessons")
        right, wrong = lessons.where("own").agg(F.sum("right"), F.sum("wrong")).first()
        if not right or not wrong or right + wrong < 20:
            return self
        self.edges = _edges(lessons.where("own"), right + wrong)
        self.start = float(np.log(right / wrong))

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = np.asarray(batch.column(0).to_pylist(), float).reshape(len(batch), len(FEATURES))
                columns = [pa.array(self._binned(rows).tolist(), pa.list_(pa.int32())), pa.array(rows[:, 0].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *batch.columns[1:]], names=["bins", "kind", *batch.schema.names[1:]])

        cells = lessons.select("row", "own", "right", "wrong")
        cells = cells.mapInArrow(binned, "bins array<int>, kind int, own boolean, right long, wrong long")
        cells = settle(cells.groupBy("bins", "kind", "own").agg(F.sum("right").alias("right"), F.sum("wrong").alias("wrong")), "cells")
        # Sorted, so that sums come out alike in every run.
        by = ["bins", "kind", "own"]
        cells = settle(cells.repartition(-(-cells.count() // CELLS), *by).sortWithinPartitions(*by), "cells")
        train = cells.where("own").select("bins", "right", "wrong")
        for _ in range(TREES):
            self.trees.append(self._grow_all(train))
        self._set_thresholds(cells.where("not own").select("bins", "kind", "right", "wrong"))
        return self

    def _grow_all(self, cells: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next tree, its nodes chosen by sums over all cells."""
        chosen, cuts = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS)
        leaves = np.zeros((2, 2**DEPTH))
        for depth in range(DEPTH):

            def level(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
                total = np.zeros(_shape(depth))
                for batch in batches:
                    bins, right, wrong = _cells(batch)
                    p, weight = 1 / (1 + np.exp(-self._sum(bins))), right + wrong
                    node = np.zeros(len(bins), np.int64)
                    for _ in range(depth):
                        node = 2 * node + 1 + (bins[np.arange(len(bins)), chosen[node]] > cuts[node])
                    total += _sums(depth, bins, node, right - weight * p, weight * p * (1 - p))
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total.tobytes()])], names=["part", "sums"])

            parts = sorted(cells.mapInArrow(level, "part long, sums binary").collect())
            sums = sum(np.frombuffer(bytes(r["sums"])).reshape(_shape(depth)) for r in parts)
            _choose(depth, sums, chosen, cuts)
            if depth == DEPTH - 1:
                for n in range(2**depth):
                    at = 2**depth - 1 + n
                    own = sums[chosen[at], :, n]
                    leaves[:, 2 * n] = own[:, : cuts[at] + 1].sum(1)
                    leaves[:, 2 * n + 1] = own[:, cuts[at] + 1 :].sum(1)
        return chosen, cuts, RATE * leaves[0] / (leaves[1] + 1)

    def _set_thresholds(self, cells: DataFrame) -> None:
        """The lowest score per kind down to which enough of the unseen lessons are right."""

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins, _, _ = _cells(batch)
                score = pa.array(1 / (1 + np.exp(-self._sum(bins))))
                yield pa.RecordBatch.from_arrays([score, *batch.columns[1:]], names=["score", "kind", "right", "wrong"])

        by_score = cells.mapInArrow(scored, "score double, kind int, right long, wrong long").groupBy("kind", "score")
        by_score = by_score.agg(F.sum("right").alias("right"), F.sum(F.col("right") + F.col("wrong")).alias("all"))
        above = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        sums = by_score.select("kind", "score", F.sum("right").over(above).alias("right"), F.sum("all").over(above).alias("all"))
        good = sums.where(F.col("right") / F.col("all") >= PRECISION)
        for r in good.groupBy("kind").agg(F.min("score").alias("lowest")).collect():
            self.thresholds[r["kind"]] = max(r["lowest"], 0.5)

    def _sum(self, bins: np.ndarray) -> np.ndarray:
        """Log odds that each binned proposal is right."""
        sums = np.full(len(bins), self.start)
        for chosen, cuts, values in self.trees:
            node = np.zeros(len(bins), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[np.arange(len(bins)), chosen[node]] > cuts[node])
            sums += values[node - (2**DEPTH - 1)]
        return sums

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability that each proposal is right."""
        if not self.trees:
            return np.zeros(len(rows))
        return 1 / (1 + np.exp(-self._sum(self._binned(rows))))

    def added(self, found: Findings) -> list[Span]:
        """Proposals to add to the base spans of a text."""
        if not found.rows:
            return []
        score = self.score(np.asarray(found.rows, float))
        good = [(-s, -(p[2] - p[1]), p) for s, p in zip(score, found.proposed, strict=True) if s >= self.thresholds[p[0]]]
        kept: list[tuple[int, int, int]] = []  # start, end, kind; apart from each other
        for _, _, (kind, start, end) in sorted(good):
            at = bisect_left(kept, (start, end, kind))
            if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
                kept.insert(at, (start, end, kind))
        return [(kind, start, end) for start, end, kind in kept]


def _shape(depth: int) -> tuple[int, int, int, int]:
    return len(FEATURES), 2, 2**depth, BINS + 1


def _sums(depth: int, bins: np.ndarray, node: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradients and weights of the rows by feature, node of the level and bin."""
    first, many = 2**depth - 1, 2**depth
    out = np.zeros((bins.shape[1], 2, many, BINS + 1))
    for j in range(bins.shape[1]):
        cell = (node - first) * (BINS + 1) + bins[:, j]
        for k, values in enumerate((gradient, weight)):
            out[j, k] = np.bincount(cell, values, many * (BINS + 1)).reshape(many, -1)
    return out


def _choose(depth: int, sums: np.ndarray, chosen: np.ndarray, cuts: np.ndarray) -> None:
    """Set feature and cut of the level's nodes, the first of those that gain most."""
    first, many = 2**depth - 1, 2**depth
    best = np.full(many, 1e-9)
    for j, (g, h) in enumerate(sums.cumsum(-1)):
        gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
        at = gain.argmax(1)
        top = gain[np.arange(many), at]
        better = np.flatnonzero(top > best)
        best[better] = top[better]
        chosen[first + better], cuts[first + better] = j, at[better]


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the cells, and how many of their lessons are right and wrong."""
    bins = np.asarray(batch.column(0).to_pylist(), np.int64).reshape(len(batch), len(FEATURES))
    return bins, *(batch.column(name).to_numpy().astype(float) for name in ("right", "wrong"))


def _edges(lessons: DataFrame, n: int) -> list[np.ndarray]:
    """The features' quantiles over all ``n`` lessons, as ``fit`` has them: distinct values that stand in the data."""
    values = lessons.select(F.posexplode("row").alias("feature", "value"), (F.col("right") + F.col("wrong")).alias("n"))
    values = values.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("upto", F.sum("n").over(upto))
    ranks = F.array(*[F.lit(k * (n - 1) // BINS).cast("long") for k in range(1, BINS)])
    hit = F.exists(ranks, lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    edges: list[list[float]] = [[] for _ in FEATURES]
    for r in values.where(hit).select("feature", "value").collect():
        edges[r["feature"]].append(r["value"])
    return [np.asarray(sorted(e)) for e in edges]


def _marked(text: Column) -> Column:
    """The text where it can hold a span at all; the rest need not go to Python."""
    return F.when(text.rlike(_MARKS), text)


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", examples: int | None = None) -> Forest:
    """Boosted trees from the base rules' verdicts on all proposals; the driver gets at most ``EXAMPLES`` of them.

    All texts are searched once; their proposals are written under the shared folder. Who can do with a sample
    names ``examples``, the most proposals it may have.
    """
    bounded_batches(docs.sparkSession)
    rows = only(docs, doc_id=doc_id, text=text)
    marked = rows.select("doc_id", _marked(F.col("text")).alias("text")).where("text is not null")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels, places = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                found = search(text, lessons=True)
                for row, label, (_, start, end) in zip(found.rows, found.labels, found.proposed, strict=True):
                    if label >= 0:
                        rows.append(row)
                        labels.append(label)
                        places.append(f"{doc}:{start}:{end}")
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.string()), pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())],
                names=["place", "row", "label"],
            )

    proposed = marked.mapInArrow(propose, "place string, row array<double>, label int")
    proposed = settle(proposed.withColumn("drawn", F.xxhash64("place", "row")), "proposals")
    all_of = {r["label"]: r["count"] for r in proposed.groupBy("label").count().collect()}
    if examples is None and sum(all_of.values()) > EXAMPLES:
        return Forest().fit_all(proposed)
    # Of a sample, right and wrong proposals alike, each to half of the bound; how many there are weighs them for the thresholds.
    got, shares, most = [], [1.0, 1.0], EXAMPLES if examples is None else examples // 2
    for label in sorted(all_of):
        # A hash share that leaves hardly more than are wanted, so that hardly more leave the executors.
        share = min(1.0, (most + 6 * most**0.5 + 6) / all_of[label])
        few = F.col("drawn").bitwiseAND(F.lit((1 << 30) - 1)) < int(share * (1 << 30))
        part = proposed.where((F.col("label") == label) & few).orderBy("drawn", "place").limit(most)
        own = [(r["drawn"], r["row"], r["label"]) for r in part.collect()]
        shares[label] = max(len(own), 1) / all_of[label]
        got += own
    got.sort(key=lambda r: r[0])
    if not got:
        return Forest()
    return Forest().fit(np.asarray([r[1] for r in got], float), np.asarray([r[2] for r in got]), tuple(shares))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in sorted(spans))


def found_spans(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``base`` and ``spans`` as ``kind:start:end`` lists, base counts by kind, ``n_added``."""
    return _run(docs, forest, doc_id, text, redact=False)


def redacted(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``found_spans``, and ``redacted``: the text with each span replaced by its kind in brackets."""
    return _run(docs, forest, doc_id, text, redact=True)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by ``[KIND]``; overlapping spans give one replacement."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _run(docs: DataFrame, forest: Forest, doc_id: str, text: str, redact: bool) -> DataFrame:
    spark = bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(forest)
    rows = only(docs, doc_id=doc_id, text=text)
    rows = rows.select("doc_id", (F.col("text") if redact else _marked(F.col("text"))).alias("text"))
    columns = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            base, every, counts, masked = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = search(text or "")
                spans = found.base + forest.added(found)
                base.append(listed(found.base))
                every.append(listed(spans))
                counts.append([*(sum(s[0] == k for s in found.base) for k in range(len(KINDS))), len(spans) - len(found.base)])
                if redact:
                    masked.append(text if text is None else mask(text, spans))
            table = np.asarray(counts, np.int64).reshape(-1, len(KINDS) + 1)
            arrays = [batch.column(0), pa.array(base, pa.string()), pa.array(every, pa.string())]
            arrays += [pa.array(table[:, j]) for j in range(len(KINDS) + 1)]
            names = ["doc_id", "base", "spans", *columns, "n_added"]
            if redact:
                arrays, names = [*arrays, pa.array(masked, pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    more = f"base string, spans string, {', '.join(f'{c} long' for c in columns)}, n_added long"
    return rows.mapInArrow(run, result(rows, ["doc_id"], more + (", redacted string" if redact else "")))

