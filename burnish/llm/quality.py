"""Quality of texts by a generalised additive model with pairwise interactions.

Each text is measured by a few numbers about its words, signs, lines and repeats (``FEATURES``). A feature's values
are cut into bins, and the model is one lookup table of log odds per feature, and one over two coarser binned
features per chosen pair. Tables are learned by cyclic boosting: round after round, one feature after the other
gets a shallow tree of its own, fitted to what the sum of all tables still gets wrong and added to its table at a
small rate. When the features are done, pairs are ranked by how much one tree over both would gain, and the best
ones get their turns in the same way. Rounds end where log loss on unseen examples is least. A text's score is the
logistic of the sum of its bins' entries, so every score can be taken apart by ``Model.terms`` and ``weakest``.

Texts are measured once, whole; the measurements are written and serve the lessons and the scores. Lessons are
measurements whose ids have labels 0 or 1: at most about ``EXAMPLES``, a hash sample if there are more. That bound is
the only sample.

Defined results: null and empty texts measure zero throughout and are scored like any other. Labels other than 0 and
1, null ones and null ids teach nothing; equal lessons count once, contradicting ones all count. Where only one
label was seen every score is that label's share, 0.5 without lessons. Rows repeat as given; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import Words, bounded_batches, only, result, slices, utf8
from burnish.session import settle

EXAMPLES = 20_000  # labelled measurements the tables are learned from, about, at most
BINS, PAIR_BINS = 32, 8  # of a feature alone, and of a feature in a pair
ROUNDS, RATE, PATIENCE = 300, 0.1, 20
PAIRS = 6
SMOOTH = 2.0  # added to a leaf's weight
_CHUNK = 1 << 20

FEATURES = (
    "words", "word_length", "longest_word", "upper", "capitals", "digits", "plain_signs", "odd_signs", "letters",
    "not_ascii", "no_letter", "ends_sentence", "ends_oddly", "same_as_before", "distinct", "commonest",
    "distinct_threes", "distinct_eights", "line_words", "lines_ending",
)

# Kinds of bytes: upper, lower, digit, plain sign, other sign, beyond ASCII, white space.
_KIND = np.full(256, 4, np.int8)
_KIND[ord("A") : ord("Z") + 1] = 0
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[ord(c) for c in ".,;:?!'\"()-"]] = 3
_KIND[0x80:] = 5
_KIND[[*range(0x09, 0x0E), 0x20]] = 6
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".?!"]] = True


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, and how often its commonest one comes."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, text[at], np.diff(np.append(at, len(hashes))))
    return np.bincount(text[at], minlength=n), most


def measurements(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text, of all its bytes."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    found = Words(data, offsets, spaced=True)
    text, starts, ends = found.text, found.starts, found.ends

    def count(of: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of, weights, minlength=n)

    kind = _KIND[data]
    filled = np.flatnonzero(np.diff(offsets))
    kinds = np.zeros((7, n))
    for k in range(7):
        kinds[k, filled] = np.add.reduceat(kind == k, offsets[filled], dtype=np.int64)
    upper, lower, digits, plain, odd, wide, spaces = kinds
    solid = kinds[:6].sum(axis=0)
    words, lengths = count(text), ends - starts
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, text, lengths)
    has_letter = np.zeros(len(starts), bool)
    if len(starts):
        letter = np.isin(kind, (0, 1, 5))
        so_far = np.concatenate([[0], np.cumsum(letter)])
        has_letter = so_far[ends] > so_far[starts]
    last = data[ends - 1]
    before = np.zeros(len(starts), bool)
    before[1:] = (found.hashes[1:] == found.hashes[:-1]) & (text[1:] == text[:-1])
    distinct, commonest = _distinct(found.hashes, text, n)
    threes, eights = (found.shingles(k) for k in (3, 8))
    # Lines: a word ends one if a line feed, or the end of its text, comes before the next word.
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    ends_line = np.ones(len(starts), bool)
    ends_line[:-1] = (text[1:] != text[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1]])
    lines = count(text[ends_line])
    columns = {
        "words": np.log1p(words),
        "word_length": _share(solid, words),
        "longest_word": np.log1p(longest),
        "upper": _share(upper, upper + lower),
        "capitals": _share(count(text, kind[starts] == 0), words),
        "digits": _share(digits, solid),
        "plain_signs": _share(plain, solid),
        "odd_signs": _share(odd, solid),
        "letters": _share(upper + lower + wide, solid + spaces),
        "not_ascii": _share(wide, solid),
        "no_letter": _share(count(text, ~has_letter), words),
        "ends_sentence": _share(count(text, _ENDS[last]), words),
        "ends_oddly": _share(count(text, _KIND[last] == 4), words),
        "same_as_before": _share(count(text, before), words),
        "distinct": _share(distinct, words),
        "commonest": _share(commonest, words),
        "distinct_threes": _share(_distinct(*threes, n)[0], count(threes[1])),
        "distinct_eights": _share(_distinct(*eights, n)[0], count(eights[1])),
        "line_words": np.log1p(_share(words, lines)),
        "lines_ending": _share(count(text, ends_line & _ENDS[last]), lines),
    }
    for j, name in enumerate(FEATURES):
        out[:, j] = columns[name]
    return out


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id`` and ``x``, the values of ``FEATURES``; written once under the shared folder."""
    bounded_batches(docs.sparkSession)
    rows = only(docs, doc_id=doc_id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            parts = [
                measurements(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, _CHUNK)
            ]
            flat = np.concatenate([p.ravel() for p in parts]) if parts else np.zeros(0)
            ends = np.arange(len(batch) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "x"])

    return settle(rows.mapInArrow(run, result(rows, ["doc_id"], "x array<double>")), "measured")


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain of the best cut of a row of bins in two, and the last bin on its left; -1 if none gains."""
    gs, hs = np.cumsum(g), np.cumsum(h)
    left, right = gs[:-1] ** 2 / (hs[:-1] + SMOOTH), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + SMOOTH)
    if not len(left):
        return 0.0, -1
    gain = left + right - gs[-1] ** 2 / (hs[-1] + SMOOTH)
    at = int(gain.argmax())
    return (float(gain[at]), at) if gain[at] > 1e-9 else (0.0, -1)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of depth two over a row of bins, from their gradients and weights."""
    out = np.zeros(len(g))
    _, at = _cut(g, h)
    edges = [0, len(g)] if at < 0 else [0, at + 1, len(g)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        _, inner = _cut(g[a:b], h[a:b])
        for c, d in [(a, b)] if inner < 0 else [(a, a + inner + 1), (a + inner + 1, b)]:
            out[c:d] = g[c:d].sum() / (h[c:d].sum() + SMOOTH)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree over a grid of bins: one cut of one axis, then one of the other on each side."""
    best, values = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        gs, hs = (g.T, h.T) if turned else (g, h)
        for at in range(gs.shape[0] - 1):
            gain, made = 0.0, np.zeros(gs.shape)
            for side in (slice(0, at + 1), slice(at + 1, None)):
                row_g, row_h = gs[side].sum(axis=0), hs[side].sum(axis=0)
                _, inner = _cut(row_g, row_h)
                for part in [slice(None)] if inner < 0 else [slice(0, inner + 1), slice(inner + 1, None)]:
                    sum_g, sum_h = row_g[part].sum(), row_h[part].sum()
                    gain += sum_g**2 / (sum_h + SMOOTH)
                    made[side, part] = sum_g / (sum_h + SMOOTH)
            gain -= g.sum() ** 2 / (h.sum() + SMOOTH)
            if gain > best:
                best, values = gain, made.T if turned else made
    return best, values


@dataclass
class Model:
    """Lookup tables of log odds; small and picklable."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)  # per feature, upper borders of its bins but the last
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        """Learn from rows of features and labels 0 and 1; every fifth row only tells when to stop."""
        if not len(y):
            return self
        share = float(y.mean())
        if not 0 < share < 1:
            self.start = np.inf if share else -np.inf
            return self
        unseen = np.arange(len(y)) % 5 == 4
        self.start = float(np.log(share / (1 - share)))
        self.edges = [_edges(column, BINS) for column in x.T]
        self.pair_edges = [_edges(column, PAIR_BINS) for column in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        bins = _binned(x, self.edges)
        sums = np.full(len(y), self.start)
        # A table per feature.
        shapes = [(len(t),) for t in self.tables]
        self.tables, sums = _boosted(bins, shapes, y, unseen, sums, lambda g, h: shallow_tree(g, h))
        # Then a table per pair, for the pairs that one tree would gain most with.
        cells = _binned(x, self.pair_edges)
        p = 1 / (1 + np.exp(-sums))
        g, h = np.where(unseen, 0, y - p), np.where(unseen, 0, p * (1 - p))
        gains = []
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                shape = (len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1)
                cell = cells[i] * shape[1] + cells[j]
                grids = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))
                gains.append((-pair_tree(*grids)[0], i, j))
        chosen = [(i, j) for gain, i, j in sorted(gains)[:PAIRS] if gain < 0]
        shapes = [(len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1) for i, j in chosen]
        cells = [cells[i] * shape[1] + cells[j] for (i, j), shape in zip(chosen, shapes, strict=True)]
        tables, _ = _boosted(cells, shapes, y, unseen, sums, lambda g, h: pair_tree(g, h)[1])
        self.pairs = dict(zip(chosen, tables, strict=True))
        return self

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Log odds that each table adds for each row: features first, then pairs."""
        out = np.zeros((len(x), len(self.tables) + len(self.pairs)))
        for j, (table, own) in enumerate(zip(self.tables, _binned(x, self.edges), strict=True)):
            out[:, j] = table[own]
        cells = _binned(x, self.pair_edges)
        for k, ((i, j), table) in enumerate(self.pairs.items()):
            out[:, len(self.tables) + k] = table[cells[i], cells[j]]
        return out

    def scores(self, parts: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(self.start + parts.sum(axis=1))))

    def names(self) -> list[str]:
        """Names of the tables, in the order of ``parts``."""
        return [*FEATURES[: len(self.tables)], *(f"{FEATURES[i]} x {FEATURES[j]}" for i, j in self.pairs)]

    def terms(self) -> list[tuple[str, float, float, float]]:
        """Every entry of the features' tables: feature, values above, values up to, log odds."""
        out = []
        for name, edges, table in zip(FEATURES, self.edges, self.tables, strict=False):
            borders = [-np.inf, *edges.tolist(), np.inf]
            out += [(name, *ends, float(v)) for *ends, v in zip(borders[:-1], borders[1:], table, strict=True)]
        return out


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
    return [np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=False)]


def _boosted(cells: list[np.ndarray], shapes: list[tuple], y: np.ndarray, unseen: np.ndarray, sums: np.ndarray, grow):
    """Tables grown in turns, and the examples' sums with them, as of the round that did best on unseen examples."""
    tables = [np.zeros(shape) for shape in shapes]
    sums, size = sums.copy(), [int(np.prod(shape)) for shape in shapes]
    best, kept, since = np.inf, ([t.copy() for t in tables], sums.copy()), 0
    for _ in range(ROUNDS if tables else 0):
        for k, cell in enumerate(cells):
            p = 1 / (1 + np.exp(-sums))
            g = np.bincount(cell, np.where(unseen, 0, y - p), size[k]).reshape(shapes[k])
            h = np.bincount(cell, np.where(unseen, 0, p * (1 - p)), size[k]).reshape(shapes[k])
            step = RATE * grow(g, h)
            tables[k] += step
            sums += step.ravel()[cell]
        margin = np.where(y[unseen] == 1, -sums[unseen], sums[unseen])
        loss = float(np.logaddexp(0, margin).mean()) if unseen.any() else 0.0
        if loss < best - 1e-6:
            best, kept, since = loss, ([t.copy() for t in tables], sums.copy()), 0
        elif (since := since + 1) >= PATIENCE:
            break
    return kept


def learn(
    measures: DataFrame,
    labels: DataFrame,
    may_teach: Column | None = None,
    label: str = "quality",
    doc_id: str = "doc_id",
    examples: int = EXAMPLES,
) -> Model:
    """Tables learned from labelled measurements; ``may_teach`` is a condition on ``doc_id``.

    The labels of about ``examples`` ids are broadcast, and about that many rows reach the driver.
    """
    known = only(labels, doc_id=doc_id, label=label).where("doc_id is not null and label in (0, 1)")
    if may_teach is not None:
        known = known.where(may_teach)
    known = known.select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    n = known.count()
    known = known.where(_drawn(examples / max(n, 1), "doc_id"))
    lessons = measures.join(F.broadcast(known), "doc_id").select("doc_id", "label", "x").distinct()
    lessons = settle(lessons, "lessons")
    # An id may have had many texts.
    n = lessons.count()
    got = lessons.where(_drawn(examples / max(n, 1), "doc_id", "x")).select("label", "x", F.xxhash64("x", "doc_id").alias("place"))
    got = got.toArrow().sort_by("place")
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(len(got), len(FEATURES))
    return Model().fit(x, got["label"].to_numpy().astype(float))


def _drawn(share: float, *columns: str) -> Column:
    """Whether a row is one of a hash sample of this share; a share of one or more takes all."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 30) - 1)) < min(1 << 30, int(share * (1 << 30)))


def scored(measures: DataFrame, model: Model) -> DataFrame:
    """Per measured document: ``doc_id``, ``score`` (0 to 1), ``predicted`` (0 or 1), ``weakest``: the table that costs most."""
    shared = measures.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.asarray([*model.names(), None], object)
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(len(batch), len(FEATURES))
            parts = model.parts(x)
            score = model.scores(parts)
            least = parts.argmin(axis=1) if parts.shape[1] else np.full(len(x), -1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(score),
                    pa.array((score >= 0.5).astype(np.int32)),
                    pa.array(names[least], pa.string()),
                ],
                names=["doc_id", "score", "predicted", "weakest"],
            )

    rows = measures.select("doc_id", "x")
    return rows.mapInArrow(run, result(rows, ["doc_id"], "score double, predicted int, weakest string"))
