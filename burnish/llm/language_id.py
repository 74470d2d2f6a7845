"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts, 0 to ``order`` bytes long, with the counts of the bytes
seen after them. The probability of a byte is n / (N + q) in the longest context it was seen in
(n: its count, N: all counts, q: distinct bytes of the context), times q / (N + q) for each longer
known context it was not seen in: the escapes of method C, without exclusions. Below the empty context
all 256 bytes are alike. Statistics are frozen after training, so a text's code length is a plain sum.

Training: the counts of all labelled documents. A language with more text than ``sample_bytes`` takes part
with a hash sample of passages that holds about as much; passages are cut over the whole text of every
document, so long and short documents teach alike, by their bytes. This bound is the only sample; every text
is scored whole.

The score is the posterior of the best language among the learned ones, all equally likely before.

Defined results: ``und`` and score 0 for a null or empty text, one without a letter, or if nothing was
learned. Equal code lengths go to the language first in the alphabet. Documents with a null ``lang`` or
text teach nothing. ``ValueError`` for more than ``LANGUAGES`` languages. Rows repeat as given; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import Lookup, bounded_batches, grams, only, result, slices, utf8

UNDETERMINED = "und"
ORDER = 3
SAMPLE_BYTES = 6 << 20  # text a language is learned from, about
LANGUAGES = 1000  # learned together, at most
PASSAGE_BYTES = 4 << 10  # of a passage; fewer for small samples, so that a sample has a thousand at least
_CHUNK = 1 << 20


class Trees:
    """Frozen code lengths, in bits, of all languages."""

    def __init__(self, languages: list[str], order: int, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``counts``: per language the distinct grams of the highest order, sorted, and how often each came."""
        self.languages, self.order = languages, order
        self.lookups: list[Lookup] = []  # of the grams of each order
        self.costs: list[np.ndarray] = []  # gram, language
        self.contexts: list[Lookup] = []
        self.escapes: list[np.ndarray] = []
        for k in range(order + 1):
            own = [self._of_order(g, n, order, k) for g, n in counts]
            every = np.unique(np.concatenate([g for g, _ in own])) if own else np.zeros(0, np.uint32)
            above = np.unique(every >> np.uint32(8))
            cost = np.empty((len(every), len(languages)), np.float32)
            escape = np.zeros((len(above), len(languages)), np.float32)
            lower = self.bits(every & np.uint32((1 << 8 * k) - 1), k - 1)
            for j, (g, n) in enumerate(own):
                context, at, distinct = np.unique(g >> np.uint32(8), return_inverse=True, return_counts=True)
                total = np.bincount(at, n, len(context)) + distinct
                escape[np.searchsorted(above, context), j] = np.log2(total / distinct)
                cost[:, j] = lower[:, j] + escape[np.searchsorted(above, every >> np.uint32(8)), j]
                cost[np.searchsorted(every, g), j] = np.log2(total[at] / n)
            self.lookups.append(Lookup(every))
            self.costs.append(cost)
            self.contexts.append(Lookup(above))
            self.escapes.append(escape)

    @staticmethod
    def _of_order(g: np.ndarray, n: np.ndarray, order: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        short, at = np.unique(g & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
        return short, np.bincount(at, n, len(short))

    def bits(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Code length of each gram's last byte in each language, from order ``k`` down."""
        if k < 0:
            return np.full((len(grams), len(self.languages)), 8.0, np.float32)
        rows = self.lookups[k](grams)
        out = self.costs[k][rows]
        new = np.flatnonzero(rows < 0)
        if len(new):
            context = self.contexts[k](grams[new] >> np.uint32(8))
            lower = self.bits(grams[new] & np.uint32((1 << 8 * k) - 1), k - 1)
            out[new] = lower + np.where(context[:, None] >= 0, self.escapes[k][context], np.float32(0))
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for first, last in slices(offsets, _CHUNK):
            own = offsets[first : last + 1]
            ends = own - own[0]
            packed = grams(data[own[0] : own[-1]], ends, self.order)
            filled = np.flatnonzero(np.diff(ends))
            for a in range(0, len(packed), 4 * _CHUNK):  # a single long text in parts
                part = self.bits(packed[a : a + 4 * _CHUNK], self.order)
                inside = filled[(ends[filled] < a + len(part)) & (ends[filled + 1] > a)]
                out[first + inside] += np.add.reduceat(part, np.maximum(ends[inside] - a, 0), axis=0, dtype=np.float64)
        return out


def drawn_grams(data: np.ndarray, offsets: np.ndarray, drawn: list[list[int] | None], step: int, order: int) -> np.ndarray:
    """Grams of the bytes of the drawn passages, each ``step`` bytes long, or of the whole text where that is None."""
    spans = []  # first byte with its context, first byte, end
    for at, end, numbers in zip(offsets[:-1].tolist(), offsets[1:].tolist(), drawn, strict=True):
        if numbers is None:
            spans.append((at, at, end))
        else:
            spans += [(at + max(0, i * step - order), at + i * step, min(end, at + (i + 1) * step)) for i in numbers]
    if not spans:
        return np.zeros(0, np.uint32)
    lengths = np.array([end - start for start, _, end in spans], np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    packed = grams(np.concatenate([data[start:end] for start, _, end in spans]), ends, order)
    keep = np.ones(len(packed), bool)
    for place, (start, first, _) in zip(ends.tolist(), spans, strict=False):
        keep[place : place + first - start] = False  # counted with the passage before, if that is drawn
    return packed[keep]


def learn(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = ORDER,
    sample_bytes: int = SAMPLE_BYTES,
) -> Trees:
    """Context trees of the labelled documents; ``docs`` are those that may be learned from.

    Counting runs on Spark. The driver gets one row per language, then the distinct grams of the
    sample: at most ``sample_bytes`` per language, about, however large the input is.
    """
    bounded_batches(docs.sparkSession)
    own = only(docs, text=text, lang=lang, doc_id=doc_id).where("text is not null and lang is not null")
    sizes = {r[0]: r[1] or 0 for r in own.groupBy("lang").agg(F.sum(F.octet_length("text"))).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: the trees of all are broadcast together")
    large = {name: sample_bytes / size for name, size in sizes.items() if size > sample_bytes}
    step = max(order + 1, min(PASSAGE_BYTES, sample_bytes >> 10))
    drawn = F.lit(None).cast("array<int>")
    if large:
        share = F.create_map(*(F.lit(x) for pair in large.items() for x in pair))[F.col("lang")]
        size = F.octet_length("text")
        # Numbers of the drawn passages. Length and beginning tell documents without an id apart.
        own_hash = F.xxhash64("doc_id", size, F.substring("text", 1, 64))
        last = F.floor(F.greatest(size - 1, F.lit(0)) / step).cast("int")

        def is_drawn(number: Column) -> Column:
            return F.xxhash64(own_hash, number).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30) < share

        drawn = F.when(share.isNotNull(), F.filter(F.sequence(F.lit(0), last), is_drawn))
    own = own.select("text", "lang", drawn.alias("drawn")).where("drawn is null or size(drawn) > 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.asarray(batch.column(1).to_pylist(), object)
            for name in sorted(set(names)):
                part = batch.filter(pa.array(names == name))
                packed = drawn_grams(*utf8(part.column(0)), part.column(2).to_pylist(), step, order)
                found, n = np.unique(packed, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    counted = own.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
    at = np.asarray(counted["lang"].to_pylist(), object)
    gram, n = counted["gram"].to_numpy().astype(np.uint32), counted["n"].to_numpy()
    names = sorted(name for name in sizes if (at == name).any())
    return Trees(names, order, [(gram[at == name], n[at == name]) for name in names])


def identified(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``lang_pred``, ``score``, ``bits_per_byte`` (of the predicted language).

    The trees are broadcast; the sample bounds their size.
    """
    spark = bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(trees)
    # Without letters there is nothing to score: such texts do not go to Python.
    rows = only(docs, doc_id=doc_id, text=text).select(
        "doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            sizes = np.diff(offsets)
            n = len(sizes)
            best, score, bits = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            known = sizes > 0
            if trees.languages and n:
                lengths = trees.lengths(data, offsets)
                best = lengths.argmin(axis=1)
                least = lengths[np.arange(n), best]
                score = 1 / np.exp2(np.minimum(least[:, None] - lengths, 0)).sum(axis=1)
                bits = least / np.maximum(sizes, 1)
            else:
                known &= False
            names = np.asarray([*trees.languages, UNDETERMINED], object)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(names[np.where(known, best, len(names) - 1)], pa.string()),
                    pa.array(np.where(known, score, 0.0)),
                    pa.array(np.where(known, bits, 0.0)),
                ],
                names=["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    return rows.mapInArrow(run, result(rows, ["doc_id"], "lang_pred string, score double, bits_per_byte double"))
