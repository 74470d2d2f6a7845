"""Benchmark decontamination: BM25 with block maxima, then overlap of question and answer.

The test items are the index, every training passage is a query. A term's impact on an item is its BM25
weight there as a share of what the whole item would score, so that a score says how much of the item the
passage covers, and one threshold suits all items. Items are indexed in blocks, with the greatest impact of
each term per block. The skipping of block-max WAND is done for a batch of passages at a time, in arrays: a block
whose maxima cannot reach the threshold together is skipped, and in the others postings are scored exactly. No
cursors move from pivot to pivot. Nothing above the threshold is lost.

How many items there are, their mean length and the items that have a word are counted once over all items. Many
items lie in several indexes; each takes these totals, so that a score does not depend on what shares an index.

A hit is confirmed if the passage holds most of the item's question and most of its answer, each as a share
of its distinct five-word shingles. The answer is the item's last sentence, the question all before; an item of one sentence
is cut in the middle. As one changed word takes up to five shingles, a half that falls short is aligned with the
passage word by word, too: words put in, left out or replaced count as missing. It may miss as large a share of its words
as of its shingles, and at least one word if it has three; both halves together no larger share of the item's words.
So an item of at least five words, none of whose halves is shorter than three, is found with any one word changed.

A document is one passage, or overlapping windows of words if it is long: every stretch as long as the longest
item, and a quarter more, lies wholly in one of them. Windows cover the whole text.

Words are stretches of letters and digits, case ignored. Defined results: documents that are null, empty or
without words hit nothing; items without words are not indexed; items shorter than a shingle count as one.
Repeated rows give repeated hits. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from burnish.llm.common import Words, bounded_batches, mixed, only, result, slices, utf8
from burnish.session import settle

SHINGLE, OVERLAP = 5, 0.8
COVERED = 0.6  # least BM25 share of an item that a passage must cover
K1, B = 1.2, 0.75
ITEM_BLOCK = 8
WINDOW = 512  # words of a passage, at least two and a half times the longest item
INDEX_BYTES = 4 << 20  # text of the items in one index; more items take several passes
SCORES = "score double, question_overlap double, answer_overlap double"
_CHUNK = 1 << 20
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


def halves(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    parts = [p for p in _SENTENCE.split(text) if re.search(r"[^\W_]", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    middle = (len(words) + 1) // 2
    return (" ".join(words[:middle]), " ".join(words[middle:])) if len(words) > 1 else (text, text)


def word_hashes(strings: list[str]) -> Words:
    return Words(*utf8(pa.array([s.lower() for s in strings], pa.string())), spaced=False)


def distinct_shingles(strings: list[str]) -> list[np.ndarray]:
    hashes, text = word_hashes(strings).shingles(SHINGLE)
    return [np.unique(hashes[text == i]) for i in range(len(strings))]


def edits(part: np.ndarray, passage: np.ndarray) -> int:
    """Least number of words put in, left out or replaced that make ``part`` of some stretch of the passage."""
    place = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    for i, word in enumerate(part):
        down = row + 1
        down[1:] = np.minimum(down[1:], row[:-1] + (passage != word))
        down[0] = i + 1
        row = np.minimum.accumulate(down - place) + place
    return int(row.min())


@dataclass
class Postings:
    """For each term, a run of places and weights."""

    starts: np.ndarray
    places: np.ndarray
    weights: np.ndarray

    def expand(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all postings of the terms: number of the term in ``terms``, and place in the lists."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        owner = np.repeat(np.arange(len(terms)), sizes)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return owner, self.starts[terms][owner] + within


@dataclass
class Totals:
    """Statistics of all items: how many have words, their mean length, and the items that have each term (sorted)."""

    items: int
    length: float
    terms: np.ndarray
    holding: np.ndarray


class Index:
    """Inverted index of test items with impacts and block maxima; without ``totals`` these items are all there are."""

    def __init__(self, ids: list, items: list[str], totals: Totals | None = None) -> None:
        split = [halves(t) for t in items]
        words = word_hashes(items)
        some = np.unique(words.text)
        self.ids = [ids[i] for i in some]
        self.questions = distinct_shingles([split[i][0] for i in some])
        self.answers = distinct_shingles([split[i][1] for i in some])
        self.sequences = [self._sequences(split[i]) for i in some]
        # Without words in one half the other one decides.
        for i, (q, a) in enumerate(zip(self.questions, self.answers, strict=True)):
            self.questions[i], self.answers[i] = (q if len(q) else a), (a if len(a) else q)
        item = np.searchsorted(some, words.text)
        n = len(some)
        lengths = np.bincount(item, minlength=n)
        self.longest = int(lengths.max(initial=0))
        self.terms, term = np.unique(words.hashes, return_inverse=True)
        pair, tf = np.unique(term * max(n, 1) + item, return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        if totals is None:
            totals = Totals(n, float(lengths.mean()) if n else 0.0, self.terms, np.bincount(term, minlength=len(self.terms)))
        df = totals.holding[np.searchsorted(totals.terms, self.terms)]
        idf = np.log1p((totals.items - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / max(totals.length, 1)))
        weight /= np.bincount(item, weight, n)[item] if n else 1
        starts = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.postings = Postings(starts, item, weight)
        self.blocks = -(-n // ITEM_BLOCK)
        cell = term * max(self.blocks, 1) + item // ITEM_BLOCK
        cells, at = np.unique(cell, return_inverse=True)
        most = np.zeros(len(cells))
        np.maximum.at(most, at, weight)
        owner = cells // max(self.blocks, 1)
        self.maxima = Postings(np.searchsorted(owner, np.arange(len(self.terms) + 1)), cells % max(self.blocks, 1), most)

    @staticmethod
    def _sequences(split: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of question and answer in order; of one that has none, the other's."""
        words = word_hashes(list(split))
        q, a = words.hashes[words.text == 0], words.hashes[words.text == 1]
        return (q if len(q) else a), (a if len(a) else q)

    def held(self, item: int, passage: np.ndarray, shingles: np.ndarray, overlap: float) -> tuple[float, float] | None:
        """Shares of question and answer in the passage (its words in order, and their shingles); None: not confirmed."""
        shares, sizes, allowed = [], [], []
        for half, words in zip((self.questions[item], self.answers[item]), self.sequences[item], strict=True):
            shares.append(float(np.isin(half, shingles).mean()))
            sizes.append(len(words))
            allowed.append(max((1 - overlap) * len(words), 1.0 if len(words) > 2 else 0.0) + 1e-9)
        if min(shares) >= overlap:
            return shares[0], shares[1]
        # Words the passage lacks are edits at least: most pairs end here.
        low = [j for j in (0, 1) if shares[j] < overlap]
        if any(np.count_nonzero(~np.isin(self.sequences[item][j], passage)) > allowed[j] for j in low):
            return None
        for j in low:
            missing = edits(self.sequences[item][j], passage)
            if missing > allowed[j]:
                return None
            shares[j] = max(shares[j], 1 - missing / sizes[j])
        if sum((1 - shares[j]) * sizes[j] for j in (0, 1)) > (1 - overlap) * sum(sizes) + 1e-9:
            return None
        return shares[0], shares[1]

    def term_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word's term, -1 if it is in no item."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        slot = self._slots()[(hashes >> np.uint64(44)).astype(np.int64)]
        late = np.flatnonzero((slot >= 0) & (self.terms[slot] != hashes))
        at = np.minimum(np.searchsorted(self.terms, hashes[late]), len(self.terms) - 1)
        slot[late] = np.where(self.terms[at] == hashes[late], at, -1)
        return slot

    def _slots(self) -> np.ndarray:
        """First try by the upper 20 bits of the hash: the last term that has them, -1 for none."""
        if "_table" not in self.__dict__:
            self._table = np.full(1 << 20, -1, np.int64)
            self._table[(self.terms >> np.uint64(44)).astype(np.int64)] = np.arange(len(self.terms))
        return self._table

    def hits(self, passage: np.ndarray, term: np.ndarray, n: int, covered: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, item and score of all pairs that reach ``covered``; the pairs (passage, term) are distinct and sorted."""
        owner, at = self.maxima.expand(term)
        bound = np.bincount(passage[owner] * self.blocks + self.maxima.places[at], self.maxima.weights[at], n * self.blocks)
        open_blocks = bound >= covered - 1e-9
        busy = open_blocks.reshape(n, self.blocks).any(axis=1)[passage]
        passage, term = passage[busy], term[busy]
        owner, at = self.postings.expand(term)
        item = self.postings.places[at]
        kept = open_blocks[passage[owner] * self.blocks + item // ITEM_BLOCK]
        pair = passage[owner][kept] * len(self.ids) + item[kept]
        pairs, place = np.unique(pair, return_inverse=True)
        score = np.bincount(place, self.postings.weights[at[kept]], len(pairs))
        good = score >= covered - 1e-9
        return pairs[good] // len(self.ids), pairs[good] % len(self.ids), score[good]

    def search(self, data: np.ndarray, offsets: np.ndarray, covered: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """Confirmed hits: text, item, score, question's and answer's share; the best passage of a text counts."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for first, last in slices(offsets, _CHUNK):
            own = offsets[first : last + 1]
            words = Words(data[own[0] : own[-1]], own - own[0], spaced=False)
            if not len(words.text) or not self.ids:
                continue
            terms = self.term_numbers(words.hashes)
            window = max(WINDOW, 5 * self.longest // 2 + 1)
            step = window // 2
            counts = np.bincount(words.text, minlength=last - first)
            begins = np.cumsum(counts) - counts
            # Windows of each text: the last one ends with the text.
            many = np.maximum(1, -(-(counts - window) // step) + 1)
            text = np.repeat(np.arange(last - first), many)
            number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
            left = begins[text] + number * step
            right = np.minimum(left + window, begins[text] + counts[text])
            known = np.flatnonzero(terms >= 0)
            a, b = np.searchsorted(known, left), np.searchsorted(known, right)
            passage = np.repeat(np.arange(len(text)), b - a)
            inside = np.arange(len(passage)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
            pair = np.unique(passage * len(self.terms) + terms[known[a[passage] + inside]])
            found = self.hits(pair // len(self.terms), pair % len(self.terms), len(text), covered)
            shingles: dict[int, np.ndarray] = {}
            for p, item, score in zip(*found, strict=True):
                if p not in shingles:
                    part = Words.__new__(Words)
                    part.hashes, part.text = words.hashes[left[p] : right[p]], np.zeros(right[p] - left[p], np.int64)
                    shingles[p] = np.concatenate([part.shingles(min(SHINGLE, len(part.hashes)))[0], self._short(part.hashes)])
                if shares := self.held(item, words.hashes[left[p] : right[p]], shingles[p], overlap):
                    key = first + int(text[p]), int(item)
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (float(score), *shares))
        return [(*key, *values) for key, values in sorted(best.items())]

    @staticmethod
    def _short(hashes: np.ndarray) -> np.ndarray:
        """Shingles of one to four words, for the halves of items that are no longer than that."""
        out = []
        for size in range(1, SHINGLE):
            if len(hashes) >= size:
                whole = np.full(len(hashes) - size + 1, size, np.uint64)
                for j in range(size):
                    whole = mixed(whole) + hashes[j : len(hashes) - size + 1 + j]
                out.append(mixed(whole))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", most: int | None = None) -> Iterator[Index]:
    """Indexes of all test items: one for every ``most`` bytes of their text, about. Each takes a pass over the documents.

    Spark counts the totals over all items. The driver holds one index at a time, with the counts of its own terms.
    """
    bounded_batches(items.sparkSession)
    rows = only(items, item_id=item_id, text=text).where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = word_hashes(batch.column(1).to_pylist())
            own = np.split(words.hashes.view(np.int64), np.searchsorted(words.text, np.arange(1, len(batch))))
            terms = pa.array([np.unique(w) for w in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(w) for w in own], pa.int64()), terms], names=["item_id", "text", "words", "terms"]
            )

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (most or INDEX_BYTES)))
    counted = rows.mapInArrow(count, result(rows, ["item_id", "text"], "words long, terms array<long>"))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    counted = settle(counted.where("words > 0").withColumn("part", part), "items")
    n, words = counted.agg(F.count("*"), F.sum("words")).first()
    spread = counted.select("part", F.explode("terms").alias("term"))
    holding = settle(spread.groupBy("term").agg(F.count("*").alias("n")), "terms")
    for i in range(parts):
        own = spread.where(F.col("part") == i).select("term").distinct().join(holding, "term").toArrow()
        terms = own["term"].to_numpy().view(np.uint64)
        order = np.argsort(terms)
        totals = Totals(n, (words or 0) / max(n, 1), terms[order], own["n"].to_numpy()[order])
        got = counted.where(F.col("part") == i).select("item_id", "text").collect()
        yield Index([r["item_id"] for r in got], [r["text"] for r in got], totals)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    covered: float = COVERED,
    overlap: float = OVERLAP,
) -> DataFrame:
    """Confirmed hits: ``doc_id``, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``.

    Of several passages of a document that hit an item, the best counts.
    """
    spark = bounded_batches(docs.sparkSession)
    rows = only(docs, doc_id=doc_id, text=text).select("doc_id", F.lower("text").alias("text"))
    item = T.StructField("item_id", only(items, item_id="item_id").schema["item_id"].dataType)
    shape = T.StructType([rows.schema["doc_id"], item, *T.StructType.fromDDL(SCORES).fields])
    ids = to_arrow_type(item.dataType)

    def one_pass(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = index.search(*utf8(batch.column(1)), covered, overlap)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                            pa.array([index.ids[f[1]] for f in found], ids),
                            *(pa.array([f[j] for f in found], pa.float64()) for j in (2, 3, 4)),
                        ],
                        names=shape.names,
                    )

        return rows.mapInArrow(run, shape)

    passes = [one_pass(spark.sparkContext.broadcast(index)) for index in indexes(items)]
    return reduce(DataFrame.unionByName, passes)


def flagged(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    covered: float = COVERED,
    overlap: float = OVERLAP,
) -> DataFrame:
    """Every document: ``doc_id`` and ``hits``, the number of items confirmed in it. No shuffle."""
    spark = bounded_batches(docs.sparkSession)
    rows = only(docs, doc_id=doc_id, text=text)
    rows = rows.select("doc_id", F.lower("text").alias("text"), F.lit(0).cast("long").alias("hits"))

    def one_pass(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = np.asarray([f[0] for f in index.search(*utf8(batch.column(1)), covered, overlap)], np.int64)
                hits = batch.column(2).to_numpy() + np.bincount(found, minlength=len(batch))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(hits)], names=["doc_id", "text", "hits"])

        return rows.mapInArrow(run, rows.schema)

    for index in indexes(items):
        rows = one_pass(rows, spark.sparkContext.broadcast(index))
    return rows.select("doc_id", "hits")
