"""Near-duplicate documents by SetSketch registers, joint likelihood and exact verification.

A document is its set of distinct word shingles. Its sketch has registers of exponentially spaced,
truncated minima: register i is floor(1 - log_b x), where x is the least of the elements' exponentially
distributed values of hash function i, cut off at both ends. Registers merge by maximum and two sets
agree in one with a probability close to their similarity.

1. Documents with the same set are one class, told by its set. From here on one row of a class counts, and the text
   that row had, whatever other texts its id may have.
2. The registers are cut into bands. Classes that agree in all registers of a band share a bucket.
   Buckets chain classes into candidate groups.
3. Within a group all pairs that can be similar are looked at, without writing them out: the joint
   likelihood of both sketches and set sizes gives an estimate, and pairs with an estimate not far below
   the threshold are compared on their full sets. Pairs already connected need no comparison. What is
   written is a spanning forest of confirmed links.
4. Connected components of the forest are the result.

Large groups are cut into chunks of bounded size by set size and hash, and each chunk meets each chunk
with fitting set sizes in a task of its own: no task holds a group, no pair is left out.

Recall: a pair at the threshold shares no band with probability (1 - s**ROWS)**BANDS, for s = 0.8 about
6e-5, for 0.85 about 2e-7, and a similar pair is mostly linked through others besides. The estimate is off
by more than MARGIN about once in 10**9 pairs.

Defined results: texts that are null or have no words have an empty set and are linked with nothing, not even
with each other. Texts with fewer words than a shingle are one shingle. Words are what stands between ASCII
white space, with A-Z as a-z. Repeated rows repeat in the result; rows with the same id and different texts are
compared each for its own text, and each gets the least id that text reaches. A null id is linked with nothing.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import Words, bounded_batches, mixed, only, result, slices, utf8
from burnish.llm.components import components
from burnish.session import settle

BANDS, ROWS = 32, 6
BASE = 1.001  # spacing of register values
LIMIT = (1 << 16) - 2  # greatest register value but one
MARGIN = 0.16  # estimates this far below the threshold are still compared exactly
CHUNK_SHINGLES = 1 << 14  # shingles of one chunk of a large group, about, and its classes
_REGISTERS = BANDS * ROWS
CHUNK_CLASSES = 256
_STEP = 1 << 20
_PAIRS = 1 << 15

_factors = mixed(np.arange(1, _REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E6C63D0676A9A99))
FACTORS = (_factors >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
SHIFTS = (_factors & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within a text, and where each text's begin."""
    hashes, text = Words(data, offsets, spaced=True).shingles(k)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[fresh], text[fresh]
    return hashes, np.searchsorted(text, np.arange(len(offsets)))


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch of each set: one row of registers; zeros for an empty set."""
    sets = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(starts) - 1, _REGISTERS), np.uint16)
    if not len(sets):
        return out
    # The least hash gives the least exponential value: one transform per register, not per element.
    low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(sets), _REGISTERS), np.uint32)
    for i in range(_REGISTERS):
        x = low * FACTORS[i] + SHIFTS[i]
        x ^= x >> np.uint32(15)
        x += high * FACTORS[-1 - i]
        x *= np.uint32(0x2C1B3C6D)
        least[:, i] = np.minimum.reduceat(x, starts[sets])
    x = -np.log1p(-(least + 0.5) / 2.0**32)
    # Values shrink with the set's size; the middle of the range suits sets of about a thousand.
    value = np.floor(1 - np.log(x) / np.log(BASE)) + LIMIT // 4
    out[sets] = np.clip(value, 0, LIMIT + 1)
    return out


def estimates(ones: np.ndarray, others: np.ndarray, size: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sets, from registers and set sizes together."""
    greater, less = (others < ones).sum(1), (others > ones).sum(1)
    equal = ones.shape[1] - greater - less
    u, v = size / (size + sizes), sizes / (size + sizes)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return greater * np.log(a) + less * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    for _ in range(14):  # golden section down to a thousandth; the likelihood has one peak
        m, n = high - 0.618 * (high - low), low + 0.618 * (high - low)
        left = likelihood(m) > likelihood(n)
        high, low = np.where(left, n, high), np.where(left, low, m)
    return (low + high) / 2


class Forest:
    """Union-find over the documents of a task."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.root(i), self.root(j)))
        self.up[j] = i


def confirmed(sets: list[np.ndarray], sketches: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among the sets; sets of one side meet those of the other, or all if there is one side."""
    sizes = np.asarray([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    # Each set with those at least as large, and small enough for the threshold.
    last = np.searchsorted(sizes[order], sizes[order] * 100 / percent + 1e-9, "right")
    pairs: list[tuple[float, int, int]] = []
    at = 0
    while at < len(order):
        many = np.maximum(np.cumsum(last[at:] - np.arange(at, len(order)) - 1), 0)
        stop = at + max(1, int(np.searchsorted(many, _PAIRS)))
        n = last[at:stop] - np.arange(at, min(stop, len(order))) - 1
        first = np.repeat(np.arange(at, min(stop, len(order))), n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        i, j = order[first], order[second]
        if side.any():
            i, j = i[side[i] != side[j]], j[side[i] != side[j]]
        for a in range(0, len(i), _PAIRS):
            x, y = i[a : a + _PAIRS], j[a : a + _PAIRS]
            estimate = estimates(sketches[x], sketches[y], sizes[x], sizes[y])
            near = estimate >= percent / 100 - MARGIN
            pairs += zip((-estimate[near]).tolist(), x[near].tolist(), y[near].tolist(), strict=True)
        at = stop
    forest, links = Forest(len(sets)), []
    for _, i, j in sorted(pairs):  # likely links first: they spare the others a comparison
        if forest.root(i) != forest.root(j):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                forest.join(i, j)
                links.append((i, j))
    return links


_SKETCH = ["n_shingles", "set_a", "set_b", "bands"]


def sketched(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, two hashes of the whole set, and the hashes of the bands."""
    bounded_batches(docs.sparkSession)
    rows = only(docs, doc_id=doc_id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, last in slices(offsets, _STEP):
                own = offsets[first : last + 1]
                hashes, starts = shingle_sets(data[own[0] : own[-1]], own - own[0], k)
                found = registers(hashes, starts)
                n = np.diff(starts)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes + np.uint64(salt)))]) for salt in (1, 2)]
                whole = [(s[starts[1:]] - s[starts[:-1]]).view(np.int64) for s in sums]
                with np.errstate(over="ignore"):
                    words = found.astype(np.uint64).reshape(-1, BANDS, ROWS)
                    band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), words.shape[:2]).copy()
                    for j in range(ROWS):
                        band = mixed(band) + words[:, :, j]
                    band = mixed(band).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(n.astype(np.int64)), *map(pa.array, whole), flat],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return rows.mapInArrow(run, result(rows, ["doc_id"], "n_shingles long, set_a long, set_b long, bands array<long>"))


def groups(sketches: DataFrame) -> DataFrame:
    """``node`` and ``root``: classes, by their least document, that buckets chain together."""
    # Banding shuffles two numbers per class and band; buckets keep their least member only.
    banded = sketches.select("node", F.explode("bands").alias("bucket"))
    least = banded.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    least = settle(least.select(F.col("bucket").alias("of"), "b"), "buckets")
    links = banded.join(least, banded["bucket"] == least["of"]).select(F.col("node").alias("a"), "b")
    return components(links, "candidates")


def links_within(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links, a spanning forest of them, among classes of the same ``root``: ``a``, ``b``.

    ``members`` has ``node``, ``root``, ``n_shingles`` and ``text``.
    """
    parts = F.greatest(F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES), F.ceil(F.count("*") / CHUNK_CLASSES))
    totals = members.groupBy("root").agg(parts.alias("chunks")).select(F.col("root").alias("of"), "chunks")
    totals = settle(totals, "totals")
    sized = members.join(totals, members["root"] == totals["of"]).drop("of")
    # Chunks: by set size, so that only neighbouring sizes can be similar, then by hash.
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / float(-np.log(percent / 100 - 1e-9)))
    sized = sized.withColumn("size", F.when(F.col("chunks") > 1, size).otherwise(0))
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    # A class meets every chunk of its own and of both neighbouring sizes; the lesser chunk comes first.
    place = F.struct(F.col("size").cast("long").alias("s"), F.col("chunk").cast("long").alias("c"))
    sizes = F.when(F.col("chunks") > 1, F.array(*(F.col("size").cast("long") + d for d in (-1, 0, 1)))).otherwise(F.array(F.lit(0).cast("long")))
    met = sized.withColumn("own", place).withColumn("s", F.explode(sizes))
    met = met.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    other = F.struct("s", "c")
    met = met.select(
        "root",
        F.least("own", other).alias("one"),
        F.greatest("own", other).alias("two"),
        (F.col("own") > other).alias("side"),
        "node",
        "text",
    )

    def confirm(pair: pa.Table) -> pa.Table:
        node, side = pair["node"].to_numpy(), pair["side"].to_numpy().astype(int)
        hashes, starts = shingle_sets(*utf8(pair["text"]), k)
        sets = [hashes[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        one_chunk = pair["one"][0] == pair["two"][0]
        found = [] if not one_chunk and len(set(side)) < 2 else confirmed(sets, registers(hashes, starts), side, percent)
        return pa.table({"a": pa.array([node[i] for i, _ in found], pa.int64()), "b": pa.array([node[j] for _, j in found], pa.int64())})

    return met.groupBy("root", "one", "two").applyInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id`` (long), ``n_shingles``, ``component_id`` (least id reachable), ``kept``.

    Documents are linked if their sets of ``k``-word shingles have 100 * common >= ``percent`` * united.
    """
    rows = only(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    # The hash of the text tells the texts of one id apart; rows are numbered as they are written.
    rows = rows.select(F.struct("doc_id", F.xxhash64("text").alias("content")).alias("whose"), "text")
    sketches = sketched(rows, k, doc_id="whose").select("doc_id.*", *(c for c in _SKETCH)).withColumn("row", F.monotonically_increasing_id())
    sketches = settle(sketches, "sketches")
    whole = ("set_a", "set_b", "n_shingles")
    classes = sketches.where("n_shingles > 0 and doc_id is not null").groupBy(*whole)
    least = [F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.min_by("content", "doc_id").alias("content")]
    classes = settle(classes.agg(*least, F.any_value("bands").alias("bands")), "classes")
    chained = settle(groups(classes.select("node", "bands")), "chained")
    wanted = classes.select(F.col("node").alias("of"), "doc_id", "content", "n_shingles")
    wanted = settle(chained.join(wanted, chained["node"] == wanted["of"]).drop("of"), "wanted")
    # Texts are shuffled once, by id and hash, whatever the number of candidates: the plan is the same at every size.
    same = (F.col("whose.doc_id") == F.col("doc_id")) & (F.col("whose.content") == F.col("content"))
    members = rows.join(wanted.hint("merge"), same).select("node", "root", "n_shingles", "text")
    members = settle(members.dropDuplicates(["node"]), "members")
    found = settle(components(links_within(members, k, percent), "links"), "joined")
    own = classes.select(F.col("node").alias("of"), "doc_id")
    found = settle(found.join(own, found["node"] == own["of"]).select("node", "root", "doc_id"), "reached")
    named = settle(found.groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("component_id")), "components")
    found = found.join(named, found["root"] == named["of"]).select(F.col("node").alias("of"), "component_id")
    named = classes.select(*(F.col(c).alias(f"{c}_") for c in whole), F.col("doc_id").alias("least"), "node")
    named = named.join(found, named["node"] == found["of"], "left")
    named = settle(named.select(*(f"{c}_" for c in whole), F.coalesce("component_id", "least").alias("component_id")), "named")
    same = [sketches[c] == named[f"{c}_"] for c in whole]
    placed = sketches.drop("bands").join(named, same, "left")
    component = F.coalesce("component_id", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.equal_null(component, "doc_id").alias("kept"))
