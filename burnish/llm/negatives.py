"""Hard negatives by inner product, with angular triangle filtering.

Vectors become integers; a score is an inner product of integers. A few reference directions are chosen, and every
vector stores its angle to each and its norm. If two vectors stand at angles s and t to a reference, the angle
between them is at least |s - t| and at most s + t and 2 pi - s - t: each reference gives an interval for their
cosine, and the references' intervals are intersected. Times the norms, and rounded outwards by more than the
arithmetic can be off, that is an interval for the score.

Rows are sorted by label, nearest reference and angle to it, and cut into blocks, and these into windows of at most
``WINDOW`` rows of one label; blocks and windows know the least and greatest angle to each reference, and norm.
Windows whose score interval does not meet what is asked for are left out; the others get integer scores:

* positives: a window counts if its upper bound reaches the score that enough rows are proved to have;
* negatives: a window counts if its interval meets the scores allowed by some positive of the anchor.

Anchors are cut into blocks too. Blocks of anchors meet blocks of rows: for positives those that share a label, for
negatives those whose intervals allow it, decided from one row per block before any vector moves. No task holds more
than two blocks, whatever the size of a label. The reference directions come from a hash sample of about ``SAMPLE``
vectors; they decide how much is left out, never what is found.

Defined results: rows without an id or a label, with a null vector, or one holding a null, NaN or infinite component
take no part. Rows with the anchor's id are never its positives or negatives. Of vectors of different lengths the
shorter one counts as zero beyond its end. Ties go to the smaller id. A repeated row is a row of its own, an
anchor too if it is one. An anchor without positives, and a positive without negatives, give no row. ``ValueError``
where scores could leave 64-bit integers. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import bounded_batches, only
from burnish.llm.topk import quantised
from burnish.session import settle

REFERENCES = 16
SAMPLE = 4096  # vectors the reference directions are chosen from, about
ANCHOR_BLOCK, BLOCK, WINDOW = 256, 4096, 64  # rows, at most
SLACK = 1e-6  # radians; angles near 0 and pi are known to about 1e-8
_MOST = 2.0**62  # of a score

_BLOCK_SCHEMA = (
    "part int, block long, n int, labels array<string>, low array<double>, high array<double>, short double, long double"
    ", ids binary, vectors binary, angles binary, norms binary, starts binary, codes binary"
)


def directions(sample: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors far from each other, then moved to the middle of the sample vectors nearest to them."""
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.zeros((0, sample.shape[1]))
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < min(most, len(units)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    out = units[chosen]
    for _ in range(4):
        own = (units @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, units)
        size = np.linalg.norm(sums, axis=1)
        out = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], out)
    return out


def angles(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angle of each vector to each reference, and norms; a zero vector, at any angle, scores 0 by its norm."""
    norms = np.linalg.norm(vectors, axis=1)
    return np.arccos(np.clip(vectors @ references.T / np.maximum(norms, 1e-300)[:, None], -1, 1)), norms


def score_bounds(
    low_a: np.ndarray, high_a: np.ndarray, norm_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray, short_b: np.ndarray, long_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each of A (angles in intervals, one norm) with anything in each of B, rounded outwards."""
    near = np.zeros((len(norm_a), len(short_b)))
    far = np.full(near.shape, math.pi)
    for r in range(low_a.shape[1]):
        la, ha, lb, hb = low_a[:, r, None], high_a[:, r, None], low_b[None, :, r], high_b[None, :, r]
        near = np.maximum(near, np.maximum(la - hb, lb - ha))
        far = np.minimum(far, np.minimum(ha + hb, 2 * math.pi - la - lb))
    most, least = np.cos(np.maximum(near - SLACK, 0)), np.cos(np.minimum(np.maximum(far, near) + SLACK, math.pi))
    long, short = norm_a[:, None] * long_b[None, :], norm_a[:, None] * short_b[None, :]
    slack = 1 + 1e-9 * long
    return np.where(least < 0, long, short) * least - slack, np.where(most > 0, long, short) * most + slack


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows, with zeros beyond the end of short ones."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _exact(most: float) -> type:
    """A type in which every inner product is exact and fast."""
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64


def _stored(most: float) -> str:
    return "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"


class Vectors:
    """What one pass needs to know of all vectors: width, greatest norm, references."""

    def __init__(self, width: int, norm: float, references: np.ndarray) -> None:
        self.width, self.references = width, references
        self.exact, self.stored, self.window = _exact(norm**2), _stored(norm), WINDOW

    def blocks(self, rows: DataFrame, most: int, name: str) -> DataFrame:
        """Rows (``vec_id``, ``label``, ``v``) sorted and cut into blocks, one row each; written once."""
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = ["label", "cell", "angle", "vec_id"]
        dealt = self.placed(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number, waiting, n = TaskContext.get().partitionId(), 0, [], 0
            for batch in batches:
                waiting.append(batch)
                n += len(batch)
                while n >= most:
                    table = pa.Table.from_batches(waiting)
                    yield self._block(table.slice(0, most), part, number)
                    number += 1
                    waiting, n = table.slice(most).to_batches(), n - most
            if n:
                yield self._block(pa.Table.from_batches(waiting), part, number)

        return settle(dealt.mapInArrow(cut, _BLOCK_SCHEMA), name)

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their nearest reference and the angle to it."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, _ = angles(_matrix(batch.column(2), self.width).astype(float), self.references)
                cell = own.argmin(axis=1) if own.shape[1] else np.zeros(len(batch), np.int64)
                angle = own[np.arange(len(own)), cell] if own.shape[1] else np.zeros(len(batch))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=["vec_id", "label", "v", "cell", "angle"]
                )

        shape = "vec_id long, label string, v array<long>, cell int, angle double"
        return settle(rows.mapInArrow(place, shape), "placed")

    def _block(self, rows: pa.Table, part: int, number: int) -> pa.RecordBatch:
        vectors = _matrix(rows["v"].combine_chunks(), self.width)
        own, norms = angles(vectors.astype(float), self.references)
        names = rows["label"].combine_chunks().dictionary_encode()
        code = names.indices.to_numpy()
        # Windows: stretches of one label.
        fresh = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        ends = np.append(fresh[1:], len(code))
        starts = np.concatenate([np.arange(a, b, self.window) for a, b in zip(fresh, ends, strict=True)])
        row = {
            "part": part,
            "block": part << 32 | number,
            "n": len(code),
            "labels": names.dictionary.to_pylist(),
            "low": own.min(axis=0).tolist(),
            "high": own.max(axis=0).tolist(),
            "short": float(norms.min()),
            "long": float(norms.max()),
            "ids": rows["vec_id"].to_numpy().astype("<i8").tobytes(),
            "vectors": vectors.astype(self.stored).tobytes(),
            "angles": own.astype("<f8").tobytes(),
            "norms": norms.astype("<f8").tobytes(),
            "starts": starts.astype("<i4").tobytes(),
            "codes": code.astype("<i4").tobytes(),
        }
        kinds = {"part": pa.int32(), "block": pa.int64(), "n": pa.int32(), "labels": pa.list_(pa.string())}
        kinds |= {c: pa.list_(pa.float64()) for c in ("low", "high")} | {c: pa.float64() for c in ("short", "long")}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], names=list(row))


class Block:
    """A block as it is read back."""

    def __init__(self, row: dict, vectors: Vectors) -> None:
        def read(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(row[name], kind)

        self.labels = row["labels"]
        self.ids, self.codes, self.norms = read("ids", "<i8"), read("codes", "<i4"), read("norms", "<f8")
        n = len(self.ids)
        self.vectors = read("vectors", vectors.stored).reshape(n, vectors.width).astype(vectors.exact)
        self.angles = read("angles", "<f8").reshape(n, len(vectors.references))
        self.starts = read("starts", "<i4").astype(np.int64)
        self.sizes = np.diff(np.append(self.starts, n))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Least and greatest angles and norms of the windows."""
        return (
            np.minimum.reduceat(self.angles, self.starts, axis=0),
            np.maximum.reduceat(self.angles, self.starts, axis=0),
            np.minimum.reduceat(self.norms, self.starts),
            np.maximum.reduceat(self.norms, self.starts),
        )

    def labels_in(self, other: Block) -> np.ndarray:
        """Each row's label as a code of another block; -1 if that has none of it."""
        code = {label: i for i, label in enumerate(other.labels)}
        return np.asarray([code.get(label, -1) for label in self.labels], np.int64)[self.codes]


_UNSEEN = np.iinfo(np.int64).min


def window_scores(anchors: Block, rows: Block, wanted: np.ndarray) -> np.ndarray:
    """Integer scores of anchors and rows in the wanted (anchor, window) pairs; ``_UNSEEN`` elsewhere."""
    out = np.full((len(anchors.ids), len(rows.ids)), _UNSEEN)
    for w in np.flatnonzero(wanted.any(axis=0)):
        some, own = np.flatnonzero(wanted[:, w]), slice(rows.starts[w], rows.starts[w] + rows.sizes[w])
        out[some, own] = (anchors.vectors[some] @ rows.vectors[own].T).astype(np.int64)
    return out


def best_positives(anchors: Block, rows: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor place, row place and score of all rows that can be among an anchor's ``k`` best of its label."""
    low, high = score_bounds(anchors.angles, anchors.angles, anchors.norms, *rows.windows())
    same = anchors.labels_in(rows)[:, None] == rows.codes[rows.starts][None, :]
    # The score that k rows are proved to have, the anchor itself not counted.
    low = np.where(same, low, -np.inf)
    order = np.argsort(-low, axis=1, kind="stable")
    enough = np.cumsum(np.where(np.take_along_axis(same, order, 1), rows.sizes[order], 0), axis=1) >= k + 1
    proved = np.where(enough.any(axis=1), np.take_along_axis(low, order, 1)[np.arange(len(low)), enough.argmax(axis=1)], -np.inf)
    scores = window_scores(anchors, rows, same & (high >= proved[:, None]))
    scores[anchors.ids[:, None] == rows.ids[None, :]] = _UNSEEN
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        kth = np.full(len(scores), _UNSEEN)
    a, r = np.nonzero((scores >= kth[:, None]) & (scores > _UNSEEN))
    score = scores[a, r]
    # Many rows can tie with the k-th: those with the smallest ids stay.
    order = np.lexsort((rows.ids[r], -score, a))
    a, r, score = a[order], r[order], score[order]
    first = np.searchsorted(a, np.arange(len(scores)))
    keep = np.arange(len(a)) - first[a] < k
    return a[keep], r[keep], score[keep]


def best_negatives(
    anchors: Block, rows: Block, asked: tuple[np.ndarray, np.ndarray, np.ndarray], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each question (anchor place, least and greatest score; sorted by anchor) the ``k`` best rows of other labels.

    Returns question, row place and score.
    """
    place, least, most = asked
    low, high = score_bounds(anchors.angles, anchors.angles, anchors.norms, *rows.windows())
    other = anchors.labels_in(rows)[:, None] != rows.codes[rows.starts][None, :]
    meets = np.zeros(low.shape, bool)
    np.logical_or.at(meets, place, (high[place] >= least[:, None]) & (low[place] <= most[:, None]))
    scores = window_scores(anchors, rows, meets & other)
    scores[anchors.ids[:, None] == rows.ids[None, :]] = _UNSEEN
    floor, ceiling = np.full(len(anchors.ids), np.iinfo(np.int64).max), np.full(len(anchors.ids), _UNSEEN)
    np.minimum.at(floor, place, least)
    np.maximum.at(ceiling, place, most)
    a, r = np.nonzero((scores >= floor[:, None]) & (scores <= ceiling[:, None]) & (scores > _UNSEEN))
    score = scores[a, r]
    order = np.lexsort((rows.ids[r], -score, a))
    r, score = r[order], score[order]
    ends = np.searchsorted(a[order], np.arange(len(anchors.ids) + 1))
    found = []
    for q, (p, lo, hi) in enumerate(zip(place.tolist(), least.tolist(), most.tolist(), strict=True)):
        own = slice(ends[p], ends[p + 1])
        at = ends[p] + int(np.searchsorted(-score[own], -hi))
        stop = min(at + k, ends[p] + int(np.searchsorted(-score[own], -lo, "right")))
        found += [(q, i) for i in range(at, stop)]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    question, at = np.asarray(found).T
    return question, r[at], score[at]


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    percent: tuple[int, int] = (50, 95),
    scale: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Per anchor and positive the best rows of other labels within ``percent`` of the positive's score.

    Columns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``,
    ``negative_score``. ``is_anchor`` is a condition on ``vec_id``; all rows are candidates.
    """
    spark = bounded_batches(vectors.sparkSession)
    rows = only(vectors, vec_id=vec_id, label=label, embedding=embedding)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), quantised(F.col("embedding"), scale).alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x))
    known = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(norm).alias("norm")).first()
    n, width, norm = known["n"], known["width"] or 0, known["norm"] or 0.0
    if norm * norm > _MOST:
        raise ValueError(f"vectors of norm {norm / scale:g}: scores leave 64-bit integers")
    drawn = F.xxhash64("vec_id").bitwiseAND(F.lit((1 << 30) - 1)) < min(1 << 30, int(SAMPLE / max(n, 1) * (1 << 30)))
    sample = rows.where(drawn).orderBy(F.xxhash64("vec_id"), "vec_id").select("v").toArrow()["v"].combine_chunks()
    shared = Vectors(width, norm, directions(_matrix(sample, width).astype(float), REFERENCES))
    blocks = shared.blocks(rows, BLOCK, "blocks")
    anchors = shared.blocks(rows.where(F.coalesce(is_anchor, F.lit(False))), ANCHOR_BLOCK, "anchors")

    by_place = Window.partitionBy("anchor_block", "place")
    found = _met(_same_label(anchors, blocks), anchors, blocks, shared, positives, None)
    found = found.withColumn("slot", F.row_number().over(by_place.orderBy(F.desc("score"), "vec_id"))).where(F.col("slot") <= positives)
    # What each positive allows: whole numbers between its percentages.
    asked = found.select(
        "anchor_block", "place", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        (-_percent(percent[0], -F.col("score"))).alias("least"), _percent(percent[1], F.col("score")).alias("most"),
    ).where("least <= most")
    asked = asked.groupBy("anchor_block").agg(
        F.sort_array(F.collect_list(F.struct("place", "slot", "positive_id", "positive_score", "least", "most"))).alias("asked"),
        F.min("least").alias("floor"),
        F.max("most").alias("ceiling"),
    )
    asked = settle(asked, "asked")
    found = _met(_in_reach(anchors, blocks, asked), anchors, blocks, shared, negatives, asked)
    order = Window.partitionBy("anchor_block", "place", "slot").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _percent(p: int, x: Column) -> Column:
    """floor(p * x / 100) of whole numbers; no step is larger than the result, but for p times 100."""
    hundred, rest = F.lit(100).cast("long"), F.pmod(x, F.lit(100).cast("long"))
    return F.lit(p) * F.call_function("div", x - rest, hundred) + F.call_function("div", F.lit(p) * rest, hundred)


def _same_label(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of anchors and of rows that have a label in common."""
    a = anchors.select(F.col("block").alias("anchor_block"), F.explode("labels").alias("label"))
    b = blocks.select("block", F.explode("labels").alias("label"))
    return a.join(b, "label").select("anchor_block", "block").distinct()


def _in_reach(anchors: DataFrame, blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks of anchors, and blocks of rows that can have a score some anchor asks for, with another label.

    One row per block and its intervals only; the stated anchors are held against all rows.
    """
    last = blocks.agg(F.max("part")).first()[0] or 0
    bounds = ["labels", "low", "high", "short", "long"]
    a = anchors.select(F.col("block").alias("anchor_block"), *(F.col(c).alias(f"a_{c}") for c in bounds)).join(asked, "anchor_block")
    a = a.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last))))
    pairs = a.join(blocks.select("part", "block", *bounds), "part")

    def farthest(x: str, y: str) -> Column:
        return F.array_max(F.zip_with(x, y, lambda p, q: p - q))

    def nearest(x: str, y: str) -> Column:
        return F.array_min(F.zip_with(x, y, lambda p, q: p + q))

    pi = F.lit(math.pi)
    near = F.greatest(F.lit(0.0), farthest("a_low", "high"), farthest("low", "a_high"))
    far = F.least(pi, nearest("a_high", "high"), 2 * pi - F.array_max(F.zip_with("a_low", "low", lambda p, q: p + q)))
    most, least = F.cos(F.greatest(near - SLACK, F.lit(0.0))), F.cos(F.least(F.greatest(far, near) + SLACK, pi))
    long, short = F.col("a_long") * F.col("long"), F.col("a_short") * F.col("short")
    slack = 1 + 1e-9 * long
    meets = (F.when(most > 0, long).otherwise(short) * most + slack >= F.col("floor")) & (
        F.when(least < 0, long).otherwise(short) * least - slack <= F.col("ceiling")
    )
    one = (F.size("labels") == 1) & (F.size("a_labels") == 1) & (F.col("labels")[0] == F.col("a_labels")[0])
    return pairs.where(meets & ~one).select("anchor_block", "block")


def _met(pairs: DataFrame, anchors: DataFrame, blocks: DataFrame, shared: Vectors, k: int, asked: DataFrame | None) -> DataFrame:
    """What the blocks of each pair find together: positives, or with ``asked`` negatives."""
    spark = blocks.sparkSession
    held = ["labels", "ids", "vectors", "angles", "norms", "starts", "codes"]
    ours = anchors.select(F.col("block").alias("anchor_block"), F.struct(*held).alias("a"))
    if asked is not None:
        ours = ours.join(asked.select("anchor_block", "asked"), "anchor_block")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = pairs.repartition(parts, "anchor_block", "block").join(ours, "anchor_block")
    met = met.join(blocks.select("block", F.struct(*held).alias("b")), "block")
    met = met.select("anchor_block", "a", "b", *([] if asked is None else ["asked"]))
    known = spark.sparkContext.broadcast(shared)
    more = [] if asked is None else ["slot", "positive_id", "positive_score"]
    names = ["anchor_block", "place", "anchor_id", *more, "vec_id", "score"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = Block(row["a"], known.value), Block(row["b"], known.value)
                columns = []
                if more:
                    questions = {c: np.asarray([q[c] for q in row["asked"]], np.int64) for c in ("place", "least", "most", *more)}
                    at, r, score = best_negatives(a, b, tuple(questions[c] for c in ("place", "least", "most")), k)
                    place, columns = questions["place"][at], [questions[c][at] for c in more]
                else:
                    place, r, score = best_positives(a, b, k)
                columns = [np.full(len(place), row["anchor_block"]), place, a.ids[place], *columns, b.ids[r], score]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    return met.mapInArrow(find, ", ".join(f"{name} long" for name in names))
