"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Vectors become integers. A block of candidates is indexed by impact: each component, above the least one
of its dimension in the block, is cut into base-4 digits, and the postings of one digit place form a
segment; a place's impact is its power of four. Segments are processed for all queries of a block in
descending impact. After each segment a candidate's score lies between two bounds, its accumulator plus
the least and the most that the smaller impacts can still add. Once the k-th greatest lower bound is known,
candidates whose upper bound lies below it are proved out. When few enough possible members remain, or no
segment is left, they are rescored exactly.

Queries and candidates meet block by block: every query block with every candidate block, each of
bounded size, so that no task holds a whole side.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part, nor do rows
without an id. A vector is never its own candidate: candidates with the query's id are left out. Of vectors
with different lengths the shorter one counts as zero beyond its end. Ties go to the smaller id. ``ValueError``
where components or scores could leave 64-bit integers. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import only, shipped

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096  # vectors of one block, about
MOST = 2.0**62  # of a score
ENOUGH = 8  # possible members for each result from which on they are rescored


def quantised(embedding: Column, scale: int = 64) -> Column:
    """Integer components floor(scale * x) of an embedding; null if it can take no part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)), whole)


class Block:
    """Segments of a block of integer vectors, by descending impact."""

    def __init__(self, vectors: np.ndarray, exact: type) -> None:
        self.vectors = vectors.astype(exact)
        self.least = vectors.min(axis=0)
        above = vectors - self.least
        places = 0
        while above.size and 4**places <= above.max():
            places += 1
        # Least impact last; what is left after a segment is at most the impact less one.
        self.segments = [(4**p, (above >> 2 * p & 3).astype(exact)) for p in range(places - 1, -1, -1)]
        self.most = above.max(axis=0)
        self.exact = exact

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query: places of all candidates that can be among its k best, and their exact scores.

        ``own``: for each query and candidate, whether the candidate is the query itself.
        """
        wide = queries.astype(self.exact)
        scores = np.broadcast_to((wide @ self.least.astype(self.exact))[:, None], own.shape).copy()
        possible = ~own
        for impact, postings in self.segments:
            scores += self.exact(impact) * (wide @ postings.T)
            rest = np.minimum(self.most, impact - 1).astype(self.exact)
            low, high = np.minimum(wide, 0) @ rest, np.maximum(wide, 0) @ rest
            open_scores = np.where(possible, scores, -np.inf if self.exact is not np.int64 else np.iinfo(np.int64).min // 2)
            if open_scores.shape[1] > k:
                kth = -np.partition(-open_scores, k - 1, axis=1)[:, k - 1]
                possible &= open_scores + high[:, None] >= (kth + low)[:, None]
            if impact > 1 and possible.sum() <= ENOUGH * k * len(queries):
                break
        out = []
        for i in range(len(queries)):
            at = np.flatnonzero(possible[i])
            out.append((at, (self.vectors[at] @ wide[i]).astype(np.int64)))
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows, with zeros beyond the end of short ones."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """Each query's ``k`` best candidates: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    ``is_query`` is a condition on ``vec_id``; all rows are candidates.
    """
    shipped(vectors.sparkSession)
    rows = only(vectors, vec_id=vec_id, embedding=embedding)
    rows = rows.select(F.col("vec_id").cast("long"), quantised(F.col("embedding"), scale).alias("v"))
    rows = rows.where("vec_id is not null and v is not null").withColumn("q", F.coalesce(is_query, F.lit(False)))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    sizes = rows.agg(
        F.count("*").alias("n"), F.sum(F.col("q").cast("int")).alias("q"), F.max(F.size("v")).alias("w"), F.max(square).alias("most")
    ).first()
    # Components that leave the integers' range end at its border, far beyond this.
    if (sizes["most"] or 0.0) > MOST:
        raise ValueError(f"a vector of norm {sizes['most'] ** 0.5 / scale:g}: scores leave 64-bit integers")
    n, queries, width = sizes["n"], sizes["q"] or 0, sizes["w"] or 0
    query_blocks, blocks = max(1, -(-queries // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    draw = F.xxhash64("vec_id")

    own = lambda parts: F.pmod(draw, F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    sides = [
        rows.where("q").select(own(query_blocks).alias("query_block"), every(blocks).alias("block"), "q", "vec_id", "v"),
        rows.select(every(query_blocks).alias("query_block"), own(blocks).alias("block"), F.lit(False).alias("q"), "vec_id", "v"),
    ]
    met = sides[0].unionByName(sides[1])

    def search(pair: pa.Table) -> pa.Table:
        side = pair["q"].to_numpy()
        ids, all_vectors = pair["vec_id"].to_numpy(), _matrix(pair["v"].combine_chunks(), width)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ours, theirs = np.flatnonzero(side), np.flatnonzero(~side)
        if len(ours) and len(theirs) and width:
            most = float(np.abs(all_vectors).max()) ** 2 * width
            exact = np.float32 if most < 2**22 else np.float64 if most < 2**51 else np.int64
            block = Block(all_vectors[theirs], exact)
            own = ids[ours][:, None] == ids[theirs][None, :]
            for i, (at, scores) in zip(ours, block.search(all_vectors[ours], k, own), strict=True):
                best = np.lexsort((ids[theirs][at], -scores))[:k]
                found.append((np.full(len(best), ids[i]), ids[theirs][at][best], scores[best]))
        columns = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(3)]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score"])

    best = met.groupBy("query_block", "block").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
