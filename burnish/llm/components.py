"""Connected components of a graph given as links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.session import settle


def components(links: DataFrame, name: str) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of ``links`` (``a``, ``b``).

    Each round links a node's greater neighbours to its smallest neighbour, then its smaller
    neighbours likewise, until every node hangs on its root. Rounds grow with the logarithm of the
    longest path. Minima are settled before they are joined back, so that both sides of a join are
    plain shuffles and the engine can split the many links of a hub. Every round is written: a lost
    executor costs one round at most.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = settle(pairs, name)
    state = _state(pairs)
    while state[0]:
        # Large star: greater neighbours of a node go to its smallest neighbour, or to itself.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        least = settle(least, name)
        large = pairs.join(least, pairs["b"] == least["node"]).select("a", F.col("m").alias("b")).distinct()
        large = settle(large, name)
        # Small star: smaller neighbours of a node, and the node, go to the smallest of them.
        roots = settle(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m"), name)
        small = large.join(roots, large["a"] == roots["node"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = small.where("a <> b").unionByName(roots.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()
        pairs = settle(pairs, name)
        before, state = state, _state(pairs)
        if before == state:
            break
    hung = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return hung.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(pairs: DataFrame) -> tuple:
    """Number and checksum of the links, all distinct."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
