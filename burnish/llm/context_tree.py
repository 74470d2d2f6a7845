"""Scoring texts by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, each with a node per context of 0 to ``DEPTH`` bytes before it. A node
estimates its next bit by Krichevsky and Trofimov, (n + 1/2) / (N + 1). Its weighted probability of all
that was learned is the mean of its own estimate and the product of its children's: so every depth takes
part, each with the weight it has earned. Counts are frozen after learning, and a text's probability is the
product of the mixed predictions of its bits. Beside it stands a base score by smoothed word counts.

Whole texts are dealt into blocks once. Each block counts its distinct words and grams (a byte with its
context). Totals per word and per gram are sums over blocks; the tree is worked out in parts, one per
two nearest context bytes; then each block gets the totals of its own words, the predictions for its own
grams and the nodes of one byte of context (65,280 at most), with which it joins the parts and scores its texts. So what is gathered grows with the input, no task holds
the vocabulary or the model, and a frequent word or gram has one row per block, not per text.

Defined results: a null text is empty: one token (its end), probability 1 of no bytes. Documents with a null
id are learned from or held out like any other, by the empty id. If nothing is learned, every bit has
probability 1/2. ``ValueError`` for a depth that is not 1, 2 or 3. Rows repeat as given; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import Lookup, blocks_for, bounded_batches, grams, only, result, slices, utf8

DEPTH = 3  # bytes of context; a subtree below two bytes has at most 2**16 grams
_CHUNK = 1 << 20
_WORD, _GRAM, _ROOT, _TOTAL = range(4)
_LOG2 = float(np.log(2))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function, by Stirling's series above 8."""
    x = np.asarray(x, float)
    low = np.zeros_like(x)
    for i in range(8):
        low += np.where(x < 8, np.log(np.minimum(x, 8) + i), 0)
    y = np.where(x < 8, x + 8, x)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - low


def estimated(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that Krichevsky and Trofimov give a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def stopped(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of nodes, and the weight of their own estimate in it."""
    weighted = np.logaddexp(own, children) - _LOG2
    return weighted, np.exp(own - _LOG2 - weighted)


def subtree(keys: np.ndarray, counts: np.ndarray, top: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part of the tree below the ``top`` nearest context bytes.

    ``keys``: grams as numbers, first byte highest, all with the same ``top`` bytes before the last; ``counts``:
    how often each was learned. Returns the mixed probability of each of a gram's eight bits from depth ``top``
    on, the nodes at that depth (nearest context byte above, bits before below), and for those zeros, ones and
    the weighted log probability.
    """
    keys = keys.astype(np.uint64)
    symbol = keys & np.uint64(0xFF)
    shifts = np.arange(8, dtype=np.uint64)
    node_of = (np.uint64(1) << shifts) | (symbol[:, None] >> (np.uint64(8) - shifts))  # bits before, with a leading one
    bit = (symbol[:, None] >> (np.uint64(7) - shifts) & np.uint64(1)).astype(bool)
    weights = np.repeat(counts.astype(float), 8)
    levels = []
    for d in range(top, depth + 1):
        context = keys >> np.uint64(8) & np.uint64((1 << 8 * d) - 1)
        nodes, at = np.unique((context[:, None] << np.uint64(8) | node_of).ravel(), return_inverse=True)
        ones = np.bincount(at, weights * bit.ravel(), len(nodes))
        levels.append((nodes, at, np.bincount(at, weights, len(nodes)) - ones, ones))
    mixed = below = None
    for d in range(depth, top - 1, -1):
        nodes, at, zeros, ones = levels[d - top]
        own = estimated(zeros, ones)
        guess = ((np.where(bit.ravel(), ones[at], zeros[at]) + 0.5) / (zeros + ones + 1)[at]).reshape(bit.shape)
        if below is None:
            weighted, mixed = own, guess
        else:
            child_nodes, child_weighted = below
            parent = (child_nodes >> np.uint64(8) & np.uint64((1 << 8 * d) - 1)) << np.uint64(8) | child_nodes & np.uint64(0xFF)
            weighted, weight = stopped(own, np.bincount(np.searchsorted(nodes, parent), child_weighted, len(nodes)))
            weight = weight[at].reshape(bit.shape)
            mixed = weight * guess + (1 - weight) * mixed
        below = nodes, weighted
    nodes, _, zeros, ones = levels[0]
    return mixed, (nodes & np.uint64(0xFFFF)).astype(np.uint16), np.stack([zeros, ones, weighted])


def scored(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``held_out`` is a condition on ``doc_id``; documents that meet it are not learned from. ``score`` and
    ``base_score`` are log10 probabilities of the whole text; ``bits_per_byte`` is the code length.
    """
    if not 1 <= depth <= DEPTH:
        raise ValueError(f"depth {depth}: a byte and its context are packed in 32 bits, so 1 to {DEPTH}")
    bounded_batches(docs.sparkSession)
    rows = only(docs, doc_id=doc_id, text=text)
    parts = blocks_for(rows)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    dealt = rows.select(block.alias("block"), "doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.repartition(parts, "block")

    def count(part: pa.Table) -> pa.Table:
        learned = ~part["held_out"].to_numpy()
        words, seen = Counter(), set()
        for text, own in zip(part["text"], learned, strict=True):
            found = lowered(text.as_py()).split()
            words.update(found) if own else seen.update(found)
        words.update(dict.fromkeys(seen - words.keys(), 0))
        data, offsets = utf8(part["text"])
        total_keys, total_counts = [], []
        for first, last in slices(offsets, 8 * _CHUNK):
            own = offsets[first : last + 1] - offsets[first]
            packed = grams(data[offsets[first] : offsets[last]], own, depth)
            weight = np.repeat(learned[first:last], np.diff(own))
            for flag in (True, False):
                keys, n = np.unique(packed[weight == flag], return_counts=True)
                total_keys.append(keys)
                total_counts.append(n if flag else np.zeros(len(n), np.int64))
        keys, at = np.unique(np.concatenate(total_keys), return_inverse=True)
        counts = np.bincount(at, np.concatenate(total_counts), len(keys)).astype(np.int64)
        n, names = len(words) + len(keys) + 1, [*words]
        packed = keys.astype(">u4").tobytes()
        values = [w for w in names] + [packed[i : i + 4] for i in range(0, len(packed), 4)] + [b""]
        kinds = np.repeat(np.asarray([_WORD, _GRAM, _TOTAL], np.int32), [len(names), len(keys), 1])
        amounts = np.concatenate([np.fromiter(words.values(), np.int64, len(names)), counts, [int(learned.sum())]])
        return pa.table(
            {
                "block": pa.array(np.full(n, part["block"][0].as_py(), np.int32)),
                "kind": pa.array(kinds),
                "key": pa.array(values, pa.binary()),
                "n": pa.array(amounts.astype(np.int64)),
            }
        )

    counted = dealt.groupBy("block").applyInArrow(count, "block int, kind int, key binary, n long")
    # One shuffle by key serves the totals and the way back to the blocks. ``what`` is the kind as a result of
    # the aggregation: a condition on it stays above the shuffle, which all of its readers then share. No key is
    # null; saying so here spares the joins from saying it in each reader.
    counted = counted.where("kind is not null and key is not null").repartition(parts, "kind", "key")
    totals = counted.groupBy("kind", "key").agg(
        F.sum("n").alias("total"), F.count("block").alias("blocks"), F.max("kind").alias("what")
    )
    totals = totals.where("blocks > 0")  # true of all: keeps the readers' columns, and so their shuffle, the same

    top = min(depth, 2)

    def grow(part: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(part["key"].to_pylist()), ">u4").astype(np.uint32)
        order = np.argsort(keys)
        keys = keys[order]
        mixed, nodes, stats = subtree(keys, part["total"].to_numpy()[order], top, depth)
        bits = mixed.astype("<f4").tobytes()
        packed, named = keys.astype(">u4").tobytes(), nodes.astype(">u2").tobytes()
        n, m = len(keys), len(nodes)
        values = [packed[i : i + 4] for i in range(0, 4 * n, 4)] + [named[i : i + 2] for i in range(0, 2 * m, 2)]
        stats = np.concatenate([np.zeros((3, n)), stats], axis=1)
        return pa.table(
            {
                "kind": pa.array(np.repeat(np.asarray([_GRAM, _ROOT], np.int32), [n, m])),
                "key": pa.array(values, pa.binary()),
                **{name: pa.array(stats[j]) for j, name in enumerate("xyz")},
                "bits": pa.array([bits[i : i + 32] for i in range(0, 32 * n, 32)] + [None] * m, pa.binary()),
            }
        )

    nearest = F.substring("key", 4 - top, top)
    tree = totals.where(F.col("what") == _GRAM).select(nearest.alias("nearest"), "key", "total")
    tree = tree.groupBy("nearest").applyInArrow(grow, "kind int, key binary, x double, y double, z double, bits binary")
    none, every = F.lit(None), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block")
    # What is known of a key: the total of a word, the predictions of a gram. A word of a single block needs no
    # answer: the block has counted it.
    words = totals.where((F.col("what") == _WORD) & (F.col("blocks") > 1))
    known = words.select("kind", "key", F.col("total").cast("double").alias("x"), none.cast("binary").alias("bits"))
    known = known.unionByName(tree.where(F.col("bits").isNotNull()).select("kind", "key", "x", "bits"))
    known = known.toDF("of_kind", "of", "x", "bits")
    asked = counted.join(known, (F.col("kind") == F.col("of_kind")) & (F.col("key") == F.col("of")))
    roots = tree.where(F.col("bits").isNull()).groupBy("key").agg(*(F.sum(c).alias(c) for c in "xyz"))
    end = F.col("what") == _TOTAL
    sums = totals.where(F.col("what") != _GRAM).agg(
        F.sum("total").alias("x"), F.sum((F.col("total") > 0).cast("long")).alias("y"), F.sum(F.when(end, F.col("total"))).alias("z")
    )

    def reply(df: DataFrame, block: Column, kind: Column, **columns: Column) -> DataFrame:
        kinds = {"key": "binary", "x": "double", "y": "double", "z": "double", "bits": "binary"}
        return df.select(block, kind.alias("kind"), *(columns.get(c, none).cast(t).alias(c) for c, t in kinds.items()))

    x, y, z, key = (F.col(c) for c in ("x", "y", "z", "key"))
    answered = (
        reply(asked, F.col("block"), F.col("kind"), key=key, x=x, y=F.col("n"), bits=F.col("bits"))
        .unionByName(reply(roots, every, F.lit(_ROOT), key=key, x=x, y=y, z=z))
        .unionByName(reply(sums, every, F.lit(_TOTAL), x=x, y=y, z=z))
        .repartition(parts, "block")
    )
    shape = result(
        dealt, ["doc_id", "held_out"], "n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    )

    def score(part: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(part):
            return pa.table({f.name: pa.array([], part[f.name].type if f.name in part.column_names else None) for f in shape}).cast(
                pa.schema([part.schema.field("doc_id"), part.schema.field("held_out"), *_numbers()])
            )
        kind = answers["kind"].to_numpy()
        total = answers.filter(pa.array(kind == _TOTAL))
        learned_tokens, distinct, ends = (int(total[c][0].as_py() or 0) for c in "xyz")
        counts = _word_counts(part, answers.filter(pa.array(kind == _WORD)))
        bits = _bit_costs(answers.filter(pa.array(kind == _ROOT)), answers.filter(pa.array(kind == _GRAM)), depth)
        logs = {word: float(np.log10(c + 0.1)) for word, c in counts.items()}
        unknown = float(np.log10(0.1))
        end = float(np.log10(ends + 0.1))
        held = part["held_out"].to_numpy()
        n_tokens, n_known, base = [], [], []
        for text, out in zip(part["text"], held, strict=True):
            found = [logs[w] for w in lowered(text.as_py()).split()]
            n_tokens.append(len(found) + 1)
            n_known.append(len(found) + (ends > 0) - (sum(v == unknown for v in found) if out else 0))
            base.append(float(np.sum(found)) + end)
        n = np.asarray(n_tokens, np.int64)
        scale = np.log10(learned_tokens + 0.1 * (distinct + 1))
        data, offsets = utf8(part["text"])
        score = np.zeros(len(part))
        for first, last in slices(offsets, _CHUNK):
            own = offsets[first : last + 1] - offsets[first]
            costs = bits(grams(data[offsets[first] : offsets[last]], own, depth))
            filled = np.flatnonzero(np.diff(own))
            if len(filled):
                score[first + filled] = np.add.reduceat(costs, own[filled])
        size = np.diff(offsets)
        return pa.table(
            {
                "doc_id": part["doc_id"],
                "held_out": part["held_out"],
                "n_tokens": pa.array(n),
                "n_known": pa.array(np.asarray(n_known, np.int64)),
                "train_tokens": pa.array(np.full(len(n), learned_tokens, np.int64)),
                "base_score": pa.array(np.asarray(base) - n * scale),
                "score": pa.array(score),
                "bits_per_byte": pa.array(-score / np.log10(2) / np.maximum(size, 1)),
            }
        )

    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, shape)


def lowered(text: str) -> bytes:
    """UTF-8 of a text with A-Z in lower case; ``split()`` then cuts it at ASCII white space."""
    return text.encode().lower()


def _numbers() -> list[pa.Field]:
    whole = [pa.field(n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")]
    return whole + [pa.field(n, pa.float64()) for n in ("base_score", "score", "bits_per_byte")]


def _word_counts(part: pa.Table, answers: pa.Table) -> dict[bytes, int]:
    """Learned count of every word of the block: its own, or the answer where other blocks have the word too."""
    counts: Counter = Counter()
    for text, out in zip(part["text"], part["held_out"].to_numpy(), strict=True):
        found = lowered(text.as_py()).split()
        counts.update(dict.fromkeys(found, 0) if out else found)
    counts.update(dict.fromkeys((), 0))
    for word, total in zip(answers["key"].to_pylist(), answers["x"].to_pylist(), strict=True):
        counts[word] = int(total)
    return counts


def _bit_costs(roots: pa.Table, known: pa.Table, depth: int):
    """Function from grams to the log10 probability of their last byte.

    ``roots``: nodes with one byte of context, with what the parts below them hold; the nodes without context
    are their sums.
    """
    at = np.frombuffer(b"".join(roots["key"].to_pylist()), ">u2").astype(np.int64)
    zeros1, ones1, weighted1, weight1 = np.zeros((4, 1 << 16))
    for column, name in ((zeros1, "x"), (ones1, "y"), (weighted1, "z")):
        column[at] = roots[name].to_numpy()
    if depth > 1:
        weighted1[at], weight1[at] = stopped(estimated(zeros1[at], ones1[at]), weighted1[at])
    zeros, ones, below = (column.reshape(256, 256).sum(axis=0) for column in (zeros1, ones1, weighted1))
    _, weight = stopped(estimated(zeros, ones), below)
    keys = np.frombuffer(b"".join(known["key"].to_pylist()), ">u4").astype(np.uint32)
    order = np.argsort(keys)
    keys = keys[order]
    mixed = np.frombuffer(b"".join(known["bits"].to_pylist()), "<f4").reshape(-1, 8).astype(float)[order]
    symbol = (keys & np.uint32(0xFF)).astype(np.int64)
    byte = (keys & np.uint32(0xFF00)).astype(np.int64)
    costs = np.zeros(len(keys))
    for k in range(8):
        node = (1 << k) | (symbol >> (8 - k))
        bit = (symbol >> (7 - k)) & 1
        guess = (np.where(bit, ones[node], zeros[node]) + 0.5) / (zeros[node] + ones[node] + 1)
        node1 = byte | node
        guess1 = (np.where(bit, ones1[node1], zeros1[node1]) + 0.5) / (zeros1[node1] + ones1[node1] + 1)
        mixed1 = weight1[node1] * guess1 + (1 - weight1[node1]) * mixed[:, k]
        costs += np.log10(weight[node] * guess + (1 - weight[node]) * mixed1)
    lookup = Lookup(keys)
    return lambda wanted: costs[lookup(wanted)]
