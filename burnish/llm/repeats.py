"""Removing repeated passages: radix order of the suffixes at sampled positions.

A byte goes if some string of ``length`` bytes that covers it also starts earlier: in a document with a
smaller id, or further to the front of its own. Strings are judged on the input.

Documents are dealt into blocks by ranges of ids. In a block every string is filed under one of its
positions, its anchor: the place of the least hash among the short grams of the string. Equal strings have
equal anchors at the same offset, so only texts around equal anchors need to be compared, and about one
position in thirty is an anchor. The strings of one anchor are one stretch of text, the span.

1. Anchors that occur in one block only are settled there. If all spans of an anchor are alike, all but
   those of its first block are repeated as a whole. Only differing spans go on.
2. The spans of those are sorted: every block sends each of its own once, a suffix that starts at an anchor
   with the text before it. All that arrive for an anchor are put in order anew, eight bytes at a time; where
   neighbours part, their common prefix is known; stretches that are settled are left alone. No
   Burrows-Wheeler transform is built or merged, and the order in which blocks send is not used: a merge of
   the order of every suffix would pass over all bytes about a hundred times.
3. Common prefixes of the suffixes and of the preceding texts give, for every offset, the intervals of
   equal strings; those that hold an earlier block mark the others.
4. Blocks put the marks on their texts, with what repeats inside the block itself.

An anchor with very many spans is split by the text that eight neighbouring strings have in common, so its
spans spread over many tasks.

Defined results: null and empty texts have 0 bytes, nothing removed. Rows with the same id are in the order
of their texts; equal rows repeat each other. A null id comes after all others. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import blocks_for, bounded_batches, mixed, only, slices, utf8

LENGTH = 100
WINDOW = 64  # grams among which the least is chosen; a span holds as many strings at most
CORE = 8  # neighbouring strings of one part of a frequent anchor
PIECE_BYTES = 4096  # of a text, for ranges of ids with as many bytes each
FREQUENT = 256  # spans of an anchor from which on it is split
_CHUNK = 1 << 20
_ALL, _ASK, _SPLIT, _MASK = range(4)
_U = np.uint64
_ODD = [_U(int(x) | 1) for x in mixed(np.arange(1, 40, dtype=np.uint64) * _U(0xA24BAED4963EE407))]
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x8CB92BA72F3D8DD7))
_BASE = 0xD6E8FEB86659FD93


class Spans:
    """Anchors and spans of some texts.

    Per span: ``first`` (place of its first string in ``data``), ``count`` (its strings), ``offset`` (of the
    anchor in the first string), ``key`` (hash of the anchor's gram), ``whole`` (hash of the span).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int) -> None:
        self.data, self.length = data, length
        gram = length - WINDOW
        n = len(data)
        many = np.maximum(np.diff(offsets) - length + 1, 0)
        starts = np.repeat(offsets[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        if not len(starts):
            self.first = self.count = self.offset = np.zeros(0, np.int64)
            self.key = self.whole = np.zeros(0, np.uint64)
            return
        with np.errstate(over="ignore"):
            wide = np.zeros(n + length + 8, np.uint64)
            wide[:n] = data
            for step in (1, 2, 4):
                wide[:-step] |= wide[step:] << _U(8 * step)
            places = [*range(0, gram - 7, 8)]
            if gram % 8:
                places.append(gram - 8)
            grams = np.zeros(n, np.uint64)
            for factor, place in zip(_ODD, places, strict=False):
                grams += (wide[place : place + n] ^ factor) * factor
                grams ^= grams >> _U(29)
            grams = mixed(grams)
            del wide
            least = np.empty(n + WINDOW, np.uint64)
            least[:n] = (grams & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
            least[n:] = _U(0xFFFFFFFFFFFFFFFF)
            step = 1
            while step < WINDOW:
                np.minimum(least[:-step], least[step:], out=least[:-step])
                step *= 2
            anchor = (least[starts] & _U(0xFFFFFFFF)).astype(np.int64)
            del least
            fresh = np.ones(len(starts), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
            at = np.flatnonzero(fresh)
            self.first, self.count = starts[at], np.diff(np.append(at, len(starts)))
            self.offset = anchor[at] - self.first
            self.key = grams[anchor[at]]
            factors = np.full(n + 1, _BASE, np.uint64)
            factors[0] = 1
            powers = np.cumprod(factors)
            factors[1:] = _U(pow(_BASE, -1, 1 << 64))
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * powers[:n])])
            self._inverse = np.cumprod(factors)
            self.whole = self.hashed(self.first, self.first + self.count - 1 + length, self.offset)

    def hashed(self, start: np.ndarray, end: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Hash of pieces of the texts, each together with a number."""
        with np.errstate(over="ignore"):
            text = (self._sums[end] - self._sums[start]) * self._inverse[start]
            return mixed(mixed(text) + mark.astype(np.uint64) * _ODD[20] + (end - start).astype(np.uint64) * _ODD[21])

    def parts(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Spans of frequent anchors in parts: row, key by the common text, first string, strings, offset."""
        last = self.offset[rows] - self.count[rows] + 1  # least offset
        low, high = last // CORE, self.offset[rows] // CORE
        n = high - low + 1
        row = np.repeat(rows, n)
        part = np.repeat(low, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        top = np.minimum(self.offset[row], CORE * part + CORE - 1)
        bottom = np.maximum(self.offset[row] - self.count[row] + 1, CORE * part)
        anchor = self.first[row] + self.offset[row]
        core = anchor - CORE * part
        key = self.hashed(core, core - CORE + 1 + self.length, part)
        return row, key, anchor - top, top - bottom + 1, top


def refined(keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of rows by key, then text, and the common prefix of each row with the one before (-1: other key).

    ``texts`` has the rows' bytes, padded, in a multiple of eight columns.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    group = np.zeros(n, np.int64)
    prefix = np.full(n, -1, np.int64)
    same = keys[order][1:] == keys[order][:-1]
    prefix[1:][same] = texts.shape[1]
    group[1:] = np.cumsum(~same)
    columns = np.ascontiguousarray(texts).view(">u8").astype(np.uint64)
    for j in range(columns.shape[1]):
        # Rows that share their place in the interleaving with another one.
        open_ = np.zeros(n, bool)
        open_[1:] = group[1:] == group[:-1]
        open_[:-1] |= open_[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        value = columns[order[at], j]
        merged = np.lexsort((value, group[at]))
        order[at], value = order[at][merged], value[merged]
        apart = np.zeros(len(at), bool)
        apart[1:] = (group[at][1:] == group[at][:-1]) & (value[1:] != value[:-1])
        split = np.flatnonzero(apart)
        if len(split):
            prefix[at[split]] = 8 * j + (63 - _top_bit(value[split] ^ value[split - 1])) // 8
            border = np.zeros(n, np.int64)
            border[at[split]] = 1
            border[1:] |= group[1:] != group[:-1]
            group = np.cumsum(border)
    return order, prefix


def _top_bit(x: np.ndarray) -> np.ndarray:
    top = np.zeros(len(x), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        high = (x >> _U(step)) > 0
        top += step * high
        x = np.where(high, x >> _U(step), x)
    return top


def _classes(order: np.ndarray, prefix: np.ndarray, active: np.ndarray, least: int) -> np.ndarray:
    """For active rows: number of the interval of rows that share ``least`` bytes; in the order of the rows."""
    at = np.flatnonzero(active[order])
    out = np.zeros(len(order), np.int64)
    if len(at) > 1:
        shared = np.minimum.reduceat(prefix[: at[-1] + 1], at[:-1] + 1)  # up to the next active row, itself included
        out[order[at[1:]]] = np.cumsum(shared < least)
    return out[active]


def repeated(keys: np.ndarray, texts: list[bytes], offset: np.ndarray, count: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each span, a bit per string (first string lowest): whether a span of a lower rank holds it too.

    Spans with different keys share nothing.
    """
    n = len(keys)
    marks = np.zeros(n, np.uint64)
    if n < 2:
        return marks
    width, depth = -(-length // 8) * 8, WINDOW
    after, before = np.zeros((n, width), np.uint8), np.zeros((n, depth), np.uint8)
    for i, text in enumerate(texts):
        own = np.frombuffer(text, np.uint8)
        left, right = own[: offset[i]][::-1], own[offset[i] :][:width]
        after[i, : len(right)] = right
        before[i, : len(left)] = left
    suffixes, prefixes = refined(keys, after), refined(keys, before)
    for o in range(WINDOW):
        active = (offset >= o) & (offset - count < o)
        rows = np.flatnonzero(active)
        if len(rows) < 2:
            continue
        right = _classes(*suffixes, active, length - o)
        left = _classes(*prefixes, active, o)
        place = np.lexsort((rank[rows], left, right))
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (right[place][1:] != right[place][:-1]) | (left[place][1:] != left[place][:-1])
        lowest = rank[rows][place][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        late = rows[place[rank[rows][place] > lowest]]
        marks[late] |= _U(1) << (offset[late] - o).astype(np.uint64)
    return marks


class Block:
    """Documents of a block in order, and their spans."""

    def __init__(self, part: pa.Table, length: int) -> None:
        ids, texts = part["doc_id"].to_numpy(zero_copy_only=False), part["text"]
        self.length = length
        if len(ids):
            nulls = np.asarray([i is None or i != i for i in ids])
            numbers = np.asarray([0 if null else int(i) for i, null in zip(part["doc_id"].to_pylist(), nulls, strict=True)], np.int64)
            order = np.lexsort((numbers, nulls))
            tied = np.flatnonzero((np.diff(numbers[order]) == 0) & (np.diff(nulls[order].astype(int)) == 0))
            if len(tied):
                values = texts.to_pylist()
                order = np.asarray(sorted(order.tolist(), key=lambda i: (nulls[i], numbers[i], values[i])))
            part = part.take(pa.array(order))
        self.ids = part["doc_id"]
        self.data, self.offsets = utf8(part["text"])

    def chunks(self):
        """Spans of the block, a bounded number of texts at a time, and where their texts begin in it."""
        for first, last in slices(self.offsets, _CHUNK):
            base = self.offsets[first]
            yield int(base), Spans(self.data[base : self.offsets[last]], self.offsets[first : last + 1] - base, self.length)

    def all_spans(self) -> dict[str, np.ndarray]:
        """Numbers of all spans of the block."""
        found = {name: [] for name in ("first", "count", "offset", "key", "whole")}
        for base, spans in self.chunks():
            for name, values in found.items():
                values.append(getattr(spans, name) + (base if name == "first" else 0))
        kinds = {"key": np.uint64, "whole": np.uint64}
        return {name: np.concatenate(v) if v else np.zeros(0, kinds.get(name, np.int64)) for name, v in found.items()}

    def text(self, first: int, count: int) -> bytes:
        return self.data[first : first + count - 1 + self.length].tobytes()


def _table(**columns) -> pa.Table:
    kinds = {"block": np.int32, "kind": np.int32, "offset": np.int32, "count": np.int32}
    return pa.table(
        {name: pa.array(v, pa.binary()) if isinstance(v, list) else pa.array(np.asarray(v).astype(kinds.get(name, np.int64))) for name, v in columns.items()}
    )


def deduplicated(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", kept: bool = False) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; with ``kept`` the bytes left."""
    bounded_batches(docs.sparkSession)
    if length < WINDOW + 8:
        raise ValueError(f"strings of at least {WINDOW + 8} bytes")
    rows = only(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    parts = blocks_for(rows)
    # Blocks are ranges of ids: a lower block's documents come first. An id counts as often as its text has pieces, so
    # that ranges hold about as many bytes, whatever the texts' lengths.
    pieces = F.sequence(F.lit(0), F.floor(F.octet_length("text") / PIECE_BYTES).cast("int"))
    weighed = rows.select(F.col("doc_id").cast("double").alias("at"), F.explode(pieces))
    cuts = weighed.approxQuantile("at", [i / parts for i in range(1, parts)], 0.5 / parts)
    splits = [-math.inf, *sorted(set(cuts) or {0.0}), math.inf]
    ranges = Bucketizer(inputCol="at", outputCol="range", splits=splits, handleInvalid="keep")
    dealt = ranges.transform(rows.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(math.nan))))
    dealt = dealt.select(F.col("range").cast("int").alias("block"), "doc_id", "text").repartition(parts, "block")

    def block_of(part: pa.Table) -> int:
        return part["block"][0].as_py()

    def file(part: pa.Table) -> pa.Table:
        spans = Block(part, length).all_spans()
        pairs = np.unique(np.stack([spans["key"], spans["whole"]], 1).view([("k", np.uint64), ("w", np.uint64)])) if len(spans["key"]) else None
        key, whole = (pairs["k"].ravel(), pairs["w"].ravel()) if pairs is not None else (np.zeros(0, np.uint64),) * 2
        return _table(block=np.full(len(key), block_of(part)), key=key.view(np.int64), whole=whole.view(np.int64))

    # One shuffle by key, read by the summary and by the way back to the blocks. Nothing is null; saying so here,
    # and asking both for all columns, keeps the two readers alike, so that they share it.
    filed = dealt.groupBy("block").applyInArrow(file, "block int, key long, whole long")
    filed = filed.where("key is not null and whole is not null and block is not null").repartition(parts, "key")
    shared = filed.groupBy(F.col("key").alias("of")).agg(
        F.min("block").alias("low"), F.max("block").alias("high"), F.min("whole").alias("a"), F.max("whole").alias("b"), F.count("*").alias("n")
    )
    kind = F.when(F.col("a") == F.col("b"), _ALL).when(F.col("n") <= FREQUENT, _ASK).otherwise(_SPLIT)
    shared = shared.where("low < high").select("of", "low", "a", "b", kind.alias("kind"))
    answers = filed.join(shared, F.col("key") == F.col("of")).where(F.col("whole").between(F.col("a"), F.col("b")))
    answers = answers.where((F.col("kind") != _ALL) | (F.col("block") > F.col("low")))
    answers = answers.select("block", F.col("kind").cast("int"), "key").repartition(parts, "block")

    def send(part: pa.Table, asked: pa.Table) -> pa.Table:
        columns = {"key": [], "block": [], "id": [], "offset": [], "count": []}
        texts: list[bytes] = []
        kinds, keys = asked["kind"].to_numpy(), asked["key"].to_numpy().view(np.uint64)
        wanted = {kind: np.unique(keys[kinds == kind]) for kind in (_ASK, _SPLIT)}
        if len(part) and any(len(v) for v in wanted.values()):
            block = Block(part, length)
            seen: set[tuple[int, int]] = set()
            for base, spans in block.chunks():
                for key, first, count, offset, identity in _contexts(spans, wanted):
                    for i in range(len(key)):
                        pair = int(key[i]), int(identity[i])
                        if pair not in seen:
                            seen.add(pair)
                            for name, v in zip(columns, (key[i], block_of(part), identity[i], offset[i], count[i]), strict=True):
                                columns[name].append(v)
                            texts.append(block.text(base + int(first[i]), int(count[i])))
        own = {
            "key": np.asarray(columns["key"], np.uint64).view(np.int64),
            "block": columns["block"],
            "id": np.asarray(columns["id"], np.uint64).view(np.int64),
            "offset": columns["offset"],
            "count": columns["count"],
        }
        order = np.lexsort((np.asarray(texts, object), own["key"])) if texts else np.zeros(0, np.int64)
        return _table(**{n: np.asarray(v)[order] for n, v in own.items()}, text=[texts[i] for i in order])

    sent = dealt.groupBy("block").cogroup(answers.where(F.col("kind") != _ALL).groupBy("block")).applyInArrow(
        send, "key long, block int, id long, offset int, count int, text binary"
    )

    def merge(part: pa.Table) -> pa.Table:
        part = part.sort_by([("block", "ascending")])
        key, block, offset, count = (part[c].to_numpy() for c in ("key", "block", "offset", "count"))
        marks = repeated(key, part["text"].to_pylist(), offset.astype(np.int64), count.astype(np.int64), block, length)
        some = np.flatnonzero(marks)
        return _table(block=block[some], kind=np.full(len(some), _MASK), key=part["id"].to_numpy()[some], mask=marks[some].view(np.int64))

    bucket = F.pmod(F.xxhash64("key"), F.lit(parts)).alias("bucket")
    marked = sent.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(merge, "block int, kind int, key long, mask long")
    asked_keys = answers.select("block", "kind", "key", F.lit(0).cast("long").alias("mask"))
    settled = asked_keys.unionByName(marked).repartition(parts, "block")
    more = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept else "")

    def cut(part: pa.Table, marked: pa.Table) -> pa.Table:
        kinds, keys = marked["kind"].to_numpy(), marked["key"].to_numpy().view(np.uint64)
        masks = marked["mask"].to_numpy().view(np.uint64)
        block = Block(part, length)
        lists: list[list] = [[], [], [], [], []]
        if len(part):
            removed = _removed(block, kinds, keys, masks)
            for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True):
                gone = removed[a:b]
                left = block.data[a:b][~gone].tobytes()
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                for values, value in zip(lists, (b - a, int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left if kept else None), strict=True):
                    values.append(value)
        columns = {"doc_id": pa.chunked_array([block.ids.combine_chunks()]) if len(part) else pa.array([], pa.int64())}
        columns |= {n: pa.array(v, pa.int64()) for n, v in zip(("n_bytes", "n_removed", "n_spans"), lists, strict=False)}
        columns["kept_sha256"] = pa.array(lists[3], pa.string())
        if kept:
            columns["kept"] = pa.array(lists[4], pa.binary())
        return pa.table(columns)

    return dealt.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(cut, f"doc_id long, {more}")


def _contexts(spans: Spans, wanted: dict[int, np.ndarray]):
    """Spans to merge, whole ones and those in parts: key, first string, strings, offset, identity."""
    rows = np.flatnonzero(np.isin(spans.key, wanted[_ASK]))
    yield spans.key[rows], spans.first[rows], spans.count[rows], spans.offset[rows], spans.whole[rows]
    rows = np.flatnonzero(np.isin(spans.key, wanted[_SPLIT]))
    if len(rows):
        row, key, first, count, offset = spans.parts(rows)
        yield key, first, count, offset, spans.hashed(first, first + count - 1 + spans.length, offset)


def _removed(block: Block, kinds: np.ndarray, keys: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Bytes of the block covered by a string that starts earlier, in another block or in this one."""
    length = block.length
    spans = block.all_spans()
    n = len(spans["key"])
    gone = np.zeros(n, np.uint64)
    full = (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - np.maximum(spans["count"], 1).astype(np.uint64))) if n else gone
    # Repeated as a whole in an earlier block.
    gone[np.isin(spans["key"], keys[kinds == _ALL])] = _U(0xFFFFFFFFFFFFFFFF)
    # Marks of the merge.
    ids, own = keys[kinds == _MASK], masks[kinds == _MASK]
    order = np.argsort(ids, kind="stable")
    ids, own = ids[order], own[order]
    if len(ids) and n:
        at = np.minimum(np.searchsorted(ids, spans["whole"]), len(ids) - 1)
        hit = ids[at] == spans["whole"]
        gone[hit] |= own[at[hit]]
    split = np.unique(keys[kinds == _SPLIT])
    if len(split) and len(ids):
        start = 0
        for _, chunk in block.chunks():
            rows = np.flatnonzero(np.isin(chunk.key, split))
            if len(rows):
                row, _, first, count, offset = chunk.parts(rows)
                identity = chunk.hashed(first, first + count - 1 + length, offset)
                at = np.minimum(np.searchsorted(ids, identity), len(ids) - 1)
                hit = np.flatnonzero(ids[at] == identity)
                shift = (first[hit] - chunk.first[row[hit]]).astype(np.uint64)
                np.bitwise_or.at(gone, start + row[hit], own[at[hit]] << shift)
            start += len(chunk.key)
    # Inside the block: spans come in the order of the texts.
    order = np.lexsort((np.arange(n), spans["whole"], spans["key"]))
    key, whole = spans["key"][order], spans["whole"][order]
    again = np.zeros(n, bool)
    again[1:] = (key[1:] == key[:-1]) & (whole[1:] == whole[:-1])
    gone[order[again]] = _U(0xFFFFFFFFFFFFFFFF)
    single, key = order[~again], key[~again]
    if len(single) > 1:
        same = key[1:] == key[:-1]
        several = np.zeros(len(single), bool)
        several[1:] |= same
        several[:-1] |= same
        rows = np.sort(single[several])
        if len(rows):
            texts = [block.text(int(f), int(c)) for f, c in zip(spans["first"][rows], spans["count"][rows], strict=True)]
            gone[rows] |= repeated(spans["key"][rows], texts, spans["offset"][rows], spans["count"][rows], rows, length)
    gone &= full
    change = np.zeros(len(block.data) + 1, np.int32)
    some = np.flatnonzero(gone)
    for i in range(WINDOW):
        starts = spans["first"][some[(gone[some] >> _U(i) & _U(1)) > 0]] + i
        change[starts] += 1  # a place starts one string only
        np.subtract.at(change, starts + length, 1)
    return np.cumsum(change[:-1]) > 0
