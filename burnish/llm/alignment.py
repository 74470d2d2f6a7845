"""Alignment of two tokenizers: which tokens of one end where tokens of the other end.

Every text is encoded whole by both tokenizers: space and text by a byte-level BPE (side A), text by a piece
model that puts the space there itself (side B). Where side A's merges are known to be the ranks of its ids, the
library that encodes by ranks does that part; its ids are the same. Token bytes tell where tokens start and end. A place at which a
space-marked token of both sides starts is an anchor: it is checked to be a shared end of the tokens before it,
and it cuts the two token sequences into windows, about one per word. A window is a pair of id tuples; few of them
are distinct, so windows of a chunk of texts are numbered by their ids, each distinct one is aligned once, and the
rest are looked up by number.

Inside a window, byte offsets where both sides have a token end cut the tokens into groups. The last tokens of a
group's two sides end together: they are the group's link. (No token of either vocabulary is without bytes, so no
further pair ends together; a vocabulary with such a token is refused.)

How it spreads: texts are taken as they lie, in chunks of about ``CHUNK_BYTES``, a chunk per long text. A chunk's
distinct windows, linked pairs and counts are written with its documents, once; so are the totals' only inputs.
Pairs are counted corpus-wide by a shuffle of chunk counts, not of documents, and the totals a chunk asked for go
back to it. What one task holds is a chunk.

Defined results: a text that is null, empty, or whose tokens' bytes are not those of space and text on either side
has no tokens: zeros and an empty ``groups_sha256``. Special tokens' strings inside texts are plain text. Rows
repeat as given and count as often; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.bpe import Vocabulary, byte_letters
from burnish.llm.common import bounded_batches, mixed, only, result, texts
from burnish.session import settle

CHUNK_BYTES = 4 << 20  # of the texts whose windows share a table, about
STRETCH = 1 << 19  # letters from which on a text is encoded in stretches

# Fixed values of the vocabulary files' formats: the sign that stands for a space, the pattern of words.
SPACE_SIGN = "▁"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Between these a space starts a token on both sides, whatever stands around: encoding on both sides of it is
# encoding the whole.
_BORDER = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


@dataclass
class Side:
    """Bytes of every token of one side, their number, and whether the token starts with a space."""

    spelt: list[bytes]
    names: list[str] = field(init=False)
    sizes: np.ndarray = field(init=False)
    spaced: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.names = [str(i) for i in range(len(self.spelt))]
        self.sizes = np.asarray([len(t) for t in self.spelt], np.int64)
        self.spaced = np.asarray([t[:1] == b" " for t in self.spelt])


class Tokenizers:
    """The two vocabulary files' contents; picklable. A Python worker opens each once."""

    def __init__(self, path_a: str, path_b: str) -> None:
        with open(path_a, encoding="utf-8") as file:
            self.spec_a = file.read()
        with open(path_b, "rb") as file:
            self.spec_b = file.read()
        self.ranked = _ranked(path_a, json.loads(self.spec_a))
        self._opened = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_opened": None}

    def opened(self) -> Opened:
        if self._opened is None:
            self._opened = Opened(self)
        return self._opened


def _ranked(path: str, spec: dict) -> bool:
    """Whether encoding by ids as ranks gives the same ids: plain byte-level words, merges in the order of the ids
    they make, and every token the encoding of its own bytes, so that no other pair of tokens ever makes it."""
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    cut = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or {k: cut.get(k, True) for k in byte_level} != byte_level:
        return False
    words = Vocabulary(path)
    made = sorted(words.rank.items())
    return len(words.reached) == len(words.ids) - len(set(words.special) & set(words.ids)) and made == [
        (first, rank) for rank, (first, _) in enumerate(made)
    ]


class Opened:
    """Both tokenizers, ready to encode, and the bytes of their tokens."""

    def __init__(self, files: Tokenizers) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: the task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.spec_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.spec_b)
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        names = self.a.get_vocab(with_added_tokens=True)
        spelt: list[bytes] = [b"\xff"] * (max(names.values()) + 1)
        for name, i in names.items():
            spelt[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        self.side_a = Side(spelt)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.side_b = Side(
            [
                bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode()
                for i, p in enumerate(pieces)
            ]
        )
        if not (self.side_a.sizes.all() and self.side_b.sizes.all()):
            raise ValueError("a token without bytes")
        # A piece that holds a space behind another letter would run over a border.
        self.cuts = not any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in pieces)
        self.by_rank = None
        if files.ranked:
            import tiktoken

            special = {t["content"] for t in json.loads(files.spec_a)["added_tokens"]}
            ranks = {spelt[i]: i for name, i in names.items() if name not in special}
            self.by_rank = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def stretches(self, text: str) -> list[str]:
        """The text cut at spaces that tokens of neither side run over; a space is left out at each cut."""
        if len(text) <= STRETCH or not self.cuts:
            return [text]
        out, at = [], 0
        while len(text) - at > STRETCH and (border := _BORDER.search(text, at + STRETCH)):
            out.append(text[at : border.start()])
            at = border.end()
        return [*out, text[at:]]

    def encoded(self, batch: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids on both sides of every text; none where the bytes differ from space and text."""
        cut = [self.stretches(text) if text else [] for text in batch]
        flat = [s for own in cut for s in own]
        spaced = [" " + s for s in flat]
        if self.by_rank:
            done_a = [self.by_rank.encode_ordinary(s) for s in spaced]
        else:
            done_a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        done_b = self.b.encode(flat, num_threads=1) if flat else []
        all_a, all_b, at = [], [], 0
        spell_a, spell_b = self.side_a.spelt.__getitem__, self.side_b.spelt.__getitem__
        for text, own in zip(batch, cut, strict=True):
            ids_a = done_a[at] if len(own) == 1 else [i for ids in done_a[at : at + len(own)] for i in ids]
            ids_b = done_b[at] if len(own) == 1 else [i for ids in done_b[at : at + len(own)] for i in ids]
            at += len(own)
            want = b" " + text.encode()
            if not text or b"".join(map(spell_b, ids_b)) != want or b"".join(map(spell_a, ids_a)) != want:
                ids_a, ids_b = [], []
            all_a.append(ids_a)
            all_b.append(ids_b)
        return all_a, all_b


def window_cuts(
    ids_a: np.ndarray, ids_b: np.ndarray, side_a: Side, side_b: Side, firsts_a: np.ndarray, firsts_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens that begin a window, on both sides, in texts that lie one behind the other.

    ``firsts_a`` and ``firsts_b`` are the places of the texts' first tokens, which begin windows too.
    """
    starts, marked = [], []
    for ids, side in ((ids_a, side_a), (ids_b, side_b)):
        sizes = side.sizes[ids]
        starts.append(np.cumsum(sizes) - sizes)
        marked.append(side.spaced[ids])
    at_byte = np.zeros((2, int(max(starts[0][-1], starts[1][-1])) + 1), bool)
    for row in range(2):
        at_byte[row, starts[row][marked[row]]] = True
    # A start of a token is the end of the one before: what both sides have is a shared end.
    cuts = []
    for row, firsts in ((0, firsts_a), (1, firsts_b)):
        begins = marked[row] & at_byte[1 - row, starts[row]]
        begins[firsts] = True
        cuts.append(np.flatnonzero(begins))
    return cuts[0], cuts[1]


def window_numbers(sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each window among the distinct ones, and for each of those a window that is one.

    ``sides``: ids and window starts of both sides. Windows are told apart by 64-bit sums over ids and places, then
    compared id by id with the one they are taken for.
    """
    sums = np.zeros(len(sides[0][1]), np.uint64)
    places = []
    for salt, (ids, cuts) in enumerate(sides):
        sizes = np.diff(cuts, append=len(ids))
        place = np.arange(len(ids)) - np.repeat(cuts, sizes)
        with np.errstate(over="ignore"):
            sums += np.add.reduceat(mixed(ids.astype(np.uint64) + (place.astype(np.uint64) * 2 + np.uint64(salt) << np.uint64(32))), cuts)
        places.append((sizes, place))
    _, first, number = np.unique(sums, return_index=True, return_inverse=True)
    taken = first[number]
    for (ids, cuts), (sizes, place) in zip(sides, places, strict=True):
        if (sizes != sizes[taken]).any() or (ids != ids[np.repeat(cuts[taken], sizes) + place]).any():
            known: dict[tuple, int] = {}  # two windows with one sum
            keys = zip(*([tuple(w) for w in np.split(ids, cuts[1:])] for ids, cuts in sides), strict=True)
            number = np.asarray([known.setdefault(key, len(known)) for key in keys])
            return number, np.unique(number, return_index=True)[1]
    return number, first


def aligned(sides: list[tuple[np.ndarray, np.ndarray]], some: np.ndarray, bytes_of: list[Side]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Groups of some windows as text, one text a window; their links, one number per pair of ids; links a window."""
    flat, window, ends = [], [], []
    for (ids, cuts), side in zip(sides, bytes_of, strict=True):
        sizes = np.diff(cuts, append=len(ids))[some]
        last = np.cumsum(sizes)
        own = ids[np.repeat(cuts[some] - last + sizes, sizes) + np.arange(int(sizes.sum()))].astype(np.int64)
        flat.append(own)
        window.append(np.repeat(np.arange(len(some)), sizes))
        ends.append(np.cumsum(side.sizes[own]))
    # Both sides spell the same bytes, window by window: places where tokens of both end close a group.
    at_byte = np.zeros((2, int(ends[0][-1]) + 1), bool)
    for row in range(2):
        at_byte[row, ends[row]] = True
    closes = [at_byte[1 - row, ends[row]] for row in range(2)]
    group = [np.cumsum(c) - c for c in closes]
    links = flat[0][closes[0]] << 32 | flat[1][closes[1]]
    n_links = np.bincount(window[0][closes[0]], minlength=len(some))
    # A group's tokens of side A, then those of side B, each followed by its sign.
    members = [np.bincount(g, minlength=len(links)) for g in group]
    before_a, before_b = np.cumsum(members[1]) - members[1], np.cumsum(members[0])
    places = [np.arange(len(flat[0])) + before_a[group[0]], np.arange(len(flat[1])) + before_b[group[1]]]
    ids, sign = np.empty(len(flat[0]) + len(flat[1]), np.int64), np.zeros(len(flat[0]) + len(flat[1]), np.int8)
    for own, place in zip(flat, places, strict=True):
        ids[place] = own
    ends_window = np.append(window[1][1:] != window[1][:-1], True)
    sign[places[0][closes[0]]] = 1
    sign[places[1]] = np.where(ends_window, 3, np.where(closes[1], 2, 0))
    names = max(bytes_of, key=lambda side: len(side.names)).names
    spelt = chain.from_iterable(zip(map(names.__getitem__, ids.tolist()), map(",|;\n".__getitem__, sign.tolist()), strict=True))
    return "".join(spelt).split("\n")[:-1], links, n_links


class Chunk:
    """Texts whose distinct windows are aligned once."""

    def __init__(self, opened: Opened) -> None:
        self.opened = opened
        self.doc_ids: list = []
        self.ids: tuple[list[np.ndarray], list[np.ndarray]] = [], []  # of both sides, per document
        self.size = 0

    def add(self, doc_ids: list, batch: list[str]) -> None:
        self.doc_ids += doc_ids
        self.size += sum(map(len, batch))
        for own, found in zip(self.ids, self.opened.encoded(batch), strict=True):
            own += [np.frombuffer(array("i", ids), np.int32) for ids in found]

    def windows(self) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray]:
        """Each document's windows by number; of each number the groups, all links in order, links a number."""
        opened = self.opened
        ids_a, ids_b = (np.concatenate(own) for own in self.ids)
        if not len(ids_a):
            return [np.zeros(0, np.int32)] * len(self.doc_ids), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends_a, ends_b = (np.cumsum([len(ids) for ids in own]) for own in self.ids)
        filled = np.diff(ends_a, prepend=0) > 0
        firsts = [np.concatenate([[0], ends[filled][:-1]]) for ends in (ends_a, ends_b)]
        cuts = window_cuts(ids_a, ids_b, opened.side_a, opened.side_b, *firsts)
        sides = [(ids_a, cuts[0]), (ids_b, cuts[1])]
        number, some = window_numbers(sides)
        per_doc = np.split(number.astype(np.int32), np.searchsorted(cuts[0], ends_a[:-1]))
        return per_doc, *aligned(sides, some, [opened.side_a, opened.side_b])

    def rows(self, chunk: int, id_type: pa.DataType) -> pa.RecordBatch:
        """One row per document; the first holds the chunk's pairs, their counts, and the windows' links."""
        per_doc, groups, links, sizes = self.windows()
        pairs, at = np.unique(links, return_inverse=True)
        seen = np.bincount(np.concatenate(per_doc), minlength=len(sizes))
        counts = np.bincount(at, np.repeat(seen, sizes), len(pairs)).astype(np.int64)
        others = [None] * (len(self.doc_ids) - 1)
        columns = {
            "chunk": pa.array([chunk] * len(self.doc_ids), pa.int64()),
            "doc_id": pa.array(self.doc_ids, id_type),
            "n_a": pa.array([len(ids) for ids in self.ids[0]], pa.int64()),
            "n_b": pa.array([len(ids) for ids in self.ids[1]], pa.int64()),
            "n_groups": pa.array([int(sizes[own].sum()) for own in per_doc], pa.int64()),
            "groups_sha256": pa.array([_digest(map(groups.__getitem__, own.tolist())) for own in per_doc], pa.string()),
            "windows": pa.array([own.tobytes() for own in per_doc], pa.binary()),
            "pairs": pa.array([pairs, *others], pa.list_(pa.int64())),
            "counts": pa.array([counts, *others], pa.list_(pa.int64())),
            "sizes": pa.array([sizes.astype(np.int32).tobytes(), *others], pa.binary()),
            "links": pa.array([at.astype(np.int32).tobytes(), *others], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _digest(groups: Iterator[str]) -> str:
    joined = ";".join(groups)
    return hashlib.sha256(joined.encode()).hexdigest() if joined else ""


def windowed(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its chunk, token counts, groups, and windows by number in the chunk; see ``Chunk.rows``.

    The vocabularies are broadcast; their size is that of the files.
    """
    spark = bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Tokenizers(path_a, path_b))
    rows = only(docs, doc_id=doc_id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = shared.value.opened()
        number = TaskContext.get().partitionId() << 32
        chunk, id_type = Chunk(opened), pa.null()
        for batch in batches:
            id_type = batch.column(0).type
            ids, all_texts = batch.column(0).to_pylist(), texts(batch.column(1))
            at = 0
            while at < len(ids):
                end, size = at, 0
                while end < len(ids) and (end == at or size + len(all_texts[end]) <= CHUNK_BYTES // 8):
                    size += len(all_texts[end])
                    end += 1
                if chunk.doc_ids and chunk.size + size > CHUNK_BYTES:
                    yield chunk.rows(number, id_type)
                    number, chunk = number + 1, Chunk(opened)
                chunk.add(ids[at:end], all_texts[at:end])
                at = end
        if chunk.doc_ids:
            yield chunk.rows(number, id_type)

    more = "n_a long, n_b long, n_groups long, groups_sha256 string, windows binary"
    more += ", pairs array<long>, counts array<long>, sizes binary, links binary"
    shape = result(rows, ["doc_id"], f"chunk long, {more}")
    order = ["chunk", "doc_id", *(f.split()[0] for f in more.split(", "))]
    return rows.mapInArrow(run, type(shape)([shape[name] for name in order]))


def linked_pairs(chunks: DataFrame) -> DataFrame:
    """Counts of every linked pair of ids over all of ``windowed``'s chunks: ``pair``, ``a_id``, ``b_id``, ``n``, ``best``.

    ``best``: no other pair with this ``b_id`` has a higher count.
    """
    pairs = _chunk_pairs(chunks).groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = pairs.withColumn("a_id", F.shiftright("pair", 32)).withColumn("b_id", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    # At most as many rows meet in one window as side A has tokens.
    best = F.col("n") == F.max("n").over(Window.partitionBy("b_id"))
    return pairs.select("pair", "a_id", "b_id", "n", best.alias("best"))


def _chunk_pairs(chunks: DataFrame) -> DataFrame:
    held = chunks.where(F.col("pairs").isNotNull()).select("chunk", F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    return held.select("chunk", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))


def alignments(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    Texts are encoded once; what they give is written under the shared folder.
    """
    chunks = settle(windowed(docs, path_a, path_b, doc_id, text), "aligned")
    totals = linked_pairs(chunks).select("pair", "n", "best")
    asked = _chunk_pairs(chunks).select(F.col("chunk").alias("asker"), "pair").join(totals, "pair")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = chunks.drop("pairs", "counts")
    shape = result(rows, ["doc_id"], "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    def count(part: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers["pair"].to_numpy())
        n, best = answers["n"].to_numpy()[order], answers["best"].to_numpy()[order].astype(np.int64)
        table = part.filter(part["sizes"].is_valid())
        sizes, links = (np.frombuffer(table[c][0].as_py(), np.int32) for c in ("sizes", "links"))
        # Sums per window: links are numbered by their pair's place in the chunk's sorted pairs.
        window = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.zeros((2, len(sizes)), np.int64)
        for row, values in enumerate((best, n)):
            np.add.at(sums[row], window, values[links])
        numbers = [np.frombuffer(w, np.int32) for w in part["windows"].to_pylist()]
        return pa.table(
            [
                *(part[c] for c in ("doc_id", "n_a", "n_b", "n_groups")),
                part["n_groups"],
                *(pa.array([int(s[own].sum()) for own in numbers], pa.int64()) for s in sums),
                part["groups_sha256"],
            ],
            names=kept,
        )

    return rows.groupBy("chunk").cogroup(asked.groupBy("asker")).applyInArrow(count, shape)
