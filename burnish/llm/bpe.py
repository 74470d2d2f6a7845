"""Byte-pair encoding and decoding by dynamic programming over prefixes.

A word is encoded left to right. An automaton over the vocabulary reports, for every prefix of the
word, all tokens that end there. Exactly one of them is the last token of the prefix's encoding: the
one compatible with the last token of the prefix it leaves. That token is stored per prefix, and the
back-pointers from the end of the word spell the encoding. No merge loop runs.

Two tokens are compatible if merging their text gives the two back. That is tested by undoing merges
on both sides of the border, latest first, and looking for a merge across the border that would have
fired earlier.

Defined results: a null or empty text has no tokens and decodes to an empty text. Rows repeat as they
are given; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from burnish.llm.common import bounded_batches, only, result, texts

# Fixed values of the vocabulary file's format: word end, word pattern, white space.
WORD_END = "</w>"
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
# Characters that Python's split() takes for white space and the format does not.
NO_SPACE = regex.compile(r"[\x1c-\x1f]")
PIECES = regex.compile(rf"[^{SPACE}]+")

# What one Python worker keeps: results of pieces and of words (bytes of each of two generations, about; none of a
# longer text), and verdicts on token pairs.
KEPT_BYTES = 32 << 20
KEPT_LETTERS = 64
KEPT_PAIRS = 1_000_000
_ENTRY_BYTES = 300  # of a result, besides its letters
_END = "\x00"
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a vocabulary file; small and picklable."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Rank of the merge that makes a token, and the two tokens it joins.
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(map(tuple, spec["model"]["merges"])):
            pair = self.ids[left], self.ids[right]
            self.merges[pair] = rank
            self.rank[self.ids[left + right]] = rank
            self.parts[self.ids[left + right]] = pair
        self.reached = self._reached()

    def border_holds(self, left: int, right: int, below: int = _NEVER) -> bool:
        """Whether no merge of a rank under ``below`` joins the two tokens across their border."""
        left_used = right_used = below
        while True:
            rank = self.merges.get((left, right))
            # Of equal merges the leftmost fires first.
            if rank is not None and rank < left_used and rank <= right_used and rank < below:
                return False
            left_made, right_made = self.rank.get(left, -1), self.rank.get(right, -1)
            if left_made < 0 and right_made < 0:
                return True
            if left_made > right_made:
                left_used, left = left_made, self.parts[left][1]
            else:
                right_used, right = right_made, self.parts[right][0]

    def _reached(self) -> set[int]:
        """Tokens that are the encoding of their own text."""
        own = {i for i in self.ids.values() if i not in self.rank}
        for token, rank in self.rank.items():
            left, right = self.parts[token]
            if left in own and right in own and self.border_holds(left, right, rank):
                own.add(token)
        return own


class Kept:
    """Results of short texts seen lately, in two generations of bounded size: frequent texts stay in."""

    def __init__(self, most: int = KEPT_BYTES) -> None:
        self.most = most
        self.size = 0
        self.young: dict[str, tuple[str, str, int]] = {}
        self.old: dict[str, tuple[str, str, int]] = {}

    def get(self, text: str, make: Callable[[str], tuple[str, str, int]]) -> tuple[str, str, int]:
        got = self.young.get(text)
        if got is None:
            got = self.old.get(text) or make(text)
            if len(text) > KEPT_LETTERS:
                return got
            if self.size >= self.most:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[text] = got
            self.size += _ENTRY_BYTES + len(text) + len(got[0]) + len(got[1])
        return got


class Encoder:
    """Encodes texts in one Python worker; keeps the tokens of pieces seen lately."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.names = {i: token for token, i in vocabulary.ids.items()} | {i: t for t, i in vocabulary.special.items()}
        self.letters = byte_letters()
        self.words = regex.compile(WORDS)
        self.marks = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        self.automaton = ahocorasick.Automaton()
        for token, i in vocabulary.ids.items():
            if i in vocabulary.reached:
                name = token.removesuffix(WORD_END) + _END if token.endswith(WORD_END) else token
                self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()
        self.numbers = {i: str(i) for i in self.names}
        self.pairs: dict[int, bool] = {}
        self.pieces_kept, self.words_kept = Kept(), Kept()

    def word(self, word: str) -> tuple[str, str, int]:
        """Ids, token texts and number of tokens of one word of the pattern."""
        spelt = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        spelt += _END
        size = len(spelt)
        last = [-1] * size  # by the last letter of the prefix: token that ends its encoding
        starts = [0] * size
        pairs = self.pairs
        for end, (token, length) in self.automaton.iter(spelt):
            if last[end] >= 0:
                continue
            start = end + 1 - length
            if start:
                before = last[start - 1]
                if before < 0:
                    continue
                key = before << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= KEPT_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self.vocabulary.border_holds(before, token)
                if not fits:
                    continue
            last[end] = token
            starts[end] = start
        ids, at = [], size
        while at:
            ids.append(last[at - 1])
            at = starts[at - 1]
        ids.reverse()
        return " ".join([self.numbers[i] for i in ids]), " ".join([self.names[i] for i in ids]), len(ids)

    def piece(self, piece: str) -> tuple[str, str, int]:
        """Ids, token texts and number of tokens of a piece without white space."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        piece = piece.lower()
        get, seen = self.words_kept.get, self.words_kept.young.get
        if piece.isalpha():
            return seen(piece) or get(piece, self.word)
        done = [seen(word) or get(word, self.word) for word in self.words.findall(piece)]
        if len(done) == 1:
            return done[0]
        return " ".join([d[0] for d in done]), " ".join([d[1] for d in done]), sum([d[2] for d in done])

    def plain(self, text: str, ids: list[str], names: list[str]) -> int:
        """Append the tokens of a text without special tokens; return their number."""
        get, seen, piece = self.pieces_kept.get, self.pieces_kept.young.get, self.piece
        done = [seen(p) or get(p, piece) for p in (PIECES.findall(text) if NO_SPACE.search(text) else text.split())]
        ids += [d[0] for d in done]
        names += [d[1] for d in done]
        return sum([d[2] for d in done])

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids joined by one space, decoded text."""
        ids: list[str] = []
        names: list[str] = []
        n = at = 0
        if self.marks and "<" in text:
            for mark in self.marks.finditer(text):
                n += self.plain(text[at : mark.start()], ids, names) + 1
                ids.append(str(self.vocabulary.special[mark[0]]))
                names.append(mark[0])
                at = mark.end()
        n += self.plain(text[at:], ids, names)
        return n, " ".join(filter(None, ids)), " ".join(filter(None, names))


def _encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; one at a time."""
    if shared.value.__dict__.get("_encoder") is None:
        shared.value._encoder = Encoder(shared.value)
    return shared.value._encoder


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``ids`` (token ids joined by one space), ``decoded``, ``n_tokens``.

    The vocabulary is broadcast: its size is that of the vocabulary file.
    """
    return _run(docs, path, doc_id, text, "ids string, decoded string", lambda ids, decoded: (ids, decoded))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens`` and SHA-256 of the ids and of the decoded text."""
    return _run(
        docs, path, doc_id, text, "ids_sha256 string, decoded_sha256 string", lambda ids, decoded: (_digest(ids), _digest(decoded))
    )


def _run(docs: DataFrame, path: str, doc_id: str, text: str, columns: str, shape) -> DataFrame:
    spark = bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Vocabulary(path))
    rows = only(docs, doc_id=doc_id, text=text)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            done = [encoder.encode(t) for t in texts(batch.column(1))]
            shaped = [shape(ids, decoded) for _, ids, decoded in done]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in done], pa.int64()),
                    *(pa.array([row[k] for row in shaped], pa.string()) for k in range(2)),
                ],
                names=["doc_id", "n_tokens", *names],
            )

    return rows.mapInArrow(run, result(rows, ["doc_id"], f"n_tokens long, {columns}"))
