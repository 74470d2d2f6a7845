"""What several operators share: column checks, Arrow batches, byte views of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.session import shipped

# Rows and bytes of one Arrow batch: keeps a Python worker small when texts are long.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20  # of the texts that one task holds
_SLOTS = 21  # bits of the first-try table of a gram lookup


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Limit what one Arrow batch holds, so that very long texts do not add up; ship the code."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def only(df: DataFrame, **names: str) -> DataFrame:
    """The named columns under the operator's own names; any other column stays out.

    Columns are taken by position, so names with dots or differing in case do no harm.
    """
    place = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    renamed = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return renamed.select(*(F.col(f"_{place[name]}").alias(own) for own, name in names.items()))


def result(rows: DataFrame, kept: list[str], more: str) -> T.StructType:
    """Schema of a result: columns of ``rows`` as they are, then new ones as DDL.

    A column that is only handed through, such as ``doc_id``, may be a struct of a whole row.
    """
    return T.StructType([rows.schema[name] for name in kept] + T.StructType.fromDDL(more).fields)


def bucket_of(id_column: Column, parts: int) -> Column:
    """CRC-32 of the id written as text, modulo ``parts``; a null id counts as no text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % parts


def blocks_for(texts: DataFrame, least: int = 12) -> int:
    """Number of blocks for a shuffle of whole texts: enough that one holds about ``BLOCK_BYTES``, however much there is,
    and no fewer than the session's shuffle partitions."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [text or "" for text in column.to_pylist()]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of the texts in them; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts that together hold about ``most`` bytes; one long text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit words so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(32)
    return x


def padded(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ``order`` zero bytes before each, so that contexts end at a text's border."""
    lengths = np.diff(offsets)
    starts = offsets[:-1] + order * np.arange(1, len(lengths) + 1)
    out = np.zeros(len(data) + order * len(lengths), np.uint8)
    out[np.arange(len(data)) + np.repeat(order * np.arange(1, len(lengths) + 1), lengths)] = data
    return out, starts


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte of each text, the byte with the ``order`` bytes before it, as one number."""
    out, _ = padded(data, offsets, order)
    wide = out.astype(np.uint32)
    packed = wide.copy()
    for back in range(1, order + 1):
        packed[back:] |= wide[:-back] << np.uint32(8 * back)
    keep = np.ones(len(out), bool)
    starts = offsets[:-1] + order * np.arange(len(offsets) - 1)
    for back in range(order):
        keep[starts + back] = False
    return packed[keep]


class Lookup:
    """Rows of known grams (sorted): a direct table for most, a sorted search for the rest."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.slots = np.zeros(1 << _SLOTS, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(self.keys))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOTS)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """Row of each gram, -1 if unknown."""
        if not len(self.keys):
            return np.full(len(grams), -1, np.int32)
        rows = self.slots[self._slot(grams)]
        late = np.flatnonzero(self.keys[rows] != grams)
        found = np.minimum(np.searchsorted(self.keys, grams[late]), len(self.keys) - 1).astype(np.int32)
        rows[late] = np.where(self.keys[found] == grams[late], found, -1)
        return rows


# Bytes of words: letters and digits of ASCII, and all of UTF-8's longer characters.
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_SPACE_BYTE = np.ones(256, bool)
_SPACE_BYTE[[*range(0x09, 0x0E), 0x20]] = False
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[ord("A") : ord("Z") + 1] += 32
# A random number per byte value, and a random odd factor per place: a word's hash is their sum of products.
_BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_POWERS = _powers(1 << 16, _BASE)
_INVERSES = _powers(1 << 16, pow(_BASE, -1, 1 << 64))


class Words:
    """Words of many texts as 64-bit hashes: ``hashes``, and ``text``, the number of each word's text.

    ``starts`` and ``ends`` are the words' places in ``data``. Words are stretches of letters and digits
    (``spaced`` false) or of anything but ASCII white space (``spaced`` true); A-Z counts as a-z.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, spaced: bool) -> None:
        self.data = _ASCII_LOWER[data]
        inside = (_SPACE_BYTE if spaced else _WORD_BYTE)[self.data]
        if not spaced:
            # Latin-1 signs (C2 xx) and general punctuation (E2 80 xx, E2 81 xx) divide words too.
            lead = np.flatnonzero(data == 0xC2)
            inside[lead] = inside[np.minimum(lead + 1, len(data) - 1)] = False
            lead = np.flatnonzero(data == 0xE2)
            lead = lead[(data[np.minimum(lead + 1, len(data) - 1)] & 0xFE) == 0x80]
            for k in range(3):
                inside[np.minimum(lead + k, len(data) - 1)] = False
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        fresh[first] = inside[first]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | fresh[1:]
        self.starts, self.ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.hashes = self._hashed()

    def _hashed(self) -> np.ndarray:
        out = np.zeros(len(self.starts), np.uint64)
        step = len(_POWERS)
        with np.errstate(over="ignore"):
            # Stretches of whole words that fit the table of powers; a longer word is hashed by itself.
            word = 0
            while word < len(self.starts):
                base = self.starts[word]
                stop = int(np.searchsorted(self.ends, base + step, "right"))
                if stop == word:
                    out[word] = self._long(int(base), int(self.ends[word]))
                    word += 1
                    continue
                stretch = self.data[base : self.ends[stop - 1]]
                sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_HASH[stretch] * _POWERS[: len(stretch)])])
                a, b = self.starts[word:stop] - base, self.ends[word:stop] - base
                out[word:stop] = (sums[b] - sums[a]) * _INVERSES[a]
                word = stop
            return mixed(out + np.uint64(0x632BE59BD9B4E019) * (self.ends - self.starts).astype(np.uint64))

    def _long(self, start: int, end: int) -> np.uint64:
        total, factor = np.uint64(0), np.uint64(1)
        for at in range(start, end, len(_POWERS)):
            part = self.data[at : min(at + len(_POWERS), end)]
            total += factor * np.sum(_BYTE_HASH[part] * _POWERS[: len(part)])
            factor *= _POWERS[-1] * np.uint64(_BASE)
        return total

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of every ``k`` words in a row; a shorter text has its whole sequence as one."""
        counts = np.bincount(self.text, minlength=int(self.text[-1]) + 1) if len(self.text) else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            n = len(self.hashes)
            if n >= k:
                whole = self.hashes[: n - k + 1].copy()
                for j in range(1, k):
                    whole = mixed(whole) + self.hashes[j : n - k + 1 + j]
                whole = mixed(whole)
                same = self.text[: n - k + 1] == self.text[k - 1 :]
                hashes, texts_ = whole[same], self.text[: n - k + 1][same]
            else:
                hashes, texts_ = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            short = np.flatnonzero((counts > 0) & (counts < k))
            if len(short):
                first = np.searchsorted(self.text, short)
                extra = np.zeros(len(short), np.uint64)
                for i, (text, at) in enumerate(zip(short, first, strict=True)):
                    h = np.uint64(counts[text])
                    for j in range(counts[text]):
                        h = mixed(h) + self.hashes[at + j]
                    extra[i] = mixed(h)
                hashes, texts_ = np.concatenate([hashes, extra]), np.concatenate([texts_, short])
                order = np.argsort(texts_, kind="stable")
                hashes, texts_ = hashes[order], texts_[order]
        return hashes, texts_
