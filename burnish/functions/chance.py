"""Reproducible choice: integer hashing of (seed, name, row key).

Only whole-number arithmetic, so it stays in generated code, gives the same
answer on any partitioning or task retry, and any SQL engine can repeat it.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnish.functions.text import col

# Two primes below 2^31: the change of modulus breaks the straight line that one
# multiplication would draw, without naming any part of the expression twice.
MODULUS, SECOND = 2**31 - 1, 2**31 - 19
_HIGH = 69621


def stream(seed: int, name: str) -> tuple[int, int, int]:
    """Two multipliers and a summand that tell one stream of draws from another."""
    a, b, c = (zlib.crc32(f"{seed}:{name}:{part}".encode()) for part in "abc")
    return a % (MODULUS - 1) + 1, b % (SECOND - 1) + 1, c % SECOND


def draw(key: Column | str, seed: int, name: str) -> Column:
    """Whole number in [0, SECOND) for a non-negative integer ``key``."""
    k = col(key).cast("bigint")
    a, b, c = (F.lit(x).cast("bigint") for x in stream(seed, name))
    x = ((k % F.lit(MODULUS)) * a + F.shiftright(k, 31) * F.lit(_HIGH) + c) % F.lit(MODULUS)
    return (x * b + c) % F.lit(SECOND)


def pick(n: int, key: Column | str, seed: int, name: str) -> Column:
    """Whole number in [0, n)."""
    return draw(key, seed, name) % F.lit(n)


def under(rate: float, chance: Column) -> Column:
    """True for a ``rate`` of all draws."""
    return chance < F.lit(int(rate * SECOND))


def happens(rate: float, key: Column | str, seed: int, name: str) -> Column:
    return under(rate, draw(key, seed, name))


def choose(words: Sequence[str], key: Column | str, seed: int, name: str) -> Column:
    listed = F.array(*[F.lit(w) for w in words])
    return F.get(listed, pick(len(words), key, seed, name).cast("int"))
