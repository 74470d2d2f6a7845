"""Missing cells: null and the empty text are the same thing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnish.functions.text import col, strip


def is_blank(c: Column | str) -> Column:
    """Null, empty or nothing but whitespace."""
    return F.coalesce(strip(c) == "", F.lit(True))


def blank_to_null(c: Column | str, tokens: Iterable[str] = ()) -> Column:
    """Empty text, and any of ``tokens`` (``NA``, ``null`` ...), become null."""
    c = col(c)
    return F.when(c.isin("", *tokens), None).otherwise(c)


def fill_text(c: Column | str, value: str = "Unknown") -> Column:
    return F.coalesce(blank_to_null(c), F.lit(value))


def fill_number(c: Column | str, value: Column | float = 0) -> Column:
    """Null and NaN become ``value``; the column is numeric."""
    c = col(c)
    return F.when(c.isNull() | F.isnan(c), value if isinstance(value, Column) else F.lit(value)).otherwise(c)


def padded_id(n: Column, prefix: str, width: int) -> Column:
    """``P007``; a number wider than ``width`` keeps all its digits."""
    digits = n.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))
