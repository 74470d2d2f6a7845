"""Amounts and counts written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnish.functions.text import col, strip

# What Python's float() and pandas' to_numeric take for a number.
FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"
PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
NAMED = r"(?i)^[+-]?(inf|infinity|nan)$"


def _number(s: Column, regex: str) -> Column:
    # The cast alone would take '12d' for 12.0; the regex keeps it out.
    digits = F.replace(s, F.lit("_"), F.lit("")) if regex is FLOAT else s
    return F.when(s.rlike(regex), digits.try_cast("double")).when(s.rlike(NAMED), s.try_cast("double"))


def parse_float(c: Column | str) -> Column:
    """Double, or null where Python's ``float`` would refuse."""
    return _number(strip(c), FLOAT)


def is_number(c: Column | str) -> Column:
    return F.coalesce(strip(c).rlike(PLAIN), F.lit(False))


def clean_amount(c: Column | str) -> Column:
    """``$1,250.50``, ``12.50 USD`` -> double; negative, blank or unreadable -> 0.0."""
    s = col(c)
    for mark in ("$", ",", "USD"):
        s = F.replace(s, F.lit(mark), F.lit(""))
    value = F.nanvl(F.coalesce(parse_float(s), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), value)


def clamp_negative(c: Column | str) -> Column:
    """Negative, null and NaN become 0; the column keeps its numeric type."""
    c = col(c)
    return F.when((c > 0) & ~F.isnan(c), c).otherwise(F.lit(0))


def coerce_number(c: Column | str) -> Column:
    """Double, or 0.0 for anything that is no number."""
    return F.nanvl(F.coalesce(_number(strip(c), PLAIN), F.lit(0.0)), F.lit(0.0))


def fixed_scale(c: Column | str, scale: int) -> Column:
    """Text with exactly ``scale`` decimals: 200.0 -> ``200.00``."""
    c = col(c)
    return F.coalesce(c.try_cast(f"decimal(38,{scale})").cast("string"), c.cast("string"))


AMOUNT_SHAPES = {
    "plain": r"^[+-]?\d[\d,]*(\.\d+)?$",
    "dollar": r"^[+-]?\$[+-]?\d[\d,]*(\.\d+)?$",
    "usd": r"^[+-]?\d[\d,]*(\.\d+)?\s*USD$",
}


def amount_shape(c: Column | str) -> Column:
    """A key of AMOUNT_SHAPES with ``padded `` before it if padded; ``blank`` or ``other``."""
    c = col(c)
    s = strip(c)
    pad = F.when(s == c, "").otherwise("padded ")
    shape = F.when(s.isNull() | (s == ""), "blank")
    for name, regex in AMOUNT_SHAPES.items():
        shape = shape.when(s.rlike(regex), F.concat(pad, F.lit(name)))
    return shape.otherwise("other")
