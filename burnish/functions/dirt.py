"""The dirt a cleaning job has to undo, put on clean values.

Each rule takes the value and a chance: a whole-number column from
``chance.draw`` that decides which dirt it gets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnish.functions.chance import pick, under
from burnish.functions.dates import iso_date
from burnish.functions.text import col

# Span of the random dates and the two probabilities.
FIRST_DAY, DAYS = "2023-01-01", 1096
BLANK_RATE, COPY_RATE = 0.08, 0.05
PAD = "  "


def _nothing(c: Column) -> Column:
    """Empty and missing values have nothing to spoil."""
    return F.when(c.isNull() | (c == ""), "")


def _padded(c: Column) -> Column:
    return F.concat(F.lit(PAD), c, F.lit(PAD))


def random_date(key: Column | str, seed: int, name: str) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), pick(DAYS, key, seed, name).cast("int"))


def dirty_date(c: Column | str, chance: Column | str) -> Column:
    """One of five formats, of which two are alike; a text that is no ISO date stays."""
    c, n = col(c), col(chance) % 5
    year, month, day = F.substring(c, 1, 4), F.substring(c, 6, 2), F.substring(c, 9, 2)

    def joined(sep: str, *parts: Column) -> Column:
        return F.concat_ws(sep, *parts)

    short = joined("/", F.ltrim(month, F.lit("0")), F.ltrim(day, F.lit("0")), F.substring(c, 3, 2))
    return (
        _nothing(c)
        .when(iso_date(c).isNull(), c)
        .when(n == 0, joined("/", month, day, year))
        .when(n == 1, joined("-", month, day, year))
        .when(n == 4, joined("-", day, month, year))
        .otherwise(short)
    )


def dirty_case(c: Column | str, chance: Column | str) -> Column:
    """Upper, lower, padded or untouched: names and categories alike."""
    c, n = col(c), col(chance) % 4
    return _nothing(c).when(n == 0, F.upper(c)).when(n == 1, F.lower(c)).when(n == 2, _padded(c)).otherwise(c)


def dirty_email(c: Column | str, chance: Column | str) -> Column:
    """Upper, ``@`` lost, domain cut to ``@example``, padded or untouched."""
    c, n = col(c), col(chance) % 5
    return (
        _nothing(c)
        .when(n == 0, F.upper(c))
        .when(n == 1, F.replace(c, F.lit("@"), F.lit("")))
        .when(n == 2, F.concat(F.substring_index(c, "@", 1), F.lit("@example")))
        .when(n == 3, _padded(c))
        .otherwise(c)
    )


def dirty_price(c: Column | str, chance: Column | str) -> Column:
    """``$x``, ``x USD``, padded ``$x`` or untouched."""
    c, n = col(c), col(chance) % 4
    dollar = F.concat(F.lit("$"), c)
    return (
        _nothing(c)
        .when(n == 0, dollar)
        .when(n == 1, F.concat(c, F.lit(" USD")))
        .when(n == 2, _padded(dollar))
        .otherwise(c)
    )


def maybe_blank(c: Column | str, chance: Column | str, rate: float = BLANK_RATE) -> Column:
    return F.when(under(rate, col(chance)), "").otherwise(col(c))
