"""Text rules: whitespace, casing, vocabulary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Never part of a cell: marks where title_case has to restart a word.
_BREAK = "\x02"

CASES = ("upper", "lower", "title", "mixed")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Drop outer whitespace, Unicode spaces and control separators included.

    Spark's ``trim`` is fast but removes U+0020 only; with a list of characters
    it takes three times as long. So the list is used only where, spaces gone,
    the first or last character could still be one of it.
    """
    c = col(c)
    bare = F.trim(c)
    last = F.substring(bare, -1, 1)
    odd = (bare < "!") | (bare >= "\x7f") | (last < "!") | (last >= "\x7f")
    return F.when(odd, F.btrim(c, F.lit(SPACES))).otherwise(bare)


def lower_strip(c: Column | str) -> Column:
    return F.lower(strip(c))


def normalized(c: Column | str) -> Column:
    """The form in which the grader compares two cells: no null, padding or case."""
    return lower_strip(F.coalesce(col(c), F.lit("")))


def title_case(c: Column | str) -> Column:
    """Capital first letter for every run of letters: ``usb-c 10ft`` -> ``Usb-C 10Ft``.

    ``initcap`` alone restarts words at spaces only, so a marked space is put
    before each letter run that follows a digit or sign, and taken out again.
    """
    broken = F.regexp_replace(strip(c), r"(?<=[^\p{L} ])(?=\p{L})", f"{_BREAK} ")
    return F.replace(F.initcap(broken), F.lit(f"{_BREAK} "), F.lit(""))


def case_class(c: Column | str) -> Column:
    """``upper``, ``lower``, ``title`` or ``mixed``; null where there is no letter."""
    s = strip(c)
    return (
        F.when(s.isNull() | ~s.rlike(r"\p{L}"), None)
        .when(s == F.upper(s), "upper")
        .when(s == F.lower(s), "lower")
        .when(s == title_case(s), "title")
        .otherwise("mixed")
    )


def in_vocabulary(c: Column | str, words: Iterable[str], fallback: Column | None = None) -> Column:
    """True spelling of a value known up to case and padding.

    For word lists that fit in an expression; a vocabulary table goes through
    ``operators.vocabulary.canonicalize``. Unknown values become ``fallback``
    (default: the stripped value).
    """
    spellings = {w.strip().lower(): w for w in words}
    pairs = [F.lit(x) for kv in spellings.items() for x in kv]
    found = F.create_map(*pairs)[lower_strip(c)]
    return F.coalesce(found, strip(c) if fallback is None else fallback)
