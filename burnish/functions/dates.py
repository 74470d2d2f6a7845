"""Dates written in many shapes -> one ISO shape."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnish.functions.text import col, strip

# The formats tried, in this order. A day-first dashed date wins
# over a month-first one unless both numbers rule it out.
FORMATS = ("yyyy-M-d", "M/d/yyyy", "M/d/yy", "d-M-yyyy", "d/M/yyyy")
# What free inference adds after those.
INFERRED = (
    "M-d-yyyy",
    "yyyy/M/d",
    "yyyy.M.d",
    "M.d.yyyy",
    "d.M.yyyy",
    "yyyyMMdd",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
)
DAY_FIRST = FORMATS + INFERRED
MONTH_FIRST = ("yyyy-M-d", "M/d/yyyy", "M/d/yy", "M-d-yyyy", "d-M-yyyy", "d/M/yyyy") + INFERRED[1:]

# Two-digit years from this one on belong to the 1900s.
PIVOT = 69

_MONTH, _DAY = "0?[1-9]|1[0-2]", "0?[1-9]|[12][0-9]|3[01]"
_YEAR = "(?!0000)[0-9]{4}"
_CLOCK = "[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]+)?)?"
# Put before the text, so that a two-digit year can take its century from it.
_CENTURIES = "1920|"
_WORDED = r"^(\p{L}{3,9} \d{1,2}, \d{4}|\d{1,2} \p{L}{3,9} \d{4})$"

# Written shapes told apart by separator and by the lengths of first and last number.
SHAPES = {
    "iso": ("-", (4, 4), (1, 2)),
    "y/m/d": ("/", (4, 4), (1, 2)),
    "m/d/yyyy": ("/", (1, 2), (4, 4)),
    "m/d/yy": ("/", (1, 2), (2, 2)),
    "dashed": ("-", (1, 2), (4, 4)),
}


def date_shape(c: Column | str) -> Column:
    """Name of the written shape: a key of SHAPES, ``blank`` or ``other``."""
    s = strip(c)
    numbers = s.rlike(r"^\d{1,4}([-/])\d{1,2}\1\d{1,4}$")
    shape = F.when(s.isNull() | (s == ""), "blank").when(~numbers, "other")
    for name, (sep, head, tail) in SHAPES.items():
        first, last = (F.octet_length(F.substring_index(s, sep, n)) for n in (1, -1))
        shape = shape.when(s.contains(sep) & first.between(*head) & last.between(*tail), name)
    return shape.otherwise("other")


def _rearrange(formats: Sequence[str], pivot: int) -> tuple[str, str]:
    """Regex and replacement that turn a text in any numeric format into ISO.

    One alternative per format, in their order. Months and days are held to
    their ranges, so a later reading gets its turn just when an earlier one is
    no date; days a month does not have are no date in any other reading.
    Groups of alternatives that did not match put nothing into the result.
    """
    early = "|".join(f"{y:02d}" for y in range(pivot))
    late = "|".join(f"{y:02d}" for y in range(pivot, 100))
    alternatives, parts, n = [], {"year": [], "month": [], "day": []}, 0

    def group(part: str, regex: str) -> str:
        nonlocal n
        n += 1
        parts[part].append(f"${n}")
        return f"({regex})"

    for fmt in formats:
        for head, year in (("19(20)", early), ("(19)20", late)) if not re.search("yyyy", fmt) else (("1920", _YEAR),):
            if "(" in head:
                n += 1
                parts["year"].append(f"${n}")
            body = re.sub(
                "y+|M|d",
                lambda m: {"M": lambda: group("month", _MONTH), "d": lambda: group("day", _DAY)}.get(
                    m.group(), lambda: group("year", year)
                )(),
                {"yyyyMMdd": "yyyyMd"}.get(fmt, fmt).replace(".", "[.]"),
            )
            if fmt == "yyyyMMdd":
                body = f"(?=[^|]{{8}}$){body}"
            clock = f"(?:{_CLOCK})?" if fmt == "yyyy-M-d" and "yyyyMMdd" in formats else ""
            alternatives.append(rf"{head}\|{body}{clock}")
    return f"^(?:{'|'.join(alternatives)})$", "-".join("".join(g) for g in parts.values())


def parse_date(c: Column | str, formats: Sequence[str] = DAY_FIRST, pivot: int = PIVOT) -> Column:
    """First of ``formats`` that yields a real date; null if none does.

    All numeric formats together are one regular expression and a cast, which
    is null for what is no date; a formatter would throw and catch at each miss.
    """
    s = strip(c)
    numeric = [f for f in formats if re.fullmatch(r"(yyyy|yy|M|d)([-/.])(M|d)\2(yyyy|yy|M|d)|yyyyMMdd", f)]
    worded = [f for f in formats if "MMM" in f]
    if len(numeric) + len(worded) < len(formats):
        raise ValueError(f"unknown date format among {formats}")
    regex, iso = _rearrange(numeric, pivot)
    parsed = F.regexp_replace(F.concat(F.lit(_CENTURIES), s), regex, iso).try_cast("date")
    if not worded:
        return parsed
    named = F.when(s.rlike(_WORDED), F.coalesce(*[F.try_to_date(F.initcap(s), f) for f in worded]))
    return F.coalesce(parsed, named)


def normalize_date(c: Column | str, formats: Sequence[str] = DAY_FIRST, pivot: int = PIVOT) -> Column:
    """ISO text of the date; what cannot be read stays as it is, stripped."""
    return F.coalesce(parse_date(c, formats, pivot).cast("string"), strip(c))


def iso_date(c: Column | str) -> Column:
    """Date of a text in exactly the form ``normalize_date`` gives, else null."""
    c = col(c)
    return F.when(c.rlike(rf"^{_YEAR}-\d{{2}}-\d{{2}}$"), c.try_cast("date"))


def ambiguous_date(c: Column | str) -> Column:
    """True for ``aa-bb-yyyy`` where both readings are real and differ."""
    s = strip(c)
    number = "(0?[1-9]|1[0-2])"
    # The same number twice, with or without a leading zero, reads one way only.
    return F.coalesce(s.rlike(rf"^(?!0?(\d+)-0?\1-){number}-{number}-\d{{4}}$"), F.lit(False))


def dashed_order(c: Column | str) -> Column:
    """What an ``aa-bb-yyyy`` tells of the order of its numbers.

    ``day`` or ``month`` if only that can stand first, ``both`` if it reads either way, ``same`` if either way is one
    date; null for all other texts.
    """
    s = strip(c)
    first, second = (F.split_part(s, F.lit("-"), F.lit(n)).try_cast("int") for n in (1, 2))
    told = (
        F.when((first > 12) & first.between(1, 31) & second.between(1, 12), "day")
        .when((second > 12) & second.between(1, 31) & first.between(1, 12), "month")
        .when(first.between(1, 12) & second.between(1, 12), F.when(first == second, "same").otherwise("both"))
    )
    return F.when(s.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), told)


def month_start(c: Column | str) -> Column:
    return F.trunc(col(c), "MM")
