"""What is wrong with a table, as rows (column, check, n_bad, n_rows, ratio).

Everything that looks at one cell is counted in a single pass with a single
one-row result. Only duplicates need a shuffle, and that of digests or keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.dates import SHAPES, ambiguous_date, date_shape
from burnish.functions.emails import valid_email
from burnish.functions.missing import is_blank
from burnish.functions.numbers import AMOUNT_SHAPES, amount_shape, is_number
from burnish.functions.text import CASES, case_class, in_vocabulary, lower_strip, strip, title_case
from burnish.operators.ordering import names

ALL_DATE_SHAPES = (*SHAPES, "blank", "other")
ALL_AMOUNT_SHAPES = (*AMOUNT_SHAPES, *(f"padded {s}" for s in AMOUNT_SHAPES), "blank", "other")
# Fixed casings a column may be meant to have.
CASINGS = {"upper": lambda c: F.upper(strip(c)), "lower": lower_strip, "title": title_case}


class Check(NamedTuple):
    """Rows where ``value``, one per row and ``kind``, is ``found`` count as bad."""

    column: str
    check: str
    kind: str
    value: Column
    found: str | bool = True


def missing_checks(columns: Iterable[str]) -> list[Check]:
    return [Check(c, "missing", "missing", is_blank(c)) for c in columns]


def padding_checks(columns: Iterable[str]) -> list[Check]:
    return [Check(c, "padded", "padded", F.col(c) != strip(c)) for c in columns]


def date_checks(columns: Iterable[str]) -> list[Check]:
    """One count per written shape, and one for dates that read two ways."""
    found = []
    for c in columns:
        found += [Check(c, f"date {s}", "date", date_shape(c), s) for s in ALL_DATE_SHAPES]
        found.append(Check(c, "date ambiguous", "ambiguous", ambiguous_date(c)))
    return found


def casing_checks(columns: Mapping[str, str | Sequence[str]]) -> list[Check]:
    """Per column its casing (``upper``, ``lower``, ``title``) or its true spellings.

    Counts values that differ from it, and how the values are in fact cased.
    """
    checks: list[Check] = []
    for c, meant in columns.items():
        right = CASINGS[meant](c) if isinstance(meant, str) else in_vocabulary(c, meant)
        checks.append(Check(c, "wrong case", "wrong case", strip(c) != right))
        checks += [Check(c, f"case {k}", "case", case_class(c), k) for k in CASES]
    return checks


def email_checks(columns: Iterable[str]) -> list[Check]:
    return [Check(c, "invalid email", "email", ~is_blank(c) & ~valid_email(c)) for c in columns]


def number_checks(columns: Iterable[str]) -> list[Check]:
    return [Check(c, "invalid number", "number", ~is_blank(c) & ~is_number(c)) for c in columns]


def amount_checks(columns: Iterable[str]) -> list[Check]:
    return [Check(c, f"amount {s}", "amount", amount_shape(c), s) for c in columns for s in ALL_AMOUNT_SHAPES]


def count_checks(df: DataFrame, checks: Sequence[Check], labels: Mapping[str, str] | None = None) -> DataFrame:
    """All checks in one aggregation; the one wide row is then turned into rows.

    ``labels``: what the result calls a column, if not by its name.

    What a check looks at is worked out once per row, in a projection, however
    many checks share it.
    """
    looked_at = {f"{c.kind} of {c.column}": c.value for c in checks}
    counted = df.select(*[value.alias(name) for name, value in looked_at.items()]).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(f"`{c.kind} of {c.column}`") == c.found).alias(f"n{i}") for i, c in enumerate(checks)],
    )
    listed = F.array(
        *[
            F.struct(F.lit((labels or {}).get(c.column, c.column)).alias("column"), F.lit(c.check).alias("check"), F.col(f"n{i}").alias("n_bad"))
            for i, c in enumerate(checks)
        ]
    )
    rows = counted.select("n_rows", F.explode(listed).alias("x"))
    return _with_ratio(rows.select("x.column", "x.check", "x.n_bad", "n_rows"))


def _with_ratio(rows: DataFrame) -> DataFrame:
    ratio = F.when(F.col("n_rows") > 0, F.col("n_bad") / F.col("n_rows")).otherwise(F.lit(0.0))
    return rows.withColumn("ratio", ratio)


def row_digest(cells: Sequence[Column]) -> Column:
    """128-bit digest of a row. The lengths go in first, so no two rows share a spelling."""
    lengths = [F.coalesce(F.octet_length(c), F.lit(-1)).cast("string") for c in cells]
    return F.md5(F.concat_ws(",", F.lit(str(len(cells))), *lengths, *cells))


def duplicate_checks(df: DataFrame, key: str | Sequence[str] | None = None) -> DataFrame:
    """Rows too many: equal rows, and rows sharing a key that is not blank."""
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(df.columns)))}
    df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    texts = [F.col(c).cast("string") for c in df.columns]
    found = [("*", "duplicate row", df.select(row_digest(texts).alias("_same")))]
    if key:
        parts = [F.col(at[c]).cast("string") for c in names(key)]
        whole = reduce(lambda a, b: a & b, [~is_blank(p) for p in parts])
        same = parts[0] if len(parts) == 1 else F.struct(*parts)
        found.append((",".join(names(key)), "duplicate key", df.select(F.when(whole, same).alias("_same"))))
    return reduce(DataFrame.unionByName, [_surplus(*f) for f in found])


def _surplus(column: str, check: str, marks: DataFrame) -> DataFrame:
    per_mark = marks.groupBy("_same").agg(F.count(F.lit(1)).alias("_n"))
    extra = F.when(F.col("_same").isNotNull(), F.col("_n") - 1).otherwise(0)
    counted = per_mark.agg(
        F.coalesce(F.sum(extra), F.lit(0)).alias("n_bad"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows")
    )
    return _with_ratio(counted.select(F.lit(column).alias("column"), F.lit(check).alias("check"), "n_bad", "n_rows"))


def profile(
    df: DataFrame,
    key: str | Sequence[str] | None = None,
    dates: Iterable[str] = (),
    amounts: Iterable[str] = (),
    numbers: Iterable[str] = (),
    emails: Iterable[str] = (),
    casing: Mapping[str, str | Sequence[str]] | None = None,
) -> DataFrame:
    """Every check for a table of text columns.

    Columns are taken by place, so headers may hold dots or differ in case only.
    Reads the table three times at most: once for all cells, once each for equal
    rows and equal keys. Store it first if it is costly to work out.
    """
    labels = {f"c{i}": c for i, c in enumerate(df.columns)}
    at = {c: i for i, c in reversed(labels.items())}
    plain = df.toDF(*labels)
    cells = (
        missing_checks(plain.columns)
        + padding_checks(plain.columns)
        + date_checks(at[c] for c in dates)
        + casing_checks({at[c]: meant for c, meant in (casing or {}).items()})
        + email_checks(at[c] for c in emails)
        + number_checks(at[c] for c in numbers)
        + amount_checks(at[c] for c in amounts)
    )
    return duplicate_checks(df, key).unionByName(count_checks(plain, cells, labels))
