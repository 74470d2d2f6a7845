"""Ids for rows that have none. Rows that have one are never shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.missing import is_blank, padded_id
from burnish.operators.ordering import Patch, Plain, apply_patches, fresh, quoted, with_position, with_row_ids


def continued_ids(df: DataFrame, column: str, order: Sequence[str], row: str, prefix: str, width: int) -> Patch:
    """Only the rows without an id are put in order."""
    digits = F.regexp_extract(quoted(column), r"(\d+)", 1).try_cast("bigint")
    highest = df.agg(F.coalesce(F.max(digits), F.lit(0)).alias("n")).scalar()
    slim = df.where(is_blank(quoted(column))).select(*map(quoted, dict.fromkeys([*order, row])))
    (place,) = fresh(slim, "place")
    missing = with_position(slim, [*order, row], place)
    number = padded_id(highest + F.col(place), prefix, width)
    return Patch(column, is_blank(quoted(column)), missing.select(row, number))


def place_ids(df: DataFrame, column: str, order: Sequence[str], row: str, prefix: str, width: int) -> Patch:
    """Places are counted on the order columns and row ids alone."""
    place, gap = fresh(df, "place", "gap")
    slim = df.select(*map(quoted, dict.fromkeys([*order, row])), is_blank(quoted(column)).alias(gap))
    missing = with_position(slim, [*order, row], place).where(F.col(gap))
    return Patch(column, is_blank(quoted(column)), missing.select(row, padded_id(F.col(place), prefix, width)))


def continue_ids(
    df: DataFrame, column: str, order: str | Sequence[str], prefix: str = "P", width: int = 3
) -> DataFrame:
    """Blank ids count on from the highest number in any id, in row order.

    The number of an id is its first run of digits. ``order`` sorts only: rows
    that tie in it follow each other in the order they were settled in.
    """
    plain = Plain.of(df)
    rows, row = with_row_ids(plain.table, "ids")
    patch = continued_ids(rows, plain.name(column), plain.names(order), row, prefix, width)
    return plain.back(apply_patches(rows, row, [patch]))


def positional_ids(
    df: DataFrame, column: str, order: str | Sequence[str], prefix: str = "P", width: int = 3
) -> DataFrame:
    """A blank id becomes the 1-based place of its row in the table."""
    plain = Plain.of(df)
    rows, row = with_row_ids(plain.table, "ids")
    patch = place_ids(rows, plain.name(column), plain.names(order), row, prefix, width)
    return plain.back(apply_patches(rows, row, [patch]))
