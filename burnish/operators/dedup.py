"""Exact and key-based duplicate removal, first row kept."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.missing import is_blank
from burnish.operators.ordering import Plain, first_per, fresh, order_key


def drop_exact_duplicates(
    df: DataFrame, order: str | Sequence[str] | None = None, on: str | Sequence[str] | None = None
) -> DataFrame:
    """One row per distinct content; the kept row carries the first ``order``.

    ``on`` (default: every column but ``order``) says what counts as content.
    Duplicates collapse before the shuffle, so a value held by a third of all
    rows costs one row per map task.
    """
    plain = Plain.of(df)
    df, order = plain.table, plain.names(order)
    on = plain.names(on) or [c for c in df.columns if c not in order]
    if not order:
        return plain.back(df.dropDuplicates(on))
    rest = [c for c in df.columns if c not in on and c not in order]
    if rest:
        return plain.back(first_per(df, on, order))
    (first,) = fresh(df, "first")
    kept = df.groupBy(*on).agg(F.min(order_key(order)).alias(first))
    back = {c: F.col(first) if len(order) == 1 else F.col(first).getField(c) for c in order}
    return plain.back(kept.select(*[back.get(c, F.col(c)).alias(c) for c in df.columns]))


def drop_key_duplicates(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``. Reads its input once.

    Rows whose key is blank identify nothing and all stay: each gets a key of its
    own, so missing keys cannot pile up in one task.
    """
    plain = Plain.of(df)
    df, key, order = plain.table, plain.names(key), plain.names(order)
    kinds = dict(df.dtypes)
    blank = [is_blank(F.col(c)) if kinds[c] == "string" else F.col(c).isNull() for c in key]
    keyless = reduce(lambda a, b: a | b, blank)
    (own,) = fresh(df, "own")
    salted = df.withColumn(own, F.when(keyless, F.monotonically_increasing_id()))
    return plain.back(first_per(salted, [*key, own], order).drop(own))
