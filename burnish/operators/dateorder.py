"""The order of day and month, told by the dates that read one way only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.dates import DAY_FIRST, MONTH_FIRST, dashed_order, normalize_date
from burnish.operators.ordering import Plain, fresh, names
from burnish.session import settle

DAY, MONTH = "day first", "month first"


def date_order_votes(
    df: DataFrame, column: str, group: str | Sequence[str] | None = None, default: str = DAY
) -> DataFrame:
    """One row per group: ``n_day_first``, ``n_month_first``, ``n_ambiguous`` and the ``date_order`` these make likely.

    Dates such as ``25-03-2024`` vote for the day first, ``03-25-2024`` for the month; ``03-04-2024`` is what is to be
    decided. Where neither has more votes, ``default`` stands. A group is what was written by one hand: a file, a
    source, a customer; without ``group`` the whole column is one.
    """
    if default not in (DAY, MONTH):
        raise ValueError(f"{default!r} is neither {DAY!r} nor {MONTH!r}")
    plain = Plain.of(df)
    keys, told = plain.names(group), dashed_order(plain.name(column))
    votes = [F.count_if(F.coalesce(told == kind, F.lit(False))) for kind in ("day", "month", "both")]
    counted = plain.table.groupBy(*keys).agg(*[v.alias(f"n{i}") for i, v in enumerate(votes)])
    order = F.when(F.col("n0") > F.col("n1"), DAY).when(F.col("n1") > F.col("n0"), MONTH).otherwise(default)
    counted = counted.select(*keys, "n0", "n1", "n2", order.alias("order"))
    return counted.toDF(*names(group), "n_day_first", "n_month_first", "n_ambiguous", "date_order")


def normalize_dates_voted(
    df: DataFrame, column: str, group: str | Sequence[str] | None = None, default: str = DAY
) -> DataFrame:
    """ISO dates, each group read in the order its own unambiguous dates vote for.

    Unreadable texts stay as they are, stripped. The votes are settled first, one row per group, so that Spark splits a
    group with many rows.
    """
    plain = Plain.of(df)
    cell, keys = plain.name(column), plain.names(group)
    table = plain.table
    votes = date_order_votes(table, cell, keys, default)
    if not keys:
        formats = MONTH_FIRST if votes.first().date_order == MONTH else DAY_FIRST
        read = normalize_date(cell, formats)
        return plain.back(table.select(*[(read if c == cell else F.col(c)).alias(c) for c in table.columns]))
    order, *own = fresh(table, "order", *(f"key{i}" for i in range(len(keys))))
    votes = settle(votes.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col("date_order").alias(order)), "votes")
    same = [table[k].eqNullSafe(votes[o]) for k, o in zip(keys, own, strict=True)]
    read = F.when(F.col(order) == MONTH, normalize_date(cell, MONTH_FIRST)).otherwise(normalize_date(cell, DAY_FIRST))
    joined = table.join(votes, same, "left")
    return plain.back(joined.select(*[(read if c == cell else F.col(c)).alias(c) for c in table.columns]))
