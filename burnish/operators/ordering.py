"""Row order without a single-task window.

``keep first``, running ids and carry-forward need a total order over the whole
table. Rows are cut into ranges of that order, sorted inside each range and
numbered there; what crosses a range border is settled on a table with one row
per range. That table is the only thing broadcast, and it grows with the number
of partitions, not with the data. The sorted form is written out, so that the
second pass sees the same ranges even if executors are lost in between.

Callers hand in few columns, and bring the result back to the wide rows as a
patch, by an id that every row gets when it is settled: the order only sorts, so
ties and nulls in it neither lose nor multiply rows. Only rows that need the new
value take part in a join. Names of helper columns keep clear of the user's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from burnish.session import settle

# monotonically_increasing_id: partition in the upper bits, row in the lower 33.
_ROW_BITS = 33


def names(columns: str | Sequence[str] | None) -> list[str]:
    if columns is None:
        return []
    return [columns] if isinstance(columns, str) else list(columns)


def quoted(column: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any casing."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


@dataclass(frozen=True)
class Plain:
    """A table with its columns named by place: headers may differ in case only, repeat, or hold dots."""

    table: DataFrame
    headers: list[str]

    @classmethod
    def of(cls, df: DataFrame) -> Plain:
        return cls(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), df.columns)

    def name(self, header: str) -> str:
        """The plain name of a header: the one written so, else the only one that is alike up to case."""
        alike = [i for i, h in enumerate(self.headers) if h.lower() == header.lower()]
        exact = [i for i in alike if self.headers[i] == header]
        if not exact and len(alike) != 1:
            raise ValueError(f"{'no' if not alike else 'more than one'} column {header!r} among {self.headers}")
        return f"c{(exact or alike)[0]}"

    def names(self, headers: str | Sequence[str] | None) -> list[str]:
        return [self.name(h) for h in names(headers)]

    def back(self, df: DataFrame, *more: str) -> DataFrame:
        """A result with the plain columns in their order, under its headers again; ``more`` are new columns behind them."""
        return df.toDF(*self.headers, *more)


@dataclass(frozen=True)
class Ranged:
    """A settled table in ranges of an order: ``slot`` numbers its rows, ``range`` its ranges."""

    table: DataFrame
    slot: str
    range: str


def in_ranges(df: DataFrame, order: Sequence[str]) -> Ranged:
    """Range-partitioned, sorted and numbered copy."""
    slot, place = fresh(df, "slot", "range")
    by = [quoted(c) for c in order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(slot, F.monotonically_increasing_id())
    return Ranged(settle(placed, "ranges").withColumn(place, F.shiftright(slot, _ROW_BITS)), slot, place)


def with_position(df: DataFrame, order: str | Sequence[str], position: str = "position") -> DataFrame:
    """Add the 1-based place of each row in the total ``order``; ties fall either way.

    One range shuffle of the columns handed in, so hand in few.
    """
    plain = Plain.of(df)
    ranged = in_ranges(plain.table, plain.names(order))
    n, start, of = fresh(ranged.table, "n", "start", "of")
    before = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.table.groupBy(F.col(ranged.range).alias(of)).agg(F.count(F.lit(1)).alias(n))
    starts = starts.select(of, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    row = F.col(ranged.slot).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = ranged.table.join(F.broadcast(starts), F.col(ranged.range) == F.col(of))
    placed = placed.select(*plain.table.columns, (F.col(start) + row + 1).alias("place"))
    return plain.back(placed, position)


def carry_forward(
    df: DataFrame,
    value: str,
    order: str | Sequence[str],
    carried: str = "carried",
    group: str | Sequence[str] | None = None,
) -> DataFrame:
    """Add the last non-null ``value`` up to and including each row, per group.

    A group may span many ranges, so a third of all rows in one group is as well
    spread as any other. Values are carried along each range as it lies, sorted, in
    the task that sorts it; what a range inherits comes from the one-row-per-range
    table. So the rows are shuffled once.
    """
    plain = Plain.of(df)
    group, order, seen = plain.names(group), plain.names(order), plain.name(value)
    table = plain.table
    places, at_value = [table.columns.index(c) for c in group], table.columns.index(seen)
    slot, place, found, mark, inherited, at, whose = fresh(table, "slot", "range", "found", "group", "inherited", "at", "whose")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flags(found: pa.Array) -> np.ndarray:
            return found.fill_null(False).to_numpy(zero_copy_only=False)

        def alike(a: pa.Array, b: pa.Array) -> np.ndarray:
            same = flags(pc.equal(a, b)) | flags(a.is_null()) & flags(b.is_null())
            return same | flags(pc.is_nan(a)) & flags(pc.is_nan(b)) if pa.types.is_floating(a.type) else same

        before, last = None, None  # the group columns and the carried value of the last row so far
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            columns, values = [batch.column(i) for i in places], batch.column(at_value)
            row = np.arange(n)
            begins = np.zeros(n, bool)
            begins[0] = before is None
            for j, column in enumerate(columns):
                begins[1:] |= ~alike(column.slice(1), column.slice(0, n - 1))
                if before is not None:
                    begins[0] |= not alike(column.slice(0, 1), before[j])[0]
            first = np.maximum.accumulate(np.where(begins, row, -1))
            seen_at = np.maximum.accumulate(np.where(flags(values.is_valid()), row, -1))
            # The group's last value so far; in a group that goes on from the batch before, else what that had.
            source = np.where(seen_at >= np.maximum(first, 0), seen_at, np.where(first < 0, n, -1))
            if last is None:
                last = pa.nulls(1, values.type)
            known = pa.concat_arrays([values, last]).take(pa.array(np.maximum(source, 0), mask=source < 0))
            before, last = [c.slice(n - 1, 1) for c in columns], known.slice(n - 1, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, known], names=[*batch.schema.names, found])

    by = [F.col(c) for c in [*group, *order]]
    shape = StructType([*table.schema.fields, StructField(found, table.schema[seen].dataType)])
    sorted_in_ranges = table.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(carry, shape)
    placed = settle(sorted_in_ranges.withColumn(slot, F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn(place, F.shiftright(slot, _ROW_BITS))
    placed = placed.withColumn(mark, F.struct(*map(F.col, group)) if group else F.lit(0))

    # Groups lie next to each other, so a range hands on what its last row has, and a range that is all one
    # group without a value passes on what it got.
    ends = placed.groupBy(F.col(place).alias(at)).agg(F.max_by(mark, slot).alias(whose), F.max_by(found, slot).alias(found))
    in_group = Window.partitionBy(whose).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    handed_on = ends.select(
        F.lead(at).over(Window.orderBy(at)).alias(at),
        whose,
        F.last(found, ignorenulls=True).over(in_group).alias(inherited),
    ).where(F.col(at).isNotNull() & F.col(inherited).isNotNull())
    same = (F.col(place) == F.col(at)) & F.col(mark).eqNullSafe(F.col(whose))
    joined = placed.join(F.broadcast(handed_on), same, "left")
    return plain.back(joined.select(*table.columns, F.coalesce(found, inherited)), carried)


def with_row_ids(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Settled copy of ``df`` with an id per row, and the id's column."""
    (row,) = fresh(df, "row")
    return settle(df.withColumn(row, F.monotonically_increasing_id()), name), row


@dataclass(frozen=True)
class Patch:
    """New values for the rows of ``column`` where ``needed`` holds.

    ``values`` has two columns, the row id and the value. A row without one
    keeps what it has.
    """

    column: str
    needed: Column
    values: DataFrame


def apply_patches(df: DataFrame, row: str, patches: Sequence[Patch]) -> DataFrame:
    """Rows that need nothing go straight through; the others are joined to the patches by row id.

    ``df`` comes from ``with_row_ids``; the id column is gone afterwards.
    """
    any_needed = reduce(lambda a, b: a | b, [p.needed for p in patches])
    rows, new = df.where(any_needed), {}
    for i, p in enumerate(patches):
        of, value = fresh(rows, f"of{i}", f"new{i}")
        rows = rows.join(p.values.toDF(of, value), F.col(row) == F.col(of), "left")
        new[p.column] = F.coalesce(F.col(value), quoted(p.column))
    kept = [c for c in df.columns if c != row]
    patched = rows.select(*[new.get(c, quoted(c)).alias(c) for c in kept])
    return df.where(~any_needed).select(*map(quoted, kept)).unionByName(patched)


def first_per(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key.

    Spark keeps one row per key and map task before the shuffle, so a key with
    a third of all rows costs no task more than one row per map task.
    """
    (place,) = fresh(df, "place")
    by = [quoted(c) if isinstance(c, str) else c for c in order]
    number = F.row_number().over(Window.partitionBy(*[quoted(k) if isinstance(k, str) else k for k in key]).orderBy(*by))
    return df.withColumn(place, number).where(F.col(place) == 1).drop(place)


def order_key(order: Sequence[str]) -> Column:
    return quoted(order[0]) if len(order) == 1 else F.struct(*map(quoted, order))
