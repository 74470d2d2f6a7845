"""Fills that need to see the whole column, and row drops."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from burnish.functions.dates import iso_date, month_start
from burnish.functions.missing import is_blank
from burnish.functions.numbers import fixed_scale
from burnish.functions.text import strip
from burnish.operators.ordering import Patch, Plain, apply_patches, carry_forward, fresh, quoted, with_row_ids

# Quantiles of one look, rows a sketch may be off by (one in so many), quantiles on either side of those that enclose
# the middle, and values a task may sort.
_QUANTILES, _ACCURACY, _SLACK, _FEW = 1000, 10_000, 1, 1 << 22


def drop_missing(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Drop rows where any of ``columns`` is null or blank."""
    plain = Plain.of(df)
    kept = F.lit(True)
    for c in plain.names(columns):
        kept = kept & ~(is_blank(c) if _is_text(plain.table, c) else F.col(c).isNull())
    return plain.back(plain.table.where(kept))


def _is_text(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] == "string"


def _number(df: DataFrame, column: str) -> Column:
    number = strip(column).try_cast("double") if _is_text(df, column) else F.col(column).cast("double")
    return F.when(~F.isnan(number), number)


@dataclass
class _Search:
    """Where the two middle values of a column lie: between ``low`` and ``high``, both included."""

    low: float = -math.inf
    high: float = math.inf
    inside: int | None = None  # values between them, about; not known at first
    ranks: tuple[int, int] = (0, 0)
    wider: tuple[float, float] = (-math.inf, math.inf)  # where they lay before, for certain

    @property
    def shrank(self) -> bool:
        """Whether the last look left anything out; a value that many rows have may be all that is enclosed."""
        return self.low < self.high and (self.low, self.high) != self.wider

    def narrowed(self, below: int, inside: int, grid: list[float]) -> _Search:
        """From counts, and quantiles of what is inside."""
        cells = len(grid) - 1
        a, b = ((k - below) * cells // max(inside, 1) for k in self.ranks)
        low, high = grid[max(a - _SLACK, 0)], grid[min(b + 1 + _SLACK, cells)]
        return replace(self, low=low, high=high, inside=(b - a + 1 + 2 * _SLACK) * inside // cells + 1, wider=(self.low, self.high))


def medians(df: DataFrame, columns: Sequence[str]) -> list[float | None]:
    """Exact interpolated medians; null, NaN and text that is no number do not count; None without values.

    All columns are looked at together. A first job gives each column quantiles from
    mergeable sketches, two of which enclose the middle; more such jobs follow only
    while what is enclosed is too much for one task to sort. A last job counts the
    values below, and the enclosed ones each, and adds the counts up: exact, with no
    shuffle of the values outside. Sketches err by a known share of the rows; should one
    be off by more, the last job sees it and is run again on the wider bounds.
    """
    plain = Plain.of(df)
    return _medians(plain.table, plain.names(columns), [])[0]


def _medians(df: DataFrame, columns: Sequence[str], more: Sequence[Column]) -> tuple[list[float | None], Row | None]:
    """Medians of plainly named columns, and further aggregates taken along with the first look."""
    if not columns:
        return [], None
    cells = [f"v{i}" for i in range(len(columns))]
    numbers = df.select(*[_number(df, c).alias(v) for c, v in zip(columns, cells, strict=True)], *columns)
    values = numbers.select(*cells)
    grid = [k / _QUANTILES for k in range(_QUANTILES + 1)]
    searches: dict[str, _Search] = {v: _Search() for v in cells}
    first, todo = None, list(cells)
    while todo:
        looks = []
        for v in todo:
            s, cell = searches[v], F.col(v)
            inside = cell.between(s.low, s.high) if first is not None else cell.isNotNull()
            looks += [
                F.count_if(cell < s.low).alias(f"{v}_below"),
                F.count_if(inside).alias(f"{v}_inside"),
                F.percentile_approx(F.when(inside, cell), grid, _ACCURACY).alias(f"{v}_grid"),
            ]
        seen = (numbers if first is None else values).agg(*looks, *([] if first else more)).first()
        for v in todo:
            below, inside = seen[f"{v}_below"], seen[f"{v}_inside"]
            if first is None:
                searches[v].ranks = (inside - 1) // 2, inside // 2
            # A bracket that misses the middle is not used: the one before is kept, and looked through as it is.
            if inside and below <= searches[v].ranks[0] and searches[v].ranks[1] < below + inside:
                searches[v] = searches[v].narrowed(below, inside, seen[f"{v}_grid"])
            elif inside or first is not None:
                searches[v] = replace(searches[v], low=searches[v].wider[0], high=searches[v].wider[1], inside=0)
        first = first or seen
        todo = [v for v in todo if (searches[v].inside or 0) > _FEW and searches[v].shrank]
    asked = [v for v in cells if searches[v].inside is not None]
    found: dict[str, float] = {}
    while asked:
        got = _middle(values, {v: searches[v] for v in asked})
        for v in asked:
            searches[v] = replace(searches[v], low=searches[v].wider[0], high=searches[v].wider[1], wider=(-math.inf, math.inf))
        found |= got
        asked = [v for v in asked if v not in got]
    return [found.get(v) for v in cells], first


def _middle(values: DataFrame, searches: Mapping[str, _Search]) -> dict[str, float]:
    """Medians of the columns whose middle lies within the bounds."""
    cells = list(searches)
    held = []
    for i, (v, s) in enumerate(searches.items()):
        cell = F.col(v)
        kept = F.when(cell.between(s.low, s.high), cell)
        held.append(F.when(cell <= s.high, F.struct(F.lit(i).alias("column"), kept.alias("v"))))
    rows = values.select(F.explode(F.array(*held)).alias("x")).where("x is not null").select("x.column", "x.v")
    counts = rows.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    # All values below count as one, in the first place.
    up_to = Window.partitionBy("column").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("end", F.sum("n").over(up_to)).where("v is not null")
    ranks = [F.get(F.array(*[F.lit(s.ranks[j]) for s in searches.values()]), F.col("column")) for j in (0, 1)]
    holds = [F.max(F.when((F.col("end") - F.col("n") <= k) & (F.col("end") > k), F.col("v"))) for k in ranks]
    middles = placed.groupBy("column").agg(((holds[0] + holds[1]) / 2).alias("m")).where("m is not null")
    return {cells[r["column"]]: r["m"] for r in middles.collect()}


def median(df: DataFrame, column: str) -> float | None:
    """Exact interpolated median of one column; see ``medians``."""
    return medians(df, [column])[0]


def fill_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null, NaN and blank cells become the median of their column; two jobs for all columns.

    A column of text is filled with the median at the scale of its finest number;
    text that is no number stays.
    """
    plain = Plain.of(df)
    table, filled = plain.table, dict.fromkeys(plain.names(columns))
    fractions = {c: F.length(F.regexp_extract(strip(c), r"^[+-]?\d*\.(\d+)$", 1)) for c in filled if _is_text(table, c)}
    found, seen = _medians(table, list(filled), [F.coalesce(F.max(f), F.lit(0)).alias(f"scale_{c}") for c, f in fractions.items()])
    for c, middle in zip(filled, found, strict=True):
        value, cell = F.lit(middle).cast("double"), F.col(c)
        if c in fractions:
            filled[c] = F.when(is_blank(cell), F.coalesce(fixed_scale(value, seen[f"scale_{c}"]), cell)).otherwise(cell)
        else:
            filled[c] = F.when(cell.isNull() | F.isnan(cell), value).otherwise(cell)
    return plain.back(table.select(*[(filled[c] if c in filled else F.col(c)).alias(c) for c in table.columns]))


def fill_median(df: DataFrame, column: str) -> DataFrame:
    """Null, NaN and blank cells become the median of the column; see ``fill_medians``."""
    return fill_medians(df, [column])


def carried_months(df: DataFrame, column: str, order: Sequence[str], row: str, group: Sequence[str] = ()) -> Patch:
    """Only group, order, row id and date take part in the shuffles that carry dates forward."""
    date, seen = fresh(df, "date", "seen")
    whole = iso_date(quoted(column))
    slim = df.select(*map(quoted, dict.fromkeys([*group, *order, row])), whole.alias(date))
    carried = carry_forward(slim, date, [*order, row], seen, group).where(F.col(date).isNull() & F.col(seen).isNotNull())
    return Patch(column, whole.isNull(), carried.select(row, month_start(seen).cast("string")))


def fill_undated(
    df: DataFrame, column: str, order: str | Sequence[str], group: str | Sequence[str] | None = None
) -> DataFrame:
    """What is no ISO date becomes the first of the month of the last date before it.

    Run ``normalize_date`` on the column first. A row with no date before it
    keeps its text. Rows that tie in ``order`` follow each other as settled.
    """
    plain = Plain.of(df)
    rows, row = with_row_ids(plain.table, "undated")
    patch = carried_months(rows, plain.name(column), plain.names(order), row, plain.names(group))
    return plain.back(apply_patches(rows, row, [patch]))
