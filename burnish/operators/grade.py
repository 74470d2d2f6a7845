"""How close a submitted table is to the expected one.

Scores keep these rules, on which the published numbers rest:

* cells are compared without case and outer whitespace; null equals empty;
* a row is the tuple of its values in the sorted order of its own header
  texts, so a renamed column still matches if it sorts to the same place, and
  any column too many breaks every row;
* rows are divided by all expected rows, repeated ones included;
* cells are compared for submitted rows whose first column is the first column
  of an expected row; unmatched rows cost nothing, repeated ones count again;
* of expected rows with one key the last counts;
* header texts are compared without case for the column score, but exactly
  when cells are looked up; a column that is absent reads as empty;
* every part, and the total, lies within [0.01, 0.99].

Header texts can differ in case only, so columns are addressed by position.

Each side is read more than once, so tables that are costly to work out should
be stored before they are graded.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.text import normalized
from burnish.operators.ordering import Plain, first_per, names
from burnish.operators.profile import row_digest
from burnish.session import settle

# Bounds of every score and the default weights.
LOWEST, HIGHEST = 0.01, 0.99
WEIGHTS = (0.2, 0.2, 0.6)


class Graded:
    """A table seen by the grader: header texts, and cells named by position."""

    def __init__(self, df: DataFrame, order: str | Sequence[str] | None = None):
        aside = names(order)
        place = [i for i, c in enumerate(df.columns) if c not in aside]
        self.headers = [df.columns[i] for i in place]
        # A repeated header stands once, at its first place, with its last values.
        self.at = {h: f"c{n}" for n, h in enumerate(self.headers)}
        by_position = df.toDF(*[f"p{i}" for i in range(len(df.columns))])
        self.order = [f"o{n}" for n in range(len(aside))]
        self.cells = by_position.select(
            *[normalized(F.col(f"p{i}").cast("string")).alias(f"c{n}") for n, i in enumerate(place)],
            *[F.col(f"p{df.columns.index(c)}").alias(o) for c, o in zip(aside, self.order)],
        )

    def cell(self, header: str) -> Column:
        return F.col(self.at[header]) if header in self.at else F.lit("")

    @property
    def key(self) -> Column:
        return self.cell(self.headers[0])

    def digests(self) -> DataFrame:
        return self.cells.select(row_digest([self.cell(h) for h in sorted(self.at)]).alias("digest"))


def bounded(score: Column | float) -> Column:
    return F.least(F.lit(HIGHEST), F.greatest(F.lit(LOWEST), score if isinstance(score, Column) else F.lit(score)))


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def row_counts(submitted: Graded, expected: Graded) -> DataFrame:
    """One row: n_matched distinct rows on both sides, n_expected, n_submitted.

    The intersection is one grouped aggregation over digests of both sides:
    no join, a digest per row in the shuffle, repeats merged before it.
    """
    sides = (
        expected.digests().withColumns({"e": F.lit(1), "s": F.lit(0)})
        .unionByName(submitted.digests().withColumns({"e": F.lit(0), "s": F.lit(1)}))
    )
    per_row = sides.groupBy("digest").agg(F.sum("e").alias("e"), F.sum("s").alias("s"))
    zero = F.lit(0).cast("bigint")
    return per_row.agg(
        F.count_if((F.col("e") > 0) & (F.col("s") > 0)).alias("n_matched"),
        F.coalesce(F.sum("e"), zero).alias("n_expected"),
        F.coalesce(F.sum("s"), zero).alias("n_submitted"),
    )


def cell_counts(submitted: Graded, expected: Graded) -> DataFrame:
    """One row: n_correct and n_cells over submitted rows with an expected key.

    The expected rows, one per key, are settled first: both sides of the join are
    then plain shuffles, and Spark splits a key that many submitted rows have.
    """
    compared = list(expected.at)
    truth = expected.cells.select(
        expected.key.alias("_key"),
        *[expected.cell(h).alias(f"e{i}") for i, h in enumerate(compared)],
        *expected.order,
    )
    # Without a row order the greatest row stands for the last, so that the answer is fixed.
    latest = expected.order or [f"e{i}" for i in range(len(compared))]
    last = first_per(truth, ["_key"], [F.col(c).desc() for c in latest]).drop(*expected.order)
    given = submitted.cells.select(
        submitted.key.alias("_key"), *[submitted.cell(h).alias(f"s{i}") for i, h in enumerate(compared)]
    )
    pairs = given.join(settle(last, "expected"), "_key")
    right = reduce(
        lambda a, b: a + b, [(F.col(f"e{i}") == F.col(f"s{i}")).cast("bigint") for i in range(len(compared))]
    )
    return pairs.agg(
        F.coalesce(F.sum(right), F.lit(0)).alias("n_correct"),
        (F.count(F.lit(1)) * len(compared)).alias("n_cells"),
    )


def _empty_score(submitted_empty: Column | bool) -> Column:
    """Score against an expected side with nothing in it: all right only if nothing was given."""
    given = submitted_empty if isinstance(submitted_empty, Column) else F.lit(submitted_empty)
    return F.when(given, HIGHEST).otherwise(LOWEST)


def _row_score() -> Column:
    return F.when(F.col("n_expected") == 0, _empty_score(F.col("n_submitted") == 0)).otherwise(
        bounded(_ratio("n_matched", "n_expected"))
    )


def column_score(submitted: Sequence[str], expected: Sequence[str]) -> float:
    """Expected headers found among the submitted ones; headers too many cost nothing."""
    if not expected:
        return LOWEST if submitted else HIGHEST
    found = {h.strip().lower() for h in expected} & {h.strip().lower() for h in submitted}
    return max(LOWEST, min(HIGHEST, len(found) / len(expected)))


def grade_rows(submitted: DataFrame, expected: DataFrame) -> DataFrame:
    counts = row_counts(Graded(submitted), Graded(expected))
    return counts.select("*", _row_score().alias("row_score"))


def grade_columns(submitted: DataFrame, expected: DataFrame) -> float:
    return column_score(submitted.columns, expected.columns)


def grade_cells(
    submitted: DataFrame, expected: DataFrame, order: str | Sequence[str] | None = None
) -> DataFrame:
    """Cell score of tables that both have rows; ``order`` are columns of ``expected``."""
    counts = cell_counts(Graded(submitted), Graded(expected, order))
    return counts.select("*", bounded(_ratio("n_correct", "n_cells")).alias("cell_score"))


def grade(
    submitted: DataFrame | None,
    expected: DataFrame,
    order: str | Sequence[str] | None = None,
    weights: Sequence[float] = WEIGHTS,
) -> DataFrame:
    """One row: row_score, column_score, cell_score, reward.

    ``order`` names columns that give the row order; they are no part of the
    tables. A missing submission, or either side without columns or rows, gets
    the lowest reward.
    """
    # A table that could not be read has no columns at all.
    aside = names(order) if expected.columns else []
    hand = None if submitted is None else Graded(submitted, [c for c in aside if c in submitted.columns])
    truth = Graded(expected, aside)
    if hand is None or not hand.headers or not truth.headers:
        spark = expected.sparkSession
        lowest = [F.lit(LOWEST).alias(c) for c in ("row_score", "column_score", "cell_score", "reward")]
        return spark.range(1).select(*lowest)

    parts = (
        row_counts(hand, truth)
        .unionByName(cell_counts(hand, truth), allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in ("n_matched", "n_expected", "n_submitted", "n_correct", "n_cells")])
    )
    scored = parts.select(
        "*",
        _row_score().alias("row_score"),
        F.lit(column_score(hand.headers, truth.headers)).alias("column_score"),
        bounded(_ratio("n_correct", "n_cells")).alias("cell_score"),
    )
    return scored.select("row_score", "column_score", "cell_score", _reward(weights).alias("reward"))


@dataclass(frozen=True)
class Sheets:
    """Tables of many tasks as one: ``task``, ``cells`` (texts by column), ``place`` (order of the rows, or null).

    ``headers`` holds each task's header texts; a task that is not among them could not be read.
    """

    rows: DataFrame
    headers: Mapping[str, Sequence[str]]

    @classmethod
    def of(cls, tables: Mapping[str, DataFrame], order: str | Sequence[str] | None = None) -> Sheets:
        """From frames, each with its cells as texts; ``order`` columns, of the same types in all that have them, are set aside."""
        aside, parts, headers = names(order), [], {}
        for task, df in tables.items():
            if not df.columns:
                continue
            plain = Plain.of(df)
            cells = [f"c{i}" for i, h in enumerate(df.columns) if h not in aside]
            own = plain.names([c for c in aside if c in df.columns])
            place = F.struct(*own) if own else F.lit(None)
            headers[task] = [h for h in df.columns if h not in aside]
            parts.append(
                plain.table.select(
                    F.lit(task).alias("task"), F.array(*[F.col(c).cast("string") for c in cells]).alias("cells"), place.alias("place")
                )
            )
        if not parts:
            raise ValueError("no table that could be read")
        return cls(reduce(DataFrame.unionByName, parts), headers)

    def sorted_places(self, task: str) -> list[int]:
        """Columns in the order of their headers; a repeated one stands once, with its last values."""
        last = {h: i for i, h in enumerate(self.headers[task])}
        return [last[h] for h in sorted(last)]

    def places(self, task: str, headers: Iterable[str]) -> list[int]:
        """Columns of the given headers, -1 for one that is absent."""
        last = {h: i for i, h in enumerate(self.headers[task])}
        return [last.get(h, -1) for h in headers]


def _picked(places: str) -> Column:
    """Cells at the places, in the form in which they are compared; an absent one is empty."""
    cell = lambda i: F.when(i >= 0, F.get("cells", i))
    return F.transform(places, lambda i: normalized(cell(i)))


def grade_sheets(submitted: Sheets, expected: Sheets, tasks: Sequence[str], weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Rows (task, row_score, column_score, cell_score, reward): ``grade`` for every task, in one keyed job.

    However many tasks there are, all rows meet in one aggregation by task and digest, and all cells in one join by
    task and key. What differs from task to task, the places of its columns, is a row of a small table. The expected
    rows, one per task and key, are settled before the join, so that Spark splits a hot key.
    """
    spark = submitted.rows.sparkSession
    plan, lowest = [], []
    for task in tasks:
        if not (submitted.headers.get(task) and expected.headers.get(task)):
            lowest.append(task)
            continue
        e, s = expected.headers[task], submitted.headers[task]
        compared = list(dict.fromkeys(e))
        plan.append((
            task, column_score(s, e), expected.sorted_places(task), submitted.sorted_places(task),
            expected.places(task, compared), submitted.places(task, compared),
            expected.places(task, e[:1]), submitted.places(task, s[:1]),
        ))
    kinds = "task string, column_score double, e_sorted array<int>, s_sorted array<int>, e_cells array<int>, s_cells array<int>"
    plans = spark.createDataFrame(plan, f"{kinds}, e_key array<int>, s_key array<int>")

    def side(sheets: Sheets, of: str) -> DataFrame:
        where = plans.select(F.col("task").alias("of"), *(F.col(f"{of}_{c}").alias(f"at_{c}") for c in ("sorted", "cells", "key")))
        rows = sheets.rows.join(F.broadcast(where), F.col("task") == F.col("of"))  # rows stay where they are
        key = F.get(_picked("at_key"), F.lit(0))
        return rows.select("task", "place", _picked("at_sorted").alias("row"), _picked("at_cells").alias("compared"), key.alias("key"))

    truth, given = side(expected, "e"), side(submitted, "s")

    def digests(rows: DataFrame, of: str) -> DataFrame:
        lengths = F.transform("row", lambda c: F.octet_length(c).cast("string"))
        digest = F.md5(F.concat_ws(",", F.size("row").cast("string"), lengths, "row"))
        return rows.select("task", digest.alias("digest"), F.lit(int(of == "e")).alias("e"), F.lit(int(of == "s")).alias("s"))

    per_row = digests(truth, "e").unionByName(digests(given, "s")).groupBy("task", "digest").agg(F.sum("e").alias("e"), F.sum("s").alias("s"))
    rows = per_row.groupBy("task").agg(
        F.count_if((F.col("e") > 0) & (F.col("s") > 0)).alias("n_matched"), F.sum("e").alias("n_expected"), F.sum("s").alias("n_submitted")
    )
    # The last row of a key by its place, else the greatest one.
    last = truth.groupBy("task", "key").agg(F.max(F.struct("place", "compared")).alias("last"))
    last = settle(last.select(F.col("task").alias("of"), F.col("key").alias("of_key"), F.col("last.compared").alias("wanted")), "expected")
    pairs = given.join(last, (F.col("task") == F.col("of")) & (F.col("key") == F.col("of_key")))
    right = F.size(F.filter(F.zip_with("wanted", "compared", lambda a, b: a == b), lambda x: x)).cast("bigint")
    cells = pairs.groupBy("task").agg(F.sum(right).alias("n_correct"), F.sum(F.size("wanted").cast("bigint")).alias("n_cells"))
    counts = ("n_matched", "n_expected", "n_submitted", "n_correct", "n_cells")
    parts = rows.unionByName(cells, allowMissingColumns=True).groupBy("task").agg(*[F.max(c).alias(c) for c in counts])
    own = plans.select(F.col("task").alias("of"), "column_score").join(parts, F.col("of") == F.col("task"), "left")
    own = own.select(F.col("of").alias("task"), "column_score", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts))
    scored = own.select("*", _row_score().alias("row_score"), bounded(_ratio("n_correct", "n_cells")).alias("cell_score"))
    scored = scored.select("task", "row_score", "column_score", "cell_score", _reward(weights).alias("reward"))
    if not lowest:
        return scored
    bottom = spark.createDataFrame([(t, LOWEST, LOWEST, LOWEST, LOWEST) for t in lowest], scored.schema)
    return scored.unionByName(bottom)


def _reward(weights: Sequence[float]) -> Column:
    """Weighted total of the three scores; the lowest if either side has no rows."""
    row, column, cell = weights
    total = row * F.col("row_score") + column * F.col("column_score") + cell * F.col("cell_score")
    both = (F.col("n_expected") > 0) & (F.col("n_submitted") > 0)
    return F.when(both, bounded(total)).otherwise(F.lit(LOWEST))
