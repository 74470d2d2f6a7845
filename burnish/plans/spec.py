"""A whole cleaning job, declared: per-column rules and the table-level steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.dates import DAY_FIRST, normalize_date
from burnish.functions.missing import is_blank
from burnish.functions.numbers import clean_amount, clamp_negative, coerce_number, fixed_scale
from burnish.functions.text import in_vocabulary
from burnish.operators.dedup import drop_exact_duplicates, drop_key_duplicates
from burnish.operators.fills import carried_months, drop_missing, fill_medians
from burnish.operators.ids import continued_ids, place_ids
from burnish.operators.ordering import Plain, apply_patches, fresh, names, with_row_ids
from burnish.operators.vocabulary import canonicalize, repair_domains
from burnish.session import settle

Rule = Callable[[Column], Column]


def dates(formats: Sequence[str] = DAY_FIRST) -> Rule:
    return lambda c: normalize_date(c, formats)


def amount(scale: int = 2) -> Rule:
    return lambda c: fixed_scale(clean_amount(c), scale)


def count() -> Rule:
    """Whole number, nothing below zero, 0 for blank or unreadable."""
    return lambda c: fixed_scale(clamp_negative(coerce_number(c)), 0)


def words(spellings: Sequence[str], fallback: Rule | None = None) -> Rule:
    return lambda c: in_vocabulary(c, spellings, None if fallback is None else fallback(c))


@dataclass(frozen=True)
class Ids:
    """Fill blank ids: by row place, or counting on from the highest."""

    column: str
    by_place: bool = True
    prefix: str = "P"
    width: int = 3


@dataclass(frozen=True)
class Undated:
    """Give unreadable dates the month start of the last readable one.

    The column needs a ``dates`` rule, so that readable means ISO.
    """

    column: str
    group: Sequence[str] = ()


@dataclass(frozen=True)
class CleaningSpec:
    """Steps run in this order: duplicates, row drops, column rules, medians,
    vocabulary tables, domains, dates, ids. Nothing happens that is not asked for.

    A cell that is blank before the rules counts as missing for ``medians``, even
    if a rule writes 0 for blanks.
    """

    rules: Mapping[str, Sequence[Rule]] = field(default_factory=dict)
    exact_duplicates: bool = False
    key: str | Sequence[str] | None = None
    required: Sequence[str] = ()
    vocabularies: Mapping[str, tuple[DataFrame, str]] = field(default_factory=dict)
    domains: Sequence[str] = ()
    medians: Sequence[str] = ()
    undated: Undated | None = None
    ids: Ids | None = None

    def by_place(self, plain: Plain) -> CleaningSpec:
        """The same steps for columns named by place; a rule holds for every column of its header."""
        rules = {plain.name(h): steps for h, steps in self.rules.items()}
        rules |= {f"c{i}": self.rules[h] for i, h in enumerate(plain.headers) if h in self.rules}
        return replace(
            self,
            rules=rules,
            key=plain.names(self.key),
            required=plain.names(self.required),
            vocabularies={plain.name(h): known for h, known in self.vocabularies.items()},
            domains=plain.names(self.domains),
            medians=plain.names(self.medians),
            undated=self.undated and replace(self.undated, column=plain.name(self.undated.column), group=plain.names(self.undated.group)),
            ids=self.ids and replace(self.ids, column=plain.name(self.ids.column)),
        )


def apply_rules(df: DataFrame, rules: Mapping[str, Sequence[Rule]]) -> DataFrame:
    """All column rules in one projection; runs on streams as well.

    Columns are taken by place: names may hold dots or differ in case only.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(
        *[reduce(lambda c, rule: rule(c), rules.get(n, ()), F.col(f"c{i}")).alias(n) for i, n in enumerate(df.columns)]
    )


def clean_table(df: DataFrame, spec: CleaningSpec, order: str | Sequence[str] | None = None) -> DataFrame:
    """Run the whole job. ``order`` names the columns that give the row order.

    All steps work on columns named by place, so headers may differ in case only, repeat, or hold dots.
    """
    order = names(order)
    if not order and (spec.key or spec.undated or spec.ids):
        raise ValueError("keep-first, carried dates and running ids need order columns")
    plain = Plain.of(df)
    return plain.back(_cleaned(plain.table, spec.by_place(plain), plain.names(order)))


def _cleaned(df: DataFrame, spec: CleaningSpec, order: list[str]) -> DataFrame:
    if spec.exact_duplicates:
        df = drop_exact_duplicates(df, order)
    if spec.key:
        df = drop_key_duplicates(df, spec.key, order)
    if spec.required:
        df = drop_missing(df, spec.required)
    blank = dict(zip(spec.medians, fresh(df, *(f"blank{i}" for i in range(len(spec.medians)))), strict=True))
    if blank:
        df = df.withColumns({flag: is_blank(F.col(c).cast("string")) for c, flag in blank.items()})
    df = apply_rules(df, spec.rules)
    if blank:
        df = settle(df, "ruled")
        cells = {c: F.when(~F.col(flag), F.col(c)).alias(c) for c, flag in blank.items()}
        kept = [c for c in df.columns if c not in blank.values()]
        df = fill_medians(df.select(*[cells.get(c, F.col(c)) for c in kept]), spec.medians)
    for column, (vocabulary, spelling) in spec.vocabularies.items():
        df = canonicalize(df, column, vocabulary, spelling)
    for column in spec.domains:
        df = repair_domains(df, column)
    if not (spec.undated or spec.ids):
        return df
    # Both kinds of patch read the rows several times, from one written copy.
    df, row = with_row_ids(df, "cleaned")
    patches = []
    if spec.undated:
        patches.append(carried_months(df, spec.undated.column, order, row, names(spec.undated.group)))
    if spec.ids:
        i = spec.ids
        patches.append((place_ids if i.by_place else continued_ids)(df, i.column, order, row, i.prefix, i.width))
    return apply_patches(df, row, patches)
