"""Clean tables of five domains and their messy twins, at any size.

Every cell is a function of (seed, column, row number): rows need no state, no
order and no shuffle, and a lost task makes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions.chance import choose, draw, happens, pick
from burnish.functions.dirt import (
    BLANK_RATE,
    COPY_RATE,
    dirty_case,
    dirty_date,
    dirty_email,
    dirty_price,
    maybe_blank,
    random_date,
)
from burnish.functions.missing import padded_id
from burnish.plans import words as W
from burnish.sources.tables import write_table

ROW, COPY = "_row", "_copy"

# (key, seed, column name) -> clean value
Maker = Callable[[Column, int, str], Column]
# (clean value, chance) -> dirty value
Spoiler = Callable[[Column, Column], Column]


def ident(prefix: str, width: int) -> Maker:
    """Numbered from 1."""
    return lambda k, seed, name: padded_id(k + 1, prefix, width)


def one_of(listed: Sequence[str]) -> Maker:
    return lambda k, seed, name: choose(listed, k, seed, name)


def full_name(first: Sequence[str], last: Sequence[str]) -> Maker:
    return lambda k, seed, name: F.concat(
        choose(first, k, seed, f"{name} first"), F.lit(" "), choose(last, k, seed, f"{name} last")
    )


def address(first: Sequence[str], last: Sequence[str], domain: str) -> Maker:
    def make(k: Column, seed: int, name: str) -> Column:
        given = F.lower(choose(first, k, seed, f"{name} first"))
        family = F.lower(choose(last, k, seed, f"{name} last"))
        return F.concat(given, F.lit("."), family, F.lit(f"@{domain}"))

    return make


def day() -> Maker:
    return lambda k, seed, name: random_date(k, seed, name).cast("string")


def whole(low: int, high: int, prefix: str = "") -> Maker:
    """Whole number from low to high, both included."""
    return lambda k, seed, name: F.concat(
        F.lit(prefix), (pick(high - low + 1, k, seed, name) + low).cast("string")
    )


def decimal(low: int, high: int, scale: int) -> Maker:
    """Number with ``scale`` decimals, bounds given in units of the last one."""
    unit = 10**scale

    def make(k: Column, seed: int, name: str) -> Column:
        n = pick(high - low + 1, k, seed, name) + low
        tail = F.lpad((n % unit).cast("string"), scale, "0")
        return F.concat(F.floor(n / unit).cast("string"), F.lit("."), tail)

    return make


@dataclass(frozen=True)
class Domain:
    """Columns in table order, how some are spoilt, and which may go blank."""

    columns: Mapping[str, Maker]
    dirt: Mapping[str, Spoiler]
    blanks: Sequence[str]


# Id formats, number ranges and which column takes which dirt.
DOMAINS = {
    "hr": Domain(
        {
            "employee_id": ident("EMP", 4),
            "name": full_name(W.HR_FIRST_NAMES, W.HR_LAST_NAMES),
            "department": one_of(W.DEPARTMENTS),
            "salary": whole(40000, 150000),
            "hire_date": day(),
            "city": one_of(W.CITIES),
            "email": address(W.HR_FIRST_NAMES, W.HR_LAST_NAMES, "company.com"),
        },
        {
            "name": dirty_case,
            "department": dirty_case,
            "salary": dirty_price,
            "hire_date": dirty_date,
            "email": dirty_email,
        },
        ("salary", "email", "city"),
    ),
    "healthcare": Domain(
        {
            "patient_id": ident("PT", 5),
            "name": full_name(W.PATIENT_FIRST_NAMES, W.PATIENT_LAST_NAMES),
            "condition": one_of(W.CONDITIONS),
            "appointment_date": day(),
            "doctor": one_of(W.DOCTORS),
            "insurance_id": whole(100000, 999999, "INS-"),
            "status": one_of(W.VISIT_STATUSES),
        },
        {
            "name": dirty_case,
            "condition": dirty_case,
            "appointment_date": dirty_date,
            "doctor": dirty_case,
            "status": dirty_case,
        },
        ("insurance_id", "status"),
    ),
    "finance": Domain(
        {
            "transaction_id": ident("TXN", 6),
            "date": day(),
            "merchant": one_of(W.MERCHANTS),
            "category": one_of(W.SPENDING_CATEGORIES),
            "amount": decimal(500, 50000, 2),
            "payment_method": one_of(W.PAYMENT_METHODS),
            "status": one_of(W.PAYMENT_STATUSES),
        },
        {
            "merchant": dirty_case,
            "category": dirty_case,
            "amount": dirty_price,
            "date": dirty_date,
            "payment_method": dirty_case,
            "status": dirty_case,
        },
        ("payment_method", "status"),
    ),
    "logistics": Domain(
        {
            "tracking_id": ident("TRK", 7),
            "origin": one_of(W.ORIGINS),
            "destination": one_of(W.DESTINATIONS),
            "carrier": one_of(W.CARRIERS),
            "weight_kg": decimal(5, 5000, 1),
            "ship_date": day(),
            "status": one_of(W.SHIPPING_STATUSES),
        },
        {
            "origin": dirty_case,
            "destination": dirty_case,
            "carrier": dirty_case,
            "ship_date": dirty_date,
            "status": dirty_case,
        },
        ("weight_kg", "status"),
    ),
    "education": Domain(
        {
            "student_id": ident("STU", 4),
            "name": full_name(W.STUDENT_FIRST_NAMES, W.STUDENT_LAST_NAMES),
            "subject": one_of(W.SUBJECTS),
            "grade": one_of(W.GRADES),
            "semester_date": day(),
            "credits": one_of(W.CREDITS),
            "status": one_of(W.STUDENT_STATUSES),
        },
        {
            "name": dirty_case,
            "subject": dirty_case,
            "semester_date": dirty_date,
            "status": dirty_case,
        },
        ("credits", "status"),
    ),
}


def clean_rows(rows: DataFrame, domain: str, seed: int, key: str = ROW) -> DataFrame:
    """Clean table with one row per ``key`` (whole numbers from 0), which stays as _row."""
    k = F.col(key).cast("bigint")
    made = [make(k, seed, name).alias(name) for name, make in DOMAINS[domain].columns.items()]
    return rows.select(k.alias(ROW), *made)


def spoil(
    df: DataFrame,
    dirt: Mapping[str, Spoiler],
    blanks: Sequence[str],
    seed: int,
    key: str = ROW,
    blank_rate: float = BLANK_RATE,
) -> DataFrame:
    """Dirty columns, then blanks.

    The draws get a projection of their own: in one piece the generated method
    would be too long for the JVM to compile, and run several times slower.
    """
    k = F.col(key)
    chances = {f"_dirt_{n}": draw(k, seed, f"dirt {n}") for n in dirt}
    chances |= {f"_blank_{n}": draw(k, seed, f"blank {n}") for n in blanks}

    def cell(name: str) -> Column:
        c = F.col(name)
        if name in dirt:
            c = dirt[name](c, F.col(f"_dirt_{name}"))
        return maybe_blank(c, F.col(f"_blank_{name}"), blank_rate) if name in blanks else c

    return df.withColumns(chances).select(*[cell(n).alias(n) for n in df.columns])


def with_copies(
    clean: DataFrame, messy: Callable[[DataFrame], DataFrame], seed: int, key: str = ROW, rate: float = COPY_RATE
) -> DataFrame:
    """Messy rows, some with a clean copy put before; ``_copy`` is 0 for the copy, else 1.

    Two narrow branches over the same rows: no shuffle, no array per row.
    """
    copied = clean.where(happens(rate, key, seed, "copy")).withColumn(COPY, F.lit(0))
    return copied.unionByName(messy(clean).withColumn(COPY, F.lit(1)))


def messy_rows(clean: DataFrame, domain: str, seed: int) -> DataFrame:
    """Messy twin of ``clean_rows``, in the order (_row, _copy)."""
    d = DOMAINS[domain]
    return with_copies(clean, lambda df: spoil(df, d.dirt, d.blanks, seed), seed)


def domain_seed(place: int) -> int:
    """42 for the first domain, 100 more for each next."""
    return 42 + 100 * place


def write_pairs(rows: DataFrame, folder: str, n_domains: int = len(DOMAINS)) -> list[str]:
    """Write ``<domain>_clean.csv`` and ``<domain>_messy.csv`` for the first domains.

    ``rows`` has the row numbers, from 0, in ``_row``; see ``numbered``.
    """
    done = list(DOMAINS)[:n_domains]
    for place, domain in enumerate(done):
        seed = domain_seed(place)
        clean = clean_rows(rows, domain, seed)
        write_table(clean, f"{folder}/{domain}_clean.csv", order=ROW)
        write_table(messy_rows(clean, domain, seed), f"{folder}/{domain}_messy.csv", order=[ROW, COPY])
    return done


def numbered(spark: SparkSession, n_rows: int = 30) -> DataFrame:
    return spark.range(n_rows).withColumnRenamed("id", ROW)
