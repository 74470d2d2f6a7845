"""Corruption and synthesis queries: rows are made from the keys of the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions import dirt as D
from burnish.functions.chance import draw
from burnish.plans import words as W
from burnish.plans.synth import COPY, ROW, clean_rows, domain_seed, messy_rows, write_pairs
from burnish.queries import messy as M
from burnish.queries.registry import query, table
from burnish.session import scratch_path
from burnish.sources.tables import read_table

S = M.SEED


@query(f"select event_id, '2023-01-01'::date + ({M.pick_sql(1096, 'event_id', S, 'day')})::int as day from events")
def random_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", D.random_date("event_id", S, "day").alias("day"))


@query(f"select k, {M.dirty_date_sql('order_date', 'k', S, 'd')} as order_date from ({M.ORDERS_CLEAN})")
def corrupt_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.orders_clean(spark, sf_dir)
    return rows.select("k", D.dirty_date("order_date", draw("k", S, "d")).alias("order_date"))


@query(f"select k, {M.dirty_case_sql('name', 'k', S, 'n')} as name from ({M.CUSTOMERS_CLEAN})")
def corrupt_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.customers_clean(spark, sf_dir).select("k", D.dirty_case("name", draw("k", S, "n")).alias("name"))


@query(f"select k, {M.dirty_email_sql('email', 'k', S, 'e')} as email from ({M.CUSTOMERS_CLEAN})")
def corrupt_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.customers_clean(spark, sf_dir).select("k", D.dirty_email("email", draw("k", S, "e")).alias("email"))


@query(f"select k, {M.dirty_price_sql('amount', 'k', S, 'p')} as amount from ({M.ORDERS_CLEAN})")
def corrupt_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.orders_clean(spark, sf_dir).select("k", D.dirty_price("amount", draw("k", S, "p")).alias("amount"))


@query(f"select k, {M.dirty_case_sql('segment', 'k', S, 'c')} as segment from ({M.CUSTOMERS_CLEAN})")
def corrupt_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.customers_clean(spark, sf_dir).select("k", D.dirty_case("segment", draw("k", S, "c")).alias("segment"))


@query(
    f"select k, {M.blank_sql('amount', 'k', S, 'a')} as amount, {M.blank_sql('priority', 'k', S, 'b')} as priority "
    f"from ({M.ORDERS_CLEAN})"
)
def blank_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.orders_clean(spark, sf_dir)
    return rows.select(
        "k",
        D.maybe_blank("amount", draw("k", S, "blank a")).alias("amount"),
        D.maybe_blank("priority", draw("k", S, "blank b")).alias("priority"),
    )


@query(f"select k, _copy, order_id, order_date, amount, priority from ({M.ORDERS_WITH_COPIES})")
def duplicate_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.orders_with_copies(spark, sf_dir)
    return rows.select("k", "_copy", "order_id", "order_date", "amount", "priority")


# --- the five domains ---------------------------------------------------------


def _one_of(listed: list[str], seed: int, name: str) -> str:
    quoted = ", ".join(f"'{w}'" for w in listed)
    return f"([{quoted}])[1 + {M.pick_sql(len(listed), 'k', seed, name)}]"


def _pair(first: list[str], last: list[str], seed: int, name: str, glue: str) -> str:
    return f"{_one_of(first, seed, f'{name} first')} || '{glue}' || {_one_of(last, seed, f'{name} last')}"


def _numbered(prefix: str, width: int) -> str:
    return f"printf('{prefix}%0{width}d', k + 1)"


def _day(seed: int, name: str) -> str:
    return f"('2023-01-01'::date + ({M.pick_sql(1096, 'k', seed, name)})::int)::varchar"


def _range(low: int, high: int, seed: int, name: str) -> str:
    return f"({low} + {M.pick_sql(high - low + 1, 'k', seed, name)})"


def _domain_columns(domain: str, seed: int) -> dict[str, str]:
    s = seed
    if domain == "hr":
        mail = _pair(W.HR_FIRST_NAMES, W.HR_LAST_NAMES, s, "email", ".")
        return {
            "employee_id": _numbered("EMP", 4),
            "name": _pair(W.HR_FIRST_NAMES, W.HR_LAST_NAMES, s, "name", " "),
            "department": _one_of(W.DEPARTMENTS, s, "department"),
            "salary": f"{_range(40000, 150000, s, 'salary')}::varchar",
            "hire_date": _day(s, "hire_date"),
            "city": _one_of(W.CITIES, s, "city"),
            "email": f"lower({mail}) || '@company.com'",
        }
    if domain == "healthcare":
        return {
            "patient_id": _numbered("PT", 5),
            "name": _pair(W.PATIENT_FIRST_NAMES, W.PATIENT_LAST_NAMES, s, "name", " "),
            "condition": _one_of(W.CONDITIONS, s, "condition"),
            "appointment_date": _day(s, "appointment_date"),
            "doctor": _one_of(W.DOCTORS, s, "doctor"),
            "insurance_id": f"'INS-' || {_range(100000, 999999, s, 'insurance_id')}::varchar",
            "status": _one_of(W.VISIT_STATUSES, s, "status"),
        }
    if domain == "finance":
        return {
            "transaction_id": _numbered("TXN", 6),
            "date": _day(s, "date"),
            "merchant": _one_of(W.MERCHANTS, s, "merchant"),
            "category": _one_of(W.SPENDING_CATEGORIES, s, "category"),
            "amount": f"({_range(500, 50000, s, 'amount')}::decimal(18,2) / 100)::decimal(18,2)::varchar",
            "payment_method": _one_of(W.PAYMENT_METHODS, s, "payment_method"),
            "status": _one_of(W.PAYMENT_STATUSES, s, "status"),
        }
    if domain == "logistics":
        return {
            "tracking_id": _numbered("TRK", 7),
            "origin": _one_of(W.ORIGINS, s, "origin"),
            "destination": _one_of(W.DESTINATIONS, s, "destination"),
            "carrier": _one_of(W.CARRIERS, s, "carrier"),
            "weight_kg": f"({_range(5, 5000, s, 'weight_kg')}::decimal(18,1) / 10)::decimal(18,1)::varchar",
            "ship_date": _day(s, "ship_date"),
            "status": _one_of(W.SHIPPING_STATUSES, s, "status"),
        }
    return {
        "student_id": _numbered("STU", 4),
        "name": _pair(W.STUDENT_FIRST_NAMES, W.STUDENT_LAST_NAMES, s, "name", " "),
        "subject": _one_of(W.SUBJECTS, s, "subject"),
        "grade": _one_of(W.GRADES, s, "grade"),
        "semester_date": _day(s, "semester_date"),
        "credits": _one_of(W.CREDITS, s, "credits"),
        "status": _one_of(W.STUDENT_STATUSES, s, "status"),
    }


_CASE, _DATE, _PRICE, _MAIL = M.dirty_case_sql, M.dirty_date_sql, M.dirty_price_sql, M.dirty_email_sql
_DIRT = {
    "hr": (
        {"name": _CASE, "department": _CASE, "salary": _PRICE, "hire_date": _DATE, "email": _MAIL},
        ["salary", "email", "city"],
    ),
    "healthcare": (
        {"name": _CASE, "condition": _CASE, "appointment_date": _DATE, "doctor": _CASE, "status": _CASE},
        ["insurance_id", "status"],
    ),
    "finance": (
        {"merchant": _CASE, "category": _CASE, "amount": _PRICE, "date": _DATE, "payment_method": _CASE,
         "status": _CASE},
        ["payment_method", "status"],
    ),
    "logistics": (
        {"origin": _CASE, "destination": _CASE, "carrier": _CASE, "ship_date": _DATE, "status": _CASE},
        ["weight_kg", "status"],
    ),
    "education": (
        {"name": _CASE, "subject": _CASE, "semester_date": _DATE, "status": _CASE},
        ["credits", "status"],
    ),
}

# Whose keys number the rows of each domain.
KEYS = {
    "hr": ("customer", "c_custkey"),
    "healthcare": ("documents", "doc_id"),
    "finance": ("orders", "o_orderkey"),
    "logistics": ("events", "event_id"),
    "education": ("part", "p_partkey"),
}


def clean_sql(domain: str, seed: int, source: tuple[str, str] | None = None) -> str:
    name, key = source or KEYS[domain]
    made = ", ".join(f'{x} as "{c}"' for c, x in _domain_columns(domain, seed).items())
    return f"select k as _row, {made} from (select {key} as k from {name})"


def messy_sql(domain: str, seed: int, source: tuple[str, str] | None = None) -> str:
    dirt, blanks = _DIRT[domain]

    def cell(c: str) -> str:
        x = dirt[c](f'"{c}"', "_row", seed, f"dirt {c}") if c in dirt else f'"{c}"'
        return M.blank_sql(x, "_row", seed, c) if c in blanks else x

    spoilt = ", ".join(f'{cell(c)} as "{c}"' for c in _domain_columns(domain, seed))
    clean = clean_sql(domain, seed, source)
    return f"""with c as ({clean}) select *, 0 as _copy from c where {M.happens_sql(D.COPY_RATE, "_row", seed, "copy")}
        union all select _row, {spoilt}, 1 from c"""


def _keys(spark: SparkSession, sf_dir: str, domain: str) -> DataFrame:
    name, key = KEYS[domain]
    return table(spark, sf_dir, name).select(F.col(key).alias(ROW))


def _register(domain: str, place: int) -> None:
    seed = domain_seed(place)

    @query(clean_sql(domain, seed), name=f"synth_{domain}_clean")
    def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
        return clean_rows(_keys(spark, sf_dir, domain), domain, seed)

    @query(messy_sql(domain, seed), name=f"synth_{domain}_messy")
    def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
        return messy_rows(clean_rows(_keys(spark, sf_dir, domain), domain, seed), domain, seed)


for _place, _domain in enumerate(KEYS):
    _register(_domain, _place)


_CELL_END = "\x1f"


def _pairs_sql() -> str:
    """All cells of all pairs, a row per customer; messy has the copies too."""
    parts = []
    for place, domain in enumerate(KEYS):
        seed, source = domain_seed(place), ("customer", "c_custkey")
        cells = ", ".join(f"coalesce(\"{c}\"::varchar, '')" for c in _domain_columns(domain, seed))
        for side, rows in (("clean", clean_sql(domain, seed, source)), ("messy", messy_sql(domain, seed, source))):
            parts.append(f"select '{domain}' as domain, '{side}' as side, concat_ws(chr(31), {cells}) as cells from ({rows})")
    return " union all ".join(parts)


@query(_pairs_sql())
def pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all five pairs with a row per customer, and read every cell back."""
    folder = scratch_path(spark, "pairs")
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(ROW))
    found = []
    for domain in write_pairs(keys, folder):
        for side in ("clean", "messy"):
            rows = read_table(spark, f"{folder}/{domain}_{side}.csv")
            cells = F.concat_ws(_CELL_END, *[F.coalesce(c, F.lit("")) for c in rows.columns])
            found.append(rows.select(F.lit(domain).alias("domain"), F.lit(side).alias("side"), cells.alias("cells")))
    return reduce(DataFrame.unionByName, found)


__all__ = ["COPY", "KEYS", "clean_sql", "messy_sql"]
