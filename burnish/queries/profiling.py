"""Profile queries over spoilt tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.operators import profile as P
from burnish.queries import messy as M
from burnish.queries.clean import PRIORITIES
from burnish.queries.registry import query
from burnish.session import settle

ORDER_COLUMNS = ["order_id", "customer_id", "order_date", "amount", "priority", "status"]


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("column", "check", "n_bad", "n_rows", F.round("ratio", 6).alias("ratio"))


def _counts_sql(source: str, tests: list[tuple[str, str, str]]) -> str:
    """One row per (column, check, SQL test) over ``source``."""
    one = (
        """select '{0}' as "column", '{1}' as "check", n_bad, n_rows, round(n_bad / n_rows, 6) as ratio
        from (select count(*) filter ({2}) as n_bad, count(*) as n_rows from t)"""
    )
    return f"with t as ({source}) " + " union all ".join(one.format(*t) for t in tests)


def _missing(cs: list[str]) -> list[tuple[str, str, str]]:
    return [(c, "missing", M.blank_test_sql(c)) for c in cs]


def _padded(cs: list[str]) -> list[tuple[str, str, str]]:
    return [(c, "padded", f"{c} <> {M.strip_sql(c)}") for c in cs]


def _dates(c: str) -> list[tuple[str, str, str]]:
    s = M.strip_sql(c)
    shapes = {
        "iso": r"\d{4}-\d{1,2}-\d{1,2}",
        "y/m/d": r"\d{4}/\d{1,2}/\d{1,2}",
        "m/d/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
        "m/d/yy": r"\d{1,2}/\d{1,2}/\d{2}",
        "dashed": r"\d{1,2}-\d{1,2}-\d{4}",
    }
    found = [(c, f"date {n}", f"regexp_full_match({s}, ''{r}'')".replace("''", "'")) for n, r in shapes.items()]
    known = " or ".join(t for _, _, t in found)
    a, b = f"split_part({s}, '-', 1)::int", f"split_part({s}, '-', 2)::int"
    dashed = f"regexp_full_match({s}, '{shapes['dashed']}')"
    return found + [
        (c, "date blank", M.blank_test_sql(c)),
        (c, "date other", f"not {M.blank_test_sql(c)} and not ({known})"),
        (
            c,
            "date ambiguous",
            f"case when {dashed} then {a} between 1 and 12 and {b} between 1 and 12 and {a} <> {b} end",
        ),
    ]


def _casing(c: str, right: str) -> list[tuple[str, str, str]]:
    s = M.strip_sql(c)
    letters = f"regexp_matches({s}, '[a-zA-Z]')"
    upper, lower, title = f"{s} = upper({s})", f"{s} = lower({s})", f"{s} = {M.title_sql(c)}"
    return [
        (c, "wrong case", f"{s} <> {right}"),
        (c, "case upper", f"{letters} and {upper}"),
        (c, "case lower", f"{letters} and not {upper} and {lower}"),
        (c, "case title", f"{letters} and not {upper} and not {lower} and {title}"),
        (c, "case mixed", f"{letters} and not {upper} and not {lower} and not {title}"),
    ]


def _amounts(c: str) -> list[tuple[str, str, str]]:
    s = M.strip_sql(c)
    shapes = {
        "plain": r"[+-]?\d[\d,]*(\.\d+)?",
        "dollar": r"[+-]?\$[+-]?\d[\d,]*(\.\d+)?",
        "usd": r"[+-]?\d[\d,]*(\.\d+)?\s*USD",
    }
    known = " or ".join(f"regexp_full_match({s}, '{r}')" for r in shapes.values())
    tests = []
    for pad, same in (("", f"{c} = {s}"), ("padded ", f"{c} <> {s}")):
        tests += [(c, f"amount {pad}{n}", f"{same} and regexp_full_match({s}, '{r}')") for n, r in shapes.items()]
    return tests + [
        (c, "amount blank", M.blank_test_sql(c)),
        (c, "amount other", f"not {M.blank_test_sql(c)} and not ({known})"),
    ]


def _numbers(c: str) -> list[tuple[str, str, str]]:
    number = rf"regexp_full_match({M.strip_sql(c)}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')"
    return [(c, "invalid number", f"not {M.blank_test_sql(c)} and not {number}")]


def _emails(c: str) -> list[tuple[str, str, str]]:
    valid = rf"regexp_full_match(lower({M.strip_sql(c)}), '[\w.\-]+@[\w.\-]+\.\w+')"
    return [(c, "invalid email", f"not {M.blank_test_sql(c)} and not {valid}")]


def _duplicates_sql(source: str, columns: list[str], key: str) -> str:
    row = ", ".join(columns)
    return f"""with t as ({source}) select "column", "check", n_bad, n_rows, round(n_bad / n_rows, 6) as ratio from (
        select '*' as "column", 'duplicate row' as "check", (sum(n) - count(*))::bigint as n_bad,
               sum(n)::bigint as n_rows from (select count(*) as n from t group by {row})
        union all
        select '{key}', 'duplicate key', (select sum(n - 1)::bigint from (select count(*) as n from t
            where not {M.blank_test_sql(key)} group by {key})), (select count(*) from t))"""


@query(_duplicates_sql(f"select customer_id, status, priority from ({M.ORDERS_WITH_COPIES})",
                       ["customer_id", "status", "priority"], "customer_id"))
def profile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.orders_with_copies(spark, sf_dir).select("customer_id", "status", "priority")
    return _rounded(P.duplicate_checks(rows, "customer_id"))


@query(_counts_sql(M.ORDERS_MESSY, _missing(ORDER_COLUMNS)))
def profile_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.count_checks(M.orders_messy(spark, sf_dir), P.missing_checks(ORDER_COLUMNS)))


@query(_counts_sql(M.PARTS_MESSY, _padded(["name", "kind", "price"])))
def profile_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.count_checks(M.parts_messy(spark, sf_dir), P.padding_checks(["name", "kind", "price"])))


@query(_counts_sql(M.ORDERS_MESSY, _dates("order_date")))
def profile_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.count_checks(M.orders_messy(spark, sf_dir), P.date_checks(["order_date"])))


@query(
    _counts_sql(
        M.PARTS_MESSY,
        _casing("name", M.title_sql("name")) + _casing("kind", f"upper({M.strip_sql('kind')})"),
    )
)
def profile_casing(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = P.casing_checks({"name": "title", "kind": "upper"})
    return _rounded(P.count_checks(M.parts_messy(spark, sf_dir), checks))


@query(_counts_sql(M.CUSTOMERS_MESSY, _emails("email") + _numbers("balance")))
def profile_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = P.email_checks(["email"]) + P.number_checks(["balance"])
    return _rounded(P.count_checks(M.customers_messy(spark, sf_dir), checks))


@query(_counts_sql(M.PARTS_MESSY, _amounts("price")))
def profile_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.count_checks(M.parts_messy(spark, sf_dir), P.amount_checks(["price"])))


def _profile_sql() -> str:
    source = f"select {', '.join(ORDER_COLUMNS)} from ({M.ORDERS_WITH_COPIES})"
    right = f"case when {M.blank_test_sql('priority')} then {M.strip_sql('priority')} else upper({M.strip_sql('priority')}) end"
    tests = _missing(ORDER_COLUMNS) + _padded(ORDER_COLUMNS) + _dates("order_date")
    tests += _casing("priority", right) + _numbers("amount") + _amounts("amount")
    return (
        f"select * from ({_duplicates_sql(source, ORDER_COLUMNS, 'order_id')}) "
        f"union all select * from ({_counts_sql(source, tests)})"
    )


@query(_profile_sql())
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes, so over a stored table."""
    rows = settle(M.orders_with_copies(spark, sf_dir).select(*ORDER_COLUMNS), "orders")
    found = P.profile(
        rows,
        key="order_id",
        dates=["order_date"],
        amounts=["amount"],
        numbers=["amount"],
        casing={"priority": PRIORITIES},
    )
    return _rounded(found)
