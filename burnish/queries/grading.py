"""Grading queries: spoilt tables against the clean ones they were made from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions.chance import pick
from burnish.functions.text import normalized
from burnish.operators.grade import Sheets, grade, grade_cells, grade_rows, grade_sheets
from burnish.plans.spec import clean_table
from burnish.plans.synth import COPY, ROW, clean_rows, domain_seed, messy_rows
from burnish.plans.tasks import grade_suite, with_levels
from burnish.queries import messy as M
from burnish.queries.clean import orders_spec
from burnish.queries.dirt import KEYS, _domain_columns, _keys, clean_sql, messy_sql
from burnish.queries.registry import query
from burnish.session import scratch_path, settle
from burnish.sources.catalog import TASKS
from burnish.sources.tables import write_table

ORDER_COLUMNS = ["order_id", "customer_id", "order_date", "amount", "priority", "status"]
CUSTOMER_COLUMNS = ["customer_id", "name", "segment", "balance", "email"]


def _norm_sql(c: str) -> str:
    return f"lower({M.strip_sql(f'coalesce({c}, chr(32))')})"


def _bounded_sql(x: str) -> str:
    return f"least(0.99::double, greatest(0.01::double, {x}))"


def _rows_sql(given: str, truth: str, given_columns: Sequence[str], truth_columns: Sequence[str]) -> str:
    """n_matched, n_expected, n_submitted; columns pair up in sorted header order."""
    if len(given_columns) != len(truth_columns):
        matched = "0::bigint"
    else:
        s = ", ".join(_norm_sql(f'"{c}"') for c in sorted(given_columns))
        e = ", ".join(_norm_sql(f'"{c}"') for c in sorted(truth_columns))
        matched = f"(select count(*) from (select distinct {e} from ({truth}) intersect select distinct {s} from ({given})))"
    return f"""select {matched} as n_matched, (select count(*) from ({truth})) as n_expected,
        (select count(*) from ({given})) as n_submitted"""


def _cells_sql(
    given: str, truth: str, given_columns: Sequence[str], truth_columns: Sequence[str], order: str = ""
) -> str:
    """n_correct, n_cells; the last truth row per key counts."""
    key, own = truth_columns[0], given_columns[0]
    last = f"row_number() over (partition by {_norm_sql(f'\"{key}\"')}{f' order by {order} desc' if order else ''})"
    e = ", ".join(f'{_norm_sql(f'"{c}"')} as e{i}' for i, c in enumerate(truth_columns))
    s = ", ".join(
        f"""{_norm_sql(f'"{c}"') if c in given_columns else "''"} as s{i}""" for i, c in enumerate(truth_columns)
    )
    right = " + ".join(f"(e{i} = s{i})::int" for i in range(len(truth_columns)))
    return f"""select coalesce(sum({right}), 0)::bigint as n_correct, count(*) * {len(truth_columns)} as n_cells
        from (select {e}, {last} as n from ({truth})) as e
        join (select {_norm_sql(f'"{own}"')} as own, {s} from ({given})) as s on s.own = e.e0 and e.n = 1"""


def _grade_sql(
    given: str, truth: str, given_columns: Sequence[str], truth_columns: Sequence[str], order: str = ""
) -> str:
    found = {c.strip().lower() for c in truth_columns} & {c.strip().lower() for c in given_columns}
    column = max(0.01, min(0.99, len(found) / len(truth_columns)))
    return f"""select round(r, 6) as row_score, round({column}::double, 6) as column_score, round(c, 6) as cell_score,
            round({_bounded_sql(f"0.2::double * r + 0.2::double * {column}::double + 0.6::double * c")}, 6) as reward
        from (select {_bounded_sql("n_matched / n_expected")} as r,
            {_bounded_sql("case when n_cells > 0 then n_correct / n_cells else 0 end")} as c
            from ({_rows_sql(given, truth, given_columns, truth_columns)}),
                 ({_cells_sql(given, truth, given_columns, truth_columns, order)}))"""


def _rounded(scores: DataFrame) -> DataFrame:
    kinds = {"row_score", "column_score", "cell_score", "reward"}
    return scores.select(*[F.round(c, 6).alias(c) if c in kinds else F.col(c) for c in scores.columns])


_CLEAN = f"select {', '.join(ORDER_COLUMNS)} from ({M.ORDERS_CLEAN})"
_MESSY = f"select {', '.join(ORDER_COLUMNS)} from ({M.ORDERS_WITH_COPIES})"


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    given = M.orders_with_copies(spark, sf_dir).select(*ORDER_COLUMNS)
    return given, M.orders_clean(spark, sf_dir).select(*ORDER_COLUMNS)


@query(
    f"select {_norm_sql('priority')} as priority, {_norm_sql('order_date')} as order_date, count(*) as n "
    f"from ({_MESSY}) group by 1, 2"
)
def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, _ = _orders(spark, sf_dir)
    cells = given.select(*[normalized(c).alias(c) for c in ("priority", "order_date")])
    return cells.groupBy("priority", "order_date").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"select *, round({_bounded_sql('n_matched / n_expected')}, 6) as row_score "
    f"from ({_rows_sql(_MESSY, _CLEAN, ORDER_COLUMNS, ORDER_COLUMNS)})",
    name="grade_rows",
)
def rows_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grade_rows(*_orders(spark, sf_dir)))


@query(
    f"select *, round({_bounded_sql('n_correct / n_cells')}, 6) as cell_score "
    f"from ({_cells_sql(_MESSY, _CLEAN, ORDER_COLUMNS, ORDER_COLUMNS)})",
    name="grade_cells",
)
def cells_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grade_cells(*_orders(spark, sf_dir)))


_LINES = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
_NUMBERS = _LINES[-4:]


def _lines_sql(shift: str) -> str:
    flag = f"case when {M.pick_sql(3, 'l_partkey', M.SEED, 'flag')} = 0 then {shift} else l_returnflag end"
    return f"""select l_orderkey::varchar as l_orderkey, l_partkey::varchar as l_partkey, l_suppkey::varchar as l_suppkey,
        l_linenumber::varchar as l_linenumber, {flag} as l_returnflag, l_linestatus,
        l_shipdate::date::varchar as l_shipdate, {", ".join(f"{c}::varchar as {c}" for c in _NUMBERS)} from lineitem"""


def _lines(spark: SparkSession, sf_dir: str, spoilt: bool) -> DataFrame:
    hit = pick(3, "l_partkey", M.SEED, "flag") == 0
    flag = F.when(hit, F.lower("l_returnflag") if spoilt else F.lit("X")).otherwise(F.col("l_returnflag"))
    lines = M.table(spark, sf_dir, "lineitem").withColumn("_flag", flag)
    texts = [F.col(c).cast("string").alias(c) for c in _LINES[:4]]
    return lines.select(
        *texts,
        F.col("_flag").alias("l_returnflag"),
        "l_linestatus",
        F.col("l_shipdate").cast("date").cast("string").alias("l_shipdate"),
        *[F.col(c).cast("string").alias(c) for c in _NUMBERS],
    )


@query(
    _grade_sql(
        _lines_sql("lower(l_returnflag)"),
        _lines_sql("'X'"),
        _LINES,
        _LINES,
        ", ".join(f'{_norm_sql(c)} desc' for c in _LINES).removesuffix(" desc"),
    )
)
def grade_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys repeat on both sides; the greatest expected row of a key stands for it."""
    return _rounded(grade(_lines(spark, sf_dir, True), _lines(spark, sf_dir, False)))


_BY_NUMBER = ["l_linenumber", *[c for c in _LINES if c != "l_linenumber"]]


@query(
    _grade_sql(
        _lines_sql("lower(l_returnflag)"),
        _lines_sql("'X'"),
        _BY_NUMBER,
        _BY_NUMBER,
        ", ".join(f'{_norm_sql(c)} desc' for c in _BY_NUMBER).removesuffix(" desc"),
    )
)
def grade_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven keys hold all rows: none is taken by one task."""
    return _rounded(grade(*(_lines(spark, sf_dir, spoilt).select(*_BY_NUMBER) for spoilt in (True, False))))


@query(_grade_sql(_MESSY, _CLEAN, ORDER_COLUMNS, ORDER_COLUMNS))
def grade_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grade(*_orders(spark, sf_dir)))


_RENAMED = ["order_id", "customer_id", "order_dated", "amount", "Priority", "status"]


@query(_grade_sql(
    "select order_id, customer_id, order_date as order_dated, amount, priority as \"Priority\", status "
    f"from ({M.ORDERS_CLEAN})",
    _CLEAN, _RENAMED, ORDER_COLUMNS))
def grade_renamed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, truth = _orders(spark, sf_dir)
    return _rounded(grade(truth.toDF(*_RENAMED), truth))


_FEWER = ["order_id", "order_date", "AMOUNT", "priority"]


@query(_grade_sql(
    f"select order_id, order_date, amount as \"AMOUNT\", priority from ({_MESSY})", _CLEAN, _FEWER, ORDER_COLUMNS))
def grade_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns too few, one in other casing: it counts as a column, its cells read as empty."""
    given, truth = _orders(spark, sf_dir)
    return _rounded(grade(given.select(*[F.col(c.lower()).alias(c) for c in _FEWER]), truth))


_FIRST = f"""select order_id, coalesce(nullif(customer_id, ''), 'Unknown') as customer_id,
        coalesce({M.date_sql("order_date")}::varchar, {M.strip_sql("order_date")}) as order_date,
        {M.amount_sql("amount")}::decimal(38,2)::varchar as amount, upper({M.strip_sql("priority")}) as priority, status
    from (select *, row_number() over (partition by order_id order by _copy) as n from ({M.ORDERS_WITH_COPIES}))
    where n = 1"""


@query(_grade_sql(_FIRST, _CLEAN, ORDER_COLUMNS, ORDER_COLUMNS))
def grade_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoil, clean, save, grade: the grader reads a table that is stored, not worked out again."""
    _, truth = _orders(spark, sf_dir)
    cleaned = clean_table(M.orders_with_copies(spark, sf_dir), orders_spec(), ["k", "_copy"])
    return _rounded(grade(settle(cleaned.select(*ORDER_COLUMNS), "cleaned"), truth))


def _domains_sql(domains: Sequence[str]) -> str:
    parts = []
    for domain in domains:
        seed = domain_seed(list(KEYS).index(domain))
        columns = list(_domain_columns(domain, seed))
        level = next(t.level for t in TASKS if t.name == domain)
        scores = _grade_sql(f"({messy_sql(domain, seed)})", clean_sql(domain, seed), columns, columns)
        parts.append(f"select '{domain}' as task, '{level}' as level, * from ({scores})")
    return " union all ".join(parts)


@query(_domains_sql(["hr", "finance", "education"]), name="grade_suite")
def suite_of_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three domain tables as frames, graded by one aggregation and one join."""
    given, truth = {}, {}
    for domain in ("hr", "finance", "education"):
        seed = domain_seed(list(KEYS).index(domain))
        clean = clean_rows(_keys(spark, sf_dir, domain), domain, seed)
        given[domain] = messy_rows(clean, domain, seed).drop(ROW, COPY)
        truth[domain] = clean.drop(ROW)
    return _rounded(with_levels(grade_sheets(Sheets.of(given), Sheets.of(truth), list(given)), TASKS))


@query(_domains_sql(["hr", "education"]))
def grade_suite_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as files, found through the catalog, graded from the files."""
    folder = scratch_path(spark, "suite")
    for domain in ("hr", "education"):
        seed = domain_seed(list(KEYS).index(domain))
        clean = clean_rows(_keys(spark, sf_dir, domain), domain, seed)
        write_table(clean, f"{folder}/{domain}_clean.csv", order=ROW)
        write_table(messy_rows(clean, domain, seed), f"{folder}/{domain}_messy.csv", order=[ROW, COPY])
    optional = [t for t in TASKS if not t.always]
    return _rounded(grade_suite(spark, folder, optional))
