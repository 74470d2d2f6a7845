"""Cleaning queries."""

from __future__ import annotations

from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions.chance import pick
from burnish.functions.dates import DAY_FIRST, MONTH_FIRST, normalize_date
from burnish.functions.emails import email_domain, fix_email, valid_email
from burnish.functions.missing import blank_to_null, fill_number, fill_text
from burnish.functions.numbers import clamp_negative, clean_amount, coerce_number, fixed_scale
from burnish.functions.text import in_vocabulary, lower_strip, strip, title_case
from burnish.operators.dateorder import date_order_votes, normalize_dates_voted
from burnish.operators.dedup import drop_exact_duplicates, drop_key_duplicates
from burnish.operators.fills import drop_missing as drop_missing_rows
from burnish.operators.fills import fill_median as fill_with_median
from burnish.operators.fills import fill_medians, fill_undated
from burnish.operators.ids import continue_ids, positional_ids
from burnish.operators.usercode import apply_code, apply_grouped, apply_pandas, apply_table_code
from burnish.operators.vocabulary import canonicalize as canonicalize_column
from burnish.operators.vocabulary import canonicalize_typos, most_common_domain, repair_domains
from burnish.plans.spec import CleaningSpec, Ids, Undated, amount, clean_table, dates, words
from burnish.queries import messy as M
from burnish.queries.registry import query, table
from burnish.session import settle

if TYPE_CHECKING:
    import pyspark.pandas as ps

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _listed(values: list[str]) -> str:
    return "(values " + ", ".join(f"('{v}')" for v in values) + ")"


# --- duplicates ---------------------------------------------------------------


@query("select min(doc_id) as doc_id, text from documents group by text")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_exact_duplicates(docs, order="doc_id")


_LINE_KEY = ["l_orderkey", "l_linenumber"]
_LINE_REST = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


@query(
    f"""select {", ".join(_LINE_KEY + _LINE_REST)} from (select *, row_number() over (
        partition by {", ".join(_LINE_KEY)} order by {", ".join(_LINE_REST)}) as n from lineitem)
    where n = 1"""
)
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line per key, in the order of all other columns."""
    lines = table(spark, sf_dir, "lineitem").select(*_LINE_KEY, *_LINE_REST)
    return drop_key_duplicates(lines, _LINE_KEY, _LINE_REST)


@query(
    f"""select order_id, order_date, amount, priority from (
        select *, row_number() over (partition by order_id order by _copy) as n from ({M.ORDERS_WITH_COPIES}))
    where n = 1"""
)
def dedup_keep_clean_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_key_duplicates(M.orders_with_copies(spark, sf_dir), "order_id", "_copy")
    return kept.select("order_id", "order_date", "amount", "priority")


# --- missing values -----------------------------------------------------------


@query(
    f"""select k, coalesce(nullif(customer_id, ''), 'Unknown') as customer_id,
        coalesce(nullif(priority, ''), 'Unknown') as priority from ({M.ORDERS_MESSY})"""
)
def fill_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.orders_messy(spark, sf_dir)
    return rows.select("k", *[fill_text(c).alias(c) for c in ("customer_id", "priority")])


_GAPS = f"""select k, case when {M.pick_sql(10, "k", M.SEED, "gap")} = 0 then null else c_acctbal end as balance
    from (select c_custkey as k, c_acctbal from customer)"""


def _balances_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    gap = pick(10, "k", M.SEED, "gap") == 0
    return rows.select("k", F.when(~gap, F.col("c_acctbal")).alias("balance"))


@query(f"select k, coalesce(balance, 0) as balance from ({_GAPS})")
def fill_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balances_with_gaps(spark, sf_dir).select("k", fill_number("balance", 0.0).alias("balance"))


@query(f"with g as ({_GAPS}) select k, round(coalesce(balance, (select median(balance) from g)), 6) as balance from g")
def fill_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = fill_with_median(_balances_with_gaps(spark, sf_dir), "balance")
    return filled.select("k", F.round("balance", 6).alias("balance"))


@query(
    """select l_orderkey, l_linenumber, coalesce(price, (select median(l_extendedprice) from lineitem where l_linenumber <> 3)) as price
    from (select *, case when l_linenumber <> 3 then l_extendedprice end as price from lineitem)"""
)
def fill_median_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    gaps = lines.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("price"))
    return fill_with_median(gaps, "price")


_WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]


def _gap_sql(c: str) -> str:
    return f"case when {M.pick_sql(7, 'l_partkey', M.SEED, f'gap {c}')} = 0 then null else {c} end::double"


@query(
    f"""with g as (select l_orderkey, l_linenumber, {", ".join(f"{_gap_sql(c)} as {c}" for c in _WIDE)} from lineitem),
        m as (select {", ".join(f"median({c}) as {c}" for c in _WIDE)} from g)
    select l_orderkey, l_linenumber, {", ".join(f"round(coalesce(g.{c}, m.{c}), 6) as {c}" for c in _WIDE)} from g, m"""
)
def fill_medians_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five columns with gaps of their own, all medians found together."""
    lines = table(spark, sf_dir, "lineitem")
    gaps = {c: F.when(pick(7, "l_partkey", M.SEED, f"gap {c}") != 0, F.col(c).cast("double")).alias(c) for c in _WIDE}
    filled = fill_medians(lines.select("l_orderkey", "l_linenumber", *gaps.values()), _WIDE)
    return filled.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in _WIDE])


@query(
    f"""select order_id, customer_id, priority from ({M.ORDERS_MESSY})
    where not {M.blank_test_sql("customer_id")} and not {M.blank_test_sql("priority")}"""
)
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_missing_rows(M.orders_messy(spark, sf_dir), ["customer_id", "priority"])
    return kept.select("order_id", "customer_id", "priority")


# --- text ---------------------------------------------------------------------


@query(f"select k, {M.strip_sql('name')} as name, {M.strip_sql('price')} as price from ({M.PARTS_MESSY})")
def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.parts_messy(spark, sf_dir).select("k", strip("name").alias("name"), strip("price").alias("price"))


@query(f"select k, {M.title_sql('name')} as name from ({M.PARTS_MESSY})", name="title_case")
def title_case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.parts_messy(spark, sf_dir).select("k", title_case("name").alias("name"))


@query(f"select k, lower({M.strip_sql('kind')}) as kind, lower({M.strip_sql('name')}) as name from ({M.PARTS_MESSY})")
def lower_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.parts_messy(spark, sf_dir)
    return rows.select("k", lower_strip("kind").alias("kind"), lower_strip("name").alias("name"))


@query("select doc_id, lower(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) as text from documents")
def lower_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", lower_strip("text").alias("text"))


@query(
    f"""select k, coalesce(w.word, {M.strip_sql("segment")}) as segment from ({M.CUSTOMERS_MESSY})
    left join {_listed(SEGMENTS)} as w(word) on lower(w.word) = lower({M.strip_sql("segment")})"""
)
def canonical_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.customers_messy(spark, sf_dir)
    return rows.select("k", in_vocabulary("segment", SEGMENTS).alias("segment"))


@query(
    f"""select k, kind from (
        select k, coalesce(w.p_type, {M.strip_sql("kind")}) as kind from ({M.PARTS_MESSY})
        left join (select distinct p_type from part) as w on lower(w.p_type) = lower({M.strip_sql("kind")}))"""
)
def canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary from a table column, joined."""
    vocabulary = table(spark, sf_dir, "part").select("p_type")
    return canonicalize_column(M.parts_messy(spark, sf_dir), "kind", vocabulary, "p_type").select("k", "kind")


def _slip_sql(c: str) -> str:
    """One character left out, put in twice or replaced, in one row of two."""
    at = f"(2 + {M.pick_sql(97, 'k', M.SEED, 'slip at')} % (length({c}) - 2))::int"
    return f"""case {M.pick_sql(6, "k", M.SEED, "slip")} when 0 then left({c}, {at} - 1) || substr({c}, {at} + 1)
        when 1 then left({c}, {at}) || substr({c}, {at}) when 2 then left({c}, {at} - 1) || '_' || substr({c}, {at} + 1)
        else {c} end"""


def _slipped(c: str) -> Column:
    n, word = pick(6, "k", M.SEED, "slip"), F.col(c)
    at = (2 + pick(97, "k", M.SEED, "slip at") % (F.length(word) - 2)).cast("int")
    return (
        F.when(n == 0, F.concat(F.left(word, at - 1), F.substr(word, at + 1)))
        .when(n == 1, F.concat(F.left(word, at), F.substr(word, at)))
        .when(n == 2, F.concat(F.left(word, at - 1), F.lit("_"), F.substr(word, at + 1)))
        .otherwise(word)
    )


@query(
    f"""with r as (select k, {_slip_sql("brand")} as brand, {_slip_sql("kind")} as kind
            from (select p_partkey as k, p_brand as brand, p_type as kind from part)),
        w as (select distinct p_brand as spelling, lower(p_brand) as word from part
            union select distinct p_type, lower(p_type) from part),
        v as (select distinct lower(brand) as value from r union select distinct lower(kind) from r),
        met as (select value, spelling, levenshtein(value, word) as edits from v join w on levenshtein(value, word) <= 1),
        fixes as (select value, min(spelling) as spelling from met as m
            where edits = (select min(edits) from met as o where o.value = m.value) group by value having count(*) = 1)
    select r.k, coalesce(b.spelling, r.brand) as brand, coalesce(t.spelling, r.kind) as kind
    from r left join fixes as b on b.value = lower(r.brand) left join fixes as t on t.value = lower(r.kind)""",
    name="canonicalize_typos",
)
def typos_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt brands, many of which could be several, and misspelt types, of one vocabulary."""
    parts = table(spark, sf_dir, "part")
    rows = parts.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))
    rows = settle(rows.select("k", _slipped("brand").alias("brand"), _slipped("kind").alias("kind")), "slipped")
    words = parts.select(F.explode(F.array("p_brand", "p_type")).alias("word"))
    for column in ("brand", "kind"):
        rows = canonicalize_typos(rows, column, words, "word")
    return rows


# --- dates --------------------------------------------------------------------


def _dates_sql(day_first: bool) -> str:
    iso = M.date_sql("order_date", day_first)
    return f"select k, coalesce({iso}::varchar, {M.strip_sql('order_date')}) as order_date from ({M.ORDERS_MESSY})"


@query(_dates_sql(True))
def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.orders_messy(spark, sf_dir)
    return rows.select("k", normalize_date("order_date", DAY_FIRST).alias("order_date"))


@query(_dates_sql(False))
def date_normalize_month_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.orders_messy(spark, sf_dir)
    return rows.select("k", normalize_date("order_date", MONTH_FIRST).alias("order_date"))


_ORDERS_BY_HAND = f"select k, o_custkey as hand, order_date from ({M.ORDERS_MESSY}) join orders on o_orderkey = k"


def _dashed_sql(n: int) -> str:
    text = M.strip_sql("order_date")
    return rf"case when regexp_full_match({text}, '\d{{1,2}}-\d{{1,2}}-\d{{4}}') then split_part({text}, '-', {n})::int end"


_VOTES = f"""select hand, count(*) filter (a between 13 and 31 and b between 1 and 12) as n_day_first,
        count(*) filter (b between 13 and 31 and a between 1 and 12) as n_month_first,
        count(*) filter (a between 1 and 12 and b between 1 and 12 and a <> b) as n_ambiguous,
        case when n_month_first > n_day_first then 'month first' else 'day first' end as date_order
    from (select hand, {_dashed_sql(1)} as a, {_dashed_sql(2)} as b from ({_ORDERS_BY_HAND})) group by hand"""


def _orders_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy dates; who wrote one is the customer of the order."""
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("hand"))
    rows = M.orders_messy(spark, sf_dir)
    return rows.join(owners, F.col("k") == F.col("key")).select("k", "hand", "order_date")


@query(_VOTES, name="date_order_votes")
def votes_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return date_order_votes(_orders_by_hand(spark, sf_dir), "order_date", "hand")


@query(
    f"""select k, r.hand, coalesce(case when date_order = 'month first' then {M.date_sql("order_date", False)}
            else {M.date_sql("order_date", True)} end::varchar, {M.strip_sql("order_date")}) as order_date
    from ({_ORDERS_BY_HAND}) as r join ({_VOTES}) as v on v.hand = r.hand"""
)
def date_order_voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambiguous dates read as the unambiguous ones of the same hand say."""
    return normalize_dates_voted(_orders_by_hand(spark, sf_dir), "order_date", "hand")


def _undated_sql(window: str) -> str:
    return f"""with d as (select k, o_custkey as owner, order_date, {M.date_sql("order_date")} as day
            from ({M.ORDERS_MESSY}) join orders on o_orderkey = k),
        f as (select k, owner, order_date, day, last_value(day ignore nulls) over ({window}
            order by k rows between unbounded preceding and current row) as seen from d)
        select k, owner, coalesce(day::varchar, date_trunc('month', seen)::date::varchar, order_date) as order_date
        from f"""


def _dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key decides the order; the owner is the customer of the order."""
    dirt = {"order_date": M._date_or_invalid}
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("owner"),
        F.col("o_orderdate").cast("date").cast("string").alias("order_date"),
    )
    spoilt = M.spoil(rows, dirt, [], M.SEED, key="k")
    return spoilt.withColumn("order_date", normalize_date("order_date"))


@query(_undated_sql("partition by owner"))
def undated_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_undated(_dated_orders(spark, sf_dir), "order_date", "k", "owner")


@query(_undated_sql(""))
def undated_fill_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_undated(_dated_orders(spark, sf_dir), "order_date", "k")


@query(_undated_sql(""))
def undated_fill_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order that ties, made total by a further column: no row is lost or doubled."""
    rows = _dated_orders(spark, sf_dir).withColumn("tie", F.floor(F.col("k") / 10))
    return fill_undated(rows, "order_date", ["tie", "k"]).drop("tie")


# --- numbers ------------------------------------------------------------------


@query(f"select k, {M.amount_sql('amount')} as amount from ({M.ORDERS_MESSY})")
def amount_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.orders_messy(spark, sf_dir).select("k", clean_amount("amount").alias("amount"))


@query(
    """select 'customer' as kind, c_custkey as k, greatest(0, c_acctbal) as balance from customer
    union all select 'supplier', s_suppkey, greatest(0, s_acctbal) from supplier"""
)
def clamp_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(kind: str, name: str, key: str, balance: str) -> DataFrame:
        rows = table(spark, sf_dir, name)
        return rows.select(F.lit(kind).alias("kind"), F.col(key).alias("k"), clamp_negative(balance).alias("balance"))

    return side("customer", "customer", "c_custkey", "c_acctbal").unionByName(
        side("supplier", "supplier", "s_suppkey", "s_acctbal")
    )


_NUMBER = r"regexp_full_match({0}, '[+-]?(\d+\.?\d*|\.\d+)')"


@query(
    f"""select k, coalesce(case when {_NUMBER.format(M.strip_sql("size"))} then try_cast(size as double) end, 0.0) as size,
        coalesce(case when {_NUMBER.format(M.strip_sql("price"))}
            then try_cast({M.strip_sql("price")} as double) end, 0.0) as price
    from ({M.PARTS_MESSY})"""
)
def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.parts_messy(spark, sf_dir)
    return rows.select("k", coerce_number("size").alias("size"), coerce_number("price").alias("price"))


@query(
    f"""select k, {M.amount_sql("price")}::decimal(38,2)::varchar as price,
        o.total::decimal(38,0)::varchar as total
    from ({M.PARTS_MESSY}) join (select l_partkey, sum(l_quantity) as total from lineitem group by 1) as o
        on o.l_partkey = k"""
)
def fixed_scale_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("total"))
    parts = M.parts_messy(spark, sf_dir).select("k", fixed_scale(clean_amount("price"), 2).alias("price"))
    return parts.join(sold, F.col("k") == F.col("l_partkey")).select(
        "k", "price", fixed_scale("total", 0).alias("total")
    )


# --- e-mails ------------------------------------------------------------------

_MAIL = f"lower({M.strip_sql('email')})"
_VALID = rf"regexp_full_match({_MAIL}, '[\w.\-]+@[\w.\-]+\.\w+')"
_UNDOTTED = f"contains({_MAIL}, '@') and not contains(split_part({_MAIL}, '@', 2), '.')"


@query(f"select k, {_VALID} as valid, case when {_VALID} then split_part({_MAIL}, '@', 2) end as domain "
       f"from ({M.CUSTOMERS_MESSY})")
def email_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.customers_messy(spark, sf_dir)
    return rows.select("k", valid_email("email").alias("valid"), email_domain("email").alias("domain"))


@query(
    f"""select k, case when {M.blank_test_sql("email")} then 'unknown@example.com'
        when {_UNDOTTED} then {_MAIL} || '.com' else {_MAIL} end as email from ({M.CUSTOMERS_MESSY})"""
)
def email_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.customers_messy(spark, sf_dir).select("k", fix_email("email").alias("email"))


_MODAL = f"""select domain from (select split_part({_MAIL}, '@', 2) as domain, count(*) as n
    from ({M.CUSTOMERS_MESSY}) where {_VALID} group by 1) order by n desc, domain limit 1"""


@query(_MODAL)
def email_modal_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_common_domain(M.customers_messy(spark, sf_dir), "email")


@query(
    f"""with d as ({_MODAL}), m as (select k, email, (select domain from d) as domain from ({M.CUSTOMERS_MESSY}))
    select k, case when {_UNDOTTED} then split_part({_MAIL}, '@', 1) || '@' || domain
        when not contains({_MAIL}, '@') and ends_with({_MAIL}, domain) and length({_MAIL}) > length(domain)
            then left({_MAIL}, length({_MAIL}) - length(domain)) || '@' || domain
        else {_MAIL} end as email from m"""
)
def email_domain_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_domains(M.customers_messy(spark, sf_dir), "email").select("k", "email")


# --- ids ----------------------------------------------------------------------

_UNNAMED = f"""select k, case when {M.pick_sql(9, "k", M.SEED, "no id")} = 0 then '' else 'P' || lpad((k + 1)::varchar,
    greatest(3, length((k + 1)::varchar))::int, '0') end as id from (select l_orderkey * 8 + l_linenumber as k
    from lineitem group by 1)"""


def _unnamed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, some without their id."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    gap = pick(9, "k", M.SEED, "no id") == 0
    number = F.format_string("P%03d", F.col("k") + 1)
    return lines.distinct().select("k", F.when(gap, "").otherwise(number).alias("id"))


def _pad_sql(n: str) -> str:
    return f"'P' || lpad(({n})::varchar, greatest(3, length(({n})::varchar))::int, '0')"


@query(
    rf"""with u as ({_UNNAMED}), m as (select max(regexp_extract(id, '(\d+)', 1)::bigint) as top from u where id <> '')
    select k, case when id = '' then {_pad_sql("top + row_number() over (partition by id = '' order by k)")}
        else id end as id from u, m"""
)
def id_continue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continue_ids(_unnamed_lines(spark, sf_dir), "id", "k")


@query(
    f"""with u as ({_UNNAMED}) select k, case when id = '' then {_pad_sql("row_number() over (order by k)")}
        else id end as id from u"""
)
def id_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_ids(_unnamed_lines(spark, sf_dir), "id", "k")


@query(
    f"""with u as ({_UNNAMED}), t as (select k // 100 as tie, id, row_number() over (order by k // 100, id, k) as place from u)
    select tie, case when id = '' then {_pad_sql("place")} else id end as id from t"""
)
def id_by_place_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many rows share their place in the order; each keeps its row, and equal rows share the places among them."""
    rows = _unnamed_lines(spark, sf_dir).select(F.floor(F.col("k") / 100).alias("tie"), "id")
    return positional_ids(rows, "id", ["tie", "id"])


# --- whole tables -------------------------------------------------------------

_FIRST_COPY = f"""select * from (select *, row_number() over (partition by order_id order by _copy) as n
    from ({M.ORDERS_WITH_COPIES})) where n = 1"""


_SPEC_AMOUNT = M.amount_sql("balance")


@query(
    f"""with m as (select k, segment, balance, case when {M.blank_test_sql("balance")} then null else {_SPEC_AMOUNT} end as v,
            email from ({M.CUSTOMERS_MESSY}) where not {M.blank_test_sql("email")}),
        w as (select lower({M.strip_sql("segment")}) as word, min({M.strip_sql("segment")}) as spelling
            from ({M.CUSTOMERS_MESSY}) where not {M.blank_test_sql("segment")} group by 1)
    select m.k, coalesce(w.spelling, {M.strip_sql("m.segment")}) as segment,
        coalesce(v, (select median(round(v, 2)) from m))::decimal(38, 2)::varchar as balance
    from m left join w on w.word = lower({M.strip_sql("m.segment")})"""
)
def clean_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row drops, medians on spoilt text, and a vocabulary table, by spec."""
    rows = M.customers_messy(spark, sf_dir).select("k", "segment", "balance", "email")
    spec = CleaningSpec(
        {"balance": [amount(2)]}, required=["email"], medians=["balance"], vocabularies={"segment": (rows, "segment")}
    )
    return clean_table(rows, spec).drop("email")


def orders_spec() -> CleaningSpec:
    return CleaningSpec(
        {"order_date": [dates()], "amount": [amount(2)], "priority": [words(PRIORITIES)], "customer_id": [fill_text]},
        key="order_id",
    )


@query(
    f"""select order_id, coalesce(nullif(customer_id, ''), 'Unknown') as customer_id,
        coalesce({M.date_sql("order_date")}::varchar, {M.strip_sql("order_date")}) as order_date,
        {M.amount_sql("amount")}::decimal(38,2)::varchar as amount,
        upper({M.strip_sql("priority")}) as priority, status
    from ({_FIRST_COPY})"""
)
def clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean_table(M.orders_with_copies(spark, sf_dir), orders_spec(), ["k", "_copy"])
    return cleaned.drop("k", "_copy")


@query(f"select k, {M.amount_sql('balance')} as balance, lower({M.strip_sql('segment')}) as segment "
       f"from ({M.CUSTOMERS_MESSY})")
def user_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    def code(df: DataFrame) -> DataFrame:
        return df.select("k", clean_amount("balance").alias("balance"), lower_strip("segment").alias("segment"))

    return apply_code(M.customers_messy(spark, sf_dir), code)


@query(f"select k, {M.amount_sql('balance')} as balance, lower({M.strip_sql('segment')}) as segment "
       f"from ({M.CUSTOMERS_MESSY})")
def user_code_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def code(rows: pd.DataFrame) -> pd.DataFrame:
        bare = rows["balance"].str.replace(r"[$,]|USD", "", regex=True).str.strip()
        balance = pd.to_numeric(bare, errors="coerce").fillna(0.0).clip(lower=0.0)
        return rows.assign(balance=balance.astype("float64"), segment=rows["segment"].str.strip().str.lower())

    rows = M.customers_messy(spark, sf_dir).select("k", "balance", "segment")
    return apply_pandas(rows, code, "k long, balance double, segment string")


@query(
    f"""select k, case when balance in ('', 'NA') then null else balance end as balance
    from ({M.CUSTOMERS_MESSY})"""
)
def blank_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.customers_messy(spark, sf_dir)
    return rows.select("k", blank_to_null("balance", ["NA"]).alias("balance"))


@query(f"select distinct c_mktsegment as segment, coalesce(balance, (select min(balance) from ({_GAPS}))) as balance "
       f"from customer join ({_GAPS}) on k = c_custkey")
def user_code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pandas code that looks across all rows."""

    def code(rows: ps.DataFrame) -> ps.DataFrame:
        rows["balance"] = rows["balance"].fillna(rows["balance"].min())
        return rows[["segment", "balance"]].drop_duplicates()

    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return apply_table_code(_balances_with_gaps(spark, sf_dir).join(segments, "k"), code)


@query(
    f"""select l_orderkey, l_linenumber, l_partkey, round(coalesce(price, median(price) over (partition by l_partkey)), 6) as price
    from (select *, case when {M.pick_sql(5, "l_orderkey", M.SEED, "no price")} <> 0 then l_extendedprice end as price from lineitem)"""
)
def user_code_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pandas code that looks across the lines of one part."""

    def code(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(price=rows["price"].fillna(rows["price"].median()).round(6))

    price = F.when(pick(5, "l_orderkey", M.SEED, "no price") != 0, F.col("l_extendedprice")).alias("price")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", price)
    return apply_grouped(lines, code, "l_partkey")


_HEADED = f"""select 2 * k as o, case when k % 5 = 2 then '' else 'C' || (k // 2)::varchar end as id, name as nm, email as mail,
        segment as city, balance, case when k % 7 = 3 then 'invalid' else (date '2024-01-01' + (k % 400)::int)::varchar end as day
    from ({M.CUSTOMERS_MESSY})"""


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under headers that differ in case only or hold a dot, some of them twice."""
    k = F.col("k")
    rows = M.customers_messy(spark, sf_dir).select(
        (2 * k).alias("o"),
        F.when(k % 5 == 2, "").otherwise(F.concat(F.lit("C"), F.floor(k / 2).cast("string"))),
        "name",
        "email",
        "segment",
        "balance",
        F.when(k % 7 == 3, "invalid").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int")).cast("string")),
    )
    copies = rows.where(F.col("o") % 20 == 0).withColumn("o", F.col("o") + 1)
    return rows.unionByName(copies).toDF("_o", "id", "Name", "name", "addr.city", "Addr.City", "ID")


@query(
    rf"""with t as ({_HEADED}), u as (select * from t union all select o + 1, * exclude (o) from t where o % 20 = 0),
        d as (select min(o) as o, * exclude (o) from u group by all),
        kept as (select * from (select *, row_number() over (partition by case when id = '' then o::varchar else id end order by o) as n from d)
            where n = 1 and not {M.blank_test_sql("city")}),
        m as (select *, case when {M.blank_test_sql("balance")} then null else {M.amount_sql("balance")} end as v,
            lower({M.strip_sql("mail")}) as e, row_number() over (order by o) as place,
            last_value(try_cast(day as date) ignore nulls) over (order by o rows between unbounded preceding and current row) as seen
            from kept),
        top as (select split_part(e, '@', 2) as domain from m where regexp_full_match(e, '[\w.\-]+@[\w.\-]+\.\w+')
            group by 1 order by count(*) desc, 1 limit 1)
    select case when id = '' then {_pad_sql("place")} else id end as id, {M.title_sql("nm")} as name,
        case when contains(e, '@') and not contains(split_part(e, '@', 2), '.') then split_part(e, '@', 1) || '@' || domain
            when not contains(e, '@') and ends_with(e, domain) and length(e) > length(domain)
                then left(e, length(e) - length(domain)) || '@' || domain else e end as email,
        upper({M.strip_sql("city")}) as city,
        coalesce(v, (select median(round(v, 2)) from m))::decimal(38, 2)::varchar as balance,
        case when day = 'invalid' and seen is not null then date_trunc('month', seen)::date::varchar else day end as day
    from m, top"""
)
def clean_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of a spec on headers that Spark cannot tell apart."""
    words_of = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("a.word"))
    spec = CleaningSpec(
        {"Name": [title_case], "Addr.City": [amount(2)], "ID": [dates()]},
        exact_duplicates=True,
        key="id",
        required=["addr.city"],
        vocabularies={"addr.city": (words_of, "a.word")},
        domains=["name"],
        medians=["Addr.City"],
        undated=Undated("ID"),
        ids=Ids("id"),
    )
    cleaned = clean_table(_headed(spark, sf_dir), spec, "_o")
    return cleaned.drop("_o").toDF("id", "name", "email", "city", "balance", "day")
