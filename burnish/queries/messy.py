"""Text tables made from orders, customers and parts, clean and spoilt, in Spark and in SQL.

The test tables are tidy, so most queries first put dirt on them by the seeded
rules and then work on the whole spoilt table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions import dirt as D
from burnish.functions.chance import SECOND, stream
from burnish.plans.synth import spoil, with_copies
from burnish.queries.registry import table

SEED = 7
COMPANY = "company.com"


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def orders_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        _text("o_orderkey").alias("order_id"),
        _text("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").cast("string").alias("order_date"),
        _money("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


def _date_or_invalid(c: Column, chance: Column) -> Column:
    return F.when(chance % 23 == 0, "invalid").otherwise(D.dirty_date(c, chance))


def _price_or_invalid(c: Column, chance: Column) -> Column:
    n = chance % 25
    signed = F.when(n == 1, F.concat(F.lit("-"), c)).otherwise(c)
    return F.when(n == 0, "  invalid  ").otherwise(D.dirty_price(signed, chance))


def orders_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirt = {"order_date": _date_or_invalid, "amount": _price_or_invalid, "priority": D.dirty_case}
    return spoil(orders_clean(spark, sf_dir), dirt, ["customer_id", "priority"], SEED, key="k")


def orders_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy orders, one in twenty preceded by its clean copy; order (k, _copy)."""
    messy = orders_messy(spark, sf_dir)
    return with_copies(orders_clean(spark, sf_dir), lambda _: messy, SEED, key="k")


def customers_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mailbox = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(".")))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"),
        _text("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        _money("c_acctbal").alias("balance"),
        F.concat(mailbox, F.lit(f"@{COMPANY}")).alias("email"),
    )


def customers_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirt = {"name": D.dirty_case, "segment": D.dirty_case, "balance": D.dirty_price, "email": D.dirty_email}
    return spoil(customers_clean(spark, sf_dir), dirt, ["email", "balance", "segment"], SEED, key="k")


def _pad_or_glue(c: Column, chance: Column) -> Column:
    """Padding ``trim`` would miss, and words whose casing ``initcap`` would miss."""
    n = chance % 6
    return (
        F.when(n == 0, F.concat(F.lit("\t"), c, F.lit("\xa0")))
        .when(n == 1, F.concat(F.lit("  "), F.upper(c), F.lit(" 10FT\t ")))
        .when(n == 2, F.concat(F.replace(c, F.lit(" "), F.lit("-")), F.lit(" (5ft)")))
        .when(n == 3, F.concat(F.upper(c), F.lit(' 27"')))
        .when(n == 4, F.concat(F.lit(" "), c, F.lit("'s, x")))
        .otherwise(c)
    )


def parts_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"),
        _text("p_partkey").alias("part_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
        _text("p_size").alias("size"),
        _money("p_retailprice").alias("price"),
    )
    dirt = {"name": _pad_or_glue, "kind": D.dirty_case, "price": _price_or_invalid}
    return spoil(clean, dirt, ["size", "kind"], SEED, key="k")


# --- the same in SQL ---------------------------------------------------------


def draw_sql(key: str, seed: int, name: str) -> str:
    a, b, c = stream(seed, name)
    x = f"(({key} % 2147483647) * {a}::bigint + ({key} >> 31) * 69621::bigint + {c}) % 2147483647"
    return f"((({x}) * {b}::bigint + {c}) % 2147483629)"


def pick_sql(n: int, key: str, seed: int, name: str) -> str:
    return f"({draw_sql(key, seed, name)} % {n})"


def happens_sql(rate: float, key: str, seed: int, name: str) -> str:
    return f"({draw_sql(key, seed, name)} < {int(rate * SECOND)})"


def blank_sql(c: str, key: str, seed: int, name: str, rate: float = D.BLANK_RATE) -> str:
    return f"case when {happens_sql(rate, key, seed, f'blank {name}')} then '' else {c} end"


def dirty_case_sql(c: str, key: str, seed: int, name: str) -> str:
    n = pick_sql(4, key, seed, name)
    return f"case {n} when 0 then upper({c}) when 1 then lower({c}) when 2 then '  ' || {c} || '  ' else {c} end"


def dirty_date_sql(c: str, key: str, seed: int, name: str) -> str:
    n = pick_sql(5, key, seed, name)
    day = f"({c})::date"
    return (
        f"case {n} when 0 then strftime({day}, '%m/%d/%Y') when 1 then strftime({day}, '%m-%d-%Y') "
        f"when 4 then strftime({day}, '%d-%m-%Y') else strftime({day}, '%-m/%-d/%y') end"
    )


def dirty_email_sql(c: str, key: str, seed: int, name: str) -> str:
    n = pick_sql(5, key, seed, name)
    return (
        f"case {n} when 0 then upper({c}) when 1 then replace({c}, '@', '') "
        f"when 2 then split_part({c}, '@', 1) || '@example' when 3 then '  ' || {c} || '  ' else {c} end"
    )


def dirty_price_sql(c: str, key: str, seed: int, name: str) -> str:
    n = pick_sql(4, key, seed, name)
    return f"case {n} when 0 then '$' || {c} when 1 then {c} || ' USD' when 2 then '  $' || {c} || '  ' else {c} end"


def price_or_invalid_sql(c: str, key: str, seed: int, name: str) -> str:
    n = pick_sql(25, key, seed, name)
    plain, negative = dirty_price_sql(c, key, seed, name), dirty_price_sql(f"('-' || {c})", key, seed, name)
    return f"case {n} when 0 then '  invalid  ' when 1 then {negative} else {plain} end"


def date_or_invalid_sql(c: str, key: str, seed: int, name: str) -> str:
    lost = pick_sql(23, key, seed, name)
    return f"case when {lost} = 0 then 'invalid' else {dirty_date_sql(c, key, seed, name)} end"


ORDERS_CLEAN = """
    select o_orderkey as k, o_orderkey::varchar as order_id, o_custkey::varchar as customer_id,
           o_orderdate::date::varchar as order_date, o_totalprice::decimal(18,2)::varchar as amount,
           o_orderpriority as priority, o_orderstatus as status
    from orders"""

ORDERS_MESSY = f"""
    select k, order_id, {blank_sql("customer_id", "k", SEED, "customer_id")} as customer_id,
           {date_or_invalid_sql("order_date", "k", SEED, "dirt order_date")} as order_date,
           {price_or_invalid_sql("amount", "k", SEED, "dirt amount")} as amount,
           {blank_sql(dirty_case_sql("priority", "k", SEED, "dirt priority"), "k", SEED, "priority")} as priority,
           status
    from ({ORDERS_CLEAN})"""

ORDERS_WITH_COPIES = f"""
    select *, 0 as _copy from ({ORDERS_CLEAN}) where {happens_sql(D.COPY_RATE, "k", SEED, "copy")}
    union all select *, 1 from ({ORDERS_MESSY})"""

CUSTOMERS_CLEAN = f"""
    select c_custkey as k, c_custkey::varchar as customer_id, c_name as name, c_mktsegment as segment,
           c_acctbal::decimal(18,2)::varchar as balance,
           lower(replace(c_name, '#', '.')) || '@{COMPANY}' as email
    from customer"""

CUSTOMERS_MESSY = f"""
    select k, customer_id, {dirty_case_sql("name", "k", SEED, "dirt name")} as name,
           {blank_sql(dirty_case_sql("segment", "k", SEED, "dirt segment"), "k", SEED, "segment")} as segment,
           {blank_sql(dirty_price_sql("balance", "k", SEED, "dirt balance"), "k", SEED, "balance")} as balance,
           {blank_sql(dirty_email_sql("email", "k", SEED, "dirt email"), "k", SEED, "email")} as email
    from ({CUSTOMERS_CLEAN})"""

PARTS_MESSY = f"""
    select k, part_id,
           case {pick_sql(6, "k", SEED, "dirt name")}
               when 0 then chr(9) || name || chr(160) when 1 then '  ' || upper(name) || ' 10FT' || chr(9) || ' '
               when 2 then replace(name, ' ', '-') || ' (5ft)' when 3 then upper(name) || ' 27"'
               when 4 then ' ' || name || '''s, x' else name end as name,
           brand, {blank_sql(dirty_case_sql("kind", "k", SEED, "dirt kind"), "k", SEED, "kind")} as kind,
           {blank_sql("size", "k", SEED, "size")} as size,
           {price_or_invalid_sql("price", "k", SEED, "dirt price")} as price
    from (select p_partkey as k, p_partkey::varchar as part_id, p_name as name, p_brand as brand, p_type as kind,
                 p_size::varchar as size, p_retailprice::decimal(18,2)::varchar as price from part)"""


def strip_sql(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def title_sql(c: str) -> str:
    runs = f"regexp_extract_all(lower({strip_sql(c)}), '([a-z]+|[^a-z]+)')"
    return f"array_to_string(list_transform({runs}, lambda w: upper(w[1:1]) || w[2:]), '')"


def date_sql(c: str, day_first: bool = True) -> str:
    """Date, or null; try_strptime alone would read 1/18/24 as the year 24."""
    s = strip_sql(c)
    dmy, mdy = f"try_strptime({s}, '%d-%m-%Y')", f"try_strptime({s}, '%m-%d-%Y')"
    dashed = f"coalesce({dmy}, {mdy})" if day_first else f"coalesce({mdy}, {dmy})"
    return rf"""(case
        when regexp_full_match({s}, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') then try_strptime({s}, '%Y-%m-%d')
        when regexp_full_match({s}, '\d{{1,2}}/\d{{1,2}}/\d{{4}}')
            then coalesce(try_strptime({s}, '%m/%d/%Y'), try_strptime({s}, '%d/%m/%Y'))
        when regexp_full_match({s}, '\d{{1,2}}/\d{{1,2}}/\d{{2}}') then try_strptime({s}, '%m/%d/%y')
        when regexp_full_match({s}, '\d{{1,2}}-\d{{1,2}}-\d{{4}}') then {dashed} end)::date"""


def amount_sql(c: str) -> str:
    s = strip_sql(f"replace(replace(replace({c}, '$', ''), ',', ''), 'USD', '')")
    number = rf"case when regexp_full_match({s}, '[+-]?(\d+\.?\d*|\.\d+)') then try_cast({s} as double) end"
    return f"greatest(0.0, coalesce({number}, 0.0))"


def blank_test_sql(c: str) -> str:
    return f"coalesce({strip_sql(c)}, '') = ''"
