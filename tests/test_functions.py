"""Column rules against Python's own text and number functions."""

import math

import pytest
from pyspark.sql import functions as F

from burnish.functions.dates import (
    DAY_FIRST,
    MONTH_FIRST,
    ambiguous_date,
    date_shape,
    iso_date,
    normalize_date,
    parse_date,
)
from burnish.functions.emails import email_domain, fix_email, restore_domain, valid_email
from burnish.functions.missing import blank_to_null, fill_number, fill_text, is_blank, padded_id
from burnish.functions.numbers import (
    amount_shape,
    clamp_negative,
    clean_amount,
    coerce_number,
    fixed_scale,
    parse_float,
)
from burnish.functions.text import SPACES, case_class, in_vocabulary, lower_strip, normalized, strip, title_case

TEXTS = [
    "", " ", "  JOHN DOE  ", "\tann\xa0", " x ", "\x1cx\x1f", "a b", "a ", "usb-c adapter 10ft", "USB CABLE (5FT)",
    "o'neil's", "élan vital", "\x7fx", "naïve É", "9lives", 'monitor 27"', "\x85", "é", " é\t", "!", "MiXeD case-d",
]


def mapped(spark, values, kind, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", *[c.alias(f"r{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
    return [row[1] if len(columns) == 1 else tuple(row)[1:] for row in rows]


def test_spaces_are_those_of_python():
    assert set(SPACES) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_text_rules_agree_with_python(spark):
    got = mapped(spark, TEXTS + [None], "string", strip("v"), lower_strip("v"), title_case("v"), normalized("v"))
    want = [(t.strip(), t.strip().lower(), t.strip().title(), t.strip().lower()) for t in TEXTS]
    assert got == want + [(None, None, None, "")]


def test_every_space_is_stripped_on_both_sides(spark):
    values = [f"{s}a{s}b{s}{s}" for s in SPACES]
    assert mapped(spark, values, "string", strip("v")) == [v.strip() for v in values]


def test_case_class_and_vocabulary(spark):
    assert mapped(spark, ["IT", "it", "It", "iT", "12", None], "string", case_class("v")) == [
        "upper", "lower", "title", "mixed", None, None,
    ]
    words = ["FedEx", "CMA CGM", "HR"]
    got = mapped(spark, ["  fedex ", "cma cgm", "hr", " odd ", None], "string", in_vocabulary("v", words))
    assert got == ["FedEx", "CMA CGM", "HR", "odd", None]


DATES = {
    # text: (day first, month first)
    "2024-1-5": ("2024-01-05", "2024-01-05"),
    "01/16/2024": ("2024-01-16", "2024-01-16"),
    "13/1/2024": ("2024-01-13", "2024-01-13"),
    "1/18/24": ("2024-01-18", "2024-01-18"),
    "1/18/68": ("2068-01-18", "2068-01-18"),
    "1/18/69": ("1969-01-18", "1969-01-18"),
    "01-20-2024": ("2024-01-20", "2024-01-20"),
    "22-01-2024": ("2024-01-22", "2024-01-22"),
    " 04-05-2024\t": ("2024-05-04", "2024-04-05"),
    "2024/01/21": ("2024-01-21", "2024-01-21"),
    "20240115": ("2024-01-15", "2024-01-15"),
    "2024-01-05T10:30:00": ("2024-01-05", "2024-01-05"),
    "Jan 5, 2024": ("2024-01-05", "2024-01-05"),
    "january 15, 2024": ("2024-01-15", "2024-01-15"),
    "5 Mar 2023": ("2023-03-05", "2023-03-05"),
    "29-02-2024": ("2024-02-29", "2024-02-29"),
}
NO_DATES = ["2024-02-30", "29-02-2023", "31-04-2024", "invalid", "2024", "0000-01-01", "1/2/3/2024", "20-30-2024",
            "2024 foo", "1-1-24x", "", "1920|2024-01-05"]


def test_dates(spark):
    texts = [*DATES, *NO_DATES, None]
    got = mapped(spark, texts, "string", normalize_date("v", DAY_FIRST), normalize_date("v", MONTH_FIRST))
    assert got == [*DATES.values(), *[(t, t) for t in NO_DATES], (None, None)]
    found = mapped(spark, texts, "string", parse_date("v").isNotNull(), iso_date(normalize_date("v")).isNotNull())
    assert found == [(t in DATES, t in DATES) for t in texts]


def test_every_day_survives_every_format(spark):
    """All days of three years, written in each format, against the date itself."""
    days = spark.range(1096).select(F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    for fmt in ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yy", "yyyy/M/d"):
        assert days.where(parse_date(F.date_format("d", fmt)) != F.col("d")).count() == 0
    for fmt, formats in (("dd-MM-yyyy", DAY_FIRST), ("MM-dd-yyyy", MONTH_FIRST)):
        read = parse_date(F.date_format("d", fmt), formats)
        assert days.where(~read.eqNullSafe(F.col("d"))).count() == 0


def test_unknown_format_is_refused():
    with pytest.raises(ValueError):
        parse_date("v", ["yyyy M d"])


def test_date_shapes_and_ambiguity(spark):
    texts = ["2024-1-5", "2024/1/5", "1/5/2024", "1/5/24", "1-5-2024", "5-5-2024", "13-5-2024", " ", None, "x"]
    got = mapped(spark, texts, "string", date_shape("v"), ambiguous_date("v"))
    assert got == [
        ("iso", False), ("y/m/d", False), ("m/d/yyyy", False), ("m/d/yy", False), ("dashed", True),
        ("dashed", False), ("dashed", False), ("blank", False), ("blank", False), ("other", False),
    ]


NUMBERS = ["1", "-2.5", " 3e2 ", ".5", "5.", "12d", "1_000", "_1", "1__0", "inf", "nan", "0x10", "", "abc", "+7", "1,5"]


def python_float(text):
    try:
        return float(text)
    except ValueError:
        return None


def test_numbers_agree_with_python(spark):
    got = mapped(spark, NUMBERS, "string", parse_float("v"))
    for text, value in zip(NUMBERS, got):
        want = python_float(text)
        assert value == want or (want is not None and math.isnan(want) and math.isnan(value)), text


def test_amounts(spark):
    texts = ["  $250.00  ", "  invalid  ", "200", "12.50 USD", "$1,250.5", "-5", "nan", "inf", None, "", "1_000"]
    got = mapped(spark, texts, "string", clean_amount("v"), fixed_scale(clean_amount("v"), 2))
    assert [a for a, _ in got] == [250.0, 0.0, 200.0, 12.5, 1250.5, 0.0, 0.0, math.inf, 0.0, 0.0, 1000.0]
    assert [t for _, t in got][:7] == ["250.00", "0.00", "200.00", "12.50", "1250.50", "0.00", "0.00"]


def test_clamp_and_coerce(spark):
    values = [-5.0, 3.0, None, float("nan"), 0.0]
    assert mapped(spark, values, "double", clamp_negative("v")) == [0.0, 3.0, 0.0, 0.0, 0.0]
    assert mapped(spark, [-5, 3, None], "int", clamp_negative("v")) == [0, 3, 0]
    assert mapped(spark, ["7", "-2", "x", None, "12d", "1_0"], "string", coerce_number("v")) == [7, -2, 0, 0, 0, 0]
    assert mapped(spark, values, "double", fill_number("v", 9.0)) == [-5.0, 3.0, 9.0, 9.0, 0.0]


def test_amount_shapes(spark):
    texts = ["5.0", " 5.0 ", "$5", "  $5 ", "5 USD", " 5 USD", "", None, "five"]
    assert mapped(spark, texts, "string", amount_shape("v")) == [
        "plain", "padded plain", "dollar", "padded dollar", "usd", "padded usd", "blank", "blank", "other",
    ]


def test_emails(spark):
    texts = ["bob@example", " ANN@X.COM ", "ivy.whitecompany.com", None, "", "a@b@c", "x@y.z", "a b@c.d"]
    got = mapped(spark, texts, "string", fix_email("v"), valid_email("v"), email_domain("v"))
    assert got == [
        ("bob@example.com", False, None),
        ("ann@x.com", True, "x.com"),
        ("ivy.whitecompany.com", False, None),
        ("unknown@example.com", False, None),
        ("unknown@example.com", False, None),
        ("a@b@c.com", False, None),
        ("x@y.z", True, "y.z"),
        ("a b@c.d", False, None),
    ]
    domain = F.lit("company.com")
    assert mapped(spark, texts[:4] + ["company.com"], "string", restore_domain("v", domain)) == [
        "bob@company.com", "ann@x.com", "ivy.white@company.com", None, "company.com",
    ]


def test_missing(spark):
    texts = ["", "  ", None, "NA", "x"]
    got = mapped(spark, texts, "string", is_blank("v"), blank_to_null("v", ["NA"]), fill_text("v"))
    assert got == [
        (True, None, "Unknown"), (True, "  ", "  "), (True, None, "Unknown"), (False, None, "NA"), (False, "x", "x"),
    ]
    assert mapped(spark, [7, 1234], "int", padded_id(F.col("v"), "P", 3)) == ["P007", "P1234"]


def test_dates_with_dots(spark):
    texts = {"2024.01.05": "2024-01-05", "2024.1.5": "2024-01-05", "05.01.2024": "2024-05-01", "25.01.2024": "2024-01-25", "2024.13.01": "2024.13.01", "1.2.24": "1.2.24", "2024-01.05": "2024-01.05", "2024x01x05": "2024x01x05"}
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    found = rows.select("v", normalize_date("v").alias("d")).collect()
    assert {r.v: r.d for r in found} == texts
