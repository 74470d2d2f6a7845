"""Cleaning specs of the catalog tasks, and the suite that cleans and grades them."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions.dates import DAY_FIRST
from burnish.functions.emails import fix_email
from burnish.functions.text import lower_strip, strip, title_case
from burnish.operators.grade import Sheets, grade, grade_sheets
from burnish.plans import words as W
from burnish.plans.spec import CleaningSpec, Ids, Undated, amount, clean_table, count, dates, words
from burnish.session import settle
from burnish.sources.catalog import TASKS, Task, available_tasks, existing
from burnish.sources.tables import ORDER, read_sheets, read_table, read_table_or_empty, unreadable

# Spellings in the stock table that title case does not give.
STOCK_CATEGORIES = ["Electronics", "Accessories", "Storage"]


def task_specs(formats: Sequence[str] = DAY_FIRST) -> dict[str, CleaningSpec]:
    """Spec per task name. ``formats`` decides dates such as 04-05-2024."""
    day = [dates(formats)]
    return {
        "easy": CleaningSpec(exact_duplicates=True),
        "medium": CleaningSpec(
            {
                "customer_name": [title_case],
                "order_date": day,
                "amount": [amount(2)],
                "email": [fix_email],
            }
        ),
        "hard": CleaningSpec(
            {
                "name": [title_case],
                "category": [words(STOCK_CATEGORIES, title_case)],
                "price": [amount(2)],
                "quantity": [count()],
                "last_updated": day,
                "supplier": [strip],
            },
            undated=Undated("last_updated"),
            ids=Ids("product_id", by_place=True, prefix="P", width=3),
        ),
        "hr": CleaningSpec(
            {
                "name": [title_case],
                "department": [words(W.DEPARTMENTS)],
                "salary": [amount(0)],
                "hire_date": day,
                "city": [words(W.CITIES)],
                "email": [lower_strip],
            },
            key="employee_id",
            domains=["email"],
        ),
        "healthcare": CleaningSpec(
            {
                "name": [title_case],
                "condition": [words(W.CONDITIONS)],
                "appointment_date": day,
                "doctor": [words(W.DOCTORS)],
                "insurance_id": [strip],
                "status": [lower_strip],
            },
            key="patient_id",
        ),
        "finance": CleaningSpec(
            {
                "date": day,
                "merchant": [words(W.MERCHANTS)],
                "category": [words(W.SPENDING_CATEGORIES)],
                "amount": [amount(2)],
                "payment_method": [words(W.PAYMENT_METHODS)],
                "status": [lower_strip],
            },
            key="transaction_id",
        ),
        "logistics": CleaningSpec(
            {
                "origin": [words(W.ORIGINS)],
                "destination": [words(W.DESTINATIONS)],
                "carrier": [words(W.CARRIERS)],
                "weight_kg": [amount(1)],
                "ship_date": day,
                "status": [lower_strip],
            },
            key="tracking_id",
        ),
        "education": CleaningSpec(
            {
                "name": [title_case],
                "subject": [words(W.SUBJECTS)],
                "grade": [words(W.GRADES)],
                "semester_date": day,
                "credits": [count()],
                "status": [lower_strip],
            },
            key="student_id",
        ),
    }


def clean_task(spark: SparkSession, folder: str, task: Task, spec: CleaningSpec) -> DataFrame:
    """Cleaned table of one task, with its row order in ``_order``."""
    return clean_table(read_table(spark, f"{folder}/{task.messy_file}", ordered=True), spec, ORDER)


def grade_file(spark: SparkSession, submitted: str | None, expected: str, **options: object) -> DataFrame:
    """Grade two files; one that is missing, cannot be read or breaks off scores lowest.

    Both are read once, and kept under the shared folder for the grader.
    """
    given = None if not submitted else read_table_or_empty(spark, submitted, stored=True)
    return grade(given, read_table_or_empty(spark, expected, stored=True, ordered=True), ORDER, **options)


def grade_suite(
    spark: SparkSession, folder: str, tasks: Sequence[Task] = TASKS, clean: bool = False
) -> DataFrame:
    """Rows (task, level, row_score, column_score, cell_score, reward) for every task in ``folder``.

    The messy tables are graded as they are, or after the spec of their task. All tasks are graded by one keyed job;
    unless they are cleaned, their files are read by one scan, too.
    """
    listed = available_tasks(spark, folder, tasks)
    there = existing(spark, folder, [f for t in listed for f in (t.messy_file, t.clean_file)])
    truth = _sheets(spark, {t.name: f"{folder}/{t.clean_file}" for t in listed if t.clean_file in there})
    if clean:
        specs = task_specs()
        given = Sheets.of({t.name: clean_task(spark, folder, t, specs[t.name]).drop(ORDER) for t in listed if t.messy_file in there})
    else:
        given = _sheets(spark, {t.name: f"{folder}/{t.messy_file}" for t in listed if t.messy_file in there})
    return with_levels(grade_sheets(given, truth, [t.name for t in listed]), listed)


def with_levels(grades: DataFrame, tasks: Sequence[Task]) -> DataFrame:
    """Grades with the level of their task behind its name."""
    levels = F.create_map(*[F.lit(x) for t in tasks for x in (t.name, t.level)])[F.col("task")]
    return grades.select("task", levels.alias("level"), *[c for c in grades.columns if c != "task"])


def _sheets(spark: SparkSession, paths: dict[str, str]) -> Sheets:
    """Tables read at once and kept; where one of them cannot be read to its end, each is read for itself."""
    if not paths:
        return Sheets(spark.createDataFrame([], "task string, cells array<string>, place string"), {})
    try:
        sheets = read_sheets(spark, paths)
        return Sheets(settle(sheets.rows, "sheets"), sheets.headers)
    except (PySparkException, Py4JJavaError, ValueError) as error:
        if not isinstance(error, ValueError) and not unreadable(error):
            raise
    tables = {task: _read_or_empty(spark, path) for task, path in paths.items()}
    return Sheets.of(tables, ORDER) if any(t.columns for t in tables.values()) else _sheets(spark, {})


def _read_or_empty(spark: SparkSession, path: str) -> DataFrame:
    try:
        return read_table_or_empty(spark, path, stored=True, ordered=True)
    except ValueError:  # its files have different headers
        return spark.createDataFrame([], "")
