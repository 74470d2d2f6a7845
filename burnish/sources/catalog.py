"""The cleaning tasks: a messy table, the clean one, a level and a description."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Task:
    name: str
    level: str
    description: str
    always: bool = False

    @property
    def messy_file(self) -> str:
        return f"{self.name}_messy.csv"

    @property
    def clean_file(self) -> str:
        return f"{self.name}_clean.csv"


# Names, levels and order. The first three are always listed, the
# others only if both their tables exist.
TASKS = (
    Task("easy", "easy", "Customers: repeated rows, missing values.", always=True),
    Task("medium", "medium", "Sales: dates, casing, e-mails, padding, amounts as text.", always=True),
    Task("hard", "hard", "Stock: missing ids, negative counts, prices, dates, casing, padding.", always=True),
    Task("hr", "medium", "Employees: casing, salaries, dates, e-mails, missing values, repeats."),
    Task("healthcare", "medium", "Appointments: casing, dates, missing insurance ids."),
    Task("finance", "hard", "Transactions: casing, amounts, dates, missing values."),
    Task("logistics", "hard", "Shipments: places, carrier names, dates, missing weights."),
    Task("education", "medium", "Students: casing, dates, missing credits."),
)


def existing(spark: SparkSession, folder: str, files: Iterable[str]) -> set[str]:
    """Which of ``files`` are right in ``folder``, as a file or as a folder of parts.

    The file system that Spark would read from is asked for each name; nothing
    is listed or read, and a folder that is missing holds nothing.
    """
    found = set()
    for name in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found.add(name)
    return found


def available_tasks(spark: SparkSession, folder: str, tasks: Sequence[Task] = TASKS) -> list[Task]:
    there = existing(spark, folder, [f for t in tasks for f in (t.messy_file, t.clean_file)])
    return [t for t in tasks if t.always or {t.messy_file, t.clean_file} <= there]


def task_catalog(spark: SparkSession, folder: str, tasks: Sequence[Task] = TASKS) -> DataFrame:
    """Rows (task, level, description, messy_file, clean_file) with full paths."""
    base = folder.rstrip("/")
    rows = [
        (t.name, t.level, t.description, f"{base}/{t.messy_file}", f"{base}/{t.clean_file}")
        for t in available_tasks(spark, folder, tasks)
    ]
    return spark.createDataFrame(
        rows, "task string, level string, description string, messy_file string, clean_file string"
    )
