"""Episode logs: one text line per start, step and end of a graded run.

[START] task=<name>_<level>_<id> env=<env> model=<model>
[STEP] step=<n> action=<text> reward=<0.00> done=<true|false> error=<text>
[END] success=<true|false> steps=<n> score=<0.00> rewards=<0.00,0.00,...>
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions.numbers import fixed_scale
from burnish.operators.ordering import names, with_position
from burnish.session import settle
from burnish.sources.tables import ORDER, with_file_order

# The line formats.
START = r"^\[START\] task=(\S*) env=(\S*) model=(.*)$"
STEP = r"^\[STEP\] step=(\d+) action=(.*) reward=(-?[\d.]+) done=(true|false) error=(.*)$"
END = r"^\[END\] success=(true|false) steps=(\d+) score=(-?[\d.]+) rewards=(.*)$"
TASK_NAME = r"^(.*)_([^_]+)_([^_]+)$"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value, _order) of one log or a folder of logs."""
    return with_file_order(spark.read.text(path))


def _field(regex: str, n: int) -> Column:
    return F.when(F.col("value").rlike(regex), F.regexp_extract("value", regex, n))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Fields of every line; ``kind`` is START, STEP, END or null for other text."""
    rest = [c for c in lines.columns if c != "value"]
    kind = F.regexp_extract("value", r"^\[(START|STEP|END)\] ", 1)
    rewards = F.transform(F.split(_field(END, 4), ","), lambda r: r.try_cast("double"))
    return lines.select(
        *rest,
        F.nullif(kind, F.lit("")).alias("kind"),
        _field(START, 1).alias("task"),
        _field(START, 2).alias("env"),
        _field(START, 3).alias("model"),
        _field(STEP, 1).try_cast("bigint").alias("step"),
        _field(STEP, 2).alias("action"),
        _field(STEP, 3).try_cast("double").alias("reward"),
        (_field(STEP, 4) == "true").alias("done"),
        _field(STEP, 5).alias("error"),
        (_field(END, 1) == "true").alias("success"),
        _field(END, 2).try_cast("int").alias("steps"),
        _field(END, 3).try_cast("double").alias("score"),
        rewards.alias("rewards"),
    )


def episodes(lines: DataFrame, order: str | Sequence[str] = ORDER) -> DataFrame:
    """One row per END line: episode, task, task_id, level, env, model, reward, steps, success, rewards.

    Task, env and model come from the START line right before it, STEP lines
    aside. An END closes its START: a second END has none. Only those two kinds
    of lines are put in order.
    """
    order = names(order)
    marks = lines.where(F.col("value").rlike(r"^\[(START|END)\] "))
    fields = ["kind", "task", "env", "model", "steps", "score", "success", "rewards"]
    placed = settle(with_position(parse_lines(marks).select(*order, *fields), order, "place"), "marks")
    starts = placed.where("kind = 'START'").select((F.col("place") + 1).alias("of"), *[F.col(c).alias(f"its_{c}") for c in fields[1:4]])
    ends = placed.where("kind = 'END'").join(starts, F.col("place") == F.col("of"), "left")
    return with_position(ends, "place", "episode").select(
        F.col("episode"),
        F.col("its_task").alias("task"),
        F.regexp_extract("its_task", TASK_NAME, 3).alias("task_id"),
        F.regexp_extract("its_task", TASK_NAME, 2).alias("level"),
        F.col("its_env").alias("env"),
        F.col("its_model").alias("model"),
        F.col("score").alias("reward"),
        "steps",
        "success",
        "rewards",
    )


def _flag(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def start_line(task: Column, env: Column, model: Column) -> Column:
    return F.format_string("[START] task=%s env=%s model=%s", task, env, model)


def step_line(step: Column, action: Column, reward: Column, done: Column, error: Column) -> Column:
    return F.format_string(
        "[STEP] step=%s action=%s reward=%s done=%s error=%s",
        step.cast("string"),
        F.replace(action, F.lit("\n"), F.lit(" ")),
        fixed_scale(reward, 2),
        _flag(done),
        F.coalesce(error, F.lit("null")),
    )


def end_line(success: Column, steps: Column, score: Column, rewards: Column) -> Column:
    listed = F.array_join(F.transform(rewards, lambda r: fixed_scale(r, 2)), ",")
    return F.format_string(
        "[END] success=%s steps=%s score=%s rewards=%s",
        _flag(success),
        steps.cast("string"),
        fixed_scale(score, 2),
        listed,
    )


def episode_lines(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Lines (episode, line, value) of ``runs`` and their ``steps``.

    runs: episode, task, env, model, success, steps, score, rewards
    steps: episode, step, action, reward, done, error
    """
    c = F.col
    last = F.lit(2**63 - 1)
    return (
        runs.select("episode", F.lit(0).cast("bigint").alias("line"), start_line(c("task"), c("env"), c("model")).alias("value"))
        .unionByName(
            steps.select(
                "episode",
                c("step").cast("bigint").alias("line"),
                step_line(c("step"), c("action"), c("reward"), c("done"), c("error")).alias("value"),
            )
        )
        .unionByName(
            runs.select(
                "episode",
                last.alias("line"),
                end_line(c("success"), c("steps"), c("score"), c("rewards")).alias("value"),
            )
        )
    )


def write_log(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Text files which, in name order, hold the episodes one after the other."""
    placed = lines.repartitionByRange("episode", "line").sortWithinPartitions("episode", "line")
    placed.select("value").write.mode(mode).text(path)
