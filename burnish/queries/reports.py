"""Report queries: events stand for graded runs, one per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.operators.grade import bounded
from burnish.operators.report import outcome as outcome_of
from burnish.operators.report import succeeded, summary_by_level, summary
from burnish.queries.registry import query, table

RUNS = """select event_id as episode, event_type as level,
    (round(value * 100)::bigint % 99 + 1) / 100 as reward, (1 + user_id % 30)::int as steps from events"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("episode"),
        F.col("event_type").alias("level"),
        bounded((F.round(F.col("value") * 100).cast("bigint") % 99 + 1) / 100).alias("reward"),
        (F.col("user_id") % 30 + 1).cast("int").alias("steps"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c.startswith("average") else F.col(c) for c in df.columns])


@query(
    f"""select count(*) as episodes, round(avg(reward), 6) as average_reward, round(avg(steps), 6) as average_steps
    from ({RUNS})""",
    name="summary",
)
def summary_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary(runs(spark, sf_dir)))


@query(
    f"""select level, round(avg(reward), 6) as average_reward, count(*) as episodes from ({RUNS})
    group by level order by level""",
    name="summary_by_level",
)
def levels_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary_by_level(runs(spark, sf_dir)))


@query(
    f"""select episode, reward >= 0.5 as success, case when reward >= 0.5 then 'SUCCESS' when reward > 0.3 then 'PARTIAL'
    else 'FAILED' end as outcome from ({RUNS})"""
)
def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    return rows.select("episode", succeeded("reward").alias("success"), outcome_of("reward").alias("outcome"))
