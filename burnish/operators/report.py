"""Summaries of graded runs: one row per episode with level, reward and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.text import col

# Thresholds of the outcome.
SUCCESS_FROM, PARTIAL_ABOVE = 0.5, 0.3


def succeeded(reward: Column | str) -> Column:
    return col(reward) >= SUCCESS_FROM


def outcome(reward: Column | str) -> Column:
    return (
        F.when(succeeded(reward), "SUCCESS").when(col(reward) > PARTIAL_ABOVE, "PARTIAL").otherwise("FAILED")
    )


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("episodes"),
        F.avg("reward").alias("average_reward"),
        F.avg("steps").alias("average_steps"),
    )


def summary_by_level(results: DataFrame) -> DataFrame:
    return (
        results.groupBy("level")
        .agg(F.avg("reward").alias("average_reward"), F.count(F.lit(1)).alias("episodes"))
        .orderBy("level")
    )
