"""Choosing among candidates: ranks, guards, promotion. Selection sees development figures only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(arms: DataFrame, metric: str, label: str) -> DataFrame:
    """``place`` by metric, then label. Arms are few."""
    return arms.withColumn("place", F.row_number().over(Window.orderBy(metric, label)))


def against_baseline(arms: DataFrame, metric: str, is_baseline: Column, least_gain: float) -> DataFrame:
    """``delta`` to the baseline arm and whether the gain reaches the limit (inclusive)."""
    base = arms.where(is_baseline).select(F.col(metric).alias("baseline")).limit(1)
    return arms.join(F.broadcast(base)).withColumn("delta", F.round(F.col(metric) - F.col("baseline"), 6)).withColumn("promote", F.col("baseline") - F.col(metric) >= least_gain)


def guarded_best(candidates: DataFrame, metric: str, guard: str, limit: Column, step: str) -> DataFrame:
    """The best candidate whose guard is within the limit (inclusive); of equals the earliest. No row if none passes."""
    best = candidates.where(F.col(guard) <= limit).agg(F.min_by(F.struct(*candidates.columns), F.struct(metric, step)).alias("b")).where("b is not null")
    return best.select("b.*")
