"""Summaries: splits, manifests, error rates, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(errors: Column, words: Column, digits: int = 6) -> Column:
    """A ratio of sums; NULL without words."""
    return F.round(errors / F.nullif(words, F.lit(0)), digits)


def error_rates(scored: DataFrame, *by: str | Column) -> DataFrame:
    """Corpus error rate per group: summed edits over summed reference words."""
    return scored.groupBy(*by).agg(F.count("*").alias("utterances"), F.sum("errors").alias("errors"), F.sum("words").alias("words")).withColumn("wer", rate(F.col("errors"), F.col("words")))


def split_summary(manifest: DataFrame, by: str = "split") -> DataFrame:
    """Segments, hours, recordings, sessions and the range of durations of each split.

    Two distinct counts in one pass: rows are first reduced to (split,
    recording, session), then counted.
    """
    return manifest.groupBy(by).agg(
        F.count("*").alias("segments"),
        F.bround(F.sum("duration") / 3600.0, 4).alias("speech_hours"),
        F.count_distinct("source_record_id").alias("recordings"),
        F.count_distinct("airport", "recorded_date").alias("sessions"),
        F.round(F.min("duration"), 3).alias("min_duration"),
        F.round(F.max("duration"), 3).alias("max_duration"),
    )


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)), digits)
