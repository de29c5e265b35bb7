"""Curation: ordered reject cascades, reason flags, clamps, first-seen dedupe, interval unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; NULL if none does. Later rules are not counted."""
    out = None
    for name, fails in rules:
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in their order."""
    return F.filter(F.array(*(F.when(fails, name) for name, fails in rules)), lambda x: x.isNotNull())


def clamp_end(end: Column, length: Column, slack: float = 0.15) -> tuple[Column, Column]:
    """(end, whether it was moved): an end at most ``slack`` past the file is the file's end."""
    over = (end > length) & (end <= length + slack)
    return F.when(over, length).otherwise(end), over


def bad_boundary(start: Column, end: Column, length: Column, least: float = 0.1) -> Column:
    return (start < 0) | (end - start < least) | (end > length)


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given total order.

    The least (order) struct per key is found by partial aggregation, so copies
    collapse before they are dealt out.
    """
    rest = [c for c in rows.columns if c not in key and c not in order]
    packed = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*key).agg(packed).select(*key, *(F.col(f"_row.{c}").alias(c) for c in [*order, *rest])).select(*rows.columns)


def covered(intervals: DataFrame, by: list[str], start: str = "start", stop: str = "stop", width: float = 3600) -> DataFrame:
    """Length of the union of each group's half-open intervals; nested and touching ones count once.

    What earlier intervals reach is the larger of what earlier buckets of
    ``width`` reach and what earlier intervals of the own bucket do, so a
    hot group is merged by many tasks.
    """
    rows = intervals.withColumn("_bucket", F.floor(F.col(start) / width))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*by, "_bucket").agg(F.max(stop).alias("_far")).withColumn("_far", F.max("_far").over(before))
    inside = Window.partitionBy(*by, "_bucket").orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1)
    reached = rows.join(reach, [*by, "_bucket"]).withColumn("_reached", F.greatest("_far", F.max(stop).over(inside)))
    fresh = F.greatest(F.lit(0), F.col(stop) - F.greatest(F.col(start), F.coalesce("_reached", F.col(start))))
    return reached.groupBy(*by).agg(F.count("*").alias("pieces"), F.sum(fresh).alias("covered"))


def running_total(rows: DataFrame, value: Column, rank: Column, partition: list[str] | None = None, prefix: int = 3, bucket: Column | None = None) -> DataFrame:
    """``rows`` with ``cum``: the total of ``value`` up to and with each row, in order of ``rank``.

    Buckets divide the order: the first digits of a hexadecimal rank, or
    ``bucket``, which must not fall as the rank rises. Their totals give each
    bucket its start. No task sees more than a bucket, whatever the partition's
    size.
    """
    by = partition or []
    kept = rows.withColumn("_rank", rank).withColumn("_value", value).withColumn("_bucket", F.substring("_rank", 1, prefix) if bucket is None else bucket)
    sums = kept.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    return kept.join(starts, [*by, "_bucket"]).withColumn("cum", F.col("_start") + F.sum("_value").over(inside)).drop("_bucket", "_start")


def numbered(rows: DataFrame, by: list[str], key: str, width: int = 4096) -> DataFrame:
    """``rows`` with ``number``: 1, 2, ... within ``by``, in order of an integer key; a hot group is numbered by many tasks."""
    out = running_total(rows, F.lit(1), F.col(key), by, bucket=F.floor(F.col(key) / width))
    return out.withColumnRenamed("cum", "number").drop("_rank", "_value")
