"""Governance: expectations, content digests, completeness, leaks by ancestor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpectationError(ValueError):
    """Some expectations do not hold."""


def expectations(facts: DataFrame, expected: dict[str, object]) -> DataFrame:
    """(name, expected, actual, ok): one row per expectation on a one-row frame of facts."""
    row = facts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(str(v)).alias("expected"), F.col(n).cast("string").alias("actual")) for n, v in expected.items()))).alias("e")).select("e.*")
    return row.withColumn("ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def require(report: DataFrame) -> None:
    """Raise if an expectation fails, naming all that do."""
    failed = report.where(~F.col("ok")).orderBy("name").limit(100).collect()
    if failed:
        raise ExpectationError("; ".join(f"{r['name']}: expected {r['expected']}, found {r['actual']}" for r in failed))


def digest(rows: DataFrame, *columns: str) -> Column:
    """A digest of a set of rows that does not depend on their order: counts and sums of row digests."""
    text = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns))
    part = lambda i: F.sum(F.conv(F.substring(F.sha2(text, 256), 1 + 8 * i, 8), 16, 10).cast("long"))
    return F.sha2(F.concat_ws(":", F.count("*"), *(part(i) for i in range(4))), 256)


def completeness(expected: DataFrame, found: DataFrame, key: str, content: str) -> DataFrame:
    """(status, n): names that are the same, changed, missing or unexpected."""
    both = expected.select(key, F.col(content).alias("_want")).join(found.select(key, F.col(content).alias("_have")), key, "full")
    status = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_want") == F.col("_have"), "same").otherwise("changed")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns by name; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
