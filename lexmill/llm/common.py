"""Helpers shared by the operators: tables, lineage cuts, size-checked joins, caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.plans.views import TEXTS, spread

#: A side is broadcast only if it holds at most this many (narrow) rows.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared tables, read by Spark alone (any store it can open)."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return bounded_batches(spread(rows) if name in TEXTS else rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where it is unset and the master is
    local (tests), a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    kept = persistent("shared_dir")
    if not hasattr(kept, "path"):
        kept.path = "file://" + tempfile.mkdtemp(prefix="lexmill-")
    return kept.path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame that ``cut`` returned, once nothing reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cut-" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def collect_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished frames that nothing refers to any more; it does so only when their objects are collected."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_checked(big: DataFrame, small: DataFrame, on: str | list[str], how: str, rows: int | None = None) -> DataFrame:
    """Join; ``small`` is broadcast only when a count proves it small, else both sides shuffle."""
    n = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)


def persistent(name: str) -> types.SimpleNamespace:
    """State that outlives a task in a Python process: tokenizers, power tables."""
    key = f"_kept_by_worker_{name}"
    if key not in sys.modules:
        sys.modules[key] = types.SimpleNamespace()
    return sys.modules[key]


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with Arrow batches of at most ``rows`` rows from now on where the session has no setting of its own.

    Whole texts travel in these batches; Spark's default of 10,000 rows would
    hold tens of megabytes of text per task, several times over.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, "10000") == "10000":
        df.sparkSession.conf.set(key, str(rows))
    return df


def sliced(batches, rows: int = 1024):
    """The batches in pieces of at most ``rows`` rows, so that Python holds little at once; at the end, what it freed goes back to the system."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
    give_back()


def give_back() -> None:
    """Free pages that numpy and Arrow no longer use; workers live on between tasks."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
