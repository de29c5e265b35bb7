"""Sinks: reports, JSON lines, text corpora, CSV per split, packages; none overwrites silently."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SinkError(ValueError):
    """A destination is not what it must be."""


def write_report(report: dict, path: str) -> None:
    """A small JSON report with sorted keys; readers see the old file or the new one."""
    temporary = f"{path}.incomplete.{os.getpid()}"
    with open(temporary, "w", encoding="utf-8") as handle:
        json.dump(report, handle, indent=2, sort_keys=True, ensure_ascii=False)
        handle.write("\n")
    os.replace(temporary, path)


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines; a destination with files is an error, and a failed job leaves no result."""
    rows.write.mode("errorifexists").json(path)


def write_corpus(rows: DataFrame, path: str, text: str = "text", order: str = "rank") -> None:
    """One text per line, in order over all files."""
    rows.orderBy(order).select(F.col(text).alias("value")).write.mode("errorifexists").text(path)


def write_splits(rows: DataFrame, path: str, fields: list[str], split: str = "split") -> None:
    """CSV with a header and a fixed order of fields, in one folder per split."""
    rows.select(split, *fields).write.mode("errorifexists").partitionBy(split).csv(path, header=True)


def write_two_tiers(evidence: DataFrame, by: list[str], public: str, private: str) -> None:
    """Row evidence under a private root, counts under a public one."""
    evidence.write.mode("errorifexists").parquet(private)
    evidence.groupBy(*by).agg(F.count("*").alias("n")).write.mode("errorifexists").json(public)


def copy_once(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a file unless the target is there; then its content must be equal. True if it was copied."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    if not b.getFileSystem(conf).exists(b):
        return jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    digests = {r[0] for r in spark.read.format("binaryFile").load([source, target]).select(F.sha2("content", 256)).collect()}
    if len(digests) > 1:
        raise SinkError(f"{target} differs from {source}")
    return False


def pack_folder(folder: str, package: str) -> dict[str, str]:
    """A tar.gz that depends on names and contents alone, and each file's digest.

    Names are sorted; times and owners are zero.
    """
    digests: dict[str, str] = {}
    with open(package, "wb") as out, gzip.GzipFile(fileobj=out, mode="wb", mtime=0, filename="") as zipped, tarfile.open(fileobj=zipped, mode="w") as tar:
        for top, _, files in sorted(os.walk(folder)):
            for name in sorted(files):
                full = os.path.join(top, name)
                inside = os.path.relpath(full, folder)
                with open(full, "rb") as handle:
                    data = handle.read()
                digests[inside] = hashlib.sha256(data).hexdigest()
                info = tarfile.TarInfo(inside)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    return digests
