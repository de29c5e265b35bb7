"""Streaming ingestion of predictions (an extension: the batch programs have no streams).

Rows arrive as files; repeated ids within the watermark are dropped; error
rates are kept per window. Restarting from the checkpoint neither loses rows
nor counts them twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.functions.edit import edit_distance
from lexmill.functions.text import norm_score, tokens


def read_predictions(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def windowed_error_rate(rows: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window, model, utterances, errors, words: sums per tumbling window, from (ts, id, model, text, pred_text)."""
    once = rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["id", "model"])
    ref, hyp = tokens(norm_score(F.col("text"))), tokens(norm_score(F.coalesce("pred_text", F.lit(""))))
    scored = once.select(time, "model", edit_distance(ref, hyp).alias("errors"), F.size(ref).alias("words"))
    return scored.groupBy(F.window(time, width), "model").agg(F.count("*").alias("utterances"), F.sum("errors").alias("errors"), F.sum("words").alias("words"))


def start(rates: DataFrame, target: str, checkpoint: str):
    """Finished windows are appended as Parquet; progress lives in the checkpoint."""
    return rates.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
