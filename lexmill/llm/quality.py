"""Quality by Bradley-Terry pairwise ranking.

Preference pairs (a good document over a bad one) train a linear score by
logistic loss on feature differences; the quantile of the training scores at
the share of bad rows is the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import features
from lexmill.llm.common import join_checked, sliced

#: Labelled rows used for training, at most; those with the smallest hash of the id.
TRAIN_ROWS = 8000


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    spread: float
    accept: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the threshold lies at ``accept``."""
        z = (self.margin(x) - self.cut) / self.spread + np.log(self.accept / (1 - self.accept))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray, accept: float = 0.3, steps: int = 1200, batch: int = 256, seed: int = 5) -> Ranker:
    """Learn from rows marked good or not. With one kind only, every score is 1 or 0 throughout."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = (x.std(0) if len(x) else np.ones(x.shape[1])) + 1e-6
    yes, no = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(yes) or not len(no):
        return Ranker(mean, scale, np.zeros(x.shape[1]), -1.0 if len(yes) or not len(x) else 1.0, 0.1, accept)
    z = np.clip((x - mean) / scale, -6, 6)
    rng, w = np.random.default_rng(seed), np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        d = z[rng.choice(yes, batch)] - z[rng.choice(no, batch)]
        g = -(d / (1 + np.exp(np.clip(d @ w, -40, 40)))[:, None]).mean(0) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    s = z @ w
    # Between the two scores around the quantile at the bad rows' share.
    return Ranker(mean, scale, w, float(np.quantile(s, (~good).mean(), method="midpoint")), float(s.std() / 4 + 1e-9), accept)


def held_out(id_column: str = "doc_id"):
    """True for the fold that training never sees."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, accept: float = 0.3) -> Ranker:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, chosen by hash of the id."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    x, kept = features.collect(join_checked(documents.select("doc_id", "text"), chosen, "doc_id", "inner", rows), "doc_id", "_quality")
    return fit(x, np.array([q == 1 for _, q in kept], bool), accept)


def score(documents: DataFrame, ranker: Ranker, *keep: str) -> DataFrame:
    """``keep`` columns and ``score`` of every row. Null and empty texts are scored by their (zero) features."""
    wanted = [F.col(c) for c in keep]

    def run(batches):
        for batch in sliced(batches):
            s = ranker.score(features.matrix(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64())], [*keep, "score"])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*wanted, F.col("text").cast("string").alias("_text")).mapInArrow(run, f"{schema}, score double")


def accepted(documents: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    at = documents.columns.index("text")

    def run(batches):
        for batch in sliced(batches):
            s = ranker.score(features.matrix(batch.column(at)))
            yield batch.filter(pa.array(s >= ranker.accept))

    return documents.withColumn("text", F.col("text").cast("string")).mapInArrow(run, documents.withColumn("text", F.col("text").cast("string")).schema)


def classify(documents: DataFrame, labels: DataFrame, accept: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; repeated rows get the same score.

    Extra columns are ignored. Without labels every document is accepted.
    """
    scored = score(documents, train(documents, labels, accept=accept), "doc_id")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
