"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table gives every document its posterior
over the domains. Nonnegative rates (expected copies) per document are then
fitted by projected-gradient least squares, so that the expected domain tokens
(rate x tokens x posterior, summed) meet the targets. Every gradient is one
distributed sum of as many numbers as there are domains.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from lexmill.llm import features
from lexmill.llm import textkernel as K
from lexmill.llm.common import cut, join_checked, sliced

DOMAINS = ("clean", "toxic", "poor")
#: Share of the target tokens that each domain should have.
WEIGHTS = {"clean": 0.97, "toxic": 0.02, "poor": 0.01}
#: What the target gives the anchor domain, as a multiple of its tokens.
GROWTH = 1.02
#: Labelled rows for the classifier, at most; those with the smallest hash of the id.
TRAIN_ROWS = 6000
#: Gradient steps, at most; each is one distributed sum.
STEPS = 60
#: Plain steps before those in the metric of the rows that still have a rate.
PLAIN = 12
#: Posteriors are fitted with this many sweeps.
SWEEPS = 500


@dataclass
class Posterior:
    """Multinomial logistic regression."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.column_stack([z, np.ones(len(z))]) @ self.weight
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit_posterior(x: np.ndarray, y: np.ndarray, kinds: int, sweeps: int = SWEEPS) -> Posterior:
    """Without any labelled row the posteriors are uniform."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack([np.clip((x - mean) / scale, -6, 6), np.ones(len(x))])
    hot = np.eye(kinds)[y] if len(y) else np.zeros((0, kinds))
    w = np.zeros((z.shape[1], kinds))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, sweeps + 1 if len(x) else 0):
        s = z @ w
        e = np.exp(s - s.max(1, keepdims=True))
        g = z.T @ (e / e.sum(1, keepdims=True) - hot) / len(z) + 2e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Posterior(mean, scale, w)


#: Hash buckets of words; those that tell the domains apart best become features.
BUCKETS = 1 << 15
CHOSEN = 64


def letters_only(data: np.ndarray) -> np.ndarray:
    """Marks and digits become spaces: words are letters alone."""
    keep = np.zeros(256, bool)
    keep[65:91] = keep[97:123] = keep[128:] = True
    return np.where(keep[data], data, np.uint8(32))


def buckets(column: pa.Array):
    """For each chunk of rows: (rows, row of each word, bucket of each word)."""
    data, offsets = K.string_buffer(column)
    for first, last in K.chunks(offsets):
        own = offsets[first : last + 1]
        part, own = letters_only(data[own[0] : own[-1]]), own - own[0]
        starts, ends, firsts = K.words_of(part, own)
        at = (K.word_hashes(part, starts, ends) % K.U64(BUCKETS)).astype(np.int64)
        yield last - first, np.repeat(np.arange(last - first), np.diff(firsts)), at


def word_features(column: pa.Array, chosen: np.ndarray) -> np.ndarray:
    """For each row, whether each of the chosen word buckets occurs."""
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    out = []
    for n, rows, bucket in buckets(column):
        at = place[bucket]
        hit = np.zeros((n, len(chosen)))
        hit[rows[at >= 0], at[at >= 0]] = 1.0
        out.append(hit)
    return np.vstack(out) if out else np.zeros((0, len(chosen)))


def choose_buckets(rows: DataFrame, kinds: int) -> np.ndarray:
    """The buckets whose presence differs most between a domain and the rest, on the (bounded) labelled rows."""

    def run(batches):
        for batch in sliced(batches):
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            counts, row = np.zeros((kinds, BUCKETS), np.int64), 0
            for n, rows_, bucket in buckets(batch.column(0)):
                seen = np.unique(rows_ * BUCKETS + bucket)
                np.add.at(counts, (y[row + seen // BUCKETS], seen % BUCKETS), 1)
                row += n
            yield pa.RecordBatch.from_arrays([pa.array([counts.astype("<i8").tobytes()], pa.binary()), pa.array([np.bincount(y, minlength=kinds).astype("<i8").tobytes()], pa.binary())], ["counts", "rows"])

    counts, n = np.zeros((kinds, BUCKETS)), np.zeros(kinds)
    for r in rows.select("_text", "_domain").coalesce(16).mapInArrow(run, "counts binary, rows binary").toLocalIterator():
        counts += np.frombuffer(r["counts"], "<i8").reshape(kinds, BUCKETS)
        n += np.frombuffer(r["rows"], "<i8")
    best = set()
    for k in range(kinds):
        rest = np.arange(kinds) != k
        inside = (counts[k] + 0.5) / (n[k] + 1)
        outside = (counts[rest].sum(0) + 0.5) / (n[rest].sum() + 1)
        gain = (inside - outside) * np.log(inside / outside)
        best |= set(np.argsort(-gain, kind="stable")[: CHOSEN // kinds].tolist())
    return np.array(sorted(best))


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, _domain): one domain per labelled id; of repeated labels the worst counts."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_q"), F.max(F.coalesce("toxic", F.lit(0))).alias("_t"))
        .select("doc_id", F.when(F.col("_t") == 1, 1).when(F.col("_q") == 0, 2).otherwise(0).alias("_domain"))
    )


def all_features(column: pa.Array, chosen: np.ndarray) -> np.ndarray:
    return np.hstack([features.matrix(column), word_features(column, chosen)])


def posteriors(documents: DataFrame, labels: DataFrame, *keep: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """``keep`` columns, _tokens (words) and _p (array<double>, one per domain) of every document."""
    kinds = len(DOMAINS)
    chosen_rows = domain_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = documents.select("doc_id", F.col("text").cast("string").alias("_text"))
    sample = cut(join_checked(text, chosen_rows, "doc_id", "inner", rows))
    chosen = choose_buckets(sample, kinds)

    def sampled(batches):
        for batch in sliced(batches):
            x = all_features(batch.column(1), chosen).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "domain", "x"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    got = sample.select("doc_id", "_text", "_domain").mapInArrow(sampled, f"doc_id {kind}, domain int, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    width = len(features.NAMES) + features.BUCKETS + len(chosen)
    x = np.array([np.frombuffer(r["x"], "<f4") for r in got], float).reshape(-1, width)
    model = fit_posterior(x, np.array([r["domain"] for r in got], np.int64), kinds)
    given = documents.select(*dict.fromkeys([*keep, "text"])).withColumn("text", F.col("text").cast("string"))
    at, names = given.columns.index("text"), list(keep)

    def run(batches):
        for batch in sliced(batches):
            column = batch.column(at)
            p = model.predict(all_features(column, chosen))
            data, offsets = K.string_buffer(column)
            words = [np.zeros(0, np.int64)]
            for first, last in K.chunks(offsets):
                own = offsets[first : last + 1]
                words.append(np.diff(K.words_of(data[own[0] : own[-1]], own - own[0])[2]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * kinds, pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate(words).astype(np.int64)), lists], [*names, "_tokens", "_p"])

    schema = given.select(*keep).schema.add("_tokens", LongType()).add("_p", ArrayType(DoubleType()))
    return given.mapInArrow(run, schema)


def rate_after(steps: list[list[float]], p: Column) -> Column:
    """The rate that a document has after the given gradient steps, each projected to zero or more."""
    each = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps)) if steps else F.array().cast("array<array<double>>")
    kinds = len(DOMAINS)
    return F.aggregate(each, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - sum((s[k] * p[k] for k in range(1, kinds)), s[0] * p[0])))


def fit_rates(scored: DataFrame, weights: dict[str, float] = WEIGHTS, anchor: str = "clean", growth: float = GROWTH, most: int = STEPS, tolerance: float = 1e-6) -> list[list[float]]:
    """Gradient steps that take all rates from 1 to the least-squares fit.

    Targets are ``weights`` of a total that gives the anchor domain ``growth``
    times the tokens it has; a domain that has less than its share is asked for
    what it has. Each residual counts relative to its domain's
    tokens; in the metric of tokens a full step never overshoots. After PLAIN of them, steps
    take the metric of the rows whose rate is not zero, where posteriors that
    overlap no longer slow the fit. Steps end when
    the targets are met or the fit no longer moves; a fit that has done neither
    is reported by a warning.
    """
    kinds = len(DOMAINS)
    p = F.col("_p")

    def totals(steps):
        """Domain tokens at the rates, and the sums of posterior products over the rows whose rate is not zero."""
        r = rate_after(steps, p)
        sums = [F.sum(r * F.col("_tokens") * p[k]) for k in range(kinds)]
        products = [F.sum(F.when(r > 0, F.col("_tokens") * p[i] * p[j])) for i in range(kinds) for j in range(kinds)]
        found = [float(x or 0.0) for x in scored.agg(*(c.alias(f"s{i}") for i, c in enumerate([*sums, *products]))).first()]
        return found[:kinds], np.array(found[kinds:]).reshape(kinds, kinds)

    mass, products = totals([])
    total = growth * mass[DOMAINS.index(anchor)] / weights[anchor]
    # A domain is not asked for more tokens than it has: others would pay for its repetition.
    target = [weights[d] * total if d == anchor else min(weights[d] * total, mass[k]) for k, d in enumerate(DOMAINS)]
    steps: list[list[float]] = []
    now = mass
    for _ in range(most):
        residual = [(now[k] - target[k]) / max(mass[k], 1.0) for k in range(kinds)]
        if max(map(abs, residual)) < tolerance:
            break
        if len(steps) < PLAIN:
            steps.append(residual)
        else:
            # Were no rate to reach zero on the way, this step would meet the targets.
            steps.append(np.linalg.lstsq(products, np.array(now) - target, rcond=1e-12)[0].tolist())
        before, (now, products) = now, totals(steps)
        if all(abs(x - y) <= 1e-9 * max(m, 1.0) for x, y, m in zip(before, now, mass)):
            break  # where rates at zero keep a target out of reach, this is the least-squares fit
    else:
        warnings.warn(f"rates moved domain tokens to {now} of {target} in {most} steps and had not settled", stacklevel=2)
    return steps


def mix(documents: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, seed: int = 23) -> DataFrame:
    """doc_id, tokens, a posterior per domain, rate and copies of every document.

    ``copies`` rounds the rate up or down by a hash of the id, so that its mean
    is the rate. Null and empty texts have no tokens, and a posterior like any
    other. Repeated rows count each; a domain without tokens gets none; extra
    columns are ignored.
    """
    scored, rate, copies = rated(documents, labels, weights, seed, "doc_id")
    return scored.select("doc_id", F.col("_tokens").alias("tokens"), *(F.col("_p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), rate.alias("rate")).withColumn("copies", copies("rate"))


def rated(documents: DataFrame, labels: DataFrame, weights: dict[str, float], seed: int, *keep: str, **fit):
    """(rows with posteriors, their rate, a function from the name of a column of rates to the copies)."""
    scored = cut(posteriors(documents, labels, *keep))
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return scored, rate_after(fit_rates(scored, weights, **fit), F.col("_p")), lambda column: F.floor(F.col(column) + u).cast("long")


def resample(documents: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, seed: int = 23, growth: float = GROWTH) -> DataFrame:
    """The rows of ``documents``, each as often as its copies say; the fitted rates alone decide.

    Clean documents have a rate of about ``growth`` and so stay; the larger it
    is, the less sure a posterior may be before a rate falls below 1. Null and empty
    texts are rated like any other; an empty table stays empty.
    """
    scored, rate, copies = rated(documents, labels, weights, seed, *documents.columns, growth=growth)
    rows = scored.withColumn("_rate", rate).withColumn("_copies", copies("_rate")).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*documents.columns)
