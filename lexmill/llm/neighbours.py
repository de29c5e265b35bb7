"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to length one, turned into a longer space by a fixed random
rotation and kept as sign bits with one correction scalar. Codes are made once
where the vectors lie and packed into chunks with them; blocks of queries come
to the chunks. A query's inner product with a code, divided by the scalar,
estimates the cosine; the scalar also bounds the error. The vectors of a chunk
whose upper bound reaches its k-th best lower bound are reranked there with
their original components, and the k best leave the chunk: k rows a query and
chunk, however many copies of a vector there are.

All codes are scanned for each block of queries. Lists around centroids would
not do: on vectors without clusters, such as those of the shared tables, the
true neighbours lie in 35 of 100 lists for a recall of 0.9.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut, give_back, sliced

#: Codes in a chunk and bytes of its vectors, at most; queries in a block, at least: a task holds one of each.
CHUNK = 16384
CHUNK_BYTES = 16 << 20
BLOCK = 512
#: Bits of a code, at least; more bits make estimates closer.
BITS = 512
#: Error bound in standard deviations of the estimate; larger reranks more.
EPSILON = 3.0
#: Queries whose estimates are held at once, and components of pairs that are reranked at once.
TOGETHER = 128
PAIR_NUMBERS = 1 << 20
#: Bytes of query vectors in a block, about; a block is broadcast.
BROADCAST_BYTES = 64 << 20


def rotation(dim: int, seed: int = 29) -> np.ndarray:
    """(dim, bits): orthonormal rows in a random direction, the same everywhere."""
    bits = max(BITS, -(-dim // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).T


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, inner product of each turned vector with its own code)."""
    turned = unit @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(turn.shape[1])


def estimate(bits: np.ndarray, own: np.ndarray, queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries, codes) and the error bound of each code.

    With signs s in {-1, 1}, <s, q> = 2 * (sum of q where the bit is set) - sum of q.
    """
    n = turn.shape[1]
    turned = (queries @ turn).astype(np.float32)
    set_bits = np.unpackbits(bits, axis=1, count=n).astype(np.float32)
    product = (2 * (turned @ set_bits.T) - turned.sum(1, keepdims=True)) / np.float32(np.sqrt(n))
    bound = EPSILON * np.sqrt(np.maximum(1 - own**2, 0) / (own**2 * max(1, n - 1)))
    return product / own.astype(np.float32), bound.astype(np.float32)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def cosine(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosines of rows with their queries in double precision; equal pairs get equal values wherever they stand."""
    return (rows * queries).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((queries * queries).sum(1)))


def search_chunk(ids: np.ndarray, bits: np.ndarray, own: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query_id, vec_id, score) of the k nearest of a chunk for each query, among those whose codes allow it; ties to smaller ids."""
    turn = rotation(queries.shape[1])
    unit = unit_rows(queries)
    for first in range(0, len(queries), TOGETHER):
        part = slice(first, first + TOGETHER)
        estimated, bound = np.empty((len(unit[part]), len(ids)), np.float32), np.empty(len(ids), np.float32)
        for at in range(0, len(ids), 4096):
            some = slice(at, at + 4096)
            estimated[:, some], bound[some] = estimate(bits[some], own[some], unit[part], turn)
        estimated[query_ids[part, None] == ids] = -np.inf
        if len(ids) > k:
            least = np.partition(estimated - bound, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            least = np.full(len(estimated), -np.inf, np.float32)
        estimated += bound
        query, code = np.nonzero((estimated >= least[:, None]) & (estimated > -np.inf))
        score, step = np.empty(len(query)), max(1, PAIR_NUMBERS // queries.shape[1])
        for at in range(0, len(query), step):
            some = slice(at, at + step)
            score[some] = cosine(vectors[code[some]], queries[part][query[some]])
        order = np.lexsort((ids[code], -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        best = order[place < k]
        yield query_ids[part][query[best]], ids[code[best]], score[best]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part.

    Vectors whose largest component is beyond 1e100 or below 1e-100 are scaled
    by a power of two, which changes no cosine, so that no square overflows.
    """
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    large = F.array_max(F.transform("v", lambda x: F.abs(x)))
    # In two steps: a power of two may itself be beyond what a double holds.
    half = F.pow(F.lit(2.0), -F.floor(F.log2(large) / 2))
    return rows.withColumn("v", F.when(large.between(1e-100, 1e100), F.col("v")).otherwise(F.transform("v", lambda x: x * half * half)))


def code_chunks(rows: DataFrame) -> DataFrame:
    """(chunk, dim, n, ids, bits, own, vectors): packed codes of the rows with their components, made where the rows lie."""

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {}

        def packed(dim):
            nonlocal number
            ids, x, bits, own = (np.concatenate(part) for part in zip(*held.pop(dim)))
            number += 1
            blob = lambda x: pa.array([x.tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int64()), blob(ids.astype("<i8")), blob(bits), blob(own.astype("<f8")), blob(x.astype("<f8"))], ["chunk", "dim", "n", "ids", "bits", "own", "vectors"])

        for batch in sliced(batches, 4096):
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            sizes, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                x = flat[(ends[mine] - dim)[:, None] + np.arange(dim)]
                held.setdefault(dim, []).append((ids[mine], x, *encode(unit_rows(x), rotation(dim))))
                size = sum(len(h[0]) for h in held[dim])
                if size > CHUNK - 4096 or 8 * dim * size > CHUNK_BYTES // 2:
                    yield packed(dim)
        for dim in list(held):
            yield packed(dim)

    return rows.mapInArrow(run, "chunk long, dim int, n long, ids binary, bits binary, own binary, vectors binary")


def by_dimension(asked: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{dimension: (ids, vectors)} of a block of queries, by rising id."""
    table = asked.select("vec_id", "v").toArrow().combine_chunks()
    ids, v = table.column("vec_id").to_numpy(), table.column("v").combine_chunks()
    sizes, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
    ends, out = np.cumsum(sizes), {}
    for dim in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == dim)
        mine = mine[np.argsort(ids[mine], kind="stable")]
        out[dim] = ids[mine], flat[(ends[mine] - dim)[:, None] + np.arange(dim)]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest vectors by cosine.

    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, nor do rows without an id; a query meets vectors of its own
    dimension. Ties go to the smaller id; repeated rows each count; of different
    vectors under one query id the smallest is asked. With fewer candidates
    than k, all are returned; without queries or vectors there are no rows.
    Extra columns are ignored.
    """
    rows, asked = usable(vectors, id_column, vector_column), usable(queries, id_column, vector_column)
    asked = cut(asked.groupBy("vec_id").agg(F.min("v").alias("v")))
    facts = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers")).first()
    blocks = max(1, min(-(-8 * facts["numbers"] // max(1, BROADCAST_BYTES)), -(-facts["n"] // BLOCK)))
    codes = cut(code_chunks(rows))
    dealt = codes.repartition(max(1, codes.count()))

    def scan(sought) -> DataFrame:
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    n, dim = row["n"], row["dim"]
                    if dim in sought.value:
                        bits, x = np.frombuffer(row["bits"], np.uint8).reshape(n, -1), np.frombuffer(row["vectors"], "<f8").reshape(n, dim)
                        for found in search_chunk(np.frombuffer(row["ids"], "<i8"), bits, np.frombuffer(row["own"], "<f8"), x, *sought.value[dim], k):
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])
            give_back()

        return dealt.select("dim", "n", "ids", "bits", "own", "vectors").mapInArrow(run, "query_id long, vec_id long, score double")

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    send = vectors.sparkSession.sparkContext.broadcast
    scored = reduce(DataFrame.unionByName, [scan(send(by_dimension(asked.where(block == b)))) for b in range(blocks)])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
