"""Nearest neighbours over several chunks and blocks, with extreme components, and recall on the shared vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import neighbours


def recall(spark, frame, x, ids, asked):
    got = {}
    for r in neighbours.nearest(frame, frame.where(F.col("vec_id").isin([int(a) for a in asked]))).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    norm = np.sqrt((x * x).sum(1))
    hits = 0
    for q in asked:
        i = int(np.flatnonzero(ids == q)[0])
        s = (x * x[i]).sum(1) / (norm * norm[i])
        s[i] = -9
        want = ids[np.lexsort((ids, -s))[:5]]
        rows = sorted(got[int(q)])
        hits += len(set(want.tolist()) & {v for _, v, _ in rows})
        assert [n for n, _, _ in rows] == [1, 2, 3, 4, 5]
        assert all(score == pytest.approx(s[np.flatnonzero(ids == v)[0]], abs=1e-12) for _, v, score in rows)
    return hits / (5 * len(asked))


def test_many_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 4200)
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", 0)
    x = np.random.default_rng(7).standard_normal((3000, 16))
    ids = np.arange(3000) * 3
    d = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(7)
    assert neighbours.code_chunks(neighbours.usable(d, "vec_id", "embedding")).count() >= 7
    assert recall(spark, d, x, ids, ids[::100]) >= 0.97


def test_recall_on_the_shared_vectors(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [r for r in d.collect() if r.embedding is not None and any(r.embedding)]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    assert recall(spark, d, x, ids, ids[ids % 50 == 0]) >= 0.97


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8))
    scale = [1e200, 1e-200, 1.0, 1e308 / 20, 5e-300]
    rows = [(i, [float(c) * scale[i % 5] for c in v]) for i, v in enumerate(base)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(spark, d, base, np.arange(40), np.arange(0, 40, 7)) == 1.0


def test_repeats_and_empty_tables(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0), (2, [1.0, 1.0], 0), (3, [], 0), (4, [2.0, 2.0, 1.0], 0)], "vec_id long, embedding array<double>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.nearest(d, d.where("vec_id in (1, 3, 4)")).collect())
    assert got == [(1, 1, 2, round(0.5**0.5, 9)), (1, 2, 2, round(0.5**0.5, 9))]
    assert neighbours.nearest(d.where("false"), d).count() == 0 and neighbours.nearest(d, d.where("false")).count() == 0


def test_copies_leave_a_chunk_k_times(spark):
    """A chunk gives k rows a query, with 4,000 copies of one vector and near copies of another; ties go to the smaller ids."""
    x = np.random.default_rng(11).standard_normal((6000, 16))
    x[500:4500] = x[0]
    x[4500:5500] = x[1] + 1e-9 * x[4500:5500]
    ids = np.arange(6000) * 2
    asked = np.concatenate([ids[:4500:150], ids[4500:5500:100], ids[-3:]])
    d = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(2)
    chunks = neighbours.code_chunks(neighbours.usable(d, "vec_id", "embedding")).collect()
    for c in chunks:
        of, dim, queries = np.frombuffer(c["ids"], "<i8"), c["dim"], x[asked // 2]
        parts = list(neighbours.search_chunk(of, np.frombuffer(c["bits"], np.uint8).reshape(len(of), -1), np.frombuffer(c["own"], "<f8"), np.frombuffer(c["vectors"], "<f8").reshape(-1, dim), asked, queries, 5))
        assert sum(len(q) for q, _, _ in parts) == 5 * len(asked)
    got = {}
    for r in neighbours.nearest(d, d.where(F.col("vec_id").isin([int(a) for a in asked]))).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in asked.tolist():
        score = neighbours.cosine(x, np.repeat(x[q // 2][None], len(x), 0))
        score[q // 2] = -9
        want = np.lexsort((ids, -score))[:5]
        assert [v for _, v, _ in sorted(got[q])] == ids[want].tolist()
        assert [s for _, _, s in sorted(got[q])] == score[want].tolist()
