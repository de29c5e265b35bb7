"""Runs of words, counted in blocks and buckets."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import runs


def test_runs_counted_in_blocks_are_all_runs(spark, monkeypatch):
    r = random.Random(6)
    docs = [(i * 37 - 500, [r.choice("abcdefg") for _ in range(r.randint(0, 60))]) for i in range(150)] + [(7000, None), (7001, [])]
    d = spark.createDataFrame(docs, "doc_id long, w array<string>")
    want = Counter(" ".join(w[i : i + 3]) for _, w in docs if w for i in range(len(w) - 2))
    want = {g: n for g, n in want.items() if n >= 12}
    hashes = F.when(F.size("w") >= 3, T.gram_hashes(F.col("w"), 3, distinct=False))
    for chunk, documents, size, few in ((4_000_000, 500, 0, 10), (50, 3, 40_000_000, 1_000_000)):
        monkeypatch.setattr(runs, "CHUNK", chunk)
        monkeypatch.setattr(runs, "DOCUMENTS", documents)
        counted = runs.frequent(d.select("doc_id", hashes.alias("h")), 12, size)
        rows = runs.spelled(d, hashes, counted, 3, few).collect()
        assert {x.gram: x.n for x in rows} == want and len(rows) == len(want) > 20


def test_hashes_do_not_become_rows(spark, sf):
    from lexmill.plans import curation

    seen, stored = [], curation.stored
    curation.stored = lambda rows: seen.append(rows._jdf.queryExecution().executedPlan().toString()) or stored(rows)
    try:
        assert curation.ngram_counts(spark, sf).count() > 0
    finally:
        curation.stored = stored
    assert len(seen) == 1 and "Generate" not in seen[0]
