"""Counts of shingles do not blur as the corpus grows: many groups and buckets tell the same as a plain count."""

from collections import Counter

from pyspark.sql import functions as F

from lexmill.llm import jaccard


def test_counts_over_groups_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 400)
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 11)
    monkeypatch.setattr(jaccard, "BUCKET_SHINGLES", 500)
    # Of 10^10 shingles, some 30 GB of text, all but a few have a slot of their own.
    assert 1 << jaccard.SLOT_BITS >= 100 * 10**10
    texts = [" ".join(f"w{(i % 40) * 1000 + (j if j % 30 or i < 40 else 7 * i + j)}" for j in range(40 + i % 40)) for i in range(100)]
    texts += [" ".join(f"c{j}" for j in range(60))] * 20 + ["", None, " \t", "one two", "ONE  two", "a b c d"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def shingles(text):
        w = (text or "").lower().split()
        return {" ".join(w)} if 0 < len(w) < 4 else {" ".join(w[i : i + 4]) for i in range(len(w) - 3)}

    sets = [shingles(t) for t in texts]
    counts = Counter(x for s in sets for x in s)
    rows = d.select("doc_id", F.xxhash64("text").alias("_key"), F.col("text").alias("_text"))
    assert jaccard.packed_sets(rows, 4).count() > 9
    for bucket in (None, 10**6):
        found = {r.doc_id: r for r in jaccard.counted_points(rows, 4, 85, bucket).collect()}
        assert len(found) == len(texts)
        for i, s in enumerate(sets):
            several = sum(counts[x] > 1 for x in s)
            wide = int(jaccard.window(len(s), 85)) if s else 0
            assert (found[i].n, found[i].u) == (len(s), len(s) - several)
            assert len(found[i].pivots) == max(0, min(wide - (len(s) - several), several))
        assert len({bytes(r.node) for r in found.values()}) == len({frozenset(s) for s in sets})
    part = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 85 * len(s | sets[j]) and part[i] != part[j]:
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    got = {r.doc_id: r.component_id for r in jaccard.link_classes(d).collect()}
    assert [got[i] for i in range(len(texts))] == part and len(set(part)) <= len(part) - 20
