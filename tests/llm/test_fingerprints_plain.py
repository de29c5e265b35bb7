"""Fingerprints against a plain winnowing, at every length; buckets of ids with gaps."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.llm import fingerprints as P


def plain(h: list[int], k: int = P.K, window: int = P.WINDOW):
    """Chosen (position, hash) of run hashes: the least of each window, the rightmost of equal ones."""
    chosen = set()
    for i in range(max(1, len(h) - window + 1)) if h else ():
        part = h[i : i + window]
        least = min(part)
        chosen.add((i + max(j for j, x in enumerate(part) if x == least), least))
    return sorted(chosen)


def test_against_plain_winnowing(spark):
    """Texts of 0 to 60 words: no length has a rule of its own."""
    r = random.Random(1)
    texts = [" ".join(r.choice("abcd") + str(r.randint(0, 3)) for _ in range(n)) for n in range(61)]
    d = spark.createDataFrame([(i, t, t.split()) for i, t in enumerate(texts)], "i int, t string, w array<string>")
    low = F.lit((1 << 32) - 1)
    h = F.transform("w", lambda x: F.xxhash64(x))
    runs = F.when(F.size("w") == 0, F.array().cast("array<bigint>")).when(F.size("w") < P.K, F.array(F.xxhash64(h).bitwiseAND(low))).otherwise(
        F.transform(F.slice(h, F.lit(1), F.size(h) - 2), lambda x, i: F.xxhash64(x, h[i + 1], h[i + 2]).bitwiseAND(low))
    )
    rows = d.select("i", P.winnow(F.col("t")).alias("f"), runs.alias("runs")).collect()
    for x in rows:
        got = sorted(((1 << 31) - 1 - (p & ((1 << 31) - 1)), p >> 31) for p in x.f)
        assert got == plain(list(x.runs)), texts[x.i]


def test_one_word_more_changes_little(spark):
    words = [f"w{i * 37 % 101}" for i in range(70)]
    d = spark.createDataFrame([(" ".join(words[:n]), " ".join(words[: n + 1])) for n in range(20, 69)], "a string, b string")
    of = lambda c: F.array_distinct(F.transform(P.winnow(F.col(c)), P.hash_of))
    assert min(x[0] for x in d.select(P.likeness(of("a"), of("b"))).collect()) > 0.8


@pytest.mark.parametrize("parts", [256, 3])
def test_likeness_of_neighbours_and_even_buckets(spark, monkeypatch, parts):
    monkeypatch.setattr(P, "PARTS", parts)
    r = random.Random(2)
    ids = [*r.sample(range(500), 60), 10**15, None, 7_000_000]
    rows = [(i, " ".join(r.choice("abcdef") + str(r.randint(0, 9)) for _ in range(r.randint(0, 50)))) for i in ids]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = [x["count"] for x in P.with_next(d, bucket_rows=8).where("not _guest").groupBy("_bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 24 and len(sizes) >= 4
    monkeypatch.setattr(P, "BUCKET_ROWS", 8)
    got = {x.doc_id: x for x in P.fingerprint_all(d).collect()}
    order = sorted(rows, key=lambda x: -1 if x[0] is None else x[0])
    sets = lambda f: {h.split(":")[0] for h in f.split()}

    def dice(a, b):
        return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))

    for (i, _), (j, _) in zip(order, order[1:] + order[:1]):
        assert got[i].near_next == pytest.approx(dice(sets(got[i].fingerprint), sets(got[j].fingerprint)))
        assert got[i].near_edited == pytest.approx(dice(sets(got[i].fingerprint), sets(got[i].edited_fingerprint)))
