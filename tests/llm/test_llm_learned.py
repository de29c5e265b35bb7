"""Learned operators: held-out accuracy, plain versions, edge cases."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import features, htmltext, jaccard, lmscore, mixing, neighbours, quality
from lexmill.llm.common import cut


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    return read("documents"), read("labels")


def test_quality_held_out(tables, docs, empty):
    d, labels = tables
    got = quality.classify(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    edge = quality.classify(docs, labels)
    assert edge.count() == docs.count() and edge.where("score is null").count() == 0
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(docs, labels.where("false")).where("predicted = 0").count() == 0


def test_quality_learns_only_from_its_folds(tables):
    d, labels = tables
    spoiled = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(d, x) for x in (labels, spoiled))
    assert np.array_equal(a.weight, b.weight) and a.cut == b.cut


def test_accepted_keeps_columns(tables):
    d, labels = tables
    ranker = quality.train(d, labels)
    kept = quality.accepted(d, ranker)
    assert kept.columns == d.columns and kept.count() == quality.score(d, ranker, "doc_id").where("score >= 0.3").count()


def test_lm_scores(spark, docs, empty):
    texts = ["a b a b c", "a b", "", None, "c c c"]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, word long")
    target = spark.createDataFrame([(0,), (0,), (99,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in lmscore.score(d, target).collect()}
    known = lmscore.vocabulary(d.select(F.col("text").alias("_text")))
    assert len(known) == 3

    def model(chosen):
        uni, pair, total = {}, {}, {}
        for t in chosen:
            s = ["^", *(t or "").split(), "^"]
            for x, y in zip(s, s[1:]):
                uni[y] = uni.get(y, 0) + 1
                pair[x, y] = pair.get((x, y), 0) + 1
                total[x] = total.get(x, 0) + 1
        n = sum(uni.values())

        def loss(t):
            s = ["^", *(t or "").split(), "^"]
            out = []
            for x, y in zip(s, s[1:]):
                base = (uni.get(y, 0) + 1) / (n + lmscore.SIZE)
                kinds = len({b for a, b in pair if a == x})
                w = total.get(x, 0) / (total.get(x, 0) + kinds) if x in total else 0
                out.append(-np.log(w * pair.get((x, y), 0) / max(1, total.get(x, 0)) + (1 - w) * base))
            return np.mean(out)

        return loss

    near, far = model(texts[:1]), model(texts)
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len((t or "").split()) + 1
        assert got[i].target_loss == pytest.approx(near(t), rel=1e-5) and got[i].background_loss == pytest.approx(far(t), rel=1e-5)
        assert got[i].score == pytest.approx(got[i].target_loss - got[i].background_loss, abs=1e-6)
    assert lmscore.score(docs, target).count() == docs.count() and lmscore.score(empty, target).count() == 0


def test_mixture_meets_targets(tables, docs):
    d, labels = tables
    rows = mixing.mix(d, labels).collect()
    mass = np.array([sum(r.rate * r.tokens * r[f"p_{k}"] for r in rows) for k in mixing.DOMAINS])
    assert mass / mass.sum() == pytest.approx([mixing.WEIGHTS[k] for k in mixing.DOMAINS], abs=1e-4)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 and sum(r[f"p_{k}"] for k in mixing.DOMAINS) == pytest.approx(1) for r in rows)
    marked = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    rate = lambda want: np.mean([r.copies for r in rows if marked.get(r.doc_id) == want])
    assert rate((1, 0)) > 0.9 and rate((0, 0)) < 0.3 and rate((1, 1)) < 0.6
    assert mixing.mix(docs, labels.where("false")).count() == docs.count()


def test_rates_are_a_plain_projection(spark):
    r = random.Random(1)
    raw = [[r.random() for _ in mixing.DOMAINS] for _ in range(50)]
    data = [(r.randint(0, 40), [x / sum(p) for x in p]) for p in raw]
    d = spark.createDataFrame(data, "_tokens long, _p array<double>")
    steps = mixing.fit_rates(d, most=8)
    got = [x[0] for x in d.select(mixing.rate_after(steps, F.col("_p"))).collect()]
    t, p = np.array([x for x, _ in data], float), np.array([p for _, p in data])
    mass = (t[:, None] * p).sum(0)
    target = np.array([mixing.WEIGHTS[k] for k in mixing.DOMAINS]) * 1.02 * mass[0] / mixing.WEIGHTS["clean"]
    rate = np.ones(len(t))
    for _ in range(len(steps)):
        rate = np.maximum(0, rate - p @ (((rate * t) @ p - target) / np.maximum(mass, 1)))
    assert got == pytest.approx(rate.tolist(), abs=1e-9)


# ---- nearest neighbours -----------------------------------------------------------


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 24)).astype("f4")
    x[100:140] = x[7] * 2
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(600)] + [(600, None, 0), (601, [0.0] * 24, 0), (602, [float("nan")] * 24, 0), (603, [None] * 24, 0), (None, [1.0] * 24, 0), (604, [1.0, 2.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in neighbours.nearest(d, d.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = x.astype(float)
    norm = np.sqrt((x * x).sum(1))
    hits = 0
    assert sorted(got) == list(range(0, 600, 50))
    for q in got:
        s = (x * x[q]).sum(1) / (norm * norm[q])
        s[q] = -9
        want = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        hits += len({v for v, _ in got[q]} & set(want.tolist()))
        assert all(score == pytest.approx(s[v], abs=1e-12) for v, score in got[q])
    assert hits / (5 * len(got)) >= 0.97
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert neighbours.nearest(few.where("false"), few.where("false")).count() == 0


# ---- exact join -------------------------------------------------------------------


def brute(rows, k=4, percent=85):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())

    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                part[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("few", [jaccard.FEW_PAIRS, 0])
def test_join_against_brute_force(spark, monkeypatch, few):
    """With and without rounds of pivots; the words repeat, so that cells are crowded."""
    monkeypatch.setattr(jaccard, "FEW_PAIRS", few)
    r = random.Random(8)
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice("abcdefghijkl") + str(r.randint(0, 5)) for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "edit" + str(r.randint(0, 40))
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "A b"), (n + 3, "a  B"), (n + 4, "\t")]
    d = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, node long").repartition(4)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.link_classes(d).collect())
    assert got == brute(rows)


def test_join_edges(spark, docs, empty):
    assert jaccard.link_classes(docs).count() == docs.count() and jaccard.link_classes(empty).count() == 0
    kept = [r.doc_id for r in jaccard.one_of_each(docs).collect()]
    assert {0, 3, 4, 5, 6, 8, 9, 10, 12} <= set(kept) and 2 not in kept and 7 not in kept and kept.count(11) == 1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 9], "a long, b long")
    assert {r.node: r.part for r in jaccard.components(cut(edges)).collect()} == {i: 0 if i < 10 else 10 for i in range(21)}


# ---- pages ------------------------------------------------------------------------


def test_blocks():
    page = "<html><head><title>t</title><script>var t='</p>';</script></head><body><!-- x --><nav><a href='/'>Home</a></nav><p>A &amp; B<br>c  d<p>two<div class=ad>buy</div><b>bare</b></body>"
    assert [t for _, t, _ in htmltext.blocks(page)] == ["Home", "A & B c d", "two", "buy", "bare"]
    for odd in ("", "<", "<p", "&am", "</p></div>", "<script>x", "<!--", "a<b>c"):
        htmltext.blocks(odd)


def test_labeller_held_out():
    net = htmltext.trained()
    r = random.Random(12345)
    data = [d for d in (htmltext.labelled(htmltext.example(r)) for _ in range(150)) if len(d[1])]
    right = np.concatenate([k == (y > 0.5) for k, (_, y) in zip(htmltext.label(net, [x for x, _ in data]), data)])
    assert right.mean() > 0.97


def test_extraction(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = htmltext.extract(pages.withColumn("text", F.lit("clash")), "page_id", "url", "html").collect()
    good = 0
    for r in rows:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)
        want = "\n".join(t for p, t, _ in htmltext.blocks(r.html) if "article" in p)
        good += r.text == want
        assert r.n_chars == len(r.text) and inside
    assert good / len(rows) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<p")], "page_id int, html string")
    assert [(r.text, r.n_chars) for r in htmltext.extract(odd, "page_id").collect()] == [("", 0)] * 3


def test_features_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["A b c!", "", None, "word " * 50, "x|y ### 1"]
    whole = features.matrix(pa.array(texts, pa.string()))
    assert np.allclose(whole, np.vstack([features.matrix(pa.array([t], pa.string())) for t in texts]))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, sf))
        assert out.columns == docs.columns and 0 < out.count(), name
        docs = out
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert rows.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
