"""Whole blocks and pages, spans apart and placed, plain quantiles, realised mixtures, repeated rows."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import htmltext, mixing, packing, pii, quality


def test_all_words_of_a_block_and_an_attribute_count():
    a, b = (f"<p>{'word ' * 60}{last}</p>" for last in ("alpha", "beta"))
    assert (htmltext.vectors(htmltext.blocks(a)) != htmltext.vectors(htmltext.blocks(b))).any()
    paths = [htmltext.blocks(f"<div class='col md grid item wide left {x}'>t</div>")[0][0] for x in ("comments", "content")]
    assert ".comments" in paths[0] and paths[0] != paths[1]


def test_inline_elements_keep_their_text():
    assert [t for _, t, _ in htmltext.blocks("<p>Let <math>x+1</math> be <object>in</object><canvas>side</canvas></p>")] == ["Let x+1 be inside"]
    assert [t for _, t, _ in htmltext.blocks("<p>a<script>var b</script><style>c</style><select><option>d</select>e</p>")] == ["ae"]


def test_unclosed_elements_take_linear_time():
    def seconds(n):
        began = time.perf_counter()
        htmltext.blocks("<select><textarea>word" * n)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(40_000) < 5


def test_empty_pages(spark):
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "url").count() == 0


def test_spans_of_many_matches(spark):
    r = random.Random(4)
    texts = ["", "no", *(" ".join(r.choice(("a@b.cd", "word", "é€𝄞", "x.y@z.org")) for _ in range(n)) for n in (1, 5, 63, 64, 65, 700, 5000))]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    pattern = pii.PATTERNS["email"]
    for x in d.select("i", pii.spans(F.col("t"), pattern, 0).alias("s")).collect():
        plain = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", texts[x.i])]
        assert [(s.start, s.end, s.value) for s in x.s] == plain


def test_added_spans_lie_apart(spark):
    rows = [(0, [(5, 4, 9, "a"), (7, 5, 20, "b"), (9, 6, 12, "c"), (5, 5, 8, "d")]), (1, [(3, 4, 5, "a")]), (2, []), (3, [(1, 4, 3, "a"), (3, 5, 6, "b"), (2, 6, 9, "c")])]
    d = spark.createDataFrame(rows, f"i int, s {pii.SPANS}")
    got = {x.i: [(s.start, s.end) for s in x.s] for x in d.select("i", pii.apart(F.col("s")).alias("s")).collect()}
    assert got == {0: [(5, 9), (9, 12)], 1: [(3, 5)], 2: [], 3: [(1, 3), (3, 6)]}


def test_detect_edges(spark, docs, empty):
    assert pii.detect(docs, "doc_id").count() == docs.count() and pii.detect(empty, "doc_id").count() == 0


def test_threshold_is_a_quantile():
    rng = np.random.default_rng(5)
    good = np.arange(400) % 4 > 0
    x = rng.standard_normal((400, 6)) + np.outer(good, [2, 1, 0, 0, 0, 0])
    ranker = quality.fit(x, good)
    s = ranker.margin(x)
    assert ranker.cut == np.quantile(s, 0.25, method="midpoint") and abs((s < ranker.cut).mean() - 0.25) < 0.01
    assert ((ranker.score(x) >= 0.3) == (s >= ranker.cut)).all()


def test_resampled_tokens_follow_the_rates(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rated = {r.doc_id: r for r in mixing.mix(d, labels).collect()}
    kept = {r.doc_id: r["count"] for r in mixing.resample(d, labels).groupBy("doc_id").count().collect()}
    assert all(kept.get(i, 0) == r.copies for i, r in rated.items())
    sums = np.array([sum(kept.get(i, 0) * r.tokens * r[f"p_{k}"] for i, r in rated.items()) for k in mixing.DOMAINS])
    # Copies are rounded rates: the shares are those asked for up to a few documents.
    assert sums / sums.sum() == pytest.approx([mixing.WEIGHTS[k] for k in mixing.DOMAINS], abs=0.012)
    clean = [i for i, r in rated.items() if r.p_clean > 0.995]
    assert len(clean) > 300 and all(kept.get(i, 0) >= 1 for i in clean)


def test_targets_that_cannot_be_met_still_settle(spark):
    d = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (10, [0.0, 1.0, 0.0])], "_tokens long, _p array<double>")
    steps = mixing.fit_rates(d)
    rates = [x[0] for x in d.select(mixing.rate_after(steps, F.col("_p"))).collect()]
    assert rates[0] == pytest.approx(1.02) and rates[1] == pytest.approx(1.02 * 0.02 / 0.97)


def test_mixing_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    assert mixing.mix(docs, labels).count() == docs.count() and mixing.mix(empty, labels).count() == 0
    assert mixing.resample(empty, labels).count() == 0 and mixing.resample(docs, labels).columns == docs.columns


def test_repeated_rows_spread_over_groups(spark):
    import public_tokenizers

    d = spark.range(600).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words").alias("text")).repartition(3)
    out = packing.pack(d, public_tokenizers.path("word_bpe_49k.json"), group_docs=50)
    sizes = [r["count"] for r in out.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert sum(sizes) == 600 and len(sizes) == 12 and max(sizes) < 100
