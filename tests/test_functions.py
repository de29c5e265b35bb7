import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import edit, stats, text


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, line = line, [i]
        for j, y in enumerate(b, 1):
            line.append(min(line[-1] + 1, above[j] + 1, above[j - 1] + (x != y)))
    return line[-1]


PAIRS = [([], []), (["a"], []), ([], ["a"]), (["a"], ["b"]), (["a", "b"], ["b", "a"]), (["a", "b", "c"], ["a", "c"])]


def random_pairs(n, seed=1):
    r = random.Random(seed)
    return [([r.choice("abcd") for _ in range(r.randint(0, 9))], [r.choice("abcd") for _ in range(r.randint(0, 9))]) for _ in range(n)]


def test_three_ways_agree(spark):
    pairs = PAIRS + random_pairs(150)
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>").select(edit.edit_distance(F.col("a"), F.col("b")).alias("d"), edit.edit_counts("a", "b").alias("c"), edit.align("a", "b").alias("o"), "a", "b").collect()
    for r in rows:
        assert r.d == r.c.cost == sum(o.op != "C" for o in r.o) == distance(r.a, r.b)
        counts = {k: sum(o.op == k for o in r.o) for k in "SDI"}
        assert r.c.substitutions + r.c.deletions + r.c.insertions == r.c.cost
        assert counts["D"] - counts["I"] == r.c.deletions - r.c.insertions == len(r.a) - len(r.b)
        assert [o.ref for o in r.o if o.op != "I"] == r.a and [o.hyp for o in r.o if o.op != "D"] == r.b


def test_ties_prefer_substitutions():
    assert edit.count_edits([(["a", "b"], ["b", "a"])]).tolist() == [[2, 2, 0, 0]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("xyz"), max_size=8), st.lists(st.sampled_from("xyz"), max_size=8))
def test_counts_property(a, b):
    cost, s, d, i = edit.count_edits([(a, b)])[0]
    assert cost == s + d + i == distance(a, b) and d - i == len(a) - len(b)
    assert sum(op != "C" for op, _, _ in edit.alignment(a, b)) == cost


SAMPLES = ["Él Niño's café—déjà vu!", "straße 12.5 [unk] [UNK]", "", "  a\tb\n", "don't — stop", "ÄÖÜ çêñ", "x_y % z"]


def exact_score(t):
    kept = "".join(c for c in unicodedata.normalize("NFKD", t).lower() if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() or c in "' " else " " for c in kept).split())


def exact_audit(t):
    kept = "".join(c for c in unicodedata.normalize("NFKD", t).casefold() if not unicodedata.combining(c))
    return " ".join("".join(" " if unicodedata.category(c)[0] in "PS" else c for c in kept).split())


def test_norms_match_full_unicode(spark):
    d = spark.createDataFrame([(t,) for t in SAMPLES], "t string")
    rows = d.select("t", text.norm_score(F.col("t")).alias("s"), text.norm_audit(F.col("t")).alias("a"), text.exact("score")("t").alias("es"), text.exact("audit")("t").alias("ea")).collect()
    for r in rows:
        assert r.s == r.es == exact_score(r.t) and r.a == r.ea == exact_audit(r.t)


def test_exact_mode_outside_the_table(spark):
    d = spark.createDataFrame([("½ ﬁ İ",)], "t string")
    assert d.select(text.exact("score")("t")).first()[0] == exact_score("½ ﬁ İ")


def test_markup_numbers_and_cells(spark):
    d = spark.createDataFrame([("[hes] a [unk] [#x] (-b) c [UNK]", "niner 12.5", "**[a](b)**<br>`c`", 7)], "m string, n string, c string, k int")
    r = d.select(text.norm_markup(F.col("m")), text.number_view(F.col("n")), text.plain_cell(F.col("c")), text.spelled_digits(F.col("k"), 3)).first()
    assert list(r) == ["uh a unknown c unk", "nine one two decimal five", "a c", "zero zero seven"]


def test_unknown_policies_differ(spark):
    d = spark.createDataFrame([("[UNK]",), ("<unk>",), ("[unknown]",), ("trunk",), ("IGNORE_TIME_SEGMENT_IN_SCORING",)], "t string")
    hits = {n: [r[0] for r in d.select(F.col("t").rlike(p)).collect()] for n, p in text.UNKNOWN_POLICIES.items()}
    assert hits == {
        "release": [True, False, False, False, False], "ablation": [True, True, False, False, False], "language_model": [True, False, True, False, False], "language_model_loose": [True, True, True, True, False], "preparation": [True, False, False, False, True],
    }


def test_grams(spark):
    d = spark.createDataFrame([([],), (["a"],), (["a", "b", "a", "b", "a"],)], "w array<string>")
    assert [r[0] for r in d.select(text.word_grams(F.col("w"), 4)).collect()] == [[], ["a"], ["a b a b", "b a b a"]]


def test_pearson_and_signals(spark):
    d = spark.createDataFrame([([1.0, 2.0, 4.0], [2.0, 1.0, 5.0]), ([1.0], [1.0]), ([1.0, 1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in d.select(stats.pearson(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(np.corrcoef([1, 2, 4], [2, 1, 5])[0, 1]) and got[1:] == [0.0, 0.0]
    rng = np.random.default_rng(0)
    x = rng.standard_normal(16000) * np.repeat(rng.uniform(0.1, 2, 100), 160)
    envelope, wave, seconds = stats.signal_likeness(x[800:], x[:14000])
    assert envelope > 0.93 and wave > 0.55 and seconds > 1.0
    assert stats.signal_likeness(x[:100], x) == (0.0, 0.0, 0.0)
    assert stats.signal_likeness(x, rng.standard_normal(16000))[1] < 0.3


def test_resample_is_repeatable(spark):
    units = spark.createDataFrame([("g", i + 1, float(i)) for i in range(20)], "g string, number int, v double")
    a = stats.resample(units, ["g"], ["v"], 50, 3).orderBy("draw").collect()
    b = stats.resample(units.repartition(7), ["g"], ["v"], 50, 3).orderBy("draw").collect()
    assert a == b and len(a) == 50 and abs(np.mean([r.v for r in a]) - 190) < 25


def test_shifted_correlations_against_plain_ones():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.standard_normal(rng.integers(1, 40)), rng.standard_normal(rng.integers(1, 40))
        shifts = np.arange(-50, 51)
        r, n = stats.shifted_correlations(a, b, shifts)
        for s, got, common in zip(shifts, r, n):
            x, y = (a[s:], b) if s >= 0 else (a, b[-s:])
            k = min(len(x), len(y))
            assert common == k and got == pytest.approx(np.corrcoef(x[:k], y[:k])[0, 1] if k > 1 else 0.0, abs=1e-6)


def test_multinomial_draws_are_those_of_single_units(spark):
    units = [(1.0, 2.0)] * 30 + [(0.0, 1.0)] * 60 + [(5.0, 3.0)] * 10
    kinds = spark.createDataFrame([("g", 1.0, 2.0, 30), ("g", 0.0, 1.0, 60), ("g", 5.0, 3.0, 10), ("h", 2.0, 1.0, 7)], "g string, a double, b double, n long")
    got = stats.multinomial_draws(kinds, "g", ["a", "b"], "n", 4000, 5)
    again = stats.multinomial_draws(kinds.repartition(3), "g", ["a", "b"], "n", 4000, 5, tasks=3)
    key = lambda r: (r.g, r.draw)
    rows = sorted(got.collect(), key=key)
    assert rows == sorted(again.collect(), key=key) and len(rows) == 8000
    assert {(r.a, r.b) for r in rows if r.g == "h"} == {(14.0, 7.0)}
    rng = np.random.default_rng(1)
    plain = np.array([np.array(units)[rng.integers(0, 100, 100)].sum(0) for _ in range(4000)])
    drawn = np.array([(r.a, r.b) for r in rows if r.g == "g"])
    for q in (0.025, 0.5, 0.975):
        assert np.abs(np.quantile(plain, q, axis=0) - np.quantile(drawn, q, axis=0)).max() <= 3
    assert np.abs(plain.mean(0) - drawn.mean(0)).max() < 1 and np.abs(plain.std(0) / drawn.std(0) - 1).max() < 0.06


def test_one_pass_words_are_the_tokens(spark):
    d = spark.createDataFrame([(t,) for t in [*SAMPLES, "", "  ", "a\tb\nc", "'", "it's 5,000 — ok_now", None]], "t string")
    t = F.col("t")
    for r in d.select(text.tokens(text.norm_score(t)).alias("s"), text.score_words(t).alias("s1"), text.tokens(text.norm_audit(t)).alias("a"), text.audit_words(t).alias("a1")).collect():
        assert r.s == r.s1 and r.a == r.a1


def test_paths_and_places(spark):
    cases = [("a b c".split(), "a x c d".split()), ([], ["q"]), (["q"], []), ([], []), (list("abcdefgh" * 9), list("abxdefgh" * 8))]
    assert edit.paths(cases) == [edit.path_of(a, b) for a, b in cases]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    for r in d.select("i", edit.align("a", "b").alias("o")).collect():
        assert [tuple(x) for x in r.o] == edit.alignment(*cases[r.i])


def test_names_and_paths(spark):
    d = spark.createDataFrame([("/a/./b/../c",), ("a//b/",), ("../x",), ("/",), ("",)], "p string")
    assert [r[0] for r in d.select(text.resolved(F.col("p"))).collect()] == ["/a/c", "a/b", "x", "/", ""]
    import hashlib

    assert d.select(text.hash_name(F.lit("id7"), ".wav")).first()[0] == hashlib.sha256(b"id7").hexdigest()[:20] + ".wav"


def test_resampling_and_normalising():
    t = np.arange(16000) / 16000
    x = np.sin(2 * np.pi * 440 * t)
    y = stats.resampled(x, 16000, 8000)
    assert len(y) == 8000 and np.abs(y[200:-200] - x[::2][200:-200]).max() < 0.01
    assert np.abs(stats.resampled(np.sin(2 * np.pi * 6000 * t), 16000, 8000)[200:-200]).max() < 0.05
    z = stats.normalised(np.column_stack([x + 0.5, x * 0]), 16000)
    assert abs(z.mean()) < 1e-9 and np.abs(z).max() == 1.0
    assert not stats.normalised(np.zeros((50, 1)), 8000).any() and not len(stats.normalised(np.zeros((0, 2)), 8000))


def test_radio_band():
    t = np.arange(32000) / 16000
    power = lambda f: np.sqrt(np.mean(stats.band_pass(np.sin(2 * np.pi * f * t), 16000)[8000:] ** 2)) * np.sqrt(2)
    assert power(1000) == pytest.approx(1, abs=0.01) and power(300) == pytest.approx(2**-0.5, abs=0.02) and power(3400) == pytest.approx(2**-0.5, abs=0.02)
    assert power(60) < 0.01 and power(7000) < 0.01
    x = 0.5 * np.sin(2 * np.pi * 1000 * t)
    heard, noisy = stats.band_pass(x, 16000), stats.radio(x, 16000, 4)
    assert np.sqrt(np.mean(heard**2) / np.mean((noisy - heard) ** 2)) == pytest.approx(10, rel=0.05)
    assert (noisy == stats.radio(x, 16000, 4)).all() and np.abs(noisy).max() <= 0.99


def test_pairs_of_all_lengths_together(monkeypatch):
    r = random.Random(9)
    for most in (1, 33, 64, 70):
        pairs = [([r.choice("abcd") for _ in range(r.randint(0, most))], [r.choice("abcd") for _ in range(r.randint(0, most))]) for _ in range(60)]
        for together in (2048, 7):
            monkeypatch.setattr(edit, "TOGETHER", together)
            assert edit.paths(pairs) == [edit.path_of(a, b) for a, b in pairs]
            assert edit._distances(*edit._listed(pairs)).tolist() == [distance(a, b) for a, b in pairs]


def test_words_are_counted_by_step(spark, monkeypatch):
    from collections import Counter

    pairs = random_pairs(200, 3) + [([], [])]
    want = Counter((op, b if op == "I" else a) for x, y in pairs for op, a, b in edit.alignment(x, y))
    d = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for most in (500_000, 1):
        monkeypatch.setattr(edit, "SUMMED", most)
        rows = edit.count_words(d, "a", "b").collect()
        assert {(r.op, r.word): r.n for r in rows} == want and len(rows) == len(want)


def test_utterances_are_scored_once(spark, sf):
    from lexmill.plans import scoring

    plan = scoring.wer_mask_fanout(spark, sf)._jdf.queryExecution().executedPlan().toString()
    steps = scoring.class_error_attribution(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan and plan.count("edit_distance") == 0
    assert "levenshtein" not in steps and "zip_with" not in steps and "MapInArrow" in steps
