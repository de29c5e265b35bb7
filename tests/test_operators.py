import itertools
import json
import random
import tarfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.operators import curate, govern, overlap, select, splits
from lexmill.sources import readers, schema, sinks


def test_interval_union(spark):
    rows = [("a", 0, 10), ("a", 5, 15), ("a", 20, 30), ("b", 0, 10), ("b", 2, 4), ("b", 10, 12), ("c", 3, 3)]
    d = spark.createDataFrame(rows, "k string, start int, stop int")
    for width in (3600, 4, 7):
        assert {r.k: r.covered for r in curate.covered(d, ["k"], width=width).collect()} == {"a": 25, "b": 12, "c": 0}


def test_cascade_and_flags(spark):
    d = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (None, 1)], "a int, b int")
    rules = [("first", F.col("a") == 1), ("second", F.col("b") == 1)]
    rows = d.select(curate.first_reason(rules), curate.all_reasons(rules)).collect()
    assert [tuple(r) for r in rows] == [("first", ["first", "second"]), ("first", ["first"]), ("second", ["second"]), (None, []), ("second", ["second"])]


def test_clamp(spark):
    d = spark.createDataFrame([(1.10,), (1.20,), (0.9,), (1.15,)], "e double")
    moved, over = curate.clamp_end(F.col("e"), F.lit(1.0))
    assert [tuple(r) for r in d.select(moved, over).collect()] == [(1.0, True), (1.2, False), (0.9, False), (1.0, True)]


def test_first_seen(spark):
    d = spark.createDataFrame([("x", 3, "c"), ("x", 1, "a"), ("y", 2, "b")], "k string, o int, v string")
    assert sorted(tuple(r) for r in curate.first_seen(d, ["k"], ["o"]).collect()) == [("x", 1, "a"), ("y", 2, "b")]


def test_running_total_equals_one_window(spark):
    d = spark.range(500).withColumn("v", (F.col("id") * 7) % 13)
    got = {r.id: r.cum for r in curate.running_total(d, F.col("v"), F.sha2(F.col("id").cast("string"), 256)).collect()}
    rows = sorted((r.id for r in d.collect()), key=lambda i: __import__("hashlib").sha256(str(i).encode()).hexdigest())
    total = 0
    for i in rows:
        total += i * 7 % 13
        assert got[i] == total


def test_overlap_never_counts_nulls(spark):
    d = spark.createDataFrame([("a", None, "r"), ("b", None, "r"), ("c", "x", None)], "split string, sha string, record string")
    got = {(r.key, r.split_a, r.split_b): r.shared for r in overlap.pairwise_overlap(d, "split", ["sha", "record"]).collect()}
    assert len(got) == 6 and got["record", "a", "b"] == 1 and sum(got.values()) == 1


def test_gram_candidates_skip_large_pools_whole(spark):
    w = "array<string>"
    s = spark.createDataFrame([(1, list("abcd")), (2, list("abc"))], f"id int, words {w}")
    t = spark.createDataFrame([(i, list("abcd")) for i in range(6)] + [(9, list("abc"))], f"id int, words {w}")
    assert overlap.gram_candidates(s, t, 4, 500).count() == 6
    assert overlap.gram_candidates(s, t, 4, 5).count() == 0


def test_containment(spark):
    hay = spark.createDataFrame([(1, "xx" + "needle in the hay, long enough" + "yy"), (2, "needle in the hay, long enoug"), (3, "abc"), (4, "y" * 40 + "x" * 30)], "id int, text string")
    needles = spark.createDataFrame([(7, "needle in the hay, long enough"), (8, "ab"), (9, "y" + "x" * 25)], "id int, text string")
    assert sorted(tuple(r) for r in overlap.containment(hay, needles).collect()) == [(1, 7, 2), (4, 9, 39)]
    assert [tuple(r) for r in overlap.short_containment(hay, needles).collect()] == [(3, 8, 0)]


def test_bag_likeness(spark):
    d = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b"]), ([], []), (["a"], [])], "x array<string>, y array<string>")
    assert [r[0] for r in d.select(overlap.bag_likeness(F.col("x"), F.col("y"))).collect()] == [0.5, 1.0, 0.0]


def test_closest_keeps_small_pools(spark):
    d = spark.createDataFrame([(1, i, abs(i - 30)) for i in range(60)] + [(2, 5, 9)], "s int, t int, d int")
    got = overlap.closest(d, "s", F.col("d"), "t").groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {1: 25, 2: 1}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=7), st.integers(0, 120))
def test_nearest_subset(ticks, target):
    got = splits.nearest_subset(ticks, target)
    sums = [sum(c) for n in range(1, len(ticks) + 1) for c in itertools.combinations(ticks, n)]
    limit = target + max(ticks)
    assert abs(sum(ticks[i] for i in got) - target) == min(abs(s - target) for s in sums if s <= limit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=7), st.integers(0, 30))
def test_best_fit(lengths, capacity):
    got = splits.best_fit(lengths, capacity)
    best = max(s for n in range(len(lengths) + 1) for s in (sum(c) for c in itertools.combinations(lengths, n)) if s <= capacity)
    assert sum(lengths[i] for i in got) == best and len(set(got)) == len(got)


def test_best_fit_rejects_negative():
    with pytest.raises(ValueError):
        splits.best_fit([-1], 3)


def test_subset_never_takes_all(spark):
    d = spark.createDataFrame([("x", str(i), float(i + 1)) for i in range(6)] + [("y", "0", 4.0)], "airport string, day string, seconds double")
    rows = splits.subset_per_group(d, "airport", "day", "seconds", 0.99, 1).collect()
    assert len(rows) == 7 and not all(r.chosen for r in rows if r.airport == "x")


def test_development_never_empties_an_airport(spark):
    r = random.Random(4)
    rows = [(f"a{i % 5}", f"d{i}", float(r.randint(10, 90))) for i in range(40)] + [("solo", "d", 30.0)]
    d = spark.createDataFrame(rows, "airport string, recorded_date string, seconds double")
    dev = {(x.airport, x.recorded_date) for x in splits.development_sessions(d, 0.5, "s").collect()}
    for airport in {a for a, _, _ in rows} - {"solo"}:
        assert {x for x in dev if x[0] == airport} < {(a, x) for a, x, _ in rows if a == airport}


def test_guard_is_inclusive_and_ties_go_to_the_earliest(spark):
    d = spark.createDataFrame([(1, 0.5, 0.10), (2, 0.3, 0.12), (3, 0.3, 0.11), (4, 0.2, 0.13)], "step int, wer double, guard double")
    assert select.guarded_best(d, "wer", "guard", F.lit(0.12), "step").first().step == 2
    assert select.guarded_best(d, "wer", "guard", F.lit(0.01), "step").count() == 0


def test_expectations(spark):
    facts = spark.createDataFrame([(5, 7)], "a int, b int")
    govern.require(govern.expectations(facts, {"a": 5, "b": 7}))
    with pytest.raises(govern.ExpectationError, match="b: expected 8, found 7"):
        govern.require(govern.expectations(facts, {"a": 5, "b": 8}))


def test_digest_ignores_order_but_not_content(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    one = lambda x: x.agg(govern.digest(x, "i", "t")).first()[0]
    assert one(d) == one(d.orderBy(F.desc("i"))) != one(d.union(d))


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\n\n{"id": "2", "text": null}\n')
    kind = schema.StructType([f for f in schema.MANIFEST.fields if f.name in ("id", "text")])
    assert readers.checked_lines(spark, str(tmp_path), kind, ("id",)).count() == 2
    with pytest.raises(readers.ScanError, match="lacks text"):
        readers.checked_lines(spark, str(tmp_path), kind, ("id", "text"))
    (tmp_path / "b.jsonl").write_text("[1]\n")
    with pytest.raises(readers.ScanError, match="not a JSON object"):
        readers.checked_lines(spark, str(tmp_path), kind)


def test_other_scans(spark, tmp_path):
    (tmp_path / "sums.txt").write_text("ab  x/y.wav\ncd  z  w.wav\n")
    assert [tuple(r) for r in readers.checksums(spark, str(tmp_path / "sums.txt")).collect()] == [("ab", "x/y.wav"), ("cd", "z  w.wav")]
    (tmp_path / "list.txt").write_text(" a \n\nb\na\n")
    got = readers.unique_lines(spark, str(tmp_path / "list.txt")).orderBy("first").collect()
    assert [r.value for r in got] == ["a", "b"]
    (tmp_path / "t.csv").write_text("name,ok,n\nx,True,3\ny,False,\n")
    kind = schema._struct(name=schema.S, ok=schema.B, n=schema.L)
    assert [tuple(r) for r in readers.csv_rows(spark, str(tmp_path / "t.csv"), kind).collect()] == [("x", True, 3), ("y", False, None)]
    (tmp_path / "s.xml").write_text("<data><segment><speaker>A</speaker><text>hi</text><start>0.5</start><end>1</end><tags><non_english>1</non_english></tags></segment><segment><start>x</start></segment></data>")
    rows = readers.xml_segments(spark, str(tmp_path / "s.xml")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.speaker, r.text, r.start, r.correct_transcript, r.non_english) for r in rows] == [(1, "A", "hi", 0.5, "0", "1"), (2, "", "", None, "0", "0")]


def test_arms_and_rowids(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"label": str(i), "score": {"normalized_wer": i / 10}}))
    assert readers.arms(spark, str(tmp_path), schema.ARM, 2).count() == 2
    with pytest.raises(readers.ScanError):
        readers.arms(spark, str(tmp_path), schema.ARM, 3)
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    ids = [r.row_id for r in readers.parquet_with_ids(spark, str(tmp_path / "p")).collect()]
    assert len(set(ids)) == 5 and ids[0].endswith(":0")


def test_wav(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000), w.writeframes(bytes(range(200)) * 160)
    (tmp_path / "b.wav").write_bytes(b"junk")
    rows = readers.wav_files(spark, str(tmp_path)).orderBy("path")
    a, b = rows.collect()
    assert (a.rate, a.channels, a.frames, a.seconds) == (16000, 1, 16000, 1.0) and b.rate is None
    crop = rows.where("rate is not null").select(readers.pcm_crop(F.col("pcm"), F.lit(0.25), F.lit(0.1))).first()[0]
    assert bytes(crop) == bytes(a.pcm)[8000:11200]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(2, "b", "x"), (1, "a", "y")], "rank int, text string, split string")
    sinks.write_corpus(d, str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_corpus(d, str(tmp_path / "c"))
    sinks.write_splits(d, str(tmp_path / "s"), ["rank", "text"])
    assert spark.read.csv(str(tmp_path / "s"), header=True).columns == ["rank", "text", "split"]
    sinks.write_report({"b": 1, "a": 2}, str(tmp_path / "r.json"))
    assert list(json.loads((tmp_path / "r.json").read_text())) == ["a", "b"]
    (tmp_path / "f").mkdir(), (tmp_path / "f" / "z").write_text("1"), (tmp_path / "f" / "a").write_text("2")
    one = sinks.pack_folder(str(tmp_path / "f"), str(tmp_path / "1.tgz"))
    assert one == sinks.pack_folder(str(tmp_path / "f"), str(tmp_path / "2.tgz"))
    assert (tmp_path / "1.tgz").read_bytes() == (tmp_path / "2.tgz").read_bytes()
    assert tarfile.open(tmp_path / "1.tgz").getnames() == ["a", "z"]
    a, b = str(tmp_path / "f" / "a"), str(tmp_path / "f" / "z")
    assert sinks.copy_once(spark, a, str(tmp_path / "copy")) and not sinks.copy_once(spark, a, str(tmp_path / "copy"))
    with pytest.raises(sinks.SinkError):
        sinks.copy_once(spark, b, str(tmp_path / "copy"))


def test_streaming(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType, TimestampType

    from lexmill.streaming import ingest

    kind = StructType([StructField("ts", TimestampType()), *(StructField(c, StringType()) for c in ("id", "model", "text", "pred_text"))])
    source = tmp_path / "in"
    source.mkdir()
    row = lambda t, i, p: json.dumps({"ts": t, "id": i, "model": "m", "text": "a b c", "pred_text": p})
    (source / "1.json").write_text("\n".join([row("2024-01-01T00:01:00", "1", "a c"), row("2024-01-01T00:02:00", "1", "a c"), row("2024-01-01T00:03:00", "2", "a b c")]))
    rates = ingest.windowed_error_rate(ingest.read_predictions(spark, str(source), kind, 1))
    run = lambda: ingest.start(rates, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (source / "2.json").write_text(row("2024-01-01T05:00:00", "3", "x"))
    run()
    (source / "3.json").write_text(row("2024-01-01T09:00:00", "4", "x"))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window").collect()
    assert (got[0].utterances, got[0].errors, got[0].words) == (2, 1, 6)


def test_paired_fails_closed(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string")
    assert overlap.paired(a, a, "k", ["t"]).count() == 2
    with pytest.raises(Exception, match="unpaired key 2"):
        overlap.paired(a, a.where("k = 1"), "k", ["t"]).collect()
    with pytest.raises(Exception, match="rows differ for key 1"):
        overlap.paired(a, a.withColumn("t", F.lit("y")), "k", ["t"]).collect()


def test_aligned_containment(spark):
    hay = spark.createDataFrame([(1, bytearray(b"\x01" + bytes(range(1, 40)))), (2, bytearray(b"\x00\x00" + bytes(range(1, 40)))), (3, bytearray(100))], "id int, data binary")
    needle = spark.createDataFrame([(7, bytearray(range(1, 25))), (8, bytearray(20)), (9, bytearray(b"ab"))], "id int, data binary")
    assert [tuple(r) for r in overlap.aligned_containment(hay, needle).collect()] == [(2, 7, 1)]


def test_any_containment_against_brute_force(spark):
    r = random.Random(8)
    hays = [(i, "".join(r.choices("ab \n", k=r.randint(0, 60)))) for i in range(25)] + [(90, None), (91, "")]
    sought = [(i, "".join(r.choices("ab \n", k=k))) for i, k in enumerate([1, 1, 2, 2, 3, 4, 5, 6, 7, 11, 12, 13, 23, 24])] + [(i + 40, t[3:]) for i, t in hays[:12]] + [(80, ""), (81, None), (82, "never there")]
    a, b = (spark.createDataFrame(x, "id int, text string") for x in (hays, sought))
    want = {(i, j, h.index(n)) for i, h in hays for j, n in sought if h and n and n in h}
    got = [tuple(x) for x in overlap.any_containment(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert overlap.any_containment(a, b.where("id = 80")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=6), st.integers(0, 40))
def test_ties_between_subsets(ticks, target):
    got = splits.nearest_subset(ticks, target, tie=lambda places: [-i for i in places])
    plain = splits.nearest_subset(ticks, target)
    away = lambda places: abs(sum(ticks[i] for i in places) - target)
    assert away(got) == away(plain) and sum(ticks[i] for i in plain) <= sum(ticks[i] for i in got)


def test_gram_candidates_against_brute_force(spark):
    r = random.Random(6)
    make = lambda n: [(i, [r.choice("abc") for _ in range(r.randint(0, 9))]) for i in range(n)]
    s, t = make(40), make(30)
    grams = lambda w, n=2: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    frames = [spark.createDataFrame(x, "id int, words array<string>") for x in (s, t)]
    for most in (500, 24, 12):
        want = {}
        for i, w in s:
            met = {j: len(grams(w) & grams(v)) for j, v in t if len(w) >= 2 and grams(w) & grams(v)}
            want |= {(i, j): n for j, n in met.items()} if len(met) <= most else {}
        got = {(x.source_id, x.target_id): x.shared for x in overlap.gram_candidates(*frames, 2, most).collect()}
        assert got == want


def test_audio_segment(spark, tmp_path):
    import wave

    import numpy as np

    x = (np.sin(np.arange(32000) / 9) * 9000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(16000), w.writeframes(np.column_stack([x, x]).tobytes())
    (tmp_path / "b.wav").write_bytes(b"junk")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    got = {r.name: r for r in files.select("name", readers.audio_segment("content", F.lit(0.5), F.lit(1.0)).alias("s"), readers.audio_segment("content", F.lit(1.75), F.lit(0.0)).alias("rest")).collect()}
    assert got["b.wav"].s is None and len(got["a.wav"].s) == 8000 and len(got["a.wav"].rest) == 2000
    assert max(map(abs, got["a.wav"].s)) == 1.0 and abs(sum(got["a.wav"].s)) < 1e-6
