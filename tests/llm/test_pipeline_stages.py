"""Each stage on its own input: empty tables, nulls, repeats, masked secrets, one of each group, clean documents kept."""

import corpus_pipeline
from pyspark.sql import functions as F

STAGE = dict(corpus_pipeline.STAGES)


def documents(spark, sf, rows):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    return spark.createDataFrame([(i, t, "en", "made", None if t is None else len(t)) for i, t in rows], schema)


def test_stages_on_an_empty_table(spark, sf):
    empty = documents(spark, sf, [])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, sf)
        assert out.columns == empty.columns and out.count() == 0, name
    assert STAGE["packing"](spark, empty, sf).count() == 0


def test_stages_mask_and_keep_one_of_each(spark, sf):
    text = " ".join(f"w{i % 97} v{i * 7 % 31}" for i in range(200))
    secret = "the api_key = 9b0b3c6a43eb78aa99cbd7049c572391524f37a8 is here"
    rows = [(5, text), (3, text + " end"), (8, text), (9, None), (10, ""), (11, secret), (11, secret)]
    d = documents(spark, sf, rows)
    kept = STAGE["near_duplicates"](spark, d, sf).collect()
    assert sorted(r.doc_id for r in kept) == [3, 9, 10, 11]
    masked = {r.doc_id: r.text for r in STAGE["secrets"](spark, d, sf).collect()}
    assert masked[9] is None and masked[10] == "" and masked[5] == text
    assert "9b0b3c6a" not in masked[11] and masked[11].endswith(" is here")


def test_mixture_keeps_clean_documents(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    clean = labels.where("quality = 1 and toxic = 0")
    d = spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["doc_id"])
    mine = d.join(clean, "doc_id", "left_semi").count()
    out = STAGE["mixing"](spark, d, sf)
    assert mine and out.join(clean, "doc_id", "left_semi").select("doc_id").distinct().count() == mine
    bad = labels.where("quality = 0 or toxic = 1")
    assert out.join(bad, "doc_id", "left_semi").count() < 0.3 * d.join(bad, "doc_id", "left_semi").count()
