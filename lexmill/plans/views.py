"""Views over the shared tables: the shapes that the operators take, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name in TEXTS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of whole texts, whose rows cost much more to work on than to move.
TEXTS = ("documents", "pages")


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt to all cores where their files have fewer splits than that (a row group is one task); as they are otherwise."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterance manifest: one row per document."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        "text",
        (F.col("n_chars") / 15.0).alias("duration"),
        F.col("lang").alias("airport"),
        "source",
        F.date_add(F.lit("2020-10-01").cast("date"), (F.col("doc_id") % 15).cast("int")).alias("recorded_date"),
        F.concat_ws("/", "source", (F.col("doc_id") % 7).cast("string")).alias("source_record_id"),
        ((F.col("doc_id") % 20) * 0.5).alias("offset"),
    )


MANIFEST = """manifest AS (SELECT doc_id AS id, text, n_chars / 15.0::DOUBLE AS duration, lang AS airport, source,
  DATE '2020-10-01' + CAST(doc_id % 15 AS INTEGER) AS recorded_date, source || '/' || CAST(doc_id % 7 AS VARCHAR) AS source_record_id,
  (doc_id % 20) * 0.5::DOUBLE AS "offset" FROM documents)"""

FOLD = "regexp_replace(strip_accents(lower(text)), '\\p{M}', '', 'g')"
NORM_SCORE = f"trim(regexp_replace(regexp_replace({FOLD}, '[^\\p{{L}}\\p{{N}}'' ]', ' ', 'g'), '\\s+', ' ', 'g'))"
NORM_AUDIT = f"trim(regexp_replace(regexp_replace(replace({FOLD}, 'ß', 'ss'), '[\\p{{P}}\\p{{S}}]', ' ', 'g'), '\\s+', ' ', 'g'))"


def words_sql(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda w: w <> '')"


#: Words of an utterance: a document is a recording of consecutive utterances, which together hold all its words.
WORDS = 30


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored utterances: all words of each document, and a hypothesis with every seventh word lost and some others wrong."""
    d = table(spark, sf_dir, "documents")
    ref = T.score_words(F.col("text"))
    rows = d.select(F.col("doc_id").alias("id"), "lang", "source", ref.alias("ref"))
    hyp = F.filter(F.transform("ref", lambda w, i: F.when(i % 7 == 3, F.lit(None)).when(i % 11 == 5, F.lit("zzz")).otherwise(w)), lambda w: w.isNotNull())
    return rows.withColumn("hyp", hyp)


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predictions`` at the grain of utterances: (id, part, lang, source, ref, hyp).

    Part ``k`` has the words from ``k * WORDS`` on, with their share of the
    hypothesis; a document without words has one empty utterance. Distances
    then cost in proportion to the corpus, whatever the length of a text.
    """
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("id"), "lang", "source", T.score_words(F.col("text")).alias("w"))
    rows = rows.select("id", "lang", "source", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("w") - 1) / WORDS).cast("int")))).alias("part"))
    rows = rows.select("id", "part", "lang", "source", F.slice("w", F.col("part") * WORDS + 1, F.lit(WORDS)).alias("ref"))
    place = F.col("part") * WORDS
    hyp = F.filter(F.transform("ref", lambda w, i: F.when((place + i) % 7 == 3, F.lit(None)).when((place + i) % 11 == 5, F.lit("zzz")).otherwise(w)), lambda w: w.isNotNull())
    return rows.withColumn("hyp", hyp)


PREDICTIONS = f"""all_words AS (SELECT doc_id AS id, lang, source, {words_sql(NORM_SCORE)} AS w FROM documents),
parted AS (SELECT *, unnest(range(0, 1 + greatest(0, len(w) - 1) // {WORDS})) AS part FROM all_words),
first_words AS (SELECT id, part, lang, source, w[part * {WORDS} + 1 : part * {WORDS} + {WORDS}] AS ref FROM parted),
predictions AS (SELECT id, part, lang, source, ref, list_transform(list_filter(list_transform(ref, lambda w, i: struct_pack(w := w, i := part * {WORDS} + i - 1)), lambda s: s.i % 7 <> 3),
  lambda s: CASE WHEN s.i % 11 = 5 THEN 'zzz' ELSE s.w END) AS hyp FROM first_words),
coded AS (SELECT *, list_distinct(list_concat(ref, hyp)) AS known FROM predictions),
scored AS (SELECT id, part, lang, source, ref, hyp, len(ref)::BIGINT AS words,
  levenshtein(coalesce(array_to_string(list_transform(ref, lambda w: chr((32 + list_position(known, w))::INTEGER)), ''), ''),
              coalesce(array_to_string(list_transform(hyp, lambda w: chr((32 + list_position(known, w))::INTEGER)), ''), ''))::BIGINT AS errors FROM coded)"""


def with_errors(rows: DataFrame) -> DataFrame:
    from lexmill.functions.edit import edit_distance

    return rows.withColumn("errors", edit_distance(F.col("ref"), F.col("hyp"))).withColumn("words", F.size("ref").cast("long"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, aligned as a whole."""
    return with_errors(predictions(spark, sf_dir))


def scored_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per utterance."""
    return with_errors(utterances(spark, sf_dir))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusion masks, long: (mask, id)."""
    labels = table(spark, sf_dir, "labels")
    each = F.array(F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "toxic"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "either"))
    return labels.select(F.col("doc_id").alias("id"), F.explode(F.filter(each, lambda m: m.isNotNull())).alias("mask"))


MASKS = """masks AS (SELECT doc_id AS id, 'low_quality' AS mask FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1
  UNION ALL SELECT doc_id, 'either' FROM labels WHERE quality = 0 OR toxic = 1)"""


def split_of(id_column, parts: int = 10):
    """train, development or test by the id's digest; the split of a recording is that of its first digits."""
    n = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("split"), id_column.cast("string")), 256), 1, 8), 16, 10).cast("long") % parts
    return F.when(n < 7, "train").when(n < 8, "development").otherwise("test")


def hash_sql(*parts: str) -> str:
    joined = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(sha256({joined}), 1, 8)) AS BIGINT)"


SPLIT = f"CASE WHEN {hash_sql(chr(39) + 'split' + chr(39), 'source_record_id')} % 10 < 7 THEN 'train' WHEN {hash_sql(chr(39) + 'split' + chr(39), 'source_record_id')} % 10 < 8 THEN 'development' ELSE 'test' END"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched stretches of a conversation: overlapping [start, end) seconds."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + F.length("text") % 25).alias("stop"))


INTERVALS = "intervals AS (SELECT conv_id, turn, turn * 10 AS start, turn * 10 + length(text) % 25 AS stop FROM conversations)"
