"""The operators over the shared tables: one query each, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of high quality. Background: all documents."""
    from lexmill.llm.lmscore import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: fixed patterns and incompressible strings near sensitive words; null and empty texts have none."""
    from lexmill.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"), "doc_id")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, in ring order of the ids; texts without words have empty ones."""
    from lexmill.llm.fingerprints import fingerprint_all

    return fingerprint_all(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every fiftieth id; unusable vectors take no part."""
    from lexmill.llm.neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of texts that share 0.85 of their four-word shingles; texts without words are alone."""
    from lexmill.llm.jaccard import link_classes

    return link_classes(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rates and copies of every document; empty texts have no tokens."""
    from lexmill.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text; null and empty texts have none."""
    from lexmill.llm.pii import detect

    return detect(table(spark, sf_dir, "documents"), "doc_id")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null and empty pages have none."""
    from lexmill.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"), "page_id", "url")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2,048 tokens; an empty text is one end id."""
    import public_tokenizers

    from lexmill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text, learnt outside the held-out fold; empty texts are scored too."""
    from lexmill.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}


#: Shingles as strings, all pairs that share one, and labels passed along links until nothing changes.
JACCARD_SQL = """WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.least AS component_id FROM sets s JOIN (SELECT a, min(b) AS least FROM reached GROUP BY a) r ON r.a = s.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": JACCARD_SQL}
