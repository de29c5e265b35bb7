"""Documents to training sequences: quality, near duplicates, secrets, mixture, packing.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns the columns of ``documents``; the last returns packed pieces.
Null and empty texts go through like others, repeated rows count each unless a
stage says otherwise, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.common import cut, table

#: What the mixture asks of the tokens of clean documents: enough above 1 that one with an unsure posterior still has a rate of 1.
CLEAN_GROWTH = 1.1


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose pairwise-ranking score reaches the threshold; a tie with it stays, null texts are scored as empty ones, repeated rows share their fate."""
    from lexmill.llm import quality

    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that shares 0.8 of its five-word shingles, link by link; texts without words stay, of repeated rows one does."""
    from lexmill.llm import jaccard

    return jaccard.one_of_each(docs, words=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked in every text; a null text stays null."""
    from lexmill.llm import secrets

    return secrets.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out as the fitted rates say, which are above 1 for clean ones; texts without words are rated by their posterior."""
    from lexmill.llm import mixing

    return mixing.resample(docs, table(spark, sf_dir, "labels"), growth=CLEAN_GROWTH)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places; every row is packed, an empty text as one end id."""
    import public_tokenizers

    from lexmill.llm import packing

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: The learned and hashed stages have no SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
