"""Registered queries of the training-data operators and their SQL.

Each query applies one operator, with its production parameters, to its whole
table and derives the digest columns from the operator's own results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import media, mixing, pii, quality, secrets, sentencepiece_codec, sharding, simhash, toxicity, version_sketch
from docquarry.llm.common import documents, labels

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text through the SentencePiece codec and back."""
    return sentencepiece_codec.token_digests(documents(spark, sf_dir), tokenizer_model())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learnt from a bounded sample of the labels."""
    docs = documents(spark, sf_dir)
    return quality.score_documents(docs, quality.fit(docs, labels(spark, sf_dir)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source: weights 3, 1, 2 in turn, 150% of all words."""
    return mixing.mix_report(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked weak candidates in every whole text."""
    return secrets.scan_documents(documents(spark, sf_dir))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a WAVE payload, read back, sniffed and described."""
    return media.media_digests(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and disguised personal data in every whole text."""
    return pii.scan_documents(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, at most two bits apart."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and the next document."""
    return version_sketch.version_report(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards, and the owner with a seventeenth."""
    return sharding.assign_shards(documents(spark, sf_dir), [1.0] * 16)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every whole text, learnt from a bounded sample of the labels."""
    docs = documents(spark, sf_dir)
    model = toxicity.train(*toxicity.fit_rows(docs, labels(spark, sf_dir), "toxic", toxicity.LABEL_ROWS))
    return toxicity.score_documents(docs, model)


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op6_pii": op6_pii,
    "op7_simhash": op7_simhash,
    "op8_fingerprints": op8_fingerprints,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_secrets": op4_secrets,
    "op5_media_columns": op5_media_columns,
}

ORACLE_SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
