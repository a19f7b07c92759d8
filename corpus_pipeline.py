"""Documents to token ids: filter, deduplicate, redact, mix, encode.

Each stage takes all rows that its predecessor kept and returns the columns of
``documents``; the last returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import mixing, near_copies, pii, quality, sentencepiece_codec
from docquarry.llm.common import documents, ensure_checkpoint_dir, labels
from docquarry.llm.registry import tokenizer_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality the classifier accepts."""
    return quality.keep_good(docs, quality.fit(docs, labels(spark, sf_dir)))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word Jaccard similarity 0.8 or more."""
    return near_copies.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data, and their new lengths."""
    kind = docs.schema["n_chars"].dataType
    return pii.redact_documents(docs).withColumn("n_chars", F.length("text").cast(kind))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target proportions: a row for each whole copy or part taken."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): token ids with begin and end of each row's text."""
    coded = sentencepiece_codec.encode_documents(docs, tokenizer_model(), spans=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", deduplicate),
    ("pii", redact),
    ("mixing", mix),
    ("encoding", encode),
]

#: No stage can be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what a stage returns is kept before the next
    reads it, often more than once."""
    ensure_checkpoint_dir(spark)
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = docs.checkpoint()
    return docs
