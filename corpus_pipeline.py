"""From documents to packed sequences: language, exact copies, near copies, secrets, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import exact, language, near, packing, secrets
from riskloom.llm.queries import WORDS, read, vocabulary
from riskloom.session import settle

FRESH = uuid.uuid4().hex  # helper columns must not meet a document's own
ORACLE_SQL = None  # compression and signatures have no SQL form; tests compare with brute force


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin."""
    return language.accepted(docs, language.learn(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original, then the smallest id: one row each, chosen by its place in the stored table."""
    return exact.distinct(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies, by id and text; rows without an id stay."""
    gone = near.assigned(docs).where("doc_id <> class_id OR digest <> class_digest")
    gone = gone.select(F.col("doc_id").alias(f"id_{FRESH}"), F.col("digest").alias(f"digest_{FRESH}")).distinct()
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    same = (docs["doc_id"] == F.col(f"id_{FRESH}")) & (digest == F.col(f"digest_{FRESH}"))
    return docs.join(gone, same, "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced and n_chars renewed."""
    return secrets.redact(docs, length="n_chars" if "n_chars" in docs.columns else None)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids."""
    return packing.pack(docs, vocabulary(WORDS))


STAGES = [
    ("language", languages),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("secrets", without_secrets),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the folder's documents, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
