"""A training-data pipeline of five operators, each stage written as Parquet and read again by the next.

Quality rules, near duplicates, repeated passages, secrets, packing. Every stage but the last returns the columns of documents;
a stage that changes texts sets ``n_chars`` to their new length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laptable.llm import line_dedup, near_dup, packing, quality, secrets
from laptable.llm.common import read, shared_folder


def _carried(docs: DataFrame) -> DataFrame:
    """Id and text, with the whole row beside them, so that no other column can clash with a computed one."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")


def _restored(changed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows as they came but for the text and its length."""
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return changed.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and their hosts' verdicts."""
    return quality.keep_good_documents(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return near_dup.drop_near_duplicates(docs, words=5, percent=80)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents have."""
    return _restored(line_dedup.drop_repeated_units(_carried(docs)), docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    ratios = secrets.train(secrets.corpus_samples(docs))
    return _restored(secrets.redact(secrets.find_secrets(_carried(docs), ratios)), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids."""
    return packing.pack_documents(docs).withColumn("ids", F.hex("ids"))


STAGES = [
    ("quality_rules", good_documents),
    ("near_dedup", distinct_documents),
    ("line_dedup", distinct_lines),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Signatures, Markov models and tokenizers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored in the shared folder of the cluster."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
