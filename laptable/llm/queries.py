"""Queries of the corpus operators over the given tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laptable.llm import alignment, counts, hard_negatives, lang, line_dedup, near_dup, packing, pieces, quality, quantised, secrets, sql, token_files, topk
from laptable.llm.common import read, shared_folder


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' ids written to coded files and read back: place, size and digest of each document."""
    files = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(read(spark, folder, "documents"), files)
    return token_files.read_tokens(spark, files)


def op2_lang(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document; a quarter of the ids is held out from learning."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = lang.train(docs, ~held_out)
    found = lang.identify(docs.withColumn("held_out", held_out), model, carry=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into windows of 4096 ids; a row per piece."""
    return packing.pack_documents(read(spark, folder, "documents")).drop("ids")


def _edits(docs: DataFrame) -> DataFrame:
    """Three edits of every document, taken from its own columns: a cut at a third, an insert at two thirds, an ending."""
    n = F.char_length("text")
    edit = lambda seq, start, stop, insert: F.struct(
        F.lit(seq).alias("seq"), start.cast("long").alias("start"), stop.cast("long").alias("stop"), insert.alias("insert")
    )
    third = F.floor(n / 3)
    ending = F.concat(F.lit("\n"), F.coalesce(F.col("source"), F.lit("")))
    made = F.array(
        edit(1, third, third + 17, F.lit("")), edit(2, 2 * third, 2 * third, F.concat(F.col("lang"), F.lit(" 42 "))), edit(3, n + 100, n + 100, ending)
    )
    return docs.select("doc_id", F.explode(made).alias("e")).select("doc_id", "e.*")


def op4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document before and after three edits of each."""
    docs = read(spark, folder, "documents")
    found = counts.count_after_edits(counts.build_trees(docs), _edits(docs))
    return found.select("doc_id", "n_tokens_before", "n_tokens", "n_edits", "chars_encoded", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: base spans counted and digested, all spans listed."""
    docs = read(spark, folder, "documents")
    ratios = secrets.train(secrets.corpus_samples(docs))
    found = secrets.find_secrets(docs.select("doc_id", "text"), ratios)
    count = lambda kind: F.size(secrets.of_kind(F.col("spans"), kind)).cast("long").alias(f"n_{kind}")
    base = secrets.span_text(secrets.of_kind(F.col("spans"), *secrets.BASE))
    digest = F.sha2(base.cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *[count(k) for k in secrets.BASE], digest, secrets.span_text(F.col("spans")).alias("spans"))


def op6_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates on two-word shingles: set size, component and whether a document stays."""
    found = near_dup.near_duplicates(read(spark, folder, "documents"), words=2, percent=80)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and verdict of every document."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "source")
    judged = quality.judge_documents(docs, keep_text=False)
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "host_poor")


def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest integer inner products of every vector whose id is divisible by 20, among all others."""
    found = topk.top_k(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64, limit=None)
    return found.select("query_id", "rank", "vec_id", "score")


def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded into pieces and decoded again."""
    docs = read(spark, folder, "documents")
    found = pieces.decode_pieces(pieces.encode_pieces(docs))
    text = F.col("text")
    return found.select("doc_id", "n_ids", "ids_crc32", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of forty words or more that earlier documents or sentences have: what goes, and a digest of what stays."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = line_dedup.drop_repeated_units(docs)
    span = lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))
    return found.select(
        "doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", span), ",").alias("removed"),
        F.char_length("text").cast("long").alias("kept_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op11_quantised(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates among vectors of one label (cosine 0.98 or more): links, component and whether a vector stays."""
    found = quantised.near_vectors(read(spark, folder, "embeddings"), cosine=0.98)
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return found.select("vec_id", "n_links", "component_id", kept.alias("kept"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens under two tokenizers: groups, links, and how often the linked ids are linked in the corpus."""
    return alignment.align_documents(read(spark, folder, "documents"))[0]


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every vector whose id is divisible by 100; a seventh of the labels is moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, folder, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, window=(30, 90, 100), scale=256)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_lang": op2_lang,
    "op3_packing": op3_packing,
    "op4_counts": op4_counts,
    "op5_secrets": op5_secrets,
    "op6_near_dup": op6_near_dup,
    "op7_quality": op7_quality,
    "op8_topk": op8_topk,
    "op9_pieces": op9_pieces,
    "op10_line_dedup": op10_line_dedup,
    "op11_quantised": op11_quantised,
    "op12_alignment": op12_alignment,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.ORACLES.items() if k in _QUERIES} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
