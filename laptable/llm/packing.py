"""Packing by concatenation: all documents in a row, cut every ``length`` tokens.

First pass: every task encodes its documents once, writes their ids (two bytes each) with the running total inside its
partition, and partition totals are summed. A prefix sum over these totals (one row per partition, so bounded by the number
of partitions) gives each partition its global offset. Second pass: with the offsets known, every document is cut at the
fixed window edges without any shuffle; each piece is a boundary record (document, window, offset in it, ids).

Padding: only the last window can be short. :func:`sequences` fills it up to ``length`` unless it already ends at a power of
two.

Defined cases: a null text counts as empty and gives the end id alone; repeated rows and null ids are documents of their
own; long documents span as many windows as they need; an empty table gives no piece; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laptable.llm.common import cut_lineage, text_or_empty
from laptable.llm.tokens import Encoder, slices

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
LENGTH = 4096
ENCODED = "doc_id long, part int, before long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder, kept between tasks."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Stored ids of each document, its partition, and the partition's ids before it."""
    end = np.array([end_id], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(tokenizer), 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [x + end for x in enc.encode(part.column("text").to_pylist())]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                arrays = [part.column("doc_id"), part.column("part"), pa.array(start), pa.array(n), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "part", "before", "n_tokens", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.spark_partition_id().alias("part"), text_or_empty(text).alias("text"))
    return cut_lineage(rows.mapInArrow(encode, ENCODED))


def with_offsets(encoded: DataFrame) -> DataFrame:
    """``begin``: ids before each document in the whole row of documents."""
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return encoded.join(F.broadcast(base), "part").withColumn("begin", F.col("base") + F.col("before"))


def pieces(encoded: DataFrame, length: int = LENGTH) -> DataFrame:
    """Boundary records: every document cut at the window edges."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, begin, n, ids in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "begin", "n_tokens", "ids")], strict=True):
                at = 0
                while at < n:
                    window, offset = divmod(begin + at, length)
                    size = min(n - at, length - offset)
                    piece = ids[2 * at : 2 * (at + size)]
                    crc = zlib.crc32(np.frombuffer(piece, "<u2").astype("<u4").tobytes())
                    out.append((doc, at, size, crc, n, window, offset, piece))
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int64()] * 7 + [pa.binary()]
    return with_offsets(encoded).select("doc_id", "begin", "n_tokens", "ids").mapInArrow(cut, PIECES)


def sequences(cut: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """One row per window: its ids (padded but at a power of two) and the number of ids that are no padding.

    A window holds at most ``length`` pieces, so the groups are bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    rows = cut.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ids.alias("ids"))
    short = (F.col("n_tokens") < length) & (F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) != 0)
    filler = F.unhex(F.repeat(F.lit(np.array([pad_id], "<u2").tobytes().hex()), (F.lit(length) - F.col("n_tokens")).cast("int")))
    return rows.withColumn("ids", F.when(short, F.concat("ids", filler)).otherwise(F.col("ids")))


def pack_documents(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    return pieces(encode_documents(docs, tokenizer, end_id), length)
