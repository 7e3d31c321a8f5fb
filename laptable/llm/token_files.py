"""Token ids of a corpus in files of coded blocks, written in ascending order of document ids and read back.

Documents are range-partitioned and sorted by id; every partition becomes a row of blocks of ``codec.BLOCK`` ids (the last one
shorter), each coded by itself with a checksum. A file is a Parquet file whose rows are blocks: partition, block number,
number of ids, how many of them continue a document and where in the partition that one begins, the ids and sizes of the
documents that begin in the block, and the coded bytes. A block can be read without any
other; the place of a document follows from its block and the totals of the partitions before, a prefix sum over one row per
partition.

Defined cases: a null text counts as empty and gives the end id alone; rows without an id come first; rows that repeat are
documents of their own, one after the other; long documents span blocks; an empty table gives no file row and no document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laptable.llm.codec import BLOCK, TOGETHER, decode_blocks, encode_blocks
from laptable.llm.common import text_or_empty
from laptable.llm.packing import encoder
from laptable.llm.tokens import slices

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
FILES = "part int, block long, n_ids long, lead long, lead_from long, doc_ids array<long>, doc_sizes array<long>, code binary"
READ = "part int, begin long, doc_id long, n_tokens long, piece long, crc long, ids binary"


def _parse(ddl: str) -> tuple[list[str], list[pa.DataType]]:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split(" ", 1) for x in ddl.split(", ")]
    return [f[0] for f in fields], [types[f[1]] for f in fields]


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, types = _parse(ddl)
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def coded_blocks(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of the files."""
    end = np.array([end_id], "<u2").tobytes()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, total, last_begin = 0, 0, 0, None
        pending, held = [], 0
        begun: dict[int, list[tuple]] = {}

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pending, held, number, last_begin
            ids = np.frombuffer(b"".join(pending), "<u2").astype(np.int64)
            cut = len(ids) if last else len(ids) // BLOCK * BLOCK
            blocks = [ids[i : min(i + BLOCK, cut)] for i in range(0, cut, BLOCK)]
            rows = []
            for block, coded in zip(blocks, encode_blocks(blocks), strict=True):
                own = begun.pop(number, [])
                lead = own[0][0] - number * BLOCK if own else len(block)
                rows.append((part, number, len(block), lead, last_begin if lead else None, [x[1] for x in own], [x[2] for x in own], coded))
                number, last_begin = number + 1, own[-1][0] if own else last_begin
            pending, held = [ids[cut:].astype("<u2").tobytes()], len(ids) - cut
            if rows:
                yield _batch(rows, FILES)

        for batch in batches:
            for some in slices(batch, "text"):
                part = some.column("part")[0].as_py()
                coded = [x + end for x in encoder(tokenizer).encode(some.column("text").to_pylist())]
                for doc, ids in zip(some.column("doc_id").to_pylist(), coded, strict=True):
                    begun.setdefault(total // BLOCK, []).append((total, doc, len(ids) // 2))
                    total += len(ids) // 2
                pending.extend(coded)
                held += sum(map(len, coded)) // 2
                if held >= TOGETHER * BLOCK:
                    yield from flush(False)
        yield from flush(True)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.select("doc_id", F.spark_partition_id().alias("part"), "text").mapInArrow(code, FILES)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    coded_blocks(docs, tokenizer, end_id).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    files = spark.read.schema(FILES).parquet(folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(k, TOGETHER)
                fields = [some.column(c).to_pylist() for c in ("part", "block", "lead", "lead_from", "doc_ids", "doc_sizes")]
                rows = []
                for part, block, lead, lead_from, doc_ids, sizes, ids in zip(*fields, decode_blocks(some.column("code").to_pylist()), strict=True):
                    raw, at = ids.astype("<u4").tobytes(), block * BLOCK
                    if lead:
                        rows.append((part, lead_from, None, None, at, None, raw[: 4 * lead]))
                    place = lead
                    for doc, size in zip(doc_ids, sizes, strict=True):
                        own, whole = raw[4 * place : 4 * (place + size)], place + size <= len(ids)
                        rows.append((part, at + place, doc, size, at + place, zlib.crc32(own) if whole else None, None if whole else own))
                        place += size
                yield _batch(rows, READ)

    totals = files.groupBy("part").agg(F.sum("n_ids").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    piece = F.when(F.col("ids").isNotNull(), F.struct("piece", "ids"))
    parts = F.array_sort(F.collect_list(piece)).alias("pieces")
    docs = files.select("part", "block", "lead", "lead_from", "doc_ids", "doc_sizes", "code").mapInArrow(decode, READ).groupBy("part", "begin")
    docs = docs.agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("crc").alias("crc"), parts)
    whole = F.aggregate("pieces", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    docs = docs.join(F.broadcast(base), "part")
    crc = F.coalesce("crc", F.crc32(whole)).alias("ids_crc32")
    return docs.select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", crc)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """``part, block, ids``: the ids of every block as an array, for readers that want no documents."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(k, TOGETHER)
                ids = pa.array([x.astype(np.int32) for x in decode_blocks(some.column("code").to_pylist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column("part"), some.column("block"), ids], names=["part", "block", "ids"])

    files = spark.read.schema(FILES).parquet(folder)
    return files.select("part", "block", "code").mapInArrow(decode, "part int, block long, ids array<int>")
