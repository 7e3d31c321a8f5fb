"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laptable.session import cut_lineage, shared_folder

#: A table of so many rows (of a few numbers each) may be sent to every executor; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000

#: Lengths are summed in blocks of so many.
BLOCK = 128

__all__ = ["BROADCAST_ROWS", "bounded_broadcast", "cut_lineage", "few_tasks", "let", "read", "shared_folder", "stored", "sum_before", "text_or_empty"]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sum_before(lengths: Column, i: Column) -> Column:
    """Sum of the first ``i`` lengths, by whole blocks and a rest, so that long arrays stay cheap."""
    add = lambda a, x: a + x
    zero = F.lit(0)
    blocks = F.transform(
        F.sequence(zero, F.floor(F.size(lengths) / BLOCK).cast("int")),
        lambda k: F.aggregate(F.slice(lengths, k * BLOCK + 1, BLOCK), zero, add),
    )
    whole = F.floor(i / BLOCK).cast("int")
    return let(blocks, lambda b: F.aggregate(F.slice(b, F.lit(1), whole), zero, add)) + F.aggregate(
        F.slice(lengths, whole * BLOCK + 1, i - whole * BLOCK), zero, add
    )


#: Narrow rows that one task reads.
TASK_ROWS = 200_000


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than its counted (or greatest possible) narrow rows are worth."""
    return df.coalesce(1 + rows // TASK_ROWS)


def stored(df: DataFrame) -> DataFrame:
    """Checkpointed narrow rows, counted, and read by as many tasks as they are worth."""
    kept = cut_lineage(df)
    return few_tasks(kept, kept.count())
