"""Hard negatives by a vertical scan: columns of vectors are read one after the other until bounds leave only the wanted rows.

Vectors become whole numbers (``floor(scale * x)``). Rows are dealt in order of label and a hash of the id into blocks of
bounded size, stored column by column with the smallest and the largest value of each column. An anchor reads a block's
columns in descending size of its own components. What the columns not yet read can still add lies between sums of
smallest and largest contributions, so after each few columns a bitmap keeps only rows that may still be wanted:

- a row whose score cannot reach a window, or must lie beyond it, is gone from that window;
- where enough rows surely lie in a window, rows that cannot reach the k-th lower bound among these are gone too.

A row stays while one window keeps it; after the last column the scores of the remaining rows are exact.

1. Positives: every block of anchors meets the blocks that hold one of its labels (one window without ends).
2. Negatives: every block of anchors, with the windows that follow from the positives' scores, meets all blocks (a stated query
   set against all rows, in blocks); rows of the anchor's own label are not in the bitmap.

Which blocks meet is a join of block numbers, salted so that a label of a third of all rows is many keys. Blocks travel to
(data block, piece of the anchor blocks), the data block once and the anchors' blocks behind it, so one block at a time is
held. At most k rows an anchor, window and block come out; they are ranked by anchor and window.

Work grows with anchors times rows, less what bounds rule out.

Defined cases: rows with a null id or label, null or empty vectors and vectors with null or non-finite components (also after
scaling) take no part; vectors of different lengths never meet; every row with the anchor's id is the anchor's own; equal
scores go to the smaller id; rows that repeat are partners each, an anchor row that repeats is one anchor; scores of any size
are exact (beyond 2**52 by Python's integers), a result that needs more than 64 bits ends the job with an error; an empty table
gives no row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laptable.llm.common import cut_lineage

#: Bytes of a data block, and rows of a block of anchors (fewer where vectors are long).
DATA_BYTES, ANCHORS = 1 << 22, 256
#: Columns read between two looks at the bounds.
STEP = 8
#: Salts of the block numbers that are joined, and blocks of anchors that meet a data block in one piece.
SALTS, PIECE = 32, 64
EXACT = float(2**52)
BLOCK = "dim int, rows int, labels array<string>, codes binary, ids binary, columns binary"
FOUND = "block long, place int, window long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, scale: int, vec_id: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, dim, v``: valid rows, ``v`` not yet rounded down."""
    x = F.transform(F.col(vector), lambda c: c.cast("double") * scale)
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), x.alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & sound).withColumn("dim", F.size("v"))


def _blocks(rows: DataFrame, most_bytes: int, most_rows: int) -> DataFrame:
    """Stored blocks of rows of one dimension, in order of label, with their number."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def cut(table: pa.Table) -> pa.RecordBatch:
            dim = table.column("dim")[0].as_py()
            labels = table.column("label").combine_chunks().dictionary_encode()
            matrix = np.floor(np.asarray(table.column("v").combine_chunks().flatten(), np.float64)).reshape(-1, dim)
            cells = [dim, len(matrix), labels.dictionary.to_pylist(), np.asarray(labels.indices).astype("<i4").tobytes()]
            cells += [np.asarray(table.column("vec_id")).astype("<i8").tobytes(), np.ascontiguousarray(matrix.T).astype("<f8").tobytes()]
            types = [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
            names = [x.split(" ")[0] for x in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=names)

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.concat_tables(held)
            dims = np.asarray(table.column("dim"))
            held, start = [], 0
            for stop in [*(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]:
                size = max(1, min(most_rows, most_bytes // (8 * int(dims[start]))))
                while stop - start >= size or start < stop and (last or stop < len(dims)):
                    yield cut(table.slice(start, min(size, stop - start)))
                    start += min(size, stop - start)
            if start < len(dims):
                held = [table.slice(start)]

        waiting = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            waiting += batch.num_rows
            if waiting >= most_rows or sum(x.nbytes for x in held) >= most_bytes:
                yield from full(False)
                waiting = sum(x.num_rows for x in held)
        if held:
            yield from full(True)

    spread = rows.withColumn("_salt", F.xxhash64("vec_id", "v"))
    ordered = spread.repartitionByRange("dim", "label", "_salt").sortWithinPartitions("dim", "label", "_salt")
    return cut_lineage(ordered.select("vec_id", "label", "dim", "v").mapInArrow(build, BLOCK)).withColumn("block", F.monotonically_increasing_id())


def _met(anchors: DataFrame, data: DataFrame, by_label: bool) -> DataFrame:
    """Numbers of blocks that meet: ``block`` (of anchors) and ``data_block``."""
    of = lambda blocks: blocks.select("dim", "block", *([F.explode(F.array_distinct("labels")).alias("label")] if by_label else []))
    left = of(anchors).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = of(data).withColumnRenamed("block", "data_block").withColumn("salt", F.pmod(F.xxhash64("data_block"), F.lit(SALTS)).cast("int"))
    met = left.join(right, ["dim", "salt", *(["label"] if by_label else [])]).select("block", "data_block")
    return met.distinct() if by_label else met


class Block:
    """A block as arrays; columns are rows of the matrix."""

    def __init__(self, row: dict):
        self.labels, self.codes = row["labels"], np.frombuffer(row["codes"], "<i4")
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.columns = np.frombuffer(row["columns"], "<f8").reshape(row["dim"], -1)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)
        self.largest = max(float(np.abs(self.low).max()), float(np.abs(self.high).max()))

    def of_label(self, label: str) -> np.ndarray:
        return self.codes == self.labels.index(label) if label in self.labels else np.zeros(len(self.ids), bool)


def _exact(q: np.ndarray, columns: np.ndarray) -> list[int]:
    """Inner products of any size, in Python's integers."""
    own = [int(x) for x in q]
    return [sum(a * int(b) for a, b in zip(own, row, strict=True)) for row in columns.T.tolist()]


def scan(q: np.ndarray, block: Block, allowed: np.ndarray, windows: list[tuple[float, float]], k: int) -> tuple[np.ndarray, np.ndarray | list[int]]:
    """Places and exact scores of the rows of ``allowed`` that may be among the first ``k`` of a window (low, high)."""
    if len(q) * max(float(np.abs(q).max()), 1.0) * max(block.largest, 1.0) >= EXACT:
        at = np.flatnonzero(allowed)
        return at, _exact(q, block.columns[:, at])
    order = np.argsort(-np.abs(q), kind="stable")
    one, two = q[order] * block.low[order], q[order] * block.high[order]
    least = np.append(np.cumsum(np.minimum(one, two)[::-1])[::-1], 0.0)
    most = np.append(np.cumsum(np.maximum(one, two)[::-1])[::-1], 0.0)
    at, score = np.flatnonzero(allowed), np.zeros(int(allowed.sum()))
    for i in range(0, len(q) + 1, STEP):
        below, above = least[i], most[i]
        alive = np.zeros(len(at), bool)
        for low, high in windows:
            bound = low - above
            sure = score[(score >= low - below) & (score <= high - above)]
            if len(sure) >= k:
                bound = max(bound, np.partition(sure, len(sure) - k)[len(sure) - k] + below - above)
            alive |= (score >= bound) & (score <= high - below)
        if not alive.all():
            at, score = at[alive], score[alive]
        if not len(at) or i >= len(q):
            break
        some = order[i : i + STEP]
        read = block.columns[some] if len(at) == block.columns.shape[1] else block.columns[np.ix_(some, at)]
        score = score + q[some] @ read
    else:
        i = len(q) // STEP * STEP
    return at, score


def best_of(ids: np.ndarray, scores: np.ndarray | list[int], low: float, high: float, k: int) -> list[tuple[int, int]]:
    """The first ``k`` (id, score) within a window: higher scores first, smaller ids on ties."""
    if isinstance(scores, list):
        inside = sorted((-s, i) for i, s in zip(ids.tolist(), scores, strict=True) if low <= s <= high)[:k]
        if any(abs(s) >= 1 << 63 for s, _ in inside):
            raise OverflowError("A score among the results needs more than 64 bits")
        return [(i, -s) for s, i in inside]
    at = np.flatnonzero((scores >= low) & (scores <= high))
    if len(at) > 4 * k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    at = at[np.lexsort((ids[at], -scores[at]))][:k]
    return [(int(ids[a]), int(scores[a])) for a in at]


def _meet(anchors: DataFrame, data: DataFrame, met: DataFrame, pieces: int, k: int, same_label: bool, window: tuple[int, int, int]) -> DataFrame:
    """``FOUND``: for each anchor (block and place) and window the first ``k`` rows of each data block that its block meets.

    ``anchors`` has ``wanted``: (place, positive score) of the windows, or null for one window without ends (number 0).
    """
    low, high, of = window

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = None, None
        for row in (x for b in batches for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
            if row["block"] is None:
                block, number = Block(row), row["data_block"]
                continue
            assert number == row["data_block"]
            own, out = Block(row), []
            wanted: dict[int, list[int]] = {}
            for x in row["wanted"] or [{"place": i, "score": None} for i in range(len(own.ids))]:
                wanted.setdefault(x["place"], []).append(x["score"])
            for place, scores in wanted.items():
                allowed = block.of_label(own.labels[own.codes[place]])
                allowed = allowed & (block.ids != own.ids[place]) if same_label else ~allowed & (block.ids != own.ids[place])
                ends = [(-np.inf, np.inf) if s is None else (-(-low * s // of), high * s // of) for s in scores]
                open_ = [(a, b) for a, b in ends if a <= b]
                if not open_ or not allowed.any():
                    continue
                at, found = scan(own.columns[:, place], block, allowed, open_, k)
                for s, (a, b) in zip(scores, ends, strict=True):
                    out.extend((row["block"], place, s or 0, *x) for x in best_of(block.ids[at], found, a, b, k))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split(" ")[0] for x in FOUND.split(", ")])

    content = ["dim", "labels", "codes", "ids", "columns"]
    piece = F.pmod(F.xxhash64("block"), F.lit(pieces)).cast("int").alias("piece")
    behind = met.join(anchors, "block").select("data_block", piece, "block", *content, "wanted")
    used = met.select("data_block", piece).distinct()
    nothing = [F.lit(None).cast("long").alias("block"), *content, F.lit(None).cast("array<struct<place:int,score:long>>").alias("wanted")]
    front = used.join(data.withColumnRenamed("block", "data_block"), "data_block").select("data_block", "piece", *nothing)
    dealt = front.unionByName(behind).repartition("data_block", "piece").sortWithinPartitions("data_block", "piece", F.col("block").asc_nulls_first())
    return dealt.mapInArrow(search, FOUND)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int, int] = (30, 90, 100), scale: int = 256,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For every anchor (rows with ``is_anchor``, an expression of ``vec_id``) and each of its best ``positives`` of the same
    label: the first ``negatives`` rows of other labels whose score lies between low/of and high/of of the positive's score.
    """
    rows = whole_numbers(vectors, scale, vec_id, vector, label)
    data = _blocks(rows, DATA_BYTES, 1 << 20)
    asked = _blocks(rows.where(is_anchor).dropDuplicates(), DATA_BYTES // 8, ANCHORS)
    pieces = max(1, -(-asked.count() // PIECE))
    none = F.lit(None).cast("array<struct<place:int,score:long>>")
    first = _meet(asked.withColumn("wanted", none), data, _met(asked, data, True), pieces, positives, True, window)
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    best = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    best = cut_lineage(best.select("block", "place", F.col("n").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    wanted = best.select("block", "place", "positive_score").distinct().groupBy("block")
    wanted = wanted.agg(F.collect_list(F.struct("place", F.col("positive_score").alias("score"))).alias("wanted"))
    asking = cut_lineage(asked.join(wanted, "block"))
    second = _meet(asking, data, _met(asking, data, False), pieces, negatives, False, window)
    order = Window.partitionBy("block", "place", "window").orderBy(F.desc("score"), "vec_id")
    ranked = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    ids = asked.select("block", F.col("ids").alias("_ids"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("_ids").to_pylist(), strict=True):
                own = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int64()), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], names=["block", "place", "anchor_id"])

    anchor = ids.mapInArrow(named, "block long, place int, anchor_id long")
    joined = best.join(anchor, ["block", "place"]).withColumnRenamed("positive_score", "window").join(ranked, ["block", "place", "window"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", F.col("window").alias("positive_score"), "negative_score")
