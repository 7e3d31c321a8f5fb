"""Near duplicates of vectors by learned binary codes, multi-index Hamming tables and exact cosines of the original vectors.

1. Equal vectors of one label are one class (grouped by two 64-bit hashes) with the smallest id and the number of its rows.
2. Iterative quantisation: on at most ``SAMPLE`` classes, vectors of length one are centred and turned to their principal
   axes; a rotation is then improved by turns (signs of the rotated vectors, then the rotation closest to these signs), from several
   random starts, until ``TABLES * BITS`` bits are there. Thresholds are the medians of the sample, so every bit is balanced.
   The same is fitted without centring, and the fit that finds more of the sample's own links is kept.
3. A code is cut into ``TABLES`` strings of ``BITS`` bits, each looked up in its own table: by the pigeonhole principle two codes
   that differ in fewer than ``TABLES`` bits share a string. At cosine 0.98 a bit differs with a chance of about 0.064, so a
   string is shared with a chance of 0.35 and all are missed with one of about 4e-5.
4. Classes that share a string of one label are compared in blocks of ``BLOCK`` members: by codes alone at first (at most
   ``MOST_BITS`` bits may differ, seven deviations at cosine 0.98), each pair under its first shared string only. Members with such a partner
   get their vectors and are compared by cosine in double precision. Per member and block pair the sum of the partners' row
   counts and the smallest member of its local component come out, never the pairs.
5. Links of a class are these sums; components follow from the local ones.

More than some 10^7 vectors of a label want longer strings (``bits``) and more tables, so that strings stay rare.

Defined cases: rows with a null id or label, null, empty or zero vectors and vectors with null or non-finite components link
with nothing (0 links, a component of their own); vectors of different lengths are never linked; copies are linked with each
other; rows that repeat an id are vectors each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laptable.llm.common import cut_lineage
from laptable.llm.components import components

#: Classes the rotations are learned from, turns of learning, and dimensions of the principal space.
SAMPLE, TURNS, AXES = 4096, 40, 64
TABLES, BITS = 24, 16
MOST_BITS = 80
#: Members of one string are compared in blocks of about so many, and so many pairs at once.
BLOCK, PAIRS = 512, 1 << 18


class Codes:
    """Directions and thresholds for vectors of one length; without a fit, random directions through the origin."""

    def __init__(self, dim: int, n_bits: int):
        turns = np.random.default_rng(dim).normal(size=(-(-n_bits // dim), dim, dim))
        self.directions = np.concatenate([np.linalg.qr(t)[0] for t in turns], axis=1)[:, :n_bits]
        self.thresholds = np.zeros(n_bits)

    def bits(self, units: np.ndarray) -> np.ndarray:
        return units @ self.directions > self.thresholds

    def fit(self, units: np.ndarray, centred: bool) -> Codes:
        n_bits, dim = len(self.thresholds), units.shape[1]
        x = units - units.mean(axis=0) * centred
        axes = np.linalg.svd(x.T @ x)[0][:, : min(dim, AXES)]
        seen, rng, found = x @ axes, np.random.default_rng(7), []
        for _ in range(-(-n_bits // axes.shape[1])):
            turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
            for _ in range(TURNS):
                left, _, right = np.linalg.svd(seen.T @ np.where(seen @ turn > 0, 1.0, -1.0))
                turn = left @ right
            found.append(axes @ turn)
        self.directions = np.concatenate(found, axis=1)[:, :n_bits]
        self.thresholds = np.median(units @ self.directions, axis=0) if centred else np.zeros(n_bits)
        return self


def unit_vectors(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; a power of two is taken out first, so that squares neither overflow nor vanish."""
    matrix = np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1))[1][:, None])
    return matrix / np.sqrt((matrix**2).sum(axis=1))[:, None]


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, of the vectors as they are (but for powers of two)."""
    one, two = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (left, right))
    return (one * two).sum(axis=1) / np.sqrt((one**2).sum(axis=1) * (two**2).sum(axis=1))


def strings_of(bits: np.ndarray, width: int) -> np.ndarray:
    """One row of numbers per code: its strings of ``width`` bits."""
    cut = bits.reshape(len(bits), -1, width)
    return cut @ (1 << np.arange(width, dtype=np.int64))


def recall_of(codes: Codes, units: np.ndarray, width: int, cosine: float) -> float:
    """The share of a sample's links whose codes share a string; 1 without links."""
    strings, links, found = strings_of(codes.bits(units), width), 0, 0
    for i in range(0, len(units), 512):
        a, b = np.nonzero(np.triu(units[i : i + 512] @ units.T >= cosine, i + 1))
        for k in range(0, len(a), PAIRS):
            some = slice(k, k + PAIRS)
            found += int((strings[a[some] + i] == strings[b[some]]).any(axis=1).sum())
        links += len(a)
    return found / links if links else 1.0


def learn(classes: DataFrame, cosine: float, tables: int, width: int, sample: int) -> dict[int, Codes]:
    """Codes for every length of vector that the sample holds enough of."""
    rows = classes.orderBy(F.xxhash64("h1", "h2", "label"), "h1", "h2").limit(sample).select("vector").toArrow().column("vector").to_pylist()
    fitted = {}
    for dim in sorted({len(v) for v in rows}):
        units = unit_vectors(np.array([v for v in rows if len(v) == dim], float))
        if len(units) >= 2 * min(dim, AXES):
            both = [Codes(dim, tables * width).fit(units, centred) for centred in (True, False)]
            fitted[dim] = max(both, key=lambda c: recall_of(c, units, width, cosine))
    return fitted


def _coded(classes: DataFrame, fitted: dict[int, Codes], n_bits: int) -> DataFrame:
    """``cls, dim, label, code`` (binary, the bits of all strings in a row)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = dict(fitted)
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                vectors = part.column("vector")
                dims = np.diff(np.asarray(vectors.offsets))
                out = np.zeros((len(dims), n_bits // 8), np.uint8)
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    units = unit_vectors(np.asarray(vectors.take(pa.array(at)).flatten(), np.float64).reshape(-1, dim))
                    codes = own.setdefault(dim, None) or Codes(dim, n_bits)
                    own[dim] = codes
                    out[at] = np.packbits(codes.bits(units), axis=1)
                packed = pa.array([x.tobytes() for x in out], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array(dims, pa.int32()), part.column("label"), packed], names=["cls", "dim", "label", "code"])

    return cut_lineage(classes.select("cls", "label", "vector").mapInArrow(code, "cls long, dim int, label string, code binary"))


def _keys(coded: DataFrame, tables: int, width: int) -> DataFrame:
    """A row per class and table: ``key`` (hash of label, length, table and string) and ``table``."""
    size = width // 8
    spread = coded.withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    string = F.substring(F.col("code"), F.col("table") * size + 1, F.lit(size))
    return spread.select(F.xxhash64("label", "dim", "table", string).alias("key"), "table", "cls")


def _groups(members: DataFrame, item: list[str]) -> DataFrame:
    """Members (key, table, cls, n and what ``item`` names) in pairs of blocks, those of the lower block first."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    whole = F.sort_array(F.collect_list(F.struct("own", *item))).alias("group")
    pair = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    return dealt.groupBy("key", "table", *pair).agg(whole).where("size(group) > 1").select("key", "table", F.expr("low <> high").alias("crossed"), "group")


def _pairs(sizes: np.ndarray, crossed: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number of the group and both members of all pairs to compare, some at a time; in a pair of blocks only pairs across."""
    if not len(sizes):
        return
    starts = np.append(0, np.cumsum(sizes))
    group, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(starts[-1])
    first = blocks == blocks[starts[:-1]][group]
    split = starts[:-1] + np.add.reduceat(first, starts[:-1], dtype=np.int64)
    begin = np.where(crossed[group], split[group], place + 1)
    count = np.where(crossed[group] & ~first, 0, starts[1:][group] - begin)
    for run in np.split(place, np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1):
        n = count[run]
        left = np.repeat(run, n)
        if len(left):
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[run], n)
            yield group[left], left, right


def _likely(codes: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, width: int, most: int) -> np.ndarray:
    """Which pairs differ in few bits and share no string of an earlier table."""
    differ = codes[left] ^ codes[right]
    close = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= most
    same = ~differ.reshape(len(differ), -1, width // 8).any(axis=2)
    return close & (same.argmax(axis=1) == table)


def _roots(n: int, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the node of lowest rank that its links reach."""
    low, node = rank.copy(), np.argsort(rank, kind="stable")
    while True:
        before = low.copy()
        least = np.minimum(low[left], low[right])
        np.minimum.at(low, left, least)
        np.minimum.at(low, right, least)
        low = low[node[low]]
        if (low == before).all():
            return node[low]


def _flat(batch: pa.RecordBatch, runs: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]]:
    """Runs of groups of bounded size: tables and sizes of the groups, whether they pair unlike blocks, and their members in a row."""
    sizes = np.diff(np.asarray(batch.column("group").offsets))
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // runs)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            part = batch.slice(a, b - a)
            yield np.asarray(part.column("table")), sizes[a:b], np.asarray(part.column("crossed").to_numpy(zero_copy_only=False)), part.column("group").flatten()


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _partnered(groups: DataFrame, width: int, most: int) -> DataFrame:
    """Members with a partner by codes."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            done = 0
            for table, sizes, crossed, rows in _flat(batch):
                codes = _matrix(rows.field("code"), np.uint8)
                hit = np.zeros(len(codes), bool)
                for group, left, right in _pairs(sizes, crossed, np.asarray(rows.field("own"))):
                    good = _likely(codes, table[group], left, right, width, most)
                    hit[left[good]] = hit[right[good]] = True
                of = np.repeat(np.arange(len(sizes)), sizes)[hit]
                arrays = [pa.array(keys[done + of]), pa.array(table[of], pa.int32()), rows.field("cls").filter(pa.array(hit))]
                done += len(sizes)
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "table", "cls"])

    return groups.mapInArrow(look, "key long, table int, cls long")


def _linked(groups: DataFrame, width: int, most: int, cosine: float) -> DataFrame:
    """``id, cls, n, root_id, root_cls``: what each member of a pair of blocks is linked with there."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table, sizes, crossed, rows in _flat(batch, 1 << 13):
                codes = _matrix(rows.field("code"), np.uint8)
                ids, cls, weight = (np.asarray(rows.field(c)) for c in ("id", "cls", "rows"))
                raw = rows.field("vector").to_pylist()
                links, one, two = np.zeros(len(ids), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for group, left, right in _pairs(sizes, crossed, np.asarray(rows.field("own"))):
                    good = _likely(codes, table[group], left, right, width, most)
                    left, right = left[good], right[good]
                    dims = np.array([len(raw[i]) for i in left.tolist()], np.int64)
                    for dim in np.unique(dims).tolist():
                        at = np.flatnonzero(dims == dim)
                        step = max(1, (1 << 20) // dim)
                        for some in (at[k : k + step] for k in range(0, len(at), step)):
                            used, place = np.unique(np.concatenate([left[some], right[some]]), return_inverse=True)
                            matrix = np.array([raw[i] for i in used.tolist()], float)
                            true = some[cosines(matrix[place[: len(some)]], matrix[place[len(some) :]]) >= cosine]
                            np.add.at(links, left[true], weight[right[true]])
                            np.add.at(links, right[true], weight[left[true]])
                            one.append(left[true])
                            two.append(right[true])
                order = np.lexsort((cls, ids))
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.arange(len(ids))
                root = _roots(len(ids), np.concatenate(one), np.concatenate(two), rank)
                at = np.flatnonzero(links)
                columns = [ids[at], cls[at], links[at], ids[root[at]], cls[root[at]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "cls", "n", "root_id", "root_cls"])

    return cut_lineage(groups.mapInArrow(look, "id long, cls long, n long, root_id long, root_cls long"))


def _shared(keys: DataFrame) -> DataFrame:
    """Stored members of keys with two or more of them; the join comes last, so adaptive execution may split a hot key."""
    counted = keys.groupBy("key", "table").agg(F.count("*").alias("n")).where("n > 1")
    return cut_lineage(keys.join(counted, ["key", "table"]))


def near_vectors(
    vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    tables: int = TABLES, width: int = BITS, most_bits: int = MOST_BITS, sample: int = SAMPLE,
) -> DataFrame:
    """``vec_id, n_links, component_id`` of every row: rows linked directly, and the smallest id that links reach."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    sound = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    some = F.exists("vector", lambda c: c != 0)
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & sound & some, F.lit(False))
    rows = rows.select("vec_id", "label", "vector", valid.alias("valid"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), "vector").alias("h2"))
    least = F.min(F.struct("vec_id", F.col("vector"))).alias("m")
    classes = rows.where("valid").groupBy("label", "h1", "h2").agg(least, F.count("*").alias("rows"))
    classes = cut_lineage(classes.select("label", "h1", "h2", "rows", F.col("m.vec_id").alias("id"), "m.vector")).withColumn("cls", F.monotonically_increasing_id())

    coded = _coded(classes, learn(classes, cosine, tables, width, sample), tables * width)
    members = _shared(_keys(coded, tables, width)).join(coded.select("cls", "code"), "cls")
    partnered = cut_lineage(_partnered(_groups(members, ["cls", "code"]), width, most_bits).distinct())
    content = coded.select("cls", "code").join(classes.select("cls", "id", "rows", "vector"), "cls")
    linked = _linked(_groups(_shared(partnered).join(content, "cls"), ["cls", "id", "rows", "code", "vector"]), width, most_bits, cosine)

    node = lambda i, c: F.struct(F.col(i).alias("id"), F.col(c).alias("cls"))
    reached = components(linked.select(node("id", "cls").alias("u"), node("root_id", "root_cls").alias("v")))
    reached = reached.select(F.col("node.cls").alias("cls"), F.col("component.id").alias("component"))
    links = linked.groupBy("cls").agg(F.sum("n").alias("n"))
    found = classes.select("cls", "label", "h1", "h2", "rows", "id").join(links, "cls", "left").join(reached, "cls", "left")
    found = found.select("label", "h1", "h2", (F.col("rows") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component"))
    joined = rows.select("vec_id", "label", "h1", "h2", "valid").join(found.withColumn("valid", F.lit(True)), ["label", "h1", "h2", "valid"], "left")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
