"""Exact top-k by inner product: dual-tree search over cover trees of query and data blocks.

Vectors become integers (``floor(scale * x)``). Data and queries are dealt into blocks of bounded size around a bounded number
of pivots (``PIVOTS`` vectors with the smallest hashes of their ids); large cells are split further by hash, so a group of
copies never fills one block. Each block gets a cover tree: a node covers its points within its radius of its centre, and
its children lie in balls of about half that radius. A pair of nodes can hold no inner product above

    <cq, cp> + rq |cp| + rp |cq| + rq rp

and is left out when that lies below the worst k-th score of the query node's queries. The search runs in two rounds: first
every query block meets the data blocks of its most promising pivot; their k-th scores then rule out whole pairs of blocks and
start the pruning in the others. Each round joins blocks on stated pairs of block numbers and merges k rows a query and block.

Work is the number of pairs that bounds cannot rule out, so up to queries times rows where vectors have no structure.

Defined cases: null vectors, and vectors with null or non-finite components, take no part, nor do empty ones and rows without
an id; vectors with a component of ``limit`` or more in size after scaling take no part unless ``limit`` is None, which keeps
every finite vector (a component or a score among the results that needs more than 64 bits ends the job with an error); vectors of different lengths are never compared; a query's own row is every
row with its id; equal scores go to the smaller id; rows that repeat are candidates each; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laptable.llm.common import cut_lineage

PIVOTS = 64
DATA_BLOCK, QUERY_BLOCK = 8192, 1024
DATA_LEAF, QUERY_LEAF = 256, 64
CHILDREN = 16
LIMIT = float(2**26)
NODE = np.dtype([("start", "<i4"), ("stop", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8"), ("centre", "<i4")])
BLOCKS = "dim int, pivot int, block long, radius double, size int, ids array<long>, vectors binary, nodes binary"
FOUND = "query_id long, vec_id long, score long"


def highest(dot, q_norm, q_radius, d_norm, d_radius, dim: int):
    """The bound of a pair of balls, with room for the rounding of every term, whatever the sign of the sum."""
    slack = (1e-12 + dim * 1e-15) * (q_norm + q_radius) * (d_norm + d_radius) + 1e-6
    return dot + q_radius * (d_norm + d_radius) + d_radius * q_norm + slack


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def cover_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the points, and the nodes; a node's points are a run, its centre comes first in it."""
    order = np.arange(len(points))
    away = _distances(points, points[0])
    nodes: list[tuple] = [(0, len(points), 0, 0, float(away.max()), 0)]
    todo = [0]
    while todo:
        at = todo.pop()
        start, stop, _, _, radius, _ = nodes[at]
        if stop - start <= leaf or radius == 0:
            continue
        run = order[start:stop]
        own = points[run]
        nearest, cell, centres = _distances(own, own[0]), np.zeros(len(run), np.int64), [0]
        while nearest.max() > radius / 2 and len(centres) < CHILDREN:
            far = int(nearest.argmax())
            away = _distances(own, own[far])
            closer = away < nearest
            nearest[closer], cell[closer] = away[closer], len(centres)
            centres.append(far)
        cell[centres] = np.arange(len(centres))
        first = np.ones(len(run), bool)
        first[centres] = False
        sorted_ = np.lexsort((first, cell))
        order[start:stop] = run[sorted_]
        edges = start + np.searchsorted(cell[sorted_], np.arange(len(centres) + 1))
        child = len(nodes)
        nodes[at] = (start, stop, child, len(centres), radius, start)
        for k in range(len(centres)):
            inside = nearest[cell == k]
            nodes.append((int(edges[k]), int(edges[k + 1]), 0, 0, float(inside.max()), int(edges[k])))
            todo.append(child + k)
    return order, np.array(nodes, NODE)


def dual_search(queries: dict, data: dict, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, data ids, scores): the best k of a data block for each query, among scores of at least ``floor``."""
    qv, dv = queries["vectors"], data["vectors"]
    qn, dn = queries["nodes"], data["nodes"]
    qc, dc = qv[qn["centre"]].astype(float), dv[dn["centre"]].astype(float)
    q_norm, d_norm = np.sqrt((qc**2).sum(axis=1)), np.sqrt((dc**2).sum(axis=1))
    rank = np.empty(len(dv), np.int64)
    rank[np.argsort(data["ids"], kind="stable")] = np.arange(len(dv))
    by_rank = np.argsort(rank)
    m = len(dv)
    largest = (float(np.abs(qv).max()) + 1) * (float(np.abs(dv).max()) + 1) * qv.shape[1]
    kind = np.int64 if largest * m < 2**62 else object
    none = np.iinfo(np.int64).min if kind is np.int64 else -(2**200)
    best = np.full((len(qv), k), none, kind)
    floor = np.nextafter(floor.astype(float), -np.inf)
    kth = floor.copy()
    # Products are exact as floats, else as 64-bit integers, else as Python's.
    qx, dx = (v.astype(float if largest < 2**52 else np.int64 if largest < 2**62 else object) for v in (qv, dv))

    def bounds(q: int, ds: np.ndarray) -> np.ndarray:
        return highest(dc[ds] @ qc[q], q_norm[q], qn["radius"][q], d_norm[ds], dn["radius"][ds], qv.shape[1])

    def pairs_of(q: int, d: int) -> list[tuple[float, int, int]]:
        split_q = qn["children"][q] and (qn["radius"][q] >= dn["radius"][d] or not dn["children"][d])
        qs = range(qn["child"][q], qn["child"][q] + qn["children"][q]) if split_q else [q]
        ds = np.array([d]) if split_q else np.arange(dn["child"][d], dn["child"][d] + dn["children"][d])
        return sorted((float(b), a, int(c)) for a in qs for b, c in zip(bounds(a, ds), ds, strict=True))

    root = float(bounds(0, np.array([0]))[0])
    stack = [(root, 0, 0)]
    while stack:
        bound, q, d = stack.pop()
        qa, qb = int(qn["start"][q]), int(qn["stop"][q])
        if bound < kth[qa:qb].min():
            continue
        if qn["children"][q] or dn["children"][d]:
            stack.extend(pairs_of(q, d))
            continue
        da, db = int(dn["start"][d]), int(dn["stop"][d])
        for a in range(da, db, 4096):
            b = min(a + 4096, db)
            scores = qx[qa:qb] @ dx[a:b].T
            scores = (scores.astype(np.int64) if scores.dtype == float else scores).astype(kind)
            keys = scores * m + (m - 1 - rank[a:b])
            keys[(scores < kth[qa:qb, None]) | (queries["ids"][qa:qb, None] == data["ids"][a:b])] = none
            both = np.concatenate([best[qa:qb], keys], axis=1)
            best[qa:qb] = -np.partition(-both.clip(none + 1), k - 1, axis=1)[:, :k]
            worst = best[qa:qb].min(axis=1)
            full = np.maximum(np.nextafter((worst // m).astype(float), -np.inf), floor[qa:qb])
            kth[qa:qb] = np.where(worst > none + 1, full, floor[qa:qb])
    at, col = np.nonzero(best > none + 1)
    keys = best[at, col]
    place = (m - 1 - keys % m).astype(np.int64)
    return queries["ids"][at], data["ids"][by_rank[place]], (keys // m).astype(np.int64)


def scaled(vectors: DataFrame, scale: int, vec_id: str, vector: str, limit: float | None = LIMIT) -> DataFrame:
    """``vec_id, dim, v``: valid vectors as integers."""
    wide = F.raise_error("A vector's component needs more than 64 bits").cast("long")
    whole = lambda c: F.when(F.abs(c.cast("double") * scale) < float(2**63), F.floor(c.cast("double") * scale)).otherwise(wide)
    x = F.transform(F.col(vector), whole)
    least = float("inf") if limit is None else limit / scale
    sound = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < least))
    valid = F.col(vec_id).isNotNull() & (F.size(F.coalesce(F.col(vector), F.array())) > 0) & sound
    return vectors.where(valid).select(F.col(vec_id).cast("long").alias("vec_id"), F.size(vector).alias("dim"), x.cast("array<long>").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dim)


def _blocks(rows: DataFrame, pivots: dict[int, np.ndarray], most: int, leaf: int) -> DataFrame:
    """One stored row per block: its ids, vectors and tree; its first point is the centre of its radius."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            cell = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own = _matrix(batch.column("v").take(pa.array(at)), int(dim)).astype(float)
                cell[at] = (own @ pivots[int(dim)].T - (pivots[int(dim)] ** 2).sum(axis=1) / 2).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "pivot"])

    def grow(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        vectors = _matrix(table.column("v").combine_chunks(), dim)
        order, nodes = cover_tree(vectors.astype(float), leaf)
        ids = np.asarray(table.column("vec_id"))[order]
        row = {"dim": dim, "pivot": table.column("pivot")[0].as_py(), "block": table.column("salt")[0].as_py(), "radius": float(nodes["radius"][0])}
        row |= {"size": len(ids), "ids": ids.tolist(), "vectors": vectors[order].astype("<i8").tobytes(), "nodes": nodes.tobytes()}
        types = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.Table.from_pydict({k: pa.array([v], t) for (k, v), t in zip(row.items(), types, strict=True)})

    dealt = cut_lineage(rows.mapInArrow(nearest, "vec_id long, dim int, v array<long>, pivot int"))
    cells = dealt.groupBy("dim", "pivot").count().select("dim", "pivot", F.ceil(F.col("count") / most).alias("parts"))
    salted = dealt.join(cells, ["dim", "pivot"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("long"))
    return cut_lineage(salted.drop("parts").groupBy("dim", "pivot", "salt").applyInArrow(grow, BLOCKS).withColumn("block", F.xxhash64("dim", "pivot", "block")))


def _block(row: dict, side: str) -> dict:
    vectors = np.frombuffer(row[f"{side}vectors"], "<i8").reshape(-1, row["dim"])
    return {"ids": np.array(row[f"{side}ids"], np.int64), "vectors": vectors, "nodes": np.frombuffer(row[f"{side}nodes"], NODE)}


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """Results of pairs of blocks (columns of both, ``q_`` and ``d_``, and the queries' k-th scores so far or null)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                queries, data = _block(row, "q_"), _block(row, "d_")
                floor = np.full(len(queries["ids"]), -np.inf)
                if row["floors"]:
                    known = {x["query_id"]: x["floor"] for x in row["floors"]}
                    floor = np.array([known.get(i, -np.inf) for i in queries["ids"].tolist()])
                columns = dual_search(queries, data, k, floor)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(search, FOUND)


def _side(blocks: DataFrame, side: str, *more: Column) -> DataFrame:
    return blocks.select("dim", *[F.col(c).alias(f"{side}{c}") for c in ("pivot", "block", "radius", "ids", "vectors", "nodes")], *more)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding", seed_pairs: int = 2,
    limit: float | None = LIMIT,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every row with ``is_query`` (an expression of ``vec_id``)."""
    rows = scaled(vectors, scale, vec_id, vector, limit)
    sample: dict[int, list] = {}
    for row in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOTS).collect():
        sample.setdefault(row["dim"], []).append(row["v"])
    for row in rows.groupBy("dim").agg(F.min(F.struct("vec_id", "v")).alias("m")).collect():
        sample.setdefault(row["dim"], [row["m"]["v"]])
    pivots = {dim: np.array(v, float) for dim, v in sample.items()}
    data = _blocks(rows, pivots, DATA_BLOCK, DATA_LEAF)
    queries = _blocks(rows.where(is_query), pivots, QUERY_BLOCK, QUERY_LEAF)

    meta = lambda side: F.struct("block", "radius", F.expr("substring(vectors, 1, dim * 8)").alias("centre")).alias(side)
    metas = queries.select("dim", meta("q")).join(data.select("dim", meta("d")), "dim")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[s]["centre"], "<i8").astype(float) for s in "qd")
                na, nb, ra, rb = np.sqrt(a @ a), np.sqrt(b @ b), row["q"]["radius"], row["d"]["radius"]
                out.append((row["q"]["block"], row["d"]["block"], float(a @ b), float(highest(a @ b, na, ra, nb, rb, len(a)))))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            names = ["q_block", "d_block", "near", "bound"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    rated = cut_lineage(metas.mapInArrow(rate, "q_block long, d_block long, near double, bound double"))
    return _rounds(rated, queries, data, k, seed_pairs)


def _rounds(rated: DataFrame, queries: DataFrame, data: DataFrame, k: int, seed_pairs: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("q_block").orderBy(F.desc("near"), "d_block"))
    seeds = rated.withColumn("n", order).where(F.col("n") <= seed_pairs).select("q_block", "d_block")
    sides = lambda pairs: pairs.join(_side(queries, "q_"), "q_block").join(_side(data, "d_").drop("dim"), "d_block")
    first = cut_lineage(_searched(sides(seeds).withColumn("floors", F.lit(None).cast("array<struct<query_id:long,floor:double>>")), k))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    ids = queries.select(F.col("block").alias("q_block"), F.explode("ids").alias("query_id"))
    floors = ids.join(kth, "query_id", "left").groupBy("q_block")
    lowest = F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("lowest")
    floors = floors.agg(lowest, F.collect_list(F.struct("query_id", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))).alias("floors"))
    rest = rated.join(seeds, ["q_block", "d_block"], "left_anti").join(floors, "q_block").where("bound >= lowest")
    second = _searched(sides(rest.select("q_block", "d_block", "floors")), k)
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

