"""Paired bootstrap of the difference in absolute error between two models.

Resampling never moves prediction rows. The cluster bootstrap works on one (sum, count) row
per cluster; each draw gives a cluster a weight from a seeded hash. The row bootstrap weighs
single rows the same way, with partial sums per draw on the map side. The hash is Spark's ``xxhash64``
over seed, draw and identity, taken in arrays of rows by draws; rows that follow each other share the
hash of the columns they have in common. Weights follow a
Poisson(1) law, the usual large-sample stand-in for drawing with replacement (documented
approximation; the means, counts and shares are exact).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLUSTER = ["season", "event", "driver"]


#: Rows whose weights of all draws are taken together, and those of them whose hashes stay in the cache of a core.
ROWS, BLOCK = 256, 16
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
WHOLE, LONG, REAL, TEXT = ("tinyint", "smallint", "int", "boolean", "date"), ("bigint", "timestamp"), ("double",), ("string",)


def _rotate(h: np.ndarray, bits: int) -> np.ndarray:
    high = h << np.uint64(bits)
    h >>= np.uint64(64 - bits)
    h |= high
    return h


def _mix(h: np.ndarray) -> np.ndarray:
    for bits, factor in ((33, P2), (29, P3), (32, None)):
        h ^= h >> np.uint64(bits)
        if factor is not None:
            h *= factor
    return h


def _four(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    h ^= value * P1
    _rotate(h, 23)
    h *= P2
    h += P3
    return h


def _eight(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    h ^= _rotate(value * P2, 31) * P1
    _rotate(h, 27)
    h *= P1
    h += P4
    return h


def _text_hash(h: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Hashes of texts of one length, a row of bytes each."""
    n, whole = data.shape[1], data.shape[1] // 32 * 32
    words = np.ascontiguousarray(data[:, : n // 8 * 8]).view("<u8")
    word = lambda i: words[:, i : i + 1]
    if whole:
        lanes = [h + P1 + P2, h + P2, h.copy(), h - P1]
        for i in range(whole // 8):
            lanes[i % 4] = _rotate(lanes[i % 4] + word(i) * P2, 31) * P1
        h = sum((_rotate(v.copy(), bits) for v, bits in zip(lanes[1:], (7, 12, 18))), _rotate(lanes[0].copy(), 1))
        for v in lanes:
            h = (h ^ (_rotate(v * P2, 31) * P1)) * P1 + P4
    else:
        h = h + P5
    h += np.uint64(n)
    for i in range(whole // 8, n // 8):
        _eight(h, word(i))
    at = n // 8 * 8
    if n - at >= 4:
        _four(h, np.ascontiguousarray(data[:, at : at + 4]).view("<u4").astype(np.uint64))
        at += 4
    for i in range(at, n):
        h ^= data[:, i : i + 1].astype(np.uint64) * P5
        _rotate(h, 11)
        h *= P1
    return _mix(h)


def _hashed(h: np.ndarray, values: pd.Series, kind: str) -> np.ndarray:
    """``xxhash64`` of one more column, a row of ``h`` per value; a null leaves it as it is. ``h`` is overwritten."""
    gone = values.isna().to_numpy()
    if kind in TEXT:
        texts = [None if g else v.encode() for v, g in zip(values, gone)]
        for size in {len(v) for v in texts if v is not None}:
            at = [i for i, v in enumerate(texts) if v is not None and len(v) == size]
            h[at] = _text_hash(h[at], np.frombuffer(b"".join(texts[i] for i in at), np.uint8).reshape(len(at), size))
        return h
    if kind in REAL:
        bits = (values.to_numpy(np.float64, na_value=0.0) + 0.0).view(np.uint64)
    else:
        bits = values.fillna(0).to_numpy(np.int64).view(np.uint64)
    kept = h[gone]
    h += P5 + np.uint64(4 if kind in WHOLE else 8)
    if kind in WHOLE:
        _mix(_four(h, (bits & np.uint64(0xFFFFFFFF))[:, None]))
    else:
        _mix(_eight(h, bits[:, None]))
    h[gone] = kept
    return h


def _bounds(highest: int = 18) -> np.ndarray:
    """Where the cumulative law of Poisson(1) steps, in units of 2**-53, the resolution of the uniform
    numbers. Counts beyond ``highest`` have a chance below that, so none is cut off."""
    total, out = 0.0, []
    for k in range(highest):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(math.ceil(total * 2**53))
    return np.array(out, np.uint64)


BOUNDS = _bounds()


def _poisson(h: np.ndarray) -> np.ndarray:
    """Poisson(1) counts from hashes, which are overwritten."""
    h >>= np.uint64(11)
    out = np.zeros(h.shape, np.uint8)
    for b in BOUNDS[:6]:
        out += (h >= b).view(np.uint8)
    high = out == 6
    if high.any():
        out[high] = np.searchsorted(BOUNDS, h[high], side="right")
    return out


def draw_weights(rows: pd.DataFrame, kinds: dict[str, str], seed: int, draws: int) -> np.ndarray:
    """Weight of every row (down) in every draw (across)."""
    first = _hashed(np.full((1, 1), 42, np.uint64), pd.Series([seed]), "int" if -(2**31) <= seed < 2**31 else "bigint")
    h = _hashed(np.repeat(first, draws, axis=0), pd.Series(range(1, draws + 1)), "int").T
    at = np.zeros(len(rows), np.int64)  # the row of ``h`` that stands for a row's columns so far
    *shared, last = kinds
    for name in shared:
        codes, distinct = pd.factorize(rows[name], use_na_sentinel=False)
        both, place, at = np.unique(at * (len(distinct) + 1) + codes, return_index=True, return_inverse=True)
        h = _hashed(h[both // (len(distinct) + 1)], rows[name].iloc[place], kinds[name])
    out = np.empty((len(rows), draws))
    for i in range(0, len(rows), BLOCK):
        out[i : i + BLOCK] = _poisson(_hashed(h[at[i : i + BLOCK]], rows[last].iloc[i : i + BLOCK], kinds[last]))
    return out


def paired_difference(aligned: DataFrame, model: str, baseline: str) -> DataFrame:
    a, b = (F.abs(F.col(f"pred_{m}") - F.col("actual")) for m in (model, baseline))
    return aligned.withColumn("diff", a - b).where(F.col("diff").isNotNull() & ~F.isnan("diff"))


def paired_summary(aligned: DataFrame, model: str, baseline: str) -> DataFrame:
    """Mean difference, share of laps the model wins, laps and clusters."""
    clusters = paired_difference(aligned, model, baseline).groupBy(*CLUSTER).agg(
        F.sum("diff").alias("s"), F.count(F.lit(1)).alias("n"), F.sum((F.col("diff") < 0).cast("int")).alias("w")
    )
    return clusters.agg(
        (F.sum("s") / F.sum("n")).alias("mean_diff_s"), (F.sum("w") / F.sum("n")).alias("share_better"),
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("clusters"),
    )


def _interval(totals: DataFrame, kind: str, draws: int) -> DataFrame:
    """``totals`` has one row per draw."""
    ratio = totals.select(F.try_divide("s", "n").alias("v")).where("v is not null")
    return ratio.agg(
        F.lit(kind).alias("kind"), F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"), F.count("v").alias("draws")
    )


def paired_bootstrap(aligned: DataFrame, model: str, baseline: str, draws: int = 2000, seed: int = 0,
                     keys: list[str] | None = None) -> DataFrame:
    """95 % intervals of the mean difference: row and cluster bootstrap, one row each."""
    if draws <= 0:
        raise ValueError("draws must be positive")
    keys = keys or ["season", "event", "session", "driver", "lap_number"]
    diff = paired_difference(aligned, model, baseline)
    def totals(rows: DataFrame, identity: list[str], salt: int) -> DataFrame:
        kinds = {c: dict(rows.dtypes)[c] for c in identity}
        unknown = [c for c, kind in kinds.items() if kind not in WHOLE + LONG + REAL + TEXT]
        if unknown:
            raise ValueError(f"Keys of these columns cannot be hashed: {unknown}")
        # Days and instants as numbers, which is what the hash takes of them.
        numbers = {"date": F.unix_date, "timestamp": F.unix_micros}
        numbered = rows.select(*[numbers[kind](c).alias(c) if kind in numbers else c for c, kind in kinds.items()], "s", "n")

        def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s, n, seen = np.zeros(draws), np.zeros(draws), False
            for batch in batches:
                seen |= len(batch) > 0
                for i in range(0, len(batch), ROWS):
                    some = batch.iloc[i : i + ROWS]
                    weights = draw_weights(some, kinds, seed + salt, draws)
                    s += some["s"].to_numpy() @ weights
                    n += some["n"].to_numpy(np.float64) @ weights
            if seen:
                yield pd.DataFrame({"draw": np.arange(1, draws + 1), "s": s, "n": n.astype(np.int64)})

        # Every task ends with one partial row per draw.
        partial = numbered.mapInPandas(weighed, "draw int, s double, n bigint")
        return partial.groupBy("draw").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))

    clusters = diff.groupBy(*CLUSTER).agg(F.sum("diff").alias("s"), F.count(F.lit(1)).alias("n"))
    single = diff.select(*keys, F.col("diff").alias("s"), F.lit(1).alias("n"))
    return _interval(totals(single, keys, 1), "row", draws).unionByName(_interval(totals(clusters, CLUSTER, 2), "cluster", draws))
