"""Hard negatives against all inner products in Python's integers."""

import math
import random

import numpy as np
import pytest
from laptable.llm import hard_negatives as hn
from pyspark.sql import functions as F


def plain(rows, is_anchor, positives=5, negatives=10, window=(30, 90, 100), scale=256):
    valid = {(n, i, l, tuple(math.floor(scale * float(x)) for x in v)) for n, (i, v, l) in enumerate(rows) if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    low, high, of = window
    out = []
    for i, label, v in sorted({r[1:] for r in valid if is_anchor(r[1])}):
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), m, own == label) for _, m, own, w in valid if m != i and len(w) == len(v)]
        for minus, m, _ in sorted(x for x in scored if x[2])[:positives]:
            fit = sorted(x for x in scored if not x[2] and low * -minus <= of * -x[0] <= high * -minus)[:negatives]
            out += [(i, m, r + 1, x[1], -minus, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def mined(found):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found.collect())


def some_rows(n, dim, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 0, 1, 2, 3])
        rows.append((i, [float(np.float32(rng.gauss(0.2 if c % 4 == label else 0.0, 0.1))) for c in range(dim)], label))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("sizes", [(1 << 22, 256), (4000, 3)])
def test_mining_equals_all_products(spark, monkeypatch, sizes):
    monkeypatch.setattr(hn, "DATA_BYTES", sizes[0])
    monkeypatch.setattr(hn, "ANCHORS", sizes[1])
    monkeypatch.setattr(hn, "PIECE", 2)
    rows = some_rows(500, 20, 1) + [(600 + i, [0.5] * 20, i % 2) for i in range(60)]
    rows += [(700, None, 1), (710, [], 1), (720, [None] * 20, 1), (730, [float("nan")] * 20, 1), (740, [float("inf")] * 20, 1), (750, [0.1] * 20, None), (None, [0.1] * 20, 1)]
    rows += [(760, [0.5, 0.25], 1), (761, [0.5, 0.5], 1), (762, [0.5, 0.1], 0), (770, [0.3], 2), (100, rows[100][1], rows[100][2]), (780, [-0.4] * 20, 9)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("block", "rank", "label_", "v", "dim", "score")})
    assert mined(hn.mine(df, F.col("vec_id") % 10 == 0)) == plain(rows, lambda i: i % 10 == 0)


def test_wide_numbers_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 6]) for _ in range(4)], i % 3) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(hn.mine(df, F.col("vec_id") % 10 == 0)) == plain(rows, lambda i: i % 10 == 0)
    huge = spark.createDataFrame([(0, [1e30], 0), (1, [1e-30], 0), (2, [1e30], 0), (3, [1e28], 1)], "vec_id long, embedding array<double>, label int")
    found = mined(hn.mine(huge, F.col("vec_id") == 1))
    assert found == plain([tuple(r) for r in huge.collect()], lambda i: i == 1) == [(1, 0, 1, 3, 0, 0), (1, 2, 1, 3, 0, 0)]
    with pytest.raises(Exception, match="64 bits"):
        hn.mine(huge, F.col("vec_id") == 0).collect()


def test_bounds_leave_columns_unread():
    rng = np.random.default_rng(3)
    columns = np.floor(rng.normal(size=(64, 4000)) * 30)
    block = hn.Block({"labels": ["x"], "codes": np.zeros(4000, "<i4").tobytes(), "ids": np.arange(4000).astype("<i8").tobytes(), "columns": columns.tobytes(), "dim": 64})
    q = np.floor(np.append(rng.normal(size=4) * 400, rng.normal(size=60) * 4))
    at, scores = hn.scan(q, block, np.ones(4000, bool), [(-np.inf, np.inf)], 5)
    every = q @ columns
    assert len(at) < 40 and (scores == every[at]).all() and set(np.argsort(-every)[:5]) <= set(at)


def test_few_or_no_rows(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    rows = [(0, [1.0], 0), (1, [2.0], 0), (2, [0.5], 1), (3, [0.5], 1), (4, [5.0], 2)]
    found = mined(hn.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0))
    assert found == plain(rows, lambda i: i == 0) and len(found) == 0
    rows += [(5, [1.0], 3)]
    found = mined(hn.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0))
    assert found == plain(rows, lambda i: i == 0) == [(0, 1, 1, 5, 131072, 65536)]
