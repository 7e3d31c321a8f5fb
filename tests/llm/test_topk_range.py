"""Top-k search over vectors of any finite size, against the full product without a limit."""

import math
import random

import numpy as np
import pytest
from laptable.llm import queries as q
from laptable.llm import topk

from .test_topk_lang import tops


def full_product(rows, k=20, scale=64):
    valid = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and all(math.isfinite(x) for x in v)]
    out = set()
    for i, v in valid:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), m) for m, w in valid if m != i)
            out |= {(i, r + 1, m, -s) for r, (s, m) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("size, one", [(2e7, 1.0), (6e7, 1.0), (1e4, 1e9)])
def test_query_keeps_long_vectors(spark, monkeypatch, tmp_path, size, one):
    monkeypatch.setattr(topk, "DATA_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "DATA_LEAF", 8)
    monkeypatch.setattr(topk, "QUERY_LEAF", 2)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(200)]
    rows += [(i, [rng.gauss(0, 1) * (size if i % 3 else 1e4) / 8 for _ in range(3)]) for i in range(200, 260)]
    rows += [(i, [-size / 8, 1.0, 2.0]) for i in range(260, 285)] + [(300, [one, 1.0, -one]), (400, [float("inf")] * 3), (420, [float("nan")] * 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert tops(q.op8_topk(spark, str(tmp_path))) == full_product(rows)


def test_a_bound_is_never_below_a_product():
    rng = np.random.default_rng(4)
    for scale in (1.0, 1e6, 1e12):
        a = np.floor(rng.normal(size=(40, 6)) * scale)
        b = -a + np.floor(rng.normal(size=(40, 6)))
        norm = lambda x: np.sqrt((x**2).sum(axis=1))
        exact = [sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for u, v in zip(a, b, strict=True)]
        bounds = topk.highest((a * b).sum(axis=1), norm(a), 0.0, norm(b), 0.0, 6)
        assert all(int(x) >= y for x, y in zip(np.ceil(bounds), exact, strict=True))
