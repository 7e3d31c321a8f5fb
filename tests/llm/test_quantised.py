"""Near duplicates of vectors against all cosines."""

import math
import random

import numpy as np
import pytest
from laptable.llm import quantised
from laptable.llm import queries as q
from pyspark.sql import functions as F

from .conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, cosine=0.98):
    """(id, links, component) per row, by a loop over all pairs."""
    sound = [i is not None and l is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v) for i, v, l in rows]
    near = [[] for _ in rows]
    for x, (_, v, l) in enumerate(rows):
        for y in range(x):
            _, w, m = rows[y]
            if sound[x] and sound[y] and l == m and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()) >= cosine:
                    near[x].append(y)
                    near[y].append(x)
    component = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for x, ys in enumerate(near):
            low = min([component[x], *(component[y] for y in ys)]) if ys else component[x]
            changed, component[x] = changed or low != component[x], low
    return sorted(((i, len(n), c) for (i, _, _), n, c in zip(rows, near, component, strict=True)), key=str)


def found_of(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect()), key=str)


def clustered(seed, dim=32, groups=25, mean=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim) + mean
        for _ in range(rng.integers(1, 30)):
            v = centre + rng.normal(size=dim) * np.linalg.norm(centre) / math.sqrt(dim) * rng.choice([0.02, 0.1, 0.14])
            rows.append((len(rows), [float(np.float32(x)) for x in v], g % 3))
    return rows


@pytest.mark.parametrize("block", [512, 5])
def test_links_and_components_equal_all_cosines(spark, monkeypatch, block):
    monkeypatch.setattr(quantised, "BLOCK", block)
    rows = clustered(1)
    n = len(rows)
    rows += [(n + 1 + i, rows[0][1], 0) for i in range(15)] + [(n + 20, [2 * x for x in rows[0][1]], 0), (n + 21, rows[0][1], 1)]
    rows += [(n + 30, None, 1), (n + 31, [], 1), (n + 32, [0.0] * 32, 1), (n + 33, [0.0] * 32, 1), (n + 34, [None] * 32, 1), (n + 35, [float("nan")] * 32, 1)]
    rows += [(n + 40, rows[0][1], None), (None, rows[0][1], 0), (n + 41, [1.0, 2.0], 0), (n + 42, [1.0, 2.01], 0), (n + 43, [-1.0, 2.0], 0)]
    rows += [(3, rows[0][1], 0), (3, rows[0][1], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("cls", "key", "h1", "valid", "n", "component_id", "rows")})
    assert found_of(quantised.near_vectors(df)) == plain(rows)


def test_vectors_of_any_size(spark):
    rows = [(i, [s * (1 + i % 2 * 0.01), s * 2, -s], 0) for i, s in enumerate([1e-300, 1.0, 1e300, 1e-300, 1e150, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found_of(quantised.near_vectors(df)) == sorted([(i, 5, 0) for i in range(6)])


def test_recall_with_a_common_mean():
    rng = np.random.default_rng(5)
    for mean in (0.0, 3.0):
        base = rng.normal(size=(300, 64)) + mean
        matrix = np.concatenate([base + rng.normal(size=base.shape) * np.linalg.norm(base, axis=1)[:, None] / 8 * s for s in (0.05, 0.1, 0.14)])
        units = quantised.unit_vectors(matrix)
        both = [quantised.Codes(64, 384).fit(units, c) for c in (True, False)]
        assert max(quantised.recall_of(c, units, 16, 0.98) for c in both) > 0.99
        balance = both[0].bits(units).mean(axis=0)
        assert balance.min() > 0.45 and balance.max() < 0.55


def test_no_rows_and_no_labels(spark):
    assert quantised.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 2.0], None), (2, None, 3)]
    assert found_of(quantised.near_vectors(spark.createDataFrame(rows, SCHEMA))) == [(1, 0, 1), (2, 0, 2)]


def test_query_equals_all_cosines(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in q.op11_quantised(spark, SF).collect()) == sorted(plain(rows))
