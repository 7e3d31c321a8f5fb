"""Top-k search against a full product; language identification on held-out documents."""

import math
import random
import zlib

import numpy as np
from laptable.llm import lang, topk
from laptable.llm import queries as q
from pyspark.sql import functions as F

from .conftest import SF


def plain_top(rows, k, scale):
    valid = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) and abs(x) < 2**26 / scale for x in v)]
    out = set()
    for i in sorted({i for i, _ in valid if i % 20 == 0}):
        for n, v in valid:
            if n == i:
                scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), m) for m, w in valid if m != i and len(w) == len(v))
                out |= {(i, r + 1, m, -s) for r, (s, m) in enumerate(scores[:k])}
    return out


def tops(found):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()}


def test_topk_equals_the_full_product(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "DATA_LEAF", 8)
    monkeypatch.setattr(topk, "QUERY_LEAF", 2)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(c % 3, 0.4) for c in range(i % 5, i % 5 + 6)]) for i in range(700)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(700, 900)]
    rows += [(1000, None), (1020, []), (1040, [None] * 6), (1060, [float("nan")] * 6), (1080, [float("inf")] * 6), (None, [1.0] * 6), (1100, [1.0, 2.0]), (1101, [3.0, 4.0]), (1120, [1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit("clash"))
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert tops(topk.top_k(docs, F.col("vec_id") % 20 == 0)) == plain_top(rounded, 20, 64)


def test_topk_edge_cases(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert tops(topk.top_k(few, F.col("vec_id") % 20 == 0)) == {(0, 1, 1, 64 * 128), (0, 2, 2, 64 * 128)}
    large = spark.createDataFrame([(0, [60_000.0, -9e5]), (1, [5e5, 7e5]), (2, [-1e6, -1e6]), (3, [2e7, 1.0])], "vec_id long, embedding array<double>")
    assert tops(topk.top_k(large, F.col("vec_id") % 20 == 0)) == plain_top([tuple(r) for r in large.collect()], 20, 64)


def test_cover_tree_holds_its_promises():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(500, 5)), np.zeros((100, 5))])
    order, nodes = topk.cover_tree(points, 16)
    assert sorted(order) == list(range(600))
    own = points[order]
    for n in nodes:
        run = own[n["start"] : n["stop"]]
        assert n["start"] == n["centre"] and topk._distances(run, own[n["centre"]]).max() <= n["radius"] + 1e-9
        if n["children"]:
            kids = nodes[n["child"] : n["child"] + n["children"]]
            assert kids["start"][0] == n["start"] and kids["stop"][-1] == n["stop"] and (kids["start"][1:] == kids["stop"][:-1]).all()


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = q.op2_lang(spark, folder).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    accepted = [r for r in held if not r["rejected"]]
    assert len(accepted) > 0.8 * len(held) and sum(r["lang_pred"] == r["lang"] for r in accepted) >= 0.98 * len(accepted)


def test_calibrated_rejection_tells_unlike_text(spark, documents):
    model = lang.train(documents, F.lit(True))
    docs = spark.createDataFrame([(1, "zqxj kvwz qqq xzzy jjkq wvxz " * 5), (2, "123 456 -- !!"), (3, None), (4, "")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in lang.identify(docs, model).collect()}
    assert found[1]["score"] < 0.999 and [found[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3
    assert all(found[i]["score"] == 0 and found[i]["rejected"] for i in (2, 3, 4))


def test_language_odd_rows(spark, odd, empty):
    found = lang.identify(odd.drop("lang_pred"), lang.train(odd, F.lit(True)), carry=("doc_id", "spans"))
    assert found.count() == odd.count() and found.columns == ["doc_id", "spans", "lang_pred", "score", "rejected"]
    assert lang.train(empty, F.lit(True)) is None
    assert {r["lang_pred"] for r in lang.identify(odd, None).collect()} == {"und"}
    assert lang.identify(empty, None).count() == 0
