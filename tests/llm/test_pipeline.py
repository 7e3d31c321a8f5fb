"""Every stage of the pipeline against brute force on what the stage before kept."""

import os

import corpus_pipeline as pipeline
import numpy as np
from laptable.llm import packing
from laptable.llm.packing import encoder

import __spark_entry__ as entry

from .conftest import CLASHES, SF
from .test_near_dup import plain_components
from .test_text_rules import base_spans, counts, plain_dedup


def stages(spark, docs, folder):
    out = []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        out.append((docs, spark.read.parquet(f"{folder}/{name}")))
        docs = out[-1][1]
    return dict(zip([n for n, _ in pipeline.STAGES], out, strict=True))


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_do_what_they_say(spark, documents, tmp_path):
    done = stages(spark, documents, str(tmp_path))
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_dedup", "line_dedup", "secrets", "packing"]
    for name in list(done)[:-1]:
        assert done[name][1].columns == documents.columns and done[name][1].dtypes == documents.dtypes

    before, after = map(texts, done["quality_rules"])
    good = {i for i, t in before.items() if (c := counts(t))[0] >= 20 and 100 * c[4] <= 30 * c[0]}
    assert after == {i: before[i] for i in good}

    before, after = map(texts, done["near_dedup"])
    first = {i for i, (_, c) in plain_components(before.items(), 5).items() if i == c}
    assert after == {i: before[i] for i in first} and len(first) < len(before)

    before, after = map(texts, done["line_dedup"])
    expected = plain_dedup(list(before.items()))
    assert after == {i: expected[(i, t)][0] for i, t in before.items()} and after != before

    before, after = map(texts, done["secrets"])
    assert set(before) == set(after)
    for i, t in before.items():
        spans = base_spans(t)
        assert not base_spans(after[i]) and ("[SECRET]" in after[i]) >= bool(spans)
        assert after[i] == t or spans or "[SECRET]" in after[i]
    assert sum(after[i] != before[i] for i in before) <= sum(bool(base_spans(t)) for t in before.values()) + 2
    assert all(r["n_chars"] == len(r["text"]) for r in done["secrets"][1].collect())

    before, found = texts(done["packing"][0]), {}
    for r in sorted(done["packing"][1].collect(), key=lambda r: r["start"]):
        found.setdefault(r["doc_id"], []).extend(np.frombuffer(bytes.fromhex(r["ids"]), "<u2").tolist())
    tokenizer = encoder(packing.TOKENIZER).tokenizer
    assert found == {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in before.items()}


def test_stages_take_odd_rows_and_empty_tables(spark, odd, empty, tmp_path):
    for name, stage in pipeline.STAGES:
        for docs in (odd, empty):
            found = stage(spark, docs, SF)
            if name != "packing":
                assert found.columns == docs.columns and found.dtypes == docs.dtypes
                assert docs is empty or all(found.where(f"`{c}` <> 'clash'").isEmpty() for c in CLASHES)
            assert (found.count() == 0) == (docs is empty)


def test_registered_queries(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in queries
    assert {n for n in sql if n.startswith("op") and n[2].isdigit()} == {"op6_near_dup", "op7_quality", "op8_topk", "op10_line_dedup", "op11_quantised", "op13_hard_negatives"}
    assert pipeline.run(spark, SF).count() > 0


def test_queries_match_their_sql(spark):
    from checks.compare import check, database

    con = database(SF)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("op6_near_dup", "op7_quality", "op8_topk", "op10_line_dedup", "op11_quantised", "op13_hard_negatives"):
        text, good = check(spark, con, SF, name, queries[name], sql[name])
        assert good, text


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(pipeline.__file__))
    for folder in ("laptable", "checks", "tests"):
        for at, _, names in os.walk(os.path.join(root, folder)):
            if os.sep + "llm" not in at:
                assert not any("laptable.llm" in open(os.path.join(at, n)).read() for n in names if n.endswith(".py")), at
