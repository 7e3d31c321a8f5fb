"""The registered bootstrap rests on the operator's own number of draws."""

import inspect

from checks import report_queries
from laptable.operators.bootstrap import paired_bootstrap


def test_registered_bootstrap_takes_all_draws(spark):
    rows = [(1999, f"GP_{i % 4}", "R", f"D{i % 3}", float(i), 80.0, 80.1 + (i % 3) / 10, 80.3) for i in range(12)]
    names = "season int, event string, session string, driver string, lap_number double, actual double, pred_m double, pred_b double"
    aligned = spark.createDataFrame(rows, names)
    default = inspect.signature(paired_bootstrap).parameters["draws"].default
    kept = report_queries.aligned
    report_queries.aligned = lambda *_: aligned
    try:
        found = {r["kind"]: r["draws"] for r in report_queries.QUERIES["paired_bootstrap"](spark, "").collect()}
    finally:
        report_queries.aligned = kept
    # A draw in which no row or cluster has weight has no mean; with 12 of each that is about one in 160,000.
    assert default == 2000 and all(0.99 * default < n <= default for n in found.values()) and set(found) == {"row", "cluster"}


def test_weights_are_those_of_spark_hashes(spark):
    from pyspark.sql import functions as F

    from laptable.operators import bootstrap

    names = ["", "é", "D1", "GP_1234", "eight by", "a name of thirty-two bytes or more, then some"]
    rows = [(n if i % 7 else None, 1990 + i if i % 5 else None, i * 10**10 - 3, [i / 7, -0.0, None][i % 3], i % 2 == 0) for i, n in enumerate(names * 4)]
    kinds = {"t": "string", "y": "int", "l": "bigint", "d": "double", "b": "boolean"}
    table = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in kinds.items())).coalesce(1)
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(3), "draw", *kinds), 11)
    wanted = table.withColumn("i", F.monotonically_increasing_id()).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(50)))).select("i", "draw", bits.alias("u"))
    bounds, found = bootstrap.BOUNDS.tolist(), bootstrap.draw_weights(table.toPandas(), kinds, 3, 50)
    assert all(found[r["i"], r["draw"] - 1] == sum(r["u"] >= b for b in bounds) for r in wanted.collect())


def test_no_rows_give_no_interval(spark):
    names = "season int, event string, session string, driver string, lap_number double, actual double, pred_m double, pred_b double"
    rows = paired_bootstrap(spark.createDataFrame([], names), "m", "b", draws=5).collect()
    assert sorted(tuple(r) for r in rows) == [("cluster", None, None, 0), ("row", None, None, 0)]
