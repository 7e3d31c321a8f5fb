"""Tasks and the driver hold bounded amounts, whatever the size of the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from laptable.models import layerwise as lw
from laptable.models import linear, preprocess
from laptable.models.preprocess import apply_preprocessor, fit_preprocessor
from laptable.session import tune


def test_a_long_vocabulary_is_solved_without_its_matrix(spark, monkeypatch):
    rows = spark.range(4000).select(
        F.concat(F.lit("D"), F.pmod(F.xxhash64("id"), F.lit(600))).alias("driver"), F.concat(F.lit("T"), F.pmod(F.xxhash64("id"), F.lit(600)) % 7).alias("team"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("C"), F.col("id") % 3)).alias("compound"),
        F.when(F.col("id") % 5 != 0, F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(1000)) / 100).alias("pace"), (F.col("id") % 17).cast("double").alias("age"),
        (F.pmod(F.xxhash64(F.col("id"), F.lit(2)), F.lit(997)) / 100).alias("_y"),
    )
    rows = rows.withColumn("driver_team", F.concat_ws("@", "driver", "team"))
    rows = rows.unionByName(rows.limit(1).withColumns({"driver": F.lit("RARE"), "driver_team": F.lit("RARE@T0")}))
    spec = fit_preprocessor(rows, ["pace", "age"], ["driver", "team", "driver_team", "compound"])
    assert spec.width > 1200 and spec.categories["driver"]["infrequent"]
    exact = linear.fit_ridge(apply_preprocessor(rows, spec), "_y")
    monkeypatch.setattr(linear, "DENSE_WIDTH", 100)
    monkeypatch.setattr(linear, "sparse_gram", None)
    assert np.allclose(linear.fit_sparse_ridge(rows, spec, "_y"), exact, rtol=1e-7, atol=1e-9)
    monkeypatch.setattr(linear, "MOST_STEPS", 1)
    with pytest.raises(ArithmeticError):
        linear.fit_sparse_ridge(rows, spec, "_y")


def test_shuffled_tables_are_read_in_bounded_tasks(spark):
    tune(spark)
    table = spark.range(8_000_000).select(F.xxhash64("id").alias("key"), F.xxhash64("id", F.lit(1)).alias("value")).repartition("key")  # 128 MB; the session has 4 partitions
    tasks = table.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 5 and max(r["count"] for r in tasks) <= 2_000_000


def test_track_status_splits_the_log_of_a_session(spark, tmp_path, monkeypatch):
    from checks import stream_queries
    from laptable.operators import intervals

    kinds = F.element_at(F.array(*[F.lit(k) for k in ("error", "signup", "purchase", "view")]), (F.col("id") % 4 + 1).cast("int"))
    spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1704067200 + F.col("id") * 300).cast("timestamp_ntz").alias("ts"), (F.col("id") % 5).alias("user_id"),
        kinds.alias("event_type"), (F.col("id") % 90 + 1).cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") * 37 % 101).alias("props"),
    ).write.parquet(str(tmp_path / "events.parquet"))
    asked, plain = [], intervals.OrderedGroups
    monkeypatch.setattr(intervals, "OrderedGroups", lambda df, keys, order, split=False: asked.append(split) or plain(df, keys, order, split))
    found = sorted(map(tuple, stream_queries.q_lap_status(spark, str(tmp_path)).collect()))
    assert asked and all(asked)
    monkeypatch.setattr(intervals, "OrderedGroups", lambda df, keys, order, split=False: plain(df, keys, order, False))
    assert found and found == sorted(map(tuple, stream_queries.q_lap_status(spark, str(tmp_path)).collect()))


def test_a_comparison_does_not_shuffle_laps_by_season(spark):
    from laptable.operators.compare import ProviderComparison
    from tests.conftest import make_laps

    laps = make_laps(spark, seasons=(2023, 2024)).repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ProviderComparison(laps, laps).merged()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    semi = [line for line in plan.splitlines() if "LeftSemi" in line and "#" in line and "season" in line]
    assert any("BroadcastHashJoin" in line for line in semi) and plan.count("BroadcastHashJoin") >= 2


def test_coded_rows_train_and_score_like_whole_ones(spark, monkeypatch):
    """F5, F6, F8, F9: a vocabulary longer than DENSE_WIDTH never becomes one-hot rows, with the same model."""
    rows = [(2024, f"GP_{i % 5}", "R", f"D{i % 40}", float(i), float(i % 13), f"D{i % 37}" if i % 9 else None, i * i % 23 / 7 - 1) for i in range(600)]
    table = spark.createDataFrame(rows, "season int, event string, session string, driver string, lap_number double, x double, code string, y double")
    spec = fit_preprocessor(table, ["x"], ["code", "event"])
    assert spec.width > 30
    config = lw.LayerConfig(layer_nodes=(12, 8), ordinal_groups=(4, 4), epochs_per_layer=3, batch_size=32, learning_rate=5e-3)
    unknown = table.where("lap_number < 50").withColumn("code", F.when(F.col("lap_number") < 25, "new").otherwise(F.col("code")))
    found = []
    for width in (spec.width, 0):
        monkeypatch.setattr(preprocess, "DENSE_WIDTH", width)
        train, test = (preprocess.feature_rows(t, spec) for t in (table, unknown))
        model = lw.fit_layerwise(train, "y", spec.width, config, ["driver", "lap_number"], None, 3)
        found.append((dict(train.dtypes)["features"], model, sorted(r[0] for r in lw.score_interval(test, model).select("residual").collect())))
    (whole, a, one), (coded, b, two) = found
    assert whole == "array<double>" and coded == "struct<values:array<double>,places:array<int>>"
    assert all(np.allclose(x, y, atol=1e-4) for x, y in zip(a.weights, b.weights)) and np.isclose(a.q80, b.q80, atol=1e-3)
    assert len(one) == 50 and np.allclose(one, two, atol=1e-3)


def test_medians_of_stored_rows_shuffle_only_values_near_them(spark, monkeypatch):
    """exact medians without a shuffle of all values, also where the sketch misses."""
    rows = spark.range(5000).select(
        (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1000).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).cast("double").alias("b"),
        F.lit(None).cast("double").alias("none"), F.when(F.col("id") < 2, F.col("id") * 3.0).when(F.col("id") < 9, F.lit(float("nan"))).alias("few"), F.lit(4).alias("same"),
    )
    names = ["a", "b", "none", "few", "same"]
    wanted = {r["feature"]: r["median"] for r in preprocess.numeric_medians(rows, names).collect()}
    monkeypatch.setattr(preprocess, "numeric_medians", None)
    found = preprocess.exact_medians(rows, names)
    assert found == pytest.approx(wanted) and set(found) == {"a", "b", "few", "same"} and found["few"] == 1.5
    assert preprocess.fit_preprocessor(rows, names, [], reread=True).medians == pytest.approx([wanted[n] for n in names if n != "none"])
    monkeypatch.undo()
    monkeypatch.setattr(preprocess, "NEAR", -0.3)  # bounds that hold nothing
    assert preprocess.exact_medians(rows, names) == pytest.approx(wanted)


def test_sums_of_long_columns_shuffle_one_row_per_combination(spark, monkeypatch):
    """a driver and a driver's team are summed together, not each row by row."""
    rows = spark.range(3000).select(F.concat(F.lit("D"), F.col("id") % 300).alias("driver"), F.concat(F.lit("X"), F.col("id") % 300 % 250).alias("other"), F.concat(F.lit("T"), F.col("id") % 5).alias("team"),
                                    (F.col("id") % 11).cast("double").alias("x"), (F.col("id") % 13).cast("double").alias("_y"))
    spec = fit_preprocessor(rows, ["x"], ["driver", "other", "team"])
    summed, plain = [], type(rows).groupingSets
    monkeypatch.setattr(type(rows), "groupingSets", lambda df, sets, *cols: summed.append((df, list(cols))) or plain(df, sets, *cols))
    design, dense = linear._design(rows, spec, "_y")
    levels = {r["at"]: r["sums"] for r in linear._level_rows(design, spec, len(dense) - 2).collect()}
    long = [df for df, cols in summed if cols == ["_c0", "_c1"]]
    assert len(long) == 1 and long[0].count() == 300
    places = preprocess.level_positions(spec)
    for column in ("driver", "other", "team"):
        for r in rows.groupBy(column).agg(F.count("x").alias("n"), F.sum("_y").alias("y")).collect():
            found = levels[places[column][r[column]] + 1]
            assert (found[0], found[-1]) == (r["n"], pytest.approx(r["y"]))


def test_a_comparison_shuffles_each_side_once(spark):
    """coverage and agreement read both sides in one aggregation by lap key."""
    from laptable.operators.compare import ProviderComparison
    from tests.conftest import make_laps

    laps = make_laps(spark, lambda r: r | {"driver": None if r["lap_number"] == 5 else r["driver"]}, drivers=("AAA", "BBB"), laps=8).repartition(3)
    other = laps.where("lap_number <> 4 or driver is null").withColumns({"position": F.col("position").cast("int"), "team": F.when(F.col("lap_number") != 7, F.col("team"))})
    other = other.unionByName(other.where("lap_number = 3 and driver = 'AAA'"))
    comparison = ProviderComparison(laps, other, ["season", "round_number", "session", "driver", "lap_number"])
    for found in (comparison.coverage(), comparison.merged(), comparison.agreement()):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sum("lap_number" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line) == 1
    row = comparison.coverage().first().asDict()
    # 2 drivers, 8 laps: the first is not compared, the fifth has no driver; the other side lacks the fourth and has one third lap twice.
    assert row == {"left_laps": 12, "right_laps": 9, "shared": 9, "left_only": 3, "right_only": 0, "left_duplicate_key": 0, "left_missing_key": 2,
                   "right_duplicate_key": 2, "right_missing_key": 2}
    agreed = {r["column"]: (r["both_present"], r["agree_share"]) for r in comparison.agreement().collect()}
    assert agreed["lap_time_s"] == (9, 1.0) and agreed["position"] == (9, 1.0) and agreed["team"] == (7, 1.0)


def test_a_whole_table_has_the_same_rows(spark):
    """conditions and columns chosen after ``unpruned`` find the rows they would find without it."""
    from pyspark.sql import Window

    from laptable.functions.groups import unpruned

    rows = spark.range(3000).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"), (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"))
    numbered = unpruned(rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v"))), unfiltered=True)
    both = numbered.where("a = 3 and k < 50").select("n", "a").unionByName(numbered.where("b = 2 and n > 4").select("n", F.col("b").alias("a")))
    found = sorted(map(tuple, both.collect()))
    plain = [(v // 100 + 1, v % 100, v % 7, v % 5) for v in range(3000)]
    assert found == sorted([(n, a) for n, k, a, b in plain if a == 3 and k < 50] + [(n, b) for n, k, a, b in plain if b == 2 and n > 4])
