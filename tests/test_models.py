"""Metrics, splits, preprocessing and models."""

from dataclasses import replace

import numpy as np
import pytest
from conftest import make_laps
from pyspark.sql import functions as F

from laptable.models import layerwise as lw
from laptable.models import linear
from laptable.models.artifact import Artifact, load_model, save_model
from laptable.models.preprocess import apply_preprocessor, fit_preprocessor
from laptable.operators import metrics, splits
from laptable.operators.bootstrap import paired_bootstrap, paired_summary
from laptable.operators.features import build_features
from laptable.plans import forecast
from laptable.schema import LAP_KEYS, TARGET

CONFIG = lw.LayerConfig(layer_nodes=(12, 8), ordinal_groups=(4, 4), epochs_per_layer=3, batch_size=32, learning_rate=5e-3)


@pytest.fixture(scope="module")
def parts(spark):
    laps = make_laps(spark, lambda r: r | {"compound": None if r["lap_number"] % 5 == 0 else r["compound"], "wind_speed_ms": None if r["lap_number"] == 3 else 2.0},
                     seasons=(2021, 2022, 2023, 2024), events=3, drivers=("AAA", "BBB", "CCC"))
    return splits.split_dispatch(build_features(laps, split=False), 2022, 2023, 2024).cache()


def of(df, name):
    return df.where(F.col("split") == name)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(80.0, 80.5, 79.0, 81.0), (81.0, 80.5, 80.0, 81.5), (82.0, 82.0, 81.8, 82.2), (83.0, 84.0, 83.5, 84.5), (None, 1.0, 0.0, 1.0)], "actual double, pred double, lower double, upper double")
    m = metrics.regression_metrics(df, [], False).first()
    assert (m["mae_s"], m["signed_bias_s"], m["rows"], m["median_ae_s"]) == (0.5, 0.25, 4, 0.5) and abs(m["p90_ae_s"] - 0.85) < 1e-12
    i = metrics.interval_metrics(df, []).first()
    assert i["interval80_coverage"] == 0.75 and abs(i["interval80_width_s"] - 1.225) < 1e-9
    flat = df.limit(4).withColumn("actual", F.lit(80.0))
    assert metrics.regression_metrics(flat, [], False).first()["r2"] is None
    with pytest.raises(ValueError, match="finite"):
        metrics.regression_metrics(df.where("false"), [], False, strict=True)


def test_alignment_refuses_double_predictions(spark):
    rows = [(1, "a", 1.0, 1.0), (1, "b", 1.0, 2.0), (2, "a", 1.0, 1.0)]
    long = spark.createDataFrame(rows, "lap int, model string, actual double, pred double")
    assert metrics.align_predictions(long, ["a", "b"], ["lap"]).count() == 1
    with pytest.raises(ValueError, match="more than one"):
        metrics.align_predictions(long.unionByName(long), ["a", "b"], ["lap"])


def test_split_arguments(parts):
    assert {r["split"] for r in parts.select("split").distinct().collect()} == {"train", "validation", "test"}
    table = parts.drop("split")
    assert splits.split_dispatch(table, 2022, 2023, 2024, holdout_event="GP_2").where("split = 'test'").select("event").distinct().collect()[0][0] == "GP_2"
    assert splits.split_dispatch(table, 2022, 2023, 2023, split_round=1).where("split = 'test' and round_number < 2").isEmpty()
    for bad in (dict(train_end=2023, validation=2023, test=2024), dict(train_end=1900, validation=2023, test=2024), dict(train_end=2022, validation=2023, test=2024, train_through_round=1),
                dict(train_end=2022, validation=2023, test=2024, holdout_event="GP_1", train_through_round=1), dict(train_end=2022, validation=2023, test=2023, split_round=2, train_through_round=3)):
        with pytest.raises(ValueError):
            splits.split_dispatch(table, **bad)
    assert [splits.parse_rounds(t) for t in ("1-5", "8-", "6", None, " ")] == [splits.Band(1, 5), splits.Band(8, None), splits.Band(6, 6), None, None]


def test_open_rounds_and_long_chains(spark):
    rows = spark.createDataFrame([(2020 + r // 100, r, "R") for r in range(1, 200)], "season int, round_number int, session string")
    assert splits.select_rows(rows, rounds=splits.parse_rounds("8-")).where("round_number in (8, 120, 199)").count() == 3
    assert splits.select_rows(rows, rounds=splits.parse_rounds("-5")).count() == 5
    with pytest.raises(ValueError):
        splits.parse_rounds("a-b")
    chain = {"train_end": 2020}
    for r in range(100, 160):
        chain = {"mode": "fine_tune_rounds", "season": 2021, "train_rounds": [r, r], "base_split": chain}
    assert splits.replay_pool(rows, chain).count() == 99 + 60
    circle = {"mode": "fine_tune_seasons", "train_seasons": [2020, 2020]}
    circle["base_split"] = circle
    with pytest.raises(ValueError, match="circle"):
        splits.replay_pool(rows, circle)


def test_sparse_ridge_equals_the_dense_one(parts):
    rows = of(parts, "train").withColumn("_y", F.col(TARGET))
    spec = fit_preprocessor(rows, ["lap_time_s", "pace_trend_3", "track_temp_c"], ["driver", "compound", "event"])
    dense = apply_preprocessor(rows, spec)
    assert np.allclose(linear.sparse_gram(rows, spec, "_y"), linear.gram(dense, "_y"))
    coefficients = linear.fit_sparse_ridge(rows, spec, "_y")
    assert np.allclose(coefficients, linear.fit_ridge(dense, "_y"))
    test = of(parts, "test").withColumn("driver", F.lit("NEW")).unionByName(of(parts, "test"))
    scored = [sorted(r[0] for r in s.select("residual").collect()) for s in (linear.score_sparse_ridge(test, spec, coefficients), linear.score_ridge(apply_preprocessor(test, spec), coefficients))]
    assert np.allclose(*scored)


def test_replay_follows_the_chain(parts):
    chain = {"mode": "fine_tune_rounds", "season": 2024, "train_rounds": [1, 1], "base_split": {"train_end": 2021}}
    pool = splits.replay_pool(parts, chain)
    assert {(r["season"], r["round_number"]) for r in pool.select("season", "round_number").distinct().collect()} == {(2021, 1), (2021, 2), (2021, 3), (2024, 1)}
    assert splits.replay_pool(parts, None, fallback_train_end=2021).where("season > 2021").isEmpty()
    a, b = (splits.seeded_sample(pool, 20, 7).select(*LAP_KEYS).collect() for _ in range(2))
    assert a == b and len(a) == 20
    assert splits.without_rows(pool, pool.where("season = 2024")).where("season = 2024").isEmpty()


def test_preprocessor_matches_numpy(parts):
    train = of(parts, "train")
    spec = fit_preprocessor(train, ["pace_trend_3", "lap_number", "gap_ahead_s"], ["compound", "driver"], False)
    assert spec.numeric == ["pace_trend_3", "lap_number"] and spec.indicators == ["pace_trend_3"] and spec.categories["compound"]["frequent"] == ["HARD", "MEDIUM", "missing"]
    rows = apply_preprocessor(train, spec).select("features", "pace_trend_3", "lap_number").collect()
    x = np.array([r["features"] for r in rows])
    raw = np.array([[np.nan if v is None else v for v in (r["pace_trend_3"], r["lap_number"])] for r in rows])
    median = np.nanmedian(raw, axis=0)
    filled = np.where(np.isnan(raw), median, raw)
    assert np.allclose(x[:, :2], (filled - filled.mean(0)) / filled.std(0)) and x.shape[1] == spec.width
    assert np.allclose(x[:, :3].std(0), 1) and np.allclose(x[:, 3:6].sum(1), 1)
    unknown = apply_preprocessor(train.limit(1).withColumn("driver", F.lit("ZZZ")), spec).first()["features"]
    assert sum(unknown[6:]) == 0


def test_ridge_matches_closed_form(parts):
    train = of(parts, "train")
    spec = fit_preprocessor(train, ["pace_trend_3", "lap_number", "lap_delta_to_rolling5"], ["driver"], False)
    rows = apply_preprocessor(train, spec)
    got = linear.fit_ridge(rows, TARGET, 2.0)
    data = rows.select("features", TARGET).collect()
    x, y = np.array([r[0] for r in data]), np.array([r[1] for r in data])
    centred = x - x.mean(0)
    coefficients = np.linalg.solve(centred.T @ centred + 2.0 * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    assert np.allclose(got[1:], coefficients) and np.isclose(got[0], y.mean() - x.mean(0) @ coefficients)
    scored = linear.score_ridge(rows, got).select("residual", "features").collect()
    assert np.allclose([r[0] for r in scored], [np.dot(r[1], got[1:]) + got[0] for r in scored])
    with pytest.raises(ValueError):
        linear.winsorize(F.col(TARGET), 0)


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 5)), rng.uniform(-1, 1, 7)
    w = rng.normal(size=(6, 8)) * 0.5
    _, g = lw.loss_and_gradient(x, y, w, 4, CONFIG)
    for i, j in [(0, 0), (1, 3), (5, 7), (3, 2)]:
        step = np.zeros_like(w)
        step[i, j] = 1e-6
        numeric = (lw.loss_and_gradient(x, y, w + step, 4, CONFIG)[0] - lw.loss_and_gradient(x, y, w - step, 4, CONFIG)[0]) / 2e-6
        assert abs(numeric - g[i, j]) < 1e-6


def test_layers_train_alone_and_learn(parts):
    artifact = forecast.train_layerwise(of(parts, "train"), of(parts, "validation"), CONFIG, partitions=2)
    losses = {(h["layer"], h["epoch"]): h["local_loss"] for h in artifact.model.history}
    assert losses[1, 3] < losses[1, 1] and losses[2, 3] < losses[2, 1]
    fresh = lw.LayerModel.initial(artifact.preprocessor.width, CONFIG)
    assert not np.allclose(artifact.model.weights[0], fresh.weights[0])
    metrics_ = forecast.evaluate(forecast.score_table(of(parts, "test"), artifact)).first()
    baseline = forecast.evaluate(forecast.score_table(of(parts, "test"), None)).first()
    assert metrics_["mae_s"] <= baseline["mae_s"] * 1.1 and 0 <= metrics_["interval80_coverage"] <= 1


def test_zero_epochs_do_not_depend_on_partitions(parts):
    config = replace(CONFIG, epochs_per_layer=0)
    models = [forecast.train_layerwise(of(parts, "train"), of(parts, "validation"), config, partitions=n).model for n in (1, 3)]
    assert np.allclose(models[0].readout, models[1].readout) and np.isclose(models[0].q80, models[1].q80)


def test_weights_depend_on_shards_and_rows_alone(spark, parts):
    """Arrow batches, partitions and the order of rows change nothing; blocks keep whole mini-batches."""
    spec = fit_preprocessor(of(parts, "train"), ["lap_time_s", "pace_trend_3"], ["driver"])
    rows = apply_preprocessor(of(parts, "train"), spec).select("features", TARGET, *LAP_KEYS)
    config = replace(CONFIG, batch_size=4)
    found = []
    for records, n in ((10_000, 1), (7, 5)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
        blocks = lw.prepared_rows(rows.repartition(n), TARGET, LAP_KEYS, config, 3)
        sizes = [r["rows"] for r in blocks.select("shard", "number", "rows").orderBy("shard", "number").collect()]
        model = lw.LayerModel.initial(spec.width, config)
        lw.fit_target_scale(model, rows, TARGET, False)
        found.append((sizes, lw.train_layers(model, blocks, local_epochs=2)))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    (a, one), (b, two) = found
    assert a == b and sum(a) == rows.count() and max(a) == 64
    assert all(np.allclose(x, y) for x, y in zip(one.weights, two.weights)) and [h["epoch"] for h in one.history] == [1, 2, 3, 1, 2, 3]
    assert np.allclose([h["local_loss"] for h in one.history], [h["local_loss"] for h in two.history])


def test_one_shard_is_a_sequential_run(parts):
    """With one shard the averages change nothing, so moments and weights go on as in one long run."""
    spec = fit_preprocessor(of(parts, "train"), ["lap_time_s"], ["driver"])
    rows = apply_preprocessor(of(parts, "train"), spec).select("features", TARGET, *LAP_KEYS)
    blocks = lw.prepared_rows(rows, TARGET, LAP_KEYS, CONFIG, 1)
    models = []
    for local in (1, 3):
        model = lw.LayerModel.initial(spec.width, CONFIG)
        lw.fit_target_scale(model, rows, TARGET, False)
        models.append(lw.train_layers(model, blocks, local_epochs=local))
    assert all(np.allclose(x, y, atol=1e-6) for x, y in zip(models[0].weights, models[1].weights))


def test_fine_tune_and_save(spark, parts, tmp_path):
    base = forecast.train_layerwise(of(parts, "train"), None, CONFIG, partitions=2)
    rows = apply_preprocessor(of(parts, "validation"), base.preprocessor)
    only_readout = lw.fine_tune(base.model, rows, TARGET, LAP_KEYS, epochs=0)
    assert all(np.array_equal(a, b) for a, b in zip(base.model.weights, only_readout.weights)) and not np.allclose(base.model.readout, only_readout.readout)
    tuned = lw.fine_tune(base.model, rows, TARGET, LAP_KEYS, replay=rows.limit(5), epochs=1, learning_rate=1e-3, partitions=2)
    assert not np.allclose(tuned.weights[0], base.model.weights[0]) and tuned.history[-1]["phase"] == "finetune"
    for bad in (dict(epochs=-1), dict(learning_rate=0.0)):
        with pytest.raises(ValueError):
            lw.fine_tune(base.model, rows, TARGET, LAP_KEYS, **bad)
    saved = Artifact("layerwise", tuned, base.preprocessor, base.contract, {"note": 1})
    save_model(spark, saved, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    test = of(parts, "test")
    a, b = (forecast.score_table(test, m).orderBy(*LAP_KEYS).collect() for m in (saved, back))
    assert np.allclose([r["predicted_next_lap_s"] for r in a], [r["predicted_next_lap_s"] for r in b]) and back.rules_match
    ridge = forecast.train_ridge(of(parts, "train"))
    save_model(spark, ridge, str(tmp_path / "r"))
    assert np.allclose(load_model(spark, str(tmp_path / "r")).model, ridge.model)
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "nothing"))


def test_fine_tuning_clips_recalibrates_and_records(spark, parts, tmp_path):
    base = forecast.train_layerwise(of(parts, "train"), None, CONFIG, partitions=2)
    wild = parts.withColumn(TARGET, F.when((F.col("season") == 2023) & (F.col("round_number") == 1), F.lit(500.0)).otherwise(F.col(TARGET)))
    options = dict(validation=of(parts, "validation"), fallback_train_end=2022, epochs=0, partitions=2)
    tuned = forecast.fine_tune_rounds(base, wild, 2023, (1, 1), **options)
    capped = forecast.fine_tune_rounds(base, wild.withColumn(TARGET, F.least(TARGET, F.lit(forecast.TARGET_CLIP_S))), 2023, (1, 1), **options)
    assert np.allclose(tuned.model.readout, capped.model.readout) and tuned.model.q80 != base.model.q80
    again = forecast.fine_tune_rounds(tuned, parts, 2023, splits.Band(2, None), **options)
    assert again.contract["split"]["train_rounds"] == [2, None] and again.contract["split"]["base_split"] == tuned.contract["split"]
    save_model(spark, again, str(tmp_path / "t"))
    chain = load_model(spark, str(tmp_path / "t")).contract["split"]
    assert splits.replay_pool(parts, chain).count() == parts.where("season <= 2023").count()
    with pytest.raises(ValueError, match="layer-wise"):
        forecast.fine_tune_rounds(Artifact("ridge", np.zeros(2), base.preprocessor, {}), parts, 2023, (1, 1))


def test_configuration_is_checked():
    for bad in (dict(layer_nodes=(8,), ordinal_groups=(4,)), dict(layer_nodes=(9, 8), ordinal_groups=(4, 4)), dict(layer_nodes=(8, 8), ordinal_groups=(4,))):
        with pytest.raises(ValueError):
            lw.LayerConfig(**bad)


def test_bootstrap(spark):
    rows = [(2024, f"GP_{i % 4}", "R", f"D{i % 5}", float(i), 80.0, 80.1 + (i % 3) / 10, 80.3) for i in range(400)]
    df = spark.createDataFrame(rows, "season int, event string, session string, driver string, lap_number double, actual double, pred_a double, pred_b double")
    summary = paired_summary(df, "a", "b").first()
    assert summary["rows"] == 400 and summary["clusters"] == 20 and abs(summary["mean_diff_s"] - (-0.1002)) < 1e-3
    for r in paired_bootstrap(df, "a", "b", 300, 1).collect():
        assert r["low"] < summary["mean_diff_s"] < r["high"] and r["high"] - r["low"] < 0.06 and r["draws"] == 300
    with pytest.raises(ValueError):
        paired_bootstrap(df, "a", "b", 0)
