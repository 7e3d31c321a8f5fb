"""Table-level questions: train, score, forecast, backtest, compare."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laptable.functions.groups import join_on, percentiles
from laptable.models.artifact import Artifact
from laptable.models.layerwise import LayerConfig, fine_tune, fit_layerwise, score_interval
from laptable.models.linear import fit_sparse_ridge, fit_tree, score_sparse_ridge, winsorize
from laptable.models.preprocess import apply_preprocessor, feature_rows, fit_preprocessor
from laptable.models.trees import score_trees, tree_table
from laptable.operators.features import assert_no_leakage, select_features
from laptable.operators.metrics import feature_coverage, interval_metrics, naive_predictions, regression_metrics
from laptable.operators.sessions import last_n_pairs, latest_forecast_row
from laptable.operators.splits import Band, replay_pool, seeded_sample, select_rows, without_rows
from laptable.plans.ledger import fingerprint, run_all, run_key
from laptable.schema import LAP_KEYS, LAP_VALIDITY_VERSION, PREDICTION_KEYS, PRIOR_GROUPS, RAW_TARGET, RUN_KEYS, TARGET
from laptable.session import shared_folder

TARGET_CLIP_S = 6.0
REPLAY_ROWS = 20_000


def choose_features(train: DataFrame, history: int = 5, drop: Iterable[str] = (), min_coverage: float = 0.05) -> dict[str, list[str]]:
    """Contract features without ablated groups and without columns almost never observed in
    the training rows."""
    chosen = select_features(train.columns, history, drop)
    assert_no_leakage(chosen["numeric"] + chosen["categorical"])
    kept = {r["feature"] for r in feature_coverage(train, chosen["numeric"], min_coverage).where("kept").collect()}  # one row per feature
    return {"numeric": [c for c in chosen["numeric"] if c in kept], "categorical": chosen["categorical"]}


def train_ridge(train: DataFrame, history: int = 5, drop: Iterable[str] = (), alpha: float = 2.0,
                clip: float = TARGET_CLIP_S) -> Artifact:
    """Ridge on the residual to the rolling median. Like all training it reads its rows many times: store them before."""
    contract = choose_features(train, history, drop)
    spec = fit_preprocessor(train, contract["numeric"], contract["categorical"], reread=True)
    rows = train.withColumn("_y", winsorize(F.col(TARGET), clip))
    return Artifact("ridge", fit_sparse_ridge(rows, spec, "_y", alpha), spec, contract | {"history": history, "lap_validity_version": LAP_VALIDITY_VERSION})


def train_layerwise(train: DataFrame, validation: DataFrame | None, config: LayerConfig, history: int = 5, drop: Iterable[str] = (),
                    clip: float = TARGET_CLIP_S, partitions: int | None = None) -> Artifact:
    contract = choose_features(train, history, drop)
    spec = fit_preprocessor(train, contract["numeric"], contract["categorical"], reread=True)
    rows = feature_rows(train, spec).withColumn(TARGET, winsorize(F.col(TARGET), clip))
    held = None if validation is None else feature_rows(validation, spec)
    model = fit_layerwise(rows, TARGET, spec.width, config, LAP_KEYS, held, partitions)
    return Artifact("layerwise", model, spec, contract | {"history": history, "lap_validity_version": LAP_VALIDITY_VERSION})


def fine_tune_rounds(base: Artifact, table: DataFrame, season: int, rounds: Band | tuple[int, int | None], sessions: list[str] | None = None,
                     validation: DataFrame | None = None, fallback_train_end: int | None = None, replay_rows: int = REPLAY_ROWS, seed: int = 42,
                     clip: float = TARGET_CLIP_S, epochs: int | None = None, learning_rate: float | None = None,
                     partitions: int | None = None) -> Artifact:
    """A layer-wise model continued on some rounds of a season.

    The readout also sees a sample of the rows the base was fitted on (its recorded splits, or the
    seasons up to ``fallback_train_end``), without the new rows. New and replayed targets are
    clipped like training targets, the interval is calibrated anew on the unclipped validation
    rows, and the new split is recorded on top of the base's.
    """
    if base.kind != "layerwise":
        raise ValueError("Only a layer-wise model can be fine-tuned")
    recorded, band = base.contract.get("split"), Band.of(rounds)
    new = select_rows(table, season, band, sessions)
    replay = seeded_sample(without_rows(replay_pool(table, recorded, sessions, fallback_train_end), new), replay_rows, seed)
    new, replay = (feature_rows(rows, base.preprocessor).withColumn(TARGET, winsorize(F.col(TARGET), clip)) for rows in (new, replay))
    held = None if validation is None else feature_rows(validation, base.preprocessor)
    model = fine_tune(base.model, new, TARGET, LAP_KEYS, replay, validation=held, epochs=epochs, learning_rate=learning_rate, partitions=partitions)
    first = recorded or (None if fallback_train_end is None else {"train_end": fallback_train_end})
    split = {"mode": "fine_tune_rounds", "season": season, "train_rounds": [band.low, band.high], "sessions": sessions, "base_split": first}
    return Artifact("layerwise", model, base.preprocessor, base.contract | {"split": split})


def train_tree(train: DataFrame, history: int = 5, clip: float = TARGET_CLIP_S, **settings) -> Artifact:
    """The tree baseline, its ensemble as a table of nodes."""
    contract = choose_features(train, history)
    spec = fit_preprocessor(train, contract["numeric"], contract["categorical"], reread=True)
    rows = apply_preprocessor(train, spec).withColumn("_y", winsorize(F.col(TARGET), clip))
    trees = tree_table(train.sparkSession, fit_tree(rows, "_y", **settings))
    return Artifact("tree", trees, spec, contract | {"history": history, "lap_validity_version": LAP_VALIDITY_VERSION})


def predict(rows: DataFrame, artifact: Artifact | None = None) -> DataFrame:
    """Add predicted_next_lap_s with its interval. Without an artifact the rolling median is
    the forecast; ridge and trees have no interval."""
    if artifact is None:
        return rows.withColumns({"predicted_next_lap_s": F.col("rolling_median_5"), "lower_80_s": F.lit(None).cast("double"),
                                 "upper_80_s": F.lit(None).cast("double"), "layer_disagreement_s": F.lit(None).cast("double")})
    missing = [c for c in artifact.contract["numeric"] + artifact.contract["categorical"] if c not in rows.columns]
    if missing:
        raise ValueError(f"The table lacks contract features {missing}")
    if artifact.kind in ("ridge", "tree"):
        if artifact.kind == "ridge":
            scored = score_sparse_ridge(rows, artifact.preprocessor, artifact.model)
        else:
            scored = score_trees(apply_preprocessor(rows, artifact.preprocessor), artifact.model)
        scored = scored.withColumns({c: F.lit(None).cast("double") for c in ("lower_80", "upper_80", "layer_disagreement")})
    else:
        scored = score_interval(feature_rows(rows, artifact.preprocessor), artifact.model)
    base = F.col("rolling_median_5")
    return scored.withColumns(
        {"predicted_next_lap_s": base + F.col("residual"), "lower_80_s": base + F.col("lower_80"), "upper_80_s": base + F.col("upper_80"),
         "layer_disagreement_s": F.col("layer_disagreement")}
    ).drop("features", "residual", "lower_80", "upper_80", "layer_disagreement")


def score_table(table: DataFrame, artifact: Artifact | None = None, season=None, rounds=None, sessions=None) -> DataFrame:
    """Predictions for a selection of a training feature table."""
    rows = predict(select_rows(table, season, rounds, sessions), artifact)
    keep = [c for c in [*PREDICTION_KEYS, "data_tier"] if c in rows.columns]
    return rows.select(
        *keep, F.col(RAW_TARGET).alias("actual_next_lap_s"), "predicted_next_lap_s", "lower_80_s", "upper_80_s", "layer_disagreement_s",
        F.col("rolling_median_5").alias("rolling5_baseline_s"), F.col("lap_time_s").alias("previous_lap_s"),
    )


def evaluate(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Point and interval metrics of scored rows."""
    keys = keys or ["model"]
    rows = predictions.withColumns(
        {"model": F.lit("model")} | {a: F.col(b) for a, b in (("actual", "actual_next_lap_s"), ("pred", "predicted_next_lap_s"), ("lower", "lower_80_s"), ("upper", "upper_80_s"))}
    )
    return join_on(regression_metrics(rows, keys), interval_metrics(rows, keys), keys)


CONTEXT = [
    "compound", "tyre_life", "stint", "position", "laps_in_segment", "track_temp_c", "air_temp_c", "humidity_pct", "wind_speed_ms",
    "wind_direction_deg", "rainfall", "gap_ahead_s", "gap_behind_s", "team", "circuit",
]


def forecast_next_lap(laps: DataFrame, table: DataFrame, artifact: Artifact | None = None, history: int = 5) -> DataFrame:
    """Forecast for the latest lap of every driver in every session, with the lap's context and
    historical values. ``status`` says why a driver has none. ``table`` is the inference table."""
    rows = latest_forecast_row(laps, table, history)
    scored = predict(rows.where("status = 'ok'"), artifact)
    columns = [c for c in [*CONTEXT, *PRIOR_GROUPS] if c in scored.columns]
    answers = scored.select(*RUN_KEYS, "predicted_next_lap_s", "lower_80_s", "upper_80_s", "layer_disagreement_s", F.col("rolling_median_5").alias("rolling5_baseline_s"), *columns)
    heads = rows.select(*RUN_KEYS, "last_lap", "last_lap_time_s", "laps_driven", "session_last_lap", "race_finished", "short_history", "status")
    return join_on(heads, answers, RUN_KEYS)


def backtest_session(table: DataFrame, artifact: Artifact | None = None, laps: int = 10) -> DataFrame:
    """Predicted and actual next laps of the last ``laps`` pairs of every driver and session."""
    rows = predict(last_n_pairs(table, laps), artifact)
    error = F.col("predicted_next_lap_s") - F.col(RAW_TARGET)
    return rows.select(
        *LAP_KEYS, F.col(RAW_TARGET).alias("actual_next_lap_s"), "predicted_next_lap_s", "lower_80_s", "upper_80_s",
        F.col("rolling_median_5").alias("rolling5_baseline_s"), F.col("lap_time_s").alias("previous_lap_s"), error.alias("error_s"), F.abs(error).alias("abs_error_s"),
        F.col(RAW_TARGET).between(F.col("lower_80_s"), F.col("upper_80_s")).alias("within_interval"), "compound", "tyre_life", "position",
    )


def backtest_summary(pairs: DataFrame, laps: DataFrame, table: DataFrame, split: bool = False) -> DataFrame:
    """One row per driver and session: errors, naive errors, laps driven, usable and skipped."""
    naive = pairs.groupBy(*RUN_KEYS).agg(
        F.avg(F.abs(F.col("previous_lap_s") - F.col("actual_next_lap_s"))).alias("previous_lap_mae_s"),
        F.avg(F.abs(F.col("rolling5_baseline_s") - F.col("actual_next_lap_s"))).alias("rolling5_mae_s"),
        F.avg(F.col("within_interval").cast("double")).alias("interval80_coverage"),
        F.avg("abs_error_s").alias("mae_s"), F.sqrt(F.avg(F.col("error_s") * F.col("error_s"))).alias("rmse_s"), F.avg("error_s").alias("signed_bias_s"),
        F.avg((F.col("abs_error_s") <= 0.5).cast("double")).alias("within_0_5s_share"), F.avg((F.col("abs_error_s") <= 1.0).cast("double")).alias("within_1s_share"),
        F.count(F.lit(1)).alias("rows"),
    )
    p90 = percentiles(pairs, RUN_KEYS, "abs_error_s", {"p90_ae_s": 0.9}, split)
    driven = laps.where("lap_time_s is not null").groupBy(*RUN_KEYS).agg(F.count(F.lit(1)).alias("laps_driven"))
    usable = table.where(F.col(RAW_TARGET).isNotNull()).groupBy(*RUN_KEYS).agg(F.count(F.lit(1)).alias("usable_lap_pairs"))
    out = join_on(join_on(join_on(naive, p90, RUN_KEYS), driven, RUN_KEYS), usable, RUN_KEYS)
    return out.withColumn("skipped_laps", F.greatest(F.col("laps_driven") - F.col("usable_lap_pairs"), F.lit(0)))


def compare_drivers(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Two drivers' backtests in the same session, side by side by lap."""
    keys = ["season", "event", "session", "lap_number"]
    values = ["actual_next_lap_s", "predicted_next_lap_s", "abs_error_s"]
    sides = [
        pairs.where(F.col("driver") == d).select(*keys, *[F.col(v).alias(f"{side}_{v}") for v in values]) for d, side in ((left, "left"), (right, "right"))
    ]
    return sides[0].join(sides[1], keys, "full")


def experiment_matrix(parts: DataFrame, layer_configs: dict[str, LayerConfig], ablate: Iterable[str] = (), history: int = 5,
                      seeds: Iterable[int] = (), ledger: str | None = None, trees: dict | None = None) -> DataFrame:
    """Naive forecasts, ridge, trees, the given layer configurations, one-group ablations and seed
    runs of the first configuration, all on one split. One row per run with its test errors.

    ``parts`` is a feature table with a ``split`` column; write it to storage before, every run
    reads it. Learned baselines are refitted on training and validation rows for the test.
    Runs are kept in ``ledger`` (a folder; else one in the shared folder): a matrix that was
    stopped goes on where it stopped. ``trees`` are settings other than the default ones.
    """
    spark = parts.sparkSession
    train, validation, test = (parts.where(F.col("split") == s) for s in ("train", "validation", "test"))
    both, table, settings = parts.where("split in ('train', 'validation')"), fingerprint(parts), dict(trees or {})

    def of(name: str, family: str, fit):
        return lambda: evaluate(score_table(test, fit())).withColumns({"model": F.lit(name), "family": F.lit(family)})

    key = lambda name, **what: run_key(name=name, table=table, history=history, rules=LAP_VALIDITY_VERSION, **what)
    naive = lambda: regression_metrics(naive_predictions(test, PREDICTION_KEYS), ["model"]).withColumn("family", F.lit("naive"))
    runs = [
        (key("naive"), naive),
        (key("ridge"), of("ridge", "baseline", lambda: train_ridge(both, history))),
        (key("trees", settings=settings), of("trees", "baseline", lambda: train_tree(both, history, **settings))),
    ]
    plans = [(name, config, ()) for name, config in layer_configs.items()]
    if plans:
        name, config, _ = plans[0]
        plans += [(f"{name} minus {g}", config, (g,)) for g in ablate]
        plans += [(f"{name} seed {s}", replace(config, seed=s), ()) for s in seeds]
    for name, config, drop in plans:
        fit = lambda config=config, drop=drop: train_layerwise(train, validation, config, history, drop)
        runs.append((key(name, config=asdict(config), drop=drop), of(name, "layerwise", fit)))
    return run_all(spark, ledger or f"{shared_folder(spark)}/ledger", runs)
