"""Queries over models and forecasts. Where SQL has a counterpart, the naive forecast is used."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import LAPS, laps
from checks.lap_queries import KEY_SQL, KEYS, UPTO_PACE, features, r6, s6
from checks.more_lap_queries import LAST
from laptable.models import layerwise, linear, preprocess
from laptable.operators import splits
from laptable.plans import forecast
from laptable.schema import LAP_KEYS, RAW_TARGET, TARGET
from laptable.session import stored

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


DELTA = "next_time - rolling_median_5"


@register(
    "winsorize_target",
    f"{UPTO_PACE} SELECT {KEY_SQL}, round(greatest(least({DELTA}, 2.0), -2.0), 6) + 0.0 AS clipped FROM usable WHERE has_target AND season <= 1998",
)
def q_clip(spark, folder):
    table = features(spark, folder, priors=[]).where("season <= 1998")
    return table.select(*KEYS, linear.winsorize(F.col(TARGET), 2.0).alias("clipped")).select(*KEYS, *r6("clipped"))


NUMERIC = ["lap_number", "laps_in_segment", "pace_trend_3", "track_temp_c", "wind_speed_ms"]
CATEGORICAL = ["driver_team", "compound", "track_status"]
STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(med, 6) AS median, round(avg(coalesce(v, med)), 6) AS mean, round(stddev_pop(coalesce(v, med)), 6) AS std, round(avg((v IS NULL)::INT), 6) AS gap_share FROM (SELECT {c} AS v, median({c}) OVER () AS med FROM t) GROUP BY med" for c in NUMERIC
)


@register("fit_preprocessor", f"{UPTO_PACE}, t AS (SELECT * FROM usable WHERE has_target AND season <= 1998) {STATS}")
def q_fit(spark, folder):
    train = features(spark, folder, priors=[]).where("season <= 1998")
    spec = preprocess.fit_preprocessor(train, NUMERIC, [])
    gaps = dict(zip(spec.indicators, spec.means[len(spec.numeric):]))
    rows = [(c, m, a, s, gaps.get(c, 0.0)) for c, m, a, s in zip(spec.numeric, spec.medians, spec.means, spec.stds)]
    return spark.createDataFrame(rows, "feature string, median double, mean double, std double, gap_share double").select("feature", *r6("median", "mean", "std", "gap_share"))


@register(
    "fit_preprocessor_categories",
    f"{UPTO_PACE}, t AS (SELECT *, driver || '@' || team AS driver_team FROM usable WHERE has_target AND season <= 1998) SELECT 'driver_team' AS feature, driver_team AS value, count(*) AS \"rows\", count(*) >= 2 AS frequent FROM t GROUP BY driver_team "
    "UNION ALL SELECT 'compound', compound, count(*), count(*) >= 2 FROM t GROUP BY compound UNION ALL SELECT 'track_status', coalesce(track_status, 'missing'), count(*), count(*) >= 2 FROM t GROUP BY 2",
)
def q_vocabulary(spark, folder):
    train = features(spark, folder, priors=[]).where("season <= 1998")
    return preprocess.category_counts(train, CATEGORICAL).withColumn("frequent", F.col("rows") >= preprocess.MIN_FREQUENCY)


def parts(spark, folder):
    """The feature table with all priors and a season split, stored once because models read it many times."""
    return splits.season_forward(stored(features(spark, folder)), 1998, 1999, 2000)


def of(table, name):
    return table.where(F.col("split") == name)


@register(
    "apply_preprocessor",
    f"{UPTO_PACE}, t AS (SELECT median(pace_trend_3) AS med FROM usable WHERE has_target AND season <= 1998), m AS (SELECT t.med, avg(coalesce(pace_trend_3, t.med)) AS a, stddev_pop(coalesce(pace_trend_3, t.med)) AS s FROM usable, t WHERE has_target AND season <= 1998 GROUP BY t.med) "
    f"SELECT {KEY_SQL}, round((coalesce(pace_trend_3, m.med) - m.a) / m.s, 6) + 0.0 AS trend, (compound = 'HARD')::INT::DOUBLE AS is_hard, (compound = 'SOFT')::INT::DOUBLE AS is_soft, 6::INT AS width FROM usable, m WHERE has_target AND season = 2000",
)
def q_apply(spark, folder):
    table = features(spark, folder, priors=[])
    spec = preprocess.fit_preprocessor(table.where("season <= 1998"), ["pace_trend_3", "track_temp_c"], ["compound"])
    encoded = preprocess.apply_preprocessor(table.where("season = 2000"), spec)
    cell = lambda i: F.get("features", i)
    return encoded.select(*KEYS, cell(0).alias("trend"), cell(3).alias("is_hard"), cell(5).alias("is_soft"), F.size("features").alias("width")).select(*KEYS, *r6("trend"), "is_hard", "is_soft", "width")


@register("fit_ridge")
def q_ridge(spark, folder):
    """Coefficients fitted on the training rows, one row each."""
    artifact = forecast.train_ridge(of(parts(spark, folder), "train"))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(artifact.model)], "position int, coefficient double")


@register("score_ridge")
def q_score_ridge(spark, folder):
    table = parts(spark, folder)
    artifact = forecast.train_ridge(table.where("split in ('train', 'validation')"))
    return forecast.evaluate(forecast.score_table(of(table, "test"), artifact))


@register("fit_tree")
def q_tree(spark, folder):
    table = parts(spark, folder)
    scored = forecast.predict(of(table, "test"), forecast.train_tree(of(table, "train")))
    error = F.abs(F.col("predicted_next_lap_s") - F.col(RAW_TARGET))
    return scored.groupBy("season").agg(F.avg(error).alias("mae_s"), F.count(F.lit(1)).alias("rows"))


CONFIG = layerwise.LayerConfig()
#: The published configurations; ablations and seed runs take the first.
CONFIGS = {
    "FFR-M": CONFIG,
    "FFR-S": layerwise.LayerConfig(layer_nodes=(256, 128), ordinal_groups=(8, 16)),
    "FFR-L": layerwise.LayerConfig(
        layer_nodes=(1024, 768, 512, 384, 256), ordinal_groups=(8, 16, 32, 64, 64), epochs_per_layer=120, batch_size=1024, learning_rate=6e-4,
        temperature=0.5, target_sigma_groups=1.0, ridge_alpha=3.0,
    ),
    "FFR-M-groups-coarse": layerwise.LayerConfig(ordinal_groups=(4, 8, 16, 32)),
    "FFR-M-groups-fine": layerwise.LayerConfig(ordinal_groups=(16, 32, 64, 64)),
    "FFR-M-random-layers": layerwise.LayerConfig(epochs_per_layer=0),
}
ABLATIONS = ["historical_numeric", "temporal_numeric", "static_categorical"]
SEEDS = [1, 2, 3]


def layer_artifact(spark, folder, table, config=CONFIG):
    return forecast.train_layerwise(of(table, "train"), of(table, "validation"), config)


@register("fit_layerwise")
def q_layers(spark, folder):
    """Loss per layer and epoch."""
    artifact = layer_artifact(spark, folder, parts(spark, folder))
    rows = [(h["layer"], h["epoch"], h["local_loss"]) for h in artifact.model.history]
    return spark.createDataFrame(rows, "layer int, epoch int, local_loss double")


@register("fit_readout")
def q_readout(spark, folder):
    """Readout over untrained layers, which needs no training loop."""
    from dataclasses import replace

    artifact = layer_artifact(spark, folder, parts(spark, folder), replace(CONFIG, epochs_per_layer=0))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(artifact.model.readout)], "position int, coefficient double")


@register("score_interval")
def q_score_interval(spark, folder):
    table = parts(spark, folder)
    return forecast.score_table(of(table, "test"), layer_artifact(spark, folder, table))


@register(
    "calibrate_interval",
    f"{UPTO_PACE} SELECT round(quantile_cont(abs({DELTA} - pace_spread_3_5), 0.8), 6) AS q80 FROM usable WHERE has_target AND season = 1999",
)
def q_calibrate(spark, folder):
    rows = features(spark, folder, priors=[]).where("season = 1999").withColumn("residual", F.col("pace_spread_3_5"))
    q80 = layerwise.calibrate_interval(rows, TARGET)
    return spark.createDataFrame([(q80,)], "q80 double").select(*r6("q80"))


@register("fine_tune")
def q_fine_tune(spark, folder):
    """Zero-shot against tuned error on later rounds, with replayed rows in the readout."""
    table = parts(spark, folder)
    base = layer_artifact(spark, folder, table)
    tuned = forecast.fine_tune_rounds(base, table, 2000, (1, 2), validation=of(table, "validation"), fallback_train_end=1998, seed=7)
    later = preprocess.feature_rows(splits.select_rows(table, 2000, (3, 4)), base.preprocessor)
    out = None
    for name, model in (("zero_shot", base.model), ("tuned", tuned.model)):
        scored = layerwise.score_interval(later, model)
        row = scored.groupBy(F.lit(name).alias("model")).agg(F.avg(F.abs(F.col("residual") - F.col(TARGET))).alias("mae_s"), F.count(F.lit(1)).alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


@register("experiment_matrix")
def q_matrix(spark, folder):
    return forecast.experiment_matrix(parts(spark, folder), CONFIGS, ablate=ABLATIONS, seeds=SEEDS).select("model", "family", "mae_s", "rmse_s", "p90_ae_s", "rows")


SCORED = "round(next_time, 6) AS actual_next_lap_s, round(rolling_median_5, 6) AS predicted_next_lap_s, round(lap_time_s, 6) AS previous_lap_s"


@register("score_table", f"{UPTO_PACE} SELECT {KEY_SQL}, {SCORED} FROM usable WHERE has_target AND season BETWEEN 1999 AND 2000 AND round_number >= 3 AND session = 'R'")
def q_score_table(spark, folder):
    out = forecast.score_table(features(spark, folder, priors=[]), None, (1999, 2000), splits.parse_rounds("3-"), ["R"])
    return out.select(*KEYS, *r6("actual_next_lap_s", "predicted_next_lap_s", "previous_lap_s"))


@register(
    "forecast_next_lap",
    f"{UPTO_PACE}, {LAST}, ends AS (SELECT season, event, session, max(last_lap) AS session_last_lap FROM last_laps GROUP BY ALL) "
    "SELECT l.season, l.event, l.session, l.driver, l.last_lap, CASE WHEN l.n < 2 THEN 'too_few_laps' WHEN u.lap_number IS NULL THEN 'not_usable' ELSE 'ok' END AS status, l.last_lap >= e.session_last_lap AS race_finished, "
    "CASE WHEN l.n >= 2 THEN round(u.rolling_median_5, 6) END AS predicted_next_lap_s, CASE WHEN l.n >= 2 THEN u.compound END AS compound, CASE WHEN l.n >= 2 THEN u.laps_in_segment END AS laps_in_segment "
    "FROM last_laps l JOIN ends e USING (season, event, session) LEFT JOIN usable u ON u.lap_valid AND u.season = l.season AND u.event = l.event AND u.session = l.session AND u.driver = l.driver AND u.lap_number = l.last_lap",
)
def q_forecast(spark, folder):
    table = features(spark, folder, priors=[], require_target=False)
    return forecast.forecast_next_lap(laps(spark, folder), table).select(
        "season", "event", "session", "driver", "last_lap", "status", "race_finished", *r6("predicted_next_lap_s"), "compound", "laps_in_segment"
    )


PAIRS = f"{UPTO_PACE}, pairs AS (SELECT *, abs(rolling_median_5 - next_time) AS ae, abs(lap_time_s - next_time) AS pe FROM usable WHERE has_target QUALIFY row_number() OVER (PARTITION BY season, event, session, driver ORDER BY lap_number DESC) <= 10)"


@register("backtest_session", f"{PAIRS} SELECT {KEY_SQL}, {SCORED}, round(rolling_median_5 - next_time, 6) + 0.0 AS error_s FROM pairs")
def q_backtest(spark, folder):
    out = forecast.backtest_session(features(spark, folder, priors=[], require_target=False), None, 10)
    return out.select(*KEYS, *r6("actual_next_lap_s", "predicted_next_lap_s", "previous_lap_s", "error_s"))


@register(
    "backtest_summary",
    f"{PAIRS}, d AS (SELECT season, event, session, driver, count(lap_time_s) AS n FROM laps GROUP BY ALL), u AS (SELECT season, event, session, driver, count(*) AS n FROM usable WHERE has_target GROUP BY ALL) "
    "SELECT p.season, p.event, p.session, p.driver, round(avg(ae), 6) AS mae_s, round(avg(pe), 6) AS previous_lap_mae_s, round(quantile_cont(ae, 0.9), 6) AS p90_ae_s, count(*) AS \"rows\", any_value(d.n) AS laps_driven, any_value(d.n) - any_value(u.n) AS skipped_laps "
    "FROM pairs p JOIN d USING (season, event, session, driver) JOIN u USING (season, event, session, driver) GROUP BY ALL",
)
def q_backtest_summary(spark, folder):
    table = features(spark, folder, priors=[], require_target=False)
    out = forecast.backtest_summary(forecast.backtest_session(table, None, 10), laps(spark, folder), table)
    return out.select("season", "event", "session", "driver", *r6("mae_s", "previous_lap_mae_s", "p90_ae_s"), "rows", "laps_driven", "skipped_laps")


@register(
    "compare_drivers",
    f"{PAIRS}, a AS (SELECT * FROM pairs WHERE driver = 'D1'), b AS (SELECT * FROM pairs WHERE driver = 'D2') SELECT coalesce(a.season, b.season) AS season, coalesce(a.event, b.event) AS event, coalesce(a.lap_number, b.lap_number) AS lap_number, "
    "round(a.ae, 6) AS left_abs_error_s, round(b.ae, 6) AS right_abs_error_s FROM a FULL JOIN b ON a.season = b.season AND a.event = b.event AND a.lap_number = b.lap_number",
)
def q_drivers(spark, folder):
    pairs = forecast.backtest_session(features(spark, folder, priors=[], require_target=False), None, 10)
    return forecast.compare_drivers(pairs, "D1", "D2").select("season", "event", "lap_number", *r6("left_abs_error_s", "right_abs_error_s"))
