"""Forecast metrics and error reports. Predictions are in long form: one row per lap and model
with ``actual``, ``pred`` and, where there is an interval, ``lower`` and ``upper``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laptable.functions.coerce import condition_bands
from laptable.functions.groups import count_if, join_on, percentiles
from laptable.schema import PREDICTION_KEYS, RAW_TARGET

MIN_ROWS_PER_KEY = 20
MIN_ROWS_PER_CONDITION = 30
TIE_S = 0.01
LARGE_ERROR_S = 5.0


def finite(column: str) -> Column:
    value = F.col(column)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def _errors(df: DataFrame) -> DataFrame:
    return df.where(finite("actual") & finite("pred")).withColumns(
        {"_e": F.col("pred") - F.col("actual"), "_ae": F.abs(F.col("pred") - F.col("actual"))}
    )


def _moments() -> list[Column]:
    """Everything except the percentiles: partial sums that combine map-side. R2 needs the
    truth's spread, which ``var_pop`` merges without a second pass."""
    squared = F.sum(F.col("_e") * F.col("_e"))
    spread = F.count(F.lit(1)) * F.var_pop("actual")
    return [
        F.avg("_ae").alias("mae_s"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse_s"),
        F.avg("_e").alias("signed_bias_s"),
        F.avg((F.col("_ae") <= 0.5).cast("double")).alias("within_0_5s_share"),
        F.avg((F.col("_ae") <= 1.0).cast("double")).alias("within_1s_share"),
        (100 * F.avg(F.col("_ae") / F.greatest(F.abs("actual"), F.lit(1e-9)))).alias("mape_pct"),
        F.when(spread > 0, 1 - squared / spread).alias("r2"),
        F.count(F.lit(1)).alias("rows"),
    ]


METRIC_NAMES = ["mae_s", "rmse_s", "median_ae_s", "p90_ae_s", "signed_bias_s", "within_0_5s_share", "within_1s_share", "mape_pct", "r2", "rows"]


def regression_metrics(df: DataFrame, keys: list[str], split: bool = True, strict: bool = False) -> DataFrame:
    """Point-forecast metrics per group; rows with a non-finite value are left out. Groups such as a
    model or the whole table have no bound, so percentiles are taken with ``split``."""
    errors = _errors(df).withColumn("_all", F.lit(0))
    group = keys or ["_all"]
    points = percentiles(errors, group, "_ae", {"median_ae_s": 0.5, "p90_ae_s": 0.9}, split)
    sums = errors.groupBy(*group).agg(*_moments())
    out = join_on(sums, points, group, "inner").select(*keys, *METRIC_NAMES)
    if strict and out.where("rows > 0").isEmpty():
        raise ValueError("No finite rows to score")
    return out


def interval_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage and mean width of the interval per group."""
    usable = df.where(finite("actual") & finite("lower") & finite("upper"))
    inside = F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")
    return usable.groupBy(*keys).agg(
        F.avg(inside).alias("interval80_coverage"), F.avg(F.col("upper") - F.col("lower")).alias("interval80_width_s")
    )


def naive_predictions(table: DataFrame, keep: list[str]) -> DataFrame:
    """The two forecasts that need no training, in long form: the previous lap and the rolling
    median of five."""
    scored = table.where(F.col(RAW_TARGET).isNotNull()).select(*keep, F.col(RAW_TARGET).alias("actual"), F.col("lap_time_s").alias("previous_lap"), "rolling_median_5")
    return scored.unpivot([*keep, "actual"], ["previous_lap", "rolling_median_5"], "model", "pred")


def metrics_by_key(df: DataFrame, keys: list[str], min_rows: int = MIN_ROWS_PER_KEY, split: bool = True) -> DataFrame:
    return regression_metrics(df, keys, split).where(F.col("rows") >= min_rows)


def align_predictions(long: DataFrame, models: list[str], keys: list[str] | None = None, strict: bool = True) -> DataFrame:
    """One row per lap with one ``pred_<model>`` column per model, for laps all models scored.
    With ``strict`` a lap scored twice by one model is an error."""
    keys = keys or PREDICTION_KEYS
    wide = long.where(F.col("model").isin(models)).groupBy(*keys).agg(
        F.max("actual").alias("actual"),
        F.count(F.lit(1)).alias("_n"),
        *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(f"pred_{m}") for m in models],
        *[count_if(F.col("model") == m).alias(f"_n_{m}") for m in models],
    )
    counts = [f"_n_{m}" for m in models]
    if strict:
        twice = wide.where(F.greatest(*counts, F.lit(0)) > 1).limit(1)
        if not twice.isEmpty():
            raise ValueError("A model has more than one prediction for a lap")
    for c in counts:
        wide = wide.where(F.col(c) > 0)
    return wide.drop("_n", *counts)


def with_condition_bands(table: DataFrame) -> DataFrame:
    """Feature table with its condition labels; the race length is the table's last lap of the
    event, from an aggregate joined back."""
    length = table.groupBy("season", "event").agg(F.max("lap_number").alias("_length"))
    out = join_on(table, length, ["season", "event"])
    return out.withColumns(condition_bands(F.col("_length"))).drop("_length")


DIMENSIONS = ["circuit", "team", "compound", "tyre_age", "conditions", "race_phase", "running_position", "clean_lap_depth", "data_tier"]


def condition_breakdown(rows: DataFrame, models: list[str], dimensions: list[str] | None = None,
                        min_rows: int = MIN_ROWS_PER_CONDITION) -> DataFrame:
    """Mean absolute error per model for every value of every dimension.

    ``rows``: aligned predictions with the dimension columns. One row per (dimension, value)
    pair is produced map-side, so all dimensions share one small shuffle. Dimensions with a
    single value and groups below ``min_rows`` are left out; the best model is marked.
    """
    dimensions = dimensions or DIMENSIONS
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    errors = {m: F.abs(F.col(f"pred_{m}") - F.col("actual")) for m in models}
    long = rows.select(pairs.alias("_d"), *[e.alias(f"_ae_{m}") for m, e in errors.items()])
    groups = long.groupBy("_d.dimension", "_d.value").agg(F.count(F.lit(1)).alias("rows"), *[F.avg(f"_ae_{m}").alias(f"mae_{m}") for m in models])
    varied = groups.where(F.col("value").isNotNull()).groupBy("dimension").agg(F.count(F.lit(1)).alias("_values")).where("_values > 1")
    kept = groups.join(varied.select("dimension"), "dimension", "left_semi").where(F.col("rows") >= min_rows)
    best = F.least(*[F.col(f"mae_{m}") for m in models]) if len(models) > 1 else F.col(f"mae_{models[0]}")
    marked = F.filter(F.array(*[F.when(F.col(f"mae_{m}") == best, F.lit(m)) for m in models]), lambda m: m.isNotNull())
    return kept.withColumn("best_model", F.get(marked, 0))


def robustness_breakdown(rows: DataFrame, dimensions: list[str], q80: float, min_rows: int = MIN_ROWS_PER_KEY,
                         split: bool = True) -> DataFrame:
    """Per value of each dimension: rows, errors of the model and both naive forecasts, p90,
    coverage, bias, how often the model beats the previous lap, near-ties, and how often the
    layer disagreement widened the interval. ``rows``: actual, pred, lower, upper,
    disagreement, previous_lap, rolling_median_5 and the dimensions."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    ae, prev = F.abs(F.col("pred") - F.col("actual")), F.abs(F.col("previous_lap") - F.col("actual"))
    long = rows.select(
        pairs.alias("_d"), ae.alias("_ae"), prev.alias("_prev"), F.abs(F.col("rolling_median_5") - F.col("actual")).alias("_r5"),
        F.col("actual").between(F.col("lower"), F.col("upper")).cast("double").alias("_in"), (F.col("pred") - F.col("actual")).alias("_e"),
        (F.col("disagreement") > q80).cast("double").alias("_wide"),
    ).select("_d.dimension", "_d.value", "_ae", "_prev", "_r5", "_in", "_e", "_wide")
    keys = ["dimension", "value"]
    sums = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("_ae").alias("mae_s"), F.avg("_prev").alias("previous_lap_mae_s"), F.avg("_r5").alias("rolling5_mae_s"),
        F.avg("_in").alias("coverage"), F.avg("_e").alias("bias_s"), F.avg((F.col("_ae") < F.col("_prev")).cast("double")).alias("beat_share"),
        F.avg((F.abs(F.col("_ae") - F.col("_prev")) < TIE_S).cast("double")).alias("tie_share"), F.avg("_wide").alias("widened_share"),
    ).where(F.col("rows") >= min_rows)
    points = percentiles(long, keys, "_ae", {"median_ae_s": 0.5, "p90_ae_s": 0.9, "p99_ae_s": 0.99}, split)
    return join_on(sums, points, keys, "inner")


def generalization_gap(scored: DataFrame) -> DataFrame:
    """Train, validation and test error per model and the test-minus-train gap.
    ``scored``: model, split, actual, pred."""
    errors = _errors(scored)
    parts = errors.groupBy("model").agg(*[
        aggregate
        for s in ("train", "validation", "test")
        for aggregate in (
            F.avg(F.when(F.col("split") == s, F.col("_ae"))).alias(f"{s}_mae_s"),
            F.sqrt(F.avg(F.when(F.col("split") == s, F.col("_e") * F.col("_e")))).alias(f"{s}_rmse_s"),
        )
    ])
    return parts.withColumn("gap_mae_s", F.col("test_mae_s") - F.col("train_mae_s"))


def season_errors(scored: DataFrame) -> DataFrame:
    """Error per model, season and split with the share of large errors."""
    return _errors(scored).groupBy("model", "season", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("_ae").alias("mae_s"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse_s"),
        F.avg((F.col("_ae") > LARGE_ERROR_S).cast("double")).alias("share_over_5s"),
    )


def worst_errors(rows: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The ``n`` largest absolute errors with their context: a top-n per partition, merged."""
    keys = keys or PREDICTION_KEYS
    return rows.withColumn("abs_error_s", F.abs(F.col("pred") - F.col("actual"))).orderBy(F.col("abs_error_s").desc_nulls_last(), *keys).limit(n)


def rescore_diff(stored: DataFrame, computed: DataFrame, keys: list[str] | None = None, thresholds: tuple[float, float] = (0.05, 0.2)) -> DataFrame:
    """Compare stored predictions with recomputed ones on the lap key."""
    keys = keys or PREDICTION_KEYS
    a = stored.select(*keys, F.col("pred").alias("_a"), F.lit(True).alias("_in_a"))
    b = computed.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("pred").alias("_b"), F.lit(True).alias("_in_b"))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    diff = F.abs(F.col("_a") - F.col("_b"))
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return a.join(b, on, "full").agg(
        count_if(both).alias("matched"), count_if(F.col("_in_b").isNull()).alias("stored_only"), count_if(F.col("_in_a").isNull()).alias("computed_only"),
        F.avg(diff).alias("mean_abs_diff_s"), F.max(diff).alias("max_abs_diff_s"),
        F.avg((diff > thresholds[0]).cast("double")).alias("share_over_low"), F.avg((diff > thresholds[1]).cast("double")).alias("share_over_high"),
    )


def unseen_categories(rows: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Flag rows whose value of a column never occurs in training. The known values are
    joined as one row each; AQE broadcasts them when they are few."""
    for c in columns:
        known = train.select(c).distinct().withColumn(f"_known_{c}", F.lit(True))
        rows = join_on(rows, known, [c]).withColumn(f"unseen_{c}", F.col(f"_known_{c}").isNull()).drop(f"_known_{c}")
    return rows


def run_summary(runs: DataFrame, recomputed: DataFrame | None = None) -> DataFrame:
    """Result table of all runs (flattened run records): test errors with tolerance shares
    taken from predictions where a record lacks them; the best test MAE is marked.
    ``recomputed``: run, within_0_5s_share, within_1s_share."""
    out = runs.select(
        "run", "model", "method", F.col("validation.mae_s").alias("validation_mae_s"), F.col("test.mae_s").alias("test_mae_s"),
        F.col("test.rmse_s").alias("test_rmse_s"), F.col("test.p90_ae_s").alias("test_p90_ae_s"),
        F.col("test.within_0_5s_share").alias("within_0_5s_share"), F.col("test.within_1s_share").alias("within_1s_share"),
        F.col("test.interval80_coverage").alias("interval80_coverage"),
    )
    if recomputed is not None:
        extra = recomputed.select("run", F.col("within_0_5s_share").alias("_w05"), F.col("within_1s_share").alias("_w1"))
        out = out.join(extra, "run", "left").withColumns(
            {"within_0_5s_share": F.coalesce("within_0_5s_share", "_w05"), "within_1s_share": F.coalesce("within_1s_share", "_w1")}
        ).drop("_w05", "_w1")
    best = out.agg(F.min("test_mae_s").alias("test_mae_s")).withColumn("is_best", F.lit(True))
    return out.join(F.broadcast(best), "test_mae_s", "left").withColumn("is_best", F.coalesce("is_best", F.lit(False)))


def seed_spread(runs: DataFrame, metrics: list[str], headline: Column) -> DataFrame:
    """Mean and population standard deviation of each metric over the swept seeds."""
    swept = runs.where(~headline)
    long = swept.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")
    return long.where(F.col("value").isNotNull()).groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n")
    )


def describe_split(df: DataFrame) -> DataFrame:
    """Rows, seasons, events, and rows per tier of every split. Counts per (split, season,
    event, tier) come first, so the lists are built from distinct values only."""
    cells = df.groupBy("split", "season", "round_number", "event", "data_tier").agg(F.count(F.lit(1)).alias("n"))
    tiers = cells.groupBy("split", "data_tier").agg(F.sum("n").alias("n")).groupBy("split").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "data_tier", F.col("n").cast("string")))), ",").alias("tiers")
    )
    rounds = cells.where("round_number is not null").select("split", "season", "round_number").distinct().groupBy("split").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", F.col("season").cast("string"), F.col("round_number").cast("string")))), ",").alias("rounds")
    )
    main = cells.groupBy("split").agg(
        F.sum("n").alias("rows"), F.array_sort(F.collect_set(F.col("season").cast("int"))).alias("seasons"),
        F.count_distinct("season", "event").alias("events"),
    )
    return main.join(rounds, "split", "left").join(tiers, "split", "left")


def feature_coverage(df: DataFrame, numeric: list[str], minimum: float = 0.05) -> DataFrame:
    """Share of present values per numeric column, in one aggregation; ``kept`` when it
    reaches the minimum. Give it the training rows."""
    shares = df.agg(*[F.coalesce(F.avg(F.col(c).isNotNull().cast("double")), F.lit(0.0)).alias(c) for c in numeric])
    return shares.unpivot([], numeric, "feature", "coverage").withColumn("kept", F.col("coverage") >= minimum)
