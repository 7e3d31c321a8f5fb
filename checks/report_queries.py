"""Queries over predictions and reports. The two naive forecasts stand in for models."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import LAPS, STATE, laps
from checks.lap_queries import BINNED, KEYS, UPTO_PACE, features, flagged, r6, s6
from checks.more_lap_queries import BAND_NAMES, BANDS_SQL
from laptable.operators import audit, bootstrap, compare, metrics, splits, validation
from laptable.schema import RAW_TARGET

QUERIES, SQL = {}, {}
PKEYS = ["season", "round_number", "event", "session", "driver", "lap_number"]
P = ", ".join(PKEYS)


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


NAIVE = f"""{UPTO_PACE}, scored AS (SELECT *, next_time AS actual FROM usable WHERE has_target),
naive AS (
  SELECT {P}, circuit, team, 'previous_lap' AS model, actual, lap_time_s AS pred FROM scored UNION ALL
  SELECT {P}, circuit, team, 'rolling_median_5' AS model, actual, rolling_median_5 AS pred FROM scored
)"""


# A mean of thousandths over, say, 400 laps can lie exactly between two sixth decimals, and then
# the order of summation decides the rounding. Both sides move off such ties before rounding.
OFF_TIE = 1e-10


def m6(*names: str) -> list:
    return [(F.round(F.col(n) + F.lit(OFF_TIE), 6) + F.lit(0.0)).alias(n) for n in names]


def off_ties(sql: str) -> str:
    return sql.replace("round(", f"round({OFF_TIE} + ")


def scored(spark, folder):
    return features(spark, folder, priors=[])


def naive(spark, folder):
    return metrics.naive_predictions(scored(spark, folder), [*PKEYS, "circuit", "team"])


def metric_sql(source: str, keys: str) -> str:
    """All point metrics; rounding hides the last bits of summation order."""
    head = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return off_ties(
        f"SELECT {head}round(avg(abs(pred - actual)), 6) AS mae_s, round(sqrt(avg((pred - actual) * (pred - actual))), 6) AS rmse_s, round(median(abs(pred - actual)), 6) AS median_ae_s, "
        "round(quantile_cont(abs(pred - actual), 0.9), 6) AS p90_ae_s, round(avg(pred - actual), 6) + 0.0 AS signed_bias_s, round(avg((abs(pred - actual) <= 0.5)::INT), 6) AS within_0_5s_share, "
        "round(avg((abs(pred - actual) <= 1.0)::INT), 6) AS within_1s_share, round(100 * avg(abs(pred - actual) / greatest(abs(actual), 1e-9)), 6) AS mape_pct, "
        f"round(1 - sum((pred - actual) * (pred - actual)) / (count(*) * var_pop(actual)), 6) + 0.0 AS r2, count(*) AS \"rows\" FROM {source}{group}"
    )


METRICS6 = [n for n in metrics.METRIC_NAMES if n != "rows"]


@register("next_lap_baseline", f"{NAIVE}, g AS ({metric_sql('naive', 'model, driver')}) SELECT * FROM g WHERE \"rows\" >= 20")
def q_baseline(spark, folder):
    return metrics.metrics_by_key(naive(spark, folder), ["model", "driver"]).select("model", "driver", *m6(*METRICS6), "rows")


@register("regression_metrics", f"{NAIVE} {metric_sql('(SELECT * FROM naive WHERE model = ' + chr(39) + 'previous_lap' + chr(39) + ')', '')}")
def q_metrics(spark, folder):
    return metrics.regression_metrics(naive(spark, folder).where("model = 'previous_lap'"), []).select(*m6(*METRICS6), "rows")


@register("naive_metrics", f"{NAIVE} {metric_sql('naive', 'model')}")
def q_naive(spark, folder):
    return metrics.regression_metrics(naive(spark, folder), ["model"]).select("model", *m6(*METRICS6), "rows")


@register("metrics_by_key", f"{NAIVE}, g AS ({metric_sql('naive', 'model, season, event')}) SELECT * FROM g WHERE \"rows\" >= 20")
def q_by_key(spark, folder):
    return metrics.metrics_by_key(naive(spark, folder), ["model", "season", "event"]).select("model", "season", "event", *m6(*METRICS6), "rows")


@register(
    "interval_metrics",
    f"{NAIVE} SELECT model, round(avg((actual BETWEEN pred - 2 AND pred + 3)::INT), 6) AS interval80_coverage, round(avg(pred + 3 - (pred - 2)), 6) AS interval80_width_s FROM naive GROUP BY model",
)
def q_interval(spark, folder):
    df = naive(spark, folder).withColumns({"lower": F.col("pred") - 2, "upper": F.col("pred") + 3})
    return metrics.interval_metrics(df, ["model"]).select("model", *r6("interval80_coverage", "interval80_width_s"))


@register(
    "align_predictions",
    f"{UPTO_PACE} SELECT {P}, round(next_time, 6) AS actual, round(lap_time_s, 6) AS pred_previous_lap, round(rolling_median_5, 6) AS pred_rolling_median_5 FROM usable WHERE has_target",
)
def q_align(spark, folder):
    out = metrics.align_predictions(naive(spark, folder), ["previous_lap", "rolling_median_5"], strict=False)
    return out.select(*PKEYS, *r6("actual", "pred_previous_lap", "pred_rolling_median_5"))


DIMS = ["circuit", "team", "compound", *BAND_NAMES, "data_tier"]
BREAKDOWN = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS \"rows\", avg(abs(lap_time_s - next_time)) AS a, avg(abs(rolling_median_5 - next_time)) AS b FROM banded GROUP BY {d}" for d in DIMS
)


@register(
    "condition_breakdown",
    f"{UPTO_PACE}, {BANDS_SQL}, g AS ({BREAKDOWN}), v AS (SELECT dimension FROM g GROUP BY dimension HAVING count(*) > 1) "
    "SELECT dimension, value, \"rows\", round(1e-10 + a, 6) AS mae_previous_lap, round(1e-10 + b, 6) AS mae_rolling_median_5, CASE WHEN a <= b THEN 'previous_lap' ELSE 'rolling_median_5' END AS best_model "
    "FROM g WHERE \"rows\" >= 30 AND dimension IN (SELECT dimension FROM v)",
)
def q_breakdown(spark, folder):
    table = metrics.with_condition_bands(scored(spark, folder))
    rows = table.select("*", F.col(RAW_TARGET).alias("actual"), F.col("lap_time_s").alias("pred_previous_lap"), F.col("rolling_median_5").alias("pred_rolling_median_5"))
    out = metrics.condition_breakdown(rows, ["previous_lap", "rolling_median_5"])
    return out.select("dimension", "value", "rows", *m6("mae_previous_lap", "mae_rolling_median_5"), "best_model")


ROBUST = ["event", "team", "driver", "compound", "rainfall", "is_yellow"]
ROBUST_SQL = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d}::VARCHAR AS value, * FROM r" for d in ROBUST)


@register(
    "robustness_breakdown",
    f"{UPTO_PACE}, r AS (SELECT *, abs(rolling_median_3 - next_time) AS ae, abs(lap_time_s - next_time) AS pe, abs(rolling_median_5 - next_time) AS re, next_time BETWEEN rolling_median_3 - 2 AND rolling_median_3 + 2 AS ins FROM usable WHERE has_target), "
    f"l AS ({ROBUST_SQL}) " + off_ties("SELECT dimension, value, count(*) AS \"rows\", round(avg(ae), 6) AS mae_s, round(avg(pe), 6) AS previous_lap_mae_s, round(avg(re), 6) AS rolling5_mae_s, round(avg(ins::INT), 6) AS coverage, "
    "round(avg(rolling_median_3 - next_time), 6) + 0.0 AS bias_s, round(avg((ae < pe)::INT), 6) AS beat_share, round(avg((abs(ae - pe) < 0.01)::INT), 6) AS tie_share, round(avg((abs(pace_spread_3_5) > 0.2)::INT), 6) AS widened_share, "
    "round(median(ae), 6) AS median_ae_s, round(quantile_cont(ae, 0.9), 6) AS p90_ae_s, round(quantile_cont(ae, 0.99), 6) AS p99_ae_s FROM l GROUP BY dimension, value HAVING count(*) >= 20"),
)
def q_robust(spark, folder):
    table = scored(spark, folder)
    rows = table.select(
        *[c for c in ROBUST], F.col(RAW_TARGET).alias("actual"), F.col("rolling_median_3").alias("pred"), (F.col("rolling_median_3") - 2).alias("lower"), (F.col("rolling_median_3") + 2).alias("upper"),
        F.abs("pace_spread_3_5").alias("disagreement"), F.col("lap_time_s").alias("previous_lap"), "rolling_median_5",
    )
    out = metrics.robustness_breakdown(rows, ROBUST, 0.2)
    names = [c for c in out.columns if c not in ("dimension", "value", "rows")]
    return out.select("dimension", "value", "rows", *m6(*names))


SPLIT_CASE = "CASE WHEN season <= 1998 THEN 'train' WHEN season = 1999 THEN 'validation' WHEN season = 2000 THEN 'test' END"


def split_naive(spark, folder):
    table = splits.season_forward(scored(spark, folder), 1998, 1999, 2000)
    return metrics.naive_predictions(table, ["split", *PKEYS])


@register(
    "generalization_gap",
    f"{NAIVE}, s AS (SELECT *, {SPLIT_CASE} AS split, abs(pred - actual) AS ae FROM naive) SELECT model, "
    + ", ".join(f"round(avg(ae) FILTER (split = '{p}'), 6) AS {p}_mae_s, round(sqrt(avg(ae * ae) FILTER (split = '{p}')), 6) AS {p}_rmse_s" for p in ("train", "validation", "test"))
    + ", round(avg(ae) FILTER (split = 'test') - avg(ae) FILTER (split = 'train'), 6) + 0.0 AS gap_mae_s FROM s GROUP BY model",
)
def q_gap(spark, folder):
    out = metrics.generalization_gap(split_naive(spark, folder))
    return out.select("model", *r6(*[c for c in out.columns if c != "model"]))


@register(
    "season_errors",
    f"{NAIVE}, s AS (SELECT *, {SPLIT_CASE} AS split, abs(pred - actual) AS ae FROM naive) SELECT model, season, split, count(*) AS \"rows\", round(avg(ae), 6) AS mae_s, round(sqrt(avg(ae * ae)), 6) AS rmse_s, "
    "round(avg((ae > 5)::INT), 6) AS share_over_5s FROM s WHERE split IS NOT NULL GROUP BY model, season, split",
)
def q_season(spark, folder):
    return metrics.season_errors(split_naive(spark, folder)).select("model", "season", "split", "rows", *r6("mae_s", "rmse_s", "share_over_5s"))


@register(
    "worst_errors",
    f"{NAIVE} SELECT {P}, model, round(actual, 6) AS actual, round(pred, 6) AS pred, round(abs(pred - actual), 6) AS abs_error_s FROM naive WHERE model = 'previous_lap' ORDER BY abs(pred - actual) DESC, {P} LIMIT 15",
)
def q_worst(spark, folder):
    out = metrics.worst_errors(naive(spark, folder).where("model = 'previous_lap'"), 15)
    return out.select(*PKEYS, "model", *r6("actual", "pred", "abs_error_s"))


@register(
    "rescore_diff",
    f"{NAIVE}, a AS (SELECT * FROM naive WHERE model = 'previous_lap' AND season <> 1996), b AS (SELECT * FROM naive WHERE model = 'rolling_median_5' AND season <> 1997), "
    "j AS (SELECT a.pred AS ap, b.pred AS bp, a.season AS sa, b.season AS sb, abs(a.pred - b.pred) AS d FROM a FULL JOIN b ON a.season = b.season AND a.event = b.event AND a.driver = b.driver AND a.lap_number = b.lap_number) "
    "SELECT count(*) FILTER (sa IS NOT NULL AND sb IS NOT NULL) AS matched, count(*) FILTER (sb IS NULL) AS stored_only, count(*) FILTER (sa IS NULL) AS computed_only, round(avg(d), 6) AS mean_abs_diff_s, round(max(d), 6) AS max_abs_diff_s, "
    "round(avg((d > 0.05)::INT), 6) AS share_over_low, round(avg((d > 0.2)::INT), 6) AS share_over_high FROM j",
)
def q_rescore(spark, folder):
    base = naive(spark, folder)
    out = metrics.rescore_diff(base.where("model = 'previous_lap' and season <> 1996"), base.where("model = 'rolling_median_5' and season <> 1997"))
    return out.select("matched", "stored_only", "computed_only", *r6("mean_abs_diff_s", "max_abs_diff_s", "share_over_low", "share_over_high"))


@register(
    "unseen_categories",
    f"{UPTO_PACE}, t AS (SELECT DISTINCT driver FROM usable WHERE has_target AND season <= 1995), u AS (SELECT DISTINCT compound FROM usable WHERE has_target AND season <= 1995) "
    f"SELECT {P}, driver NOT IN (SELECT driver FROM t) AS unseen_driver, compound NOT IN (SELECT compound FROM u) AS unseen_compound FROM usable WHERE has_target AND season = 2000",
)
def q_unseen(spark, folder):
    table = scored(spark, folder)
    out = metrics.unseen_categories(table.where("season = 2000"), table.where("season <= 1995"), ["driver", "compound"])
    return out.select(*PKEYS, "unseen_driver", "unseen_compound")


@register(
    "describe_split",
    f"{UPTO_PACE}, s AS (SELECT *, {SPLIT_CASE} AS split FROM usable WHERE has_target) SELECT split, count(*) AS \"rows\", array_to_string(list_sort(list(DISTINCT season)), ',') AS seasons, count(DISTINCT season || event) AS events, "
    "array_to_string(list_sort(list(DISTINCT season || '/' || round_number)), ',') AS rounds, 'fastf1_timing=' || count(*) AS tiers FROM s WHERE split IS NOT NULL GROUP BY split",
)
def q_describe(spark, folder):
    out = metrics.describe_split(splits.season_forward(scored(spark, folder), 1998, 1999, 2000))
    return out.select("split", F.col("rows").cast("bigint").alias("rows"), F.array_join(F.col("seasons").cast("array<string>"), ",").alias("seasons"), "events", "rounds", "tiers")


COVERED = ["tyre_life", "gap_ahead_s", "pace_trend_3", "laps_in_segment"]


@register(
    "feature_coverage",
    f"{UPTO_PACE}, t AS (SELECT * FROM usable WHERE has_target AND season <= 1998) SELECT f AS feature, round(c, 6) AS coverage, c >= 0.05 AS kept FROM (SELECT 'tyre_life' AS f, avg((tyre_life IS NOT NULL)::INT) AS c FROM t UNION ALL SELECT 'gap_ahead_s', 0.0 "
    "UNION ALL SELECT 'pace_trend_3', avg((pace_trend_3 IS NOT NULL)::INT) FROM t UNION ALL SELECT 'laps_in_segment', avg((laps_in_segment IS NOT NULL)::INT) FROM t)",
)
def q_coverage(spark, folder):
    out = metrics.feature_coverage(scored(spark, folder).where("season <= 1998"), COVERED)
    return out.select("feature", *r6("coverage"), "kept")


@register(
    "table_summary",
    f"WITH {LAPS} SELECT count(*) AS \"rows\", array_to_string(list_sort(list(DISTINCT season)), ',') AS seasons, count(DISTINCT event) AS events, count(DISTINCT driver) AS drivers, count(DISTINCT season || event || session) AS sessions, "
    "'' AS missing_required, true AS has_chronology FROM laps",
)
def q_summary(spark, folder):
    return validation.table_summary(laps(spark, folder)).select(
        F.col("rows").cast("bigint").alias("rows"), F.array_join(F.col("seasons").cast("array<string>"), ",").alias("seasons"), "events", "drivers", "sessions", "missing_required", "has_chronology"
    )


@register("infer_data_source", f"WITH {LAPS} SELECT string_agg(t, '+' ORDER BY t) AS data_source FROM (SELECT DISTINCT CASE WHEN src_part % 5 = 0 THEN 'legacy_timing' ELSE data_tier END AS t FROM laps)")
def q_source(spark, folder):
    tier = F.when(F.col("src_part") % 5 == 0, "legacy_timing").when(F.col("src_part") % 5 == 1, None).otherwise(F.col("data_tier"))
    return validation.infer_data_source(laps(spark, folder).withColumn("data_tier", tier))


@register(
    "union_sessions",
    f"WITH {LAPS} SELECT season, CASE WHEN src_part % 4 = 0 THEN 'legacy_timing' ELSE data_tier END AS data_tier, count(*) AS laps, count(DISTINCT event) AS events, count(CASE WHEN src_part % 4 <> 0 THEN compound END) AS with_compound FROM laps GROUP BY 1, 2",
)
def q_union(spark, folder):
    from laptable.sources.readers import tier_counts, union_sessions

    base = laps(spark, folder)
    legacy = base.where("src_part % 4 = 0").select(*KEYS, F.lit("legacy_timing").alias("data_tier"))
    both = union_sessions([base.where("src_part % 4 <> 0"), legacy])
    filled = both.groupBy("season", "data_tier").agg(F.count("compound").alias("with_compound"))
    return tier_counts(both).join(filled, ["season", "data_tier"])


# --- provider comparison ------------------------------------------------------------------------
PROVIDER_B = """
b_once AS (
  SELECT * REPLACE (lap_time_s + CASE WHEN src_part % 7 = 0 THEN 0.001 ELSE 0 END + CASE WHEN src_part % 211 = 0 THEN 2 ELSE 0 END AS lap_time_s,
    CASE WHEN src_part % 31 = 0 THEN 'WET' ELSE compound END AS compound) FROM laps WHERE src_order % 50 <> 0
),
b_all AS (SELECT * FROM b_once UNION ALL SELECT * FROM b_once WHERE src_part % 401 = 0),
l1 AS (SELECT * FROM laps WHERE lap_number > 1),
r1 AS (SELECT * FROM b_all WHERE lap_number > 1 QUALIFY count(*) OVER (PARTITION BY season, round_number, session, driver, lap_number) = 1),
j AS (SELECT l.*, r.lap_time_s AS rt, r.compound AS rc, r.position AS rp, r.track_status AS rs FROM l1 l JOIN r1 r ON l.season = r.season AND l.round_number = r.round_number AND l.session = r.session AND l.driver = r.driver AND l.lap_number = r.lap_number)"""


def provider_pair(spark, folder):
    left = laps(spark, folder)
    part = F.col("src_part")
    shift = F.when(part % 7 == 0, 0.001).otherwise(0.0) + F.when(part % 211 == 0, 2.0).otherwise(0.0)
    right = left.where("src_order % 50 <> 0").withColumns(
        {"lap_time_s": F.col("lap_time_s") + shift, "compound": F.when(part % 31 == 0, "WET").otherwise(F.col("compound"))}
    )
    right = right.unionByName(right.where("src_part % 401 = 0"))
    return compare.ProviderComparison(left, right)


@register(
    "compare_providers_coverage",
    f"WITH {LAPS}, {PROVIDER_B} SELECT (SELECT count(*) FROM l1) AS left_laps, (SELECT count(*) FROM r1) AS right_laps, (SELECT count(*) FROM j) AS shared, (SELECT count(*) FROM l1) - (SELECT count(*) FROM j) AS left_only, "
    "(SELECT count(*) FROM r1) - (SELECT count(*) FROM j) AS right_only, 0::BIGINT AS left_missing_key, 0::BIGINT AS right_missing_key, 0::BIGINT AS left_duplicate_key, (SELECT count(*) FROM b_all WHERE lap_number > 1) - (SELECT count(*) FROM r1) AS right_duplicate_key",
)
def q_cmp_coverage(spark, folder):
    return provider_pair(spark, folder).coverage()


@register(
    "compare_providers_agreement",
    f"WITH {LAPS}, {PROVIDER_B} SELECT 'lap_time_s' AS \"column\", count(lap_time_s) AS both_present, round(avg((abs(lap_time_s - rt) <= 0.002)::INT), 6) AS agree_share FROM j WHERE lap_time_s IS NOT NULL UNION ALL "
    "SELECT 'compound', count(*), round(avg((compound = rc)::INT), 6) FROM j UNION ALL SELECT 'position', count(*), round(avg((position = rp)::INT), 6) FROM j UNION ALL SELECT 'track_status', count(track_status), 1.0 FROM j WHERE track_status IS NOT NULL",
)
def q_cmp_agreement(spark, folder):
    out = provider_pair(spark, folder).agreement()
    return out.where(F.col("column").isin("lap_time_s", "compound", "position", "track_status")).select("column", "both_present", *r6("agree_share"))


@register(
    "compare_providers_lap_time",
    f"WITH {LAPS}, {PROVIDER_B} SELECT round(median(abs(lap_time_s - rt)), 6) + 0.0 AS median_s, round(quantile_cont(abs(lap_time_s - rt), 0.99), 6) AS p99_s, count(*) FILTER (abs(lap_time_s - rt) > 1) AS over_1s FROM j",
)
def q_cmp_time(spark, folder):
    return provider_pair(spark, folder).lap_time_differences().select(*r6("median_s", "p99_s"), "over_1s")


@register(
    "compare_providers_worst",
    f"WITH {LAPS}, {PROVIDER_B} SELECT season, round_number, session, driver, lap_number, round(lap_time_s, 3) AS left_s, round(rt, 3) AS right_s, round(abs(lap_time_s - rt), 6) AS diff FROM j WHERE lap_time_s IS NOT NULL "
    "ORDER BY abs(lap_time_s - rt) DESC, season, round_number, session, driver, lap_number LIMIT 10",
)
def q_cmp_worst(spark, folder):
    out = provider_pair(spark, folder).largest_differences(10)
    return out.select("season", "round_number", "session", "driver", "lap_number", F.round("left_s", 3).alias("left_s"), F.round("right_s", 3).alias("right_s"), *r6("diff"))


# --- bootstrap and audit ---------------------------------------------------------------------------
def aligned(spark, folder):
    table = scored(spark, folder)
    return table.select(*PKEYS, F.col(RAW_TARGET).alias("actual"), F.col("rolling_median_5").alias("pred_m"), F.col("lap_time_s").alias("pred_b"))


@register(
    "paired_bootstrap_summary",
    f"{UPTO_PACE}, d AS (SELECT *, abs(rolling_median_5 - next_time) - abs(lap_time_s - next_time) AS d FROM usable WHERE has_target) "
    "SELECT round(avg(d), 6) + 0.0 AS mean_diff_s, round(avg((d < 0)::INT), 6) AS share_better, count(*) AS \"rows\", count(DISTINCT season || '|' || event || '|' || driver) AS clusters FROM d",
)
def q_boot_summary(spark, folder):
    out = bootstrap.paired_summary(aligned(spark, folder), "m", "b")
    return out.select(*r6("mean_diff_s", "share_better"), "rows", "clusters")


@register("paired_bootstrap")
def q_boot(spark, folder):
    return bootstrap.paired_bootstrap(aligned(spark, folder), "m", "b", seed=0)


ISSUED = f"""{UPTO_PACE},
o AS (SELECT *, lead(is_pit_in) OVER run AS np, coalesce(lead(is_safety_car) OVER run, false) OR coalesce(lead(is_vsc) OVER run, false) AS nn FROM usable
  WINDOW run AS (PARTITION BY season, event, session, driver ORDER BY lap_number)),
pts AS (SELECT *, coalesce(next_lap = lap_number + 1, false) AS adj, coalesce(next_valid, false) AS clean, abs(rolling_median_5 - next_time) AS ae, abs(lap_time_s - next_time) AS pe FROM o
  WHERE lap_number IN (5, 10, 15, 20, 25, 30, 35, 40, 45, 50) AND lap_time_s IS NOT NULL),
d AS (SELECT * FROM pts WHERE lap_valid AND adj AND next_time IS NOT NULL),
l AS (SELECT 'all' AS grp, * FROM d UNION ALL SELECT CASE WHEN clean THEN 'clean' ELSE 'not clean' END, * FROM d UNION ALL SELECT 'pit-in', * FROM d WHERE np UNION ALL SELECT 'SC or VSC', * FROM d WHERE nn
  UNION ALL SELECT 'lap ' || lap_number::INT, * FROM d UNION ALL SELECT 'clean lap ' || lap_number::INT, * FROM d WHERE clean)"""


def issued(spark, folder):
    runs, df = flagged(spark, folder)
    table = features(spark, folder, priors=[], require_target=False)
    forecasts = table.select(*KEYS, F.col("rolling_median_5").alias("pred"), (F.col("rolling_median_5") - 2).alias("lower"), (F.col("rolling_median_5") + 2).alias("upper"))
    return audit.issued_forecasts(runs, df, forecasts)


@register("issued_forecast_counts", f"{ISSUED} SELECT lap_valid AS issued, count(*) AS laps FROM pts GROUP BY 1")
def q_issued(spark, folder):
    return audit.issue_counts(issued(spark, folder))


@register(
    "issued_forecast_audit",
    f"{ISSUED} SELECT grp AS \"group\", count(*) AS \"rows\", round(avg(ae), 6) AS mae_s, round(avg((ae <= 0.5)::INT), 6) AS within_0_5s_share, round(avg((next_time BETWEEN rolling_median_5 - 2 AND rolling_median_5 + 2)::INT), 6) AS coverage, "
    "round(avg(pe), 6) AS previous_lap_mae_s, round(avg((pe <= 0.5)::INT), 6) AS previous_lap_within_0_5s_share, round(median(ae), 6) AS median_ae_s, round(quantile_cont(ae, 0.9), 6) AS p90_ae_s FROM l GROUP BY grp",
)
def q_audit(spark, folder):
    out = audit.issued_forecast_audit(issued(spark, folder))
    names = [c for c in out.columns if c not in ("group", "rows")]
    return out.select("group", "rows", *r6(*names))


@register(
    "seed_spread",
    f"{NAIVE}, g AS (SELECT event AS run, avg(abs(pred - actual)) AS mae_s, avg((abs(pred - actual) <= 0.5)::INT) AS within_0_5s_share FROM naive WHERE model = 'previous_lap' GROUP BY event) "
    "SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n FROM (SELECT 'mae_s' AS metric, mae_s AS v FROM g WHERE run <> 'GP_1' UNION ALL SELECT 'within_0_5s_share', within_0_5s_share FROM g WHERE run <> 'GP_1') GROUP BY metric",
)
def q_seeds(spark, folder):
    runs = metrics.regression_metrics(naive(spark, folder).where("model = 'previous_lap'"), ["event"])
    out = metrics.seed_spread(runs, ["mae_s", "within_0_5s_share"], F.col("event") == "GP_1")
    return out.select("metric", *r6("mean", "std"), "n")


@register(
    "run_summary",
    f"{NAIVE}, g AS (SELECT model || '/' || event AS run, event, model, round(avg(abs(pred - actual)), 9) AS mae, round(avg((abs(pred - actual) <= 0.5)::INT), 6) AS w05 FROM naive GROUP BY model, event) "
    "SELECT run, model, 'baseline' AS method, round(mae, 6) AS test_mae_s, w05 AS within_0_5s_share, mae = (SELECT min(mae) FROM g) AS is_best FROM g",
)
def q_run_summary(spark, folder):
    per = metrics.regression_metrics(naive(spark, folder), ["model", "event"]).withColumns(
        {"run": F.concat_ws("/", "model", "event"), "mae_s": F.round("mae_s", 9)}
    )
    test = F.struct("mae_s", "rmse_s", "p90_ae_s", F.when(F.col("event") == "GP_1", F.lit(None).cast("double")).otherwise(F.col("within_0_5s_share")).alias("within_0_5s_share"), "within_1s_share", F.lit(None).cast("double").alias("interval80_coverage"))
    runs = per.select("run", "model", F.lit("baseline").alias("method"), test.alias("validation"), test.alias("test"))
    out = metrics.run_summary(runs, per.select("run", "within_0_5s_share", "within_1s_share"))
    return out.select("run", "model", "method", *r6("test_mae_s", "within_0_5s_share"), "is_best")
