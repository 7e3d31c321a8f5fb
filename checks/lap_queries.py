"""Queries over laps: scan, scalar expressions, lap state, segments, features, priors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.adapter import LAPS, ROLLING, SEGMENTS, STATE, laps, read
from laptable.functions.coerce import weather_bins, wind_components
from laptable.operators import features as feat
from laptable.operators.lap_state import lap_state_flags, runs_of
from laptable.operators.priors import history_prior, key_parts
from laptable.schema import LAP_STATE, PRIOR_GROUPS, RAW_TARGET, TARGET
from laptable.session import shared_folder
from laptable.sources import readers

KEYS = ["season", "event", "session", "driver", "lap_number"]
KEY_SQL = "season, event, session, driver, lap_number"


def r6(*names: str) -> list:
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def flagged(spark, folder):
    runs = runs_of(feat.prepare(laps(spark, folder)))
    return runs, lap_state_flags(runs)


def features(spark, folder, **options) -> DataFrame:
    return feat.build_features(laps(spark, folder), **options)


QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


SCAN = KEYS + ["round_number", "circuit", "event_date", "team", "compound", "stint", "position", "track_status", "pit_in", "pit_out",
               "is_accurate", "deleted", "rainfall", "data_tier"]


@register(
    "scan_laps",
    f"WITH {LAPS} SELECT {', '.join(SCAN)}, {s6('lap_time_s', 'sector1_s', 'sector2_s', 'sector3_s')} FROM laps",
)
def scan_laps(spark, folder):
    return laps(spark, folder).select(*SCAN, *r6("lap_time_s", "sector1_s", "sector2_s", "sector3_s"))


@register("scan_laps_files", SQL["scan_laps"])
def scan_laps_files(spark, folder):
    """All laps written as parquet folders and as CSV, half of the seasons each, and read back by the library's reader."""
    target = f"{shared_folder(spark)}/laps_{uuid.uuid4().hex}"
    table = laps(spark, folder)
    readers.write_laps(table.where("season % 2 = 0"), f"{target}/laps")
    table.where("season % 2 <> 0").write.csv(f"{target}/laps.csv", header=True)
    back = readers.scan_laps(spark, f"{target}/laps", f"{target}/laps.csv")
    return back.select(*SCAN, *r6("lap_time_s", "sector1_s", "sector2_s", "sector3_s"))


@register("lap_state_flags", f"WITH {LAPS}, {STATE} SELECT {KEY_SQL}, {', '.join(LAP_STATE)} FROM state")
def q_lap_state(spark, folder):
    runs, df = flagged(spark, folder)
    return runs.finish(df).select(*KEYS, *LAP_STATE)


@register(
    "restart_laps",
    f"WITH {LAPS}, {STATE} SELECT {KEY_SQL}, is_red_flag_restart, is_safety_car_restart FROM state "
    "WHERE is_red_flag_restart OR is_safety_car_restart",
)
def q_restarts(spark, folder):
    runs, df = flagged(spark, folder)
    return df.where("is_red_flag_restart or is_safety_car_restart").select(*KEYS, "is_red_flag_restart", "is_safety_car_restart")


@register("segments", f"WITH {LAPS}, {STATE}, {SEGMENTS} SELECT {KEY_SQL}, lap_valid, is_break, segment, laps_in_segment FROM segs")
def q_segments(spark, folder):
    runs, df = flagged(spark, folder)
    return feat.segments(runs, df).select(*KEYS, "lap_valid", "is_break", "segment", "laps_in_segment")


def run_table(spark, folder, history=5):
    runs, df = flagged(spark, folder)
    return runs.finish(feat.run_features(runs, df, history))


UPTO_PACE = f"WITH {LAPS}, {STATE}, {SEGMENTS}, {ROLLING}"


def rolling_query(name, columns):
    @register(name, f"{UPTO_PACE} SELECT {KEY_SQL}, {s6(*columns)} FROM usable")
    def query(spark, folder):
        return run_table(spark, folder).select(*KEYS, *r6(*columns))


rolling_query("rolling_pace", ["rolling_median_3", "rolling_median_5"])
rolling_query(
    "sector_pace",
    [f"sector{i}_{what}" for i in (1, 2, 3) for what in ("mean_3", "rel_3", "share_3")],
)
rolling_query("pace_trend", ["pace_trend_3"])
rolling_query("pace_spread", ["lap_delta_to_rolling5", "pace_spread_3_5"])


def lag_sql(history: int) -> str:
    from laptable.schema import LAG_SOURCES, RELATIVE_LAGS

    out = []
    present = {"lap_time_s", "sector1_s", "sector2_s", "sector3_s", "tyre_life", "track_temp_c", "air_temp_c", "wind_speed_ms"}
    for source in LAG_SOURCES:
        for k in range(1, history):
            if source not in present:
                out.append(f"NULL::DOUBLE AS {source}_lag{k}")
            elif source in RELATIVE_LAGS:
                out.append(f"round(lag({source}, {k}) OVER s - {RELATIVE_LAGS[source]}, 6) + 0.0 AS {source}_lag{k}_rel")
            else:
                out.append(f"lag({source}, {k}) OVER s AS {source}_lag{k}")
    return ", ".join(out)


SEGMENT_WINDOW = "WINDOW s AS (PARTITION BY season, event, session, driver, segment ORDER BY lap_number)"


@register("segment_lags", f"{UPTO_PACE} SELECT {KEY_SQL}, {lag_sql(5)} FROM usable {SEGMENT_WINDOW}")
def q_lags(spark, folder):
    from laptable.schema import lag_names

    return run_table(spark, folder).select(
        *KEYS, *[r6(c)[0] if c.endswith("_rel") else F.col(c) for c in lag_names(5)]
    )


@register(
    "next_lap_target",
    f"{UPTO_PACE} SELECT {KEY_SQL}, round(next_time, 6) + 0.0 AS {RAW_TARGET}, round(next_time - rolling_median_5, 6) + 0.0 AS {TARGET} "
    "FROM usable WHERE has_target",
)
def q_target(spark, folder):
    return features(spark, folder, priors=[]).select(*KEYS, *r6(RAW_TARGET, TARGET))


@register(
    "next_lap_target_inference",
    f"{UPTO_PACE} SELECT {KEY_SQL}, CASE WHEN has_target THEN round(next_time, 6) + 0.0 END AS {RAW_TARGET}, "
    f"CASE WHEN has_target THEN round(next_time - rolling_median_5, 6) + 0.0 END AS {TARGET} FROM usable WHERE lap_valid",
)
def q_target_inference(spark, folder):
    return features(spark, folder, priors=[], require_target=False).select(*KEYS, *r6(RAW_TARGET, TARGET))


# --- priors -----------------------------------------------------------------------------
BINNED = """
binned AS (
  SELECT *, round_even(track_temp_c / 5.0, 0) * 5.0 AS track_temp_bin, round_even(air_temp_c / 4.0, 0) * 4.0 AS air_temp_bin,
    round_even(humidity_pct / 10.0, 0) * 10.0 AS humidity_bin, round_even(wind_speed_ms / 2.0, 0) * 2.0 AS wind_bin,
    rainfall::INT AS rain_state, driver || '@' || coalesce(team, 'None') AS driver_team,
    sin(radians(wind_direction_deg)) AS wind_dir_sin, cos(radians(wind_direction_deg)) AS wind_dir_cos
  FROM usable
)"""


def prior_cte(name: str) -> str:
    groups = PRIOR_GROUPS[name]
    g = ", ".join(groups)
    return f"""
m_{name} AS (
  SELECT {g}, season, event, median(lap_time_s) AS m, min(event_date::DATE) AS d FROM binned WHERE lap_valid GROUP BY {g}, season, event
),
{name} AS (
  SELECT {g}, season, event, median(m) OVER (PARTITION BY {g} ORDER BY d
    RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS v
  FROM m_{name}
)"""


def prior_join(name: str) -> str:
    on = " AND ".join(f"b.{c} IS NOT DISTINCT FROM {name}.{c}" for c in [*PRIOR_GROUPS[name], "season", "event"])
    return f"LEFT JOIN {name} ON {on}"


def prior_query(name):
    groups = PRIOR_GROUPS[name]
    texts = [f"{c}::VARCHAR" if not c.endswith("_bin") else f"{c}::DOUBLE::VARCHAR" for c in groups]

    @register(
        f"history_prior_{name[5:]}",
        f"{UPTO_PACE}, {BINNED}, {prior_cte(name)} "
        f"SELECT array_to_string([{', '.join(texts)}], '|') AS key, season, event, round(v, 6) + 0.0 AS value FROM {name}",
    )
    def query(spark, folder):
        runs, df = flagged(spark, folder)
        valid = df.withColumns(weather_bins()).where("lap_valid")
        return history_prior(valid, [name]).select(F.array_join(key_parts(F.col("key")), "|").alias("key"), "season", "event", *r6("value"))


for _name in PRIOR_GROUPS:
    prior_query(_name)


@register(
    "prior_lookup",
    f"{UPTO_PACE}, {BINNED}, {prior_cte('hist_driver_circuit_pace')}, {prior_cte('hist_team_weather_pace')} "
    "SELECT b.season, b.event, b.session, b.driver, b.lap_number, b.lap_valid, round(hist_driver_circuit_pace.v, 6) + 0.0 AS hist_driver_circuit_pace, "
    "round(hist_team_weather_pace.v, 6) + 0.0 AS hist_team_weather_pace FROM binned b "
    f"{prior_join('hist_driver_circuit_pace')} {prior_join('hist_team_weather_pace')}",
)
def q_prior_lookup(spark, folder):
    from laptable.operators.priors import prior_lookup

    names = ["hist_driver_circuit_pace", "hist_team_weather_pace"]
    runs, df = flagged(spark, folder)
    df = df.withColumns(weather_bins())
    priors = history_prior(df.where("lap_valid"), names)
    return prior_lookup(runs.finish(df), priors, names).select(*KEYS, "lap_valid", *r6(*names))


FULL_NUMERIC = [
    "rolling_median_3", "rolling_median_5", "pace_trend_3", "lap_delta_to_rolling5", "pace_spread_3_5", "sector1_rel_3", "sector2_rel_3",
    "sector3_rel_3", "sector1_share_3", "sector2_share_3", "sector3_share_3",
]
FULL = f"""{UPTO_PACE}, {BINNED}, {', '.join(prior_cte(n) for n in PRIOR_GROUPS)},
full_table AS (
  SELECT b.*, {', '.join(f'{n}.v AS {n}' for n in PRIOR_GROUPS)},
    CASE WHEN has_target THEN next_time END AS {RAW_TARGET}, CASE WHEN has_target THEN next_time - rolling_median_5 END AS {TARGET}
  FROM binned b {' '.join(prior_join(n) for n in PRIOR_GROUPS)}
)"""


@register(
    "build_features",
    f"{FULL}, lagged AS (SELECT {KEY_SQL}, has_target, laps_in_segment, driver_team, {s6(*FULL_NUMERIC, 'wind_dir_sin', 'wind_dir_cos', RAW_TARGET, TARGET)}, "
    f"{', '.join(f'round({n}, 6) + 0.0 AS {n}, round({n} - rolling_median_5, 6) + 0.0 AS {n}_rel' for n in PRIOR_GROUPS)}, {lag_sql(5)}, "
    f"3 AS lap_validity_version FROM full_table {SEGMENT_WINDOW}) SELECT * EXCLUDE (has_target) FROM lagged WHERE has_target",
)
def q_features(spark, folder):
    from laptable.schema import lag_names

    priors = [c for n in PRIOR_GROUPS for c in (n, f"{n}_rel")]
    return features(spark, folder).select(
        *KEYS, "laps_in_segment", "driver_team", *r6(*FULL_NUMERIC, "wind_dir_sin", "wind_dir_cos", RAW_TARGET, TARGET), *r6(*priors),
        *[r6(c)[0] if c.endswith("_rel") else F.col(c) for c in lag_names(5)], "lap_validity_version",
    )


@register(
    "next_lap_table_v0",
    f"""WITH {LAPS}, kept AS (SELECT *, lag(lap_time_s) OVER run AS t1, lead(lap_time_s) OVER run AS nt, lead(lap_number) OVER run AS nl
      FROM laps WHERE is_accurate AND NOT deleted AND NOT pit_in AND NOT pit_out
      WINDOW run AS (PARTITION BY season, event, session, driver ORDER BY lap_number)),
    r AS (SELECT *, median(lap_time_s) OVER three AS rolling_median_3, median(lap_time_s) OVER five AS rolling_median_5,
      avg(lap_time_s - t1) OVER three AS pace_trend_3 FROM kept
      WINDOW three AS (PARTITION BY season, event, session, driver ORDER BY lap_number ROWS 2 PRECEDING),
        five AS (PARTITION BY season, event, session, driver ORDER BY lap_number ROWS 4 PRECEDING))
    SELECT {KEY_SQL}, {s6('rolling_median_3', 'rolling_median_5', 'pace_trend_3')},
      round(lap_time_s - rolling_median_5, 6) + 0.0 AS lap_delta_to_rolling5, nt AS {RAW_TARGET}, round(nt - rolling_median_5, 6) + 0.0 AS {TARGET}
    FROM r WHERE nl - lap_number = 1 AND nt IS NOT NULL""",
)
def q_v0(spark, folder):
    return feat.next_lap_table_v0(laps(spark, folder)).select(
        *KEYS, *r6("rolling_median_3", "rolling_median_5", "pace_trend_3", "lap_delta_to_rolling5"), RAW_TARGET, *r6(TARGET)
    )


@register(
    "wind_components",
    f"WITH {LAPS} SELECT {KEY_SQL}, round(sin(radians(wind_direction_deg)), 6) + 0.0 AS wind_dir_sin, round(cos(radians(wind_direction_deg)), 6) + 0.0 AS wind_dir_cos FROM laps",
)
def q_wind(spark, folder):
    return laps(spark, folder).withColumns(wind_components(F.col("wind_direction_deg"))).select(*KEYS, *r6("wind_dir_sin", "wind_dir_cos"))


@register(
    "weather_bins",
    f"WITH {LAPS} SELECT {KEY_SQL}, (round_even(track_temp_c / 5.0, 0) * 5.0)::DOUBLE AS track_temp_bin, (round_even(air_temp_c / 4.0, 0) * 4.0)::DOUBLE AS air_temp_bin, "
    "(round_even(humidity_pct / 10.0, 0) * 10.0)::DOUBLE AS humidity_bin, (round_even(wind_speed_ms / 2.0, 0) * 2.0)::DOUBLE AS wind_bin, rainfall::INT AS rain_state FROM laps",
)
def q_bins(spark, folder):
    return laps(spark, folder).withColumns(weather_bins()).select(*KEYS, "track_temp_bin", "air_temp_bin", "humidity_bin", "wind_bin", "rain_state")
