"""The lap schema: column names, types, defaults and the feature taxonomy.

A lap table is a DataFrame; any subset of the optional columns may be absent on input.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: column names and types of one lap ------------------------------------
LAP_SCHEMA = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("event", T.StringType()),
        T.StructField("session", T.StringType()),
        T.StructField("driver", T.StringType()),
        T.StructField("lap_number", T.DoubleType()),
        T.StructField("round_number", T.IntegerType()),
        T.StructField("event_date", T.StringType()),
        T.StructField("circuit", T.StringType()),
        T.StructField("driver_number", T.StringType()),
        T.StructField("team", T.StringType()),
        T.StructField("manufacturer", T.StringType()),
        T.StructField("car_model", T.StringType()),
        T.StructField("car_class", T.StringType()),
        T.StructField("lap_time_s", T.DoubleType()),
        T.StructField("sector1_s", T.DoubleType()),
        T.StructField("sector2_s", T.DoubleType()),
        T.StructField("sector3_s", T.DoubleType()),
        T.StructField("compound", T.StringType()),
        T.StructField("tyre_manufacturer", T.StringType()),
        T.StructField("tyre_life", T.DoubleType()),
        T.StructField("fresh_tyre", T.BooleanType()),
        T.StructField("stint", T.DoubleType()),
        T.StructField("position", T.DoubleType()),
        T.StructField("track_status", T.StringType()),
        T.StructField("pit_in", T.BooleanType()),
        T.StructField("pit_out", T.BooleanType()),
        T.StructField("is_accurate", T.BooleanType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("air_temp_c", T.DoubleType()),
        T.StructField("track_temp_c", T.DoubleType()),
        T.StructField("humidity_pct", T.DoubleType()),
        T.StructField("pressure_mbar", T.DoubleType()),
        T.StructField("rainfall", T.BooleanType()),
        T.StructField("wind_speed_ms", T.DoubleType()),
        T.StructField("wind_direction_deg", T.DoubleType()),
        T.StructField("gap_ahead_s", T.DoubleType()),
        T.StructField("gap_behind_s", T.DoubleType()),
        T.StructField("mean_speed_kph", T.DoubleType()),
        T.StructField("max_speed_kph", T.DoubleType()),
        T.StructField("mean_throttle_pct", T.DoubleType()),
        T.StructField("brake_fraction", T.DoubleType()),
        T.StructField("mean_rpm", T.DoubleType()),
        T.StructField("max_rpm", T.DoubleType()),
        T.StructField("gear_changes", T.DoubleType()),
        T.StructField("drs_fraction", T.DoubleType()),
        T.StructField("data_tier", T.StringType()),
    ]
)

REQUIRED = ["season", "event", "session", "driver", "lap_number", "lap_time_s"]
CHRONOLOGY = ["event_date", "round_number"]

RUN_KEYS = ["season", "event", "session", "driver"]
LAP_KEYS = RUN_KEYS + ["lap_number"]
ROUND_LAP_KEYS = ["season", "round_number", "session", "driver", "lap_number"]
PREDICTION_KEYS = ["season", "round_number", "event", "session", "driver", "lap_number"]

# Equal lap numbers inside one run are ordered by these columns (an explicit ``ingest_id``
# column, when present, goes first), so every window has one well-defined order.
# --- Fixed values: column names ----------------------------------------------------------
TIE_BREAK = ["lap_time_s", "track_status", "pit_in", "pit_out", "is_accurate", "deleted"]

TARGET = "target_delta_vs_rolling5_s"
RAW_TARGET = "target_next_lap_time_s"

# Rules in lap_state.py; written to every result so runs under other rules are told apart.
LAP_VALIDITY_VERSION = 3

DEFAULT_TIER = "fastf1_timing"
CHECK_ONLY_SUFFIX = "_check_only"

# --- Fixed values: default of each optional column when a table lacks it ---------------
TEXT_DEFAULTS = {
    "series": "F1",
    "circuit": None,
    "team": None,
    "manufacturer": None,
    "car_class": None,
    "compound": None,
    "tyre_manufacturer": "Pirelli",
    "data_tier": DEFAULT_TIER,
    "track_status": "1",
}
NUMBER_DEFAULTS = [
    "fresh_tyre",
    "tyre_life",
    "stint",
    "position",
    "air_temp_c",
    "track_temp_c",
    "humidity_pct",
    "pressure_mbar",
    "wind_speed_ms",
    "wind_direction_deg",
    "gap_ahead_s",
    "gap_behind_s",
    "mean_speed_kph",
    "max_speed_kph",
    "mean_throttle_pct",
    "brake_fraction",
    "mean_rpm",
    "max_rpm",
    "gear_changes",
    "drs_fraction",
    "sector1_s",
    "sector2_s",
    "sector3_s",
]
FLAG_DEFAULTS = {
    "rainfall": False,
    "is_accurate": True,
    "deleted": False,
    "pit_in": False,
    "pit_out": False,
}

# --- Fixed values: feature names ---------------------------------------------------------
STATIC_CATEGORICAL = [
    "series",
    "event",
    "circuit",
    "session",
    "driver",
    "team",
    "driver_team",
    "manufacturer",
    "car_class",
    "compound",
    "tyre_manufacturer",
    "data_tier",
]
DYNAMIC_NUMERIC = [
    "lap_number",
    "sector1_rel_3",
    "sector2_rel_3",
    "sector3_rel_3",
    "tyre_life",
    "fresh_tyre",
    "stint",
    "laps_in_segment",
    "position",
    "air_temp_c",
    "track_temp_c",
    "humidity_pct",
    "pressure_mbar",
    "rainfall",
    "wind_speed_ms",
    "wind_dir_sin",
    "wind_dir_cos",
    "gap_ahead_s",
    "gap_behind_s",
    "mean_speed_kph",
    "max_speed_kph",
    "mean_throttle_pct",
    "brake_fraction",
    "mean_rpm",
    "max_rpm",
    "gear_changes",
    "drs_fraction",
]
TEMPORAL_NUMERIC = [
    "rolling_median_5",
    "pace_spread_3_5",
    "sector1_share_3",
    "sector2_share_3",
    "sector3_share_3",
    "pace_trend_3",
    "lap_delta_to_rolling5",
]
WEATHER_BINS = ["track_temp_bin", "air_temp_bin", "humidity_bin", "wind_bin", "rain_state"]
WEATHER_GROUP = ["circuit", "compound"] + WEATHER_BINS
PRIOR_GROUPS = {
    "hist_driver_circuit_pace": ["driver", "circuit"],
    "hist_team_circuit_pace": ["team", "circuit"],
    "hist_compound_circuit_pace": ["compound", "circuit"],
    "hist_driver_circuit_compound_pace": ["driver", "circuit", "compound"],
    "hist_team_circuit_compound_pace": ["team", "circuit", "compound"],
    "hist_driver_global_pace": ["driver"],
    "hist_team_global_pace": ["team"],
    "hist_weather_compound_pace": WEATHER_GROUP,
    "hist_driver_weather_pace": ["driver"] + WEATHER_GROUP,
    "hist_team_weather_pace": ["team"] + WEATHER_GROUP,
}
LAG_SOURCES = [
    "lap_time_s",
    "sector1_s",
    "sector2_s",
    "sector3_s",
    "tyre_life",
    "track_temp_c",
    "air_temp_c",
    "wind_speed_ms",
    "gap_ahead_s",
    "mean_speed_kph",
    "mean_throttle_pct",
    "brake_fraction",
]
# Lags of these sources are stored as a difference to the named column of the current lap.
RELATIVE_LAGS = {
    "lap_time_s": "rolling_median_5",
    "sector1_s": "sector1_mean_3",
    "sector2_s": "sector2_mean_3",
    "sector3_s": "sector3_mean_3",
}
# --- Fixed values: names of the flags of a lap --------------------------------------------
LAP_STATE = [
    "lap_valid",
    "is_safety_car",
    "is_vsc",
    "is_yellow",
    "is_red_flag",
    "is_red_flag_restart",
    "is_safety_car_restart",
    "is_pit_in",
    "is_pit_out",
    "is_deleted",
]
# Columns that describe the next lap and may never be model inputs.
# --- Fixed values: names of the next lap's columns ----------------------------------------
NEXT_LAP_COLUMNS = {
    RAW_TARGET,
    TARGET,
    "next_lap_time_s",
    "next_lap_number",
    "next_lap_valid",
    "next_sector1_s",
    "next_sector2_s",
    "next_sector3_s",
    "next_mean_speed_kph",
    "next_max_speed_kph",
}


def lag_names(history: int = 5) -> list[str]:
    return [
        f"{source}_lag{k}" + ("_rel" if source in RELATIVE_LAGS else "")
        for source in LAG_SOURCES
        for k in range(1, history)
    ]


def feature_groups(history: int = 5) -> dict[str, list[str]]:
    """Feature groups that can be ablated, by name."""
    return {
        "static_categorical": list(STATIC_CATEGORICAL),
        "dynamic_numeric": list(DYNAMIC_NUMERIC),
        "temporal_numeric": TEMPORAL_NUMERIC + lag_names(history),
        "historical_numeric": [f"{name}_rel" for name in PRIOR_GROUPS],
    }


def feature_contract(history: int = 5) -> dict[str, list[str]]:
    """Model inputs in contract order: numeric columns and categorical columns."""
    groups = feature_groups(history)
    return {
        "numeric": DYNAMIC_NUMERIC
        + TEMPORAL_NUMERIC
        + groups["historical_numeric"]
        + lag_names(history),
        "categorical": groups["static_categorical"],
    }
