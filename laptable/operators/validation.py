"""Data checks and table summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laptable.functions.coerce import is_blank, number
from laptable.functions.groups import count_if
from laptable.operators.sessions import addressable
from laptable.schema import CHRONOLOGY, DEFAULT_TIER, LAP_KEYS, REQUIRED

# --- Fixed values: plausible ranges of a lap table ------------------------------------------
VALUE_RANGES = {
    "lap_time_s": (30.0, 600.0),
    "tyre_life": (0.0, 100.0),
    "position": (1.0, 40.0),
    "track_temp_c": (-20.0, 80.0),
    "air_temp_c": (-20.0, 60.0),
    "humidity_pct": (0.0, 100.0),
    "wind_speed_ms": (0.0, 40.0),
    "lap_number": (1.0, 200.0),
}
SYNTHETIC_PREFIX = "Synthetic_"
SYNTHETIC_SOURCE = "synthetic_fixture"


def value_range_violations(df: DataFrame) -> DataFrame:
    """Per column: rows outside the plausible range and the most extreme example. One pass
    over all columns."""
    present = {c: r for c, r in VALUE_RANGES.items() if c in df.columns}
    aggs = []
    for c, (low, high) in present.items():
        value = number(c)
        bad = F.when((value < low) | (value > high), value)
        distance = F.struct(F.abs(bad - (low + high) / 2), bad)
        aggs.append(F.struct(F.count(bad).alias("violations"), F.max_by(bad, F.when(bad.isNotNull(), distance)).alias("example")).alias(c))
    wide = df.agg(*aggs)
    long = wide.unpivot([], list(present), "column", "r")
    return long.select("column", "r.violations", "r.example").where("violations > 0")


def identity_checks(df: DataFrame) -> DataFrame:
    """Counts of blank identities, of duplicated lap keys and of non-numeric seasons and laps."""
    singles = df.agg(
        *[count_if(is_blank(c)).alias(f"blank_{c}") for c in ("driver", "season", "event", "session")],
        *[count_if(F.col(c).isNotNull() & number(c).isNull()).alias(f"not_numeric_{c}") for c in ("season", "lap_number")],
    )
    names = [c for c in singles.columns]
    out = singles.unpivot([], names, "check", "rows")
    repeated = df.groupBy(*LAP_KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(
        F.lit("duplicate_lap").alias("check"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")
    )
    return out.unionByName(repeated)


def check_frame_types(df: DataFrame) -> None:
    """Refuse a table whose season or lap number holds a value that is not a number."""
    for c in ("season", "lap_number"):
        if c in df.columns:
            bad = df.where(F.col(c).isNotNull() & number(c).isNull()).select(F.col(c).cast("string")).first()
            if bad is not None:
                raise ValueError(f"Column '{c}' must be numeric; found {bad[0]!r}")


def addressable_rows(df: DataFrame) -> DataFrame:
    return df.where(addressable())


def infer_data_source(df: DataFrame) -> DataFrame:
    """One label for a table: the synthetic label when every event is synthetic, else its tiers."""
    if "event" not in df.columns:
        return df.sparkSession.range(1).select(F.lit("unknown").alias("data_source"))
    synthetic = F.bool_and(F.coalesce(F.startswith(F.col("event").cast("string"), F.lit(SYNTHETIC_PREFIX)), F.lit(False)))
    tiers: Column = F.lit("user_supplied")
    if "data_tier" in df.columns:
        tiers = F.array_join(F.array_sort(F.collect_set(F.coalesce("data_tier", F.lit(DEFAULT_TIER)))), "+")
    return df.agg(
        F.when(F.count(F.lit(1)) == 0, "unknown").when(synthetic, SYNTHETIC_SOURCE).otherwise(tiers).alias("data_source")
    )


def table_summary(df: DataFrame) -> DataFrame:
    """One row: size, distinct identities and what is missing. The session list and the data
    warnings are their own tables (``list_sessions``, ``value_range_violations``,
    ``identity_checks``)."""
    missing = [c for c in REQUIRED if c not in df.columns]
    season = number("season")
    identities = df.groupBy(
        F.when(season == F.floor(season), season.cast("int")).alias("season"), F.col("event").cast("string").alias("event"),
        F.col("session").cast("string").alias("session"), F.col("driver").cast("string").alias("driver"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return identities.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.array_sort(F.collect_set("season")).alias("seasons"),
        F.count_distinct(F.coalesce("event", F.lit("nan"))).alias("events"),
        F.count_distinct(F.coalesce("driver", F.lit("nan"))).alias("drivers"),
        F.count_distinct(F.struct("season", "event", "session")).alias("sessions"),
    ).withColumns(
        {
            "columns": F.lit(len(df.columns)),
            "missing_required": F.lit(",".join(missing)),
            "has_chronology": F.lit(any(c in df.columns for c in CHRONOLOGY)),
        }
    )
