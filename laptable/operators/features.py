"""The next-lap feature table.

Every feature of lap N uses what is known at the end of lap N. Lags and rolling values stay
inside a segment, a stretch of consecutive valid laps, so neither a pit stop nor a
neutralised lap can slip in between. All run-level expressions share one window order, so the
laps are shuffled and sorted once.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laptable.functions.coerce import driver_team, number, weather_bins, wind_components
from laptable.functions.groups import OrderedGroups, join_on, unpruned
from laptable.operators.lap_state import lap_state_flags, runs_of
from laptable.operators.priors import attach_bundled, attach_priors, bundled
from laptable.schema import (
    CHECK_ONLY_SUFFIX,
    CHRONOLOGY,
    DEFAULT_TIER,
    FLAG_DEFAULTS,
    LAG_SOURCES,
    LAP_VALIDITY_VERSION,
    NEXT_LAP_COLUMNS,
    NUMBER_DEFAULTS,
    PRIOR_GROUPS,
    RAW_TARGET,
    RELATIVE_LAGS,
    REQUIRED,
    RUN_KEYS,
    TARGET,
    TEXT_DEFAULTS,
    feature_contract,
    feature_groups,
)

SECTORS = ("sector1", "sector2", "sector3")


def fill_defaults(df: DataFrame) -> DataFrame:
    """Add absent optional columns with their defaults. A null value inside a column that is
    present stays null, except the tier: files older than that column are timing laps."""
    absent: dict[str, Column] = {}
    if "circuit" not in df.columns and "event" in df.columns:
        absent["circuit"] = F.col("event")
    for name, value in TEXT_DEFAULTS.items():
        if name not in df.columns and name not in absent:
            absent[name] = F.lit(value).cast("string")
    absent |= {n: F.lit(None).cast("double") for n in NUMBER_DEFAULTS if n not in df.columns}
    absent |= {n: F.lit(v) for n, v in FLAG_DEFAULTS.items() if n not in df.columns}
    df = df.withColumns(absent) if absent else df
    return df.withColumn("data_tier", F.coalesce(F.col("data_tier"), F.lit(DEFAULT_TIER)))


def check_only_guard(df: DataFrame) -> DataFrame:
    """The table, which ends its job with an error at a row that exists for provider checks only."""
    if "data_tier" not in df.columns:
        return df
    message = F.concat(F.lit("A row carries the check-only data tier "), F.col("data_tier"), F.lit("; it repeats a lap of another tier and cannot feed a model"))
    check_only = F.coalesce(F.col("data_tier").endswith(CHECK_ONLY_SUFFIX), F.lit(False))
    return df.where(F.when(check_only, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def contract_guard(df: DataFrame, require_chronology: bool = True) -> None:
    """Schema checks that need no job."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    if require_chronology and not any(c in df.columns for c in CHRONOLOGY):
        raise ValueError("An event_date or round_number column is needed to order events")


def assert_no_leakage(columns: Iterable[str]) -> None:
    bad = sorted(NEXT_LAP_COLUMNS.intersection(columns))
    if bad:
        raise ValueError(f"Columns describing the next lap are among the features: {bad}")


def select_features(columns: Iterable[str], history: int = 5, drop: Iterable[str] = ()) -> dict[str, list[str]]:
    """Contract columns present in ``columns`` without the ablated groups."""
    groups = feature_groups(history)
    unknown = [g for g in drop if g not in groups]
    if unknown:
        raise ValueError(f"Unknown feature groups {unknown}; choose from {sorted(groups)}")
    removed = {c for g in drop for c in groups[g]}
    kept = set(columns) - removed
    return {kind: [c for c in names if c in kept] for kind, names in feature_contract(history).items()}


def with_appearance_rounds(df: DataFrame) -> DataFrame:
    """Rounds for tables without chronology: events of a season in order of first appearance,
    which needs an explicit ``ingest_id``. Without one, events of a season do not see each
    other in the priors."""
    if "ingest_id" not in df.columns:
        return df.withColumn("round_number", F.lit(None).cast("int"))
    first = df.groupBy("season", "event").agg(F.min("ingest_id").alias("_first"))
    order = Window.partitionBy("season").orderBy("_first")
    rounds = first.select("season", "event", F.row_number().over(order).alias("round_number"))
    return join_on(df, rounds, ["season", "event"])


def prepare(df: DataFrame) -> DataFrame:
    """Defaults and coercion; rows without a lap number are dropped."""
    df = fill_defaults(df)
    numeric = ["season", "lap_number", "lap_time_s", *[f"{s}_s" for s in SECTORS]]
    types = dict(df.dtypes)
    return df.withColumns(
        {c: number(c) for c in numeric if types[c] != "int"} | {"season": F.col("season").try_cast("int")}
    ).where(F.col("lap_number").isNotNull())


def segment_breaks(runs: OrderedGroups, df: DataFrame) -> DataFrame:
    """Mark where a segment starts: every invalid lap, the first valid lap after one, and any
    gap in lap numbers. ``_starts`` also holds for the first lap of a run."""
    w = runs.window()
    previous = F.lag("lap_number").over(w)
    after_invalid = ~F.lag("lap_valid").over(w)
    gap = F.col("lap_number") - previous != 1
    breaks = ~F.col("lap_valid") | F.coalesce(after_invalid, F.lit(False)) | F.coalesce(gap, F.lit(False))
    return df.withColumns({"is_break": breaks, "_starts": breaks | previous.isNull()})


def with_position(runs: OrderedGroups, df: DataFrame) -> DataFrame:
    """``laps_in_segment``: lap numbers are consecutive inside a segment, so the position is
    the distance to the lap the segment started on."""
    start = F.when(F.col("_starts"), F.col("lap_number"))
    df = runs.before(df, last={"_start": start})
    return df.withColumn(
        "laps_in_segment",
        (F.col("lap_number") - F.coalesce(start, F.col("_start")) + 1).cast("int"),
    ).drop("_start")


def segments(runs: OrderedGroups, df: DataFrame) -> DataFrame:
    """Segment number within the run and position within the segment."""
    flagged = runs.core(segment_breaks(runs, runs.with_halo(df, before=1, after=0)))
    out = with_position(runs, flagged)
    own = F.col("is_break").cast("int")
    out = runs.before(out, total={"segment": own})
    return out.withColumn("segment", (F.col("segment") + own).cast("int")).drop("_starts")


def _tail(source: str, length: int) -> list[Column]:
    """Values of the last ``length`` laps, null outside the segment."""
    return [F.col(source)] + [
        F.when(F.col("laps_in_segment") > k, F.col(f"_{source}_{k}")) for k in range(1, length)
    ]


def _median(values: list[Column]) -> Column:
    ordered = F.sort_array(F.array_compact(F.array(*values)))
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return low + (high - low) * F.when(n % 2 == 0, 0.5).otherwise(0.0)


def _mean(values: list[Column]) -> Column:
    """Mean of the values that are present."""
    total = reduce(add, [F.coalesce(v, F.lit(0.0)) for v in values])
    present = reduce(add, [v.isNotNull().cast("int") for v in values])
    return F.try_divide(total, present.cast("double"))


def shifted(runs: OrderedGroups, df: DataFrame, sources: dict[str, int]) -> DataFrame:
    """Raw shifts ``_<source>_<k>`` within the run, one window for all of them."""
    w = runs.window()
    return df.withColumns(
        {f"_{s}_{k}": F.lag(s, k).over(w) for s, depth in sources.items() for k in range(1, depth + 1)}
    )


def rolling_columns() -> dict[str, Column]:
    return {
        "rolling_median_3": _median(_tail("lap_time_s", 3)),
        "rolling_median_5": _median(_tail("lap_time_s", 5)),
        "sector1_mean_3": _mean(_tail("sector1_s", 3)),
        "sector2_mean_3": _mean(_tail("sector2_s", 3)),
        "sector3_mean_3": _mean(_tail("sector3_s", 3)),
        "pace_trend_3": _mean(_lap_deltas()),
    }


def _lap_deltas() -> list[Column]:
    """The last three lap-to-lap changes inside the segment."""
    chain = [F.col("lap_time_s")] + [F.col(f"_lap_time_s_{k}") for k in (1, 2, 3)]
    return [F.when(F.col("laps_in_segment") > k + 1, chain[k] - chain[k + 1]) for k in range(3)]


def pace_columns() -> dict[str, Column]:
    out = {
        "lap_delta_to_rolling5": F.col("lap_time_s") - F.col("rolling_median_5"),
        "pace_spread_3_5": F.col("rolling_median_3") - F.col("rolling_median_5"),
    }
    for s in SECTORS:
        out[f"{s}_rel_3"] = F.col(f"{s}_s") - F.col(f"{s}_mean_3")
        out[f"{s}_share_3"] = F.try_divide(F.col(f"{s}_mean_3"), F.col("rolling_median_5"))
    return out


def lag_columns(history: int) -> dict[str, Column]:
    """Lags 1..history-1, defined only while the lagged lap lies in the same segment."""
    out = {}
    for source in LAG_SOURCES:
        for k in range(1, history):
            value = F.when(F.col("laps_in_segment") > k, F.col(f"_{source}_{k}"))
            base = RELATIVE_LAGS.get(source)
            out[f"{source}_lag{k}" + ("_rel" if base else "")] = value - F.col(base) if base else value
    return out


def _shift_depths(history: int) -> dict[str, int]:
    depths = {s: history - 1 for s in LAG_SOURCES}
    depths["lap_time_s"] = max(history - 1, 4)
    for s in SECTORS:
        depths[f"{s}_s"] = max(history - 1, 2)
    return {s: d for s, d in depths.items() if d > 0}


def next_lap_columns(runs: OrderedGroups, df: DataFrame) -> DataFrame:
    """Time, number and validity of the following lap of the run."""
    w = runs.window()
    return df.withColumns(
        {
            RAW_TARGET: F.lead("lap_time_s").over(w),
            "next_lap_number": F.lead("lap_number").over(w),
            "next_lap_valid": F.lead("lap_valid").over(w),
        }
    )


def has_target() -> Column:
    """The next lap is adjacent, valid and timed."""
    return (
        F.coalesce(F.col("next_lap_number") - F.col("lap_number") == 1, F.lit(False))
        & F.coalesce(F.col("next_lap_valid"), F.lit(False))
        & F.col(RAW_TARGET).isNotNull()
    )


def run_features(runs: OrderedGroups, flagged: DataFrame, history: int = 5) -> DataFrame:
    """Segment position, rolling pace, lags and the next lap for every lap of every run."""
    depths = _shift_depths(history)
    df = runs.with_halo(flagged, before=max(depths.values()) + 1, after=1)
    df = segment_breaks(runs, df)
    df = shifted(runs, df, depths)
    df = runs.core(next_lap_columns(runs, df))
    df = with_position(runs, df)
    df = df.withColumns(rolling_columns()).withColumns(pace_columns()).withColumns(lag_columns(history))
    raw_shifts = [f"_{s}_{k}" for s, d in depths.items() for k in range(1, d + 1)]
    return df.drop("_starts", "is_break", *raw_shifts)


def build_features(raw: DataFrame, history: int = 5, require_chronology: bool = True,
                   require_target: bool = True, split: bool = False,
                   check_tiers: bool = True, priors: Iterable[str] | None = None) -> DataFrame:
    """The leakage-safe feature table.

    ``require_target=True`` keeps laps with a usable next lap (training and evaluation);
    ``False`` keeps every valid lap and leaves the target null where there is none.
    ``split=True`` takes the plans for runs and events without a bound; a run is a driver's laps
    in a session and an event a weekend, so it is off. Building the table starts no job (with
    ``split`` one, which stores the laps). ``priors`` limits the historical priors to the named ones.
    """
    if history < 1:
        raise ValueError("history must be >= 1")
    contract_guard(raw, require_chronology)
    if check_tiers:
        raw = check_only_guard(raw)
    if not any(c in raw.columns for c in CHRONOLOGY):
        raw = with_appearance_rounds(raw)
    prepared = prepare(raw)
    names = list(PRIOR_GROUPS if priors is None else priors)
    together = bool(names) and not split
    runs = runs_of(bundled(prepared), keys=["_b1", "_b2", *RUN_KEYS]) if together else runs_of(prepared, split)
    flagged = lap_state_flags(runs)
    if together:
        flagged = unpruned(flagged)
    flagged = flagged.withColumns(
        wind_components(number("wind_direction_deg")) | {"driver_team": driver_team()} | weather_bins()
    )
    table = runs.finish(run_features(runs, flagged, history).where("lap_valid"))
    if require_target:
        table = table.where(has_target())
    table = attach_bundled(table, flagged.where("lap_valid"), names) if together else attach_priors(table, flagged, names, split)
    usable = has_target()
    return table.withColumns(
        {
            TARGET: F.when(usable, F.col(RAW_TARGET) - F.col("rolling_median_5")),
            "lap_validity_version": F.lit(LAP_VALIDITY_VERSION),
        }
    ).withColumn(RAW_TARGET, F.when(usable, F.col(RAW_TARGET)))


def next_lap_table_v0(raw: DataFrame, split: bool = False) -> DataFrame:
    """The older, simpler table: laps that are accurate, not deleted and not pit laps; rolling
    values over whatever laps remain of a run, adjacency required for the target only."""
    df = raw
    for name, default in (("is_accurate", True), ("deleted", False), ("pit_in", False), ("pit_out", False)):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default))
    keep = F.coalesce(F.col("is_accurate"), F.lit(False))
    for name in ("deleted", "pit_in", "pit_out"):
        keep = keep & ~F.coalesce(F.col(name), F.lit(False))
    runs = runs_of(df.where(keep), split)
    w = runs.window()
    out = runs.with_halo(runs.df, before=5, after=1)
    out = out.withColumn("_delta", F.col("lap_time_s") - F.lag("lap_time_s").over(w))
    shifts = {f"_t{k}": F.lag("lap_time_s", k).over(w) for k in range(1, 5)}
    shifts |= {f"_d{k}": F.lag("_delta", k).over(w) for k in (1, 2)}
    shifts |= {RAW_TARGET: F.lead("lap_time_s").over(w), "next_lap_number": F.lead("lap_number").over(w)}
    out = runs.finish(runs.core(out.withColumns(shifts)))

    def compact(*names: str) -> list[Column]:
        return [F.col(n) for n in names]

    out = out.withColumns(
        {
            "rolling_median_3": _median(compact("lap_time_s", "_t1", "_t2")),
            "rolling_median_5": _median(compact("lap_time_s", "_t1", "_t2", "_t3", "_t4")),
            "pace_trend_3": _mean(compact("_delta", "_d1", "_d2")),
        }
    )
    return (
        out.withColumns(
            {
                "lap_delta_to_rolling5": F.col("lap_time_s") - F.col("rolling_median_5"),
                TARGET: F.col(RAW_TARGET) - F.col("rolling_median_5"),
            }
        )
        .where((F.col("next_lap_number") - F.col("lap_number") == 1) & F.col(RAW_TARGET).isNotNull())
        .drop("_delta", "_t1", "_t2", "_t3", "_t4", "_d1", "_d2")
    )
