"""Sessions: running order, listing, selection, and the rows a forecast starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laptable.functions.coerce import is_blank, number
from laptable.functions.dims import SPRINT_CODES, session_code, weekend_rank
from laptable.functions.groups import OrderedGroups, join_on
from laptable.schema import RAW_TARGET, RUN_KEYS

SESSION = ["season", "event", "session"]
CHRONOLOGICAL = ["season", "round_number", "event_date", "event", "session_rank", "lap_number"]


def addressable() -> Column:
    """A whole-number season and non-blank event and session names."""
    season = number("season")
    return F.coalesce(season == F.floor(season), F.lit(False)) & ~is_blank("event") & ~is_blank("session")


def with_session_rank(df: DataFrame) -> DataFrame:
    """Place of each row's session in its weekend. A weekend with any sprint session is a
    sprint weekend; the few distinct sessions are ranked and joined back, so no window ever
    holds the laps of a weekend."""
    season = number("season")
    distinct = df.select(season.alias("_season"), F.col("event"), session_code(F.col("session")).alias("_code"), "session").distinct()
    sprint = distinct.groupBy("_season", "event").agg(F.max(F.col("_code").isin(SPRINT_CODES)).alias("_sprint"))
    ranked = join_on(distinct, sprint, ["_season", "event"]).select(
        "_season", "event", "session", weekend_rank(F.col("_code"), F.col("_season"), F.coalesce("_sprint", F.lit(False))).alias("session_rank")
    )
    return join_on(df.withColumn("_season", season), ranked, ["_season", "event", "session"]).drop("_season")


def chronological_sort(df: DataFrame) -> DataFrame:
    """Rows in the order the laps were driven."""
    ranked = with_session_rank(df)
    return ranked.orderBy(*[c for c in CHRONOLOGICAL if c in ranked.columns], "session", "driver")


def session_warning(column: str = "session") -> Column:
    """Text for sessions that are not races; null for races and sprints."""
    code = F.upper(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))))
    name = F.when(code == "", "non-race").otherwise(code)
    return F.when(
        ~code.isin("R", "RACE", "S", "SPRINT"),
        F.concat(F.lit("This is a "), name, F.lit(" session; models are trained on race laps only.")),
    )


def latest_session(df: DataFrame) -> DataFrame:
    """Rows of the chronologically last addressable session. The last key comes from one
    aggregation over distinct sessions, not from a sort of the laps."""
    keys = [c for c in CHRONOLOGICAL if c in [*df.columns, "session_rank"]]
    usable = df.where(addressable())
    heads = usable.groupBy(*SESSION, *[c for c in ("round_number", "event_date") if c in df.columns]).agg(F.max("lap_number").alias("lap_number"))
    # A missing round or date sorts after all known ones.
    order = F.struct(*[part for c in keys for part in (F.col(c).isNull(), F.col(c))], F.col("session"))
    last = with_session_rank(heads).agg(F.max_by(F.struct(*SESSION), order).alias("s")).select("s.*")
    return df.join(F.broadcast(last), SESSION, "left_semi")


def select_session(df: DataFrame, season: int | None = None, event: str | None = None, session: str | None = None) -> DataFrame:
    """The named session, or the latest one inside whatever is named."""
    scope = df
    if event is not None:
        scope = scope.where(F.col("event").cast("string") == event)
    if season is not None:
        scope = scope.where(number("season") == int(season))
    if session is not None:
        scope = scope.where(F.col("session").cast("string") == session)
    chosen = latest_session(scope)
    if chosen.isEmpty():
        raise ValueError(f"No laps for session {[v for v in (season, event, session) if v is not None]}")
    return chosen


def list_sessions(df: DataFrame) -> DataFrame:
    """Every session with laps, drivers, codes and date; blank identities are listed under a
    placeholder and cannot be selected."""
    season = number("season")
    named = df.select(
        F.when(season == F.floor(season), season.cast("int")).alias("season"),
        F.when(is_blank("event"), "(missing event)").otherwise(F.col("event").cast("string")).alias("event"),
        F.when(is_blank("session"), "(missing session)").otherwise(F.col("session").cast("string")).alias("session"),
        addressable().alias("selectable"),
        F.coalesce(F.col("driver").cast("string"), F.lit("nan")).alias("driver"),
        *[F.substring(F.col("event_date").cast("string"), 1, 10).alias("date") if "event_date" in df.columns else F.lit(None).cast("string").alias("date")],
    )
    # Laps are counted per driver first; a session then meets one row per driver.
    per_driver = named.groupBy(*SESSION, "selectable", "driver").agg(F.count(F.lit(1)).alias("laps"), F.min("date").alias("date"))
    listed = per_driver.groupBy(*SESSION, "selectable").agg(
        F.sum("laps").alias("laps"), F.count(F.lit(1)).alias("drivers"),
        F.array_sort(F.collect_list("driver")).alias("driver_codes"), F.min("date").alias("date"),
    )
    return with_session_rank(listed).orderBy("season", "date", "event", "session_rank", "session")


def _last_laps(df: DataFrame) -> DataFrame:
    """One row per run: its last lap number and the position and time on it."""
    columns = ["lap_number", "lap_time_s"] + (["position"] if "position" in df.columns else [])
    tie = F.struct(F.col("lap_number"), *[F.col(c).isNotNull() for c in columns[1:]], *columns[1:])
    return df.groupBy(*RUN_KEYS).agg(F.max_by(F.struct(*columns), tie).alias("_last"), F.count(F.lit(1)).alias("laps_driven"))


def pick_driver(df: DataFrame) -> DataFrame:
    """Default driver per session: most completed laps, then position on the last lap (a
    missing one counts as 99), then the code."""
    last = _last_laps(df)
    position = F.coalesce(F.col("_last.position").cast("double"), F.lit(99.0)) if "position" in df.columns else F.lit(99.0)
    return last.groupBy(*SESSION).agg(
        F.min_by(F.struct("driver", F.col("_last.lap_number").alias("lap_number"), position.alias("position")),
                 F.struct(-F.col("_last.lap_number"), position, "driver")).alias("p")
    ).select(*SESSION, "p.driver", "p.lap_number", "p.position")


def latest_forecast_row(laps: DataFrame, table: DataFrame, history: int = 5) -> DataFrame:
    """The row each driver's next-lap forecast starts from, for all drivers of all sessions.

    ``status`` is ``ok``, ``too_few_laps`` or ``not_usable`` (the latest timed lap is not a
    valid racing lap). ``laps`` is the raw lap table, ``table`` the inference feature table.
    """
    timed = laps.where(number("lap_time_s").isNotNull()).withColumn("lap_number", number("lap_number"))
    last = _last_laps(timed).select(*RUN_KEYS, F.col("_last.lap_number").alias("last_lap"), F.col("_last.lap_time_s").alias("last_lap_time_s"), "laps_driven")
    ends = last.groupBy(*SESSION).agg(F.max("last_lap").alias("session_last_lap"))
    last = join_on(last, ends, SESSION)
    rows = join_on(last, table.withColumn("last_lap", F.col("lap_number")).drop("laps_driven"), [*RUN_KEYS, "last_lap"])
    return rows.withColumns(
        {
            "status": F.when(F.col("laps_driven") < 2, "too_few_laps").when(F.col("lap_number").isNull(), "not_usable").otherwise("ok"),
            "race_finished": F.col("last_lap") >= F.col("session_last_lap"),
            "short_history": F.col("laps_driven") < history,
        }
    )


def last_n_pairs(table: DataFrame, laps: int) -> DataFrame:
    """The last ``laps`` scored lap pairs of every driver in every session. A run is bounded
    in laps; for a very large one the filter on the descending rank becomes a per-partition
    top-n before the shuffle."""
    if laps < 1:
        raise ValueError("laps must be >= 1")
    order = Window.partitionBy(*RUN_KEYS).orderBy(F.col("lap_number").desc(), F.col(RAW_TARGET).desc())
    return table.where(F.col(RAW_TARGET).isNotNull()).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= laps).drop("_rank")


def next_lap_outcome(runs: OrderedGroups, flagged: DataFrame) -> DataFrame:
    """What happened on the lap after each lap: time, adjacency, validity, pit-in, SC or VSC."""
    w = runs.window()
    df = runs.with_halo(flagged, before=0, after=1)
    df = df.withColumns(
        {
            "next_time_s": F.lead("lap_time_s").over(w),
            "next_lap": F.lead("lap_number").over(w),
            "next_valid": F.lead("lap_valid").over(w),
            "next_pit_in": F.lead("is_pit_in").over(w),
            "next_neutralised": F.coalesce(F.lead("is_safety_car").over(w), F.lit(False)) | F.coalesce(F.lead("is_vsc").over(w), F.lit(False)),
        }
    )
    return runs.finish(runs.core(df)).withColumn("next_adjacent", F.coalesce(F.col("next_lap") == F.col("lap_number") + 1, F.lit(False)))


