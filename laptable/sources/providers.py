"""Provider tables to the lap schema. Everything starts from landed rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laptable.functions.coerce import driver_code, lap_seconds, number, timestamp, true_text
from laptable.functions.dims import SESSION_NAMES, literal_map, with_event_location, with_location, with_team
from laptable.functions.groups import join_on, unpruned
from laptable.operators.intervals import lap_track_status, track_status_intervals
from laptable.operators.lap_state import accuracy_rule, lap_end_time, legacy_validity, with_pit_flags
from laptable.operators.timed_joins import (
    WEATHER_TOLERANCE_S,
    asof_backward,
    asof_nearest,
    deleted_laps,
    stint_range_join,
    weather_defaults,
)

# --- Fixed values: tiers, first season of the timing tier, weather column names ------------
LEGACY_TIER = "legacy_timing"
LEGACY_CHECK_TIER = "legacy_timing_check_only"
FIRST_TIMING_SEASON = 2018
OPEN_TIER = "openf1_timing"
ARCHIVE_TIER = "tracinginsights_timing"
WEATHER = {
    "air_temperature": "air_temp_c",
    "track_temperature": "track_temp_c",
    "humidity": "humidity_pct",
    "pressure": "pressure_mbar",
    "rainfall": "rainfall",
    "wind_speed": "wind_speed_ms",
    "wind_direction": "wind_direction_deg",
}
LOCATION_ALIASES = {"Yas Marina": "Yas Island"}
SETTLE_HOURS = 3


# --- timing tier ---------------------------------------------------------------------------
def normalize_timing(rows: DataFrame) -> DataFrame:
    """Laps of the timing library (landed) in the lap schema: day-time intervals to seconds,
    pit markers from the presence of a pit time."""

    def seconds(column: str) -> Column:
        return F.col(column).cast("interval day to second").cast("decimal(20,6)").cast("double") if dict(rows.dtypes)[column].startswith("interval") else number(column)

    return rows.select(
        F.col("season").try_cast("int").alias("season"), F.lit("F1").alias("series"), F.col("round_number").try_cast("int").alias("round_number"),
        "event", "circuit", F.col("event_date").cast("string").alias("event_date"), "session",
        F.col("Driver").cast("string").alias("driver"), F.col("Team").cast("string").alias("team"),
        number("LapNumber").alias("lap_number"), seconds("LapTime").alias("lap_time_s"),
        *[seconds(f"Sector{i}Time").alias(f"sector{i}_s") for i in (1, 2, 3)],
        F.col("Compound").alias("compound"), number("TyreLife").alias("tyre_life"), number("FreshTyre").alias("fresh_tyre"),
        F.lit("Pirelli").alias("tyre_manufacturer"), number("Stint").alias("stint"), number("Position").alias("position"),
        F.col("TrackStatus").cast("string").alias("track_status"),
        F.col("PitInTime").isNotNull().alias("pit_in"), F.col("PitOutTime").isNotNull().alias("pit_out"),
        F.col("IsAccurate").alias("is_accurate"), F.col("Deleted").alias("deleted"),
        F.lit("fastf1_timing").alias("data_tier"),
    )


# --- relational dump ------------------------------------------------------------------------
def read_dump(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The relational dump's CSV files; ``\\N`` is null. Pit stops may be absent."""
    names = ["lap_times", "races", "drivers", "results", "constructors", "circuits"]
    tables = {n: spark.read.csv(f"{folder}/{n}.csv", header=True, nullValue="\\N") for n in names}
    try:
        tables["pit_stops"] = spark.read.csv(f"{folder}/pit_stops.csv", header=True, nullValue="\\N")
    except AnalysisException:  # only dumps with pit stops have the file
        tables["pit_stops"] = spark.createDataFrame([], "raceId string, driverId string, lap string")
    return tables


def ergast_season_laps(tables: dict[str, DataFrame], seasons: list[int] | None = None, split: bool = False) -> DataFrame:
    """Legacy-tier laps from the seven-table star. The season filter goes to the small race
    table, and the lap table meets it first."""
    races = tables["races"]
    if seasons is not None:
        races = races.where(F.col("year").try_cast("int").isin(seasons))
    race = races.select("raceId", F.col("year").try_cast("int").alias("season"), F.col("round").try_cast("int").alias("round_number"), F.col("name").alias("event"), F.col("date").alias("event_date"), "circuitId")
    race = with_location(race.join(tables["circuits"].select("circuitId", "circuitRef", "location"), "circuitId", "left"), "circuitRef", "location")
    drivers = tables["drivers"].select("driverId", F.col("driverRef").alias("driver_id"), driver_code(F.col("code"), F.col("surname")).alias("driver"))
    # The first result row of a driver in a race decides the team.
    results = tables["results"].groupBy("raceId", "driverId").agg(F.min_by("constructorId", F.col("resultId").try_cast("bigint")).alias("constructorId"))
    entries = results.join(tables["constructors"].select("constructorId", "constructorRef", F.col("name").alias("_constructor")), "constructorId", "left")
    entries = with_team(entries.join(races.select("raceId", F.col("year").try_cast("int").alias("_season")), "raceId"), "constructorRef", "_season", "_constructor")
    laps = tables["lap_times"].select("raceId", "driverId", F.col("lap").try_cast("double").alias("lap_number"), "position", "time", "milliseconds")
    laps = laps.join(race.drop("circuitId", "circuitRef", "location"), "raceId")
    laps = with_pit_flags(laps, tables["pit_stops"].select("raceId", "driverId", F.col("lap").try_cast("double").alias("lap_number")), ["raceId", "driverId"])
    laps = laps.join(entries.select("raceId", "driverId", "team"), ["raceId", "driverId"], "left").join(drivers, "driverId", "left")
    frame = laps.select(
        "season", F.lit("F1").alias("series"), "round_number", "event", "circuit", F.col("event_date").cast("string").alias("event_date"),
        F.lit("R").alias("session"), F.coalesce("driver", F.lit("UNK")).alias("driver"), "driver_id", "team", "lap_number",
        F.coalesce(F.col("milliseconds").try_cast("double") / 1000, lap_seconds(F.col("time"))).alias("lap_time_s"),
        number("position").alias("position"), "pit_in", "pit_out", F.lit(LEGACY_TIER).alias("data_tier"),
    )
    return legacy_validity(frame, split)


def ergast_export(laps: DataFrame, seasons: list[int], include_timing_era: bool = False) -> DataFrame:
    """Chosen seasons; those the timing tier covers only on request, tagged check-only."""
    late = [s for s in seasons if s >= FIRST_TIMING_SEASON]
    if late and not include_timing_era:
        raise ValueError(f"Seasons {late} belong to the timing tier; pass include_timing_era=True to export them for provider checks")
    tier = F.when(F.col("season") >= FIRST_TIMING_SEASON, LEGACY_CHECK_TIER).otherwise(F.col("data_tier"))
    return laps.where(F.col("season").isin(seasons)).withColumn("data_tier", tier)


# --- nested result pages --------------------------------------------------------------------
PAGES_SCHEMA = """
season string, round string, raceName string, date string,
Circuit struct<circuitId string, Location struct<locality string>>,
Laps array<struct<number string, Timings array<struct<driverId string, position string, time string>>>>,
Results array<struct<Driver struct<driverId string, code string, familyName string>, Constructor struct<constructorId string, name string>>>,
PitStops array<struct<driverId string, lap string>>
"""


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed race pages, one JSON document per line; laps of a race may span several."""
    return spark.read.schema(PAGES_SCHEMA).json(path)


def jolpica_race_laps(pages: DataFrame, split: bool = False) -> DataFrame:
    """Legacy-tier laps from nested race pages. Laps, results and pit stops of a race may sit
    in different pages, so each is flattened on its own and joined by race and driver."""
    race = ["season", "round_number"]
    base = pages.withColumns({"season": F.col("season").try_cast("int"), "round_number": F.col("round").try_cast("int")})
    timings = (
        base.select(*race, F.col("raceName").alias("event"), F.col("date").alias("event_date"), "Circuit", F.explode("Laps").alias("l"))
        .select("*", F.explode("l.Timings").alias("t"))
        .select(*race, "event", "event_date", F.col("Circuit.circuitId").alias("_circuit"), F.col("Circuit.Location.locality").alias("_locality"),
                F.col("l.number").try_cast("double").alias("lap_number"), F.col("t.driverId").alias("driver_id"),
                F.col("t.position").try_cast("double").alias("position"), F.col("t.time").alias("_time"))
    )
    entry = base.select(*race, F.explode("Results").alias("r")).select(
        *race, F.col("r.Driver.driverId").alias("driver_id"),
        driver_code(F.col("r.Driver.code"), F.coalesce("r.Driver.familyName", "r.Driver.driverId")).alias("_code"),
        F.col("r.Constructor.constructorId").alias("_ref"), F.col("r.Constructor.name").alias("_name"),
    )
    entry = with_team(entry, "_ref", "season", "_name").groupBy(*race, "driver_id").agg(F.max(F.struct("_code", "team")).alias("_entry")).select(*race, "driver_id", "_entry.*")
    stops = base.select(*race, F.explode("PitStops").alias("p")).select(
        *race, F.col("p.driverId").alias("driver_id"), F.col("p.lap").try_cast("double").alias("lap_number")
    )
    laps = with_pit_flags(with_location(timings, "_circuit", "_locality"), stops, [*race, "driver_id"])
    laps = laps.join(entry, [*race, "driver_id"], "left")
    return legacy_validity(
        laps.select(
            *race, F.lit("F1").alias("series"), "event", "circuit", "event_date", F.lit("R").alias("session"),
            F.coalesce(F.col("_code"), F.upper(F.substring("driver_id", 1, 3))).alias("driver"), "driver_id", "team", "lap_number",
            lap_seconds(F.col("_time")).alias("lap_time_s"), "position", "pit_in", "pit_out", F.lit(LEGACY_TIER).alias("data_tier"),
        ),
        split,
    )


# --- live-timing endpoints --------------------------------------------------------------------
def openf1_meetings(meetings: DataFrame) -> DataFrame:
    """Race weekends in calendar order with their round; testing and cancelled ones left out.
    A season has a few dozen meetings, so the window is small by nature."""
    held = meetings.where(
        ~F.contains(F.lower(F.coalesce(F.col("meeting_name"), F.lit(""))), F.lit("testing"))
        & ~F.coalesce(F.col("is_cancelled").try_cast("boolean"), F.lit(False))
    )
    order = Window.partitionBy("year").orderBy("date_start", "meeting_key")
    return held.withColumn("round_number", F.row_number().over(order))


def meeting_sessions(sessions: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Sessions with a known code, optionally only the given codes."""
    coded = sessions.withColumn("session_code", F.try_element_at(literal_map(SESSION_NAMES), F.col("session_name")))
    wanted = F.col("session_code").isNotNull()
    return coded.where(wanted & F.col("session_code").isin(codes) if codes else wanted)


def openf1_session_laps(tables: dict[str, DataFrame], split: bool = False) -> DataFrame:
    """All laps of all given sessions, from the landed endpoint tables.

    ``sessions`` carries session_key, year, session_code, date_end, meeting_name, location,
    event_date and round_number (one row per session). Every step is keyed by the session.
    """
    key, who = "session_key", ["session_key", "driver_number"]
    sessions = tables["sessions"]
    laps = tables["laps"].select(
        key, F.col("driver_number").try_cast("bigint").alias("driver_number"), number("lap_number").alias("lap_number"),
        number("lap_duration").alias("lap_time_s"), timestamp("date_start").alias("lap_start"),
        *[number(f"duration_sector_{i}").alias(f"sector{i}_s") for i in (1, 2, 3)],
        F.coalesce(F.col("is_pit_out_lap").try_cast("boolean"), F.lit(False)).alias("_pit_out"),
    ).where("lap_number is not null")
    last_start = laps.groupBy(key).agg(F.max("lap_start").alias("_last"))
    ends = sessions.join(last_start, key, "left").select(
        key, F.coalesce(timestamp("date_end"), F.col("_last") + F.expr("interval 5 minutes")).alias("session_end")
    )
    # Steps that read their laps twice come while the laps are narrow; the other reading is of the laps as landed, or shares its shuffles.
    # The three joins by lap number follow each other, so the laps are shuffled for the first only, and so do the two joins by driver.
    held = laps.join(ends, key)
    laps = unpruned(lap_end_time(held, who, F.col("session_end"), split), unfiltered=True)
    messages = tables["race_control"].withColumn("date", timestamp("date"))
    intervals = track_status_intervals(messages, ends, split)
    laps = lap_track_status(laps, intervals, [*who, "lap_number"], split)
    pits = tables["pit"].select(key, F.col("driver_number").try_cast("bigint").alias("driver_number"), F.col("lap_number").try_cast("double").alias("lap_number"))
    laps = with_pit_flags(laps, pits, who).withColumn("pit_out", F.col("_pit_out")).drop("_pit_out")
    stints = tables["stints"].withColumn("driver_number", F.col("driver_number").try_cast("bigint"))
    laps = stint_range_join(laps, stints, who, source=held)
    laps = deleted_laps(laps, messages, split, held)
    laps = accuracy_rule(unpruned(laps, unfiltered=True), who, split)
    drivers = tables["drivers"].groupBy(key, F.col("driver_number").try_cast("bigint").alias("driver_number")).agg(F.max(F.struct(F.col("name_acronym").alias("_code"), F.col("team_name").alias("team"))).alias("_entry")).select(*who, "_entry.*")
    laps = join_on(laps, drivers.dropna(subset=who), who)
    # Updates of one instant count in the order they were landed in, where the table says it.
    landed = "ingest_id" if "ingest_id" in tables["position"].columns else "position"
    positions = tables["position"].select(
        key, F.col("driver_number").try_cast("bigint").alias("driver_number"), timestamp("date").alias("_when"), number("position").alias("position"),
        number(landed).alias("_landed"),
    )
    laps = asof_backward(laps, positions, who, "lap_end", "_when", ["position"], sequence="_landed", split=split)
    weather = tables["weather"].select(key, timestamp("date").alias("_when"), *[number(a).alias(b) for a, b in WEATHER.items()])
    laps = asof_nearest(laps, weather, [key], "lap_start", "_when", list(WEATHER.values()), WEATHER_TOLERANCE_S, split=split)
    laps = laps.withColumns(weather_defaults()).join(
        sessions.select(key, F.col("year").alias("season"), "session_code", F.col("meeting_name").alias("event"), F.coalesce("location", F.lit("")).alias("_location"), "event_date", "round_number"), key
    )
    return laps.select(
        F.col("season").try_cast("int").alias("season"), F.lit("F1").alias("series"), F.col("round_number").try_cast("int").alias("round_number"), "event",
        F.coalesce(F.try_element_at(literal_map(LOCATION_ALIASES), F.col("_location")), F.col("_location")).alias("circuit"),
        "event_date", F.col("session_code").alias("session"),
        F.coalesce(F.col("_code"), F.concat(F.lit("#"), F.col("driver_number").cast("string"))).alias("driver"), "team",
        "lap_number", "lap_time_s", "sector1_s", "sector2_s", "sector3_s", "compound", "tyre_life", "fresh_tyre", F.lit("Pirelli").alias("tyre_manufacturer"),
        "stint", "position", "track_status", "pit_in", "pit_out", "is_accurate", "deleted", F.lit(OPEN_TIER).alias("data_tier"),
        *WEATHER.values(), "driver_number", key,
    )


# --- columnar session JSON ----------------------------------------------------------------------
COLUMNAR_KEYS = [
    "lap", "time", "s1", "s2", "s3", "compound", "life", "fresh", "stint", "pos", "status", "pin", "pout", "iacc", "del",
    "drv", "team", "lSD", "wAT", "wTT", "wH", "wP", "wR", "wWS", "wWD",
]


def columnar_json_laps(documents: DataFrame) -> DataFrame:
    """Laps from one-list-per-key session documents: season, event, session_code and one array
    of texts per key. A list of another length than ``lap`` is a missing column; the text
    ``None`` is a missing value. A document is one session, a few thousand laps."""
    n = F.size("lap")
    aligned = documents.select(
        "season", "event", "session_code",
        *[F.when(F.size(F.col(k)) == n, F.col(k)).otherwise(F.array_repeat(F.lit(None).cast("string"), n)).alias(k)
          if k in documents.columns else F.array_repeat(F.lit(None).cast("string"), n).alias(k) for k in COLUMNAR_KEYS],
    )
    dates = F.transform("lSD", lambda v: F.try_to_timestamp(v))
    rows = aligned.withColumn("event_date", F.date_format(F.array_min(dates), "yyyy-MM-dd")).select(
        "season", "event", "session_code", "event_date", F.explode(F.arrays_zip(*COLUMNAR_KEYS)).alias("r")
    )

    def text(k: str) -> Column:
        return F.nullif(F.col(f"r.{k}"), F.lit("None"))

    def num(k: str) -> Column:
        return number(text(k))

    frame = rows.select(
        F.col("season").try_cast("int").alias("season"), F.lit("F1").alias("series"), F.lit(None).cast("int").alias("round_number"), "event", "event_date",
        F.col("session_code").alias("session"), text("drv").alias("driver"), text("team").alias("team"), num("lap").alias("lap_number"),
        num("time").alias("lap_time_s"), num("s1").alias("sector1_s"), num("s2").alias("sector2_s"), num("s3").alias("sector3_s"),
        text("compound").alias("compound"), num("life").alias("tyre_life"), true_text(text("fresh")).alias("fresh_tyre"),
        F.lit("Pirelli").alias("tyre_manufacturer"), num("stint").alias("stint"), num("pos").alias("position"),
        F.coalesce(text("status"), F.lit("1")).alias("track_status"), text("pin").isNotNull().alias("pit_in"), text("pout").isNotNull().alias("pit_out"),
        true_text(text("iacc")).alias("is_accurate"), true_text(text("del")).alias("deleted"), F.lit(ARCHIVE_TIER).alias("data_tier"),
        num("wAT").alias("air_temp_c"), num("wTT").alias("track_temp_c"), num("wH").alias("humidity_pct"), num("wP").alias("pressure_mbar"),
        true_text(text("wR")).alias("rainfall"), num("wWS").alias("wind_speed_ms"), F.coalesce(num("wWD"), F.lit(0.0)).alias("wind_direction_deg"),
        timestamp(text("lSD")).alias("lap_start_time"),
    )
    return with_event_location(frame, "event", "season")


# --- calendar ---------------------------------------------------------------------------------
def apply_calendar(laps: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Round, circuit and date per (season, event) from another lap table. Events it lacks keep
    their own circuit and date and have no round."""
    if calendar is None or not {"season", "event"} <= set(calendar.columns):
        return laps.withColumn("round_number", F.lit(None).cast("int"))
    names = {"round_number": "int", "circuit": "string", "event_date": "string"}
    values = [(F.col(c) if c in calendar.columns else F.lit(None)).try_cast(t).alias(f"_{c}") for c, t in names.items()]
    # One row of the calendar decides all three: the first as it was filed, else the smallest.
    row = F.struct(*values)
    first = F.min_by(row, "ingest_id") if "ingest_id" in calendar.columns else F.min(row)
    known = calendar.groupBy("season", "event").agg(first.alias("_first")).select("season", "event", "_first.*")
    joined = laps.join(known, ["season", "event"], "left")
    return joined.withColumns(
        {"round_number": F.col("_round_number"), "circuit": F.coalesce("_circuit", "circuit"), "event_date": F.coalesce("_event_date", "event_date")}
    ).drop("_round_number", "_circuit", "_event_date")


def calendar_select(schedule: DataFrame, today: Column, keywords: list[str] | None = None, first: int = 0) -> DataFrame:
    """Past events whose event name, location or country contains any keyword; the first
    ``first`` of them in calendar order when that is positive."""
    out = schedule.where((F.col("round_number") > 0) & (F.to_date("event_date") <= today))
    if keywords:
        text = F.lower(F.concat_ws(" ", "event", "location", "country"))
        out = out.where(F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(text, k)))
    return out.orderBy("event_date", "round_number").limit(first) if first > 0 else out


def completed_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions that ended at least three hours ago; later ones may still change."""
    return sessions.where(F.col("date_end") + F.expr(f"interval {SETTLE_HOURS} hours") <= now)


# --- run records -------------------------------------------------------------------------------
METRICS = "struct<mae_s double, rmse_s double, median_ae_s double, p90_ae_s double, signed_bias_s double, within_0_5s_share double, within_1s_share double, mape_pct double, r2 double, interval80_coverage double, interval80_width_s double, rows bigint>"
RUN_SCHEMA = f"""
artifact string, name string, model string, training_policy string, data_source string, is_synthetic boolean, created_utc string, input_file string,
lap_validity_version int, validation {METRICS}, test {METRICS}, models map<string, struct<validation {METRICS}, test {METRICS}>>,
test_by_driver map<string, {METRICS}>
"""


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records, one JSON document per file."""
    return spark.read.schema(RUN_SCHEMA).json(path, multiLine=True)


def flatten_runs(runs: DataFrame) -> DataFrame:
    """One row per run; a baseline record is one row per model it holds."""
    common = ["artifact", "data_source", "is_synthetic", "created_utc", "input_file", "training_policy"]
    many = runs.where("models is not null").select(*common, F.explode("models").alias("m", "r")).select(
        F.concat_ws("/", "artifact", "m").alias("run"), F.col("m").alias("model"), F.lit("baseline").alias("method"),
        "r.validation", "r.test", *common,
    )
    one = runs.where("models is null").select(
        F.col("artifact").alias("run"), F.coalesce("name", "model", "artifact").alias("model"),
        F.when(F.contains("training_policy", F.lit("forward-forward")), "forward-forward").otherwise(F.col("training_policy")).alias("method"),
        "validation", "test", *common,
    )
    return one.unionByName(many)


def driver_error_report(runs: DataFrame) -> DataFrame:
    """Per-driver test metrics of every run that has them."""
    return runs.where("test_by_driver is not null").select(
        "artifact", F.coalesce("name", "artifact").alias("name"), F.coalesce("is_synthetic", F.lit(False)).alias("is_synthetic"),
        F.explode("test_by_driver").alias("driver", "m"),
    ).select("artifact", "name", "is_synthetic", "driver", "m.*")


BREAKDOWN_SCHEMA = "name string, title string, models array<string>, rows bigint, breakdowns map<string, map<string, map<string, double>>>"


def breakdown_catalog(reports: DataFrame) -> DataFrame:
    """Committed breakdown reports: name, title, models, rows and the dimensions they hold."""
    return reports.select(
        "name", "title", F.coalesce("models", F.array().cast("array<string>")).alias("models"), "rows",
        F.array_sort(F.map_keys("breakdowns")).alias("dimensions"),
    )
