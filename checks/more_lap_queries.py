"""Queries over laps: scalars, validity of other tiers, sessions, splits, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import LAPS, SEGMENTS, STATE, laps
from checks.lap_queries import BINNED, KEY_SQL, KEYS, UPTO_PACE, features, flagged, r6, s6
from laptable.functions import coerce, dims
from laptable.operators import features as feat
from laptable.operators import lap_state, sessions, splits, validation, windows
from laptable.schema import PRIOR_GROUPS, RAW_TARGET, TARGET

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


# --- scalar expressions --------------------------------------------------------------------
@register(
    "parse_lap_time",
    f"WITH {LAPS}, t AS (SELECT {KEY_SQL}, lap_time_s, CASE src_part % 3 WHEN 0 THEN (floor(lap_time_s / 60)::INT) || ':' || printf('%06.3f', lap_time_s - 60 * floor(lap_time_s / 60)) "
    "WHEN 1 THEN '1:' || printf('%02d', src_part % 60) || ':' || printf('%06.3f', src_part % 50 + 0.5) ELSE lap_time_s::VARCHAR END AS txt FROM laps) "
    f"SELECT {KEY_SQL}, CASE WHEN len(string_split(txt, ':')) = 1 THEN round(txt::DOUBLE, 6) WHEN len(string_split(txt, ':')) = 2 THEN round(split_part(txt, ':', 1)::INT * 60 + split_part(txt, ':', 2)::DOUBLE, 6) "
    "ELSE round(split_part(txt, ':', 1)::INT * 3600 + split_part(txt, ':', 2)::INT * 60 + split_part(txt, ':', 3)::DOUBLE, 6) END AS seconds FROM t",
)
def q_parse(spark, folder):
    minutes = F.floor(F.col("lap_time_s") / 60)
    text = (
        F.when(F.col("src_part") % 3 == 0, F.concat(minutes.cast("int").cast("string"), F.lit(":"), F.format_string("%06.3f", F.col("lap_time_s") - 60 * minutes)))
        .when(F.col("src_part") % 3 == 1, F.concat(F.lit("1:"), F.format_string("%02d", F.col("src_part") % 60), F.lit(":"), F.format_string("%06.3f", F.col("src_part") % 50 + F.lit(0.5))))
        .otherwise(F.col("lap_time_s").cast("string"))
    )
    df = laps(spark, folder).withColumn("text", F.when(F.col("lap_time_s").isNotNull() | (F.col("src_part") % 3 == 1), text))
    return df.select(*KEYS, F.round(coerce.lap_seconds(F.col("text")), 6).alias("seconds"))


@register(
    "driver_code",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN upper(substr(regexp_replace(s_name, '[^A-Za-z]', '', 'g'), 1, 3)) WHEN s_suppkey % 3 = 1 THEN 'NAT' ELSE 'UNK' END AS code FROM supplier",
)
def q_code(spark, folder):
    from checks.adapter import read

    df = read(spark, folder, "supplier")
    code = F.when(F.col("s_suppkey") % 3 == 1, F.lit(" nat1 ")).when(F.col("s_suppkey") % 3 == 2, F.lit("42"))
    return df.select("s_suppkey", coerce.driver_code(code, F.col("s_name")).alias("code"))


REFS = ["rb", "sauber", "alfa", "ferrari", "haas", "brawn"]


@register(
    "team_for_season",
    f"WITH {LAPS}, r AS (SELECT {KEY_SQL}, 2001 + src_part % 26 AS year, (['rb', 'sauber', 'alfa', 'ferrari', 'haas', 'brawn'])[(src_part % 6 + 1)::INT] AS ref, team FROM laps) "
    f"SELECT {KEY_SQL}, ref, CASE ref WHEN 'rb' THEN CASE WHEN year <= 2024 THEN 'RB' ELSE 'Racing Bulls' END WHEN 'sauber' THEN CASE WHEN year >= 2024 THEN 'Kick Sauber' ELSE 'Sauber' END "
    "WHEN 'alfa' THEN CASE WHEN year <= 2021 THEN 'Alfa Romeo Racing' ELSE 'Alfa Romeo' END WHEN 'ferrari' THEN 'Ferrari' WHEN 'haas' THEN 'Haas F1 Team' ELSE team END AS name FROM r",
)
def q_team(spark, folder):
    df = laps(spark, folder).withColumns(
        {"year": (F.lit(2001) + F.col("src_part") % 26).cast("int"), "ref": F.element_at(F.array(*[F.lit(r) for r in REFS]), (F.col("src_part") % 6 + 1).cast("int"))}
    )
    return dims.with_team(df, "ref", "year", "team", out="name").select(*KEYS, "ref", "name")


@register(
    "circuit_for_season",
    f"WITH {LAPS}, r AS (SELECT {KEY_SQL}, 2018 + src_part % 10 AS year, (['Monaco Grand Prix', 'Miami Grand Prix', 'Italian Grand Prix', 'Madrid Grand Prix'])[(src_part % 4 + 1)::INT] AS e, "
    "(['monza', 'spa', 'nowhere'])[(src_part % 3 + 1)::INT] AS ref, circuit FROM laps) "
    f"SELECT {KEY_SQL}, CASE e WHEN 'Monaco Grand Prix' THEN CASE WHEN year >= 2026 THEN 'Monte Carlo' WHEN year >= 2022 THEN 'Monaco' ELSE 'Monte Carlo' END "
    "WHEN 'Miami Grand Prix' THEN CASE WHEN year >= 2025 THEN 'Miami Gardens' ELSE 'Miami' END WHEN 'Italian Grand Prix' THEN 'Monza' ELSE 'Madrid' END AS by_event, "
    "CASE ref WHEN 'monza' THEN 'Monza' WHEN 'spa' THEN 'Spa-Francorchamps' ELSE circuit END AS by_id FROM r",
)
def q_circuit(spark, folder):
    events = ["Monaco Grand Prix", "Miami Grand Prix", "Italian Grand Prix", "Madrid Grand Prix"]
    df = laps(spark, folder).withColumns(
        {
            "year": (F.lit(2018) + F.col("src_part") % 10).cast("int"),
            "e": F.element_at(F.array(*[F.lit(e) for e in events]), (F.col("src_part") % 4 + 1).cast("int")),
            "ref": F.element_at(F.array(F.lit("monza"), F.lit("spa"), F.lit("nowhere")), (F.col("src_part") % 3 + 1).cast("int")),
        }
    )
    df = dims.with_event_location(df, "e", "year", out="by_event")
    return dims.with_location(df, "ref", "circuit", out="by_id").select(*KEYS, "by_event", "by_id")


@register(
    "coerce_values",
    f"WITH {LAPS}, t AS (SELECT {KEY_SQL}, src_part, CASE WHEN src_part % 5 = 0 THEN 'abc' WHEN src_part % 7 = 0 THEN NULL ELSE src_part::VARCHAR END AS n, "
    "CASE src_part % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'false' WHEN 2 THEN NULL ELSE 'true' END AS b FROM laps) "
    f"SELECT {KEY_SQL}, try_cast(n AS DOUBLE) AS num, coalesce(try_cast(b AS BOOLEAN), false) AS flg, coalesce(lower(b) = 'true', false) AS txt, "
    "CASE WHEN src_part % 3 = 0 THEN 1704067200000000 + (src_part % 86400) * 1000000 WHEN src_part % 3 = 1 THEN 1704067200000000 + (src_part % 86400) * 1000000 + 250000 END AS micros FROM t",
)
def q_coerce(spark, folder):
    part = F.col("src_part")
    clock = F.date_format(F.timestamp_seconds(F.lit(1704067200) + part % 86400), "yyyy-MM-dd'T'HH:mm:ss")
    df = laps(spark, folder).withColumns(
        {
            "n": F.when(part % 5 == 0, "abc").when(part % 7 == 0, None).otherwise(part.cast("string")),
            "b": F.when(part % 4 == 0, "True").when(part % 4 == 1, "false").when(part % 4 == 3, "true"),
            "t": F.when(part % 3 == 0, F.concat(clock, F.lit("+00:00"))).when(part % 3 == 1, F.concat(clock, F.lit(".250+00:00"))).otherwise("not a time"),
        }
    )
    return df.select(
        *KEYS, coerce.number("n").alias("num"), coerce.flag("b").alias("flg"), coerce.true_text(F.col("b")).alias("txt"),
        F.unix_micros(coerce.timestamp("t")).alias("micros"),
    )


@register(
    "fill_defaults",
    f"WITH {LAPS} SELECT {KEY_SQL}, 'F1' AS series, event AS circuit, 'Pirelli' AS tyre_manufacturer, CASE WHEN src_part % 3 = 0 THEN 'fastf1_timing' ELSE 'other' END AS data_tier, NULL::DOUBLE AS gap_ahead_s, "
    "false AS rainfall, true AS is_accurate, '1' AS track_status FROM laps",
)
def q_defaults(spark, folder):
    df = laps(spark, folder).select(*KEYS, "lap_time_s", F.when(F.col("src_part") % 3 != 0, "other").alias("data_tier"))
    return feat.fill_defaults(df).select(*KEYS, "series", "circuit", "tyre_manufacturer", "data_tier", "gap_ahead_s", "rainfall", "is_accurate", "track_status")


@register("driver_team", f"WITH {LAPS} SELECT {KEY_SQL}, driver || '@' || CASE WHEN src_part % 11 = 0 THEN 'None' ELSE team END AS driver_team FROM laps")
def q_driver_team(spark, folder):
    df = laps(spark, folder).withColumn("team", F.when(F.col("src_part") % 11 != 0, F.col("team")))
    return df.select(*KEYS, coerce.driver_team().alias("driver_team"))


@register(
    "event_order",
    f"WITH {LAPS} SELECT {KEY_SQL}, date_diff('day', DATE '1970-01-01', coalesce(CASE WHEN src_part % 13 = 0 THEN NULL ELSE event_date::DATE END, make_date(season, 1, 1)))::INT AS by_date, "
    "(date_diff('day', DATE '1970-01-01', make_date(season, 1, 1)) + round_number)::INT AS by_round FROM laps",
)
def q_event_order(spark, folder):
    df = laps(spark, folder).withColumn("event_date", F.when(F.col("src_part") % 13 == 0, "bad").otherwise(F.col("event_date")))
    return df.select(*KEYS, coerce.event_order(df.columns).alias("by_date"), coerce.event_order(["round_number"]).alias("by_round"))


BANDS_SQL = """
banded AS (
  SELECT *, CASE WHEN tyre_life > 0 AND tyre_life <= 5 THEN '1-5 laps' WHEN tyre_life > 5 AND tyre_life <= 15 THEN '6-15 laps' WHEN tyre_life > 15 AND tyre_life <= 30 THEN '16-30 laps'
      WHEN tyre_life > 30 AND tyre_life <= 999 THEN '31+ laps' ELSE 'unknown' END AS tyre_age,
    CASE WHEN rainfall THEN 'wet' ELSE 'dry' END AS conditions,
    CASE WHEN position > 0 AND position <= 3 THEN 'P1-P3' WHEN position > 3 AND position <= 10 THEN 'P4-P10' WHEN position > 10 AND position <= 99 THEN 'P11+' ELSE 'unknown' END AS running_position,
    CASE WHEN laps_in_segment <= 1 THEN '1 (first clean lap)' WHEN laps_in_segment <= 4 THEN '2-4' WHEN laps_in_segment <= 10 THEN '5-10' WHEN laps_in_segment <= 999 THEN '11+' ELSE 'unknown' END AS clean_lap_depth,
    CASE WHEN phase > 0 AND phase <= 0.33 THEN 'opening third' WHEN phase > 0.33 AND phase <= 0.66 THEN 'middle third' WHEN phase > 0.66 AND phase <= 1.0 THEN 'final third' ELSE 'nan' END AS race_phase
  FROM (SELECT *, lap_number / max(lap_number) OVER (PARTITION BY season, event) AS phase FROM usable WHERE has_target)
)"""
BAND_NAMES = ["tyre_age", "conditions", "running_position", "clean_lap_depth", "race_phase"]


@register("condition_bands", f"{UPTO_PACE}, {BANDS_SQL} SELECT {KEY_SQL}, {', '.join(BAND_NAMES)} FROM banded")
def q_bands(spark, folder):
    from laptable.operators.metrics import with_condition_bands

    return with_condition_bands(features(spark, folder, priors=[])).select(*KEYS, *BAND_NAMES)


@register(
    "value_range_violations",
    f"WITH {LAPS}, v AS (SELECT 'lap_time_s' AS \"column\", lap_time_s * 7 AS v, 30.0 AS lo, 600.0 AS hi FROM laps UNION ALL SELECT 'humidity_pct', humidity_pct * 2, 0, 100 FROM laps "
    "UNION ALL SELECT 'lap_number', lap_number * 5 - 5, 1, 200 FROM laps UNION ALL SELECT 'position', position, 1, 40 FROM laps) "
    "SELECT \"column\", count(*) AS violations, round(arg_max(v, abs(v - (lo + hi) / 2)), 6) AS example FROM v WHERE v < lo OR v > hi GROUP BY 1",
)
def q_ranges(spark, folder):
    df = laps(spark, folder).select(
        (F.col("lap_time_s") * 7).alias("lap_time_s"), (F.col("humidity_pct") * 2).alias("humidity_pct"), (F.col("lap_number") * 5 - 5).alias("lap_number"), "position"
    )
    return validation.value_range_violations(df).select("column", "violations", *r6("example"))


BLANKED = """
blanked AS (
  SELECT * REPLACE (CASE WHEN src_part % 509 = 0 THEN NULL WHEN src_part % 503 = 0 THEN '  ' ELSE event END AS event,
    CASE WHEN src_part % 499 = 0 THEN 'None' ELSE driver END AS driver, CASE WHEN src_part % 491 = 0 THEN season + 0.5 ELSE season END AS season,
    floor(lap_number / 2) AS lap_number) FROM laps
)"""


def blanked(spark, folder):
    part = F.col("src_part")
    return laps(spark, folder).withColumns(
        {
            "event": F.when(part % 509 == 0, None).when(part % 503 == 0, "  ").otherwise(F.col("event")),
            "driver": F.when(part % 499 == 0, "None").otherwise(F.col("driver")),
            "season": F.when(part % 491 == 0, F.col("season") + F.lit(0.5)).otherwise(F.col("season").cast("double")),
            "lap_number": F.floor(F.col("lap_number") / 2).cast("double"),
        }
    )


@register(
    "identity_checks",
    f"WITH {LAPS}, {BLANKED} SELECT 'blank_driver' AS \"check\", count(*) FILTER (driver IS NULL OR trim(driver) IN ('', 'nan', 'None')) AS \"rows\" FROM blanked "
    "UNION ALL SELECT 'blank_season', count(*) FILTER (season IS NULL) FROM blanked UNION ALL SELECT 'blank_event', count(*) FILTER (event IS NULL OR trim(event) IN ('', 'nan', 'None')) FROM blanked "
    "UNION ALL SELECT 'blank_session', count(*) FILTER (session IS NULL) FROM blanked UNION ALL SELECT 'not_numeric_season', 0 UNION ALL SELECT 'not_numeric_lap_number', 0 "
    "UNION ALL SELECT 'duplicate_lap', sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM blanked GROUP BY season, event, session, driver, lap_number)",
)
def q_identity(spark, folder):
    return validation.identity_checks(blanked(spark, folder))


@register(
    "addressable_rows",
    f"WITH {LAPS}, {BLANKED} SELECT season::DOUBLE AS season, event, session, driver, lap_number, src_order, src_part FROM blanked WHERE season = floor(season) AND event IS NOT NULL AND trim(event) <> ''",
)
def q_addressable(spark, folder):
    return validation.addressable_rows(blanked(spark, folder)).select(*KEYS, "src_order", "src_part")


SESSIONED = """
sessioned AS (
  SELECT * REPLACE (CASE src_order % 10 WHEN 0 THEN 'S' WHEN 1 THEN 'Q' WHEN 2 THEN 'FP1' ELSE 'R' END AS session, season + 26 AS season), src_order % 10 AS m FROM laps
)"""


def sessioned(spark, folder):
    """Several sessions per event; seasons moved to the years the weekend formats changed in."""
    m = F.col("src_order") % 10
    return laps(spark, folder).withColumns(
        {"session": F.when(m == 0, "S").when(m == 1, "Q").when(m == 2, "FP1").otherwise("R"), "season": F.col("season") + 26}
    )


@register(
    "session_code",
    f"WITH {LAPS} SELECT {KEY_SQL}, CASE src_order % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'FP1' WHEN 2 THEN 'R' WHEN 3 THEN 'SS' ELSE 'XYZ' END AS code FROM laps",
)
def q_session_code(spark, folder):
    m = F.col("src_order") % 5
    text = F.when(m == 0, "Sprint ").when(m == 1, "practice 1").when(m == 2, " r").when(m == 3, "SPRINT SHOOTOUT").otherwise("xyz")
    return laps(spark, folder).withColumn("session_text", text).select(*KEYS, dims.session_code(F.col("session_text")).alias("code"))


@register(
    "session_warning",
    f"WITH {LAPS}, {SESSIONED} SELECT {KEY_SQL}, src_part, src_order, CASE WHEN session NOT IN ('R', 'S') THEN 'This is a ' || session || ' session; models are trained on race laps only.' END AS warning FROM sessioned",
)
def q_warning(spark, folder):
    return sessioned(spark, folder).select(*KEYS, "src_part", "src_order", sessions.session_warning().alias("warning"))


RANK = """CASE session WHEN 'FP1' THEN 0 WHEN 'R' THEN 6 WHEN 'Q' THEN CASE WHEN NOT sprint THEN 3 WHEN season < 2024 THEN 1 ELSE 3 END
  WHEN 'S' THEN CASE WHEN season < 2024 THEN 4 ELSE 2 END ELSE 5 END"""


@register(
    "session_rank",
    f"WITH {LAPS}, {SESSIONED}, w AS (SELECT *, bool_or(session = 'S') OVER (PARTITION BY season, event) AS sprint FROM sessioned) "
    f"SELECT {KEY_SQL}, src_part, src_order, {RANK} AS session_rank FROM w",
)
def q_rank(spark, folder):
    return sessions.with_session_rank(sessioned(spark, folder)).select(*KEYS, "src_part", "src_order", "session_rank")


@register(
    "chronological_sort",
    f"WITH {LAPS}, {SESSIONED}, w AS (SELECT *, bool_or(session = 'S') OVER (PARTITION BY season, event) AS sprint FROM sessioned) "
    f"SELECT season, round_number, event_date, event, {RANK} AS session_rank, session, driver, lap_number FROM w ORDER BY season, round_number, event_date, event, session_rank, lap_number",
)
def q_sort(spark, folder):
    return sessions.chronological_sort(sessioned(spark, folder)).select("season", "round_number", "event_date", "event", "session_rank", "session", "driver", "lap_number")


@register(
    "latest_session",
    f"WITH {LAPS}, {SESSIONED}, w AS (SELECT *, bool_or(session = 'S') OVER (PARTITION BY season, event) AS sprint FROM sessioned), "
    f"r AS (SELECT *, {RANK} AS session_rank FROM w), l AS (SELECT season, event, session FROM r ORDER BY season DESC, round_number DESC, event_date DESC, event DESC, session_rank DESC, lap_number DESC LIMIT 1) "
    f"SELECT r.season, r.event, r.session, driver, lap_number, src_part FROM r JOIN l ON r.season = l.season AND r.event = l.event AND r.session = l.session",
)
def q_latest(spark, folder):
    return sessions.latest_session(sessioned(spark, folder)).select(*KEYS, "src_part")


@register(
    "select_session",
    f"WITH {LAPS}, {SESSIONED} SELECT season, event, session, driver, lap_number, src_part FROM sessioned WHERE season = 2024 AND session = 'Q' AND event = 'GP_4'",
)
def q_select(spark, folder):
    return sessions.select_session(sessioned(spark, folder), season=2024, session="Q").select(*KEYS, "src_part")


@register(
    "list_sessions",
    f"WITH {LAPS}, {SESSIONED}, w AS (SELECT *, bool_or(session = 'S') OVER (PARTITION BY season, event) AS sprint FROM sessioned) "
    f"SELECT season::INT AS season, event, session, true AS selectable, count(*) AS laps, count(DISTINCT driver) AS drivers, array_to_string(list_sort(list(DISTINCT driver)), ',') AS driver_codes, min(event_date) AS date, "
    f"any_value({RANK}) AS session_rank FROM w GROUP BY season, event, session",
)
def q_list(spark, folder):
    return sessions.list_sessions(sessioned(spark, folder)).select(
        "season", "event", "session", "selectable", F.col("laps").cast("bigint").alias("laps"), F.col("drivers").cast("bigint").alias("drivers"),
        F.array_join("driver_codes", ",").alias("driver_codes"), "date", "session_rank",
    )


LAST = "last_laps AS (SELECT season, event, session, driver, max(lap_number) AS last_lap, arg_max(position, lap_number) AS pos, count(*) AS n FROM laps WHERE lap_time_s IS NOT NULL GROUP BY ALL)"


@register(
    "pick_driver",
    f"WITH {LAPS}, {LAST} SELECT season, event, session, driver, last_lap AS lap_number, coalesce(pos, 99) AS position FROM last_laps "
    "QUALIFY row_number() OVER (PARTITION BY season, event, session ORDER BY last_lap DESC, coalesce(pos, 99), driver) = 1",
)
def q_pick(spark, folder):
    return sessions.pick_driver(laps(spark, folder).where("lap_time_s is not null"))


@register(
    "latest_forecast_row",
    f"{UPTO_PACE}, {LAST}, ends AS (SELECT season, event, session, max(last_lap) AS session_last_lap FROM last_laps GROUP BY ALL) "
    "SELECT l.season, l.event, l.session, l.driver, l.last_lap, l.n AS laps_driven, CASE WHEN l.n < 2 THEN 'too_few_laps' WHEN u.lap_number IS NULL THEN 'not_usable' ELSE 'ok' END AS status, "
    "l.last_lap >= e.session_last_lap AS race_finished, l.n < 5 AS short_history, round(u.rolling_median_5, 6) AS rolling_median_5 "
    "FROM last_laps l JOIN ends e USING (season, event, session) LEFT JOIN usable u ON u.lap_valid AND u.season = l.season AND u.event = l.event AND u.session = l.session AND u.driver = l.driver AND u.lap_number = l.last_lap",
)
def q_latest_row(spark, folder):
    table = features(spark, folder, priors=[], require_target=False)
    return sessions.latest_forecast_row(laps(spark, folder), table).select(
        "season", "event", "session", "driver", "last_lap", "laps_driven", "status", "race_finished", "short_history", *r6("rolling_median_5")
    )


@register(
    "last_n_pairs",
    f"{UPTO_PACE} SELECT {KEY_SQL}, round(next_time, 6) AS {RAW_TARGET}, round(rolling_median_5, 6) AS rolling_median_5 FROM usable WHERE has_target "
    "QUALIFY row_number() OVER (PARTITION BY season, event, session, driver ORDER BY lap_number DESC) <= 10",
)
def q_pairs(spark, folder):
    return sessions.last_n_pairs(features(spark, folder, priors=[]), 10).select(*KEYS, *r6(RAW_TARGET, "rolling_median_5"))


@register(
    "next_lap_outcome",
    f"WITH {LAPS}, {STATE}, o AS (SELECT *, lead(lap_time_s) OVER run AS nt, lead(lap_number) OVER run AS nl, lead(lap_valid) OVER run AS nv, lead(is_pit_in) OVER run AS np, lead(is_safety_car) OVER run AS ns, lead(is_vsc) OVER run AS nx FROM state "
    "WINDOW run AS (PARTITION BY season, event, session, driver ORDER BY lap_number)) "
    f"SELECT {KEY_SQL}, nt AS next_time_s, coalesce(nl = lap_number + 1, false) AS next_adjacent, nv AS next_valid, np AS next_pit_in, coalesce(ns, false) OR coalesce(nx, false) AS next_neutralised FROM o",
)
def q_outcome(spark, folder):
    runs, df = flagged(spark, folder)
    return sessions.next_lap_outcome(runs, df).select(*KEYS, "next_time_s", "next_adjacent", "next_valid", "next_pit_in", "next_neutralised")


# --- validity of other tiers ------------------------------------------------------------------
@register(
    "legacy_validity",
    f"WITH {LAPS}, m AS (SELECT *, median(lap_time_s) OVER (PARTITION BY season, event, driver) AS med FROM laps) "
    f"SELECT {KEY_SQL}, CASE WHEN season <= 2010 THEN 'Bridgestone' ELSE 'Pirelli' END AS tyre_manufacturer, coalesce(lap_number > 1 AND NOT pit_in AND NOT pit_out AND lap_time_s <= 1.12 * med, false) AS is_accurate FROM m",
)
def q_legacy(spark, folder):
    return lap_state.legacy_validity(laps(spark, folder)).select(*KEYS, "tyre_manufacturer", "is_accurate")


@register(
    "accuracy_rule",
    f"WITH {LAPS}, s AS (SELECT * REPLACE (CASE WHEN src_part % 3 = 0 THEN NULL WHEN src_part % 3 = 1 THEN lap_time_s - sector1_s - sector2_s ELSE sector3_s END AS sector3_s), "
    "NOT regexp_matches(coalesce(track_status, ''), '[4567]') AS clear FROM laps), "
    "c AS (SELECT *, clear AND NOT pit_in AND NOT pit_out AND lap_time_s IS NOT NULL AS clean FROM s), "
    "m AS (SELECT *, median(CASE WHEN clean THEN lap_time_s END) OVER (PARTITION BY season, event, driver) AS med FROM c) "
    f"SELECT {KEY_SQL}, coalesce(lap_number > 1 AND lap_time_s IS NOT NULL AND abs(sector1_s + sector2_s + sector3_s - lap_time_s) <= 0.05 AND NOT pit_in AND NOT pit_out AND clear AND NOT coalesce(clean AND lap_time_s > 1.2 * med, false), false) AS is_accurate FROM m",
)
def q_accuracy(spark, folder):
    third = F.when(F.col("src_part") % 3 == 1, F.col("lap_time_s") - F.col("sector1_s") - F.col("sector2_s")).when(F.col("src_part") % 3 == 2, F.col("sector3_s"))
    return lap_state.accuracy_rule(laps(spark, folder).withColumn("sector3_s", third), ["season", "event", "driver"]).select(*KEYS, "is_accurate")


@register(
    "pit_flags",
    f"WITH {LAPS}, p AS (SELECT DISTINCT season, event, driver, lap_number FROM laps WHERE pit_in) SELECT {', '.join('l.' + k for k in KEYS)}, "
    "EXISTS (SELECT 1 FROM p WHERE p.season = l.season AND p.event = l.event AND p.driver = l.driver AND p.lap_number = l.lap_number) AS pit_in, "
    "EXISTS (SELECT 1 FROM p WHERE p.season = l.season AND p.event = l.event AND p.driver = l.driver AND p.lap_number = l.lap_number - 1) AS pit_out FROM laps l",
)
def q_pits(spark, folder):
    base = laps(spark, folder)
    pits = base.where("pit_in").select("season", "event", "driver", "lap_number")
    return lap_state.with_pit_flags(base, pits, ["season", "event", "driver"]).select(*KEYS, "pit_in", "pit_out")


@register(
    "lap_end_time",
    f"WITH {LAPS}, s AS (SELECT *, make_timestamp(1704067200000000 + (lap_number * 90000000)::BIGINT) AS lap_start FROM laps) "
    f"SELECT {KEY_SQL}, epoch_us(coalesce(make_timestamp(epoch_us(lap_start) + round(lap_time_s * 1000000)::BIGINT), lead(lap_start) OVER (PARTITION BY season, event, session, driver ORDER BY lap_number), TIMESTAMP '2024-02-01')) AS end_us FROM s",
)
def q_end(spark, folder):
    df = laps(spark, folder).withColumn("lap_start", F.timestamp_micros(F.lit(1704067200000000) + (F.col("lap_number") * 90000000).cast("bigint")))
    out = lap_state.lap_end_time(df, ["season", "event", "session", "driver"], F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    return out.select(*KEYS, F.unix_micros("lap_end").alias("end_us"))


# --- splits and selection -----------------------------------------------------------------------
def split_query(name, case, apply):
    @register(name, f"{UPTO_PACE}, s AS (SELECT {KEY_SQL}, {case} AS split FROM usable WHERE has_target) SELECT * FROM s WHERE split IS NOT NULL")
    def query(spark, folder):
        return apply(features(spark, folder, priors=[])).select(*KEYS, "split")


split_query("split_season_forward", "CASE WHEN season <= 1998 THEN 'train' WHEN season = 1999 THEN 'validation' WHEN season = 2000 THEN 'test' END", lambda t: splits.season_forward(t, 1998, 1999, 2000))
split_query(
    "split_season_round",
    "CASE WHEN season <= 1999 OR (season = 2000 AND round_number <= 1) THEN 'train' WHEN season = 2000 AND round_number <= 2 THEN 'validation' WHEN season = 2000 THEN 'test' END",
    lambda t: splits.season_round(t, 1999, 2000, 2, 1),
)
split_query(
    "split_leave_event_out",
    "CASE WHEN event = 'GP_3' THEN 'test' WHEN season <= 1998 THEN 'train' WHEN season = 1999 THEN 'validation' END",
    lambda t: splits.leave_event_out(t, "GP_3", 1998, 1999),
)


@register("select_rows", f"WITH {LAPS}, {SESSIONED} SELECT {KEY_SQL}, src_part FROM sessioned WHERE season BETWEEN 2023 AND 2025 AND round_number BETWEEN 2 AND 3 AND session IN ('R', 'S')")
def q_rows(spark, folder):
    return splits.select_rows(sessioned(spark, folder), (2023, 2025), splits.parse_rounds("2-3"), ["R", "S"]).select(*KEYS, "src_part")


CHAIN = {
    "mode": "fine_tune_rounds", "season": 1999, "train_rounds": [1, 2], "sessions": ["R"],
    "base_split": {"mode": "fine_tune_seasons", "train_seasons": [1997, 1998], "sessions": None, "base_split": {"train_end": 1995}},
}
POOL = "season <= 1995 OR season BETWEEN 1997 AND 1998 OR (season = 1999 AND round_number BETWEEN 1 AND 2)"


@register("replay_pool", f"WITH {LAPS} SELECT {KEY_SQL} FROM laps WHERE ({POOL}) AND NOT (season = 1998 AND round_number = 4)")
def q_pool(spark, folder):
    base = laps(spark, folder)
    training = splits.select_rows(base, 1998, (4, 4))
    return splits.without_rows(splits.replay_pool(base, CHAIN), training).select(*KEYS)


@register("replay_sample")
def q_sample(spark, folder):
    return splits.seeded_sample(splits.replay_pool(laps(spark, folder), CHAIN), 500, 7).select(*KEYS)


@register("union_train_val", f"{UPTO_PACE} SELECT {KEY_SQL} FROM usable WHERE has_target AND season <= 1999")
def q_union(spark, folder):
    return splits.season_forward(features(spark, folder, priors=[]), 1998, 1999, 2000).where("split in ('train', 'validation')").select(*KEYS)


@register(
    "event_set_diff",
    f"WITH {LAPS} SELECT DISTINCT season, event FROM laps a WHERE NOT EXISTS (SELECT 1 FROM laps b WHERE b.season = a.season AND b.event = a.event AND b.src_part % 7 = 0 AND b.round_number <= 3)",
)
def q_event_diff(spark, folder):
    base = laps(spark, folder)
    return splits.event_set_diff(base, base.where("src_part % 7 = 0 and round_number <= 3"), ["season", "event"])


# --- windows ---------------------------------------------------------------------------------------
@register(
    "history_windows",
    f"{UPTO_PACE}, t AS (SELECT * FROM usable WHERE has_target), f AS (SELECT *, coalesce(last_value(pace_trend_3 IGNORE NULLS) OVER run, 0) AS x, row_number() OVER run AS n FROM t "
    "WINDOW run AS (PARTITION BY season, event, session, driver ORDER BY lap_number)) "
    f"SELECT {KEY_SQL}, round(lap_time_s, 3) AS newest, round(lag(lap_time_s, 4) OVER run, 3) AS oldest, round(x, 4) + 0.0 AS newest_trend, round(lag(x, 4) OVER run, 4) + 0.0 AS oldest_trend, "
    f"round(next_time - rolling_median_5, 6) + 0.0 AS {TARGET} FROM f WINDOW run AS (PARTITION BY season, event, session, driver ORDER BY lap_number) QUALIFY n >= 5",
)
def q_windows(spark, folder):
    out = windows.history_windows(features(spark, folder, priors=[]), ["lap_time_s", "pace_trend_3"], 5)

    def cell(lap, column, digits):
        return F.round(F.get(F.get("window", lap), column).cast("double"), digits) + F.lit(0.0)

    return out.select(
        *KEYS, cell(4, 0, 3).alias("newest"), cell(0, 0, 3).alias("oldest"), cell(4, 1, 4).alias("newest_trend"), cell(0, 1, 4).alias("oldest_trend"), *r6(TARGET)
    )


@register(
    "walk_forward",
    f"{UPTO_PACE}, t AS (SELECT *, row_number() OVER run - 1 AS i, list(lap_time_s) OVER ctx AS c FROM usable WHERE has_target "
    "WINDOW run AS (PARTITION BY season, event, session, driver ORDER BY lap_number), ctx AS (PARTITION BY season, event, session, driver ORDER BY lap_number ROWS 7 PRECEDING)) "
    f"SELECT {KEY_SQL}, len(c)::INT AS context_laps, list_sum(list_transform(c, lambda x: round(x * 1000)::BIGINT))::BIGINT AS context_ms, next_time AS actual_next_s FROM t WHERE i >= 3 AND (i - 3) % 2 = 0",
)
def q_walk(spark, folder):
    out = windows.walk_forward(features(spark, folder, priors=[]), context_length=8, stride=2)
    total = F.aggregate("context", F.lit(0).cast("bigint"), lambda a, v: a + F.round(v.cast("double") * 1000).cast("bigint"))
    return out.select(*KEYS, F.size("context").alias("context_laps"), total.alias("context_ms"), "actual_next_s")
