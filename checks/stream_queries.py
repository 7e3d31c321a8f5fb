"""Queries over timed streams: as-of joins, race-control intervals, and provider pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapter import LAPS, laps, read
from checks.lap_queries import KEY_SQL, KEYS, UPTO_PACE, r6
from checks.report_queries import NAIVE, OFF_TIE, m6, metric_sql, naive
from laptable.operators import intervals as iv
from laptable.operators import metrics, timed_joins
from laptable.schema import LAP_VALIDITY_VERSION
from laptable.session import stored
from laptable.sources import providers, readers

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def events(spark, folder):
    """Streams with a UTC time, the day as session, and the number in the JSON column."""
    return read(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


EVENTS = "ev AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, value, json_extract_string(props, '$.k')::INT AS k, strftime(ts, '%Y-%m-%d') AS day FROM events)"


def kind(spark, folder, name):
    return events(spark, folder).where(F.col("event_type") == name)


@register(
    "asof_position",
    f"WITH {EVENTS}, p AS (SELECT * FROM ev WHERE event_type = 'purchase'), c AS (SELECT *, (trunc(value)::INT % 20 + 1) AS position FROM ev WHERE event_type = 'click') "
    "SELECT p.event_id, p.user_id, c.position FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts",
)
def q_position(spark, folder):
    updates = kind(spark, folder, "click").select("user_id", F.col("at").alias("when"), (F.col("value").cast("int") % 20 + 1).alias("position"), "event_id")
    out = timed_joins.asof_backward(kind(spark, folder, "purchase"), updates, ["user_id"], "at", "when", ["position"], "event_id")
    return out.select("event_id", "user_id", "position")


NEAREST = """
n AS (SELECT p.event_id, p.us, b.us AS bus, b.value AS bv, f.us AS fus, f.value AS fv FROM p
  ASOF LEFT JOIN w b ON p.{key} = b.{key} AND p.ts >= b.ts ASOF LEFT JOIN w f ON p.{key} = f.{key} AND p.ts <= f.ts),
pick AS (SELECT event_id, CASE WHEN fus IS NULL OR (bus IS NOT NULL AND us - bus <= fus - us) THEN bv ELSE fv END AS v,
  CASE WHEN fus IS NULL OR (bus IS NOT NULL AND us - bus <= fus - us) THEN us - bus ELSE fus - us END AS d FROM n)"""
PW = f"WITH {EVENTS}, p AS (SELECT * FROM ev WHERE event_type = 'purchase'), w AS (SELECT * FROM ev WHERE event_type = 'view')"


@register("asof_nearest", f"{PW}, {NEAREST.format(key='user_id')} SELECT event_id, v AS air_temp_c FROM pick")
def q_nearest(spark, folder):
    samples = kind(spark, folder, "view").select("user_id", F.col("at").alias("when"), F.col("value").alias("air_temp_c"), "event_id")
    out = timed_joins.asof_nearest(kind(spark, folder, "purchase"), samples, ["user_id"], "at", "when", ["air_temp_c"], sequence="event_id")
    return out.select("event_id", "air_temp_c")


@register(
    "asof_weather",
    f"{PW}, {NEAREST.format(key='day')} SELECT event_id, CASE WHEN d <= 600000000 THEN v END AS air_temp_c, coalesce(d <= 600000000 AND v > 20, false) AS rainfall, CASE WHEN d <= 600000000 THEN floor(v) ELSE 0 END AS wind_direction_deg FROM pick",
)
def q_weather(spark, folder):
    samples = kind(spark, folder, "view").select(
        "day", F.col("at").alias("when"), F.col("value").alias("air_temp_c"), (F.col("value") > 20).cast("double").alias("rainfall"), F.floor("value").cast("double").alias("wind_direction_deg"), "event_id"
    )
    names = ["air_temp_c", "rainfall", "wind_direction_deg"]
    out = timed_joins.asof_nearest(kind(spark, folder, "purchase"), samples, ["day"], "at", "when", names, timed_joins.WEATHER_TOLERANCE_S, "event_id")
    return out.withColumns(timed_joins.weather_defaults()).select("event_id", *names)


# --- race-control messages -------------------------------------------------------------------
def messages(spark, folder):
    k = F.col("k")

    def by_range(*steps):
        out = None
        for upper, value in steps:
            out = F.when(k < upper, value) if out is None else out.when(k < upper, value)
        return out

    return events(spark, folder).where("event_type in ('error', 'signup')").select(
        F.col("day").alias("session_key"), F.col("at").alias("date"), F.col("event_id").alias("message_id"),
        by_range((50, "SafetyCar"), (101, "Flag")).alias("category"),
        by_range((50, None), (70, "GREEN"), (75, "RED"), (95, "YELLOW"), (101, "CLEAR")).alias("flag"),
        F.when(k >= 75, "Sector").otherwise("Track").alias("scope"), (k % 3).alias("sector"),
        by_range((12, "SAFETY CAR DEPLOYED"), (25, "VIRTUAL SAFETY CAR DEPLOYED"), (37, "SAFETY CAR IN THIS LAP"), (50, "VSC ENDING"), (101, "")).alias("message"),
    )


def session_ends(spark, folder):
    days = events(spark, folder).select("day").distinct()
    return days.select(F.col("day").alias("session_key"), (F.to_timestamp("day") + F.expr("interval 1 day")).alias("session_end"))


# A period is stated from its end: the openings that share a closing message, and their
# earliest time. This is a different formulation from the running state the library uses.
CONTROL = f"""{EVENTS},
msg AS (
  SELECT day, ts, CASE WHEN k < 12 THEN 'sc' WHEN k < 25 THEN 'vsc' WHEN k < 37 THEN 'in' WHEN k < 50 THEN 'vend' WHEN k < 70 THEN 'green' WHEN k < 75 THEN 'red' WHEN k < 95 THEN 'yellow' ELSE 'sclear' END AS kind, k % 3 AS sector
  FROM ev WHERE event_type IN ('error', 'signup')
  UNION ALL SELECT DISTINCT day, day::TIMESTAMP + INTERVAL 1 DAY, 'end', NULL FROM ev
),
marks AS (SELECT day, ts, kind FROM msg WHERE kind IN ('sc', 'in')),
green_marked AS (SELECT g.day, g.ts FROM msg g ASOF JOIN marks m ON g.day = m.day AND g.ts > m.ts WHERE g.kind = 'green' AND m.kind = 'in'),
sc_close AS (SELECT day, ts FROM green_marked UNION SELECT day, ts FROM msg WHERE kind IN ('red', 'end')),
sc AS (SELECT o.day, min(o.ts) AS s, c.ts AS e, '4' AS code FROM (SELECT * FROM msg WHERE kind = 'sc') o ASOF JOIN sc_close c ON o.day = c.day AND o.ts < c.ts GROUP BY o.day, c.ts),
red_close AS (SELECT day, ts FROM msg WHERE kind IN ('green', 'end')),
red AS (SELECT o.day, min(o.ts) AS s, c.ts AS e, '5' AS code FROM (SELECT * FROM msg WHERE kind = 'red') o ASOF JOIN red_close c ON o.day = c.day AND o.ts < c.ts GROUP BY o.day, c.ts),
vsc_close AS (SELECT day, ts, kind FROM msg WHERE kind IN ('vend', 'red', 'end')),
vsc0 AS (SELECT o.day, min(o.ts) AS s, c.ts AS e, any_value(c.kind) AS kind FROM (SELECT * FROM msg WHERE kind = 'vsc') o ASOF JOIN vsc_close c ON o.day = c.day AND o.ts < c.ts GROUP BY o.day, c.ts),
vsc AS (SELECT day, s, e, '6' AS code FROM vsc0),
vend_close AS (SELECT day, ts FROM msg WHERE kind IN ('green', 'red', 'end')),
vend AS (SELECT o.day, max(o.e) AS s, c.ts AS e, '7' AS code FROM (SELECT * FROM vsc0 WHERE kind = 'vend') o ASOF JOIN vend_close c ON o.day = c.day AND o.e < c.ts GROUP BY o.day, c.ts),
neutral AS (SELECT * FROM sc UNION ALL SELECT * FROM red UNION ALL SELECT * FROM vsc UNION ALL SELECT * FROM vend),
y_close AS (SELECT day, ts, u.sector FROM msg, (SELECT unnest([0, 1, 2]) AS sector) u WHERE kind IN ('green', 'end') OR (kind = 'sclear' AND msg.sector = u.sector)),
yellow AS (SELECT o.day, min(o.ts) AS s, c.ts AS e FROM (SELECT * FROM msg WHERE kind = 'yellow') o ASOF JOIN y_close c ON o.day = c.day AND o.sector = c.sector AND o.ts < c.ts GROUP BY o.day, o.sector, c.ts)"""


def sweep(name: str, source: str, block: str, keys: str) -> str:
    """Stretches covered by ``source`` and by no ``block`` span."""
    return f"""
{name}_t AS (SELECT DISTINCT {keys}, t FROM (SELECT {keys}, s AS t FROM {source} UNION ALL SELECT {keys}, e FROM {source} UNION ALL SELECT {keys}, s FROM {block} UNION ALL SELECT {keys}, e FROM {block})),
{name}_p AS (SELECT {keys}, t AS s, lead(t) OVER (PARTITION BY {keys} ORDER BY t) AS e FROM {name}_t),
{name}_a AS (SELECT {keys}, s, e, EXISTS (SELECT 1 FROM {source} y WHERE {' AND '.join(f'y.{k} = p.{k}' for k in keys.split(', '))} AND y.s <= p.s AND y.e >= p.e)
  AND NOT EXISTS (SELECT 1 FROM {block} b WHERE {' AND '.join(f'b.{k} = p.{k}' for k in keys.split(', '))} AND b.s <= p.s AND b.e >= p.e) AS on_ FROM {name}_p p WHERE e IS NOT NULL),
{name}_g AS (SELECT *, sum((NOT on_)::INT) OVER (PARTITION BY {keys} ORDER BY s) AS g FROM {name}_a),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {name}_g WHERE on_ GROUP BY {keys}, g)"""


STATUS = f"{CONTROL}, {sweep('free', 'yellow', 'neutral', 'day')}, status AS (SELECT * FROM neutral UNION ALL SELECT day, s, e, '2' FROM free)"


def status(spark, folder):
    return iv.track_status_intervals(messages(spark, folder), session_ends(spark, folder), split=True)  # a session's log has no bound here


@register("track_status_intervals", f"WITH {STATUS} SELECT day AS session_key, epoch_us(s) AS start_us, epoch_us(e) AS end_us, code FROM status")
def q_status(spark, folder):
    return status(spark, folder).select("session_key", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "code")


SPANS = f"{EVENTS}, spans AS (SELECT event_id, day, ts AS s, make_timestamp(us + (value * 60000000)::BIGINT) AS e, (['2', '4', '5', '6', '7'])[k % 5 + 1] AS code FROM ev WHERE event_type IN ('error', 'signup'))"


def spans(spark, folder):
    codes = F.array(*[F.lit(c) for c in ("2", "4", "5", "6", "7")])
    return events(spark, folder).where("event_type in ('error', 'signup')").select(
        F.col("day").alias("session_key"), F.col("at").alias("start"),
        F.timestamp_micros(F.unix_micros("at") + F.round(F.col("value") * 60000000).cast("bigint")).alias("end"), F.element_at(codes, F.col("k") % 5 + 1).alias("code"),
    )


@register(
    "interval_subtract",
    f"WITH {SPANS}, y AS (SELECT * FROM spans WHERE code = '2' AND s < e), b AS (SELECT * FROM spans WHERE code <> '2' AND s < e), {sweep('free', 'y', 'b', 'day')} SELECT day AS session_key, epoch_us(s) AS start_us, epoch_us(e) AS end_us, '2' AS code FROM free",
)
def q_subtract(spark, folder):
    all_spans = spans(spark, folder)
    out = iv.subtract_intervals(all_spans.where("code = '2'"), all_spans.where("code <> '2'"))
    return out.select("session_key", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "code")


ISLANDS = """
ordered AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE s < e),
grouped AS (SELECT *, sum((reach IS NULL OR s > reach)::INT) OVER (PARTITION BY {keys} ORDER BY s, e) AS g FROM ordered),
islands AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM grouped GROUP BY {keys}, g)"""


@register(
    "interval_union_length",
    f"WITH {SPANS}, {ISLANDS.format(keys='day', source='spans')} SELECT day AS session_key, round(sum(epoch_us(e) - epoch_us(s)) / 1000000.0, 6) AS covered_s FROM islands GROUP BY day",
)
def q_union_length(spark, folder):
    return iv.union_length(spans(spark, folder), ["session_key"]).select("session_key", *r6("covered_s"))


PLAPS = "pl AS (SELECT event_id, day, ts AS ls, make_timestamp(us + 60000000 + (value * 1000000)::BIGINT) AS le FROM ev WHERE event_type = 'purchase')"


def stream_laps(spark, folder):
    return kind(spark, folder, "purchase").select(
        "event_id", F.col("day").alias("session_key"), F.col("at").alias("lap_start"),
        F.timestamp_micros(F.unix_micros("at") + 60000000 + F.round(F.col("value") * 1000000).cast("bigint")).alias("lap_end"),
    )


@register(
    "interval_overlap_join",
    f"WITH {SPANS}, {PLAPS} SELECT DISTINCT p.event_id, s.code FROM pl p JOIN spans s ON p.day = s.day AND p.ls < s.e AND s.s < p.le AND s.s < s.e",
)
def q_overlap(spark, folder):
    merged = iv.merge_intervals(spans(spark, folder), ["session_key", "code"])
    return iv.overlap_join(stream_laps(spark, folder), merged, ["session_key"]).select("event_id", F.col("span_code").alias("code")).distinct()


@register(
    "lap_track_status",
    f"WITH {STATUS}, {PLAPS}, {ISLANDS.format(keys='day', source='status')}, "
    "codes AS (SELECT p.event_id, string_agg(DISTINCT s.code, '' ORDER BY s.code) AS c FROM pl p JOIN status s ON p.day = s.day AND p.ls < s.e AND s.s < p.le AND s.s < s.e GROUP BY p.event_id), "
    "cov AS (SELECT p.event_id, sum(least(epoch_us(i.e), epoch_us(p.le)) - greatest(epoch_us(i.s), epoch_us(p.ls))) / 1000000.0 AS covered FROM pl p JOIN islands i ON p.day = i.day AND p.ls < i.e AND i.s < p.le GROUP BY p.event_id) "
    "SELECT p.event_id, CASE WHEN covered IS NULL OR covered < (epoch_us(le) - epoch_us(ls)) / 1000000.0 - 0.5 THEN '1' ELSE '' END || coalesce(c, '') AS track_status FROM pl p LEFT JOIN codes USING (event_id) LEFT JOIN cov USING (event_id)",
)
def q_lap_status(spark, folder):
    out = iv.lap_track_status(stream_laps(spark, folder), status(spark, folder), ["session_key", "event_id"], split=True)
    return out.select("event_id", "track_status")


# --- laps as provider tables ----------------------------------------------------------------
SESSION_KEYED = "k AS (SELECT *, season * 10 + round_number AS session_key, substr(driver, 2)::BIGINT AS driver_number FROM laps)"


def keyed(spark, folder):
    start = F.timestamp_micros(F.lit(1704067200000000) + (F.col("lap_number") * 90000000).cast("bigint"))
    return laps(spark, folder).withColumns(
        {"session_key": F.col("season") * 10 + F.col("round_number"), "driver_number": F.substring("driver", 2, 20).cast("bigint"), "lap_start": start}
    )


def stint_rows(df):
    return df.groupBy("session_key", "driver_number", "stint").agg(
        F.min("lap_number").alias("lap_start"), (F.max("lap_number") + 1).alias("lap_end"), F.min("compound").alias("compound"),
        F.when(F.min("src_part") % 3 != 0, (F.min("src_part") % 3 - 1).cast("int")).alias("tyre_age_at_start"),
    ).withColumns({"stint_number": F.col("stint").cast("int"), "stint_id": F.col("stint").cast("bigint")})


@register(
    "stint_range_join",
    f"WITH {LAPS}, {SESSION_KEYED}, st AS (SELECT session_key, driver_number, stint, min(lap_number) AS a, max(lap_number) + 1 AS b, min(compound) AS c, CASE WHEN min(src_part) % 3 <> 0 THEN min(src_part) % 3 - 1 END AS age FROM k GROUP BY ALL) "
    f"SELECT k.season, k.event, k.session, k.driver, k.lap_number, st.c AS compound, st.stint, coalesce(st.age, 0) + k.lap_number - st.a + 1 AS tyre_life, coalesce(st.age, 0) = 0 AS fresh_tyre "
    "FROM k JOIN st ON k.session_key = st.session_key AND k.driver_number = st.driver_number AND k.lap_number BETWEEN st.a AND st.b QUALIFY row_number() OVER (PARTITION BY k.session_key, k.driver_number, k.lap_number ORDER BY st.stint DESC) = 1",
)
def q_stints(spark, folder):
    df = keyed(spark, folder)
    out = timed_joins.stint_range_join(df.drop("compound", "stint", "tyre_life", "fresh_tyre"), stint_rows(df), ["session_key", "driver_number"])
    return out.select(*KEYS, "compound", "stint", "tyre_life", "fresh_tyre")


def steward_messages(df):
    minutes = F.floor(F.col("lap_time_s") / 60).cast("int")
    car = F.concat(F.lit("CAR "), F.col("driver_number").cast("string"), F.lit(" (ABC) "))
    timed = F.concat(car, F.lit("TIME "), minutes.cast("string"), F.lit(":"), F.format_string("%06.3f", F.col("lap_time_s") - 60 * minutes), F.lit(" DELETED - TRACK LIMITS"))
    text = (
        F.when((F.col("src_part") % 3 == 0) & F.col("lap_time_s").isNotNull(), timed)
        .when(F.col("src_part") % 3 == 1, F.concat(car, F.lit("LAP DELETED - TRACK LIMITS AT TURN 4 LAP "), F.col("lap_number").cast("int").cast("string")))
        .otherwise(F.concat(car, F.lit("LAP DELETED - TRACK LIMITS")))
    )
    return df.where("src_part % 83 = 0").select("session_key", (F.col("lap_start") + F.expr("interval 30 seconds")).alias("date"), F.col("src_order").alias("message_id"), text.alias("message"))


@register(
    "deleted_laps",
    f"WITH {LAPS}, {SESSION_KEYED}, m AS (SELECT * FROM k WHERE src_part % 83 = 0), hit AS ("
    "SELECT k.session_key, k.driver_number, k.lap_number FROM m JOIN k USING (session_key, driver_number) WHERE m.src_part % 3 = 0 AND m.lap_time_s IS NOT NULL AND abs(k.lap_time_s - (floor(m.lap_time_s / 60) * 60 + printf('%06.3f', m.lap_time_s - 60 * floor(m.lap_time_s / 60))::DOUBLE)) < 0.002 "
    "UNION SELECT session_key, driver_number, lap_number FROM m WHERE src_part % 3 <> 0 OR lap_time_s IS NULL) "
    f"SELECT {KEY_SQL}, EXISTS (SELECT 1 FROM hit h WHERE h.session_key = k.session_key AND h.driver_number = k.driver_number AND h.lap_number = k.lap_number) AS deleted FROM k",
)
def q_deleted(spark, folder):
    df = keyed(spark, folder)
    return timed_joins.deleted_laps(df, steward_messages(df)).select(*KEYS, "deleted")


@register("openf1_session_laps")
def q_open(spark, folder):
    landed = keyed(spark, folder)
    df = stored(landed)  # seven tables are made of it; weather samples of one instant keep the order they are derived in
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    who = ["session_key", "driver_number"]
    sessions = df.groupBy("session_key", F.col("season").alias("year"), "round_number", F.col("event").alias("meeting_name"), F.col("circuit").alias("location"), "event_date").agg(F.max("lap_start").alias("_last"))
    tables = {
        "laps": df.select(*who, "lap_number", F.col("lap_time_s").alias("lap_duration"), text("lap_start").alias("date_start"), F.col("sector1_s").alias("duration_sector_1"), F.col("sector2_s").alias("duration_sector_2"), (F.col("lap_time_s") - F.col("sector1_s") - F.col("sector2_s")).alias("duration_sector_3"), F.col("pit_out").alias("is_pit_out_lap")),
        "sessions": sessions.select("session_key", "year", "round_number", "meeting_name", "location", "event_date", F.lit("R").alias("session_code"), text(F.col("_last") + F.expr("interval 5 minutes")).alias("date_end")),
        "drivers": df.select(*who, F.col("driver").alias("name_acronym"), F.col("team").alias("team_name")).distinct(),
        "stints": stint_rows(df),
        "pit": df.where("pit_in").select(*who, "lap_number"),
        "position": df.select(*who, text(F.col("lap_start") + F.expr("interval 45 seconds")).alias("date"), "position"),
        "weather": landed.where("src_part % 50 = 0").select("session_key", text("lap_start").alias("date"), F.col("air_temp_c").alias("air_temperature"), F.col("track_temp_c").alias("track_temperature"), F.col("humidity_pct").alias("humidity"), F.col("pressure_mbar").alias("pressure"), F.col("rainfall").cast("double").alias("rainfall"), F.col("wind_speed_ms").alias("wind_speed"), F.col("wind_direction_deg").alias("wind_direction")),
        "race_control": steward_messages(df).select("session_key", text("date").alias("date"), "message_id", "message", F.lit("Other").alias("category"), F.lit(None).cast("string").alias("flag"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("int").alias("sector")).unionByName(
            df.where("src_part % 97 < 10").select("session_key", text("lap_start").alias("date"), F.col("src_order").alias("message_id"), F.when(F.col("src_part") % 97 < 3, "SAFETY CAR DEPLOYED").when(F.col("src_part") % 97 < 6, "SAFETY CAR IN THIS LAP").otherwise("").alias("message"),
                F.when(F.col("src_part") % 97 < 6, "SafetyCar").otherwise("Flag").alias("category"), F.when(F.col("src_part") % 97 >= 6, "GREEN").alias("flag"), F.lit("Track").alias("scope"), F.lit(None).cast("int").alias("sector"))
        ),
    }
    return providers.openf1_session_laps(tables)


@register(
    "normalize_timing",
    f"WITH {LAPS} SELECT {KEY_SQL}, round(lap_time_s, 6) AS lap_time_s, round(sector1_s, 6) AS sector1_s, src_part % 5 = 0 AS pit_in, src_part % 6 = 0 AS pit_out, compound, tyre_life, CASE WHEN fresh_tyre THEN 1.0::DOUBLE ELSE 0.0 END AS fresh_tyre, 'fastf1_timing' AS data_tier FROM laps",
)
def q_normalize(spark, folder):
    df = laps(spark, folder)

    def span(c):
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(c).cast("decimal(18,6)"))

    rows = df.select(
        "season", "round_number", "event", "circuit", "event_date", "session", F.col("driver").alias("Driver"), F.col("team").alias("Team"), F.col("lap_number").alias("LapNumber"), span("lap_time_s").alias("LapTime"),
        span("sector1_s").alias("Sector1Time"), span("sector2_s").alias("Sector2Time"), span("sector3_s").alias("Sector3Time"), F.col("compound").alias("Compound"), F.col("tyre_life").alias("TyreLife"), F.col("fresh_tyre").alias("FreshTyre"),
        F.col("stint").alias("Stint"), F.col("position").alias("Position"), F.col("track_status").alias("TrackStatus"), F.when(F.col("src_part") % 5 == 0, 1.0).alias("PitInTime"), F.when(F.col("src_part") % 6 == 0, 1.0).alias("PitOutTime"),
        F.col("is_accurate").alias("IsAccurate"), F.col("deleted").alias("Deleted"),
    )
    return providers.normalize_timing(rows).select(*KEYS, *r6("lap_time_s", "sector1_s"), "pit_in", "pit_out", "compound", "tyre_life", "fresh_tyre", "data_tier")


# --- relational dump and nested pages ----------------------------------------------------------
CONSTRUCTOR_REFS = ["ferrari", "sauber", "rb", "minardi"]
CIRCUIT_REFS = ["monza", "spa", "jerez", "monaco"]


def dump(spark, folder, shift=20):
    """The seven tables of the relational dump, from laps. Seasons move to the 2010s and 2020s."""
    df = keyed(spark, folder).withColumn("season", F.col("season") + shift)
    refs, circuits = F.array(*[F.lit(r) for r in CONSTRUCTOR_REFS]), F.array(*[F.lit(c) for c in CIRCUIT_REFS])
    race = df.select("session_key", "season", "round_number", "event", "event_date").distinct()
    suppliers = read(spark, folder, "supplier")
    teams = suppliers.select(F.col("s_nationkey").alias("constructorId")).distinct()
    return {
        "races": race.select(F.col("session_key").alias("raceId"), F.col("season").alias("year"), F.col("round_number").alias("round"), F.col("event").alias("name"), F.col("event_date").alias("date"), F.col("round_number").alias("circuitId")),
        "circuits": race.select(F.col("round_number").alias("circuitId"), F.element_at(circuits, F.col("round_number")).alias("circuitRef"), F.lit("Jerez").alias("location")).distinct(),
        "drivers": suppliers.select(F.col("s_suppkey").alias("driverId"), F.concat(F.lit("ref"), F.col("s_suppkey").cast("string")).alias("driverRef"), F.concat(F.lit("d"), F.chr(65 + F.col("s_suppkey") % 26), F.chr(65 + F.col("s_suppkey") / 26 % 26)).alias("code"), F.col("s_name").alias("surname")),
        "constructors": teams.select("constructorId", F.element_at(refs, F.col("constructorId") % 4 + 1).alias("constructorRef"), F.concat(F.lit("T"), F.col("constructorId").cast("string")).alias("name")),
        "results": df.select(F.col("session_key").alias("raceId"), F.col("driver_number").alias("driverId"), F.substring("team", 2, 5).cast("int").alias("constructorId"), F.col("driver_number").alias("resultId")).distinct(),
        "lap_times": df.select(F.col("session_key").alias("raceId"), F.col("driver_number").alias("driverId"), F.col("lap_number").cast("int").alias("lap"), F.col("position").cast("int").alias("position"), F.concat(F.lit("1:"), F.format_string("%06.3f", F.col("lap_time_s") - 60)).alias("time"), F.when(F.col("src_part") % 3 != 0, F.round(F.col("lap_time_s") * 1000).cast("int")).alias("milliseconds")),
        "pit_stops": df.where("pit_in").select(F.col("session_key").alias("raceId"), F.col("driver_number").alias("driverId"), F.col("lap_number").cast("int").alias("lap")),
    }


DUMP_LAPS = f"""{LAPS}, {SESSION_KEYED},
base AS (
  SELECT season + 20 AS season, round_number, event, event_date, driver_number, substr(team, 2)::INT AS nation, lap_number, lap_time_s AS t, position, session_key,
    pit_in, coalesce(lag(pit_in) OVER run AND lap_number - lag(lap_number) OVER run = 1, false) AS pit_out,
    median(lap_time_s) OVER (PARTITION BY session_key, driver_number) AS med
  FROM k WINDOW run AS (PARTITION BY session_key, driver_number ORDER BY lap_number)
),
dump AS (
  SELECT season, round_number, event, event_date, 'D' || chr((65 + driver_number % 26)::INT) || chr((65 + driver_number // 26 % 26)::INT) AS driver, 'ref' || driver_number AS driver_id,
    CASE round_number WHEN 1 THEN 'Monza' WHEN 2 THEN 'Spa-Francorchamps' WHEN 3 THEN 'Jerez' ELSE 'Monaco' END AS circuit,
    CASE nation % 4 WHEN 0 THEN 'Ferrari' WHEN 1 THEN CASE WHEN season >= 2024 THEN 'Kick Sauber' ELSE 'Sauber' END WHEN 2 THEN CASE WHEN season <= 2024 THEN 'RB' ELSE 'Racing Bulls' END ELSE 'T' || nation END AS team,
    lap_number, round(t, 6) AS lap_time_s, position, pit_in, pit_out, 'Pirelli' AS tyre_manufacturer, coalesce(lap_number > 1 AND NOT pit_in AND NOT pit_out AND t <= 1.12 * med, false) AS is_accurate,
    'legacy_timing' AS data_tier FROM base
)"""
# Drivers of one code in one race share their median in the library; the code here is unique.
DUMP_COLUMNS = ["season", "round_number", "event", "event_date", "driver", "driver_id", "circuit", "team", "lap_number", "position", "pit_in", "pit_out", "tyre_manufacturer", "is_accurate", "data_tier"]


def dump_result(df):
    return df.select(*DUMP_COLUMNS, *r6("lap_time_s"))


@register("ergast_season_laps", f"WITH {DUMP_LAPS} SELECT * FROM dump")
def q_dump(spark, folder):
    return dump_result(providers.ergast_season_laps(dump(spark, folder)))


@register(
    "ergast_export",
    f"WITH {DUMP_LAPS} SELECT * REPLACE (CASE WHEN season >= 2018 THEN 'legacy_timing_check_only' ELSE data_tier END AS data_tier) FROM dump WHERE season IN (2016, 2017, 2018)",
)
def q_export(spark, folder):
    seasons = [2016, 2017, 2018]
    return dump_result(providers.ergast_export(providers.ergast_season_laps(dump(spark, folder), seasons), seasons, include_timing_era=True))


@register(
    "jolpica_race_laps",
    f"WITH {DUMP_LAPS} SELECT season, round_number, event, event_date, driver, driver_id, circuit, team, lap_number, position, pit_in, pit_out, tyre_manufacturer, is_accurate, data_tier, lap_time_s FROM dump",
)
def q_pages(spark, folder):
    """Pages of one lap each, as the paged API returns them, plus result and pit-stop pages."""
    t = dump(spark, folder)
    race = t["races"].join(t["circuits"], "circuitId").select(
        "raceId", F.col("year").cast("string").alias("season"), F.col("round").cast("string").alias("round"), F.col("name").alias("raceName"), "date",
        F.struct(F.col("circuitRef").alias("circuitId"), F.struct(F.col("location").alias("locality")).alias("Location")).alias("Circuit"),
    )
    ids = t["drivers"].select("driverId", "driverRef", "code", "surname")
    timing = F.struct(F.col("driverRef").alias("driverId"), F.col("position").cast("string").alias("position"), F.col("time").alias("time"))
    lap_pages = t["lap_times"].join(ids, "driverId").groupBy("raceId", "lap").agg(F.collect_list(timing).alias("Timings")).select(
        "raceId", F.array(F.struct(F.col("lap").cast("string").alias("number"), "Timings")).alias("Laps")
    )
    entry = F.struct(F.struct(F.col("driverRef").alias("driverId"), "code", F.col("surname").alias("familyName")).alias("Driver"), F.struct(F.col("constructorRef").alias("constructorId"), F.col("name").alias("name")).alias("Constructor"))
    results = t["results"].join(ids, "driverId").join(t["constructors"], "constructorId").select("raceId", F.array(entry).alias("Results"))
    stops = t["pit_stops"].join(ids, "driverId").select("raceId", F.array(F.struct(F.col("driverRef").alias("driverId"), F.col("lap").cast("string").alias("lap"))).alias("PitStops"))
    pages = race.join(lap_pages, "raceId").unionByName(race.join(results, "raceId"), allowMissingColumns=True).unionByName(race.join(stops, "raceId"), allowMissingColumns=True)
    return dump_result(providers.jolpica_race_laps(pages))


@register("openf1_meetings", f"WITH {LAPS}, m AS (SELECT DISTINCT season, round_number FROM laps) SELECT season AS year, 'GP ' || round_number AS meeting_name, row_number() OVER (PARTITION BY season ORDER BY round_number)::INT AS round_number FROM m WHERE NOT (season = 1997 AND round_number = 2)")
def q_meetings(spark, folder):
    held = laps(spark, folder).select("season", "round_number").distinct()
    rows = held.select(
        F.col("season").alias("year"), F.concat(F.lit("GP "), F.col("round_number").cast("string")).alias("meeting_name"), F.concat(F.col("season").cast("string"), F.lit("-0"), (F.col("round_number") * 2).cast("string"), F.lit("-01")).alias("date_start"),
        (F.col("season") * 10 + F.col("round_number")).alias("meeting_key"), ((F.col("season") == 1997) & (F.col("round_number") == 2)).alias("is_cancelled"),
    )
    testing = held.select(F.col("season").alias("year"), F.lit("Pre-Season Testing").alias("meeting_name"), F.concat(F.col("season").cast("string"), F.lit("-01-01")).alias("date_start"), F.col("season").alias("meeting_key"), F.lit(False).alias("is_cancelled")).distinct()
    return providers.openf1_meetings(rows.unionByName(testing)).select("year", "meeting_name", "round_number")


@register(
    "columnar_json_laps",
    f"WITH {LAPS} SELECT {KEY_SQL}, round(lap_time_s, 6) AS lap_time_s, CASE WHEN season % 2 = 0 THEN compound END AS compound, CASE WHEN src_part % 97 = 9 THEN '1' ELSE track_status END AS track_status, pit_in, is_accurate, rainfall, wind_direction_deg, "
    "season || '-01-01' AS event_date, 'GP_' || round_number AS circuit, 'tracinginsights_timing' AS data_tier FROM laps",
)
def q_columnar(spark, folder):
    """One document per driver and session; in odd seasons the compound list is one short."""
    df = laps(spark, folder)

    def texts(column):
        return F.transform("_rows", lambda r: F.coalesce(r[column].cast("string"), F.lit("None")))

    columns = {"lap": "lap_number", "time": "lap_time_s", "s1": "sector1_s", "pin": "_pin", "iacc": "is_accurate", "wR": "rainfall", "wWD": "wind_direction_deg", "drv": "driver", "status": "track_status", "lSD": "_start"}
    rows = df.withColumns({"_pin": F.when(F.col("pit_in"), 1.0), "_start": F.concat(F.col("season").cast("string"), F.lit("-01-01T10:00:00.500"))})
    docs = rows.groupBy("season", "event", F.col("session").alias("session_code"), "driver").agg(F.collect_list(F.struct(*sorted({*columns.values(), "compound"}))).alias("_rows"))
    docs = docs.select("season", "event", "session_code", *[texts(c).alias(k) for k, c in columns.items()], F.when(F.col("season") % 2 == 0, texts("compound")).otherwise(F.slice(texts("compound"), F.lit(1), F.size("_rows") - 1)).alias("compound"))
    return providers.columnar_json_laps(docs).select(*KEYS, *r6("lap_time_s"), "compound", "track_status", "pit_in", "is_accurate", "rainfall", "wind_direction_deg", "event_date", "circuit", "data_tier")


@register(
    "apply_calendar",
    f"WITH {LAPS} SELECT {KEY_SQL}, CASE WHEN round_number <= 3 THEN round_number END AS round_number, CASE WHEN round_number <= 3 THEN 'K_' || round_number ELSE circuit END AS circuit, event_date FROM laps",
)
def q_calendar(spark, folder):
    base = laps(spark, folder)
    calendar = base.where("round_number <= 3").withColumn("circuit", F.concat(F.lit("K_"), F.col("round_number").cast("string")))
    return providers.apply_calendar(base, calendar).select(*KEYS, "round_number", "circuit", "event_date")


@register(
    "calendar_select",
    f"WITH {LAPS}, s AS (SELECT DISTINCT season, round_number, event, circuit, event_date FROM laps) SELECT season, round_number, event FROM s WHERE event_date::DATE <= DATE '1999-12-31' AND (contains(lower(event), 'gp_1') OR contains(lower(circuit), 'c_3')) ORDER BY event_date, round_number LIMIT 7",
)
def q_calendar_select(spark, folder):
    schedule = laps(spark, folder).select("season", "round_number", "event", F.col("circuit").alias("location"), "event_date", F.lit(None).cast("string").alias("country")).distinct()
    return providers.calendar_select(schedule, F.to_date(F.lit("1999-12-31")), ["GP_1", "c_3"], 7).select("season", "round_number", "event")


@register("table_fingerprint")
def q_fingerprint(spark, folder):
    return readers.table_fingerprint(laps(spark, folder), 5, LAP_VALIDITY_VERSION)


# --- run records ---------------------------------------------------------------------------------
def run_records(spark, folder):
    """Run records as they are read from JSON: one baseline record, and one per event with its
    errors by driver, all computed from the laps."""
    base = naive(spark, folder)
    names = ["mae_s", "rmse_s", "rows"]
    whole = metrics.regression_metrics(base, ["model"]).select("model", F.struct(*names).alias("m"))
    baseline = whole.agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct(F.col("m").alias("validation"), F.col("m").alias("test"))))).alias("models")).select(F.lit("baselines").alias("artifact"), "models")
    previous = base.where("model = 'previous_lap'")
    events_ = metrics.regression_metrics(previous, ["event"]).select("event", F.struct(*names).alias("test"), F.struct(*names).alias("validation"))
    drivers = metrics.regression_metrics(previous, ["event", "driver"]).groupBy("event").agg(F.map_from_entries(F.collect_list(F.struct("driver", F.struct(*names)))).alias("test_by_driver"))
    one = events_.join(drivers, "event").select(F.concat(F.lit("run_"), F.col("event")).alias("artifact"), F.col("event").alias("name"), "validation", "test", "test_by_driver", F.lit("forward-forward-local").alias("training_policy"))
    records = one.unionByName(baseline, allowMissingColumns=True)
    return records.withColumns({"model": F.lit(None).cast("string"), "data_source": F.lit("fastf1_timing"), "is_synthetic": F.lit(False), "created_utc": F.lit("2026-01-01"), "input_file": F.lit("laps")})


@register(
    "flatten_runs",
    f"{NAIVE}, a AS ({metric_sql('naive', 'model')}), e AS ({metric_sql('(SELECT * FROM naive WHERE model = ' + chr(39) + 'previous_lap' + chr(39) + ')', 'event')}) "
    "SELECT 'baselines/' || model AS run, model, 'baseline' AS method, mae_s AS test_mae_s, \"rows\" AS test_rows FROM a UNION ALL SELECT 'run_' || event, event, 'forward-forward', mae_s, \"rows\" FROM e",
)
def q_flatten(spark, folder):
    out = providers.flatten_runs(run_records(spark, folder))
    return out.select("run", "model", "method", (F.round(F.col("test.mae_s") + OFF_TIE, 6) + F.lit(0.0)).alias("test_mae_s"), F.col("test.rows").alias("test_rows"))


@register(
    "driver_error_report",
    f"{NAIVE}, e AS ({metric_sql('(SELECT * FROM naive WHERE model = ' + chr(39) + 'previous_lap' + chr(39) + ')', 'event, driver')}) SELECT 'run_' || event AS artifact, event AS name, driver, mae_s, \"rows\" FROM e",
)
def q_driver_report(spark, folder):
    return providers.driver_error_report(run_records(spark, folder)).select("artifact", "name", "driver", *m6("mae_s"), "rows")


@register(
    "breakdown_catalog",
    f"{UPTO_PACE} SELECT event AS name, 'GP_1 report' AS title, 'previous_lap' AS models, count(*) AS \"rows\", 'compound,team' AS dimensions FROM usable WHERE has_target AND event = 'GP_1' GROUP BY event "
    f"UNION ALL SELECT event, NULL, 'previous_lap', count(*), 'compound,team' FROM usable WHERE has_target AND event <> 'GP_1' GROUP BY event",
)
def q_catalog(spark, folder):
    from checks.report_queries import scored

    groups = scored(spark, folder).select("event", F.explode(F.array(F.struct(F.lit("team").alias("d"), F.col("team").alias("v")), F.struct(F.lit("compound").alias("d"), F.col("compound").alias("v")))).alias("g")).groupBy("event", "g.d", "g.v").count()
    inner = groups.groupBy("event", "d").agg(F.map_from_entries(F.collect_list(F.struct("v", F.create_map(F.lit("rows"), F.col("count").cast("double"))))).alias("m"), F.sum("count").alias("n"))
    reports = inner.groupBy("event").agg(F.map_from_entries(F.collect_list(F.struct("d", "m"))).alias("breakdowns"), F.max("n").alias("rows"))
    reports = reports.select(F.col("event").alias("name"), F.when(F.col("event") == "GP_1", "GP_1 report").alias("title"), F.array(F.lit("previous_lap")).alias("models"), "rows", "breakdowns")
    return providers.breakdown_catalog(reports).select("name", "title", F.array_join("models", ",").alias("models"), "rows", F.array_join("dimensions", ",").alias("dimensions"))
