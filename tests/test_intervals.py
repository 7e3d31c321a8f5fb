"""Race-control log to status periods, against a row-by-row simulation."""

import datetime as dt
import random

from pyspark.sql import functions as F

from laptable.functions.groups import OrderedGroups
from laptable.operators import intervals as iv

T0 = dt.datetime(2024, 5, 1, 12, 0, 0)
COLUMNS = "session_key string, date timestamp, message_id bigint, category string, flag string, scope string, sector int, message string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def log(spark, *events, session="s"):
    """events: (second, category, flag, scope, sector, message)"""
    rows = [(session, at(e[0]), i, *e[1:]) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, COLUMNS)


def periods(spark, messages, end):
    ends = messages.select("session_key").distinct().withColumn("session_end", F.lit(at(end)))
    rows = iv.track_status_intervals(messages, ends, False).collect()
    return sorted(((r["start"] - T0).total_seconds(), (r["end"] - T0).total_seconds(), r["code"]) for r in rows)


def car(second, text):
    return (second, "SafetyCar", None, None, None, text)


def flag(second, name, sector=None):
    return (second, "Flag", name, "Sector" if sector else "Track", sector, "")


def status(second, text):
    return (second, "SessionStatus", None, None, None, text)


def test_yellow_safety_car_vsc_and_red(spark):
    messages = log(
        spark, flag(10, "YELLOW", 3), flag(20, "CLEAR", 3), car(100, "SAFETY CAR DEPLOYED"), flag(120, "DOUBLE YELLOW", 2), car(180, "SAFETY CAR IN THIS LAP"),
        flag(200, "CLEAR"), car(300, "VSC DEPLOYED"), car(340, "VSC ENDING"), flag(350, "GREEN"), flag(400, "RED"), status(460, "SESSION RESUMED"),
    )
    assert periods(spark, messages, 500) == [(10, 20, "2"), (100, 200, "4"), (300, 340, "6"), (340, 350, "7"), (400, 460, "5")]


def test_start_behind_the_safety_car(spark):
    messages = log(
        spark, (0, "Other", None, None, None, "RACE WILL START BEHIND THE SAFETY CAR"), status(10, "SESSION STARTED"), (90, "Other", None, None, None, "ROLLING START"),
        flag(95, "GREEN"),
    )
    assert periods(spark, messages, 200) == [(10, 90, "4")]


def test_started_under_red_only_ends_the_red_flag(spark):
    messages = log(spark, flag(10, "RED"), (20, "Other", None, None, None, "RESTART BEHIND THE SAFETY CAR"), status(30, "SESSION STARTED"))
    assert periods(spark, messages, 100) == [(10, 30, "5")]


def test_abort_ends_the_safety_car(spark):
    messages = log(spark, car(10, "SAFETY CAR DEPLOYED"), status(40, "SESSION ABORTED"), flag(80, "GREEN"))
    assert periods(spark, messages, 100) == [(10, 40, "4"), (40, 80, "5")]


def test_yellow_is_removed_under_a_neutralisation(spark):
    messages = log(spark, flag(10, "YELLOW", 1), car(20, "SAFETY CAR DEPLOYED"), car(30, "SAFETY CAR IN THIS LAP"), flag(40, "CLEAR"), flag(50, "YELLOW", 1))
    assert periods(spark, messages, 60) == [(10, 20, "2"), (20, 40, "4"), (50, 60, "2")]


def simulate(events, end):
    """One message after the other; yellow time as covered seconds (integer grid)."""
    got, yellow, red, sc, vsc, ending, mark, behind = [], {}, None, None, None, None, False, False
    yellows = []

    def close(start, t, code):
        if start is not None:
            got.append((start, t, code))

    for t, category, name, scope, sector, text in events:
        stop = (category == "Flag" and name == "RED") or (category == "SessionStatus" and ("ABORTED" in text or "SUSPENDED" in text))
        if category == "Flag":
            if name == "YELLOW":
                yellow.setdefault(sector or "track", t)
            elif name == "CLEAR" and scope == "Sector":
                if sector in yellow:
                    yellows.append((yellow.pop(sector), t))
            elif name in ("CLEAR", "GREEN"):
                yellows += [(s, t) for s in yellow.values()]
                yellow = {}
                if sc is not None and mark:
                    close(sc, t, "4")
                    sc, mark = None, False
                close(ending, t, "7")
                close(red, t, "5")
                ending = red = None
        if stop:
            red = t if red is None else red
            if sc is not None:
                close(sc, t, "4")
                sc, mark = None, False
            close(vsc, t, "6")
            close(ending, t, "7")
            vsc = ending = None
        elif category == "SessionStatus" and red is not None:
            close(red, t, "5")
            red = None
        elif category == "SessionStatus" and "STARTED" in text and behind:
            sc, mark, behind = t if sc is None else sc, False, False
        if category == "SafetyCar":
            if text == "VSC DEPLOYED":
                vsc = t if vsc is None else vsc
            elif text == "VSC ENDING" and vsc is not None:
                close(vsc, t, "6")
                vsc, ending = None, t
            elif text == "SAFETY CAR DEPLOYED":
                sc, mark = t if sc is None else sc, False
            elif text == "SAFETY CAR IN THIS LAP":
                mark = True
        if category == "Other":
            if "BEHIND" in text:
                behind = True
            elif sc is not None:
                close(sc, t, "4")
                sc, mark = None, False
    yellows += [(s, end) for s in yellow.values()]
    for start, code in ((sc, "4"), (vsc, "6"), (ending, "7"), (red, "5")):
        close(start, end, code)
    seconds = {x for s, e in yellows for x in range(s, e)} - {x for s, e, _ in got for x in range(s, e)}
    return sorted(got), seconds


def test_random_logs_against_the_simulation(spark):
    rng, rows, wanted = random.Random(11), [], {}
    kinds = [flag(0, "YELLOW", 1), flag(0, "YELLOW", 2), flag(0, "CLEAR", 1), flag(0, "CLEAR", 2), flag(0, "GREEN"), flag(0, "CLEAR"), flag(0, "RED"), car(0, "SAFETY CAR DEPLOYED"),
             car(0, "SAFETY CAR IN THIS LAP"), car(0, "VSC DEPLOYED"), car(0, "VSC ENDING"), status(0, "SESSION ABORTED"), status(0, "SESSION STARTED"), status(0, "SESSION RESUMED"),
             (0, "Other", None, None, None, "WILL START BEHIND THE SAFETY CAR"), (0, "Other", None, None, None, "ROLLING START")]
    for s in range(60):
        times = sorted(rng.sample(range(1, 900), 40))
        events = [(t, *rng.choice(kinds)[1:]) for t in times]
        wanted[str(s)] = simulate(events, 1000)
        rows += [(str(s), at(e[0]), i, *e[1:]) for i, e in enumerate(events)]
    messages = spark.createDataFrame(rows, COLUMNS)
    ends = messages.select("session_key").distinct().withColumn("session_end", F.lit(at(1000)))
    got = {k: ([], set()) for k in wanted}
    for r in iv.track_status_intervals(messages, ends, False).collect():
        start, end = int((r["start"] - T0).total_seconds()), int((r["end"] - T0).total_seconds())
        if r["code"] == "2":
            got[r["session_key"]][1].update(range(start, end))
        else:
            got[r["session_key"]][0].append((start, end, r["code"]))
    for s, (neutral, seconds) in wanted.items():
        assert sorted(got[s][0]) == neutral and got[s][1] == seconds, s


def test_only_positive_overlap_counts_and_spans_add_up(spark):
    laps = spark.createDataFrame([("s", 1, at(0), at(100)), ("s", 2, at(100), at(200)), ("s", 3, at(200), at(300)), ("s", 4, None, at(400))], "session_key string, lap int, lap_start timestamp, lap_end timestamp")
    spans = spark.createDataFrame([("s", at(50), at(100), "4"), ("s", at(200), at(260), "4"), ("s", at(260), at(300), "6")], "session_key string, start timestamp, end timestamp, code string")
    rows = iv.lap_track_status(laps, spans, ["session_key", "lap"], False).orderBy("lap").collect()
    assert [r["track_status"] for r in rows] == ["14", "1", "46", "1"]
    assert iv.union_length(spans, ["session_key"], False).first()["covered_s"] == 150


SPAN_COLUMNS = "session_key string, start timestamp, end timestamp, code string"
LAP_COLUMNS = "session_key string, lap int, lap_start timestamp, lap_end timestamp"


def test_coverage_by_code_against_brute_force(spark):
    """Random overlapping spans and laps, with ties, repeated rows, missing keys and times, and odd lengths."""
    rng = random.Random(4)

    def moment():
        return None if rng.random() < 0.04 else at(rng.randrange(0, 400, 4))

    keys = ["a", "b", "c", None]
    spans = [(rng.choice(keys[:2] + [None]), moment(), moment(), rng.choice("245")) for _ in range(120)]
    laps = [(rng.choice(keys), i, moment(), moment()) for i in range(80)]
    laps += laps[:5] + [("a", 900, at(0), at(400)), ("b", 901, at(40), at(40))]

    def seconds(key, low, high, codes):
        inside = {x for k, s, e, c in spans if k is not None and k == key and c in codes and s and e and s < e
                  for x in range(int((s - T0).total_seconds()), int((e - T0).total_seconds()))}
        return len(inside & set(range(low, high)))

    wanted = []
    for key, lap, start, end in laps:
        if start and end and start < end:
            low, high = int((start - T0).total_seconds()), int((end - T0).total_seconds())
            found = {c: seconds(key, low, high, codes) for c, codes in (("2", "2"), ("5", "5"), (iv.ANY, "245"))}
            wanted += [(key, lap, c, float(n)) for c, n in found.items() if n]
    lap_table, span_table = spark.createDataFrame(laps, LAP_COLUMNS), spark.createDataFrame(spans, SPAN_COLUMNS)
    for split in (False, True):
        got = iv.overlap_join(lap_table, span_table, ["session_key"], ["2", "5", iv.ANY], split)
        rows = [tuple(r) for r in got.select("session_key", "lap", "span_code", "overlap_s").collect()]
        assert sorted(rows, key=repr) == sorted(wanted, key=repr)
        status = iv.lap_track_status(lap_table, span_table, ["session_key", "lap"], split)
        assert status.columns == [*lap_table.columns, "track_status"] and status.count() == len(laps)


def test_very_long_spans_and_laps_are_two_rows_each(spark):
    decade = 10 * 365 * 86_400
    spans = spark.createDataFrame([("s", at(-decade), at(decade), "4"), ("s", at(10), at(20), "6")], SPAN_COLUMNS)
    laps = spark.createDataFrame([("s", 1, at(0), at(15)), ("s", 2, at(-decade), at(15)), ("s", 3, at(-2 * decade), at(30))], LAP_COLUMNS)
    steps = iv._span_steps(spans, ["session_key"], ["4", "6"])
    assert steps.count() == 4
    got = {(r["lap"], r["span_code"]): r["overlap_s"] for r in iv.overlap_join(laps, spans, ["session_key"]).collect()}
    assert got == {(1, "4"): 15.0, (1, "6"): 5.0, (2, "4"): decade + 15.0, (2, "6"): 5.0, (3, "4"): decade + 30.0, (3, "6"): 10.0}
    statuses = [r["track_status"] for r in iv.lap_track_status(laps, spans, ["session_key", "lap"]).orderBy("lap").collect()]
    assert statuses == ["46", "46", "146"]


def test_without_spans_every_lap_is_clear(spark):
    laps = spark.createDataFrame([("s", 1, at(0), at(0.2)), (None, 2, at(0), at(90)), ("s", 3, None, None)], LAP_COLUMNS)
    none = spark.createDataFrame([], SPAN_COLUMNS)
    assert {r["track_status"] for r in iv.lap_track_status(laps, none, ["session_key", "lap"]).collect()} == {"1"}
    assert iv.overlap_join(laps, none, ["session_key"]).count() == 0


def test_many_clears_and_sectors_in_one_session(spark):
    """100,000 track-wide clears and 40 sectors: each yellow finds its own end, no clear is copied to the sectors."""
    n = 100_000
    step = F.col("id")
    clears = spark.range(n).select(
        F.lit("s").alias("session_key"), F.timestamp_seconds(F.unix_timestamp(F.lit(at(0))) + step * 10).alias("date"), (step * 2).alias("message_id"),
        F.lit("Flag").alias("category"), F.lit("GREEN").alias("flag"), F.lit("Track").alias("scope"), F.lit(None).cast("int").alias("sector"), F.lit("").alias("message"),
    )
    yellows = clears.where("message_id % 2000 = 0").withColumns({
        "date": F.col("date") + F.expr("interval 3 seconds"), "message_id": F.col("message_id") + 1, "flag": F.lit("YELLOW"), "scope": F.lit("Sector"),
        "sector": (F.col("message_id") / 2000 % 40).cast("int"),
    })
    ends = spark.createDataFrame([("s", at(n * 10))], "session_key string, session_end timestamp")
    for split in (False, True):
        found = iv.track_status_intervals(clears.unionByName(yellows), ends, split)
        lengths = found.groupBy("code", iv.seconds_between("start", "end").alias("s")).count().collect()
        assert [(r["code"], r["s"], r["count"]) for r in lengths] == [("2", 7.0, 100)]


def test_next_value_of_a_split_group_equals_the_window(spark):
    rows = [(("a" if i % 5 else None), i, i * 10 if i % 7 == 0 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    out = []
    for split in (False, True):
        groups = OrderedGroups(df, ["k"], ["i"], split, 6)
        out.append(sorted(((r["i"], r["nxt"]) for r in groups.after(groups.df, first={"nxt": F.col("v")}).collect())))
    later = {i: next((v for k2, j, v in rows if k2 == k and j > i and v is not None), None) for k, i, _ in rows}
    assert out[0] == out[1] == sorted(later.items())
