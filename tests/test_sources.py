"""Provider tables to laps, readers and writers."""

import json

import pytest
from conftest import make_laps
from pyspark.sql import functions as F

from laptable.functions.coerce import driver_code, lap_seconds, letter_code
from laptable.functions.dims import session_code, with_event_location, with_team
from laptable.operators.features import build_features
from laptable.schema import LAP_VALIDITY_VERSION
from laptable.sources import providers, readers


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_codes_times_and_names(spark):
    names = spark.createDataFrame([("Häkkinen",), ("Pérez",), ("Räikkönen",), ("Çağlar",), ("Æ",), ("de la Rosa",), (None,)], "n string")
    assert column(names, letter_code(F.coalesce("n", F.lit("")))) == ["HAK", "PER", "RAI", "CAG", "UNK", "DEL", "UNK"]
    both = spark.createDataFrame([("NOR", "Norris"), (None, "Hakkinen"), ("  ", "Alesi"), (None, None)], "c string, s string")
    assert column(both, driver_code(F.col("c"), F.col("s"))) == ["NOR", "HAK", "ALE", "UNK"]
    texts = spark.createDataFrame([("1:31.234",), ("1:02:03.4",), ("95.5",), ("abc",), ("a:1",), (None,), ("",)], "t string")
    assert column(texts, F.round(lap_seconds(F.col("t")), 6)) == [91.234, 3723.4, 95.5, None, None, None, None]
    teams = spark.createDataFrame([("rb", 2024, "x"), ("rb", 2025, "x"), ("sauber", 2010, "x"), ("alfa", 2022, "x"), ("brawn", 2009, "Brawn"), (None, 2009, "x")], "r string, y int, n string")
    assert column(with_team(teams, "r", "y", "n"), "team") == ["RB", "Racing Bulls", "Sauber", "Alfa Romeo", "Brawn", None]
    events = spark.createDataFrame([("Monaco Grand Prix", 2019), ("Monaco Grand Prix", 2023), ("Monaco Grand Prix", 2026), ("Madrid Grand Prix", 2026)], "e string, y int")
    assert column(with_event_location(events, "e", "y"), "circuit") == ["Monte Carlo", "Monaco", "Monte Carlo", "Madrid"]
    codes = spark.createDataFrame([("Sprint ",), ("race",), ("fp1",), ("Sprint Shootout",)], "s string")
    assert column(codes, session_code(F.col("s"))) == ["S", "R", "FP1", "SS"]


def test_dump_from_csv(spark, tmp_path):
    files = {
        "races": "raceId,year,round,circuitId,name,date\n1,2025,3,7,Italian Grand Prix,2025-09-07\n",
        "circuits": "circuitId,circuitRef,name,location\n7,monza,Autodromo,Monza town\n",
        "drivers": "driverId,driverRef,code,surname\n1,hakkinen,\\N,Häkkinen\n2,norris,NOR,Norris\n",
        "constructors": "constructorId,constructorRef,name\n5,rb,RB F1\n6,mclaren,McLaren\n",
        "results": "resultId,raceId,driverId,constructorId\n1,1,1,5\n2,1,2,6\n3,1,2,5\n",
        "lap_times": "raceId,driverId,lap,position,time,milliseconds\n" + "".join(f"1,{d},{n},{d},1:3{d}.000,{'' if n == 6 else 90000 + d * 1000}\n" for d in (1, 2) for n in range(1, 8)),
        "pit_stops": "raceId,driverId,stop,lap,time,duration,milliseconds\n1,1,1,4,x,y,1\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    laps = providers.ergast_season_laps(providers.read_dump(spark, str(tmp_path)), [2025])
    rows = {(r["driver"], int(r["lap_number"])): r for r in laps.collect()}
    assert len(rows) == 14 and {d for d, _ in rows} == {"HAK", "NOR"}
    assert rows["HAK", 2]["team"] == "Racing Bulls" and rows["NOR", 2]["team"] == "McLaren" and rows["NOR", 2]["circuit"] == "Monza"
    assert [rows["HAK", n]["is_accurate"] for n in (1, 4, 5, 6)] == [False, False, False, True]
    assert rows["HAK", 4]["pit_in"] and rows["HAK", 5]["pit_out"] and rows["HAK", 6]["lap_time_s"] == 91.0
    with pytest.raises(ValueError, match="timing tier"):
        providers.ergast_export(laps, [2025])
    assert column(providers.ergast_export(laps, [2025], True).limit(1), "data_tier") == ["legacy_timing_check_only"]


def test_columnar_document(spark, tmp_path):
    document = {"season": 2025, "event": "Italian Grand Prix", "session_code": "R", "lap": ["1", "2", "3"], "time": ["90.5", "None", "91.0"], "drv": ["NOR"] * 3, "compound": ["HARD"],
                "iacc": ["true", "True", "None"], "pin": ["None", "12.5", "None"], "lSD": ["2025-09-07T13:00:01.250", "2025-09-07T13:02:00", "None"], "status": ["1", "None", "4"]}
    (tmp_path / "d.json").write_text(json.dumps(document))
    rows = providers.columnar_json_laps(spark.read.json(str(tmp_path / "d.json"))).orderBy("lap_number").collect()
    assert [r["lap_time_s"] for r in rows] == [90.5, None, 91.0] and [r["compound"] for r in rows] == [None] * 3
    assert [r["is_accurate"] for r in rows] == [True, True, False] and [r["pit_in"] for r in rows] == [False, True, False]
    assert rows[0]["event_date"] == "2025-09-07" and rows[0]["circuit"] == "Monza" and rows[1]["track_status"] == "1"


def open_session(spark):
    frame = spark.createDataFrame
    t = lambda s: f"2025-09-07T13:{s // 60:02d}:{s % 60:02d}+00:00"
    return {
        "sessions": frame([(9, 2025, "R", t(600), "Italian Grand Prix", "Yas Marina", "2025-09-07", 16)], "session_key int, year int, session_code string, date_end string, meeting_name string, location string, event_date string, round_number int"),
        "laps": frame([(9, 4, n, None if n == 5 else 90.0, t(90 * (n - 1)), 30.0, 30.0, 30.0, n == 4) for n in range(1, 6)], "session_key int, driver_number int, lap_number int, lap_duration double, date_start string, duration_sector_1 double, duration_sector_2 double, duration_sector_3 double, is_pit_out_lap boolean"),
        "drivers": frame([(9, 4, "NOR", "McLaren")], "session_key int, driver_number int, name_acronym string, team_name string"),
        "stints": frame([(9, 4, 1, 1, 3, "HARD", 0, 1), (9, 4, 2, 4, 5, "SOFT", 2, 2)], "session_key int, driver_number int, stint_number int, lap_start int, lap_end int, compound string, tyre_age_at_start int, stint_id int"),
        "pit": frame([(9, 4, 3)], "session_key int, driver_number int, lap_number int"),
        "position": frame([(9, 4, t(5), 3), (9, 4, t(200), 1)], "session_key int, driver_number int, date string, position int"),
        "weather": frame([(9, t(10), 25.0, 40.0, 50.0, 1000.0, 0.0, 1.5, 90.0)], "session_key int, date string, air_temperature double, track_temperature double, humidity double, pressure double, rainfall double, wind_speed double, wind_direction double"),
        "race_control": frame([(9, t(100), 1, "Flag", "YELLOW", "Sector", 2, ""), (9, t(120), 2, "Flag", "CLEAR", "Sector", 2, ""), (9, t(300), 3, "Other", None, None, None, "CAR 4 (NOR) LAP DELETED - TRACK LIMITS")],
                              "session_key int, date string, message_id int, category string, flag string, scope string, sector int, message string"),
    }


def test_endpoint_tables_to_laps(spark):
    rows = providers.openf1_session_laps(open_session(spark), False).orderBy("lap_number").collect()
    assert [r["tyre_life"] for r in rows] == [1, 2, 3, 3, 4] and [r["compound"] for r in rows] == ["HARD"] * 3 + ["SOFT"] * 2
    assert [r["position"] for r in rows] == [3, 3, 1, 1, 1]
    assert [r["track_status"] for r in rows] == ["1", "12", "1", "1", "1"]
    assert [r["pit_in"] for r in rows] == [False, False, True, False, False] and [r["pit_out"] for r in rows] == [False, False, False, True, False]
    assert [r["is_accurate"] for r in rows] == [False, True, False, False, False]
    assert [r["deleted"] for r in rows] == [False, False, False, True, False]
    assert {r["circuit"] for r in rows} == {"Yas Island"} and {r["driver"] for r in rows} == {"NOR"} and {r["air_temp_c"] for r in rows} == {25.0}


def test_read_write_and_cache(spark, tmp_path):
    laps = make_laps(spark, seasons=(2023, 2024))
    readers.write_laps(laps, str(tmp_path / "laps"))
    back = readers.scan_laps(spark, str(tmp_path / "laps"))
    assert back.count() == laps.count() and back.where("season = 2024").count() == 14
    laps.drop("compound").coalesce(1).write.csv(str(tmp_path / "laps.csv"), header=True)
    merged = readers.scan_laps(spark, str(tmp_path / "laps"), str(tmp_path / "laps.csv"))
    assert merged.count() == 2 * laps.count() and dict(merged.dtypes)["lap_time_s"] == "double"
    calls = []

    def build(df):
        calls.append(1)
        return build_features(df, split=False)

    first, second = (readers.cached_features(laps, str(tmp_path / "cache"), build, 5, LAP_VALIDITY_VERSION).count() for _ in range(2))
    assert first == second and len(calls) == 1
    other = laps.withColumn("lap_time_s", F.col("lap_time_s") + 1)
    readers.cached_features(other, str(tmp_path / "cache"), build, 5, LAP_VALIDITY_VERSION)
    assert len(calls) == 2
    same = readers.table_fingerprint(laps.orderBy(F.rand()), 5, 3).first()
    assert same == readers.table_fingerprint(laps, 5, 3).first()
    readers.write_predictions(laps.limit(3), str(tmp_path / "out"), laps.groupBy().count())
    assert spark.read.parquet(str(tmp_path / "out/predictions")).count() == 3


def test_nan_becomes_null(spark, tmp_path):
    spark.createDataFrame([(float("nan"), 1.0)], "lap_time_s double, lap_number double").write.parquet(str(tmp_path / "n"))
    assert readers.scan_laps(spark, str(tmp_path / "n")).first()["lap_time_s"] is None


def test_bad_cells_become_missing(spark):
    race = spark.createDataFrame([("20x4", "3", "GP", "2024-01-01", None, [("1a", [("abc", "p", "1:31.0")]), ("2", [("abc", "1", "oops")])], None, [("abc", "two")])], providers.PAGES_SCHEMA)
    rows = providers.jolpica_race_laps(race).collect()
    assert len(rows) == 2 and all(r["season"] is None and r["round_number"] == 3 and not r["pit_in"] for r in rows)
    assert {r["lap_number"] for r in rows} == {None, 2.0}
    timing = spark.createDataFrame([("20x4", "r", "GP", "C", "2024-01-01", "R", "AAA", "T", "x", "y", "1", "2", "3", "SOFT", "z", "1", "1", "1", "1", None, None, True, False)],
        "season string, round_number string, event string, circuit string, event_date string, session string, Driver string, Team string, LapNumber string, LapTime string, Sector1Time string, Sector2Time string, Sector3Time string, Compound string, TyreLife string, FreshTyre string, Stint string, Position string, TrackStatus string, PitInTime string, PitOutTime string, IsAccurate boolean, Deleted boolean")
    row = providers.normalize_timing(timing).first()
    assert row["season"] is None and row["round_number"] is None and row["lap_number"] is None and row["lap_time_s"] is None and row["sector1_s"] == 1.0
    document = spark.createDataFrame([("20x4", "GP", "R", ["1", "b"], ["90.5", "late"])], "season string, event string, session_code string, lap array<string>, time array<string>")
    assert sorted((r["lap_number"] or 0, r["lap_time_s"] or 0) for r in providers.columnar_json_laps(document).collect()) == [(0, 0), (1.0, 90.5)]


def test_calendar_values_come_from_one_row(spark):
    laps = make_laps(spark, laps=1).drop("round_number").withColumns({"event": F.lit("GP_1"), "circuit": F.lit("own")})
    schema = "season int, event string, round_number int, circuit string, event_date string"
    filed = [(2024, "GP_1", 5, "Bcirc", "2024-05-02"), (2024, "GP_1", 4, "Zcirc", "2024-05-01")]
    calendar = spark.createDataFrame(filed, schema)
    row = providers.apply_calendar(laps, calendar).first()
    assert (row["round_number"], row["circuit"], row["event_date"]) == (4, "Zcirc", "2024-05-01")
    landed = spark.createDataFrame([(*r, i) for i, r in enumerate(filed)], schema + ", ingest_id int")
    row = providers.apply_calendar(laps, landed).first()
    assert (row["round_number"], row["circuit"], row["event_date"]) == (5, "Bcirc", "2024-05-02")


def test_sessions_that_may_still_change_are_left_out(spark):
    rows = spark.createDataFrame([(1, "2024-05-01 10:00:00", "Race"), (2, "2024-05-01 12:00:00", "Race"), (3, None, "Day 1")], "session_key int, d string, session_name string")
    sessions = rows.withColumn("date_end", F.to_timestamp("d"))
    done = providers.completed_sessions(sessions, F.to_timestamp(F.lit("2024-05-01 14:00:00")))
    assert column(done, "session_key") == [1]
    assert sorted(column(providers.meeting_sessions(sessions), "session_key")) == [1, 2]
    assert column(providers.meeting_sessions(sessions, ["Q"]), "session_key") == []
