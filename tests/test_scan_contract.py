"""The reading contract: types by path, bad cells, defaults."""

from laptable.schema import LAP_SCHEMA
from laptable.sources import readers


def test_paths_of_other_types_are_read_alike(spark, tmp_path):
    good = "season int, event string, lap_number double, lap_time_s double, pit_in boolean, extra int"
    texts = "season string, event int, lap_number string, lap_time_s string, pit_in string"
    parts = "season double, event string, lap_number int, lap_time_s float"
    spark.createDataFrame([(2020, "A", 1.0, 80.5, True, 7), (2020, "A", 2.0, float("nan"), None, 8)], good).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("2021", 5, "1", "81.5", "false"), ("x", 6, "2", "fast", "maybe")], texts).write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([(2022.0, "C", 3, 82.5), (2022.5, "C", 4, None)], parts).write.parquet(str(tmp_path / "c"))
    (tmp_path / "d.csv").write_text("season,event,lap_number,lap_time_s\n2023,D,1,83.5\n2023,D,two,\n")
    paths = [str(tmp_path / p) for p in ("a", "b", "c", "d.csv")]
    laps = readers.scan_laps(spark, *paths)
    types = {f.name: f.dataType for f in LAP_SCHEMA}
    assert all(f.dataType == types[f.name] for f in laps.schema if f.name in types) and dict(laps.dtypes)["extra"] == "int"
    rows = {(r["season"], r["event"], r["lap_number"], r["lap_time_s"], r["pit_in"]) for r in laps.collect()}
    assert rows == {
        (2020, "A", 1.0, 80.5, True), (2020, "A", 2.0, None, None), (2021, "5", 1.0, 81.5, False), (None, "6", 2.0, None, None),
        (2022, "C", 3.0, 82.5, None), (None, "C", 4.0, None, None), (2023, "D", 1.0, 83.5, None), (2023, "D", None, None, None),
    }
    bad = {r["column"]: (r["rows"], r["bad"]) for r in readers.bad_cells(spark, *paths).collect()}
    assert bad == {"season": (8, 2), "event": (8, 0), "lap_number": (8, 1), "lap_time_s": (8, 1), "pit_in": (4, 1)}
    filled = readers.scan_laps(spark, *paths, defaults=True)
    assert {"circuit", "data_tier", "team"} <= set(filled.columns) and filled.where("data_tier is null").isEmpty()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "season int, other string").write.parquet(str(tmp_path / "e"))
    assert readers.scan_laps(spark, str(tmp_path / "e"), defaults=True).isEmpty()
    assert readers.bad_cells(spark, str(tmp_path / "e")).isEmpty()
