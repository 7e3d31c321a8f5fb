import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from laptable.session import tune  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


def make_laps(spark, edit=None, seasons=(2024,), events=1, drivers=("AAA",), laps=14, shuffle=False):
    """A small table of clean laps; ``edit(row)`` changes rows (or returns None to drop one)."""
    rows = []
    for s in seasons:
        for e in range(1, events + 1):
            for d, driver in enumerate(drivers):
                for n in range(1, laps + 1):
                    row = dict(
                        season=s, round_number=e, event_date=f"{s}-{e + 2:02d}-15", event=f"GP_{e}", circuit=f"C_{e}", session="R", driver=driver, team=f"T{d % 2}",
                        lap_number=float(n), lap_time_s=80.0 + e + d + ((n * 37 + s * 7) % 11) / 10, sector1_s=25.0, sector2_s=27.0 + n / 100, sector3_s=28.0,
                        compound="HARD" if n > 7 else "MEDIUM", tyre_life=float(n), position=float(d + 1), track_status="1", pit_in=False, pit_out=False,
                        is_accurate=True, deleted=False, air_temp_c=20.0 + n, track_temp_c=30.0, humidity_pct=50.0, rainfall=False, wind_speed_ms=2.0, wind_direction_deg=90.0,
                    )
                    row = edit(row) if edit else row
                    if row is not None:
                        rows.append(row)
    if shuffle:
        rows = rows[::-1][::2] + rows[::2] if len(rows) % 2 == 0 else rows[::-1]
    types = {int: "int", float: "double", str: "string", bool: "boolean"}
    names = list(rows[0])
    kinds = {n: next((types[type(r[n])] for r in rows if r[n] is not None), "string") for n in names}
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in names))


def change(laps, **values):
    """Edit that sets columns on the given lap numbers."""

    def edit(row):
        return row | values if row["lap_number"] in laps else row

    return edit


def both(*edits):
    def edit(row):
        for e in edits:
            row = e(row)
        return row

    return edit


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
