"""The plans for very large groups give the same rows as Spark's own windows."""

import uuid

import numpy as np
import pytest
from conftest import SF, make_laps, rows_of
from pyspark.sql import functions as F

from checks.adapter import laps
from checks.stream_queries import kind, messages, session_ends, spans
from checks.stream_queries import q_open as open_laps
from laptable.functions.groups import OrderedGroups, _sliced, percentiles
from laptable.operators import features as feat
from laptable.operators import intervals as iv
from laptable.operators import timed_joins, windows
from laptable.operators.lap_state import lap_state_flags, runs_of
from laptable.operators.sessions import next_lap_outcome
from laptable.schema import LAP_KEYS, LAP_STATE


def one_long_run(spark):
    """Every lap in one run: a group that holds the whole table, with gaps and copies."""
    def edit(r):
        n = r["lap_number"]
        if n % 41 == 0:
            return None
        return r | {
            "track_status": "4" if n % 23 == 0 else "5" if n % 57 == 0 else "1", "lap_time_s": None if n % 19 == 0 else r["lap_time_s"] + (n * 7919 % 101) / 100,
            "pit_in": n % 31 == 0,
        }

    base = make_laps(spark, edit, laps=400)
    return base.unionByName(base.where("lap_number % 50 = 0"))


@pytest.mark.parametrize("chunks", [3, 9])
def test_run_features_of_one_long_run(spark, chunks):
    df = feat.prepare(one_long_run(spark))
    results = []
    for split in (False, True):
        runs = runs_of(df, split, chunks)
        flagged = lap_state_flags(runs)
        table = runs.finish(feat.run_features(runs, flagged, 5))
        columns = [*LAP_KEYS, *LAP_STATE, "laps_in_segment", "rolling_median_3", "rolling_median_5", "pace_trend_3", "sector2_mean_3", *[c for c in table.columns if "_lag" in c], "target_next_lap_time_s", "next_lap_number", "next_lap_valid"]
        results.append(rows_of(table.select(*columns)))
        assert not split or runs.df.select("_chunk").distinct().count() > 1
    assert results[0] == results[1]


def test_segments_and_outcome_split(spark):
    df = feat.prepare(one_long_run(spark))
    out = []
    for split in (False, True):
        runs = runs_of(df, split, 5)
        flagged = lap_state_flags(runs)
        seg = feat.segments(runs, flagged).select(*LAP_KEYS, "is_break", "segment", "laps_in_segment")
        nxt = next_lap_outcome(runs, flagged).select(*LAP_KEYS, "next_time_s", "next_valid", "next_pit_in", "next_neutralised", "next_adjacent")
        out.append((rows_of(seg), rows_of(nxt)))
    assert out[0] == out[1]


def test_full_table_split(spark):
    base = laps(spark, SF)
    columns = [*LAP_KEYS, "laps_in_segment", "rolling_median_5", "pace_trend_3", "hist_driver_circuit_pace", "hist_team_weather_pace", "target_delta_vs_rolling5_s"]
    names = ["hist_driver_circuit_pace", "hist_team_weather_pace"]
    plain, split = (feat.build_features(base, split=s, priors=names).select(*columns) for s in (False, True))
    assert rows_of(plain) == rows_of(split)


def test_windows_split(spark):
    table = feat.build_features(one_long_run(spark), priors=[], split=False)
    for make in (lambda s: windows.history_windows(table, ["lap_time_s", "pace_trend_3"], 4, back_fill=True, split=s), lambda s: windows.walk_forward(table, 6, 3, split=s)):
        assert rows_of(make(False)) == rows_of(make(True))


def test_percentiles_split_equals_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=301), np.full(150, 0.25)])
    df = spark.createDataFrame([(("a" if i % 3 else None), float(v)) for i, v in enumerate(values)], "g string, v double")
    points = {"p0": 0.0, "p2": 0.02, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    for split in (False, True):
        got = {r["g"]: [r[n] for n in points] for r in percentiles(df, ["g"], "v", points, split).collect()}
        for g, keep in (("a", [i % 3 != 0 for i in range(len(values))]), (None, [i % 3 == 0 for i in range(len(values))])):
            assert np.allclose(got[g], np.quantile(values[keep], list(points.values())), atol=1e-12)
    whole = percentiles(df, [], "v", {"m": 0.5}, True).first()["m"]
    assert abs(whole - np.median(values)) < 1e-12


def test_asof_split(spark):
    probes, updates = kind(spark, SF, "purchase"), kind(spark, SF, "click").select("day", F.col("at").alias("when"), "value", "event_id")
    one = probes.withColumn("day", F.lit("all")), updates.withColumn("day", F.lit("all"))
    for p, u in ((probes, updates), one):
        back = [rows_of(timed_joins.asof_backward(p.drop("value"), u, ["day"], "at", "when", ["value"], "event_id", s)) for s in (False, True)]
        near = [rows_of(timed_joins.asof_nearest(p.drop("value"), u, ["day"], "at", "when", ["value"], 600, "event_id", s)) for s in (False, True)]
        assert back[0] == back[1] and near[0] == near[1]


def test_intervals_split(spark):
    for make in (
        lambda s: iv.track_status_intervals(messages(spark, SF), session_ends(spark, SF), s),
        lambda s: iv.merge_intervals(spans(spark, SF), ["session_key"], s),
    ):
        assert rows_of(make(False)) == rows_of(make(True))


def jobs_of(spark, build):
    """Jobs that building a plan starts."""
    context, group = spark.sparkContext, f"plan-{uuid.uuid4()}"
    context.setJobGroup(group, "plan")
    try:
        build()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(group))


def test_building_plans_starts_no_job(spark):
    base = laps(spark, SF)
    assert jobs_of(spark, lambda: feat.build_features(base)) == 0
    assert jobs_of(spark, lambda: open_laps(spark, SF)) <= 2, "only the schemas of the two tables are read"
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    assert jobs_of(spark, lambda: percentiles(df, ["k"], "id", {"m": 0.5}, split=True)) == 0
    assert jobs_of(spark, lambda: OrderedGroups(df, ["k"], ["id"], split=True)) >= 1


def test_percentiles_of_an_empty_table_have_one_shape(spark):
    df = spark.createDataFrame([], "g string, v double")
    for keys, rows in (([], 1), (["g"], 0)):
        shapes = [percentiles(df, keys, "v", {"m": 0.5}, split).collect() for split in (False, True)]
        assert shapes[0] == shapes[1] and len(shapes[0]) == rows


def test_percentile_plans_agree_to_the_bit(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(rng.normal(0, 3, 999))], "g int, v double")
    plans = [rows_of(percentiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}, split)) for split in (False, True)]
    assert plans[0] == plans[1]


def test_percentile_slices_follow_the_values_not_their_range(spark):
    """Values over a range of 10^12, most of them crowded together: slices stay small, and results equal Spark's own to the bit."""
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(80, 1e-4, 6000), 10.0 ** rng.uniform(-6, 12, 3000), -(10.0 ** rng.uniform(0, 12, 1000))])
    df = spark.createDataFrame([(("a", "b", None)[i % 3], float(v)) for i, v in enumerate(values)] + [("tie", 5.0)] * 500, "g string, v double")
    points = {"p0": 0.0, "p2": 0.025, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    for keys in (["g"], []):
        plans = [rows_of(percentiles(df, keys, "v", points, split)) for split in (False, True)]
        assert plans[0] == plans[1]
    counted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("_n"))
    sizes = _sliced(counted, ["g"], "v", False).groupBy("g", "_slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 16
    whole = df.select(F.col("v").cast("decimal(30,6)").alias("v"))
    assert percentiles(whole, [], "v", {"m": 0.5}, True).count() == 1
