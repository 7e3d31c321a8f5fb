"""Lap state, restarts, segments and targets on hand-made races."""

import pytest
from conftest import both, change, make_laps

from laptable.operators import features as feat
from laptable.operators.lap_state import lap_state_flags, runs_of


def table(spark, edit=None, **options):
    rows = feat.build_features(make_laps(spark, edit, **options), priors=[], split=False).orderBy("lap_number").collect()
    return {int(r["lap_number"]): r for r in rows}


def flags(spark, edit=None, **options):
    runs = runs_of(feat.prepare(make_laps(spark, edit, **options)), False)
    return {int(r["lap_number"]): r for r in lap_state_flags(runs).collect()}


def test_pit_stop_resets_the_context(spark):
    t = table(spark, both(change({6}, pit_in=True), change({7}, pit_out=True)))
    assert {5, 6, 7}.isdisjoint(t) and 4 in t
    assert t[8]["laps_in_segment"] == 1 and t[8]["lap_time_s_lag1_rel"] is None
    assert t[8]["rolling_median_5"] == t[8]["lap_time_s"]


def test_safety_car_and_virtual_safety_car(spark):
    edit = both(change({4}, track_status="4"), change({9}, track_status="67"))
    t, f = table(spark, edit), flags(spark, edit)
    assert {3, 4, 5, 8, 9}.isdisjoint(t)
    assert f[5]["is_safety_car_restart"] and not f[10]["is_safety_car_restart"] and f[10]["lap_valid"]


def test_yellow_lap_is_skipped(spark):
    t = table(spark, change({6}, track_status="12"))
    assert {5, 6}.isdisjoint(t) and t[7]["lap_time_s_lag1_rel"] is None


def test_untimed_safety_car_lap(spark):
    f = flags(spark, both(change({4, 5}, track_status="4"), change({5}, lap_time_s=None)))
    assert [n for n, r in f.items() if r["is_safety_car_restart"]] == [6]


def test_red_flag_restart(spark):
    edit = both(change({5}, track_status="125"), change({5, 6}, lap_time_s=None), change({7}, lap_time_s=140.0))
    t, f = table(spark, edit), flags(spark, edit)
    assert f[7]["is_red_flag_restart"] and {4, 5, 6, 7}.isdisjoint(t)


def test_red_flag_on_the_first_lap_of_shuffled_rows(spark):
    f = flags(spark, change({1}, track_status="5"), shuffle=True)
    assert [n for n, r in f.items() if r["is_red_flag_restart"]] == [2]


def test_missing_lap_breaks_adjacency(spark):
    t = table(spark, lambda r: None if r["lap_number"] == 6 else r)
    assert 5 not in t and t[7]["laps_in_segment"] == 1


def test_deleted_and_inaccurate_laps(spark):
    t = table(spark, both(change({5}, deleted=True), change({9}, is_accurate=False)))
    assert {4, 5, 8, 9}.isdisjoint(t)


def test_duplicate_laps_collapse_segments(spark):
    laps = make_laps(spark)
    t = feat.build_features(laps.unionByName(laps), priors=[], split=False)
    assert t.where("laps_in_segment > 2").isEmpty()


def test_missing_status_is_clear(spark):
    f = flags(spark, both(change({3}, track_status=None), change({4}, track_status="nan")))
    assert f[3]["lap_valid"] and f[4]["lap_valid"]


def test_inference_mode_keeps_the_last_lap(spark):
    laps = make_laps(spark)
    rows = {int(r["lap_number"]): r for r in feat.build_features(laps, priors=[], require_target=False, split=False).collect()}
    assert rows[14]["target_next_lap_time_s"] is None and rows[13]["target_next_lap_time_s"] is not None


def test_guards(spark):
    laps = make_laps(spark)
    with pytest.raises(ValueError, match="Missing required"):
        feat.build_features(laps.drop("driver"))
    with pytest.raises(ValueError, match="order events"):
        feat.build_features(laps.drop("event_date", "round_number"))
    assert feat.build_features(laps.drop("event_date", "round_number"), require_chronology=False, split=False).count() == 13
    with pytest.raises(Exception, match="check-only"):
        from pyspark.sql import functions as F

        feat.build_features(laps.withColumn("data_tier", F.lit("legacy_timing_check_only"))).count()
    with pytest.raises(ValueError, match="Unknown feature groups"):
        feat.select_features(laps.columns, drop=["nothing"])
    with pytest.raises(ValueError, match="next lap"):
        feat.assert_no_leakage(["lap_number", "next_lap_valid"])
    with pytest.raises(ValueError, match="history"):
        feat.build_features(laps, history=0)


def test_feature_names_follow_the_contract(spark):
    from laptable.schema import feature_contract

    t = feat.build_features(make_laps(spark, seasons=(2023, 2024)), split=False)
    contract = feature_contract(5)
    assert not [c for c in contract["numeric"] + contract["categorical"] if c not in t.columns]
    ablated = feat.select_features(t.columns, drop=["historical_numeric"])
    assert not [c for c in ablated["numeric"] if c.startswith("hist_")]
