"""Release gate: nothing after a lap may change a feature of that lap or an earlier one."""

from conftest import make_laps
from pyspark.sql import functions as F

from laptable.operators.features import build_features
from laptable.schema import PRIOR_GROUPS, RAW_TARGET, TARGET, lag_names

NUMERIC = ["rolling_median_3", "rolling_median_5", "pace_trend_3", "pace_spread_3_5", "laps_in_segment", "sector2_rel_3", *lag_names(5), *PRIOR_GROUPS]


def laps(spark):
    return make_laps(spark, seasons=(2022, 2023, 2024), events=2, drivers=("AAA", "BBB"))


def table(df):
    return build_features(df, split=False, require_target=False)


def test_future_laps_do_not_change_features(spark):
    base = laps(spark)
    later = (F.col("season") == 2024) & ((F.col("round_number") > 1) | (F.col("lap_number") > 6))
    noisy = base.withColumns({c: F.when(later, F.col(c) + 5 + F.col("lap_number") % 3).otherwise(F.col(c)) for c in ("lap_time_s", "sector2_s", "air_temp_c")})
    keys = ["season", "event", "driver", "lap_number"]
    earlier = "season < 2024 or (round_number = 1 and lap_number <= 6)"
    before = {tuple(r[k] for k in keys): r for r in table(base).where(earlier).collect()}
    after = {tuple(r[k] for k in keys): r for r in table(noisy).where(earlier).collect()}
    assert before.keys() == after.keys() and before
    for key, row in before.items():
        assert [row[c] for c in NUMERIC] == [after[key][c] for c in NUMERIC], key
    edge = (2024, "GP_1", "AAA", 6.0)
    assert before[edge][RAW_TARGET] != after[edge][RAW_TARGET] and before[edge][TARGET] != after[edge][TARGET]


def test_priors_ignore_the_current_event(spark):
    base = laps(spark)
    here = (F.col("season") == 2024) & (F.col("round_number") == 1)
    slower = base.withColumn("lap_time_s", F.when(here, F.col("lap_time_s") + 30).otherwise(F.col("lap_time_s")))
    pick = lambda df: sorted(tuple(r) for r in table(df).where("season = 2024 and round_number = 1").select("driver", "lap_number", *PRIOR_GROUPS).collect())
    assert pick(base) == pick(slower)
    assert any(v is not None for row in pick(base) for v in row[2:])


def test_other_rows_order_does_not_matter(spark):
    base = laps(spark)
    columns = ["season", "event", "driver", "lap_number", *NUMERIC]
    a = sorted(map(repr, table(base).select(*columns).collect()))
    b = sorted(map(repr, table(base.orderBy(F.rand(3))).select(*columns).collect()))
    assert a == b


def test_events_of_one_day_do_not_see_each_other(spark):
    base = laps(spark).withColumn("event_date", F.concat(F.col("season").cast("string"), F.lit("-05-05")))
    first = table(base).where("season = 2022").select(*PRIOR_GROUPS).collect()
    assert all(v is None for row in first for v in row)


def test_missing_keys_group_and_match(spark):
    base = laps(spark).withColumn("compound", F.lit(None).cast("string"))
    values = table(base).where("season = 2024").select("hist_compound_circuit_pace").collect()
    assert all(r[0] is not None for r in values)


def test_wind_is_circular(spark):
    base = make_laps(spark, lambda r: r | {"wind_direction_deg": 359.0 if r["lap_number"] < 7 else 1.0})
    rows = table(base).select("wind_dir_sin", "wind_dir_cos").collect()
    assert max(abs(a["wind_dir_sin"] - b["wind_dir_sin"]) for a in rows for b in rows) < 0.05
