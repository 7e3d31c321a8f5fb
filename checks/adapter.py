"""Lap and stream tables derived from the given parquet tables, and the same tables as SQL.

The given tables hold no laps; these deterministic views of lineitem, supplier and events
carry every situation the operators deal with. Times keep three decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = [
    "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def laps(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem joined with supplier as a lap table."""
    suppliers = read(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    items = read(spark, folder, "lineitem")
    items = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    items = items.withColumns(
        {"season": F.year("l_shipdate"), "round_number": F.quarter("l_shipdate"), "pit_in": F.col("l_quantity") >= 49}
    )
    run = Window.partitionBy("season", "round_number", "l_suppkey").orderBy(*ORDER)
    items = items.withColumns(
        {"lap": F.row_number().over(run), "pit_out": F.coalesce(F.lag("pit_in").over(run), F.lit(False))}
    )
    price, part = F.col("l_extendedprice"), F.col("l_partkey")
    status = part % 97
    return items.select(
        F.lit("F1").alias("series"),
        "season",
        "round_number",
        F.concat(F.lit("GP_"), F.col("round_number").cast("string")).alias("event"),
        F.concat(F.lit("C_"), F.col("round_number").cast("string")).alias("circuit"),
        F.concat(F.col("season").cast("string"), F.lit("-0"), (F.col("round_number") * 2).cast("string"), F.lit("-15")).alias("event_date"),
        F.lit("R").alias("session"),
        F.concat(F.lit("D"), F.col("l_suppkey").cast("string")).alias("driver"),
        F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("team"),
        F.col("lap").cast("double").alias("lap_number"),
        F.when(part % 101 != 0, 80 + F.floor(price / 10) / 1000).alias("lap_time_s"),
        (25 + F.floor(price / 40) / 1000).alias("sector1_s"),
        (27 + F.floor(price / 30) / 1000).alias("sector2_s"),
        (28 + F.floor(price / 50) / 1000).alias("sector3_s"),
        F.when(F.col("l_linenumber") % 3 == 0, "SOFT").when(F.col("l_linenumber") % 3 == 1, "MEDIUM").otherwise("HARD").alias("compound"),
        ((F.col("lap") - 1) % 14 + 1).cast("double").alias("tyre_life"),
        ((F.col("lap") - 1) % 14 == 0).alias("fresh_tyre"),
        (F.floor((F.col("lap") - 1) / 14) + 1).cast("double").alias("stint"),
        F.col("l_linenumber").cast("double").alias("position"),
        F.when(status < 3, "4").when(status < 5, "67").when(status < 8, "12").when(status == 8, "5")
        .when(status == 9, None).otherwise("1").alias("track_status"),
        "pit_in",
        "pit_out",
        (part % 89 != 0).alias("is_accurate"),
        (part % 83 == 0).alias("deleted"),
        F.lit("fastf1_timing").alias("data_tier"),
        (15 + F.round(F.col("l_discount") * 100)).alias("air_temp_c"),
        (25 + F.round(F.col("l_tax") * 100) * 2).alias("track_temp_c"),
        (40 + F.round(F.col("l_discount") * 100) * 3).alias("humidity_pct"),
        (1000 + F.round(F.col("l_tax") * 100)).alias("pressure_mbar"),
        (F.col("l_discount") >= 0.095).alias("rainfall"),
        (F.round(F.col("l_tax") * 100) / 2).alias("wind_speed_ms"),
        (part % 360).cast("double").alias("wind_direction_deg"),
        F.col("l_orderkey").alias("src_order"),
        F.col("l_partkey").alias("src_part"),
    )


LAPS = """
items AS (
  SELECT *, year(l_shipdate)::INT AS season, quarter(l_shipdate)::INT AS round_number, l_quantity >= 49 AS pit_in
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
),
numbered AS (
  SELECT *, row_number() OVER run AS lap, coalesce(lag(pit_in) OVER run, false) AS pit_out
  FROM items
  WINDOW run AS (PARTITION BY season, round_number, l_suppkey
    ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus)
),
laps AS (
  SELECT 'F1' AS series, season, round_number,
    'GP_' || round_number AS event, 'C_' || round_number AS circuit,
    season || '-0' || (round_number * 2) || '-15' AS event_date,
    'R' AS session, 'D' || l_suppkey AS driver, 'T' || s_nationkey AS team,
    lap::DOUBLE AS lap_number,
    CASE WHEN l_partkey % 101 <> 0 THEN 80 + floor(l_extendedprice / 10) / 1000 END AS lap_time_s,
    25 + floor(l_extendedprice / 40) / 1000 AS sector1_s,
    27 + floor(l_extendedprice / 30) / 1000 AS sector2_s,
    28 + floor(l_extendedprice / 50) / 1000 AS sector3_s,
    CASE l_linenumber % 3 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' ELSE 'HARD' END AS compound,
    ((lap - 1) % 14 + 1)::DOUBLE AS tyre_life,
    (lap - 1) % 14 = 0 AS fresh_tyre,
    ((lap - 1) // 14 + 1)::DOUBLE AS stint,
    l_linenumber::DOUBLE AS position,
    CASE WHEN l_partkey % 97 < 3 THEN '4' WHEN l_partkey % 97 < 5 THEN '67' WHEN l_partkey % 97 < 8 THEN '12'
         WHEN l_partkey % 97 = 8 THEN '5' WHEN l_partkey % 97 = 9 THEN NULL ELSE '1' END AS track_status,
    pit_in, pit_out, l_partkey % 89 <> 0 AS is_accurate, l_partkey % 83 = 0 AS deleted,
    'fastf1_timing' AS data_tier,
    15 + round(l_discount * 100) AS air_temp_c,
    25 + round(l_tax * 100) * 2 AS track_temp_c,
    40 + round(l_discount * 100) * 3 AS humidity_pct,
    1000 + round(l_tax * 100) AS pressure_mbar,
    l_discount >= 0.095 AS rainfall,
    round(l_tax * 100) / 2 AS wind_speed_ms,
    (l_partkey % 360)::DOUBLE AS wind_direction_deg,
    l_orderkey AS src_order, l_partkey AS src_part
  FROM numbered
)"""

# Lap state: the restart rule is stated as in its definition (flag counts against the count at
# the previous timed, unflagged lap).
STATE = """
status AS (
  SELECT *, coalesce(track_status, '1') AS st FROM laps
),
flags AS (
  SELECT *, contains(st, '2') AS is_yellow, contains(st, '4') AS is_safety_car, contains(st, '5') AS is_red_flag,
    contains(st, '6') OR contains(st, '7') AS is_vsc, pit_in AS is_pit_in, pit_out AS is_pit_out, deleted AS is_deleted
  FROM status
),
counts AS (
  SELECT *, sum(is_red_flag::INT) OVER run AS red_n, sum(is_safety_car::INT) OVER run AS sc_n,
    lap_time_s IS NOT NULL AND NOT is_red_flag AS red_cand, lap_time_s IS NOT NULL AND NOT is_safety_car AS sc_cand
  FROM flags
  WINDOW run AS (PARTITION BY season, event, session, driver ORDER BY lap_number)
),
previous AS (
  SELECT *,
    coalesce(last_value(CASE WHEN red_cand THEN red_n END IGNORE NULLS) OVER earlier, 0) AS red_prev,
    coalesce(last_value(CASE WHEN sc_cand THEN sc_n END IGNORE NULLS) OVER earlier, 0) AS sc_prev
  FROM counts
  WINDOW earlier AS (PARTITION BY season, event, session, driver ORDER BY lap_number
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
restarts AS (
  SELECT *, red_cand AND red_n > red_prev AS is_red_flag_restart, sc_cand AND sc_n > sc_prev AS is_safety_car_restart
  FROM previous
),
state AS (
  SELECT *, is_accurate AND lap_time_s IS NOT NULL AND NOT (is_deleted OR is_pit_in OR is_pit_out OR is_yellow OR is_safety_car
    OR is_safety_car_restart OR is_vsc OR is_red_flag OR is_red_flag_restart) AS lap_valid
  FROM restarts
)"""

SEGMENTS = """
neighbours AS (
  SELECT *, lag(lap_valid) OVER run AS prev_valid, lag(lap_number) OVER run AS prev_lap
  FROM state WINDOW run AS (PARTITION BY season, event, session, driver ORDER BY lap_number)
),
breaks AS (
  SELECT *, NOT lap_valid OR NOT coalesce(prev_valid, true) OR coalesce(lap_number - prev_lap, 1) <> 1 AS is_break
  FROM neighbours
),
seg AS (
  SELECT *, (sum(is_break::INT) OVER (PARTITION BY season, event, session, driver ORDER BY lap_number))::INT AS segment
  FROM breaks
),
segs AS (
  SELECT *, (row_number() OVER (PARTITION BY season, event, session, driver, segment ORDER BY lap_number))::INT AS laps_in_segment
  FROM seg
)"""

ROLLING = """
deltas AS (
  SELECT *, lap_time_s - lag(lap_time_s) OVER s AS delta
  FROM segs WINDOW s AS (PARTITION BY season, event, session, driver, segment ORDER BY lap_number)
),
rolling AS (
  SELECT *, median(lap_time_s) OVER three AS rolling_median_3, median(lap_time_s) OVER five AS rolling_median_5,
    avg(sector1_s) OVER three AS sector1_mean_3, avg(sector2_s) OVER three AS sector2_mean_3, avg(sector3_s) OVER three AS sector3_mean_3,
    avg(delta) OVER three AS pace_trend_3
  FROM deltas
  WINDOW three AS (PARTITION BY season, event, session, driver, segment ORDER BY lap_number ROWS 2 PRECEDING),
    five AS (PARTITION BY season, event, session, driver, segment ORDER BY lap_number ROWS 4 PRECEDING)
),
pace AS (
  SELECT *, lap_time_s - rolling_median_5 AS lap_delta_to_rolling5, rolling_median_3 - rolling_median_5 AS pace_spread_3_5,
    sector1_s - sector1_mean_3 AS sector1_rel_3, sector2_s - sector2_mean_3 AS sector2_rel_3, sector3_s - sector3_mean_3 AS sector3_rel_3,
    sector1_mean_3 / rolling_median_5 AS sector1_share_3, sector2_mean_3 / rolling_median_5 AS sector2_share_3, sector3_mean_3 / rolling_median_5 AS sector3_share_3,
    lead(lap_time_s) OVER run AS next_time, lead(lap_number) OVER run AS next_lap, lead(lap_valid) OVER run AS next_valid
  FROM rolling WINDOW run AS (PARTITION BY season, event, session, driver ORDER BY lap_number)
),
usable AS (
  SELECT *, lap_valid AND coalesce(next_lap - lap_number = 1, false) AND coalesce(next_valid, false) AND next_time IS NOT NULL AS has_target
  FROM pace
)"""
