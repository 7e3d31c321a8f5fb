"""Live-style audit: would a forecast have been issued at fixed laps, and how good was it?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laptable.functions.groups import OrderedGroups, join_on, percentiles
from laptable.operators.sessions import next_lap_outcome
from laptable.schema import LAP_KEYS

# --- Fixed values: laps at which forecasts are audited --------------------------------------
CUTS = [5, 10, 15, 20, 25, 30, 35, 40, 45, 50]


def issued_forecasts(runs: OrderedGroups, flagged: DataFrame, scored: DataFrame, cuts: list[int] | None = None) -> DataFrame:
    """Timed laps at the cuts with the next lap's outcome and, where the lap is a usable
    racing lap, its forecast. ``scored``: lap key, pred, lower, upper."""
    outcome = next_lap_outcome(runs, flagged)
    points = outcome.where(F.col("lap_number").isin([float(c) for c in cuts or CUTS]) & F.col("lap_time_s").isNotNull()).select(
        *LAP_KEYS, "lap_time_s", "next_time_s", "next_adjacent", "next_valid", "next_pit_in", "next_neutralised"
    )
    forecasts = scored.select(*LAP_KEYS, "pred", "lower", "upper")
    return join_on(points, forecasts, LAP_KEYS).withColumn("issued", F.col("pred").isNotNull())


def issue_counts(issued: DataFrame) -> DataFrame:
    return issued.groupBy("issued").agg(F.count(F.lit(1)).alias("laps"))


def issued_forecast_audit(issued: DataFrame, split: bool = True) -> DataFrame:
    """Errors over all next laps, by what the next lap was, and by cut. A lap belongs to a few
    groups; the pairs are made map-side and aggregated once."""
    scored = issued.where(F.col("issued") & F.col("next_adjacent") & F.col("next_time_s").isNotNull())
    clean = F.coalesce(F.col("next_valid"), F.lit(False))
    groups = F.array_compact(F.array(
        F.lit("all"),
        F.when(clean, "clean").otherwise("not clean"),
        F.when(F.coalesce("next_pit_in", F.lit(False)), "pit-in"),
        F.when(F.col("next_neutralised"), "SC or VSC"),
        F.concat(F.lit("lap "), F.col("lap_number").cast("int").cast("string")),
        F.when(clean, F.concat(F.lit("clean lap "), F.col("lap_number").cast("int").cast("string"))),
    ))
    long = scored.select(
        F.explode(groups).alias("group"), F.abs(F.col("pred") - F.col("next_time_s")).alias("_ae"),
        F.abs(F.col("lap_time_s") - F.col("next_time_s")).alias("_prev"), F.col("next_time_s").between(F.col("lower"), F.col("upper")).cast("double").alias("_in"),
    )
    sums = long.groupBy("group").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("_ae").alias("mae_s"), F.avg((F.col("_ae") <= 0.5).cast("double")).alias("within_0_5s_share"),
        F.avg("_in").alias("coverage"), F.avg("_prev").alias("previous_lap_mae_s"),
        F.avg((F.col("_prev") <= 0.5).cast("double")).alias("previous_lap_within_0_5s_share"),
    )
    return join_on(sums, percentiles(long, ["group"], "_ae", {"median_ae_s": 0.5, "p90_ae_s": 0.9}, split), ["group"], "inner")
