"""Physical plans: shuffles, pruning and pushdown that must not get lost."""

import re

from conftest import make_laps
from pyspark.sql import functions as F

from laptable.operators import features as feat
from laptable.operators import timed_joins
from laptable.operators.lap_state import lap_state_flags, runs_of
from laptable.sources.readers import scan_laps, write_laps


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_run_features_shuffle_and_sort_once(spark, tmp_path, capsys):
    write_laps(make_laps(spark, seasons=(2023, 2024)).withColumn("mean_rpm", F.lit(1.0)), str(tmp_path / "laps"))
    runs = runs_of(feat.prepare(scan_laps(spark, str(tmp_path / "laps"))), False)
    table = feat.run_features(runs, lap_state_flags(runs), 5)
    text = plan(table.select("driver", "lap_number", "rolling_median_5", "laps_in_segment", "target_next_lap_time_s"), capsys)
    assert text.count("Exchange hashpartitioning") == 1 and len(re.findall(r"\+- Sort ", text)) == 1
    columns = re.search(r"FileScan parquet \[(.*?)\]", text).group(1)
    assert "lap_time_s" in columns and "mean_rpm" not in columns and "compound" not in columns


def test_season_filter_prunes_folders(spark, tmp_path, capsys):
    write_laps(make_laps(spark, seasons=(2023, 2024)), str(tmp_path / "laps"))
    text = plan(scan_laps(spark, str(tmp_path / "laps")).where("season = 2024 and lap_time_s > 80").select("driver"), capsys)
    assert re.search(r"PartitionFilters: \[[^\]]*season", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_asof_join_is_one_shuffle_without_a_join(spark, capsys):
    probes = spark.range(10).select((F.col("id") % 3).alias("k"), F.timestamp_seconds("id").alias("at"))
    updates = spark.range(10).select((F.col("id") % 3).alias("k"), F.timestamp_seconds("id").alias("when"), "id")
    text = plan(timed_joins.asof_backward(probes, updates, ["k"], "at", "when", ["id"], "id", False), capsys)
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
