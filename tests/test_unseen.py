"""Unseen values against all earlier rows."""

from checks import report_queries
from conftest import make_laps
from pyspark.sql import functions as F

from laptable.operators.features import build_features


def test_values_of_any_earlier_row_are_seen(spark, monkeypatch):
    laps = make_laps(spark, seasons=(1995, 2000), drivers=("AAA", "BBB"), laps=14)
    table = build_features(laps, check_tiers=False, priors=[])
    late = F.col("season") == 2000
    table = table.withColumn("driver", F.when(late & (F.col("lap_number") == 9), "NEW").otherwise(F.col("driver")))
    # No earlier row of BBB has a number divisible by three.
    table = table.withColumn("src_part", F.when((F.col("driver") == "BBB") & ~late, 1).otherwise(3))
    monkeypatch.setattr(report_queries, "scored", lambda *_: table)
    found = report_queries.QUERIES["unseen_categories"](spark, "").select("driver", "unseen_driver").distinct().collect()
    assert {r["driver"]: r["unseen_driver"] for r in found} == {"AAA": False, "BBB": False, "NEW": True}
