"""Priors are looked up once per run and come back as one map per run."""

from statistics import median

from pyspark.sql import functions as F

from laptable.operators.features import build_features
from laptable.operators.priors import history_prior, prior_lookup
from laptable.schema import PRIOR_GROUPS
from tests.conftest import make_laps

NAMES = ["hist_driver_global_pace", "hist_team_circuit_pace", "hist_driver_circuit_compound_pace"]


def expected(rows, row, name):
    """Median of the medians of strictly earlier events of the row's group."""
    same = [r for r in rows if all(r[c] == row[c] for c in PRIOR_GROUPS[name])]
    earlier = {(r["season"], r["event"]) for r in same if r["event_date"] < row["event_date"]}
    medians = [median(r["lap_time_s"] for r in same if (r["season"], r["event"]) == e) for e in earlier]
    return round(median(medians), 6) if medians else None


def test_laps_of_a_run_ask_for_a_value_once(spark, monkeypatch):
    # A missing driver and a missing compound are groups of their own.
    laps = make_laps(
        spark, lambda r: r | {"driver": None if r["driver"] == "CCC" else r["driver"], "compound": None if r["lap_number"] == 3 else r["compound"]},
        seasons=(2022, 2023, 2024), events=2, drivers=("AAA", "BBB", "CCC"), laps=12,
    )
    asked, join = [], type(laps).join
    monkeypatch.setattr(type(laps), "join", lambda df, other, on=None, how=None: asked.append(df) or join(df, other, on, how))
    found = prior_lookup(laps, history_prior(laps, NAMES), NAMES).collect()
    rows = laps.collect()
    assert len(found) == len(rows) == 216
    for row in found:
        for name in NAMES:
            value = row[name]
            assert (None if value is None else round(value, 6)) == expected(rows, row, name), (row, name)
    # Of 18 runs of 12 laps, two thirds want 1 + 1 + 3 values; without a driver each of the 3 compounds asks by itself.
    assert asked[0].count() == 12 * 5 + 6 * 3 * 3


def test_a_lap_that_is_not_valid_has_the_priors_of_its_group(spark):
    laps = make_laps(spark, lambda r: r | {"compound": "SOFT" if r["lap_number"] == 2 and r["driver"] == "AAA" or r["season"] == 2022 else "HARD"},
                     seasons=(2022, 2023), drivers=("AAA", "BBB", "CCC"), laps=4).withColumn("lap_valid", F.expr("lap_number <> 2 or driver <> 'AAA'"))
    soft = laps.where("lap_valid").unionByName(laps.where("driver = 'CCC' and season = 2023").withColumn("compound", F.lit("SOFT")))
    name = "hist_team_circuit_compound_pace"  # AAA and CCC share a team
    found = prior_lookup(laps, history_prior(soft, [name]), [name]).where("not lap_valid and season = 2023").collect()
    assert [r["compound"] for r in found] == ["SOFT"] and found[0][name] is not None


def test_tables_without_runs_have_the_same_priors(spark):
    laps = make_laps(spark, seasons=(2022, 2023), events=2, drivers=("AAA", "BBB"), laps=4)
    found = {n: [sorted(map(str, prior_lookup(rows, history_prior(rows, NAMES), NAMES).select("season", "event", "driver", *NAMES).collect()))
                 for rows in (laps, laps.drop("session"))] for n in NAMES}
    assert all(a == b for a, b in found.values())


def test_features_look_priors_up_where_their_laps_are(spark):
    """neither the wide rows nor the laps of another branch are shuffled again, and the values stay those of earlier events."""
    laps = make_laps(
        spark, lambda r: r | {"driver": None if r["driver"] == "CCC" else r["driver"], "team": None if r["driver"] == "BBB" else r["team"],
                              "compound": None if r["lap_number"] % 3 == 0 else r["compound"], "event_date": None if r["season"] == 2021 else r["event_date"]},
        seasons=(2021, 2022, 2023, 2024), events=2, drivers=("AAA", "BBB", "CCC", "DDD"), laps=9,
    )
    table = build_features(laps)
    names = list(PRIOR_GROUPS)
    before = build_features(laps, split=True)
    found, old = (sorted(map(str, t.select("season", "event", "driver", "lap_number", *[F.round(n, 6).alias(n) for n in names]).collect())) for t in (table, before))
    assert len(found) > 200 and found == old
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = build_features(laps)
        first = table._jdf.queryExecution().executedPlan().toString().splitlines()
        table.collect()
        final = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(i for i, line in enumerate(first) if "Join [_b1" in line and "LeftOuter" in line)
    window = next(i for i, line in enumerate(first) if i > join and "Window" in line)
    assert not any("Exchange" in line for line in first[join:window])
    assert final.count("ReusedExchange") >= 4
