"""Entry points."""

import __spark_entry__ as entry


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(1).count() <= 1
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_some_queries_match_their_sql(spark):
    from checks.compare import check, database

    con = database("/root/testdata/sf0.001")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("next_lap_baseline", "segments", "history_prior_driver_circuit_pace", "track_status_intervals", "compare_providers_coverage", "session_rank"):
        text, good = check(spark, con, "/root/testdata/sf0.001", name, queries[name], sql[name])
        assert good, text
