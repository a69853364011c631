"""Queries that compare what a row holds make no join, so no table of theirs is sent to all executors; repeated, unknown and unnumbered events give the SQL's rows."""

import duckdb
import pytest

from trajectree import catalog


@pytest.fixture
def odd_events(spark, tmp_path):
    kinds = ["error", "click", "view", "signup", "purchase", "other", None]
    rows = [(k, f"2024-01-01 00:00:{k % 60:02}", k * 7 % 5, kinds[k * 5 % 7], 1.0) for k in range(60)]
    rows += rows[3:4] * 2 + rows[8:20] + [(None, "2024-01-01 00:00:00", 1, None, 1.0)]
    frame = spark.createDataFrame(rows, "event_id long, at string, user_id long, event_type string, value double")
    frame.selectExpr("event_id", "cast(at as timestamp_ntz) as ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["label_bag_distance", "variable_uses"])
def test_no_join_and_the_rows_of_sql(spark, odd_events, name):
    got = catalog.QUERIES[name](spark, odd_events)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{odd_events}/events.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
