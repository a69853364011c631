"""Rows of an upsert are dealt to as many tasks as their number asks for."""

from trajectree.operators import sets

FOLDER = "/root/testdata/sf0.001"


def test_tasks_follow_the_rows(spark, monkeypatch):
    want = sorted(map(tuple, sets.upsert_latest(spark, FOLDER).collect()))
    monkeypatch.setattr(sets, "TASK_ROWS", 500)
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    found = sets.upsert_latest(spark, FOLDER)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and f", {rows // 500 + 1})" in plan
    assert sorted(map(tuple, found.collect())) == want
