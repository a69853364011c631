"""Variants over one scan, paired by user."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from trajectree.plans import ablations


def test_paired_variants(spark):
    rows = [(f"p{k % 3}", k, k * 5 % 11) for k in range(40)]
    targets = ablations.first_targets(spark.createDataFrame(rows, "pid string, user_id long, x long"), 8, "user_id")
    passed = lambda: (F.col("x") + F.length("ref") + F.when(F.col("repair") == "plain", 3).otherwise(0)) % 4 < 2
    results = ablations.outcomes(targets, passed, lambda: F.col("x"))
    first = [r for p in ("p0", "p1", "p2") for r in [r for r in rows if r[0] == p][:8]]
    options = {v: ablations.DEFAULTS | given for v, given in ablations.VARIANTS.items()}
    ok = {(u, v): (x + len(o["ref"]) + 3 * (o["repair"] == "plain")) % 4 < 2 for _, u, x in first for v, o in options.items()}
    got = {r["variant"]: r for r in ablations.matrix(results).collect()}
    assert set(got) == set(ablations.VARIANTS)
    tags = defaultdict(Counter)
    for v, r in got.items():
        edits = [x for _, u, x in first if ok[u, v]]
        won, lost = (sum(ok[u, v] is w and ok[u, "full"] is not w for _, u, _ in first) for w in (True, False))
        assert (r["n"], r["n_passed"], r["n_won"], r["n_lost"]) == (24, len(edits), won, lost)
        assert r["edit_mean"] == round(sum(edits) / len(edits) if edits else 0, 6) and r["delta"] == round((won - lost) / 24, 6)
        for _, u, _ in first:
            tags[v][{(True, True): "both", (False, False): "neither", (True, False): "only_variant", (False, True): "only_full"}[ok[u, v], ok[u, "full"]]] += 1
    assert {(r["variant"], r["tag"]): r["n"] for r in ablations.tags(results).collect()} == {(v, t): n for v, c in tags.items() if v != "full" for t, n in c.items()}
    assert ablations.matrix(results.limit(0)).collect() == []


def test_the_scan_is_there_once(spark, tmp_path):
    spark.createDataFrame([("p", 1, 2)], "pid string, user_id long, x long").write.parquet(f"{tmp_path}/t")
    results = ablations.outcomes(ablations.first_targets(spark.read.parquet(f"{tmp_path}/t"), 5, "user_id"), lambda: F.col("x") > 1, lambda: F.col("x"))
    plan = ablations.matrix(results)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
