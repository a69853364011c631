"""Owners' histories as texts: what all programs have against the rows of nodes, and plans that shuffle no nodes."""

from __future__ import annotations

import pytest

from tests.programs import edited, program
from trajectree import catalog
from trajectree.operators.matching import fixed_hashes, frozen
from trajectree.operators.trees import flattened, nodes_of


def test_fixed_hashes_are_frozen(spark):
    rows, prog = [], 0
    for owner in range(30):
        code = program(owner, depth=owner % 3)
        for seq in range(1, 6):
            rows.append((prog, owner, seq, code))
            prog, code = prog + 1, edited(code, prog) if seq % 2 else code
    readable = [(p, o, s, c) for p, o, s, c in rows if nodes_of(c) is not None]
    first, history, place = {}, [], {}
    for p, o, _, c in readable:
        place[o] = place.get(o, 0) + 1
        history.append((p, o, place[o], c, first.setdefault(o, c)))
    nodes = flattened(spark.createDataFrame(rows, "prog long, owner long, ts long, code string"))
    want = {(r["prog"], r["hash"]) for r in frozen(nodes).join(nodes, ["prog", "node"]).select("prog", "hash").collect()}
    got = {(r["prog"], h) for r in fixed_hashes(spark.createDataFrame(history, "prog long, owner long, seq int, code string, first_code string")).collect() for h in r["fixed"]}
    later = {p for p, _, s, _, _ in history if s > 1}
    assert got == {(p, h) for p, h in want if p in later} and len(got) > 50


@pytest.mark.parametrize("name, most", [("tree_match", 4), ("first_variable_map", 4), ("statement_candidates", 4), ("sketch_rows", 11), ("edit_coverage", 16), ("statement_signatures", 3), ("program_features", 3)])
def test_only_texts_are_shuffled(spark, name, most):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    ready = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and ready.count("Exchange hashpartitioning") <= most
