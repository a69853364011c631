"""Programs cut into statements that are parsed once, and runs counted inside a row."""

from __future__ import annotations

import ast
from collections import Counter

import pytest

from tests.programs import program
from trajectree.functions.text import counted, ngrams
from trajectree.operators import trees
from trajectree.operators.trees import flattened, nodes_of, parsed

CODES = [
    "if a:\n    b\nelse:\n    c", "@f\ndef g():\n    pass", "s = '''\nx = 1\n'''\ny", "x = (1,\n2)", "x = 1; y = 2\nz", "# a\nx\n# b", "if a:\n    x\n# c\n    y", "x = 1 \\\n+ 2", "x = 1\n+ 2",
    "try:\n    a\nexcept E:\n    b\nfinally:\n    c", "", "\n\nx", "x\r\ny\rz", " x", "x\n y", "class A:\n    def f(self):\n        return 1\n\n\nA()", "match x:\n    case 1:\n        pass\ncase = 3", "x = 1 \\\n\ny",
]


@pytest.mark.parametrize("code", CODES + [program(k, depth=k % 4) for k in range(60)])
def test_pieces_are_the_whole(code):
    kept = {}
    for _ in range(2):  # the second time, pieces are known
        rows = nodes_of(code, kept)
        try:
            tops = [trees._subtree(s, "", 1) for s in ast.parse(code).body]
        except SyntaxError:
            assert rows is None
            continue
        want = [trees._module(tops)[3:]]
        begins = []
        for top in tops:
            begins.append(len(want))
            want += [n[3:15] + n[16:] for n in top]
        assert [list(r[3:15] + r[16:]) if r[0] else list(r[3:]) for r in rows] == want
        assert [r[0] for r in rows] == list(range(len(rows))) and [r[0] for r in rows if r[1] == 0] == begins and all(r[1] < r[0] for r in rows)


def test_statements_are_parsed_once(monkeypatch):
    calls = []
    monkeypatch.setattr(trees, "_body", lambda code, real=trees._body: calls.append(code) or real(code))
    kept = {}
    for k in range(100):
        nodes_of("x = 1\nprint(x)" if k % 2 else "print(x)\nx = 1", kept)
    assert len(calls) == 2


def test_nodes_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(trees, "KEPT", 3)
    monkeypatch.setattr(trees, "PROGRAMS", 4)
    codes = dict(enumerate([*CODES, None, *(program(k, depth=2) for k in range(30))]))
    frame = spark.createDataFrame(list(codes.items()), "prog long, code string")
    want = {k: nodes_of(code) for k, code in codes.items() if code is not None and nodes_of(code)}
    got = {}
    for r in flattened(frame).orderBy("prog", "node").collect():
        got.setdefault(r["prog"], []).append(tuple(r)[1:])
    assert got == want
    assert {r["prog"]: (r["slot"], r["parent"]) for r in parsed(frame, "parent", "slot").collect()} == {k: ([n[2] for n in rows], [n[1] for n in rows]) for k, rows in want.items()}
    assert not any("Exchange" in line for line in flattened(frame)._jdf.queryExecution().executedPlan().toString().split("\n"))


def test_runs_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, list("abab")), (2, []), (3, None), (4, ["a", None, "a"]), (5, ["x"])], "k long, a array<string>")
    found = counted(rows, rows["a"])
    got = Counter({(r["k"], r["item"]): r["n"] for r in found.collect()})
    assert got == {(1, "a"): 2, (1, "b"): 2, (4, "a"): 2, (4, None): 1, (5, "x"): 1}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in rows.orderBy("k").select(ngrams("a", 0, 2, mark="S:")).collect()] == [["S:a/a", "S:b/b"], [], [], ["S:a/a"], []]
