"""Tree matching against going through the nodes one by one, on programs of a varied grammar and on trees derived by hand."""

from __future__ import annotations

import ast
from collections import defaultdict

import pytest

from tests.programs import edited, program
from trajectree.operators.matching import edit_operations, frozen, holes, matched, variable_map
from trajectree.operators.trees import flattened

#: Attributes that labels show (fixed values).
SHOWN = {"Name": ["id"], "arg": ["arg"], "keyword": ["arg"], "Attribute": ["attr"], "ImportFrom": ["module"], "FunctionDef": ["name"], "alias": ["name", "asname"]}


class Tree:
    """A program's nodes in preorder, by number."""

    def __init__(self, code):
        self.kind, self.label, self.slot, self.parent, self.kids, self.depth = [], [], [], [], [], []
        self._add(ast.parse(code), "", -1, 0)
        n = len(self.kind)
        self.size = [1] * n
        self.height = [0] * n
        self.form = [None] * n
        for i in reversed(range(n)):
            self.size[i] += sum(self.size[c] for c in self.kids[i])
            self.height[i] = max((1 + self.height[c] for c in self.kids[i]), default=0)
            self.form[i] = (self.label[i], tuple((self.slot[c], self.form[c]) for c in self.kids[i]))

    def _add(self, node, slot, parent, depth):
        me, kind = len(self.kind), type(node).__name__
        self.kind.append(kind)
        self.label.append(f"{kind}:{node.value!r}" if kind == "Constant" else ":".join([kind, *(str(getattr(node, x)) for x in SHOWN.get(kind, []))]))
        self.slot.append(slot)
        self.parent.append(parent)
        self.depth.append(depth)
        self.kids.append([])
        for name, value in ast.iter_fields(node):
            for k, child in enumerate(value) if isinstance(value, list) else [(None, value)]:
                if isinstance(child, ast.AST) and name != "ctx":
                    self.kids[me].append(len(self.kind))
                    self._add(child, name if k is None else f"{name}[{k}]", me, depth + 1)

    def named(self, i):
        return {self.label[c] for c in self.kids[i] if self.slot[c] in ("func", "target") or self.slot[c].startswith("targets")}


def plain(a: Tree, v: Tree):
    found = {}
    free = lambda: [j for j in range(len(v.kind)) if j not in found.values()]
    for i in sorted(range(len(a.kind)), key=lambda i: -a.height[i]):
        if i not in found and a.height[i] >= 1:
            for j in [j for j in free() if v.form[j] == a.form[i]][:1]:
                found |= {i + k: j + k for k in range(a.size[i])}
    for i in range(len(a.kind)):
        if i not in found and not a.kids[i]:
            found |= {i: j for j in [j for j in free() if not v.kids[j] and v.label[j] == a.label[i]][:1]}
    for i in sorted(range(len(a.kind)), key=lambda i: a.height[i]):
        if i in found or not a.kids[i]:
            continue
        votes = defaultdict(list)
        for c in a.kids[i]:
            j, away = (v.parent[found[c]], 0) if c in found else (-1, 0)
            while j >= 0:
                votes[j].append(away)
                j, away = v.parent[j], away + 1
        mine, open_ = a.named(i), set(free())
        ranked = sorted(votes, key=lambda j: (bool(mine) and not mine & v.named(j), -len(votes[j]), votes[j][0]))
        fits = [j for j in ranked if v.kind[j] == a.kind[i] and j in open_ and not (mine and v.named(j) and not mine & v.named(j))]
        if fits:
            found[i] = fits[0]
    for i in range(1, len(a.kind)):
        if i not in found and a.parent[i] in found:
            found |= {i: j for j in [j for j in v.kids[found[a.parent[i]]] if v.slot[j] == a.slot[i] and j in free()][:1]}
    return found


def mapped(spark, programs):
    """programs: pair to two programs."""
    code = [(2 * p + side, text) for p, both in programs.items() for side, text in enumerate(both)]
    nodes = flattened(spark.createDataFrame(code, "prog long, code string"))
    pairs = spark.createDataFrame([(p, 2 * p, 2 * p + 1) for p in programs], "pair long, prog long, ref long")
    out = defaultdict(dict)
    for r in matched(nodes, pairs).collect():
        assert r["node"] not in out[r["pair"]] and 1 <= r["phase"] <= 4
        out[r["pair"]][r["node"]] = r["ref_node"]
    return out


def test_against_going_one_by_one(spark):
    programs = {}
    for k in range(220):
        one = program(k, depth=k % 4)
        programs[k] = (one, edited(one, k + 1000) if k % 3 else program(k + 5000))
    got, n = mapped(spark, programs), 0
    for k, (one, two) in programs.items():
        try:
            a, v = Tree(one), Tree(two)
        except (SyntaxError, ValueError):
            assert got[k] == {}
            continue
        n += 1
        assert got[k] == plain(a, v), (k, one, two)
        assert len(set(got[k].values())) == len(got[k])
    assert n > 150


@pytest.mark.parametrize(
    "one, two, want",
    [
        ("x = f(1)", "y = f(1)", {3: 3, 4: 4, 5: 5}),  # the call is equal; the statements' targets contradict each other
        ("f(g(1))\ng(1)", "g(1)\nf(g(1))", {1: 5, 2: 6, 3: 7, 4: 8, 5: 9, 6: 10, 7: 1, 8: 2, 9: 3, 10: 4, 0: 0}),  # the taller goes first and takes what is in it
        ("g(1)\ng(1)", "g(1)", {1: 1, 2: 2, 3: 3, 4: 4, 0: 0}),  # one of two equal subtrees stays free, and so do its leaves
        ("x = f(1)\nz", "x = f(2)\n3", {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}),  # leaves, their ancestors by votes, the rest by its slots
        ("x", "1", {}),  # nothing is alike, so no parent matches
    ],
)
def test_by_hand(spark, one, two, want):
    got = mapped(spark, {0: (one, two)})[0]
    assert got == plain(Tree(one), Tree(two))
    assert got == want


def test_no_pairs_and_broken_programs(spark):
    assert mapped(spark, {0: ("x =", "x = 1"), 1: ("x = 1", "x ="), 2: ("", "")}) == {2: {0: 0}}
    nodes = flattened(spark.createDataFrame([(1, "x = 1")], "prog long, code string"))
    assert matched(nodes, spark.createDataFrame([], "pair long, prog long, ref long")).collect() == []


def test_edits_and_variables_by_hand(spark):
    both = {0: ("x = f(1)\nprint(x)", "y = f(2)\nprint(y)"), 1: ("a = 1", "a = 1\nb = a"), 2: ("a = b\ndel c", "a = b"), 3: ("n = n", "n = n")}
    nodes = flattened(spark.createDataFrame([(2 * p + k, code) for p, pair in both.items() for k, code in enumerate(pair)], "prog long, code string"))
    pairs = spark.createDataFrame([(p, 2 * p, 2 * p + 1) for p in both], "pair long, prog long, ref long")
    found = matched(nodes, pairs)
    ops = defaultdict(list)
    for r in edit_operations(nodes, pairs, found).orderBy("pair", "op", "node").collect():
        ops[r["pair"]].append((r["op"], r["node"]))
    # 0: the first statements' targets contradict each other, so all but the equal f and what the votes and slots reach is gone and new.
    a, v = Tree(both[0][0]), Tree(both[0][1])
    by_hand = plain(a, v)
    assert set(ops[0]) == {("delete", i) for i in range(len(a.kind)) if i not in by_hand} | {("insert", j) for j in range(len(v.kind)) if j not in by_hand.values()} | {("replace", i) for i, j in by_hand.items() if a.label[i] != v.label[j]}
    assert ops[1] == [("insert", 4), ("insert", 5), ("insert", 6)] and ops[2] == [("delete", 4), ("delete", 5)] and ops[3] == []
    names = {(r["pair"], r["ref_name"]): r["name"] for r in variable_map(nodes, pairs, found).collect()}
    assert names[3, "n"] == "n" and names[2, "a"] == "a" and names[2, "b"] == "b" and names[1, "a"] == "a" and (1, "b") not in names


def test_holes_are_what_changed(spark):
    codes = ["x = 1\ny = 2", "x = 1\ny = 3", "x = 1\nif z:\n    y = 2\ny = 2", "q ="]
    nodes = flattened(spark.createDataFrame([(k, 7, k, code) for k, code in enumerate(codes)] + [(9, 8, 0, "x = 1")], "prog long, owner long, ts long, code string"))
    got = defaultdict(list)
    for r in holes(nodes).orderBy("prog", "node").collect():
        got[r["prog"]].append((r["node"], r["hole"]))
    assert got == {0: [(1, "__HOLE_0"), (4, "__HOLE_1")], 1: [(4, "__HOLE_0")], 2: [(4, "__HOLE_0"), (9, "__HOLE_1")], 9: [(1, "__HOLE_0")]}
    assert {(r["prog"], r["node"]) for r in frozen(nodes).filter("prog = 1").collect()} == {(1, 1), (1, 2), (1, 3), (1, 5)}
