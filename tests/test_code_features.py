"""Features of programs of a varied grammar against reading each tree from the top, a test for each kind of token, and node columns against the parser's own."""

from __future__ import annotations

import ast
from collections import Counter

import pytest

from tests.programs import program
from trajectree.operators.code_features import BUILTINS, feature_bags, signatures
from trajectree.operators.trees import flattened, nodes_of


def below(node):
    return [c for c in ast.iter_child_nodes(node) if not isinstance(c, ast.expr_context)]


def number(value, other):
    return str(value) if abs(value) <= 2 else other


def signature(stmt):
    found, todo = set(), [stmt]
    while todo:
        node = todo.pop()
        todo += [c for c in below(node) if not isinstance(c, ast.stmt)]
        match node:
            case ast.operator() | ast.unaryop() | ast.boolop() | ast.cmpop():
                found.add(type(node).__name__)
            case ast.Call(func=ast.Name(id=name)):
                found.add(f"call:{name}" if name in BUILTINS else "call")
            case ast.Call(func=ast.Attribute(attr=name)):
                found.add(f"meth:{name}")
            case ast.Call():
                found.add("call")
            case ast.Subscript():
                found.add("sub")
            case ast.Constant(value=value) if isinstance(value, (bool, int, float, str)):
                found.add("k" + ("B" if isinstance(value, bool) else number(value, "I") if isinstance(value, int) else "F" if isinstance(value, float) else "S"))
    return type(stmt).__name__ + "|" * bool(found) + ",".join(sorted(found))


def preorder(node):
    return [node, *(x for c in below(node) for x in preorder(c))]


def plain(code):
    nodes = preorder(ast.parse(code))
    stmts, kinds, out = [signature(n) for n in nodes if isinstance(n, ast.stmt)], [type(n).__name__ for n in nodes], Counter()
    for mark, stream, ahead, n in (("E2:", stmts, (0, 1), 1), ("E3:", stmts, (0, 1, 2), 1), ("Es1b:", stmts, (0, 2), 1), ("EU:", stmts, (0,), 2), ("F4:", kinds, (0, 1, 2, 3), 1)):
        for i in range(len(stream) - ahead[-1]):
            out[mark + "/".join(stream[i + k] for k in ahead)] += n
    for node in nodes:
        if isinstance(node, (ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
            out["OP:" + type(node).__name__] += 1
            out["CMP:" + type(node).__name__] += isinstance(node, ast.cmpop)
        elif isinstance(node, ast.Constant):
            v = node.value
            said = {bool: f"bool={v}", float: "float", str: "str" + "=empty" * (v == "")}.get(type(v)) or (f"int={number(v, 'big')}" if type(v) is int else type(v).__name__)
            out["C:" + said] += 1
    return +out


def test_features_of_varied_programs(spark):
    codes = {k: program(k, depth=k % 4) for k in range(150)}
    codes |= {900: "def f(x):\n    @g\n    def h(y=1):\n        return x[0](y)\n    return 'a'.join(h(2))", 901: "", 902: "x = b'' + 1j\n...", 903: "f()()\n1()\na[0]()", 904: "lambda: 3 < 4 <= 5 is not None", 905: "match x:\n    case 1:\n        pass"}
    nodes = flattened(spark.createDataFrame(list(codes.items()), "prog long, code string"))
    got, n = {}, 0
    for r in feature_bags(nodes).collect():
        got.setdefault(r["prog"], {})[r["feature"]] = r["n"]
    for k, code in codes.items():
        try:
            want = plain(code)
        except SyntaxError:
            assert k not in got
            continue
        n += 1
        assert got.get(k, {}) == dict(want), code
    assert n > 100


@pytest.mark.parametrize(
    "code, sig",
    [
        ("x = -1", "Assign|USub,k1"), ("x = 7 + 2", "Assign|Add,k2,kI"), ("f(1.5, '', True, None)", "Expr|call,kB,kF,kS"), ("print(xs.pop(), len(a[0]))", "Expr|call:len,call:print,k0,meth:pop,sub"),
        ("if a < b and not c:\n    x = 9", "If|And,Lt,Not"), ("for i in range(3):\n    y += i", "For|call:range,kI"), ("del x[1]", "Delete|k1,sub"), ("import os", "Import"),
    ],
)
def test_signature_of_each_kind(spark, code, sig):
    assert signature(ast.parse(code).body[0]) == sig
    assert signatures(flattened(spark.createDataFrame([(1, code)], "prog long, code string"))).filter("node = 1").first()["sig"] == sig


@pytest.mark.parametrize("code", ["a, b = b, a", "for i, j in z:\n    pass", "with f() as g:\n    pass", "del x, y[0]", "x = 1\nprint(x)", "[a.b for a in c]"])
def test_contexts_and_counts(code):
    tree = ast.parse(code)
    rows = nodes_of(code)
    assert [(r[4], r[12]) for r in rows if r[3] == "Name"] == [(f"Name:{n.id}", type(n.ctx).__name__) for n in preorder(tree) if isinstance(n, ast.Name)]
    assert rows[0][14] == sum(1 for _ in ast.walk(tree)) and [r[11] for r in rows] == [isinstance(n, ast.expr) for n in preorder(tree)]
    top = [n for n in preorder(tree)]
    assert [r[15] for r in rows] == [next((i for i in range(k, -1, -1) if isinstance(top[i], ast.stmt) and top[k] in preorder(top[i])), -1) for k in range(len(rows))] or any(isinstance(n, (ast.operator, ast.cmpop)) for n in top)
