"""Small per-row helpers on syntax trees: an exact edit distance and a standard form."""

from __future__ import annotations

import ast
from collections import Counter

#: What parsing and walking a program may raise: bad code, or code nested too deeply.
UNREADABLE = (SyntaxError, ValueError, RecursionError, MemoryError)
#: Kinds whose value is part of the label in distances (fixed values).
VALUED = {"Name": "id", "Constant": "value", "arg": "arg", "Attribute": "attr"}


def _postorder(code: str) -> tuple[list[str], list[int]]:
    """Labels in postorder, contexts (Load, Store, Del) included, and for each node the place of its leftmost leaf."""
    labels, leftmost = [], []

    def visit(tree: ast.AST) -> int:
        first = -1
        for child in ast.iter_child_nodes(tree):
            left = visit(child)
            first = left if first < 0 else first
        kind = type(tree).__name__
        labels.append(f"{kind}:{getattr(tree, VALUED[kind])!r}" if kind in VALUED else kind)
        leftmost.append(len(labels) - 1 if first < 0 else first)
        return leftmost[-1]

    visit(ast.parse(code))
    return labels, leftmost


def edit_distance(a: str | None, b: str | None) -> int | None:
    """Least inserts, deletes and relabels between two programs' trees (Zhang and Shasha); None if one can't be parsed."""
    if a is None or b is None:
        return None
    try:
        la, fa = _postorder(a)
        lb, fb = (la, fa) if a == b else _postorder(b)
    except UNREADABLE:
        return None
    if fa == fb:
        # Of one shape: relabelling is enough, and needed where the labels themselves differ so often.
        relabels = sum(x != y for x, y in zip(la, lb))
        if relabels <= 1 or relabels == len(la) - (Counter(la) & Counter(lb)).total():
            return relabels
    return _by_forests(la, fa, lb, fb)


def _by_forests(la: list[str], fa: list[int], lb: list[str], fb: list[int]) -> int:
    """The distance of two trees in postorder, by the distances of their forests."""
    last = lambda first: sorted({f: i for i, f in enumerate(first)}.values())
    tree: dict[tuple[int, int], int] = {}
    for i in last(fa):
        for j in last(fb):
            x, y = fa[i], fb[j]
            forest = [[0] * (j - y + 2) for _ in range(i - x + 2)]
            for p in range(1, i - x + 2):
                forest[p][0] = p
            forest[0] = list(range(j - y + 2))
            for p in range(1, i - x + 2):
                for q in range(1, j - y + 2):
                    m, n = x + p - 1, y + q - 1
                    edit = min(forest[p - 1][q], forest[p][q - 1]) + 1
                    if fa[m] == x and fb[n] == y:
                        tree[m, n] = forest[p][q] = min(edit, forest[p - 1][q - 1] + (la[m] != lb[n]))
                    else:
                        forest[p][q] = min(edit, forest[fa[m] - x][fb[n] - y] + tree[m, n])
    return tree[len(la) - 1, len(lb) - 1]


class _Standard(ast.NodeTransformer):
    """Children are put in standard form before the node itself."""

    loops = 0

    def visit_Call(self, node: ast.Call) -> ast.AST:
        self.generic_visit(node)
        name = getattr(node.func, "id", None)
        if name in ("list", "tuple", "dict") and not node.args and not node.keywords:
            return ast.parse({"list": "[]", "tuple": "()", "dict": "{}"}[name], mode="eval").body
        if name == "range" and 1 <= len(node.args) <= 3 and not any(isinstance(x, ast.Starred) for x in node.args):
            bounds = {"start": ast.Constant(0), "step": ast.Constant(1)} | dict(zip(["stop"] if len(node.args) == 1 else ["start", "stop", "step"], node.args))
            bounds |= {k.arg: k.value for k in node.keywords}
            node.args, node.keywords = [bounds["start"], bounds["stop"], bounds["step"]], []
        return node

    def visit_Compare(self, node: ast.Compare) -> ast.AST:
        self.generic_visit(node)
        turned = {ast.Gt: ast.Lt, ast.GtE: ast.LtE}
        operands = [node.left, *node.comparators]
        if all(type(op) in turned for op in node.ops) and (len(node.ops) == 1 or all(isinstance(x, (ast.Name, ast.Constant)) for x in operands)):
            operands.reverse()
            return ast.Compare(operands[0], [turned[type(op)]() for op in reversed(node.ops)], operands[1:])
        return node

    def visit_AugAssign(self, node: ast.AugAssign) -> ast.AST:
        self.generic_visit(node)
        if not isinstance(node.target, ast.Name):
            return node
        return ast.Assign([node.target], ast.BinOp(ast.Name(node.target.id, ast.Load()), node.op, node.value))

    def visit_While(self, node: ast.While) -> ast.AST:
        self.generic_visit(node)
        if node.orelse or isinstance(node.test, ast.Constant) and node.test.value is True:
            return node
        leave = ast.If(ast.UnaryOp(ast.Not(), node.test), [ast.Break()], [])
        return ast.While(ast.Constant(True), [leave, *node.body], [])

    def visit_For(self, node: ast.For) -> ast.AST | list[ast.AST]:
        self.generic_visit(node)
        if node.orelse:  # what follows a loop that ends by itself would be left with the rewritten loop's break
            return node
        self.loops += 1
        name = f"_it{self.loops}"
        call = lambda f, x: ast.Call(ast.Name(f, ast.Load()), [x], [])
        step = ast.Assign([node.target], call("next", ast.Name(name, ast.Load())))
        stop = ast.ExceptHandler(ast.Name("StopIteration", ast.Load()), None, [ast.Break()])
        loop = ast.While(ast.Constant(True), [ast.Try([step], [stop], [], []), *node.body], [])
        return [ast.Assign([ast.Name(name, ast.Store())], call("iter", node.iter)), loop]


def standard_form(code: str | None) -> str | None:
    """A program with ranges, comparisons, updates and loops in one form; loops with an else stay. None if it can't be parsed or is nested too deeply."""
    try:
        return ast.unparse(ast.fix_missing_locations(_Standard().visit(ast.parse(code)))) if code is not None else None
    except UNREADABLE:
        return None
