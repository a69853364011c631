"""Programs of a varied grammar, made from seeds: imports, functions, tuples, with, del, strings, nested loops, and broken code."""

from __future__ import annotations

import random

NAMES = ["a", "b", "n", "total", "xs"]
BROKEN = ["x =", "if :", "def f(:", "for in x:\n    pass", "print('", "\tx = 1\n  y = 2"]


def expression(rng: random.Random, depth: int = 2) -> str:
    below = lambda: expression(rng, depth - 1)
    if depth <= 0 or rng.random() < 0.3:
        return rng.choice([*NAMES, "0", "1", "2", "3", "100", "1.5", "True", "None", "''", "'s'", '"q"'])
    return rng.choice(
        [
            lambda: f"({below()} {rng.choice(['+', '-', '*', '//', '%', '<<', '&'])} {below()})", lambda: f"({below()} {rng.choice(['<', '>', '==', 'is not', 'in'])} {below()})",
            lambda: f"({below()} {rng.choice(['and', 'or'])} {below()})", lambda: f"not {below()}", lambda: f"-{below()}", lambda: f"{rng.choice(['int', 'len', 'f', 'range'])}({below()})",
            lambda: f"{rng.choice(NAMES)}.{rng.choice(['read', 'append'])}({below()})", lambda: f"{rng.choice(NAMES)}[{below()}]", lambda: f"[{below()}, {below()}]",
            lambda: f"({below()} if {below()} else {below()})", lambda: f"[{below()} for i in {below()}]", lambda: f"f(x={below()})",
        ]
    )()


def statement(rng: random.Random, depth: int) -> list[str]:
    inner = lambda: ["    " + line for _ in range(rng.randint(1, 2)) for line in statement(rng, depth - 1)]
    name, value = rng.choice(NAMES), lambda: expression(rng)
    simple = [
        lambda: [f"{name} = {value()}"], lambda: [f"{name}, {rng.choice(NAMES)} = {value()}, {value()}"], lambda: [f"{name} {rng.choice(['+', '-', '*'])}= {value()}"], lambda: [f"print({value()}, {value()})"],
        lambda: [rng.choice(["import math", "import math as m", "from math import gcd", "from math import gcd as g"])], lambda: [f"del {name}[{value()}]"], lambda: ["pass"], lambda: [f"{name}[{value()}] = {value()}"],
    ]
    nested = [
        lambda: [f"if {value()}:", *inner(), "else:", *inner()], lambda: [f"for {name} in {value()}:", *inner()], lambda: [f"while {value()}:", *inner(), "    break"],
        lambda: [f"def {rng.choice('fg')}({name}, y={value()}):", *inner(), f"    return {value()}"], lambda: [f"with open({value()}) as {name}:", *inner()], lambda: [f"for a, b in {value()}:", *inner()],
        lambda: ["try:", *inner(), "except ValueError as e:", *inner()],
    ]
    return rng.choice(simple if depth <= 0 or rng.random() < 0.5 else nested)()


def program(seed: int, statements: int = 4, depth: int = 2) -> str:
    rng = random.Random(seed)
    if rng.random() < 0.05:
        return rng.choice(BROKEN)
    return "\n".join(line for _ in range(rng.randint(1, statements)) for line in statement(rng, depth))


def edited(code: str, seed: int) -> str:
    """A program with some lines of its own dropped, repeated or replaced; it may not parse."""
    rng, lines = random.Random(seed), code.split("\n")
    for _ in range(rng.randint(1, 3)):
        k = rng.randrange(len(lines))
        lines[k : k + 1] = rng.choice([[], [lines[k]] * 2, [lines[k].replace(rng.choice(NAMES), rng.choice(NAMES))], [lines[k].replace("1", "2")]])
        lines = lines or ["pass"]
    return "\n".join(lines)
