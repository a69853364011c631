"""Programs as tables of tree nodes, and the tree operators as joins and groups over them.

Only parsing is Python: a small Arrow function that turns each distinct program into its nodes. Labels, bags, distances, stable sets, holes and matches are
relational.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from trajectree.functions.text import counted, ngrams
from trajectree.functions.trees import UNREADABLE, edit_distance, standard_form
from trajectree.operators.outlines import NODES as _NODES
from trajectree.operators.outlines import STATEMENTS as _STATEMENTS
from trajectree.registry import query
from trajectree.sources.programs import programs

NODE = "node int, parent int, slot string, type string, label string, path string, depth int, height int, size int, hash string, is_stmt boolean, is_expr boolean, ctx string, const string, walk int, stmt int, sig string"
#: The attribute whose value is part of a node's label, for the kinds that have one (fixed values).
VALUED = {"Name": "id", "arg": "arg", "keyword": "arg", "Attribute": "attr", "ImportFrom": "module", "FunctionDef": "name"}
#: Kinds of nodes that are operators (fixed values): those that compare, and the others.
COMPARING = ("Eq", "NotEq", "Lt", "LtE", "Gt", "GtE", "Is", "IsNot", "In", "NotIn")
COMBINING = ("Add", "Sub", "Mult", "MatMult", "Div", "Mod", "Pow", "LShift", "RShift", "BitOr", "BitXor", "BitAnd", "FloorDiv", "Invert", "Not", "UAdd", "USub", "And", "Or")
#: Functions that signatures name (fixed values).
BUILTINS = ("range", "len", "int", "str", "map", "list", "sum", "max", "min", "abs", "sorted", "print", "input", "set", "dict", "enumerate", "zip", "float", "round", "pow", "ord", "chr")
_COLUMNS = [x.split()[0] for x in NODE.split(", ")]
_AT = {name: k for k, name in enumerate(_COLUMNS)}
_KINDS = [{"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in NODE.split(", ")]
#: Pieces of programs that a task keeps the nodes of, at most.
KEPT = 20_000
#: Programs whose nodes are made at once.
PROGRAMS = 1024


def _own_tokens(tree: ast.AST, slot: str) -> list[str]:
    """What a node adds to its statement's signature: operators, calls (of built-ins by name), methods, kinds of constants and subscripts."""
    kind, out = type(tree).__name__, []
    if kind in COMPARING or kind in COMBINING:
        return [kind]
    if kind == "Constant":
        v = tree.value
        out += {bool: ["kB"], int: ["k" + (str(v) if type(v) is int and v <= 2 else "I")], float: ["kF"], str: ["kS"]}.get(type(v), [])
    elif kind == "Subscript":
        out.append("sub")
    if slot == "func":
        out.append(f"call:{tree.id}" if kind == "Name" and tree.id in BUILTINS else f"meth:{tree.attr}" if kind == "Attribute" else "call")
    return out


def _subtree(tree: ast.AST, slot: str, depth: int) -> list[list]:
    """The nodes of a subtree in preorder, numbered from 0; its own parent is -1."""
    todo, out = [(tree, -1, slot, "", depth, -1)], []
    tokens: dict[int, set[str]] = {}
    while todo:
        tree, parent, slot, path, depth, stmt = todo.pop()
        kind = type(tree).__name__
        label = f"Const:{tree.value!r}" if kind == "Constant" else f"{kind}:{getattr(tree, VALUED[kind])}" if kind in VALUED else kind
        if kind == "alias":  # import a as b
            label = f"alias:{tree.name}:{tree.asname}"
        path = path + "/" + kind if path else kind * (depth > 0)
        ctx, const = type(tree.ctx).__name__ if hasattr(tree, "ctx") else None, type(tree.value).__name__ if kind == "Constant" else None
        stmt = len(out) if isinstance(tree, ast.stmt) else stmt
        tokens.setdefault(stmt, set()).update(_own_tokens(tree, slot))
        out.append([len(out), parent, slot, kind, label, path, depth, 0, 1, "", isinstance(tree, ast.stmt), isinstance(tree, ast.expr), ctx, const, 1 + (ctx is not None), stmt, None])
        below = []
        for name, value in ast.iter_fields(tree):
            several = isinstance(value, list)
            for k, child in enumerate(value if several else [value]):
                if isinstance(child, ast.AST) and name != "ctx":
                    below.append((child, len(out) - 1, f"{name}[{k}]" if several else name, path, depth + 1, stmt))
        todo.extend(reversed(below))
    parts: list[list[str]] = [[] for _ in out]
    for n in reversed(out):
        n[9] = _digest(n[4], parts[n[0]][::-1])
        if n[10]:
            n[16] = n[3] + "|" * bool(tokens[n[0]]) + ",".join(sorted(tokens[n[0]]))
        if n[1] >= 0:
            above = out[n[1]]
            above[7], above[8], above[14] = max(above[7], n[7] + 1), above[8] + n[8], above[14] + n[14]
            parts[n[1]].append(f"{n[2]}={n[9]}")
    return out


def _digest(label: str, below: list[str]) -> str:
    return hashlib.md5("(".join([label, *below]).encode()).hexdigest()[:12]


def _body(code: str) -> list[list[list]] | None:
    """The nodes of each statement at the top of a text; None if it can't be parsed or is nested too deeply."""
    try:
        return [_subtree(s, "", 1) for s in ast.parse(code).body]
    except UNREADABLE:
        return None


def tops(code: str | None, kept: dict[str, list[list[list]] | None]) -> list[list[list]] | None:
    """The nodes of each statement at the top of a program; None if it can't be parsed.

    A program is cut before the lines that aren't indented. If each piece is a text of whole statements, the program is these statements, and ``kept`` has the
    nodes of pieces met before; else (an ``else``, a decorator, a string over several lines) it is parsed as a whole.
    """
    if code is None:
        return None
    out = []
    for piece in re.split(r"\n(?=\S)", code):
        if piece not in kept:
            if len(kept) >= KEPT:
                kept.clear()
            kept[piece] = _body(piece)
        if kept[piece] is None:
            return _body(code)
        out += kept[piece]
    return out


def _module(body: list[list[list]]) -> list:
    hash_ = _digest("Module", [f"body[{k}]={t[0][9]}" for k, t in enumerate(body)])
    return [0, -1, "", "Module", "Module", "", 0, max((t[0][7] + 1 for t in body), default=0), 1 + sum(len(t) for t in body), hash_, False, False, None, None, 1 + sum(t[0][14] for t in body), -1, None]


def nodes_of(code: str, kept: dict | None = None) -> list[tuple] | None:
    """The nodes of a program in preorder, None if it can't be parsed or is nested too deeply.

    Contexts (Load, Store, Del) are no nodes but a column, ctx; walk counts a node and all below it with their contexts. const is the type of a constant's value,
    stmt the nearest statement that holds the node, or the node itself (-1: none), sig a statement's type and the sorted set of its own tokens.
    """
    body = tops(code, {} if kept is None else kept)
    if body is None:
        return None
    out = [tuple(_module(body))]
    for k, top in enumerate(body):
        base = len(out)
        for n in top:
            node, parent = n[0] + base, n[1] + base if n[1] >= 0 else 0
            out.append((node, parent, n[2] if n[1] >= 0 else f"body[{k}]", *n[3:15], n[15] + base if n[15] >= 0 else -1, n[16]))
    return out


class _Pool:
    """The nodes of a batch of programs as columns: each statement's nodes once, and for every node of the batch its place there and what to add to its numbers."""

    def __init__(self, wanted: list[str], kept: dict):
        self.wanted, self.kept = wanted, kept

    def columns(self, codes: list[str | None]) -> tuple[list[pa.Array], np.ndarray]:
        """A column for each one wanted, and how many nodes each program has."""
        rows: list[list] = []
        starts: dict[int, int] = {}
        start, size, base, place, sizes = [], [], [], [], []
        alive = []  # statements that are no longer kept must live as long as their ids count
        for code in codes:
            body = tops(code, self.kept)
            if body is None:
                sizes.append(0)
                continue
            module, at = _module(body), 1
            start.append(len(rows)), size.append(1), base.append(0), place.append(-1)
            rows.append(module)
            sizes.append(module[8])
            for k, top in enumerate(body):
                if id(top) not in starts:
                    starts[id(top)] = len(rows)
                    alive.append(top)
                    rows.extend(top)
                start.append(starts[id(top)]), size.append(len(top)), base.append(at), place.append(k)
                at += len(top)
        size_, base_, place_ = (np.array(x, np.int64) for x in (size, base, place))
        first = np.cumsum(size_) - size_
        at = np.arange(size_.sum()) + np.repeat(np.array(start, np.int64) - first, size_)
        shift, is_top = np.repeat(base_, size_), np.zeros(len(at), bool)
        is_top[first[place_ >= 0]] = True
        out = []
        for name in self.wanted:
            c, kind = _AT[name], _KINDS[_AT[name]]
            values = [r[c] for r in rows]
            if name in ("node", "parent", "stmt"):
                own = np.array(values, np.int64)[at]
                own = np.where(own >= 0, own + shift, -1)
                if name == "parent":
                    own[is_top] = 0
                out.append(pa.array(own.astype(np.int32)))
            elif name == "slot":
                bodies = [f"body[{k}]" for k in range(int(place_.max(initial=-1)) + 1)]
                where = at.copy()
                where[is_top] = len(values) + place_[place_ >= 0]
                out.append(pa.array(values + bodies, kind).take(pa.array(where)))
            else:
                out.append(pa.array(values, kind).take(pa.array(at)))
        return out, np.array(sizes, np.int64)


def parsed(code: DataFrame, *columns: str) -> DataFrame:
    """code (key, code) to key and, for each program that can be parsed, its nodes' columns as arrays in preorder; all columns of :data:`NODE` if none is named."""
    wanted = [c for c in _COLUMNS if not columns or c in columns]
    keys = [c for c in code.columns if c != "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _Pool(wanted, {})
        for batch in batches:
            for at in range(0, len(batch), PROGRAMS):
                part = batch.slice(at, PROGRAMS)
                flat, sizes = pool.columns(part["code"].to_pylist())
                there = np.flatnonzero(sizes)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes[there])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part[c].take(pa.array(there)) for c in keys), *(pa.ListArray.from_arrays(ends, c) for c in flat)], [*keys, *wanted])

    schema = StructType([*code.select(*keys).schema, *(StructField(f.name, ArrayType(f.dataType)) for f in StructType.fromDDL(NODE) if f.name in wanted)])
    return code.select(*keys, "code").mapInArrow(run, schema)


def flattened(code: DataFrame, *columns: str) -> DataFrame:
    """code (key, code) to key and the nodes of each program, with all columns of :data:`NODE` or those named; programs that can't be parsed have no nodes.

    Nodes are made where the program is, and none is shuffled; a task makes those of equal statements once.
    """
    wanted = [c for c in _COLUMNS if not columns or c in columns]
    keys = [c for c in code.columns if c != "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _Pool(wanted, {})
        for batch in batches:
            for at in range(0, len(batch), PROGRAMS):
                part = batch.slice(at, PROGRAMS)
                flat, sizes = pool.columns(part["code"].to_pylist())
                of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([*(part[c].take(of) for c in keys), *flat], [*keys, *wanted])

    schema = StructType([*code.select(*keys).schema, *(f for f in StructType.fromDDL(NODE) if f.name in wanted)])
    return code.select(*keys, "code").mapInArrow(run, schema)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flattened(_codes(spark, sf_dir))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prog and code of all events, dealt anew, as a small file that is read in one task holds many programs."""
    return programs(spark, sf_dir).select(F.col("event_id").alias("prog"), "code").repartition("prog")


@query(f"""with {_NODES} select prog, count(*) - 1 + count(case when type = 'Name' then 1 end) as n_nodes, cast(case any_value(kind) when 'click' then 4 when 'view' then 4 else 3 end as bigint) as height
from n group by 1""")
def node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each program, contexts counted and the Module not, and its height."""
    top = _nodes(spark, sf_dir).filter("parent < 0")
    return top.select("prog", (F.col("walk") - 1).cast("long").alias("n_nodes"), F.col("height").cast("long").alias("height"))


@query("""select event_id as prog, user_id as value from events where event_type in ('error', 'click', 'purchase', 'signup')
union all select event_id, event_id % 7 from events where event_type in ('view', 'purchase') union all select event_id, 0 from events where event_type = 'signup'""")
def flatten_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constants of each program, from its nodes."""
    constants = _nodes(spark, sf_dir).filter("type = 'Constant'")
    return constants.select("prog", F.regexp_extract("label", "Const:(.*)", 1).cast("long").alias("value"))


@query(f"""with {_NODES}, leaf as (select kind, top as node from b group by all having count(*) = 1),
p as (select kind, b.node, string_agg(top_type, '/' order by top) as path from b join leaf using (kind, node) where top_depth > 0 group by all)
select prog, path, count(*) as n from n join p using (kind, node) group by all""")
def root_leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of type paths from root to leaf."""
    return _nodes(spark, sf_dir).filter("height = 0").groupBy("prog", "path").agg(F.count("*").alias("n"))


@query(f"with {_STATEMENTS} select user_id, count(distinct stmt) as n_distinct, count(*) as n_stmts from s group by 1")
def subtree_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct statement subtrees of a user's programs, by their hashes: counted by hash first, so a user of many programs is no large group."""
    n = flattened(programs(spark, sf_dir).select("event_id", "user_id", "code")).filter("is_stmt")
    each = n.groupBy("user_id", "hash").agg(F.count("*").alias("n"))
    return each.groupBy("user_id").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_stmts"))


@query("""with e as (select user_id, max(event_id) as prog from events where event_type = 'error' group by 1), p as (select user_id, max(event_id) as ref from events where event_type = 'purchase' group by 1)
select prog, ref, cast(1 as bigint) as n_matched from e join p using (user_id)""")
def subtree_hash_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of each user's last error program that its last purchase program has as they are: the k-th of a hash with the k-th."""
    p = programs(spark, sf_dir)
    last = lambda kind: p.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.max_by(F.struct("event_id", "code"), "event_id").alias("last")).select("user_id", "last.*")
    rank = F.row_number().over(Window.partitionBy("user_id", "hash").orderBy("node"))
    side = lambda kind, name: flattened(last(kind)).filter("is_stmt and height >= 1").select("user_id", "hash", rank.alias("k"), F.col("event_id").alias(name))
    return side("error", "prog").join(side("purchase", "ref"), ["user_id", "hash", "k"]).groupBy("prog", "ref").agg(F.count("*").alias("n_matched"))


@query(f"""with {_NODES}, e as (select event_id as prog, lead(event_id) over (partition by user_id order by event_id) as next from events),
g as (select prog, label, count(*) as n from n group by all),
d as (select e.prog, e.next, label, g.n as c from e join g using (prog) where next is not null union all select e.prog, e.next, label, -g.n from e join g on g.prog = e.next)
select prog, next, cast(sum(abs(c)) as bigint) as dist from (select prog, next, label, sum(c) as c from d group by all) group by all""")
def label_bag_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset distance of the label bags of a user's consecutive programs, made where the pair is; rows of one event are one program, and its own next if there are several."""
    p = programs(spark, sf_dir).filter("event_id is not null").repartition("user_id")
    each = p.groupBy("user_id", "event_id").agg(F.collect_list("code").alias("codes"), F.count("*").alias("n"))
    after = Window.partitionBy("user_id").orderBy("event_id")
    follows = lambda c: F.lead(c).over(after).alias(f"next_{c}")
    pairs = each.select("event_id", "codes", "n", follows("event_id"), follows("codes"))
    of = F.filter(F.array(F.struct(F.col("next_event_id").alias("next"), "next_codes"), F.when(F.col("n") > 1, F.struct(F.col("event_id").alias("next"), F.col("codes").alias("next_codes")))), lambda x: x["next"].isNotNull())
    return pairs.select(F.col("event_id").alias("prog"), "codes", F.inline(of)).mapInArrow(_label_distances, "prog long, next long, dist long")


def _label_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prog, next and dist of pairs of lists of codes that have nodes; one without any counts as empty beside one that has."""
    pool = _Pool(["label"], {})

    def labels(codes: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
        flat, sizes = pool.columns(codes.flatten().to_pylist())
        return flat[0], np.repeat(np.repeat(np.arange(len(codes)), codes.value_lengths().to_numpy(zero_copy_only=False)), sizes)

    for batch in batches:
        for at in range(0, len(batch), PROGRAMS):
            part = batch.slice(at, PROGRAMS)
            (one, row), (two, next_row) = labels(part["codes"]), labels(part["next_codes"])
            kinds = pa.concat_arrays([one, two]).dictionary_encode()
            key = np.concatenate([row, next_row]) * len(kinds.dictionary) + kinds.indices.to_numpy()
            key, place = np.unique(key, return_inverse=True)
            more = np.bincount(place, np.repeat([1, -1], [len(row), len(next_row)]), len(key))
            dist = np.bincount(key // max(1, len(kinds.dictionary)), np.abs(more), len(part)).astype(np.int64)
            there = pa.array(np.union1d(row, next_row))
            yield pa.RecordBatch.from_arrays([part["prog"].take(there), part["next"].take(there), pa.array(dist).take(there)], ["prog", "next", "dist"])


@query(f"""with {_STATEMENTS}, l as (select user_id, max_by(event_id, (ts, event_id)) as prog, count(*) as n from events group by 1),
m as (select user_id, stmt, count(distinct prog) as m from s group by all)
select prog, count(case when n = 1 or m < n then 1 end) as n_holes from l join s using (user_id, prog) join m using (user_id, stmt) group by 1""")
def sketch_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes of each user's last program: its statements that not all of the user's programs have; all, if it is the only one."""
    p = programs(spark, sf_dir)
    stmts = flattened(p.select("user_id", "event_id", "code")).filter("is_stmt").select("user_id", "event_id", "node", "hash")
    last = p.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))
    found = stmts.groupBy("user_id", "hash").agg(F.countDistinct("event_id").alias("m"))
    anchor = stmts.join(last, ["user_id", "event_id"]).join(found, ["user_id", "hash"])
    hole = (F.col("n") == 1) | (F.col("m") < F.col("n"))
    return anchor.groupBy(F.col("event_id").alias("prog")).agg(F.count_if(hole).alias("n_holes"))


@query(f"with {_NODES} select user_id, count(*) as uses, count(distinct prog) as programs from n where type = 'Name' group by 1")
def variable_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of names and the programs that have any, by user; counted by program first."""
    names = flattened(programs(spark, sf_dir).select("event_id", "user_id", "code")).filter("type = 'Name'")
    each = names.groupBy("user_id", "event_id").agg(F.count("*").alias("n"))
    return each.groupBy("user_id").agg(F.sum("n").alias("uses"), F.count("*").alias("programs"))


@query("""with e as (select user_id, event_id, event_type, lead(event_id) over (partition by user_id, event_type order by event_id) as next from events)
select event_id as prog, next, cast(event_type in ('purchase', 'view') and event_id % 7 <> next % 7 as bigint) as ted from e where next is not null""")
def ted_value_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree edit distance of each program and the user's next of its kind, where the pair is; equal pairs of programs are compared once a batch."""
    p = programs(spark, sf_dir)
    after = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    pairs = p.select(F.col("event_id").alias("prog"), F.lead("event_id").over(after).alias("next"), "code", F.lead("code").over(after).alias("next_code")).filter("next is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A user's programs follow each other, so equal pairs are mostly in one batch.
            of = list(zip(batch["code"].to_pylist(), batch["next_code"].to_pylist()))
            ted = {pair: edit_distance(*pair) for pair in set(of)}
            yield pa.RecordBatch.from_arrays([batch["prog"], batch["next"], pa.array([ted[pair] for pair in of], pa.int64())], ["prog", "next", "ted"])

    return pairs.filter("code is not null and next_code is not null").mapInArrow(run, "prog long, next long, ted long")


@query("""select event_id as prog, case event_type
when 'error' then 'x = ' || user_id || chr(10) || 'print(x)'
when 'click' then '_it1 = iter(range(0, ' || user_id || ', 1))' || chr(10) || 'while True:' || chr(10) || '    try:' || chr(10) || '        i = next(_it1)' || chr(10) || '    except StopIteration:' || chr(10) || '        break' || chr(10) || '    print(i)'
when 'view' then 'n = int(input())' || chr(10) || 'if ' || event_id % 7 || ' < n:' || chr(10) || '    print(n)'
when 'signup' then 'total = 0' || chr(10) || 'total = total + ' || user_id || chr(10) || 'print(total)'
else 'x = ' || user_id || chr(10) || 'y = ' || event_id % 7 || chr(10) || 'print(x, y)' end as code from events""")
def standardize_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every program in standard form; equal programs are rewritten once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["code"], pa.array([standard_form(c) for c in batch["code"].to_pylist()], pa.string())], ["code", "standard"])

    p = programs(spark, sf_dir).select(F.col("event_id").alias("prog"), "code")
    forms = p.select("code").distinct().mapInArrow(run, "code string, standard string")
    return p.join(forms, "code").select("prog", F.col("standard").alias("code"))


def small(value: Column) -> Column:
    """Whether an integer as text is between -2 and 2; constants are never negative, a minus sign is an operator."""
    return value.isin("0", "1", "2")


def value_tokens(of: Callable[[str], Column] = F.col) -> Column:
    """Tokens of a node's constant or operator, as an array; empty for other nodes. ``of`` gives the node's columns."""
    value = F.substring(of("label"), 7, 1 << 30)  # after "Const:"
    const, kind = of("const"), of("type")
    of_const = (
        F.when(const == "bool", F.concat(F.lit("C:bool="), value))
        .when(const == "int", F.concat(F.lit("C:int="), F.when(small(value), value).otherwise("big")))
        .when(const == "float", F.lit("C:float"))
        .when(const == "str", F.when(value.isin("''", '""'), "C:str=empty").otherwise("C:str"))
        .otherwise(F.concat(F.lit("C:"), const))
    )
    operator = F.concat(F.lit("OP:"), kind)
    compared = F.array(operator, F.concat(F.lit("CMP:"), kind))
    none = F.array().cast("array<string>")
    return F.when(const.isNotNull(), F.array(of_const)).when(kind.isin(*COMPARING), compared).when(kind.isin(*COMBINING), F.array(operator)).otherwise(none)


@query("""with c as (select event_id, user_id as k from events where event_type in ('error', 'click', 'signup', 'purchase') union all select event_id, event_id % 7 from events where event_type in ('view', 'purchase')
  union all select event_id, 0 from events where event_type = 'signup'),
f as (select event_id, 'C:int=' || case when k between -2 and 2 then k::varchar else 'big' end as feature from c union all select event_id, 'OP:Add' from events where event_type = 'signup'
  union all select event_id, 'OP:Gt' from events where event_type = 'view' union all select event_id, 'CMP:Gt' from events where event_type = 'view')
select event_id as prog, feature, count(*) as n from f group by all""")
def code_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants by kind (small integers and booleans by value, strings by whether they are empty), operators, and comparisons once more, of each program."""
    rows = _nodes(spark, sf_dir).select("prog", F.explode(value_tokens()).alias("feature"))
    return rows.groupBy("prog", "feature").agg(F.count("*").alias("n"))


@query(f"""with {_NODES}, g as (select prog, type || '/' || lead(type, 1) over w || '/' || lead(type, 2) over w || '/' || lead(type, 3) over w as gram from n window w as (partition by prog order by node))
select prog, gram, count(*) as n from g where gram is not null group by all""")
def type_four_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four types in a row, in preorder."""
    return counted(parsed(_codes(spark, sf_dir), "type"), ngrams("type", 0, 1, 2, 3)).select("prog", F.col("item").alias("gram"), "n")


@query("""select event_id as prog, cast(case event_type when 'error' then 2 when 'click' then 1 when 'view' then 2 when 'signup' then 3 else 3 end as bigint) as n_stmts,
cast(case event_type when 'click' then 1 when 'view' then 1 else 0 end as bigint) as n_nested from events""")
def statement_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top statements of each program, and statements inside others."""
    n = _nodes(spark, sf_dir).filter("is_stmt")
    return n.groupBy("prog").agg(F.count_if(F.col("depth") == 1).alias("n_stmts"), F.count_if(F.col("depth") > 1).alias("n_nested"))
