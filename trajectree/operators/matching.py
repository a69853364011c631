"""One-to-one matches between the nodes of two programs, for many pairs of programs at once.

Four phases, node by node, in the task that holds the pair (:func:`match_nodes`); what has matched stays so:

1. Equal subtrees, tallest first, never lone leaves: the first free one takes the first free one of the other program, with all below it.
2. Leaves of equal labels, first with first.
3. Inner nodes from low to high: matched children vote for the ancestors of their matches of the node's type; most votes win, names in ``func`` and ``target``
   slots must not contradict.
4. Nodes whose parents match take the child of the same slot.

Spark makes the pairs from the owners' histories and deals them; their texts are shuffled, not their nodes, and a task parses what programs share once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from trajectree.operators.outlines import ORDER_MATCHES, ORDER_NODES
from trajectree.operators.trees import PROGRAMS, nodes_of, parsed, tops
from trajectree.registry import query
from trajectree.sources.order_programs import order_programs

#: What names of holes begin with (fixed value).
HOLE = "__HOLE_"
#: Kinds of nodes in order programs that are neither statements nor expressions (fixed values).
_PARTS = "'Module', 'alias', 'arguments', 'arg', 'withitem', 'Add', 'Mod', 'Eq', 'Or', 'Not', 'Is', 'Gt'"
#: Slots that hold what a node is named by (fixed values).
NAMING = r"^(func|target|targets.*)$"


#: The columns of a node that matching reads.
READ = ("node", "parent", "slot", "type", "label", "path", "depth", "height", "size", "hash")


def _first_free(kinds: dict[str, list[int]], key: str, taken: list[int]) -> int:
    """The first node of a kind that isn't taken, -1 if there is none; those passed are dropped."""
    left = kinds.get(key, [])
    while left and taken[left[-1]] >= 0:
        left.pop()
    return left[-1] if left else -1


def match_nodes(a: list[tuple], b: list[tuple]) -> list[tuple[int, int, int]]:
    """node, ref_node and phase of the nodes that match; a and b: nodes in preorder whose first columns are those of :data:`READ`."""
    found, taken, phases = [-1] * len(a), [-1] * len(b), [0] * len(a)

    def take(i: int, j: int, phase: int, size: int = 1) -> None:
        found[i : i + size], taken[j : j + size], phases[i : i + size] = range(j, j + size), range(i, i + size), [phase] * size

    equal: dict[str, list[int]] = {}
    leaves: dict[str, list[int]] = {}
    for n in reversed(b):
        (equal if n[7] else leaves).setdefault(n[9] if n[7] else n[4], []).append(n[0])
    low_first = sorted((n[0] for n in a if n[7]), key=lambda i: a[i][7])
    for i in sorted(low_first, key=lambda i: (-a[i][7], i)):
        if found[i] < 0 and (j := _first_free(equal, a[i][9], taken)) >= 0:
            take(i, j, 1, a[i][8])
    for n in a:
        if found[n[0]] < 0 and not n[7] and (j := _first_free(leaves, n[4], taken)) >= 0:
            take(n[0], j, 2)
    kids: dict[int, list[int]] = {}
    for n in a:
        kids.setdefault(n[1], []).append(n[0])
    names = [_named(nodes) for nodes in (a, b)]
    for i in low_first:
        if found[i] >= 0:
            continue
        votes: dict[int, list[int]] = {}
        for c in kids[i]:
            j, away = (b[found[c]][1], 0) if found[c] >= 0 else (-1, 0)
            while j >= 0:
                if taken[j] < 0 and b[j][3] == a[i][3]:
                    votes.setdefault(j, []).append(away)
                j, away = b[j][1], away + 1
        mine = names[0].get(i, set())
        shared = {j: bool(mine & names[1].get(j, set())) for j in votes}
        fits = [j for j in votes if not mine or not names[1].get(j) or shared[j]]
        if fits:
            take(i, min(fits, key=lambda j: (bool(mine) and not shared[j], -len(votes[j]), votes[j][0])), 3)
    slots = {(n[1], n[2]): n[0] for n in b}
    for n in a[1:]:
        j = slots.get((found[n[1]], n[2]), -1) if found[n[0]] < 0 <= found[n[1]] else -1
        if j >= 0 and taken[j] < 0:
            take(n[0], j, 4)
    return [(i, j, phases[i]) for i, j in enumerate(found) if j >= 0]


def _named(nodes: list[tuple]) -> dict[int, set[str]]:
    """The labels of each node's naming children."""
    out: dict[int, set[str]] = {}
    for n in nodes:
        if n[2].startswith(("func", "target")) and re.match(NAMING, n[2]):
            out.setdefault(n[1], set()).add(n[4])
    return out


def with_trees(rows: DataFrame, one: str, two: str, fields: str, of: Callable[[list[tuple], list[tuple]], tuple]) -> DataFrame:
    """rows without the programs of columns one and two, and fields: what ``of`` makes of the nodes of both programs, which must be such as can be parsed."""
    keys, added = [c for c in rows.columns if c not in (one, two)], StructType.fromDDL(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        kinds = [to_arrow_type(f.dataType) for f in added]
        for batch in (whole.slice(at, PROGRAMS) for whole in batches for at in range(0, len(whole), PROGRAMS)):
            trees: dict[str, list[tuple]] = {}
            texts = list(zip(batch[one].to_pylist(), batch[two].to_pylist()))
            for text in chain.from_iterable(texts):
                if text not in trees:
                    trees[text] = nodes_of(text, kept)
            found = list(zip(*(of(trees[x], trees[y]) for x, y in texts))) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keys), *(pa.array(c, k) for c, k in zip(found, kinds))], [*keys, *added.names])

    return rows.mapInArrow(run, StructType([*rows.select(*keys).schema, *added]))


def matched(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, node, ref_node and phase (1 to 4) of all nodes that match, for each of pairs (pair, prog, ref) of programs in nodes."""
    trees = nodes.groupBy("prog").agg(F.array_sort(F.collect_list(F.struct(*READ))).alias("tree"))
    side = lambda key, name: trees.select(F.col("prog").alias(key), F.col("tree").alias(name))
    rows = pairs.join(side("prog", "one"), "prog").join(side("ref", "two"), "ref").select("pair", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [[[tuple(n.values()) for n in tree] for tree in batch[c].to_pylist()] for c in ("one", "two")]
            pair, of = batch["pair"], list(map(match_nodes, *both))
            flat = list(zip(*(r for rows_ in of for r in rows_))) or [[]] * 3
            at = pa.array([k for k, rows_ in enumerate(of) for _ in rows_], pa.int32())
            yield pa.RecordBatch.from_arrays([pair.take(at), *(pa.array(c, pa.int32()) for c in flat)], ["pair", "node", "ref_node", "phase"])

    return rows.mapInArrow(run, StructType([pairs.schema["pair"], *StructType.fromDDL("node int, ref_node int, phase int")]))


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prog, owner, seq (its place among the owner's programs that can be parsed, from 1), code, the owner's first_code, and ref and ref_code, the next; texts are shuffled, no nodes."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            yield batch.filter(pa.array([tops(code, kept) is not None for code in batch["code"].to_pylist()], pa.bool_()))

    programs = order_programs(spark, sf_dir).select("prog", "owner", "ts", "code")
    readable = programs.mapInArrow(parse, programs.schema)
    order = Window.partitionBy("owner").orderBy("ts", "prog")
    return readable.select("prog", "owner", F.row_number().over(order).alias("seq"), "code", F.first("code").over(order).alias("first_code"), F.lead("prog").over(order).alias("ref"), F.lead("code").over(order).alias("ref_code"))


def consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prog and ref, and their code and ref_code, of each customer's consecutive programs that can be parsed."""
    return histories(spark, sf_dir).filter("ref is not null").select("prog", "ref", "code", "ref_code")


@query(ORDER_MATCHES + "select prog, ref, node, ref_node from matches")
def tree_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which node of each program is which of the customer's next one."""

    def of(a: list[tuple], b: list[tuple]) -> tuple:
        found = match_nodes(a, b)
        return [i for i, _, _ in found], [j for _, j, _ in found]

    found = with_trees(consecutive(spark, sf_dir), "code", "ref_code", "node array<int>, ref_node array<int>", of)
    return found.select("prog", "ref", F.inline(F.arrays_zip("node", "ref_node")))


def variable_map(nodes: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pair, ref_name and name: each variable of the second program with the variable of the first that its first match, in preorder, has."""
    names = nodes.filter("type = 'Name'").select("prog", "node", F.substring("label", 6, 1 << 30).alias("name"))  # after "Name:"
    side = lambda k, name: pairs.select("pair", F.col(k).alias("prog")).join(names, "prog").select("pair", F.col("node").alias(name), F.col("name").alias(f"{name}_name"))
    met = found.join(side("prog", "node"), ["pair", "node"]).join(side("ref", "ref_node"), ["pair", "ref_node"])
    return met.groupBy("pair", F.col("ref_node_name").alias("ref_name")).agg(F.min_by("node_name", "node").alias("name"))


@query(ORDER_MATCHES + """select matches.prog, matches.ref, substring(v.label, 6) as ref_name, arg_min(substring(a.label, 6), a.node) as name from matches
join on_ a on a.prog = matches.prog and a.node = matches.node and a.type = 'Name' join on_ v on v.prog = matches.ref and v.node = ref_node and v.type = 'Name' group by all""")
def first_variable_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which variable of each program is which of the customer's next one, by the first match."""

    def of(a: list[tuple], b: list[tuple]) -> tuple:
        names: dict[str, str] = {}
        for i, j, _ in match_nodes(a, b):  # in preorder, so the first match stays
            if a[i][3] == b[j][3] == "Name":
                names.setdefault(b[j][4][5:], a[i][4][5:])  # after "Name:"
        return list(names), list(names.values())

    found = with_trees(consecutive(spark, sf_dir), "code", "ref_code", "ref_name array<string>, name array<string>", of)
    return found.select("prog", "ref", F.inline(F.arrays_zip("ref_name", "name")))


def edit_operations(nodes: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pair, op and node: matched nodes of unlike labels are replaced, free nodes of the first program deleted, those of the second inserted (node is theirs then)."""
    side = lambda k, name: pairs.select("pair", F.col(k).alias("prog")).join(nodes.select("prog", "node", "label"), "prog").select("pair", F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    both = side("prog", "node").join(found.select("pair", "node", "ref_node"), ["pair", "node"], "left").join(side("ref", "ref_node"), ["pair", "ref_node"], "full")
    op = F.when(F.col("node").isNull(), "insert").when(F.col("ref_node").isNull(), "delete").when(F.col("node_label") != F.col("ref_node_label"), "replace")
    return both.select("pair", op.alias("op"), F.coalesce("node", "ref_node").alias("node")).filter("op is not null")


def frozen(nodes: DataFrame) -> DataFrame:
    """prog and node of the statements and expressions that all programs of the owner up to this one have."""
    seq = nodes.filter("parent < 0").select("prog", "owner", F.row_number().over(Window.partitionBy("owner").orderBy("ts", "prog")).alias("seq"))
    seen = nodes.filter("is_stmt or is_expr").join(seq.drop("owner"), "prog").select("owner", "hash", "seq", "prog").distinct()
    # In the first n programs without a gap: the n-th program to have it is the owner's n-th.
    always = seen.withColumn("k", F.row_number().over(Window.partitionBy("owner", "hash").orderBy("seq"))).filter("k = seq").select("prog", "hash")
    return nodes.filter("is_stmt or is_expr").join(always, ["prog", "hash"]).select("prog", "node")


def fixed_hashes(history: DataFrame) -> DataFrame:
    """prog and fixed, the hashes of statements and expressions that all of the owner's programs up to this one have; only for programs after the first that have any.

    What all have, the first has: only hashes that a program shares with the first become rows, and the first itself none.
    """

    def of(a: list[tuple], first: list[tuple]) -> tuple:
        return (sorted({n[9] for n in a if n[10] or n[11]} & {n[9] for n in first if n[10] or n[11]}),)

    shared = with_trees(history.filter("seq > 1").select("prog", "owner", "seq", "code", "first_code"), "code", "first_code", "common array<string>", of)
    seen = shared.select("owner", F.explode("common").alias("hash"), "seq", "prog")
    # In the first n programs without a gap: the n-th program to have it is the owner's n-th.
    always = seen.withColumn("k", F.row_number().over(Window.partitionBy("owner", "hash").orderBy("seq"))).filter("k = seq - 1")
    return always.groupBy("prog").agg(F.collect_list("hash").alias("fixed"))


def holes(nodes: DataFrame) -> DataFrame:
    """prog, node and hole of the statements at the top of each program that not all of the owner's programs up to it have, named in preorder; all, if it is the first."""
    first = nodes.filter("parent < 0").groupBy("owner").agg(F.min_by("prog", F.struct("ts", "prog")).alias("prog")).select("prog", F.lit(True).alias("first"))
    tops = nodes.filter("is_stmt and depth = 1").select("prog", "node").join(first, "prog", "left").join(frozen(nodes).withColumn("fixed", F.lit(True)), ["prog", "node"], "left")
    open_ = tops.filter(F.col("first").isNotNull() | F.col("fixed").isNull())
    return open_.select("prog", "node", F.concat(F.lit(HOLE), F.row_number().over(Window.partitionBy("prog").orderBy("node")) - 1).alias("hole"))


@query(f"""with {ORDER_NODES}, sq as (select prog, owner, row_number() over (partition by owner order by ts, prog) as seq from on_ where node = 0),
se as (select distinct on_.owner, form, seq, prog from on_ join sq using (prog) where type not in ({_PARTS})),
fr as (select prog, form from se qualify row_number() over (partition by owner, form order by seq) = seq)
select prog, node, '__HOLE_' || (row_number() over (partition by prog order by node) - 1) as hole from on_ join sq using (prog) left join fr using (prog, form) where depth = 1 and (seq = 1 or fr.prog is null)""")
def sketch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holes of every program's sketch against the customer's earlier ones."""
    history = histories(spark, sf_dir)
    trees = parsed(history.select("prog", "seq", "code"), "node", "depth", "hash")
    statements = trees.select("prog", "seq", F.filter(F.arrays_zip("node", "depth", "hash"), lambda x: x["depth"] == 1).alias("tops"))
    rows = statements.join(fixed_hashes(history), "prog", "left")
    open_ = F.filter("tops", lambda x: (F.col("seq") == 1) | F.col("fixed").isNull() | ~F.array_contains("fixed", x["hash"]))
    return rows.select("prog", F.posexplode(open_).alias("k", "top")).select("prog", F.col("top.node").alias("node"), F.concat(F.lit(HOLE), "k").alias("hole"))


@query(ORDER_MATCHES + f""", accepted as (select o_orderkey as ref, o_orderstatus = 'F' as accepted from orders),
ops as (select prog, ref, node, 'delete' as op from pr join on_ using (prog) anti join matches using (prog, node) union all select pr.prog, ref, node, 'insert' from pr join on_ on on_.prog = ref
  anti join (select ref, ref_node as node from matches) using (ref, node)
  union all select m.prog, m.ref, m.node, 'replace' from matches m join on_ a on a.prog = m.prog and a.node = m.node join on_ v on v.prog = m.ref and v.node = ref_node where a.label <> v.label),
sq as (select prog, owner, row_number() over (partition by owner order by ts, prog) as seq from on_ where node = 0),
se as (select distinct on_.owner, form, seq, prog from on_ join sq using (prog) where type not in ({_PARTS})),
fr as (select prog, form from se qualify row_number() over (partition by owner, form order by seq) = seq),
fn as (select prog, node from on_ join fr using (prog, form) where type not in ({_PARTS})),
p as (select pr.prog, pr.ref, count(case when op <> 'insert' and fn.node is not null then 1 end) > 0 as uncovered, count(case when op = 'insert' then 1 end) > 0 as inserts,
  count(case when op = 'replace' then 1 end) as n_replace, count(case when op = 'delete' then 1 end) as n_delete, count(case when op = 'insert' then 1 end) as n_insert
  from pr left join ops using (prog, ref) left join fn on fn.prog = ops.prog and fn.node = ops.node and op <> 'insert' group by all)
select uncovered, inserts, accepted as outcome, count(*) as n, cast(sum(n_replace) as bigint) as n_replace, cast(sum(n_delete) as bigint) as n_delete, cast(sum(n_insert) as bigint) as n_insert
from p join accepted using (ref) group by 1, 2, 3""")
def edit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits from each program to the customer's next one: pairs by whether an edit touches what never changed before, whether nodes are inserted, and the outcome."""

    def of(a: list[tuple], b: list[tuple]) -> tuple:
        found = match_nodes(a, b)
        replaced, kept = [i for i, j, _ in found if a[i][4] != b[j][4]], {i for i, _, _ in found}
        deleted = [n[0] for n in a if n[0] not in kept]
        touched = {a[i][9] for i in replaced + deleted if a[i][10] or a[i][11]}
        return sorted(touched), len(replaced), len(deleted), len(b) - len(found)

    history = histories(spark, sf_dir)
    pairs = history.filter("ref is not null").select("prog", "seq", "ref", "code", "ref_code")
    each = with_trees(pairs, "code", "ref_code", "touched array<string>, n_replace long, n_delete long, n_insert long", of).join(fixed_hashes(history), "prog", "left")
    # All statements and expressions of an owner's first program are fixed.
    uncovered = F.when(F.col("seq") == 1, F.size("touched") > 0).otherwise(F.coalesce(F.arrays_overlap("touched", "fixed"), F.lit(False)))
    each = each.select("ref", uncovered.alias("uncovered"), (F.col("n_insert") > 0).alias("inserts"), "n_replace", "n_delete", "n_insert")
    outcome = order_programs(spark, sf_dir).select(F.col("prog").alias("ref"), F.col("accepted").alias("outcome"))
    rows = each.join(outcome, "ref")
    sums = [F.coalesce(F.sum(f"n_{op}"), F.lit(0)).alias(f"n_{op}") for op in ("replace", "delete", "insert")]
    return rows.groupBy("uncovered", "inserts", "outcome").agg(F.count("*").alias("n"), *sums)
