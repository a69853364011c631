"""Goldens derived by hand, properties, and the sources and sinks."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajectree.functions import text
from trajectree.functions.trees import _by_forests, _postorder, edit_distance, standard_form
from trajectree.operators.trees import flattened, nodes_of, ted_value_aware
from trajectree.plans.dataset import build_trajectories
from trajectree.sources import sinks, tables
from trajectree.streaming.first_accept import EVENTS, first_accepts


@pytest.mark.parametrize("a, b, distance", [("x=1", "x=2", 1), ("x=1", "y=2", 2), ("x = a + b", "x = a + b", 0), ("x=", "x=1", None), (None, "x=1", None), ("", "", 0)])
def test_edit_distance(a, b, distance):
    assert edit_distance(a, b) == distance


_EXPRESSIONS = st.recursive(st.sampled_from(["a", "b", "1"]), lambda x: st.tuples(x, x).map(lambda p: f"({p[0]} + {p[1]})"), max_leaves=5)


@settings(max_examples=60, deadline=None)
@given(_EXPRESSIONS, _EXPRESSIONS, _EXPRESSIONS)
def test_edit_distance_is_a_metric(a, b, c):
    assert edit_distance(a, a) == 0 and edit_distance(a, b) == edit_distance(b, a) and edit_distance(a, c) <= edit_distance(a, b) + edit_distance(b, c)


@settings(max_examples=60, deadline=None)
@given(_EXPRESSIONS, _EXPRESSIONS)
def test_trees_of_one_shape_have_the_distance_of_their_forests(a, b):
    pairs = [(a, b), (a, a), (a, a.replace("a", "b")), (f"x = {a}\ny = {b}", f"x = {b}\ny = {a}"), ("f(a, b, c)", "f(b, c, a)")]
    for x, y in pairs:
        assert edit_distance(x, y) == _by_forests(*_postorder(x), *_postorder(y))


def test_long_programs_of_one_shape_need_no_forests():
    long = "x = 1\n" * 3000  # 12,000 nodes: by forests this doesn't end
    assert edit_distance(long, long) == 0 and edit_distance(long + "x = 1", long + "x = 2") == 1


def test_programs_are_compared_where_their_pair_is(spark):
    plan = ted_value_aware(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize(
    "code, form",
    [
        ("a > b", "b < a"),
        ("a >= b > c", "c < b <= a"),
        ("f(a) > b > c", "f(a) > b > c"),
        ("x += 1", "x = x + 1"),
        ("d = dict()", "d = {}"),
        ("s = set()", "s = set()"),
        ("range(3)", "range(0, 3, 1)"),
        ("range(1, 9)", "range(1, 9, 1)"),
        ("while n:\n    n -= 1", "while True:\n    if not n:\n        break\n    n = n - 1"),
        ("while True:\n    pass", "while True:\n    pass"),
        ("for i in range(3):\n    print(i)", "_it1 = iter(range(0, 3, 1))\nwhile True:\n    try:\n        i = next(_it1)\n    except StopIteration:\n        break\n    print(i)"),
        ("for x in [1]:\n    pass\nelse:\n    print(x > 0)", "for x in [1]:\n    pass\nelse:\n    print(0 < x)"),
        ("a =", None),
        ("x = " + "-" * 3000 + "1", None),
    ],
)
def test_standard_form(code, form):
    assert standard_form(code) == form
    if form:
        assert standard_form(form) == form


def test_nodes():
    rows = nodes_of("x = a + b")
    assert [r[3] for r in rows] == ["Module", "Assign", "Name", "BinOp", "Name", "Add", "Name"]
    assert [r[5] for r in rows if r[7] == 0] == ["Assign/Name", "Assign/BinOp/Name", "Assign/BinOp/Add", "Assign/BinOp/Name"]
    assert rows[0][7:9] == (3, 7) and rows[1][10] and nodes_of("x =") is None
    assert nodes_of("y = 1\nx = a + b")[4][9] == rows[1][9]
    whole = lambda code: nodes_of(code)[0][9]
    assert whole("import a as b") != whole("import a as c") != whole("import a") and whole("from m import a as b") == whole("from m import a as b")
    assert [r[4] for r in nodes_of("import a as b, c")[2:]] == ["alias:a:b", "alias:c:None"]
    deep = "x = " + "-" * 3000 + "1"
    assert len(nodes_of(deep)) > 6000 and edit_distance(deep, "x = 1") is None


def test_unparsable_programs_have_no_nodes(spark):
    code = spark.createDataFrame([(1, "x = 1"), (2, "x ="), (3, None), (4, "x = 1")], "prog long, code string")
    assert {r["prog"]: r["count"] for r in flattened(code).groupBy("prog").count().collect()} == {1: 4, 4: 4}


def test_text_functions(spark):
    row = spark.createDataFrame([("<p>a <b>b</b>\n c</p>", " 1  2\n", "from fractions import gcd\nfractions.gcd(1)")], "html string, out string, code string")
    got = row.select(text.plain(F.col("html")), text.normalized_output(F.col("out")), text.normalized_code(F.col("code")), text.normalized_output(F.lit(None).cast("string"))).first()
    assert tuple(got) == ("a b c", "1 2", "from math import gcd\nmath.gcd(1)", "")


def test_trajectories_are_cut_and_whole(spark):
    runs = {"u1": "WWAW", "u2": "WA", "u3": "AW", "u4": "WW", "u5": "WWA", "u6": "WWA"}
    rows = [("p1", u, f"{u}-{k}", k, "Accepted" if v == "A" else "Wrong Answer") for u, run in runs.items() for k, v in enumerate(run)]
    rows += [("p2", "u1", f"z{k}", k, v) for k, v in enumerate(["Wrong Answer", "Wrong Answer", "Accepted"])]
    submissions = spark.createDataFrame(rows, "pid string, user_id string, sid string, ts long, verdict string")
    sources = submissions.filter("sid <> 'u6-0'").select("sid", F.lit("pass").alias("code"))
    got = build_trajectories(submissions, sources).collect()
    assert {(r["pid"], r["user_id"], tuple(s["sid"] for s in r["submissions"])) for r in got} == {("p1", "u1", ("u1-0", "u1-1", "u1-2")), ("p1", "u5", ("u5-0", "u5-1", "u5-2"))}


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "data" / "p1"
    folder.mkdir(parents=True)
    record = {"problem_id": "p1", "user_id": "u", "submissions": [{"sid": "s1", "ts": 1, "verdict": "Wrong Answer", "code": "x"}, {"sid": "s2", "ts": 2, "verdict": "Accepted", "code": "é"}]}
    (folder / "trajectories.jsonl").write_text(json.dumps(record, ensure_ascii=False) + "\n{bad\n")
    (folder / "tests.jsonl").write_text('{"input": "1", "output": "2"}\n{"input": "3", "output": "4"}\n')
    (folder / "meta.json").write_text('{"problem_id": "p1", "time_limit_ms": 1500}')
    (tmp_path / "data" / "p2").mkdir()
    (tmp_path / "data" / "p2" / "meta.json").write_text("not json")
    path = str(tmp_path / "data")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        tables.trajectories(spark, path).collect()
    (folder / "trajectories.jsonl").write_text(json.dumps(record, ensure_ascii=False) + "\n")
    assert [(r["seq"], r["sid"], r["code"]) for r in tables.trajectories(spark, path).orderBy("seq").collect()] == [(0, "s1", "x"), (1, "s2", "é")]
    assert sorted((r["pid"], r["test_id"], r["input"]) for r in tables.tests(spark, path).collect()) == [("p1", 0, "1"), ("p1", 1, "3")]
    assert dict(tables.time_limits(spark, path).collect()) == {"p1": 1.5, "p2": 2.0}
    sinks.write_trajectories(tables.trajectories(spark, path).select(F.col("problem_id").alias("pid"), "user_id", "sid"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").select("pid").first()[0] == "p1"
    old = spark.createDataFrame([("p1", 0.5), ("p2", 0.25)], "pid string, rr double")
    sinks.update_summary(old, spark.createDataFrame([("p2", 1.0)], old.schema), f"{tmp_path}/summary", "pid")
    assert sorted(map(tuple, spark.read.csv(f"{tmp_path}/summary", header=True).collect())) == [("p1", "0.500000"), ("p2", "1.000000")]
    sinks.write_results(old.withColumn("ted", F.lit(None).cast("int")), f"{tmp_path}/results")
    assert spark.read.csv(f"{tmp_path}/results", header=True).columns == ["pid", "rr", "ted"]


def test_stream_keeps_state_between_batches(spark, tmp_path):
    source = tmp_path / "in"
    day = lambda rows: spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr("event_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, event_id) as ts", "user_id", "event_type", "1.0D as value", "'' as props")
    got = []
    for rows in ([(1, 1, "error"), (2, 2, "purchase"), (3, 1, "error")], [(4, 1, "purchase"), (5, 1, "purchase"), (6, 2, "purchase"), (7, 3, "view")]):
        day(rows).write.mode("append").parquet(str(source))
        stream = first_accepts(spark.readStream.schema(EVENTS).parquet(str(source)))
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 4, 2), (2, 2, 0)]


def test_entry_needs_no_subpackage():
    import __spark_entry__

    assert "retrieve_topk" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
