"""From files to files: the catalogue, the dataset build, rows set aside, the store that resumes, and the log of a stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from trajectree.operators import bands
from trajectree.plans import build, loading
from trajectree.sources import catalogue, quarantine, sinks, store, tables
from trajectree.streaming import progress


def put(root, files):
    for name, text in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_catalogue(spark, tmp_path):
    whole = dict.fromkeys(catalogue.REQUIRED, "{}")
    put(tmp_path, {f"p1/{n}": t for n, t in whole.items()} | {"p2/trajectories.jsonl": "x", "p2/tests.jsonl": "x", "q3/tests.jsonl": "x", "p2/.hidden": "x", "loose.txt": "x", "p4/deep/tests.jsonl": "x"})
    listing = catalogue.files(spark, str(tmp_path))
    assert rows(catalogue.problems(listing)) == [("p1",), ("p2",)]
    assert rows(catalogue.missing_files(listing)) == [("p2", "meta.json"), ("p2", "problem.html"), ("q3", "meta.json"), ("q3", "problem.html"), ("q3", "trajectories.jsonl")]
    assert rows(catalogue.whole_problems(listing)) == [("p1",)] and rows(catalogue.marked_ids(listing)) == [("p1",), ("p2",), ("p4",)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        catalogue.files(spark, f"{tmp_path}/none").collect()


def test_both_layouts_and_the_first_folder_with_tests(spark, tmp_path):
    put(tmp_path, {"ABC001/A/in/1.txt": "1", "ABC001/A/in/2.txt": "2", "ABC001/A/out/1.txt": "a", "ABC001/A/out/3.txt": "c", "ABC001/A/4.txt": "flat beside in", "ABC001/A/out/4.txt": "d"})
    put(tmp_path, {"abc001/B/1.txt": "1", "abc001/B/out/1.txt": "a", "abc001/A/1.txt": "x", "abc001/A/out/1.txt": "x", "ABC001/B/in/1.txt": "no output", "ABC001/C/in/.x": "x", "ABC001/C/out/.x": "x"})
    tests = catalogue.test_files(catalogue.files(spark, str(tmp_path)))
    assert rows(tests.select("contest", "letter", "name")) == [("ABC001", "A", "1.txt"), ("abc001", "A", "1.txt"), ("abc001", "B", "1.txt")]
    tasks = spark.createDataFrame([("p1", "ABC001", "A"), ("p2", "ABC001", "B"), ("p3", "ABC001", "C")], "pid string, code string, letter string")
    assert rows(catalogue.first_filled(tasks, tests).select("pid", "contest", "input")) == [("p1", "ABC001", ["ABC001", "A", "in", "1.txt"]), ("p2", "abc001", ["abc001", "B", "1.txt"])]


def test_tasks(spark):
    listed = [("p2", "AtCoder Beginner Contest 7 - B"), ("p1", "AtCoder Beginner Contest 007 - A"), ("p3", "Odd Cup - Q"), ("p4", "Other"), ("p5", "AtCoder Grand Contest 1234 - A")]
    got = catalogue.tasks(spark.createDataFrame(listed, "pid string, title string"), {"Odd Cup": "odd1"})
    assert rows(got.select("pid", "code", "letter")) == [("p1", "ABC007", "A"), ("p2", "ABC007", "B"), ("p3", "odd1", "A"), ("p5", "AGC1234", "A")]
    assert rows(catalogue.tasks(spark.createDataFrame(listed[2:4], "pid string, title string"), {})) == []


HEAD = "submission_id,problem_id,user_id,date,language,original_language,filename_ext,status\n"


def corpus(root):
    listed = [("p1", "AtCoder Beginner Contest 001 - A", "AtCoder"), ("p2", "AtCoder Beginner Contest 001 - B", "AtCoder"), ("p3", "AtCoder Beginner Contest 002 - A", "Other"), ("p4", "AtCoder Beginner Contest 003 - A", "AtCoder")]
    put(root, {"metadata/problem_list.csv": "id,name,dataset,time\n" + "".join(f"{a},{b},{c},1\n" for a, b, c in listed) + "short\n"})
    for pid in ("p1", "p2", "p3", "p4"):
        lines, k = [], 0
        for user, run in {"u1": "WWA", "u2": "WWWAW", "u3": "WA", "u4": "WWA"}.items():
            for v in run:
                k += 1
                lines.append(f"s{k},{pid},{user},{100 if user == 'u1' else k},Python,x,py,{'Accepted' if v == 'A' else 'Wrong Answer'}")
                if (pid, user, k) != ("p1", "u4", 11):
                    put(root, {f"data/{pid}/Python/s{k}.py": b"x = 1\r\n# \xff"})
        lines += ["s98,p1,u9,1,C,x,c,Accepted", "s99,p1,u9,1,Python,x,py,Runtime Error", "broken"]
        put(root, {f"metadata/{pid}.csv": HEAD + "\n".join(lines) + "\n", f"bench/{pid}/x": "x"} if pid != "p4" else {f"metadata/{pid}.csv": HEAD})
    put(root, {"test_cases/ABC001/A/in/b": "2\r\n", "test_cases/ABC001/A/in/a": "1", "test_cases/ABC001/A/out/a": "one", "test_cases/ABC001/A/out/b": "two", "test_cases/abc001/B/a": "1", "test_cases/abc001/B/out/a": "é"})
    put(root, {"problem_descriptions/p1.html": "<p>one</p>\n"})


def test_dataset_from_files_to_files(spark, tmp_path):
    corpus(tmp_path / "in")
    data = build.from_files(spark, str(tmp_path / "in"), "bench", {})
    got = {(r["pid"], r["user_id"]): [(s["sid"], s["verdict"][0], s["code"]) for s in r["submissions"]] for r in data.trajectories.collect()}
    code = "x = 1\n# �"
    # Equal times keep the order of the file; p1 loses the user with a missing source, p3 is of another dataset, p4 has no tests.
    assert got[("p1", "u1")] == [("s1", "W", code), ("s2", "W", code), ("s3", "A", code)] and [s[0] for s in got[("p2", "u2")]] == ["s4", "s5", "s6", "s7"]
    assert set(got) == {("p1", "u1"), ("p1", "u2"), ("p2", "u1"), ("p2", "u2"), ("p2", "u4")}
    assert rows(data.tests) == [("p1", "a", "1", "one"), ("p1", "b", "2\n", "two"), ("p2", "a", "1", "é")]
    assert rows(data.statements) == [("p1", "<p>one</p>\n"), ("p2", "")] and tuple(data.summary.first()) == (2, 5, 17, 2, 3, 3)
    build.write(data, str(tmp_path / "out"))
    back = spark.read.json(f"{tmp_path}/out/trajectories")
    assert sorted((r["pid"], r["user_id"], len(r["submissions"])) for r in back.collect()) == sorted((p, u, len(s)) for (p, u), s in got.items())
    [part] = (tmp_path / "out/tests/pid=p1").glob("part-*")
    assert [json.loads(x) for x in part.read_text().splitlines()] == [{"input": "1", "output": "one"}, {"input": "2\n", "output": "two"}]
    assert rows(spark.read.json(f"{tmp_path}/out/statements").select("pid", "html")) == rows(data.statements)
    assert "| trajectories per problem (min/median/max) | 2 / 3 / 3 |" in "".join(f.read_text() for f in (tmp_path / "out/summary").glob("part-*"))


def test_rows_set_aside(spark, tmp_path):
    line = lambda user, *codes: json.dumps({"problem_id": "p", "user_id": user, "submissions": [{"sid": f"s{k}", "ts": k, "verdict": "Wrong Answer" if k + 1 < len(codes) else "Accepted", "code": c} for k, c in enumerate(codes)]})
    put(tmp_path, {"p1/trajectories.jsonl": "\n".join([line("u1", "x = 1", "x = 2"), "{bad", line("u2", "x =", "x = 2"), line("u3", "x = 1", None), line("u4"), "{}"]), "p2/trajectories.jsonl": "nonsense\n" + line("u5", "ok")})
    good, aside = quarantine.split(quarantine.scanned(spark, str(tmp_path)))
    assert rows(good.select("pid", "user_id")) == [("p1", "u1"), ("p2", "u5")]
    assert rows(quarantine.counts(aside)) == [("p1", "bad_line", 2), ("p1", "missing_source", 1), ("p1", "no_submissions", 1), ("p1", "unparsable", 1), ("p2", "bad_line", 1)]
    assert {r["line"] for r in aside.filter("line is not null").collect()} == {"{bad", "nonsense"}


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    path, kinds, did = f"{tmp_path}/store", "user string, n long, pid string", []
    problems = spark.createDataFrame([(f"p{k}",) for k in range(20)], "pid string")

    def work(part, stop=False):
        pids = [r["pid"] for r in part.collect()]
        did.extend(pids)
        made = part.filter("pid <> 'p7'").select(F.explode(F.array(F.lit("u1"), F.lit("u2"))).alias("user"), F.lit(1).cast("long").alias("n"), "pid")
        if stop and len(did) > 8:
            store.save(made, part.limit(0), path)  # rows are there, but the manifest isn't
            raise RuntimeError("stopped")
        return made

    with pytest.raises(RuntimeError):
        store.run(problems, lambda part: work(part, True), path)
    before, seen = {r["pid"] for r in store.finished(spark, path).collect()}, list(did)
    assert 0 < len(before) < 20 and {r["pid"] for r in store.results(spark, path, kinds).collect()} <= before
    did.clear()
    store.run(problems, work, path)
    assert not before & set(did) and before | set(did) == {f"p{k}" for k in range(20)} and set(seen) - before <= set(did)
    assert rows(store.results(spark, path, kinds)) == sorted((u, 1, f"p{k}") for k in range(20) if k != 7 for u in ("u1", "u2"))
    did.clear()
    store.run(problems, work, path)
    assert did == [] and store.pending(problems, path).count() == 0
    store.run(problems, work, path, reset=True)
    assert len(did) == 20 and store.results(spark, path, kinds).count() == 38


def test_read_through(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.read_through(spark, f"{tmp_path}/pool", make).count() == 3
    assert calls == [1]


def test_progress_of_three_batches(spark, tmp_path):
    ticks, source = iter([2.0, 4.0, 10.0]), tmp_path / "in"
    for status in (["pass", "fail"], ["skip", "pass", "pass"], ["fail"]):
        spark.createDataFrame([(s,) for s in status], "status string").coalesce(1).write.mode("append").parquet(str(source))
        results = spark.readStream.schema("status string").parquet(str(source))
        progress.logged(results, f"{tmp_path}/log", 8, lambda: next(ticks)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in progress.log(spark, f"{tmp_path}/log").orderBy("batch").collect()]
    assert got == [(0, 2, 1, 0, 2.0, 1.0, 6.0), (1, 5, 3, 1, 4.0, 1.25, 2.4), (2, 6, 3, 1, 10.0, 0.6, 2 / 0.6)]


@pytest.mark.parametrize("low, high, piece", [(0.5, 2.0, 4096), (0.25, 1.5, 3), (0.9, 7.0, 1)])
def test_band_join(spark, monkeypatch, low, high, piece):
    monkeypatch.setattr(bands, "ROWS", piece)
    one, two = [(k, "hot" if k % 3 else "t", 1 + k * 7 % 40) for k in range(60)], [(k, "hot" if k % 4 else "t", 1 + k * 5 % 90) for k in range(70)]
    left, right = spark.createDataFrame(one, "a long, kind string, left_size long"), spark.createDataFrame(two, "b long, kind string, right_size long")
    want = sorted((a, b) for a, k, s in one for b, j, t in two if k == j and low * s <= t <= high * s)
    assert rows(bands.band_join(left, right, ["kind"], low, high).select("a", "b")) == want
    assert bands.band_join(left.limit(0), right, ["kind"]).count() == 0


def test_report_is_added_to(spark, tmp_path):
    results = [("p2", "pass", 4.0, 0.5), ("p1", "fail", None, None), ("p1", "pass", 2.0, -0.5), ("p1", "skip", None, None), ("p3", "skip", None, None)]
    df = spark.createDataFrame(results, "pid string, status string, ted double, ip double")
    for _ in range(2):
        sinks.append_report(df, f"{tmp_path}/out")
    want = [
        "p1       RR= 50.0% (1/2) skip=1 | TED=   2.0 IP mean=-0.50", "p2       RR=100.0% (1/1) skip=0 | TED=   4.0 IP mean=+0.50", "p3       RR=  0.0% (0/0) skip=1 | TED=   0.0 IP mean=+0.00",
        "=== OVERALL: micro-RR=66.7% (2/3) macro-RR=50.0% over 3 problems | TED=3.0 IP mean=+0.00 ===",
    ]
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()) == sorted(want * 2)
    assert [f.read_text().splitlines() for f in (tmp_path / "out").glob("part-*")] == [want] * 2
    assert sinks.report(df.limit(0)).count() == 1


def test_problems_as_loaded(spark, tmp_path):
    both = {"trajectories.jsonl": "{}", "tests.jsonl": "{}"}
    for pid, more in {"p1": {"meta.json": '{"time_limit_ms": 5000}', "problem.html": "<h1>A</h1>\n b" + "c" * 2000}, "p2": {"meta.json": "bad"}, "p3": {}, "p4": {"meta.json": '{"time_limit_ms": null}'}}.items():
        put(tmp_path, {f"{pid}/{n}": t for n, t in (both | more).items()})
    put(tmp_path, {"p5/tests.jsonl": "{}"})
    assert rows(loading.problems(spark, str(tmp_path)).select("pid", "seconds")) == [("p1", 5.0), ("p2", 2.0), ("p3", 2.0), ("p4", 2.0)]
    assert rows(loading.problems(spark, str(tmp_path), 3.0, 4.0).select("pid", "seconds")) == [("p1", 4.0), ("p2", 2.0), ("p3", 3.0), ("p4", 2.0)]
    texts = {r["pid"]: r["statement"] for r in loading.problems(spark, str(tmp_path)).collect()}
    assert texts["p1"].startswith("A bccc") and len(texts["p1"]) == 1200 and texts["p3"] == ""


def test_submissions_by_verdict(spark, tmp_path):
    runs = {"u1": [("Wrong Answer", "a"), ("Accepted", "b"), ("Wrong Answer", "c"), ("Accepted", "d")], "u2": [("Wrong Answer", "e")], "u3": [("Accepted", None)]}
    put(tmp_path, {"p/trajectories.jsonl": "\n".join(json.dumps({"problem_id": "p", "user_id": u, "submissions": [{"sid": f"s{k}", "ts": k, "verdict": v, "code": c} for k, (v, c) in enumerate(run)]}) for u, run in runs.items())})
    assert rows(loading.by_verdict(tables.trajectories(spark, str(tmp_path)))) == [("p", "u1", ["a", "c"], "d"), ("p", "u2", ["e"], None), ("p", "u3", [], None)]
