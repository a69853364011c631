"""Operators leave nothing in the shared folder but what their results read, and no bitmap in their plans."""

import os

from tests.llm.helpers import documents, words
from trajectree.llm import line_dedup, near_copies
from trajectree.llm.common import scratch, shared_folder, stored


def left(spark, before=()):
    folder = shared_folder(spark).removeprefix("file:")
    return {os.path.join(at, name) for at, _, names in os.walk(folder) for name in names if not name.endswith(".crc")} - set(before)


def size(paths):
    return sum(map(os.path.getsize, paths))


def rows():
    lines = [words(12, s, 400) for s in range(150)]
    return [(k, "\n".join(lines[(k + j) % 150] + f" {(k + j) // 150}" for j in range(10))) for k in range(300)] + [(400 + k, words(120, k % 20, 3000)) for k in range(40)]


def test_tables_end_with_their_scratch(spark):
    before = left(spark)
    with scratch(spark):
        inner = stored(spark.range(10))
        with scratch(spark):
            kept, gone = stored(spark.range(3), keep=True), stored(spark.range(4))
            assert gone.count() == 4
        assert kept.count() == 3 and inner.count() == 10
    assert not left(spark, before)


def test_near_copies_leave_their_result_only(spark):
    before = left(spark)
    found = near_copies.near_copies(documents(spark, rows()), 3)
    files = {f.removeprefix("file://") for f in found.inputFiles()}
    assert {f for f in left(spark, before) if not f.endswith("_SUCCESS")} == files
    assert found.count() == 340 and found.select("component_id").distinct().count() < 340


def test_line_dedup_leaves_the_removed_lines_only(spark):
    before, docs = left(spark), documents(spark, rows())
    out = line_dedup.deduplicate(docs)
    # the removed lines by document, and a bitmap of them
    assert len({os.path.dirname(f) for f in left(spark, before)}) == 2
    assert out.count() and len(out._jdf.queryExecution().toString()) < 100_000


def test_rows_of_line_dedup_are_numbered_by_place_and_narrow(spark):
    """What is dealt out for each word of a prefix has no place, and its number tells which line is earlier."""
    docs = documents(spark, [(k, text) for k, text in rows()[::-1]])
    with scratch(spark):
        rank, frequent = line_dedup.ranks(docs)
        firsts = line_dedup._firsts(stored(line_dedup.lines(docs, rank)))
        by_number = [(r["doc"], r["line"]) for r in firsts.orderBy("set").collect()]
        assert by_number == sorted(by_number) and len(set(by_number)) == len(by_number) > 300
        dealt = line_dedup._proposed(firsts, None, line_dedup.TILE, frequent)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in dealt and not {"doc", "line"} & {c.split("#")[0].strip() for c in dealt.split("MapInArrow")[1].split("[", 1)[1].split("\n")[0].split(",")}
