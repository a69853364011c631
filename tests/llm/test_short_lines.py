"""Line dedup over lines of any number of words, against brute force."""

import re

import corpus_pipeline
from tests.llm.helpers import documents, words
from trajectree.llm import line_dedup


def plain(rows):
    seen, out = [], set()
    for doc_id, text in sorted(rows):
        for k, line in enumerate(text.split("\n")):
            tokens = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if tokens:
                if any(len(tokens & t) >= 0.8 * len(tokens | t) - 1e-9 for t in seen):
                    out.add((doc_id, k))
                seen.append(tokens)
    return out


def test_short_lines_are_removed_and_whole_copies_dropped(spark):
    body = words(60, 1)
    rows = [(1, f"Title\n{body}\nthe end\n\nread on here"), (2, f"Title\n{body}\nthe end\n\nread on here"), (3, f"Title\n{words(60, 2)}\na b c d e"), (4, "a b c d\na b c\na b\n \nb a\na b c d x y")]
    rows += [(5, "Title Title\nTITLE\n\tTitle\na b d c"), (6, "Title")]
    docs = documents(spark, rows)
    got = {(r["doc_id"], r["line"]) for r in line_dedup.removed_lines(docs, least_words=1).collect()}
    # Of four tokens within five, the later line goes.
    assert got == plain(rows) and (4, 0) in got and (4, 1) not in got
    out = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(docs, least_words=1).collect()}
    assert set(out) == {1, 3, 4, 5} and out[1] == rows[0][1] and out[3] == f"{words(60, 2)}\na b c d e" and out[5] == "TITLE"
    # In the pipeline, documents that would lose more than half are left to near-dedup as they are.
    staged = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert staged == dict(rows) | {k: out[k] for k in (3, 4)}
    more = [(7, f"{words(40, 4)}\n{words(60, 3)}"), (8, f"{words(40, 4)}\n{words(20, 5)}"), (9, f"{words(40, 4)}\n{words(60, 6)}"), (10, f"{words(9, 7)}\nx"), (11, f"{words(9, 7)}\ny")]
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, documents(spark, more), "").collect()}
    # Of documents 8 and 11 less than half would be left.
    assert kept == dict(more) | {9: words(60, 6)}
