"""Each operator against a plain version, on small tables with odd rows, and on empty ones."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import components, documents, odd_rows, words
from trajectree.llm import chat, embedding_dedup, langid, line_dedup, mixing, packing, quality, simhash, suffix_array, suffix_dedup, token_counts
from trajectree.llm.tokens import default_path, encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(10, 1, 0), (11, 1, 0), (11, 1, 0), (6, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def plain_targets(sizes, epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, target, free = float(sum(sizes.values())), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > epochs * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing_meets_targets(odd):
    got = mixing.mixed_plan(odd.select("doc_id", "source", "text")).join(odd.select("doc_id", "source").distinct(), "doc_id").collect()
    sizes = Counter()
    for r in odd_rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        if r["doc_id"] == 10:  # the join above doubles the repeated row
            continue
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
    for r in mixing.plan(odd.select("doc_id", "source", "text")).select("source", "taken").collect():
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 1 for s in want)


def test_mix_is_a_stream_of_copies(odd, empty):
    out = mixing.mix(odd).collect()
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(empty).count() == 0 and mixing.mixed_plan(empty.select("doc_id", "source", "text")).count() == 0
    text = {r[0]: r[1] or "" for r in odd_rows()}
    assert all(text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(odd).collect()))


def test_mixing_keeps_clashing_columns(odd):
    extra = odd.withColumn("taken", F.lit("x")).withColumn("_size", F.lit(1)).withColumn("target", F.lit(None).cast("string"))
    assert mixing.mix(extra).columns == extra.columns and mixing.mix(extra).count() == mixing.mix(odd).count()


def test_token_trees_follow_edits(spark, odd, empty):
    encode = encoder(default_path())
    edits = lambda t: [(m.start(), m.end(), new) for m, new in zip(re.finditer(r"w\d+x", t), ["", " 7", "\n\n", "a b", "'s"] * 3)]
    got = {r["doc_id"]: r for r in token_counts.edited_counts(odd, edits).collect()}
    for doc_id, text, *_ in odd_rows():
        after = text or ""
        for a, b, new in reversed(edits(after)):
            after = after[:a] + new + after[b:]
        count = lambda t: len(encode.slow.encode(t, add_special_tokens=False).ids)
        assert (got[doc_id]["n_tokens"], got[doc_id]["n_tokens_edited"]) == (count(text or ""), count(after)), doc_id
    assert got[6]["encoded_chars"] < len(odd_rows()[5][1]) + 2000
    assert token_counts.edited_counts(empty).count() == 0
    tree = token_counts.Tree("a  b", encode)
    with pytest.raises(ValueError):
        tree.replace(2, 9, "")
    with pytest.raises(ValueError):
        token_counts.counts("abcdef", [(0, 3, "x"), (2, 4, "y")], encode)


def test_masked_personal_data():
    found = token_counts.mask_personal("write to a.b@c.org or 12345, not 123")
    assert [x[2] for x in found] == ["[email]", "[number]"]


def plain_removed_lines(rows):
    lines, seen, out = [], set(), set()
    order = lambda r: (r[0] is not None, r[0] or 0)
    for doc_id, text, *_ in sorted({(r[0], r[1]) for r in rows}, key=order):
        for k, line in enumerate((text or "").split("\n")):
            tokens = WORD.findall(line)
            if tokens:
                lines.append(((doc_id, k), frozenset(tokens)))
    for key, tokens in lines:
        earlier = [t for k, t in seen if k != key]
        if any(len(tokens & t) >= 0.8 * len(tokens | t) - 1e-9 for t in earlier):
            out.add(key)
        seen.add((key, tokens))
    return out


def test_line_dedup(spark, empty, labels):
    base = [words(20, s) for s in range(30)]
    near = [b.replace(b.split()[3], f"new{k}") for k, b in enumerate(base)]
    far = [" ".join(b.split()[:12] + words(8, 99 + k).split()) for k, b in enumerate(base)]
    rows = [(k, "\n".join([base[k], "short line", far[k], ""])) for k in range(30)] + [(100 + k, "\n".join([near[k], base[(k + 1) % 30], words(9, 300 + k)])) for k in range(30)]
    rows += [(500, base[0]), (501, base[0] + "\t\t" + base[0]), (None, base[5]), (502, None), (503, ""), (504, "\n\n"), (1, rows[1][1])]
    docs = documents(spark, rows)
    got = {(r["doc_id"], r["line"]) for r in line_dedup.removed_lines(docs).collect()}
    assert got == plain_removed_lines(rows)
    out = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(docs.withColumn("removed", F.lit(1))).collect()}
    assert 500 not in out and out[503] == "" and out[502] is None and out[None] == base[5] and out[0].split("\n")[1] == "short line" and "short line" not in out[1].split("\n")
    assert line_dedup.deduplicate(docs).columns == docs.columns and line_dedup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("tile", [16, line_dedup.TILE])
def test_a_family_of_near_copies_loses_all_but_one_line(spark, tile):
    base = words(40, 7).split()
    rows = [(k, " ".join(base[: k % 40] + [f"z{k}"] + base[k % 40 + 1 :])) for k in range(400)]
    got = {(r["doc_id"], r["line"]) for r in line_dedup.removed_lines(documents(spark, rows), tile=tile).collect()}
    assert got == plain_removed_lines(rows)


@pytest.mark.parametrize("tile", [32, line_dedup.TILE])
def test_large_families_around_the_threshold(spark, tile):
    """Over a thousand near copies, many just under the threshold with each other: each line needs one witness, and none is lost."""
    pick = np.random.default_rng(8)
    base = words(60, 9, 4000).split()
    rows = []
    for k in range(1200):
        line = list(base)
        for at in pick.choice(60, pick.integers(0, 9), replace=False):
            line[at] = f"v{pick.integers(40)}"
        rows.append((k, " ".join(line)))
    rows += [(3000 + k, words(int(pick.integers(1, 9)), 70 + k, 6)) for k in range(200)]
    got = {(r["doc_id"], r["line"]) for r in line_dedup.removed_lines(documents(spark, rows), tile=tile).collect()}
    assert got == plain_removed_lines(rows)


def test_words_are_hashed_alike_wherever_chunks_end(monkeypatch):
    from trajectree.llm import wordhash

    data = (words(300, 5) + "\n\n" + "y" * 700 + " \tz\x0b" + words(50, 6) + "\r\n" + "q" * 64 + "\n").encode()
    whole = wordhash.word_hashes(data)
    assert len(whole[0]) == len(data.split()) and len(set(whole[0].tolist())) == len(set(data.split()))
    assert whole[1].tolist() == [data[: m.start()].count(b"\n") for m in re.finditer(rb"\S+", data)] and whole[2].tolist() == [k for k, b in enumerate(data) if b == 10]
    monkeypatch.setattr(wordhash, "CHUNK", 800)
    assert all((a == b).all() for a, b in zip(wordhash.word_hashes(data), whole))
    monkeypatch.setattr(wordhash, "CHUNK", 100)
    cut = wordhash.word_hashes(data + b"y" * 700)
    assert cut[1][:-1].tolist() == whole[1].tolist() and cut[0][-1] == cut[0][300] and (cut[0][:300] == whole[0][:300]).all()
    assert [k.tolist() for k in wordhash.word_hashes(b"")] == [[], [], []]


def plain_fingerprint(text, width=3):
    tokens = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + width]) for i in range(max(1, len(tokens) - width + 1))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


@pytest.mark.parametrize("tile", [2, 4096])
def test_simhash_links(spark, tile):
    pick = np.random.default_rng(3)
    base = pick.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(6):
            prints.add(int(b) ^ sum(1 << int(k) for k in pick.choice(64, pick.integers(1, 4), replace=False)))
    fps = sorted(prints)
    reps = spark.createDataFrame([(k, int(np.uint64(f).view(np.int64))) for k, f in enumerate(fps)], "rep long, fp long")
    got = [(r["a"], r["b"]) for r in simhash.links(reps, 2, tile).collect()]
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert components(range(len(fps)), got) == components(range(len(fps)), want)


def test_simhash_components(odd, empty):
    found = simhash.near_duplicates(odd).collect()
    fp = [(r["doc_id"], r["fp"] % (1 << 64)) for r in found]
    assert sorted(fp, key=str) == sorted(((r[0], plain_fingerprint(r[1])) for r in odd_rows()), key=str)
    links = [(a, b) for a, x in fp for b, y in fp if (x ^ y).bit_count() <= 2 and a is not None and b is not None]
    want = components({a for a, _ in fp if a is not None}, links)
    assert all(r["component_id"] == want[r["doc_id"]] for r in found if r["doc_id"] is not None)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicate(odd.withColumn("fp", F.lit(0)))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(x for x in ids if x is not None) == sorted(set(want.values())) and "fp" in kept.columns


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 4, 40)])
def test_packing_places_each_id_once(odd, empty, limits):
    rows = packing.pack(odd, limits).collect()
    encode = encoder(default_path())
    want = sorted(len(encode.slow.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in odd_rows())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    starts = [1 for p in rows if p["start"] == 0]
    assert len(starts) == len(want) and sum(r["length"] for r in rows) == sum(want)
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert len(s) <= limits.segments and sum(r["length"] for r in s) <= limits.tokens and sum(r["loss_tokens"] for r in s) <= limits.loss_tokens
        assert all(a["offset"] + a["length"] == b["offset"] for a, b in zip(s, s[1:])) and s[0]["offset"] == 0
    text = {r[0]: r[1] for r in odd_rows()}
    for (doc_id, n), parts in pieces.items():
        ids = [*encode.slow.encode(text[doc_id] or "", add_special_tokens=False).ids, 0]
        assert len(ids) == n
        for p in parts:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == p["ids_crc32"]
    assert packing.pack(empty).count() == 0


def test_prompts_bear_no_loss(spark):
    rows = [(k, words(10 + k, 600 + k), 5 * k if k % 3 else None) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, silent long").withColumn("offset", F.lit("x")).withColumn("_prompt", F.lit(9))
    limits = packing.Limits(256, 16, 60)
    found = packing.pack(docs, limits, prompt="silent").collect()
    silent = {d: p if p is not None else 1 for d, _, p in rows}
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append(r)
        assert r["loss_tokens"] == max(0, r["start"] + r["length"] - max(r["start"], silent[r["doc_id"]]))
    sums = [(sum(r["length"] for r in s), len(s), sum(r["loss_tokens"] for r in s)) for s in sequences.values()]
    assert all(a <= 256 and b <= 16 and c <= 60 for a, b, c in sums) and sum(c == 60 for *_, c in sums) > len(sums) / 2
    assert sum(r["length"] for r in found) == sum(r["doc_tokens"] for r in found if r["start"] == 0)


def test_suffix_array_of_any_string():
    import random

    pick = random.Random(4)
    for _ in range(3000):
        s = [pick.randrange(1, pick.choice([2, 3, 5])) for _ in range(pick.randrange(30))] + [0]
        order = suffix_array.suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        shared = suffix_array.longest_shared(s, order)
        for i in range(len(s)):
            both = [next((k for k, (a, b) in enumerate(zip(s[i:], s[j:])) if a != b), min(len(s) - i, len(s) - j)) for j in range(len(s)) if j != i]
            assert shared[i] == max(both, default=0)


def plain_remaining(rows):
    count, out = Counter(), []
    for _, text, *_ in rows:
        b = (text or "").encode()
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    for doc_id, text, *_ in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [3, suffix_dedup.GROUP])
def test_suffix_dedup(spark, empty, most):
    passage, other = words(60, 11), words(45, 12)
    rows = [(k, words(30 + k, 50 + k) + passage[: 150 + 9 * k] + words(20, 80 + k)) for k in range(25)]
    rows += [(100 + k, words(40, 200 + k) + " " + other[k : k + 205] + words(7, 400 + k)) for k in range(12)]
    rows += [(200, "ab" * 300), (201, "x" * 199), (202, "y" * 201), (203, words(30, 5) + "é" * 120), (204, "é" * 120), (205, None), (206, ""), (207, passage), (207, passage), (None, passage + "!")]
    family = words(50, 13)
    rows += [(300 + k, family[: 7 * k] + chr(97 + k) + family[7 * k + 1 :]) for k in range(20)]
    got = suffix_dedup.remaining(documents(spark, rows), most).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_remaining(rows)
    assert suffix_dedup.remaining(empty).count() == 0


def test_long_texts_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    data = (words(400, 21) + words(100, 22) + words(400, 21)).encode()
    found = [x for part in suffix_dedup.fragments(data) for x in zip(*part)]
    starts = [s for f in found for s in range(f[3], f[4] + 1)]
    assert starts == list(range(len(data) - 199))
    anchors = {}
    for a, _, at, first, last in found:
        for s in range(first, last + 1):
            assert anchors.setdefault(data[s : s + 200], (a, at - s)) == (a, at - s)


def test_chat_round_trip(spark):
    nasty = ["", "\\", "</turn>\n", "### Assistant: x</turn>\n", "a</turn>", "\\</turn>\n\\", "### User:", '"', None]
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for r in ("user", "assistant", "system", 'x":\n\\', None) for t in nasty)]
    rows += [(2, None, "assistant", "first"), (2, 1, "user", "b"), (2, 1, "user", "b"), (None, 0, "assistant", "n")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.rendered_turns(chat.with_extra(frame))).collect()}
    for conv in (1, 2, None, -7):
        mine = [r for r in rows if r[0] == conv] if conv != -7 else [(-7, 0, "user", chat.EXTRA[1]), (-7, 1, "assistant", chat.EXTRA[1])]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (got[conv]["n_turns"], got[conv]["loss_chars"]) == (len(mine), len(loss))
        assert got[conv]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest() and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.parse("### User: a") is None and chat.parse("junk") is None and chat.parse("### Nobody: a</turn>\n") is None


@pytest.mark.parametrize("tile", [7, 2048])
def test_embedding_links(spark, tile):
    pick = np.random.default_rng(5)
    rows = []
    for k in range(150):
        v = pick.normal(size=16) * 10.0 ** pick.integers(-3, 4)
        rows.append((k, v.tolist(), k % 3))
        for j in range(2):
            rows.append((200 + 2 * k + j, (v * 2 + pick.normal(size=16) * np.linalg.norm(v) * 0.08 * j).tolist(), k % 3))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [float("inf")] + [1.0] * 15, 1), (1004, [None] + [1.0] * 15, 1), (1005, [], 1)]
    rows += [(1006, rows[0][1], None), (1007, rows[0][1], 0), (1007, rows[0][1], 0), (1008, rows[0][1][:8], 0), (1009, rows[0][1], 1), (None, rows[3][1], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile).collect()
    good = lambda r: r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])
    n, links = Counter(), []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    n[i] += 1
                    links.append((i, j))
    roots = components(range(len(rows)), links)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[roots[i]] = min(least.get(roots[i], r[0]), r[0])
    want = sorted(((r[0], n[i], least.get(roots[i])) for i, r in enumerate(rows)), key=str)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_labels_keep_their_type(spark):
    v = [1.0, 2.0, 3.0]
    for kind, labels in (("double", [1.2, 1.7, 1.2]), ("string", ["x", "y", "x"]), ("long", [3_000_000_000, 5, 3_000_000_000])):
        rows = [(k, v, label) for k, label in enumerate(labels)]
        frame = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}").withColumn("rep", F.lit("x")).withColumn("n", F.lit(1))
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(frame).collect()) == [(0, 1, 0), (1, 0, 1), (2, 1, 0)]


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_language_of_held_out_rows(spark, odd, empty):
    said = {"en": "the and of with this that", "de": "der und nicht mit für über", "fr": "le et où été à la", "es": "el y niño está con una"}
    pick = np.random.default_rng(6)
    rows = [(k, " ".join(pick.choice(said[lang].split(), 12)), lang) for k, lang in enumerate(list(said) * 60)]
    docs = documents(spark, rows)
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, *_ in rows)
    held = [k for k, *_ in rows if got[k]["held_out"]]
    assert len(held) > 30 and np.mean([got[k]["lang_pred"] == rows[k][2] for k in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())
    out = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all(out[k]["lang_pred"] == "und" and out[k]["score"] == 0 for k in (1, 2, 3)) and out[9]["lang_pred"] in said
    nothing = langid.train(empty)
    assert nothing.languages == [] and langid.identify(empty, model).count() == 0 and langid.identify(odd, nothing).first()["lang_pred"] == "und"


def test_language_against_plain_naive_bayes(spark, odd):
    train = [(r[1], r[2]) for r in odd_rows() if r[1] is not None and r[2] is not None]
    counts = {x: sum(langid.buckets(t) for t, lang in train if lang == x) for x in {lang for _, lang in train}}
    model = langid.train(odd)
    for most in (1, 2, langid.MOST_LANGUAGES):
        for (_, text, *_), r in zip(odd_rows(), langid.identify(odd.coalesce(1), model, most).collect()):
            if text is None or not any(c.isalpha() for c in text):
                assert (r["lang_pred"], r["score"]) == ("und", 0)
                continue
            logs = {}
            for x, c in counts.items():
                p = np.log((c + 1) / (c.sum() + langid.BUCKETS))
                logs[x] = (math.log(sum(lang == x for _, lang in train) / len(train)) + float(langid.buckets(text) @ p)) / len(text)
            best = max(sorted(logs), key=logs.get)
            assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values())) and r["score"] < 1


def test_hashed_ngrams_of_long_texts_are_cut_alike(monkeypatch):
    text = "Über den Fluß " * 50
    whole = langid.buckets(text)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert (langid.buckets(text) == whole).all()


def test_quality_rules(spark, odd, empty, labels):
    prose = [words(90, k, 3000) for k in range(20)]
    rows = odd_rows() + [(1000 + k, p) for k, p in enumerate(prose)] + [(2000, " ".join(w + "%%%" for w in prose[0].split())), (2001, "a b c " * 60), (2002, "x\nx\n\nx\ny\n \n")]
    docs = documents(spark, rows).select("doc_id", "text")
    good = labels.union(spark.createDataFrame([(1000 + k, 1, 0) for k in range(15)], labels.schema))
    got = defaultdict(list)
    for r in quality.judged(docs, good).drop("text").collect():
        got[r["doc_id"]].append(r)
    for doc_id, text, *_ in rows:
        tokens = WORD.findall(text or "")
        windows = Counter(zip(tokens, tokens[1:], tokens[2:]))
        again = np.zeros(len(tokens), bool)
        for k in range(len(tokens) - 2):
            if windows[tuple(tokens[k : k + 3])] > 1:
                again[k : k + 3] = True
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want = (len(tokens), sum(map(len, tokens)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), int(again.sum()))
        for r in got[doc_id]:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (len(tokens) < 50 or 100 * want[4] > 50 * len(tokens)) and not (r["kept"] and r["base_failed"])
    assert all(got[1000 + k][0]["kept"] for k in range(20)) and not got[2000][0]["kept"] and not got[2001][0]["kept"]
    kept = quality.keep(odd.withColumn("score", F.lit("x")), good)
    assert kept.columns == [*odd.columns, "score"] and {r["doc_id"] for r in kept.collect()} <= {6, 7, 8, 10, 11, -5}
    assert quality.keep(empty, good).count() == 0 and quality.judged(docs, good.limit(0)).filter("score <> 0").count() == 0
