"""Personal data: fixed patterns, and a skip-chain conditional random field that finds further mentions of what a document's patterns found.

Base spans come from one pattern a kind, leftmost and without overlaps, and stay. Tokens (runs of digits, and runs of letters with digits or beside an @) are the
nodes of a field over the whole document: neighbours are linked in a chain, and each token is linked to the one before it that reads alike, however far, so a
token that repeats n times adds n - 1 links. Base spans are evidence; messages over chain and skip links carry them to repeated and similar tokens. Runs of
tokens of one label, sure enough, of a valid form, and joined by skip links to a base span of their kind become spans too.

The field is trained on a bounded sample: of the :data:`ASKED` documents of least hash, at most :data:`SAMPLE` with a token and at most :data:`LONGEST` tokens each,
labelled by the base spans. It never sees more, so its size doesn't follow the corpus.

Defined results: null text is empty; offsets count code points; each row is a document, repeated rows too; null doc_ids stay, and aren't trained on; spans equal in
start go by kind as listed; other columns are ignored; an empty table gives an empty result. A task holds one document's tokens at a time.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectree.llm.components import forest
from trajectree.llm.skip_chain import FEATURES, Graph, Model, marginals, train

KINDS = ("email", "ip", "card", "phone")
#: Documents that training draws from, documents it takes of them, and tokens of each at most.
ASKED, SAMPLE, LONGEST = 40_000, 2_000, 200
#: Probability from which a token is taken for part of an entity.
SURE = 0.9
#: Digits of a run by which it is like another run.
TAIL = 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that isn't followed by dots and numbers matches from none of its digits, so only its first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
_DIGITS = re.compile(r"[0-9]+")
_LETTER = re.compile(r"[A-Za-z]")
#: What may stand between neighbours: signs, and anything short on one line between tokens with letters (`` at ``).
_GAP, _WIDE_GAP = re.compile(r"[ ().@/-]{0,4}"), re.compile(r"[^\n,;:]{0,6}")
_WORD = re.compile(r"([A-Za-z]+)[^A-Za-z]*\Z")


def luhn(digits: str) -> bool:
    values = [int(x) for x in reversed(digits)]
    return (sum(values[::2]) + sum(2 * x - 9 * (x > 4) for x in values[1::2])) % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of what the patterns find, in that order."""
    found = [(begin, 0, end) for begin, end in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found)


def tokens(text: str) -> list[tuple[int, int]]:
    """Begin and end of each run of digits, and of each run of letters that has a digit or is beside an @."""
    out = []
    for m in _RUN.finditer(text):
        run, begin, end = m[0], m.start(), m.end()
        beside = text[end : end + 1] == "@" or begin > 0 and text[begin - 1] == "@"
        if not beside and not _DIGITS.search(run):
            continue
        if _LETTER.search(run):
            left = len(run) - len(run.lstrip("._%+-"))
            out.append((begin + left, begin + len(run.rstrip("._%+-"))))
        else:
            out += [(begin + d.start(), begin + d.end()) for d in _DIGITS.finditer(run)]
    return out


def _sign(text: str, at: int) -> str:
    """What stands at a place: letters and digits by kind, others as they are."""
    c = text[at] if 0 <= at < len(text) else ""
    return "a" if c.isalpha() else "9" if c.isdigit() else c


@functools.lru_cache(1 << 14)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % FEATURES


def graph(text: str, spans: list[tuple[int, int, int]], evidence: bool) -> tuple[Graph, list[tuple[int, int]], list[int]]:
    """The field of a text, its tokens, and the first token of each token's run. Labels: 1 + kind inside a base span; else 0, or unknown with evidence."""
    at = tokens(text)
    g, starts = Graph(len(at)), []
    named = [_LETTER.search(text, b, e) is not None for b, e in at]
    for i, (begin, _) in enumerate(at):
        gap = _WIDE_GAP if i and named[i - 1] and named[i] else _GAP
        near = i and gap.fullmatch(text, at[i - 1][1], begin) is not None
        starts.append(starts[-1] if near else i)
        if near:
            g.chain.append((i - 1, i))
    label = [-1 if evidence else 0] * len(at)
    ends = [end for _, end in at]
    for first, kind, last in spans:
        i = bisect.bisect_right(ends, first)
        while i < len(at) and at[i][0] < last:
            if label[i] < 1:
                label[i] = 1 + kind
            i += 1
    g.label = label
    seen: dict[str, int] = {}
    for first in sorted(set(starts)):
        last = first
        while last + 1 < len(at) and starts[last + 1] == first:
            last += 1
        run = [text[b:e] for b, e in at[first : last + 1]]
        digits = "".join(run) if all(map(str.isdigit, run)) else ""
        gaps = "".join(sorted(set("".join(text[at[i][1] : at[i + 1][0]] for i in range(first, last)))))[:6]
        shared = [f"rt{min(len(run), 6)}", f"rd{min(len(digits), 20)}", f"rs{gaps}", f"rl{12 <= len(digits) <= 19 and luhn(digits)}"]
        for i, token in enumerate(run, first):
            begin, end = at[i]
            number, before, after = token.isdigit(), _sign(text, begin - 1), _sign(text, end)
            word = _WORD.search(text, max(0, begin - 24), begin)
            own = ["1", f"t{min(len(token), 20) if number else 'm'}", f"p{before}", f"n{after}", f"pn{before}{after}", f"w{word[1].lower()[-6:] if word else ''}", f"at{i - first}"]
            own += [f"v{number and len(token) <= 3 and int(token) <= 255}", f"l{number and 12 <= len(token) <= 19 and luhn(token)}"]
            buckets = [*map(_bucket, own + shared)]
            g.feature += buckets
            g.owner += [i] * len(buckets)
            keys = ["=" + token.lower()] * (len(token) >= (3 if number else 5)) + ["#" + digits[-TAIL:]] * (i == last and len(digits) >= TAIL)
            for key in keys:
                if key in seen and (seen[key], i) not in g.skip[-2:]:
                    g.skip.append((seen[key], i))
                seen[key] = i
    return g, at, starts


def _valid(kind: int, said: str, emails: set[str]) -> bool:
    """Whether a run of tokens has its kind's form; an address must be one of the text's, its halves in order."""
    parts = _DIGITS.findall(said)
    digits = "".join(parts)
    if kind == 0:
        halves = said.lower().split()
        return len(halves) >= 2 and f"{halves[0]}@{halves[-1]}" in emails
    return len(parts) == 4 and _octets(parts) if kind == 1 else 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else TAIL <= len(digits) <= 15


def added_spans(text: str, spans: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """Further mentions: runs of tokens that the field gives one kind and that skip links join to a base span of that kind."""
    if not spans:
        return []
    g, at, starts = graph(text, spans, True)
    known = np.array(g.label)
    if not g.skip or not (known < 0).any():
        return []
    sure = marginals(g, model)
    label = np.where(known >= 0, known, np.where(sure.max(1) >= SURE, sure.argmax(1), 0))
    a, b = g.links("skip")
    alike = (label[a] == label[b]) & (label[a] > 0)
    links = np.concatenate([np.column_stack([a, b])[alike], [(i - 1, i) for i in range(1, g.n) if starts[i] == starts[i - 1] and label[i] == label[i - 1] > 0] or np.zeros((0, 2), np.int64)])
    root = forest(g.n, links[:, 0], links[:, 1])
    emails = {text[first:last].lower() for first, kind, last in spans if kind == 0}
    based, out, i = set(root[known > 0].tolist()), [], 0
    while i < g.n:
        j = i
        while j + 1 < g.n and starts[j + 1] == starts[i] and label[j + 1] == label[i] and known[j + 1] < 0:
            j += 1
        if known[i] < 0 and label[i] > 0 and root[i] in based:
            begin, end, kind = at[i][0], at[j][1], int(label[i]) - 1
            begin -= ")" in text[begin:end] and text[begin - 1 : begin] == "("
            if _valid(kind, text[begin:end], emails) and not any(begin < last and first < end for first, _, last in spans):
                out.append((begin, kind, end))
        i = j + 1
    return out


#: Columns of a sampled field.
_PARTS = ["label", "feature", "owner", "chain", "skip"]


def trained(docs: DataFrame) -> Model:
    """The field, from a sample of docs (doc_id, text)."""
    n = docs.count()
    share = int(min(1.0, ASKED / max(1, n)) * (1 << 31))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    asked = docs.select("doc_id", "text", order.alias("order")).filter((F.col("order") <= share) & F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, order in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "order"))):
                g = graph(text, base_spans(text), False)[0]
                if 0 < g.n <= LONGEST:
                    rows.append((order, doc_id, g.label, g.feature, g.owner, [x for pair in g.chain for x in pair], [x for pair in g.skip for x in pair]))
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], ["order", "doc_id", *_PARTS])

    fields = asked.mapInArrow(run, "order long, doc_id long, " + ", ".join(f"{x} array<int>" for x in _PARTS))
    taken = fields.orderBy("order", "doc_id", "label", "feature").limit(SAMPLE).select(*_PARTS).toArrow()
    column = {x: taken[x].combine_chunks() for x in _PARTS}
    nodes = np.diff(column["label"].offsets.to_numpy())
    before = np.concatenate([[0], np.cumsum(nodes)[:-1]]) if len(nodes) else nodes
    flat = lambda x: column[x].flatten().to_numpy().astype(np.int64)
    moved = lambda x: flat(x) + np.repeat(before, np.diff(column[x].offsets.to_numpy()))
    return train(Graph(int(nodes.sum()), flat("feature"), moved("owner"), moved("chain"), moved("skip"), flat("label")), 1 + len(KINDS))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{begin}:{end}" for begin, kind, end in sorted(spans))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans, and n_added of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                base = base_spans(text) if text else []
                more = added_spans(text, base, shared.value) if base else []
                counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
            kinds = [*[pa.int64()] * len(KINDS), pa.string(), pa.string(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *names, "base_sha256", "spans", "n_added"])

    # No text without a digit or an @ has a span, so only others go to Python.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike("[0-9@]"), F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names) + ", base_sha256 string, spans string, n_added long")
