r"""Quality rules: base rules, and a hashed n-gram likelihood ratio of trusted and raw text. DataFrame functions only.

Words are reduced to their shapes first (each run of lower-case letters is ``a``, of upper-case letters ``A``, of digits ``0``), so the n-grams tell prose
from tables, mark-up, shouting and symbol noise in any vocabulary. Shapes and pairs of neighbouring shapes are hashed into :data:`BUCKETS`; lower-case words
and pairs of neighbouring words, which tell vocabulary and word order, into :data:`WORD_BUCKETS`. For each of the two kinds, the raw multinomial counts every
document, the trusted one the documents of a bounded sample of good labels (:data:`TRUSTED_ROWS` ids of least hash, so the set of ids that is broadcast has a
fixed bound). A document's score is the mean of log(trusted / raw) over its n-grams of a kind, the lesser of both, and it passes at :data:`LEAST_SCORE` or
more: on average its n-grams may be at most exp(0.5) times as likely in the raw corpus as in trusted text.

The ratios of all buckets (a fixed number of doubles) go to the tasks as one constant. Repeated three-word windows of a text are found inside its row:
window hashes are packed with their positions into longs, as many hash bits as the position leaves free (over 49 for 32,000 words), and sorted.

Defined results: null text counts as empty and has no word; a text without a word fails the base rules; without trusted documents every score is 0; a
repeated label counts once; repeated rows are judged alike; an empty table gives an empty result; other columns are kept by :func:`keep`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajectree.llm.common import cut, fast_words, spaced

BUCKETS = 1 << 14
WORD_BUCKETS = 1 << 16
TRUSTED_ROWS = 20_000
LEAST_SCORE = -0.5
LEAST_WORDS = 50
#: Percent of words in repeated three-word windows.
MOST_REPEATS = 50


def _shapes(text: Column) -> Column:
    for kind, letter in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "0")):
        text = F.regexp_replace(text, kind, letter)
    return text


def _pairs(name: str) -> Column:
    """The hash of each of a column's hashes with the next."""
    m = F.greatest(F.size(name) - 1, F.lit(0))
    return F.zip_with(F.slice(name, 1, m), F.slice(name, 2, m), lambda a, b: F.xxhash64(a, b))


def hashed(docs: DataFrame) -> DataFrame:
    """docs with the hashes of each text's words, shapes and neighbouring pairs of both: _words, _word_pairs, _shapes, _shape_pairs."""
    text = F.coalesce("text", F.lit(""))
    each = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    docs = docs.withColumn("_words", each(fast_words(text))).withColumn("_shapes", each(fast_words(_shapes(text))))
    return docs.withColumn("_word_pairs", _pairs("_words")).withColumn("_shape_pairs", _pairs("_shapes"))


def _bucket(hash: Column, buckets: int) -> Column:
    return hash.bitwiseAND(F.lit(buckets - 1)).cast("int")


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of good quality: all, or the ``most`` of least hash."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()
    return good.orderBy(F.xxhash64("_trusted"), "_trusted").limit(most)


def ratios(docs: DataFrame, labels: DataFrame) -> tuple[Column, Column]:
    """The log ratio of each bucket's trusted and raw likelihood, add-one smoothed: for shapes and for words, each as one constant array of doubles."""
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted_ids(labels)), F.col("doc_id") == F.col("_trusted"), "left")
    # Words' buckets follow those of shapes, so all are counted at once.
    each = {"_shapes": (0, BUCKETS), "_shape_pairs": (0, BUCKETS), "_words": (BUCKETS, WORD_BUCKETS), "_word_pairs": (BUCKETS, WORD_BUCKETS)}
    both = F.array(*(F.col(c) for c in each))
    spread = hashed(marked).select("_trusted", F.posexplode(both).alias("kind", "hashes")).select("_trusted", "kind", F.explode("hashes").alias("h"))
    grams = spread.select("_trusted", F.when(F.col("kind") < 2, _bucket(F.col("h"), BUCKETS)).otherwise(_bucket(F.col("h"), WORD_BUCKETS) + BUCKETS).alias("bucket"))
    counts = cut(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_trusted").alias("good")))

    def made(first: int, buckets: int) -> Column:
        mine = counts.filter((F.col("bucket") >= first) & (F.col("bucket") < first + buckets))
        raw, good = mine.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
        part = lambda c, total: F.ln((F.coalesce(c, F.lit(0)) + 1) / F.lit(float(total + buckets)))
        ratio = part("good", good) - part("raw", raw) if good else F.lit(0.0)
        every = docs.sparkSession.range(first, first + buckets).withColumnRenamed("id", "_id").join(mine, F.col("_id") == F.col("bucket"), "left")
        rows = every.select("_id", ratio.alias("ratio")).toArrow().sort_by("_id")
        return F.split(F.lit(",".join(map(repr, rows["ratio"].to_pylist()))), ",").cast("array<double>")

    return made(0, BUCKETS), made(BUCKETS, WORD_BUCKETS)


def _repeats(docs: DataFrame) -> DataFrame:
    """docs (with _words and _word_pairs) with n_repeat_words: the words in three-word windows that the text has twice or more."""
    m = F.greatest(F.size("_words") - 2, F.lit(0))
    docs = docs.withColumn("_windows", F.zip_with(F.slice("_word_pairs", 1, m), F.slice("_words", 3, m), lambda a, b: F.xxhash64(a, b)))
    # Most texts repeat no window and are done here.
    docs = docs.withColumn("_windows", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.col("_windows")).otherwise(F.array().cast("array<bigint>")))
    docs = docs.withColumn("_bits", F.length(F.bin(F.size("_windows"))))
    packed = F.transform("_windows", lambda h, i: F.call_function("shiftleft", F.coalesce(h, F.lit(0)), F.col("_bits")).bitwiseOR(i.cast("long")))
    docs = docs.withColumn("_sorted", F.sort_array(packed)).drop("_windows")
    n = F.size("_sorted")
    hash_of = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    docs = docs.withColumn("_same", F.zip_with("_sorted", F.slice("_sorted", 2, F.greatest(n, F.lit(1))), lambda a, b: F.coalesce(hash_of(a) == hash_of(b), F.lit(False))))
    found = F.zip_with("_same", F.concat(F.array(F.lit(False)), F.col("_same")), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    position = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)
    at = F.filter(F.zip_with("_sorted", found, lambda x, f: F.when(f, position(x)).otherwise(F.lit(-1).cast("long"))), lambda p: p >= 0)
    docs = docs.withColumn("_at", F.sort_array(at)).drop("_sorted", "_same", "_bits")
    reach = F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.least(F.lit(3).cast("long"), F.coalesce(b - a, F.lit(3).cast("long"))))
    return docs.withColumn("n_repeat_words", F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x)).drop("_at")


def rules(docs: DataFrame) -> DataFrame:
    """docs (with :func:`hashed`'s columns) with the counts of the base rules and base_failed."""
    text = F.coalesce("text", F.lit(""))
    blank = F.lit(" \t\n\x0b\x0c\r")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, blank) != "")
    docs = docs.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.replace(spaced(text), F.lit(" "), F.lit(""))).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "_lines": lines,
        }
    )
    docs = docs.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    docs = _repeats(docs)
    return docs.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words")))


def _score(ratio: Column, buckets: int, *names: str) -> Column:
    """The mean ratio of some columns' hashes, 0 if there are none."""
    add: Callable[[Column, Column], Column] = lambda s, h: s + F.get(ratio, _bucket(h, buckets))
    total = sum((F.aggregate(c, F.lit(0.0), add) for c in names), F.lit(0.0))
    return F.coalesce(F.try_divide(total, sum((F.size(c) for c in names), F.lit(0)).cast("double")), F.lit(0.0))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) with the rules' counts, score and kept."""
    shapes, words = ratios(docs, labels)
    score = F.least(_score(shapes, BUCKETS, "_shapes", "_shape_pairs"), _score(words, WORD_BUCKETS, "_words", "_word_pairs"))
    scored = rules(hashed(docs).withColumn("score", score)).drop("_words", "_word_pairs", "_shapes", "_shape_pairs")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= LEAST_SCORE))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, as they are."""
    row = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    # A filter would be pushed down through all the steps and repeat them inside each other; a generator stays above.
    return judged(row, labels).select(F.inline(F.when(F.col("kept"), F.array("_row"))))
