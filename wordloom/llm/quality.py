"""Quality rules: base counts, and divergence from language references.

Method: the share of every character class and of the most common words of a document is
compared with the same histogram of its language, by the Jensen-Shannon distance (base 2, so
between 0 and 1).  The references are counted over all documents of a language.  A document
that is too short for a histogram passes that comparison.  The word limit is at most a share of
the distance of a document without any common word, so it is in reach in every language.

Only DataFrame functions.  Null text: no words, so `base_failed`.  Null and empty `lang` form
one language.  Equal rows get equal verdicts; an empty table gives no rows; other columns of
the input are carried along by `judge`, which replaces those that bear its own names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.vectors import bind
from wordloom.session import bounded_join, written

WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \n\t\x0b\x0c\r"  # all that is no word's
SYMBOLS = r"[^#*$%&|<>]+"
# Character classes among what is neither a-z nor white space: all but their members.
CLASSES = {
    "upper": r"[^A-Z]+",
    "letter": r"[^\p{L}]+",
    "digit": r"[^\p{N}]+",
    "point": r"[^.,;:!?'\"()\-]+",
    "symbol": SYMBOLS,
}
WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
COMMON_WORDS = 24  # common words of a language in its reference
MIN_CLASS_CHARS = 100  # shorter texts have no class histogram
MIN_HISTOGRAM_WORDS = 60  # shorter texts have no word histogram
MIN_REFERENCE_WORDS = 2_000  # languages with fewer words have no reference
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.42
MAX_WORD_SHARE = 0.9  # of the distance that a document without any common word has

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def with_rest(rows: DataFrame) -> DataFrame:
    """Rows with `_t` and with `_rest`, the characters of `_t` that are neither a-z nor white
    space, and `_lower` and `_white`, the numbers of those.  White space goes first, character by
    character without a pattern; then a run of a-z is many words long.  All else is counted on the
    rest."""
    dense = F.col("_t")
    for white in WHITE:
        dense = F.replace(dense, F.lit(white), F.lit(""))
    rows = rows.withColumn("_dense", dense)
    rows = rows.withColumn("_rest", F.regexp_replace("_dense", "[a-z]+", ""))
    lower, white = F.length("_dense") - F.length("_rest"), F.length("_t") - F.length("_dense")
    return rows.withColumns({"_lower": lower, "_white": white}).drop("_dense")


def class_counts() -> list[Column]:
    """Code points of each class; the classes share no character and cover the text."""
    n = {k: F.length(F.regexp_replace("_rest", p, "")) for k, p in CLASSES.items()}
    other = F.length("_rest") - n["letter"] - n["digit"] - n["point"] - n["symbol"]
    counts = (F.col("_lower"), n["upper"], n["letter"] - n["upper"], n["digit"], n["point"], n["symbol"], F.col("_white"), other)
    return [c.cast("bigint") for c in counts]


def repeated_words(words: Column) -> Column:
    """Words inside windows of five that are found twice or more, each word once."""
    n = WINDOW_WORDS

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(places, i + 1), p + n) - p))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def twins(order: Column) -> Column:
        return F.filter(order, lambda x, i: (x.h == F.get(order, i - 1).h) | (x.h == F.get(order, i + 1).h))

    def of_windows(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = bind(order, lambda o: F.sort_array(F.transform(twins(o), lambda x: x.i)))
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, bind(places, covered)).otherwise(0)

    def from_place(a: Column, start: int) -> Column:
        return F.slice(a, F.lit(start + 1), F.greatest(F.size(words) - start, F.lit(0)))

    # words 1-2, then 1-4, then 1-5: each step joins two hashes; the ends are not whole
    two = F.zip_with(words, from_place(words, 1), lambda a, b: F.xxhash64(a, b))
    four = bind(two, lambda t: F.zip_with(t, from_place(t, 2), lambda a, b: F.xxhash64(a, b)))
    five = F.zip_with(four, from_place(words, 4), lambda a, b: F.xxhash64(a, b))
    hashes = F.slice(five, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return bind(hashes, of_windows).cast("bigint")


def measured(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with the base counts, `_lang`, `_words` and the columns of `with_rest`."""
    out = docs.drop(*BASE, "_t", "_lang", "_words", "_dense", "_rest", "_lower", "_white")
    out = with_rest(out.withColumn("_t", F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn("_lang", F.coalesce(F.col(lang).cast("string"), F.lit("")))
    out = out.withColumn("_words", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": (F.col("_lower") + F.length("_rest")).cast("bigint"),
            "n_symbols": F.length(F.regexp_replace("_rest", SYMBOLS, "")).cast("bigint"),
            "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
            "n_repeat_words": repeated_words(F.col("_words")),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(_lang, ref_words, ref_word_share, ref_class_share), counted over all documents.

    `ref_words` are the most common words of a language, ties to the smaller word;
    `ref_word_share` has one place more, for all other words."""
    base = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_t")
    )
    counts = class_counts()
    names = [f"c{i}" for i in range(len(counts))]
    classes = with_rest(base).select("_lang", *[c.alias(n) for c, n in zip(counts, names)])
    class_sums = classes.groupBy("_lang").agg(*[F.sum(n).alias(n) for n in names])
    class_share = class_sums.select("_lang", shares(F.array(*names)).alias("ref_class_share"))
    # each word is one row of a task's hash map; the common ones meet in few rows
    words = base.select("_lang", F.explode(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))).alias("w"))
    counted = words.groupBy("_lang", "w").agg(F.count("*").alias("n"))
    # words met once become one row per language; they count in its total alone
    freq = written(counted.groupBy("_lang", F.when(F.col("n") > 1, F.col("w")).alias("w")).agg(F.sum("n").alias("n")))
    totals = freq.groupBy("_lang").agg(F.sum("n").alias("total"))
    best = Window.partitionBy("_lang").orderBy(F.desc("n"), "w")
    top = freq.where("w is not null").withColumn("r", F.row_number().over(best)).where(F.col("r") <= COMMON_WORDS)
    tops = top.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("r", "w", "n"))).alias("top"))
    word_share = tops.join(totals, "_lang").where(F.col("total") >= MIN_REFERENCE_WORDS)
    other = F.col("total") - F.aggregate("top.n", F.lit(0).cast("bigint"), lambda a, x: a + x)
    word_share = word_share.select(
        "_lang",
        F.col("top.w").alias("ref_words"),
        F.array_max(F.transform("top.w", lambda w: F.octet_length(w))).alias("ref_longest"),
        shares(F.concat("top.n", F.array(other))).alias("ref_word_share")
    )
    return word_share.join(class_share, "_lang")


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return bind(total, lambda t: F.transform(counts, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0))))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence of two distributions, base 2; null for null."""

    def toward(a: Column, b: Column) -> Column:
        middle = (a + b) / 2
        return F.when(a > 0, a * F.log2(F.when(middle > 0, a / middle))).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: (toward(a, b) + toward(b, a)) / 2)
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.sqrt(total)).when(total.isNotNull(), F.lit(0.0))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with the base counts, class_distance, word_distance (null where a guard holds)
    and kept."""
    new = ["class_distance", "word_distance", "kept"]
    kept_columns = [c for c in docs.columns if c not in [*BASE, *new]]
    refs = written(language_references(docs, text, lang))
    # the columns of `docs` travel in a struct, so that none meets a name of these
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("_in"), F.col(text).alias("_text"), F.col(lang).alias("_language"))
    # one row per language with a reference of bounded width
    joined = bounded_join(measured(packed, "_text", "_language"), refs, "_lang", refs.count(), 8_192)
    # most words are longer than any common one: a cheap test before the list
    common = F.filter(
        "_words", lambda w: (F.octet_length(w) <= F.col("ref_longest")) & F.array_contains(F.col("ref_words"), w)
    )

    def word_counts(found: Column) -> Column:
        own = F.transform("ref_words", lambda r: F.size(found) - F.size(F.array_remove(found, r)))
        return F.concat(own, F.array(F.size("_words") - F.size(found)))

    long_enough = F.col("ref_words").isNotNull()
    joined = joined.withColumn(
        "_word_share",
        F.when(
            long_enough & (F.col("n_words") >= MIN_HISTOGRAM_WORDS),
            bind(common, lambda c: shares(F.transform(word_counts(c), lambda x: x.cast("bigint")))),
        ),
    )
    joined = joined.withColumn(
        "_class_share",
        F.when(
            long_enough & (F.col("word_chars") >= MIN_CLASS_CHARS),
            shares(F.array(*class_counts())),
        ),
    )
    out = joined.withColumns(
        {
            "class_distance": js_distance(F.col("_class_share"), F.col("ref_class_share")),
            "word_distance": js_distance(F.col("_word_share"), F.col("ref_word_share")),
        }
    )
    # a text of another language, a list of rare words: its distance ends where no word is common
    none = F.transform("ref_word_share", lambda _, i: F.when(i == F.size("ref_words"), F.lit(1.0)).otherwise(F.lit(0.0)))
    without = MAX_WORD_SHARE * js_distance(none, F.col("ref_word_share"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (
        F.coalesce("word_distance", F.lit(0.0)) <= F.coalesce(F.least(F.lit(MAX_WORD_DISTANCE), without), F.lit(MAX_WORD_DISTANCE))
    )
    out = out.withColumn("kept", ~F.col("base_failed") & near)
    return out.select(*[F.col("_in").getField(c).alias(c) for c in kept_columns], *BASE, *new)
