"""Filter interaction audit: what every order of five filters keeps, removes and costs.

Method: the failures A-D are row-local.  E, "another document with a smaller id has this very
text", is an existential self-join: a left-semi join on the text's hash, the exact text and the
smaller id.  The ids it marks are united with those of the other failures, and bit
combinations are aggregated; all 120 orders are then read off at most 32 combinations per part.

Hash groups without two different ids can't fail E, so their texts never travel.  The existing
side holds one row per different text of a group, the least id, combined in each task; the other
side of a large group is dealt over several salts, to each of which that row is copied.

A row is a document.  Null text: empty.  Null part: ''.  A row without an id may fail A-D, never
E, makes nobody fail E and has no label.  Rows that share id, part and text count one by one and
do not repeat each other.  A document is good or toxic if any of its label rows says 1.  An empty
table gives no rows; other columns are left aside.  DataFrame functions only."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.vectors import bind
from wordloom.session import bounded_join, written

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
SYMBOLS = "[#$%&*|]"
SALT_ROWS = 64  # rows of one hash group that go to one salt


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def local_failures(text: Column) -> Column:
    """Bits of the filters A-D."""
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))

    def of_words(words: Column) -> Column:
        few = F.size(words) < MIN_WORDS
        same = 100 * F.size(F.array_distinct(words)).cast("bigint") < MIN_DISTINCT_PERCENT * F.size(words).cast("bigint")
        return F.when(few, bit("A")).otherwise(0) + F.when(same, bit("B")).otherwise(0)

    return (
        bind(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)
        + F.when(100 * upper.cast("bigint") > MAX_UPPER_PERCENT * F.length(text).cast("bigint"), bit("C")).otherwise(0)
        + F.when(text.rlike(SYMBOLS), bit("D")).otherwise(0)
    )


def repeated(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(doc_id, part, hash) of the rows of `docs` (doc_id, part, text) whose text a smaller id has.

    `hashes`: (doc_id, hash) of all rows."""
    shared = hashes.groupBy("hash").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = written(shared.where("least < most").select("hash", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")))
    keyed = docs.where("doc_id is not null").withColumn("hash", F.xxhash64("text"))
    some = bounded_join(keyed, shared, "hash", None, 32, "inner")
    firsts = some.groupBy("hash", "text", "salts").agg(F.min("doc_id").alias("least"))
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    later = some.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.col("salts")).cast("int"))
    same = (later["hash"] == firsts["hash"]) & (later["salt"] == firsts["salt"]) & (later["text"] == firsts["text"])
    marked = later.join(firsts, same & (firsts["least"] < later["doc_id"]), "left_semi")
    return marked.select("doc_id", "part", "hash")


def combinations(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail."""
    base = docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    local = written(base.select("doc_id", "part", F.xxhash64("text").alias("hash"), local_failures(F.col("text")).alias("mask")))
    again = repeated(base, local.select("doc_id", "hash"))
    every = local.withColumn("n", F.lit(1).cast("bigint")).unionByName(
        again.withColumns({"mask": F.lit(bit("E")), "n": F.lit(0).cast("bigint")})
    )
    masks = every.groupBy("doc_id", "part", "hash").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
    flags = labels.groupBy("doc_id").agg(
        F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic")
    )
    known = masks.join(flags, "doc_id", "left")
    return known.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def orders(found: DataFrame) -> DataFrame:
    """One row per part, order and step from the rows of `combinations`."""
    each = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))  # 32 at most
    rows = each.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = {c: F.lit(bit(c)) for c in FILTERS}

    def bits_of(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(c)), b).otherwise(0) for c, b in bits.items()), F.lit(0))

    own = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    rows = rows.withColumns({"own": bits_of(own), "before": bits_of(before)})

    def summed(value: str, test) -> Column:
        chosen = F.filter("sets", lambda x: test(x["mask"]))
        return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda a, x: a + x[value])

    own, before = F.col("own"), F.col("before")

    def removed(mask: Column) -> Column:
        return (mask.bitwiseAND(own) != 0) & (mask.bitwiseAND(before) == 0)

    # a document that fails k filters is removed by each of them in 120 / k of the orders
    shares = F.transform(F.filter("sets", lambda x: x["mask"].bitwiseAND(own) != 0), lambda x: x["n"] * (F.lit(120) / F.bit_count(x["mask"])).cast("bigint"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        summed("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        summed("n", removed).alias("removed"),
        summed("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        summed("n", lambda m: m == own).alias("unique_fails"),
        summed("good", removed).alias("good_lost"),
        summed("toxic", removed).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """Counts of every order of the filters at every step, per value of `part`."""
    return orders(combinations(docs, labels, text, part))
