"""Token frequencies and frequency-ranked vocabularies.

Every count is combined on the map side, so a token that makes up a third of the corpus
costs one row per task in the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from wordloom.operators.documents import token_positions
from wordloom.operators.splitting import ordered_rank
from wordloom.session import written
from wordloom.settings import MAX_VOCAB_SIZE, MIN_FREQ, PAD_IDX, PAD_TOKEN, UNK_IDX, UNK_TOKEN, W2V_MIN_COUNT


def token_freq(tokenized: DataFrame) -> DataFrame:
    """(token, freq BIGINT) over all documents."""
    long = tokenized.select(F.explode_outer("tokens").alias("token")).where(F.col("token").isNotNull())
    return long.groupBy("token").agg(F.count("*").alias("freq"))


def _first_occurrence(df: DataFrame, key: str) -> Column:
    """Order of first occurrence by (key, pos).  An integral key is packed with the
    position into one decimal: decimals keep the aggregation in a hash map, where a
    struct would force Spark to sort all tokens."""
    if isinstance(df.schema[key].dataType, IntegralType):
        packed = F.col(key).cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)")
        return F.min(packed + F.col("pos").cast("decimal(10,0)"))
    return F.min(F.struct(key, "pos"))


def vocabulary_rows(max_size: int) -> int:
    """Row bound of a vocabulary built with that cap.  The cap counts the two specials but
    is looked at after a word was added, so one word always gets in."""
    return max(max_size, 3)


def build_vocab(
    tokenized: DataFrame,
    key: str = "doc_id",
    max_size: int = MAX_VOCAB_SIZE,
    min_freq: int = MIN_FREQ,
) -> DataFrame:
    """(idx INT, token, freq BIGINT), written: the specials, then words by falling frequency, words
    of equal frequency by first occurrence.

    How many words have each frequency (one row per frequency) tells the frequency at which
    the cap cuts.  Only words down to that one are ordered, in range partitions with offsets,
    so no task sees them all, however many share the last frequency."""
    spark = tokenized.sparkSession
    words = (
        token_positions(tokenized, key)
        .where(~F.col("token").isin(PAD_TOKEN, UNK_TOKEN))
        .groupBy("token")
        .agg(F.count("*").alias("freq"), _first_occurrence(tokenized.withColumn("pos", F.lit(0)), key).alias("first"))
        .where(F.col("freq") >= min_freq)
    )
    words = written(words)
    most = vocabulary_rows(max_size) - 2
    before = F.sum("here").over(Window.orderBy(F.desc("freq"))) - F.col("here")
    sizes = words.groupBy("freq").agg(F.count("*").alias("here")).withColumn("before", before)
    cut = sizes.where(F.col("before") < most).agg(F.min("freq")).first()[0]
    chosen = ordered_rank(words.where(F.col("freq") >= F.lit(cut)), F.desc("freq"), F.asc("first"))
    ranked = chosen.where(F.col("rank") <= most).select((F.col("rank") + 1).cast("int").alias("idx"), "token", "freq")
    specials = spark.range(0, 1, 1, 1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(idx).alias("idx"), F.lit(token).alias("token"), F.lit(0).cast("bigint").alias("freq"))
                    for idx, token in ((PAD_IDX, PAD_TOKEN), (UNK_IDX, UNK_TOKEN))
                ]
            )
        )
    )
    return written(specials.unionByName(ranked))


def frequent_words(tokenized: DataFrame, min_count: int = W2V_MIN_COUNT) -> DataFrame:
    """(token, freq) of the words that take part in vector training."""
    return token_freq(tokenized).where(F.col("freq") >= min_count)
