"""Documents as fixed-length id sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.session import bounded_join
from wordloom.settings import MAX_LEN, PAD_IDX, UNK_IDX

# Bytes of one broadcast vocabulary row: token, id, hash entry.
VOCAB_ROW_BYTES = 96


def lookup_ids(long: DataFrame, vocab: DataFrame, vocab_rows: int | None = None) -> DataFrame:
    """Adds `idx` to rows with a `token`; a token outside the vocabulary gets the unknown id."""
    known = vocab.select("token", "idx")
    joined = bounded_join(long, known, "token", vocab_rows, VOCAB_ROW_BYTES)
    return joined.withColumn("idx", F.coalesce("idx", F.lit(UNK_IDX)))


def encode(
    tokenized: DataFrame,
    vocab: DataFrame,
    max_len: int = MAX_LEN,
    key: str = "doc_id",
    keep: tuple[str, ...] = (),
    vocab_rows: int | None = None,
) -> DataFrame:
    """(key, *keep, input_ids ARRAY<INT> of `max_len`, length INT >= 1).

    Encoding keeps the first `max_len` tokens by definition, so the array is cut before it
    is exploded and a document contributes at most `max_len` rows.  The rows of a document
    stay in one task until the partial collect, so one row per document is shuffled."""
    cut = tokenized.select(key, *keep, F.slice("tokens", 1, max_len).alias("tokens"))
    long = cut.select(key, *keep, F.posexplode_outer("tokens").alias("pos", "token"))
    # position and id in one number: a quarter of the bytes of a struct
    hit = F.shiftleft(F.col("pos").cast("bigint"), 32).bitwiseOR(F.col("idx").cast("bigint"))
    idx_type = vocab.schema["idx"].dataType
    ids = (
        lookup_ids(long, vocab, vocab_rows)
        # by the key alone, so that later groupings by key need no further shuffle
        .groupBy(key)
        .agg(
            *[F.any_value(c).alias(c) for c in keep],
            # the one row of an empty document carries no position and is not collected
            F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), hit))).alias("hits"),
        )
    )
    return ids.select(
        key,
        *keep,
        tx.pad_or_cut(F.transform("hits", lambda h: h.bitwiseAND(2**32 - 1).cast(idx_type)), max_len).alias("input_ids"),
        F.greatest(F.lit(1), F.size("hits")).alias("length"),
    )


def unknown_rate(
    tokenized: DataFrame, vocab: DataFrame, key: str = "doc_id", vocab_rows: int | None = None
) -> DataFrame:
    """Known and unknown tokens per document, over all of its tokens."""
    long = tokenized.select(key, F.posexplode_outer("tokens").alias("pos", "token"))
    hit = F.col("pos").isNotNull() & (F.col("idx") != UNK_IDX)
    miss = F.col("pos").isNotNull() & (F.col("idx") == UNK_IDX)
    return (
        lookup_ids(long, vocab, vocab_rows)
        .groupBy(key)
        .agg(F.count_if(hit).alias("known_tokens"), F.count_if(miss).alias("unk_tokens"))
    )


def mask_stats(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Real and pad positions of every encoded document."""
    real = F.size(F.filter("input_ids", lambda i: i != PAD_IDX))
    return encoded.select(
        key,
        "length",
        real.cast("bigint").alias("real_positions"),
        (F.size("input_ids") - real).cast("bigint").alias("pad_positions"),
    )
