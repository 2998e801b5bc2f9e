"""Exact stratified split, seeded shuffles, batches.

Nothing here ranks the whole table in a few tasks.  The hash of the key cuts the rows
into buckets of equal expected size; bucket counts (a bounded table) locate every rank,
and only rows of one bucket are ever ordered against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.hashing import order_hash
from wordloom.session import written
from wordloom.settings import BATCH_SIZE, SEED, VAL_SIZE

# Hex digits of a bucket name: 16^3 buckets per class to find a split, 16^4 to shuffle.
SPLIT_DIGITS = 3
SHUFFLE_DIGITS = 4
# More classes than this is a mistake in the label column; bounds the broadcast below.
MAX_CLASSES = 10_000


def split_quotas(df: DataFrame, label: str = "label", val_size: float = VAL_SIZE) -> DataFrame:
    """(label, n, n_train, n_val): exact per-class quotas by largest remainder.

    n_val in total is ceil(val_size * rows).  Raises at run time for a missing label, for a
    class with fewer than two rows, and when either side has fewer rows than there are
    classes."""
    counts = df.groupBy(label).agg(F.count("*").alias("here"))
    return class_quotas(counts, label, val_size).select(
        label, "n", "n_train", (F.col("n") - F.col("n_train")).alias("n_val")
    )


def class_quotas(counts: DataFrame, label: str, val_size: float) -> DataFrame:
    """(label, n, n_train) from counts (label, here), which may have several rows per class.

    The classes are counted before anything else looks at them, so the windows below see at
    most MAX_CLASSES rows."""
    totals = written(counts.groupBy(label).agg(F.sum("here").cast("bigint").alias("n")))
    if totals.limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ValueError(f"too many classes: more than {MAX_CLASSES}")
    everything = Window.partitionBy()
    sized = totals.withColumns(
        {
            "rows": F.sum("n").over(everything).cast("bigint"),
            "classes": F.count("*").over(everything),
            "smallest": F.min("n").over(everything),
            "unnamed": F.count_if(F.col(label).isNull()).over(everything),
        }
    ).withColumn("train_rows", F.col("rows") - F.ceil(F.lit(float(val_size)) * F.col("rows")))

    def error(text: str) -> Column:
        return F.raise_error(F.lit(text)).cast("bigint")

    fewest = F.least("train_rows", F.col("rows") - F.col("train_rows"))
    checked = (
        F.when(F.col("unnamed") > 0, error("a label is missing"))
        .when(F.col("smallest") < 2, error("a class has fewer than 2 rows"))
        .when(fewest < F.col("classes"), error("one side of the split has fewer rows than there are classes"))
        .otherwise(F.col("train_rows"))
    )
    # rows * rows leaves BIGINT at large scale
    product = F.col("n").cast("decimal(19,0)") * F.col("train_rows").cast("decimal(19,0)")
    shares = sized.withColumn("train_rows", checked).withColumns(
        {
            "remainder": (product % F.col("rows")).cast("decimal(38,0)"),
            "floor": ((product - product % F.col("rows")) / F.col("rows")).cast("bigint"),
        }
    )
    turns = shares.withColumns(
        {
            "open": F.col("train_rows") - F.sum("floor").over(everything),
            "turn": F.row_number().over(Window.orderBy(F.desc("remainder"), F.asc(label))),
        }
    )
    n_train = F.col("floor") + F.when(F.col("turn") <= F.col("open"), 1).otherwise(0)
    return turns.select(label, "n", n_train.cast("bigint").alias("n_train"))


def _with_quotas(counts: DataFrame, label: str, val_size: float) -> DataFrame:
    """Adds `n` and `n_train` of the class to counts (label, bucket, here)."""
    quotas = class_quotas(counts, label, val_size).withColumnRenamed(label, "_class")
    joined = counts.join(F.broadcast(quotas), F.col(label).eqNullSafe(F.col("_class")))  # MAX_CLASSES rows
    return joined.select(*counts.columns, "n", "n_train")


def split_cuts(
    df: DataFrame, label: str, key: str, val_size: float = VAL_SIZE, seed: int = SEED
) -> DataFrame:
    """Per class the hash and key of its last training row; at most MAX_CLASSES rows."""
    hashed = df.select(label, key, order_hash(F.col(key), seed).alias("hash"))
    bucket = F.substring("hash", 1, SPLIT_DIGITS)
    upto = F.sum("here").over(Window.partitionBy(label).orderBy("bucket"))
    filled = written(hashed.groupBy(label, bucket.alias("bucket")).agg(F.count("*").alias("here")))
    edge = (
        _with_quotas(filled, label, val_size)
        .withColumn("before", upto - F.col("here"))
        .where((F.col("before") < F.col("n_train")) & (F.col("n_train") <= F.col("before") + F.col("here")))
        .select(label, "bucket", (F.col("n_train") - F.col("before")).alias("take"))
    )
    # only the rows of one bucket per class are ordered
    inside = (
        hashed.join(F.broadcast(edge), label)
        .where(F.substring("hash", 1, SPLIT_DIGITS) == F.col("bucket"))
        .withColumn("turn", F.row_number().over(Window.partitionBy(label).orderBy("hash", key)))
    )
    return inside.where(F.col("turn") == F.col("take")).select(
        label, F.col("hash").alias("cut_hash"), F.col(key).alias("cut_key")
    )


def apply_cuts(
    df: DataFrame, cuts: DataFrame, label: str = "label", key: str = "doc_id", seed: int = SEED
) -> DataFrame:
    """Adds `split` = 'train' | 'val': each row compares its own hash with the cut of its
    class, so the rows themselves are not shuffled."""
    mine = order_hash(F.col(key), seed)
    before = (mine < F.col("cut_hash")) | ((mine == F.col("cut_hash")) & (F.col(key) <= F.col("cut_key")))
    return (
        df.join(F.broadcast(cuts), label, "left")
        .withColumn("split", F.when(before, "train").otherwise("val"))
        .select(*df.columns, "split")
    )


def stratified_split(
    df: DataFrame,
    label: str = "label",
    key: str = "doc_id",
    val_size: float = VAL_SIZE,
    seed: int = SEED,
) -> DataFrame:
    """Adds `split` with exact per-class quotas.  `key` must be unique.  The cuts (one row
    per class) are found and written at once; the split itself is lazy."""
    return apply_cuts(df, written(split_cuts(df, label, key, val_size, seed)), label, key, seed)


def split_sizes(split: DataFrame, vocab: DataFrame) -> DataFrame:
    """(part, size): rows of both splits and of the vocabulary."""
    rows = split.groupBy(F.col("split").alias("part")).agg(F.count("*").alias("size"))
    words = vocab.agg(F.count("*").alias("size")).select(F.lit("vocab").alias("part"), "size")
    return rows.unionByName(words)


def shuffled_rank(df: DataFrame, key: str, *seed_parts: object) -> DataFrame:
    """(key, rank BIGINT from 1): position in a seeded shuffle of all rows; `key` unique."""
    hashed = df.select(key, order_hash(F.col(key), *seed_parts).alias("hash")).withColumn(
        "bucket", F.substring("hash", 1, SHUFFLE_DIGITS)
    )
    offsets = (
        hashed.groupBy("bucket")
        .agg(F.count("*").alias("here"))
        # at most 16^4 rows
        .select("bucket", (F.sum("here").over(Window.orderBy("bucket")) - F.col("here")).alias("before"))
    )
    return hashed.join(F.broadcast(offsets), "bucket").select(
        key,
        (F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("hash", key)))
        .cast("bigint")
        .alias("rank"),
    )


def ordered_rank(df: DataFrame, *order: Column | str, parts: int | None = None, name: str = "rank") -> DataFrame:
    """Adds the position (BIGINT from 1) of every row in the order of `order`, which must
    leave no ties.

    Range partitions are sampled, so the partition of a row is written down once in
    the shared folder, and both the counts and the ranks are taken from that copy."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count("*").alias("_here"))
        # one row per range partition
        .select("_part", (F.sum("_here").over(Window.orderBy("_part")) - F.col("_here")).alias("_before"))
    )
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_part").select(*df.columns, place.cast("bigint").alias(name))


def training_batches(
    df: DataFrame,
    key: str = "doc_id",
    batch_size: int = BATCH_SIZE,
    seed: int = SEED,
    epoch: int = 1,
    shuffle: bool = True,
) -> DataFrame:
    """(key, batch_id BIGINT from 0, slot BIGINT from 0); the last batch may be short.
    `shuffle` draws a new order per epoch, otherwise the order of the key is kept."""
    ranked = shuffled_rank(df, key, seed, epoch) if shuffle else ordered_rank(df.select(key), key)
    place = F.col("rank") - 1
    return ranked.select(
        key,
        F.floor(place / batch_size).cast("bigint").alias("batch_id"),
        (place % batch_size).cast("bigint").alias("slot"),
    )
