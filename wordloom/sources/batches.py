"""Training-ready data set on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.splitting import training_batches
from wordloom.settings import BATCH_SIZE, SEED


def write_batches(
    encoded: DataFrame,
    path: str,
    key: str = "doc_id",
    batch_size: int = BATCH_SIZE,
    seed: int = SEED,
    epoch: int = 1,
    shuffle: bool = True,
    keys: DataFrame | None = None,
    batches_per_shard: int = 1024,
) -> None:
    """Encoded rows as Parquet in batch order: training rows in the shuffled order of
    `epoch`, validation rows (`shuffle=False`) by key.  A batch is never torn over files.

    Batches are placed on the keys alone; the encoded rows, grouped by key already, move
    once, to their shard.  `keys` may name a cheaper table with the same keys (the split
    documents), so that nothing is encoded for the placing."""
    names = (encoded if keys is None else keys).select(key)
    placed = encoded.join(training_batches(names, key, batch_size, seed, epoch, shuffle), key)
    shard = F.floor(F.col("batch_id") / batches_per_shard)
    placed.repartition(shard).sortWithinPartitions("batch_id", "slot").write.mode("overwrite").parquet(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
