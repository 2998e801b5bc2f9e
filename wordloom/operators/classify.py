"""Class scores, probabilities and ranked classes."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.functions import vectors as vx
from wordloom.settings import LABEL_NAMES


def class_centroids(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """(label_id, weight ARRAY<DOUBLE>, bias): per-class mean of every dimension as linear
    class weights.  Sums of whole vectors are combined per task first, so a large class is no
    hot spot."""
    rows = df.where(F.col(features).isNotNull()).select(
        F.col(label).alias("label_id"), array_to_vector(F.col(features).cast("array<double>")).alias("v")
    )
    means = rows.groupBy("label_id").agg(Summarizer.mean(F.col("v")).alias("mean"))
    return means.select("label_id", vector_to_array("mean").alias("weight"), F.lit(0.0).alias("bias"))


def linear_logits(df: DataFrame, weights: DataFrame, features: str = "features") -> DataFrame:
    """Adds `logits` ARRAY<DOUBLE> in label order: features . weight + bias.

    `weights` (label_id, weight, bias) has one row per class.  It enters as a scalar
    subquery: one small constant for all tasks, and no join that multiplies rows."""
    table = weights.agg(F.sort_array(F.collect_list(F.struct("label_id", "weight", "bias"))).alias("w")).scalar()
    values = F.col(features).cast("array<double>")
    scores = F.transform("_weights", lambda c: vx.dot(values, c["weight"]) + c["bias"])
    return df.withColumn("_weights", table).withColumn("logits", scores).drop("_weights")


def with_probabilities(df: DataFrame) -> DataFrame:
    """Adds `probs` (soft-max of `logits`) and `y_pred` (first maximum)."""
    return df.withColumns({"probs": vx.softmax(F.col("logits")), "y_pred": vx.argmax(F.col("logits"))})


def ranked_probs(df: DataFrame, key: str = "doc_id", names: list[str] = LABEL_NAMES) -> DataFrame:
    """(key, rank, label_id, label_name, prob): all classes of a row by falling
    probability, ties by class id.  Ranked inside the row, so nothing is shuffled."""
    pairs = F.transform("probs", lambda p, i: F.struct((-p).alias("neg"), i.alias("label_id"), p.alias("prob")))
    rows = df.select(key, F.posexplode_outer(F.sort_array(pairs)).alias("place", "c"))
    return rows.where(F.col("place").isNotNull()).select(
        key,
        (F.col("place") + 1).alias("rank"),
        F.col("c.label_id").alias("label_id"),
        tx.label_name(F.col("c.label_id"), names).alias("label_name"),
        F.col("c.prob").alias("prob"),
    )
