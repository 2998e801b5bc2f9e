"""The given tables as inputs of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.hashing import normal_vector
from wordloom.operators import classify
from wordloom.operators.documents import derive_documents
from wordloom.operators.recurrent import RecurrentSpec
from wordloom.operators.runs import Prefix, running
from wordloom.settings import SEED

# Width of the vectors in the `embeddings` table.
DIM = 64

# Hidden units of the recurrent scorer whose weights are cut from the embeddings.
RNN_HIDDEN = 8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of a raw labelled CSV: string class index, title and
    description with several spellings of missing values."""
    source = F.col("source")
    title = (
        F.when(source == "src0", None).when(source == "src1", "NA").when(source == "src2", "").otherwise(source)
    )
    description = F.when(source.isin("src0", "src3"), None).when(source == "src4", "None").otherwise(F.col("text"))
    class_index = (
        F.when(F.col("lang") == "en", "1").when(F.col("lang") == "fr", "2").when(F.col("lang") == "de", "3").otherwise("4.0")
    )
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        class_index.alias("class_index"),
        title.alias("title"),
        description.alias("description"),
    )


def raw_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_documents(
        raw_documents(spark, sf_dir), class_index="class_index", title="title", description="description"
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, text): the language plays the class."""
    lang = F.col("lang")
    label = F.when(lang == "en", 0).when(lang == "fr", 1).when(lang == "de", 2).otherwise(3)
    return load(spark, sf_dir, "documents").select("doc_id", label.alias("label"), "text")


def word_vectors(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> DataFrame:
    """(token, vector): the vocabulary words, from 2 on, own the embeddings in order of their
    ids, so low ids have a vector and high ids have none."""
    emb = load(spark, sf_dir, "embeddings").select((F.col("vec_id") + 2).alias("idx"), F.col("embedding").alias("vector"))
    words = vocab.where(F.col("idx") >= 2).select(F.col("idx").cast("bigint").alias("idx"), "token")
    return words.join(emb, "idx").select("token", "vector")


def centroid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, logits): nearest-centroid class scores of all embeddings."""
    emb = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("features"))
    scored = classify.linear_logits(emb, classify.class_centroids(emb))
    return scored.select("vec_id", "label", F.transform("logits", lambda x: F.round(x, 6)).alias("logits"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, y_true, y_pred)"""
    scored = classify.with_probabilities(centroid_scores(spark, sf_dir))
    return scored.select("vec_id", F.col("label").alias("y_true"), "y_pred")


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_name, epoch, train_loss, train_acc, train_macro_f1, val_loss, val_acc, val_macro_f1): the
    events of a user are the epochs of a run; an error event logs NaN."""
    events = load(spark, sf_dir, "events").select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_name"), "event_id", "event_type", "value", "props"
    )
    numbered = running(events, "run_name", "event_id", Prefix("epoch", "sum", F.lit(1)))
    score = F.round(F.col("value") / (F.col("value") + 10), 4)
    gain = F.get_json_object("props", "$.k").cast("double") / 1000
    return numbered.select(
        "run_name",
        F.col("epoch").cast("int").alias("epoch"),
        F.round(1 / (2 + F.col("value")), 4).alias("train_loss"),
        F.round(F.col("value") / (F.col("value") + 11), 4).alias("train_acc"),
        F.round(score + gain, 4).alias("train_macro_f1"),
        F.round(1 / (1 + F.col("value")), 4).alias("val_loss"),
        F.round(F.col("value") / (F.col("value") + 12), 4).alias("val_acc"),
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(score).alias("val_macro_f1"),
    )


def run_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_name, best_epoch, c_mktsegment): customers override runs of the same number;
    runs without a customer stay as they are."""
    return (
        load(spark, sf_dir, "customer")
        .select(
            F.concat(F.lit("run_"), F.col("c_custkey").cast("string")).alias("run_name"),
            F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey").cast("int")).alias("best_epoch"),
            "c_mktsegment",
        )
    )


def layout_of(spec: RecurrentSpec, dim: int = DIM, classes: int = 4) -> list[tuple[str, int, int]]:
    """(name, rows, width) of the parameters of a one-layer network with layer norms, in order."""
    hidden, gates = spec.hidden_size, {"lstm": 4, "gru": 3}[spec.model_type] * spec.hidden_size
    features = hidden * (2 if spec.bidirectional else 1) * (2 if spec.pooling == "meanmax" else 1)
    out = []
    for way in ["l0", "l0_reverse"] if spec.bidirectional else ["l0"]:
        out += [(f"rnn.weight_ih_{way}", gates, dim), (f"rnn.weight_hh_{way}", gates, hidden)]
        out += [(f"rnn.bias_ih_{way}", 1, gates), (f"rnn.bias_hh_{way}", 1, gates)]
    for name, width in (("embedding_norm", dim), ("feature_norm", features)):
        out += [(f"{name}.weight", 1, width), (f"{name}.bias", 1, width)]
    return [*out, ("classifier.weight", classes, features), ("classifier.bias", 1, classes)]


def drawn_weights(spark: SparkSession, spec: RecurrentSpec, dim: int = DIM, std: float = 0.1) -> DataFrame:
    """(name, shape, values): parameters of `layout_of` drawn from a normal distribution, each row by
    its own number, so that a large block is many rows until they are put together."""
    parts = []
    for number, (name, rows, width) in enumerate(layout_of(spec, dim)):
        values = normal_vector(F.col("id") + number * 1_000_000, width, SEED, std)
        each = spark.range(rows).select("id", values.alias("v"))
        whole = each.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x["v"])).alias("values"))
        shape = F.array(F.lit(width)) if rows == 1 else F.array(F.lit(rows), F.lit(width))
        parts.append(whole.select(F.lit(name).alias("name"), shape.alias("shape"), "values"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def rnn_weights(spark: SparkSession, sf_dir: str, spec: RecurrentSpec, classes: int = 4) -> DataFrame:
    """(name, shape, values): network parameters taken from consecutive embedding rows, one
    row of a parameter per embedding row, cut to its width."""
    hidden, gates = spec.hidden_size, {"lstm": 4, "gru": 3}[spec.model_type] * spec.hidden_size
    features = hidden * (2 if spec.bidirectional else 1) * (2 if spec.pooling == "meanmax" else 1)
    ways = ["l0", "l0_reverse"] if spec.bidirectional else ["l0"]
    layout: list[tuple[str, int, int, int]] = []  # name, first embedding row, rows, width
    start = 0
    for way in ways:
        for name, rows, width in (
            (f"rnn.weight_ih_{way}", gates, DIM),
            (f"rnn.weight_hh_{way}", gates, hidden),
            (f"rnn.bias_ih_{way}", 1, gates),
            (f"rnn.bias_hh_{way}", 1, gates),
        ):
            layout.append((name, start, rows, width))
            start += rows
    for name, rows, width in (("classifier.weight", classes, features), ("classifier.bias", 1, classes)):
        layout.append((name, start, rows, width))
        start += rows
    vec_id = F.col("vec_id")

    def owner(field: int) -> Column:
        """Field of the parameter that a row belongs to; NULL for the rows after the last."""
        return F.coalesce(*[F.when((vec_id >= p[1]) & (vec_id < p[1] + p[2]), F.lit(p[field])) for p in layout])

    rows = (
        load(spark, sf_dir, "embeddings")
        .select("vec_id", "embedding", owner(0).alias("name"), owner(2).alias("rows"), owner(3).alias("width"))
        .where(F.col("name").isNotNull())
    )
    cut = rows.groupBy("name", "rows", "width").agg(
        F.sort_array(F.collect_list(F.struct("vec_id", F.slice("embedding", 1, F.col("width")).alias("v")))).alias("c")
    )
    shape = F.when(F.col("rows") == 1, F.array("width")).otherwise(F.array("rows", "width"))
    return cut.select("name", shape.alias("shape"), F.flatten("c.v").alias("values"))
