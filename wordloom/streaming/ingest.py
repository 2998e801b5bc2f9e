"""New files as a stream: labelled CSV to tokens, texts to ranked classes.  All steps look at one
row at a time, so the batch operators apply unchanged; nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators.documents import derive_documents, tokenize
from wordloom.plans.score import RowScorer
from wordloom.settings import CSV_COLUMNS


def stream_labelled_csv(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """Streaming (file, label, tokens) of the labelled CSV files that arrive in `folder`.
    Columns are taken by position, so the files hold the three labelled columns first."""
    schema = ", ".join(f"`{c}` string" for c in CSV_COLUMNS)
    raw = (
        spark.readStream.schema(schema)
        .options(header=True, quote='"', escape='"', multiLine=multi_line, enforceSchema=True)
        .csv(folder)
        .withColumn("file", F.col("_metadata.file_name"))
    )
    return tokenize(derive_documents(raw, key="file"))


def stream_texts(spark: SparkSession, folder: str, key_type: str = "bigint") -> DataFrame:
    """Streaming (doc_id, text) of the Parquet files that arrive in `folder`."""
    return spark.readStream.schema(f"doc_id {key_type}, text string").parquet(folder)


def write_scores(texts: DataFrame, scorer: RowScorer, folder: str, state: str) -> StreamingQuery:
    """Scores every text that has arrived and appends the ranked classes to `folder`.  `state` is the
    query's checkpoint: a stopped or failed query goes on where it was, each text once."""
    rows = scorer.score(texts)
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", state).trigger(availableNow=True).start()
