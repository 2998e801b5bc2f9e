"""Raw labelled rows -> (key, label, text) -> tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.settings import CSV_COLUMNS, LABEL_NAMES


def require_columns(df: DataFrame, columns: list[str] = CSV_COLUMNS) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"input must contain the columns {', '.join(columns)}; missing: {', '.join(missing)}")


def decode_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: tx.decode_missing(F.col(c)) for c in columns})


def derive_documents(
    raw: DataFrame,
    key: str = "doc_id",
    class_index: str = "Class Index",
    title: str = "Title",
    description: str = "Description",
) -> DataFrame:
    """(key, label INT, text STRING) from the raw labelled columns."""
    require_columns(raw, [class_index, title, description])
    return raw.select(
        key,
        tx.label_from_class_index(F.col(f"`{class_index}`")).alias("label"),
        tx.document_text(
            tx.decode_missing(F.col(f"`{title}`")), tx.decode_missing(F.col(f"`{description}`"))
        ).alias("text"),
    )


def label_names(df: DataFrame, names: list[str] = LABEL_NAMES, label: str = "label") -> DataFrame:
    """Adds `label_name`; NULL for an id outside the list."""
    return df.withColumn("label_name", tx.label_name(F.col(label), names))


def tokenize(df: DataFrame, text: str = "text", lower: bool = True) -> DataFrame:
    """Replaces `text` by `tokens` ARRAY<STRING>."""
    return df.withColumn("tokens", tx.tokens(F.col(text), lower)).drop(text)


def token_positions(tokenized: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long form (key, pos, token), positions from 0; a document without tokens has no row.

    The outer explode is on purpose: from an inner one Spark infers a filter on the array's
    size and runs the whole tokenizer once more for it."""
    return tokenized.select(key, F.posexplode_outer("tokens").alias("pos", "token")).where(F.col("pos").isNotNull())
