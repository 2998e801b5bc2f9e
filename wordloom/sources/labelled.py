"""Labelled CSV files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.operators.documents import derive_documents, require_columns
from wordloom.session import bounded_join, written
from wordloom.settings import CSV_COLUMNS
from wordloom.sources.records import csv_records

DEFAULT_PATH = "data/train.csv"

# Doubled quotes inside quoted fields, spaces kept.
FORMAT = dict(
    header=True,
    quote='"',
    escape='"',
    encoding="UTF-8",
    ignoreLeadingWhiteSpace=False,
    ignoreTrailingWhiteSpace=False,
)


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def resolve_csv(spark: SparkSession, path: str | None = None) -> str:
    """File to read: the default path, `<dir>/train.csv` for a folder that has one, the path
    itself otherwise (so a folder of part files and a glob work too)."""
    path = path or DEFAULT_PATH
    if re.search(r"[*?\[{]", path):
        return path
    target, fs = _hadoop_path(spark, path)
    if not fs.exists(target):
        raise FileNotFoundError(f"labelled CSV not found: {path}")
    if fs.getFileStatus(target).isDirectory():
        inner, _ = _hadoop_path(spark, f"{path.rstrip('/')}/train.csv")
        if fs.exists(inner):
            return inner.toString()
        if not list(fs.listStatus(target)):
            raise FileNotFoundError(f"no labelled CSV in {path}")
    return path


def read_raw_csv(spark: SparkSession, path: str | None = None, multi_line: bool = True, whole_files: bool = False) -> DataFrame:
    """All columns as strings plus `doc_id`.  Quotes are doubled inside quoted fields.

    Fields may hold newlines: the records of large files are cut in byte ranges (`records`).
    `multi_line=False` says that none does and saves the counting of quotes; `whole_files=True`
    parses each file in one task, which also stands quotes inside unquoted fields.  Records are
    parsed once, into the shared folder.  `doc_id` is the place of a row in its file after all rows
    of the files before it by name, whatever the splits were."""
    path = resolve_csv(spark, path)
    df = spark.read.options(multiLine=multi_line and whole_files, **FORMAT).csv(path)
    require_columns(df, CSV_COLUMNS)
    if multi_line and not whole_files:
        found = csv_records(spark, path).where("_begin > 0 or _index > 0")  # without the headers
        shape = ", ".join(f"`{c}` string" for c in df.columns)
        fields = F.from_csv(F.regexp_replace("record", "\r$", ""), shape, {k: str(v) for k, v in FORMAT.items() if k != "header"})
        landed = written(found.select(fields.alias("_fields"), "_file", "_begin", F.col("_index").alias("_row"))).select("_fields.*", "_file", "_begin", "_row")
    else:
        file, begin = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
        # the id rises by one from row to row of a split
        landed = written(df.select("*", file.alias("_file"), begin.alias("_begin"), F.monotonically_increasing_id().alias("_row")))
    splits = landed.groupBy("_file", "_begin").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_file", "_begin").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    starts = written(splits.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows"))
    placed = bounded_join(landed, starts, ["_file", "_begin"], starts.count(), 512)
    return placed.select(*df.columns, (F.col("_start") + F.col("_row") - F.col("_first")).cast("bigint").alias("doc_id"))


def read_labelled_csv(spark: SparkSession, path: str | None = None, multi_line: bool = True) -> DataFrame:
    """(doc_id, label, text) of a labelled CSV file."""
    return derive_documents(read_raw_csv(spark, path, multi_line))


def write_raw_csv(raw: DataFrame, path: str) -> None:
    """The labelled columns of `raw` as CSV part files that `read_raw_csv` reads back."""
    require_columns(raw, CSV_COLUMNS)
    raw.select(*[F.col(f"`{c}`") for c in CSV_COLUMNS]).write.options(**FORMAT).csv(path)
