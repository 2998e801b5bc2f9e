"""Quoted CSV records of large files, read in byte ranges.

A newline ends a record unless it lies inside quotes, and whether it does follows from the parity of
all quotes before it.  So each byte range first counts its quotes, a prefix over the ranges of a
file (one row each) gives the parity at every range's start, and then all ranges cut their
records at once.  Only the pieces of records that cross a range meet again.

Quotes stand around whole fields and are doubled inside them; a file with an odd number of quotes
is an error.  Empty lines between records are skipped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.session import fits_broadcast, written

SPLIT_ROW_BYTES = 256
WHOLE, OPENED, CONTINUED = 0, 1, 2  # a record; its first piece; a later piece

_SHAPE = "_file string, _begin bigint, _index bigint, kind int, record string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces of lines (_file, _begin, _inside, value) that come in the order of a range.

    `_index` counts the records that begin in a range."""
    split, index, parity, pieces, kind = None, 0, 0, [], WHOLE
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])

    def put(kind: int, number: int, text: str) -> None:
        for column, value in zip(out, (*split, number, kind, text)):
            column.append(value)

    def rows() -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        names = ["_file", "_begin", "_index", "kind", "record"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
        for column in out:
            column.clear()

    def close() -> None:
        """The end of a range: what is still open goes on in the next one."""
        nonlocal pieces
        if split is not None and pieces:
            put(kind if kind == CONTINUED else OPENED, index - 1, "\n".join(pieces))
        pieces = []

    for batch in batches:
        quotes = pc.count_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False)
        values = batch.column("value").to_pylist()
        begins = batch.column("_begin").to_numpy()
        files = batch.column("_file").dictionary_encode()
        codes, names = np.asarray(files.indices), files.dictionary.to_pylist()
        inside = batch.column("_inside").to_numpy(zero_copy_only=False)
        for i, value in enumerate(values):
            here = (names[codes[i]], int(begins[i]))
            if here != split:
                close()
                split, index, parity = here, 0, int(inside[i])
                kind = CONTINUED if parity else WHOLE
            if not parity and not pieces:
                if value in ("", "\r"):
                    continue
                kind = WHOLE
                index += 1
            pieces.append(value)
            parity ^= int(quotes[i]) & 1
            if not parity:
                put(kind, index - 1, "\n".join(pieces))
                pieces = []
        if len(out[0]) >= 4096:
            yield from rows()
    close()
    yield from rows()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _begin, _index, record): all records, headers included, named by the range in which
    they begin and their number in it; written."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_begin"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("_file", "_begin").agg(F.sum(quotes).alias("quotes"))
    upto = F.sum("quotes").over(Window.partitionBy("_file").orderBy("_begin"))  # a row per range
    splits = written(counts.select("_file", "_begin", ((upto - F.col("quotes")) % 2).cast("int").alias("_inside"), "quotes"))
    odd = splits.groupBy("_file").agg((F.sum("quotes") % 2).alias("odd")).where("odd = 1").first()
    if odd:
        raise ValueError(f"odd number of quotes in {odd['_file']}: its records can't be told apart in ranges")
    parities = splits.select("_file", "_begin", "_inside")
    if fits_broadcast(parities, parities.count(), SPLIT_ROW_BYTES):
        ordered = lines.join(F.broadcast(parities), ["_file", "_begin"])  # lines stay where and as they are
    else:
        numbered = lines.withColumn("_line", F.monotonically_increasing_id())
        ordered = numbered.join(parities.hint("merge"), ["_file", "_begin"]).sortWithinPartitions("_file", "_begin", "_line")
    cut = written(ordered.select("_file", "_begin", "_inside", "value").mapInArrow(_cut, _SHAPE))
    order = Window.partitionBy("_file").orderBy("_begin", F.desc("kind"))  # two pieces per range at most
    pieces = cut.where(F.col("kind") != WHOLE).withColumn("_number", F.count_if(F.col("kind") == OPENED).over(order))
    joined = pieces.groupBy("_file", "_number").agg(
        F.max(F.when(F.col("kind") == OPENED, F.struct("_begin", "_index"))).alias("at"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_begin", (-F.col("kind")).alias("k"), "record"))), lambda x: x["record"]), "\n").alias("record"),
    )
    stitched = joined.select("_file", "at._begin", "at._index", "record")
    whole = cut.where(F.col("kind") == WHOLE).select("_file", "_begin", "_index", "record")
    return written(whole.unionByName(stitched))
