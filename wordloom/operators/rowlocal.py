"""Encoding and scoring that look at one row at a time, for tables and streams alike.

Vocabulary, vectors and class weights are static; they travel to the tasks behind a check of
their size, and every row is looked up where it is.  Nothing is grouped, joined or shuffled, so
a stream needs no state.  Beyond the budget there is no such form: `encoding.encode` and
`embedding.pool` join instead."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.embedding import POOLINGS
from wordloom.operators.encoding import VOCAB_ROW_BYTES
from wordloom.session import fits_broadcast
from wordloom.settings import MAX_LEN, PAD_IDX, UNK_IDX, VECTOR_DIM

ROWS_AT_ONCE = 256  # rows whose vectors are held together


@dataclass(frozen=True)
class StaticVocabulary:
    """The words in the order of their ids, for lookups inside tasks."""

    words: Broadcast  # (Arrow array of words, their ids)

    @classmethod
    def of(cls, vocab: DataFrame, vocab_rows: int | None = None) -> StaticVocabulary:
        if not fits_broadcast(vocab, vocab_rows, VOCAB_ROW_BYTES):
            raise ValueError("the vocabulary does not fit a broadcast; use encoding.encode")
        rows = vocab.select("token", "idx").orderBy("idx").toArrow()
        tokens = rows.column("token").combine_chunks()
        return cls(vocab.sparkSession.sparkContext.broadcast((tokens, rows.column("idx").to_numpy())))

    def ids(self, lists: pa.ListArray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids padded to `max_len`, lengths) of lists of words; a null list is empty."""
        words, idx = self.words.value
        offsets = np.asarray(lists.offsets, np.int64)
        sizes = np.where(np.asarray(lists.is_valid()), np.diff(offsets), 0)
        sizes = np.minimum(sizes, max_len)
        row = np.repeat(np.arange(len(lists)), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        tokens = lists.values.take(pa.array(offsets[:-1][row] + pos))
        found = pc.index_in(tokens, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
        out = np.full((len(lists), max_len), PAD_IDX, np.int32)
        out[row, pos] = np.where(found >= 0, idx[found], UNK_IDX)
        return out, np.maximum(sizes, 1).astype(np.int32)


@dataclass(frozen=True)
class StaticMatrix:
    """Word vectors by id, for lookups inside tasks."""

    rows: Broadcast

    @classmethod
    def of(cls, matrix: DataFrame, dim: int = VECTOR_DIM, matrix_rows: int | None = None) -> StaticMatrix:
        if not fits_broadcast(matrix, matrix_rows, 8 * dim):
            raise ValueError("the matrix does not fit a broadcast; use embedding.pool")
        rows = matrix.select("idx", "vector").toArrow()
        idx = rows.column("idx").to_numpy()
        dense = np.zeros((int(idx.max()) + 1 if len(idx) else 1, dim))
        dense[idx] = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return cls(matrix.sparkSession.sparkContext.broadcast(dense))

    def pooled(self, ids: np.ndarray, how: str) -> np.ndarray:
        """Mean, maximum or both over the real positions; a row without any pools the pad row."""
        table = self.rows.value
        real = ids != PAD_IDX
        real[~real.any(axis=1), 0] = True
        vectors = table[ids]
        parts = []
        if how != "max":
            parts.append(np.where(real[:, :, None], vectors, 0.0).sum(axis=1) / real.sum(axis=1)[:, None])
        if how != "mean":
            parts.append(np.where(real[:, :, None], vectors, -np.inf).max(axis=1))
        return np.concatenate(parts, axis=1)


def list_array(rows: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel()))


def _kept(df: DataFrame, columns: tuple[str, ...]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def encode_rows(
    tokenized: DataFrame, words: StaticVocabulary, max_len: int = MAX_LEN, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """(*keep, input_ids ARRAY<INT> of `max_len`, length INT >= 1), as `encoding.encode` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths = words.ids(batch.column("tokens"), max_len)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), list_array(ids), pa.array(lengths)], [*keep, "input_ids", "length"])

    return tokenized.select(*keep, "tokens").mapInArrow(run, _kept(tokenized, keep) + "input_ids array<int>, length int")


def pool_rows(
    encoded: DataFrame, matrix: StaticMatrix, how: str = "meanmax", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """(*keep, features ARRAY<DOUBLE>), as `embedding.pool` gives them."""
    if how not in POOLINGS:
        raise ValueError(f"how must be one of {', '.join(POOLINGS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = part.column("input_ids").flatten().to_numpy().reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), list_array(matrix.pooled(ids, how))], [*keep, "features"])

    return encoded.select(*keep, "input_ids").mapInArrow(run, _kept(encoded, keep) + "features array<double>")


def logit_rows(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds `logits`: features . weight + bias by class weights (label_id, weight, bias) that enter as
    constants of the plan, one row per class."""
    rows = sorted(weights.select("label_id", "weight", "bias").collect())  # one row per class
    scores = [
        F.aggregate(
            F.zip_with("features", F.lit([float(x) for x in r["weight"]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x
        ) + float(r["bias"])
        for r in rows
    ]
    return features.withColumn("logits", F.array(*scores))
