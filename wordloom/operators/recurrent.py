"""Recurrent scorer: LSTM or GRU with imported weights over encoded documents.

Spark partitions the rows; a task turns each Arrow batch into a few matrix products.  The
recurrence itself is the one thing built-in expressions cannot state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import BROADCAST_BYTES, fits_broadcast, ranked_join
from wordloom.settings import LAYER_EPS, PAD_IDX, RMS_EPS, VECTOR_DIM

# Rows per matrix product inside a task: bounds memory to rows * max_len * 4 * hidden.
ROWS_AT_ONCE = 256


@dataclass(frozen=True)
class RecurrentSpec:
    """Shape of the network.  Weights are looked up under the usual state names:
    rnn.weight_ih_l<k>[_reverse], rnn.weight_hh_..., rnn.bias_ih_..., rnn.bias_hh_...,
    classifier.weight, classifier.bias, and for norms embedding_norm.weight/.bias and
    feature_norm.weight/.bias.  Gate rows are ordered i,f,g,o (LSTM) and r,z,n (GRU)."""

    model_type: str = "lstm"
    hidden_size: int = 128
    num_layers: int = 1
    bidirectional: bool = True
    pooling: str = "last"
    use_rms_norm: bool = False
    use_layer_norm: bool = False
    pad_idx: int = PAD_IDX
    dtype: str = "float32"

    def __post_init__(self) -> None:
        if self.model_type not in ("lstm", "gru"):
            raise ValueError(f"unknown cell {self.model_type!r}: expected lstm or gru")
        if self.pooling not in ("last", "meanmax"):
            raise ValueError(f"unknown pooling {self.pooling!r}: expected last or meanmax")
        if self.use_rms_norm and self.use_layer_norm:
            raise ValueError("choose one norm, RMS or layer, not both")


def _sigmoid_of_negative(x: np.ndarray) -> np.ndarray:
    """The sigmoid of -x, in place.  The exponential takes a third of the time of np.tanh."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    return _sigmoid_of_negative(np.negative(x, out=x))


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= -2
    _sigmoid_of_negative(x)
    x *= 2
    x -= 1
    return x


def _norm(spec: RecurrentSpec, weights: dict, name: str, x: np.ndarray) -> np.ndarray:
    if spec.use_rms_norm:
        scale = np.sqrt(np.mean(x * x, axis=-1, keepdims=True) + RMS_EPS)
        return weights[f"{name}.weight"] * x / scale
    if spec.use_layer_norm:
        centred = x - x.mean(axis=-1, keepdims=True)
        scale = np.sqrt(np.mean(centred * centred, axis=-1, keepdims=True) + LAYER_EPS)
        return weights[f"{name}.weight"] * centred / scale + weights[f"{name}.bias"]
    return x


def _sweep(spec: RecurrentSpec, weights: dict, suffix: str, x: np.ndarray, place: np.ndarray, lengths: np.ndarray):
    """One direction of one layer over the inputs x[place].  Rows come longest first, so the rows that
    have a token at step t are a prefix; a backward sweep thus enters each row at its own last token."""
    rows, steps = place.shape
    size = spec.hidden_size
    lstm = spec.model_type == "lstm"
    w_ih, b_ih = weights[f"rnn.weight_ih_{suffix}"].T, weights[f"rnn.bias_ih_{suffix}"]
    w_hh, b_hh = weights[f"rnn.weight_hh_{suffix}"].T, weights[f"rnn.bias_hh_{suffix}"]
    if lstm:  # tanh(g) = 2 sigmoid(2 g) - 1: all gates by one call; doubling and signs are exact
        sign = np.repeat(np.array([-1, -1, -2, -1], dtype=x.dtype), size)
        w_ih, b_ih, w_hh = w_ih * sign, (b_ih + b_hh) * sign, w_hh * sign
    gates = x @ w_ih
    gates += b_ih
    h = np.zeros((rows, size), dtype=x.dtype)
    c = np.zeros_like(h)
    out = np.zeros((rows, steps, size), dtype=x.dtype)
    order = range(steps)
    for t in reversed(order) if suffix.endswith("_reverse") else order:
        live = int(np.searchsorted(-lengths, -t, side="left"))  # rows with length > t
        if live == 0:
            continue
        here, recur = gates[place[:live, t]], h[:live] @ w_hh
        if lstm:
            here += recur
            _sigmoid_of_negative(here)
            i, f, g, o = (here[:, k * size : (k + 1) * size] for k in range(4))
            g *= 2
            g -= 1
            g *= i
            c[:live] *= f
            c[:live] += g
            h[:live] = _tanh(c[:live].copy())
            h[:live] *= o
        else:
            recur += b_hh
            (xr, xz, xn), (hr, hz, hn) = np.split(here, 3, axis=1), np.split(recur, 3, axis=1)
            z = _sigmoid(xz + hz)
            h[:live] = (1.0 - z) * _tanh(xn + _sigmoid(xr + hr) * hn) + z * h[:live]
        out[:live, t] = h[:live]
    return out, h


def _logits(spec: RecurrentSpec, weights: dict, ids: np.ndarray, x: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Class scores of rows sorted by falling length, with the vectors x[place]; a vector that many
    positions share is normalised and meets the input weights once."""
    steps = int(lengths[0])
    place = place[:, :steps]
    x = _norm(spec, weights, "embedding_norm", x.astype(spec.dtype))
    mask = ids[:, :steps] != spec.pad_idx
    ways = ["", "_reverse"] if spec.bidirectional else [""]
    for layer in range(spec.num_layers):
        swept = [_sweep(spec, weights, f"l{layer}{way}", x, place, lengths) for way in ways]
        if layer + 1 < spec.num_layers:
            x = np.concatenate([out for out, _ in swept], axis=2).reshape(place.size, -1)
            place = np.arange(place.size).reshape(place.shape)
    if spec.pooling == "last":
        features = np.concatenate([final for _, final in swept], axis=1)
    else:
        real, pad = np.maximum(mask.sum(axis=1), 1)[:, None], ~mask
        parts: tuple[list, list] = ([], [])
        for out, _ in swept:
            out[pad] = 0.0
            parts[0].append(out.sum(axis=1) / real)
            out[pad] = -np.inf
            peak = out.max(axis=1)
            parts[1].append(np.where(np.isfinite(peak), peak, 0.0))
        features = np.concatenate([*parts[0], *parts[1]], axis=1)
    features = _norm(spec, weights, "feature_norm", features)
    return features @ weights["classifier.weight"].T + weights["classifier.bias"]


def _collect_weights(weights: DataFrame, dtype: str) -> dict[str, np.ndarray]:
    """The parameter table (name, shape, values) as arrays, behind a check of its size."""
    cells = weights.agg(F.sum(F.size("values")).alias("n")).head()["n"] or 0
    if cells * 8 > BROADCAST_BYTES:
        raise ValueError(f"{cells} network weights do not fit a broadcast")
    return {r["name"]: np.array(r["values"], dtype=dtype).reshape(r["shape"]) for r in weights.collect()}


def rnn_score(
    encoded: DataFrame,
    matrix: DataFrame,
    weights: DataFrame,
    spec: RecurrentSpec,
    key: str = "doc_id",
    dim: int = VECTOR_DIM,
    matrix_rows: int | None = None,
) -> DataFrame:
    """(key, logits ARRAY<DOUBLE>) for encoded rows (input_ids, length).

    A matrix within the broadcast budget (at most `matrix_rows` rows, counted when not
    given) goes to the tasks once and rows carry ids only.  Beyond it the vectors are joined
    in Spark and travel with the rows."""
    context = encoded.sparkSession.sparkContext
    params = context.broadcast(_collect_weights(weights, spec.dtype))
    bound = matrix.count() if matrix_rows is None else matrix_rows
    if fits_broadcast(matrix, bound, 8 * dim):
        rows = matrix.select("idx", "vector").limit(bound + 1).toPandas()
        if len(rows) > bound:
            raise ValueError(f"the matrix has more than {bound} rows")
        dense = np.zeros((int(rows["idx"].max()) + 1, dim), dtype=spec.dtype)
        dense[rows["idx"].to_numpy()] = np.stack(rows["vector"].to_numpy())
        table = context.broadcast(dense)
        source = encoded.select(key, "input_ids", "length")
    else:
        table = None
        source = _with_vectors(encoded, matrix, key, dim, bound)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values("length", ascending=False, kind="stable")
            for start in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[start : start + ROWS_AT_ONCE]
                ids = np.stack(part["input_ids"].to_numpy())
                lengths = np.maximum(part["length"].to_numpy(), 1)
                if table is not None:
                    words, place = np.unique(ids[:, : lengths[0]], return_inverse=True)
                    vectors, place = table.value[words], place.reshape(len(ids), -1)
                else:
                    vectors = np.concatenate([np.stack(list(v)) for v in part["vectors"]])
                    place = np.arange(len(vectors)).reshape(len(ids), -1)
                logits = _logits(spec, params.value, ids, vectors, place, lengths)
                yield pd.DataFrame({key: part[key].to_numpy(), "logits": list(logits.astype("float64"))})

    key_type = encoded.schema[key].dataType.simpleString()
    return source.mapInPandas(score, f"{key} {key_type}, logits array<double>")


def _with_vectors(encoded: DataFrame, matrix: DataFrame, key: str, dim: int, matrix_rows: int | None) -> DataFrame:
    """Adds `vectors`, one per position; at most `max_len` rows per key are gathered."""
    long = encoded.select(key, "length", F.posexplode_outer("input_ids").alias("pos", "idx"))
    joined = ranked_join(long, matrix.select("idx", "vector"), "idx", matrix_rows, 8 * dim)
    cells = F.sort_array(F.collect_list(F.struct("pos", "idx", "vector")))
    grouped = joined.groupBy(key).agg(F.any_value("length").alias("length"), cells.alias("c"))
    return grouped.select(key, "length", F.col("c.idx").alias("input_ids"), F.col("c.vector").alias("vectors"))
