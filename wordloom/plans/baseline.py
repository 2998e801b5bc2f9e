"""Linear baseline: multinomial logistic regression with an L2 penalty, by Newton steps.

A step is one pass: every task adds up the gradient and the Hessian of its rows and hands on
one row, a few tasks add those up, and the driver solves a system of the size of the model.  The
objective is the mean log loss plus l2 / 2 times the squared weights (not the biases)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_AT_ONCE = 2048
MERGERS = 16  # rows that reach the driver per step
MOST_PARAMETERS = 2048  # classes x (width + 1): a Hessian of 32 MB


@dataclass(frozen=True)
class Baseline:
    weights: DataFrame  # (label_id, weight, bias), as `classify.linear_logits` takes them
    losses: list[float]  # the objective after each accepted step
    slope: float  # largest part of the last gradient


def sums_of(x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> list[np.ndarray]:
    """[rows, loss, gradient, Hessian] summed over rows x (with a column of ones) of classes y."""
    classes, width = theta.shape
    scores = x @ theta.T
    scores -= scores.max(axis=1, keepdims=True)
    chance = np.exp(scores)
    chance /= chance.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(chance[np.arange(len(y)), y], 1e-300)).sum()
    error = chance.copy()
    error[np.arange(len(y)), y] -= 1
    hessian = np.empty((classes, width, classes, width))
    for k in range(classes):
        for m in range(k, classes):
            w = chance[:, k] * ((k == m) - chance[:, m])
            hessian[k, :, m] = (x * w[:, None]).T @ x
            hessian[m, :, k] = hessian[k, :, m].T
    return [np.array([float(len(y))]), np.array([loss]), (error.T @ x).ravel(), hessian.ravel()]


def _row(parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts)], pa.list_(pa.float64()))], ["sums"])


def summed(rows: DataFrame, theta: np.ndarray) -> list[np.ndarray]:
    classes, width = theta.shape
    sizes = [1, 1, theta.size, theta.size**2]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(n) for n in sizes]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                x = part.column("features").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width - 1)
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                for t, s in zip(total, sums_of(x, part.column("label").to_numpy().astype(np.int64), theta)):
                    t += s
        yield _row(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(sizes))
        for batch in batches:
            for i in range(batch.num_rows):
                total += batch.column("sums")[i].values.to_numpy(zero_copy_only=False)
        yield _row([total])

    few = rows.mapInArrow(add, "sums array<double>").repartition(MERGERS).mapInArrow(merge, "sums array<double>")
    total = np.sum([np.array(r["sums"]) for r in few.collect()], axis=0)  # MERGERS rows
    return np.split(total, np.cumsum(sizes)[:-1])


def fit_baseline(features: DataFrame, l2: float = 1e-3, classes: int | None = None, steps: int = 50, tolerance: float = 1e-9) -> Baseline:
    """`features`: (label INT from 0, features ARRAY<DOUBLE>), all of one width, without nulls."""
    rows = features.select("label", F.col("features").cast("array<double>").alias("features"))
    head = rows.agg(F.max(F.size("features")).alias("width"), F.min(F.size("features")).alias("least"), F.max("label").alias("last")).first()
    if head["width"] is None or head["width"] != head["least"]:
        raise ValueError("features must be vectors of one width")
    classes, width = classes or head["last"] + 1, head["width"] + 1
    if classes * width > MOST_PARAMETERS:
        raise ValueError(f"{classes * width} parameters: more than {MOST_PARAMETERS}")
    theta, move = np.zeros((classes, width)), None
    free = np.ones((classes, width))
    free[:, -1] = 0  # biases are not penalised
    losses: list[float] = []
    for _ in range(steps):
        n, loss, gradient, hessian = summed(rows, theta)
        objective = float(loss[0] / n[0] + l2 / 2 * (free * theta**2).sum())
        if losses and objective > losses[-1] + 1e-12 and np.abs(move).max() > tolerance:
            move = move / 2  # too far: half the way back
            theta = theta - move
            continue
        losses.append(objective)
        slope = gradient.reshape(classes, width) / n[0] + l2 * free * theta
        if np.abs(slope).max() < tolerance:
            break
        curve = hessian.reshape(theta.size, theta.size) / n[0] + np.diag((l2 * free).ravel())
        # adding one number to all biases changes nothing: the shortest solution
        move = -np.linalg.lstsq(curve, slope.ravel(), rcond=1e-12)[0].reshape(classes, width)
        theta = theta + move
    table = [(k, [float(v) for v in theta[k, :-1]], float(theta[k, -1])) for k in range(classes)]
    spark = features.sparkSession
    return Baseline(spark.createDataFrame(table, "label_id int, weight array<double>, bias double"), losses, float(np.abs(slope).max()))
