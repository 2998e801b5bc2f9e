"""Severity of toxicity by cumulative-link ordinal regression.

Method: log P(grade > k) / P(grade <= k) = w.x - t_k with one weight vector w for all ordered
thresholds t_0 < t_1 < ...  x holds log(1 + count) of the words (runs of letters, lower case,
and their first bytes, hashed to `BUCKETS`) that tell toxic labels from others.  The severity of a document is the
expected grade, the sum of P(grade > k).

Labels say toxic or not.  The grade of a labelled document is 0 without, else 1 plus the
number of `CUTS` quantiles of telling words, taken over the toxic rows, that it exceeds.

The fit reads at most `SAMPLE_ROWS` labelled rows, those with the smallest hash of their id;
that is a parameter.  All documents are scored, over whole texts.  Null text has no words, and
so the severity of the thresholds alone.  Labels that are null are left out; without toxic and
clean labels nothing is toxic.  Repeated labels of a document count as rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm import batches as B
from wordloom.session import written

SAMPLE_ROWS = 30_000
BUCKETS = 1 << 20
STEM_BYTES = 5
TELLING = 2_048  # features at most
LEAST_G = 22.0  # likelihood ratio statistic that a feature needs, about 4.7 standard errors
CUTS = (1 / 3, 2 / 3)  # quantiles of telling words between the grades above 0
PENALTY = 2e-6
STEPS = 400

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = _NOT_LETTER[128:] = False


def letter_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each run of letters and of its beginning, bounds by text)"""
    data, offsets = B.text_bytes(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last, bounds = B.word_spans(data, offsets, _NOT_LETTER)
    sums, down = B.prefix_hashes(data, fold=True), B.powers(len(data) + 1)[1][first]
    begin = np.minimum(first + STEM_BYTES, last)  # a shorter run is its own beginning
    hashes = np.empty(2 * len(first), np.uint64)
    hashes[0::2] = B.mix((sums[last] - sums[first]) * down)
    hashes[1::2] = B.mix((sums[begin] - sums[first]) * down + np.uint64(1))
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), 2 * bounds


def text_counts(column: pa.Array, telling: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of a column; only buckets marked in `telling` if given."""
    bucket, bounds = letter_runs(column)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if telling is not None:
        keep = telling[bucket]
        bucket, text = bucket[keep], text[keep]
    pairs, counts = np.unique(text * BUCKETS + bucket, return_counts=True)
    return pairs // BUCKETS, pairs % BUCKETS, counts


@dataclass
class Model:
    buckets: np.ndarray  # telling buckets, ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows with the smallest hashes."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    picked = known.select("doc_id", (F.col("toxic") > 0).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    # at most `rows` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def sample_counts(sample: DataFrame) -> DataFrame:
    """(toxic, buckets, counts): one row per labelled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "text"):
                text, bucket, count = text_counts(part.column("text"))
                bounds = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (bucket, count)]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), *lists], ["toxic", "buckets", "counts"])

    return sample.mapInArrow(run, "toxic boolean, buckets array<int>, counts array<int>")


def telling_buckets(rows: DataFrame) -> np.ndarray:
    """The buckets whose document shares differ most between toxic and clean rows."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        return np.zeros(0, np.int64)
    one, none = float(sizes[True]), float(sizes[False])
    each = rows.select("toxic", F.explode("buckets").alias("bucket"))
    seen = each.groupBy("bucket").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / (one + none)

    def excess(found: Column, expected: Column) -> Column:
        return F.when(found > 0, 2 * found * F.log(found / expected)).otherwise(F.lit(0.0))

    cells = [(a, share * one), (b, share * none), (one - a, (1 - share) * one), (none - b, (1 - share) * none)]
    scored = seen.withColumn("g", sum((excess(*c) for c in cells[1:]), excess(*cells[0]))).where(F.col("g") >= LEAST_G)
    top = scored.orderBy(F.desc("g"), "bucket").limit(TELLING).select("bucket").collect()
    return np.sort(np.array([r["bucket"] for r in top], np.int64))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int) -> Model:
    """Weights and thresholds that minimise the mean negative log-likelihood plus a ridge, by
    full gradient steps with adaptive rates; the gaps of the thresholds stay positive."""
    n, top = len(grade), int(grade.max())
    above = np.array([(grade > k).mean() for k in range(top)]).clip(1e-6, 1 - 1e-6)
    start = -np.log(above / (1 - above))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    theta = np.concatenate([np.zeros(width), start[:1], gaps])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, cuts = theta[:width], np.cumsum(np.concatenate([theta[width : width + 1], np.exp(theta[width + 1 :])]))
        score = np.bincount(row, value * w[column], n)
        # P(grade = g) = P(> g - 1) - P(> g); beyond the ends 1 and 0
        over = np.concatenate([np.ones((n, 1)), sigmoid(score[:, None] - cuts), np.zeros((n, 1))], axis=1)
        slope = over * (1 - over)
        i = np.arange(n)
        p = np.maximum(over[i, grade] - over[i, grade + 1], 1e-12)
        d_score = -(slope[i, grade] - slope[i, grade + 1]) / p / n
        d_cut = np.zeros((n, top + 2))
        d_cut[i, grade] += slope[i, grade] / p / n
        d_cut[i, grade + 1] -= slope[i, grade + 1] / p / n
        by_cut = d_cut.sum(axis=0)[1 : top + 1]
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate(
            [np.bincount(column, value * d_score[row], width) + 2 * PENALTY * w, tail[:1], tail[1:] * np.exp(theta[width + 1 :])]
        )
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    cuts = np.cumsum(np.concatenate([theta[width : width + 1], np.exp(theta[width + 1 :])]))
    return Model(np.zeros(0, np.int64), theta[:width], cuts)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model of a bounded sample of labelled rows; the driver sees their telling words."""
    counted = written(sample_counts(labelled_sample(docs, labels, rows)))
    buckets = telling_buckets(counted)
    if not len(buckets):
        return Model(buckets, np.zeros(0), np.array([40.0]))
    mine = counted.select("toxic", F.arrays_zip("buckets", "counts").alias("x")).select(
        "toxic", F.filter("x", lambda e: e["buckets"].isin(buckets.tolist())).alias("x")
    )
    got = mine.collect()  # at most `rows` rows of telling words
    toxic = np.array([r["toxic"] for r in got], bool)
    sizes = [len(r["x"]) for r in got]
    row = np.repeat(np.arange(len(got)), sizes)
    column = np.searchsorted(buckets, np.array([e["buckets"] for r in got for e in r["x"]], np.int64))
    count = np.array([e["counts"] for r in got for e in r["x"]], np.float64)
    share = np.bincount(column, toxic[row], len(buckets)) / np.maximum(np.bincount(column, minlength=len(buckets)), 1)
    heavy = np.bincount(row, count * (share[column] > 0.5), len(got))
    edges = np.quantile(heavy[toxic], CUTS)
    grade = np.where(toxic, 1 + (heavy[:, None] > edges).sum(axis=1), 0)
    grade = np.unique(grade, return_inverse=True)[1]  # without empty grades
    model = fit_ordinal(row, column, np.log1p(count), grade, len(buckets))
    return Model(buckets, model.weights, model.thresholds)


def severity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without the text, with expected_severity, grade (the most probable), p_toxic and
    toxic (p_toxic of one half or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TELLING weights
    keep = [c for c in docs.columns if c not in (text, "expected_severity", "grade", "p_toxic", "toxic")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        telling = np.zeros(BUCKETS, bool)
        telling[m.buckets] = True
        for batch in batches:
            for part in B.slices(batch, text):
                row, bucket, count = text_counts(part.column(text), telling)
                at = np.searchsorted(m.buckets, bucket)
                score = np.bincount(row, np.log1p(count) * m.weights[at], part.num_rows) if len(row) else np.zeros(part.num_rows)
                over = sigmoid(score[:, None] - m.thresholds)
                p = -np.diff(np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], axis=1), axis=1)
                made = [over.sum(axis=1), p.argmax(axis=1).astype(np.int32), over[:, 0], over[:, 0] >= 0.5]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], *map(pa.array, made)],
                    [*keep, "expected_severity", "grade", "p_toxic", "toxic"],
                )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    made = "expected_severity double, grade int, p_toxic double, toxic boolean"
    return docs.select(*keep, text).mapInArrow(run, f"{schema}, {made}" if keep else made)
