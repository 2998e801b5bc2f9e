"""Linear baseline against another solver; search with halving, resumed after a stop."""

import json
import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wordloom.operators import classify
from wordloom.plans import baseline, trials
from wordloom.session import written

RNG = np.random.default_rng(6)


@pytest.fixture(scope="module")
def table(spark):
    centre = RNG.normal(size=(3, 5))
    rows = [(i, i % 3, (centre[i % 3] + RNG.normal(size=5)).tolist()) for i in range(400)]
    return written(spark.createDataFrame(rows, "doc_id bigint, label int, features array<double>").repartition(7))


@pytest.mark.parametrize("l2", [0.5, 0.01])
def test_baseline_equals_another_solver(table, l2):
    got = baseline.fit_baseline(table, l2)
    assert got.slope < 1e-9 and got.losses == sorted(got.losses, reverse=True)
    ml = LogisticRegression(regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-13, family="multinomial")
    model = ml.fit(table.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features")))
    want = model.coefficientMatrix.toArray()
    rows = sorted(got.weights.collect())
    have = np.array([r["weight"] for r in rows])
    assert np.allclose(have - have.mean(0), want - want.mean(0), atol=1e-5)
    bias, other = np.array([r["bias"] for r in rows]), np.array(model.interceptVector)
    assert np.allclose(bias - bias.mean(), other - other.mean(), atol=1e-5)


def test_baseline_sums_follow_the_loss():
    x, y = np.concatenate([RNG.normal(size=(30, 3)), np.ones((30, 1))], axis=1), RNG.integers(0, 3, 30)
    theta, step = RNG.normal(size=(3, 4)), 1e-5
    n, _, gradient, hessian = baseline.sums_of(x, y, theta)
    assert n[0] == 30
    for i in range(12):
        move = np.zeros(12)
        move[i] = step
        up, down = (baseline.sums_of(x, y, theta + s * move.reshape(3, 4)) for s in (1, -1))
        assert (up[1][0] - down[1][0]) / (2 * step) == pytest.approx(gradient[i], abs=1e-5)
        assert np.allclose((up[2] - down[2]) / (2 * step), hessian.reshape(12, 12)[i], atol=1e-5)


def test_baseline_scores(table):
    weights = baseline.fit_baseline(table).weights
    scored = classify.with_probabilities(classify.linear_logits(table, weights)).collect()
    assert sum(r["y_pred"] == r["label"] for r in scored) > 300


def test_baseline_limits(spark, table):
    with pytest.raises(ValueError, match="parameters"):
        baseline.fit_baseline(table, classes=2000)
    with pytest.raises(ValueError, match="one width"):
        baseline.fit_baseline(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "label int, features array<double>"))
    same = spark.createDataFrame([(i % 2, [1.0, 2.0]) for i in range(10)], "label int, features array<double>")
    assert baseline.fit_baseline(same, 0.1).slope < 1e-9


SPACE = {"rate": (1e-4, 1.0), "hidden": [16, 32, 64], "kind": ["a", "b"]}


def objective(options, budget):
    return -abs(math.log10(options["rate"]) + 2) + options["hidden"] / 100 + (options["kind"] == "b") - 1 / budget


def test_samples_fill_the_space():
    points = trials.samples(SPACE, 60, seed=3)
    assert points == trials.samples(SPACE, 60, seed=3) != trials.samples(SPACE, 60, seed=4)
    places = sorted(math.log10(p["rate"]) / 4 + 1 for p in points)
    assert max(b - a for a, b in zip([0, *places], [*places, 1])) < 0.06
    for value in (16, 32, 64):
        assert 14 <= sum(p["hidden"] == value for p in points) <= 26


def test_search_halves_and_resumes(spark, tmp_path):
    asked = []

    def train(options, budget):
        asked.append(budget)
        return objective(options, budget)

    whole = sorted(map(tuple, trials.search(spark, str(tmp_path / "a"), train, SPACE).collect()))
    assert [asked.count(b) for b in (1, 3, 9)] == [30, 10, 4]
    assert [sum(r[1] == k and r[5] == "pruned" for r in whole) for k in (0, 1)] == [20, 6]

    def stopped(options, budget):
        if budget == 9:
            raise RuntimeError("stopped")
        return objective(options, budget)

    with pytest.raises(RuntimeError):
        trials.search(spark, str(tmp_path / "b"), stopped, SPACE)
    asked.clear()
    again = trials.search(spark, str(tmp_path / "b"), train, SPACE)
    assert asked == [9] * 4 and sorted(map(tuple, again.collect())) == whole
    best = trials.best_trial(again).first()
    assert best["score"] == max(r[4] for r in whole if r[5] == "done")
    assert objective(json.loads(best["options"]), 9) == best["score"]
    with pytest.raises(ValueError, match="another search"):
        trials.search(spark, str(tmp_path / "b"), train, SPACE, seed=1)


def test_search_ranks_nan_last(spark, tmp_path):
    def train(options, budget):
        return float("nan") if options["kind"] == "a" else options["rate"]

    rows = trials.search(spark, str(tmp_path / "n"), train, SPACE, n_trials=9).collect()
    assert all(json.loads(r["options"])["kind"] == "b" for r in rows if r["state"] == "done")


def test_search_over_the_baseline(spark, table, tmp_path):
    train_rows, held = table.where("doc_id % 4 <> 0"), table.where("doc_id % 4 = 0")

    def train(options, budget):
        fitted = baseline.fit_baseline(train_rows, options["l2"], steps=budget, classes=3)
        scored = classify.with_probabilities(classify.linear_logits(held, fitted.weights))
        return scored.agg(F.avg((F.col("y_pred") == F.col("label")).cast("double"))).first()[0]

    found = trials.search(spark, str(tmp_path / "l"), train, {"l2": (1e-4, 10.0)}, n_trials=4, budgets=(1, 4), keep=2)
    assert trials.best_trial(found).first()["score"] > 0.6
