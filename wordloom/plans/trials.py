"""Search over training options: seeded space-filling samples and successive halving.

Every trial starts with the smallest budget; of each rung the best share goes on with a larger
one, the others are pruned.  The table of trials (one row per trial and rung) is kept in a folder
and written rung by rung, so a search that was stopped goes on where it was and ends alike."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.settings import SEED

N_TRIALS = 30
KEEP = 3  # one trial of so many goes on
SHAPE = "trial int, rung int, budget int, options string, score double, state string"

Options = dict[str, object]
Range = tuple[float, float]


def halton(index: int, base: int) -> float:
    """Digits of `index` mirrored behind the point: the places fill [0, 1) evenly."""
    out, step = 0.0, 1.0
    while index:
        step /= base
        out += step * (index % base)
        index //= base
    return out


def samples(space: Mapping[str, Sequence | Range], n: int, seed: int = SEED) -> list[Options]:
    """`n` points of a space: a list is chosen from, a pair of floats is a range on a log scale."""
    primes = [p for p in range(2, 200) if all(p % q for q in range(2, p))]
    if len(space) > len(primes):
        raise ValueError(f"more than {len(primes)} options")
    out = []
    for i in range(n):
        point: Options = {}
        for (name, values), prime in zip(sorted(space.items()), primes):
            place = (halton(i + 1, prime) + halton(seed % 9973 + 1, prime)) % 1.0
            if isinstance(values, tuple):
                low, high = values
                point[name] = math.exp(math.log(low) + place * (math.log(high) - math.log(low)))
            else:
                point[name] = values[min(len(values) - 1, int(place * len(values)))]
        out.append(point)
    return out


def search(
    spark: SparkSession,
    folder: str,
    train: Callable[[Options, int], float],
    space: Mapping[str, Sequence | Range],
    n_trials: int = N_TRIALS,
    budgets: Sequence[int] = (1, 3, 9),
    keep: int = KEEP,
    seed: int = SEED,
    parallelism: int = 2,
) -> DataFrame:
    """(trial, rung, budget, options, score, state) of all trials; `state` is 'kept', 'pruned', or
    'done' in the last rung.  `train(options, budget)` gives a score, the larger the better; a NaN
    is the worst.  Ties go to the earlier trial."""
    points = samples(space, n_trials, seed)
    alive = list(range(n_trials))
    rungs = []
    for rung, budget in enumerate(budgets):
        path = f"{folder.rstrip('/')}/rung-{rung}"
        known = _read(spark, path)
        if known is None:
            with ThreadPoolExecutor(parallelism) as threads:
                run = inheritable_thread_target(spark)(lambda t: train(points[t], budget))
                scores = dict(zip(alive, threads.map(run, alive)))
            ranked = sorted(alive, key=lambda t: (-scores[t] if scores[t] == scores[t] else math.inf, t))
            last = rung == len(budgets) - 1
            onward = set(ranked if last else ranked[: max(1, math.ceil(len(alive) / keep))])
            state = {t: "done" if last else "kept" if t in onward else "pruned" for t in alive}
            rows = [(t, rung, budget, json.dumps(points[t], sort_keys=True), float(scores[t]), state[t]) for t in alive]
            spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(path)
            known = spark.read.schema(SHAPE).parquet(path)
        elif [json.loads(r["options"]) for r in known.orderBy("trial").collect()] != [json.loads(json.dumps(points[t])) for t in alive]:
            raise ValueError(f"{path} holds trials of another search")
        rungs.append(known)
        alive = sorted(r["trial"] for r in known.where("state = 'kept'").collect())  # at most n_trials rows
    out = rungs[0]
    for more in rungs[1:]:
        out = out.unionByName(more)
    return out


def best_trial(trials: DataFrame) -> DataFrame:
    """The row of the best trial that went through all rungs."""
    score = F.when(~F.isnan("score"), F.col("score"))
    return trials.where("state = 'done'").orderBy(F.desc_nulls_last(score), "trial").limit(1)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A rung that was written to its end."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        return spark.read.schema(SHAPE).parquet(path)
    fs.delete(target.getParent(), True)  # a rung that broke off
    return None
