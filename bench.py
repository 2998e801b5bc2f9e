"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_QUERIES (comma
list, default the headline list), BENCH_RUNS (default 2: the best run counts, so the first
one also warms the JVM)."""

from __future__ import annotations

import json
import os
import sys
import time

from wordloom.plans.catalog import REGISTRY
from wordloom.session import build_session

HEADLINE = [
    "tokenize",
    "stratified_split",
    "token_freq",
    "vocab_build",
    "encode",
    "encode_rows",
    "unk_rate",
    "training_batches",
    "embedding_matrix",
    "pool_meanmax",
    "most_similar_batch",
    "class_report",
    "mean_cross_entropy",
    "running_best",
    "early_stop",
    "leaderboard",
    "score_documents",
    "score_rows",
    "rnn_score",
    "rnn_score_bilstm",
    "batch_files",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            times[name] = round(min(spent, times.get(name, spent)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
