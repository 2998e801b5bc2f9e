import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom import session
from wordloom.functions import vectors as vx
from wordloom.operators import classify, embedding

RNG = np.random.default_rng(5)


def vector_table(spark, rows, name="token"):
    return spark.createDataFrame(
        [(k, [float(x) for x in v]) for k, v in rows], f"{name} {'string' if name == 'token' else 'int'}, vector array<float>"
    )


@pytest.fixture(scope="module")
def vocab(spark):
    words = ["<pad>", "<unk>"] + [f"w{i}" for i in range(2, 12)]
    return spark.createDataFrame([(i, w, 1) for i, w in enumerate(words)], "idx int, token string, freq bigint")


@pytest.fixture(scope="module")
def trained(spark):
    return vector_table(spark, [(f"w{i}", RNG.normal(size=6)) for i in (2, 3, 5, 7, 99)])


def test_matrix_rows(vocab, trained):
    rows = {r["idx"]: r for r in embedding.embedding_matrix(vocab, trained, 6).collect()}
    hits = {r["token"]: r["vector"] for r in trained.collect()}
    assert len(rows) == 12
    assert rows[0]["vector"] == [0.0] * 6
    assert {i for i, r in rows.items() if r["found"]} == {2, 3, 5, 7}
    for i in (2, 3, 5, 7):
        assert rows[i]["vector"] == hits[f"w{i}"]
    assert len({tuple(r["vector"]) for r in rows.values()}) == 12


def test_generated_vectors_are_normal_and_repeatable(spark, trained):
    vocab = spark.range(2000).select(F.col("id").cast("int").alias("idx"), F.concat(F.lit("g"), "id").alias("token"))
    one = embedding.embedding_matrix(vocab.repartition(3), trained, 7, seed=1).orderBy("idx").collect()
    two = embedding.embedding_matrix(vocab.repartition(9), trained, 7, seed=1).orderBy("idx").collect()
    other = embedding.embedding_matrix(vocab, trained, 7, seed=2).orderBy("idx").collect()
    assert one == two and one[1] != other[1]
    cells = np.array([r["vector"] for r in one[1:]])
    assert cells.shape == (1999, 7)
    assert abs(cells.mean()) < 0.002 and abs(cells.std() - 0.05) < 0.001
    assert np.abs(np.corrcoef(cells.T) - np.eye(7)).max() < 0.1


def test_coverage_and_membership(vocab, trained):
    assert embedding.coverage(vocab, trained).head().asDict() == {"found": 4, "vocab_size": 12, "coverage": 4 / 12}
    assert {r["idx"] for r in embedding.known_words(vocab, trained).collect()} == {2, 3, 5, 7}
    assert {r["idx"] for r in embedding.oov_words(vocab, trained).collect()} == set(range(12)) - {2, 3, 5, 7}


def test_coverage_of_nothing(vocab, trained):
    assert embedding.coverage(vocab.where("idx < 0"), trained).head()["coverage"] == 0.0


@pytest.mark.parametrize("how", ["mean", "max", "meanmax"])
def test_pool_equals_numpy(spark, vocab, trained, how, budget):
    rng = random.Random(2)
    matrix = embedding.embedding_matrix(vocab, trained, 6)
    table = np.zeros((12, 6))
    for r in matrix.collect():
        table[r["idx"]] = r["vector"]
    docs = [[], [2], [3, 3, 1], [1] * 8] + [[rng.randint(1, 11) for _ in range(rng.randint(0, 8))] for _ in range(40)]
    encoded = spark.createDataFrame(
        [(i, d + [0] * (8 - len(d)), max(1, len(d)), 3) for i, d in enumerate(docs)],
        "doc_id bigint, input_ids array<int>, length int, label int",
    )
    rows = embedding.pool(encoded, matrix, how, keep=("label",), dim=6).collect()
    assert len(rows) == len(docs)
    for r in rows:
        v = table[docs[r["doc_id"]]] if docs[r["doc_id"]] else np.zeros((1, 6))
        parts = {"mean": [v.mean(0)], "max": [v.max(0)], "meanmax": [v.mean(0), v.max(0)]}[how]
        assert np.allclose(r["features"], np.concatenate(parts), atol=1e-9)
        assert r["label"] == 3


def test_pool_rejects_other_names(spark, vocab, trained):
    with pytest.raises(ValueError):
        embedding.pool(vocab, trained, "last")


@pytest.mark.parametrize("kind", ["rms", "layer"])
def test_norms_equal_numpy(spark, kind):
    rows = RNG.normal(size=(20, 9)).astype("float32")
    rows[0] = 0.0
    df = vector_table(spark, list(enumerate(rows)), "idx")
    got = {r["idx"]: r["vector"] for r in embedding.normalise(df, "vector", kind).collect()}
    x = rows.astype("float64")
    if kind == "layer":
        x = x - x.mean(1, keepdims=True)
    eps = {"rms": 1e-8, "layer": 1e-5}[kind]
    expected = x / np.sqrt((x * x).mean(1, keepdims=True) + eps)
    assert np.allclose([got[i] for i in range(20)], expected, atol=1e-9)


def test_norm_weights(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 0.5, 1.0], [1.0, 1.0, -1.0])], "v array<double>, w array<double>, b array<double>")
    got = df.select(vx.layer_norm(F.col("v"), F.col("w"), F.col("b")), vx.rms_norm(F.col("v"), F.col("w"))).head()
    x, w, b = np.array([1.0, 2, 3]), np.array([2, 0.5, 1]), np.array([1, 1, -1.0])
    assert np.allclose(got[0], (x - 2) / np.sqrt(2 / 3 + 1e-5) * w + b)
    assert np.allclose(got[1], w * x / np.sqrt((x * x).mean() + 1e-8))
    with pytest.raises(ValueError):
        embedding.normalise(df, "v", "batch")


def python_near(rows, word, n):
    q = rows[word] / np.linalg.norm(rows[word])
    scores = {k: round(float(v @ q / np.linalg.norm(v)), 9) for k, v in rows.items() if k != word}
    return sorted(scores, key=lambda k: (-scores[k], k))[:n]


def test_most_similar(spark):
    rows = {f"w{i}": RNG.normal(size=5).astype("float32").astype("float64") for i in range(60)}
    rows["w7"] = rows["w3"] * 2  # same direction: similarity 1
    rows["w1"] = rows["w9"]  # copies tie
    df = vector_table(spark, rows.items())
    for word in ("w3", "w20"):
        got = embedding.most_similar(df, word, 5).orderBy("rank").collect()
        assert [r["token"] for r in got] == python_near(rows, word, 5)
    assert embedding.most_similar(df, "w3", 1).head()["token"] == "w7"
    with pytest.raises(Exception, match="no vector"):
        embedding.most_similar(df, "absent").collect()


def test_most_similar_batch_over_many_blocks(spark):
    rows = {f"w{i}": RNG.normal(size=5).astype("float32").astype("float64") for i in range(60)}
    for i in range(40, 60):
        rows[f"w{i}"] = rows["w0"]  # a third of all rows are copies
    df = vector_table(spark, rows.items())
    got = {}
    for r in embedding.most_similar_batch(df, df, 4, query_block=7, vector_block=16).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["token"])
    assert got == {w: python_near(rows, w, 4) for w in rows}


def test_softmax_argmax_cross_entropy(spark):
    logits = RNG.normal(scale=300, size=(30, 4))
    logits[0] = 5.0
    df = spark.createDataFrame([(i, i % 4, [float(x) for x in v]) for i, v in enumerate(logits)], "id int, label int, logits array<double>")
    rows = df.select("id", vx.softmax(F.col("logits")).alias("p"), vx.argmax(F.col("logits")).alias("a"), vx.cross_entropy(F.col("logits"), F.col("label")).alias("ce")).collect()
    for r in rows:
        x = logits[r["id"]]
        p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert np.allclose(r["p"], p) and math.isclose(sum(r["p"]), 1.0)
        assert r["a"] == int(np.argmax(x))
        assert math.isclose(r["ce"], math.log(np.exp(x - x.max()).sum()) + x.max() - x[r["id"] % 4], abs_tol=1e-9)


def test_linear_logits(spark):
    w, b, x = RNG.normal(size=(3, 5)), RNG.normal(size=3), RNG.normal(size=(8, 5))
    weights = spark.createDataFrame([(i, w[i].tolist(), float(b[i])) for i in (2, 0, 1)], "label_id int, weight array<double>, bias double")
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(8)], "id int, features array<double>")
    scored = classify.linear_logits(df, weights)
    for r in scored.collect():
        assert np.allclose(r["logits"], w @ x[r["id"]] + b)
    assert "NestedLoop" not in scored._jdf.queryExecution().executedPlan().toString()


def test_ranked_probs_break_ties_by_class(spark):
    df = spark.createDataFrame([(1, [0.1, 0.4, 0.1, 0.4])], "doc_id bigint, probs array<double>")
    got = [(r["rank"], r["label_id"], r["label_name"]) for r in classify.ranked_probs(df).collect()]
    assert got == [(1, 1, "Sports"), (2, 3, "Sci/Tech"), (3, 0, "World"), (4, 2, "Business")]


def test_zero_vectors_have_no_neighbours(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("zero", [0.0, 0.0]), ("c", [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "token string, vector array<float>")
    assert [r["token"] for r in embedding.most_similar(df, "a", 5).orderBy("rank").collect()] == ["b", "c"]
    assert embedding.most_similar(df, "zero", 5).count() == 0
    found = embedding.most_similar_batch(df, df, 5, query_block=2).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append(r["token"])
    assert got == {"a": ["b", "c"], "b": ["a", "c"], "c": ["b", "a"]}


def test_batch_search_has_one_plan_for_any_number_of_queries(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("token"), F.array(F.col("id").cast("float"), F.lit(1.0)).alias("vector"))

    def nodes(queries):
        return embedding.most_similar_batch(df, queries, query_block=2, vector_block=9)._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert nodes(df.where("token < 3")) == nodes(df.where("token < 400"))


def test_batch_search_in_many_blocks(spark):
    """Blocks of any size give the same rows; null and zero vectors take no part."""
    rows = [(f"w{i}", None if i == 7 else [0.0] * 5 if i == 9 else RNG.normal(size=5).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "token string, vector array<double>").repartition(6)
    some = df.where("token like '%3%' or token in ('w7', 'w9')")
    known = {w: np.array(v) for w, v in rows if w not in ("w7", "w9")}
    for sizes in ((4096, 8192), (3, 20), (50, 1)):
        got = {}
        for r in embedding.most_similar_batch(df, some, 4, query_block=sizes[0], vector_block=sizes[1]).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["token"])
        assert got == {w: python_near(known, w, 4) for w in known if "3" in w}
    assert embedding.most_similar_batch(df, df.limit(0)).count() == 0
    assert embedding.most_similar_batch(df.limit(0), df).count() == 0


@pytest.mark.parametrize("how", ["mean", "meanmax"])
def test_pool_with_a_hot_word_beyond_the_budget(spark, monkeypatch, how):
    """A word with a third of all tokens travels with the frequent ranks; the shuffle sees rare words only."""
    rng, dim = np.random.default_rng(8), 4
    table = np.concatenate([np.zeros((1, dim)), rng.normal(size=(199, dim)).astype("f4")])
    docs = [[2 if rng.random() < 0.34 else int(rng.integers(3, 200)) for _ in range(30)] for _ in range(120)] + [[]]
    encoded = spark.createDataFrame([(i, d + [0] * (30 - len(d))) for i, d in enumerate(docs)], "doc_id bigint, input_ids array<int>")
    matrix = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(table)], "idx int, vector array<float>")
    monkeypatch.setattr(session, "BROADCAST_BYTES", 20 * (8 * dim + 96))  # twenty ranks
    pooled = embedding.pool(encoded, matrix, how, dim=dim)
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    for r in pooled.collect():
        x = table[docs[r["doc_id"]] or [0]].astype(float)
        assert np.allclose(r["features"], np.concatenate([x.mean(0), x.max(0)][: 2 if how == "meanmax" else 1]))
    long = encoded.select(F.explode(F.filter("input_ids", lambda i: i != 0)).alias("idx"))
    far = long.where("idx >= 20").groupBy("idx").count().agg(F.max("count"), F.sum("count")).first()
    assert far[0] < 0.02 * far[1]


@pytest.mark.parametrize("how", ["mean", "max", "meanmax"])
def test_pool_keeps_vectors_out_of_the_rows(spark, how):
    """Within the budget no row per token is made, which a grouping would sort and spill; keys and words that
    repeat, ids without a vector and rows without any known id count as in a join."""
    matrix = [(0, [0.0, 0.0]), (1, [1.0, -2.0]), (2, [3.0, 4.0]), (2, [5.0, -6.0])]
    rows = [(7, [1, 2]), (7, [1, 0]), (8, [0, 0]), (9, [3, -1]), (None, [2]), (None, [1, 9]), (10, None), (11, [1, None])]
    encoded = spark.createDataFrame(rows, "doc_id bigint, input_ids array<int>")
    table = spark.createDataFrame(matrix, "idx int, vector array<float>")
    pooled = embedding.pool(encoded, table, how, dim=2)
    assert "Generate" not in pooled._jdf.queryExecution().executedPlan().toString()
    want = {}
    for key, ids in rows:
        real = [i for i in ids or [] if i]
        for i in real or [0] * (ids is not None):
            want.setdefault(key, []).extend(v for idx, v in matrix if idx == i)
    want = {k: np.array(v) for k, v in want.items() if v}
    got = {r["doc_id"]: r["features"] for r in pooled.collect()}
    assert got.keys() == want.keys() == {7, 8, None, 11}
    for key, x in want.items():
        parts = {"mean": [x.mean(0)], "max": [x.max(0)], "meanmax": [x.mean(0), x.max(0)]}[how]
        assert np.allclose(got[key], np.concatenate(parts))
