"""Row-local encoding and scoring: equal to the grouped forms, and alike on a stream."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector

from wordloom import session
from wordloom.operators import classify, embedding, rowlocal
from wordloom.operators.encoding import encode
from wordloom.operators.vocabulary import build_vocab
from wordloom.plans.score import RowScorer, score_documents
from wordloom.plans.views import rnn_weights
from wordloom.operators.recurrent import RecurrentSpec
from wordloom.operators.documents import tokenize
from wordloom.session import written
from wordloom.streaming.ingest import stream_texts, write_scores

DIM = 8
RNG = np.random.default_rng(4)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    edges = spark.createDataFrame([(-1, ""), (-2, None), (-3, "!!"), (-4, "zzzz unseen")], "doc_id bigint, text string")
    return written(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(edges))


@pytest.fixture(scope="module")
def vocab(docs):
    return written(build_vocab(tokenize(docs), max_size=900))


@pytest.fixture(scope="module")
def matrix(spark, vocab):
    rows = [(r["idx"], [0.0] * DIM if r["idx"] == 0 else RNG.normal(size=DIM).astype("f4").tolist()) for r in vocab.collect()]
    return written(spark.createDataFrame(rows, "idx int, vector array<float>"))


@pytest.fixture(scope="module")
def weights(spark):
    return written(spark.createDataFrame([(i, RNG.normal(size=DIM).tolist(), float(i)) for i in range(4)], "label_id int, weight array<double>, bias double"))


def as_dict(df, *columns):
    return {r["doc_id"]: tuple(r[c] if not isinstance(r[c], list) else tuple(r[c]) for c in columns) for r in df.collect()}


@pytest.mark.parametrize("max_len", [3, 96])
def test_encode_rows_equals_encode(docs, vocab, max_len):
    tokens = tokenize(docs)
    rows = rowlocal.encode_rows(tokens, rowlocal.StaticVocabulary.of(vocab), max_len)
    assert as_dict(rows, "input_ids", "length") == as_dict(encode(tokens, vocab, max_len), "input_ids", "length")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("how", ["mean", "max", "meanmax"])
def test_pool_rows_equals_pool(docs, vocab, matrix, how):
    encoded = written(encode(tokenize(docs), vocab, 32))
    want = as_dict(embedding.pool(encoded, matrix, how, dim=DIM), "features")
    got = as_dict(rowlocal.pool_rows(encoded, rowlocal.StaticMatrix.of(matrix, DIM), how), "features")
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_tables_beyond_the_budget_are_refused(vocab, matrix, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 100)
    with pytest.raises(ValueError, match="encoding.encode"):
        rowlocal.StaticVocabulary.of(vocab)
    with pytest.raises(ValueError, match="embedding.pool"):
        rowlocal.StaticMatrix.of(matrix, DIM)


def ranked(df):
    return sorted((r["doc_id"], r["rank"], r["label_id"], round(r["prob"], 9)) for r in df.collect())


def test_score_rows_equals_score_documents(docs, vocab, matrix, weights):
    scorer = RowScorer.of(vocab, matrix, weights, dim=DIM, how="mean")
    assert ranked(scorer.score(docs)) == ranked(score_documents(docs, vocab, matrix, weights, how="mean", dim=DIM))


@pytest.mark.parametrize("kind", ["linear", "fitted", "recurrent"])
def test_stream_equals_batch_after_a_restart(spark, sf_dir, docs, vocab, matrix, weights, tmp_path, kind):
    options = {"how": "mean"}
    if kind == "linear":
        model = weights
    elif kind == "fitted":
        pooled = embedding.pool(encode(tokenize(docs), vocab), matrix, "mean", dim=DIM)
        model = LogisticRegression(maxIter=3).fit(pooled.selectExpr("cast(pmod(doc_id, 4) as double) as label", "features").withColumn("features", array_to_vector("features")))
    else:
        spec = RecurrentSpec("gru", 8, 1, False, "last", dtype="float64")
        wide = spark.createDataFrame([(r["idx"], (r["vector"] * 8)[:64]) for r in matrix.collect()], "idx int, vector array<float>")
        model, matrix, options = written(rnn_weights(spark, sf_dir, spec)), written(wide), {"spec": spec}
    scorer = RowScorer.of(vocab, matrix, model, dim=64 if kind == "recurrent" else DIM, **options)
    arriving, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    docs.where("doc_id % 2 = 0").coalesce(2).write.parquet(arriving)
    for more in (docs.where("doc_id % 2 <> 0").coalesce(1), None):
        query = write_scores(stream_texts(spark, arriving), scorer, out, state)
        query.awaitTermination(120)
        assert query.exception() is None
        if more is not None:  # the next query goes on from the state of this one
            more.write.mode("append").parquet(arriving)
    assert ranked(spark.read.parquet(out)) == ranked(scorer.score(docs))
    assert len(ranked(spark.read.parquet(out))) == 4 * docs.count()


def test_nothing(spark, docs, vocab, matrix, weights):
    assert RowScorer.of(vocab, matrix, weights, dim=DIM, how="mean").score(docs.limit(0)).count() == 0
