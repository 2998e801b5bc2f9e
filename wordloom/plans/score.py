"""Batch scoring: a table of texts to ranked class probabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators import classify, embedding, recurrent, rowlocal
from wordloom.operators.documents import tokenize
from wordloom.operators.encoding import encode
from wordloom.operators.recurrent import RecurrentSpec
from wordloom.session import spread
from wordloom.settings import LABEL_NAMES, MAX_LEN, VECTOR_DIM


def text_features(
    docs: DataFrame,
    vocab: DataFrame,
    matrix: DataFrame,
    how: str = "meanmax",
    max_len: int = MAX_LEN,
    lower: bool = True,
    dim: int = VECTOR_DIM,
    vocab_rows: int | None = None,
) -> DataFrame:
    """(doc_id, features) of (doc_id, text)."""
    tokens = tokenize(spread(docs.select("doc_id", "text"), "doc_id"), lower=lower)
    encoded = encode(tokens, vocab, max_len, vocab_rows=vocab_rows)
    return embedding.pool(encoded, matrix, how, dim=dim, matrix_rows=vocab_rows)


def score_features(features: DataFrame, model: DataFrame | Transformer) -> DataFrame:
    """Adds `probs`: by linear class weights (a table) or by a fitted MLlib classifier."""
    if isinstance(model, Transformer):
        vectors = features.select("doc_id", array_to_vector("features").alias("features"))
        return model.transform(vectors).select("doc_id", vector_to_array("probability").alias("probs"))
    return classify.with_probabilities(classify.linear_logits(features, model)).select("doc_id", "probs")


def score_documents(
    docs: DataFrame,
    vocab: DataFrame,
    matrix: DataFrame,
    model: DataFrame | Transformer,
    names: list[str] = LABEL_NAMES,
    **options: object,
) -> DataFrame:
    """(doc_id, rank, label_id, label_name, prob) for every document and class."""
    features = text_features(docs, vocab, matrix, **options)
    return classify.ranked_probs(score_features(features, model), "doc_id", names)


def score_documents_rnn(
    docs: DataFrame,
    vocab: DataFrame,
    matrix: DataFrame,
    weights: DataFrame,
    spec: RecurrentSpec,
    names: list[str] = LABEL_NAMES,
    max_len: int = MAX_LEN,
    lower: bool = True,
    dim: int = VECTOR_DIM,
    vocab_rows: int | None = None,
) -> DataFrame:
    """The same by a recurrent network with imported weights: text to tokens, ids, scores and
    ranked classes."""
    tokens = tokenize(spread(docs.select("doc_id", "text"), "doc_id"), lower=lower)
    encoded = encode(tokens, vocab, max_len, vocab_rows=vocab_rows)
    scored = recurrent.rnn_score(encoded, matrix, weights, spec, dim=dim, matrix_rows=vocab_rows)
    return classify.ranked_probs(classify.with_probabilities(scored).select("doc_id", "probs"), "doc_id", names)


@dataclass(frozen=True)
class RowScorer:
    """Texts to ranked classes, row by row: the same for a table and for a stream.

    `model`: linear class weights (a table), a fitted MLlib classifier, or the parameter table of
    a recurrent network, then with its `spec`."""

    words: rowlocal.StaticVocabulary
    matrix: DataFrame
    vectors: rowlocal.StaticMatrix
    model: DataFrame | Transformer
    spec: RecurrentSpec | None = None
    names: tuple[str, ...] = tuple(LABEL_NAMES)
    how: str = "meanmax"
    max_len: int = MAX_LEN
    lower: bool = True
    dim: int = VECTOR_DIM

    @classmethod
    def of(
        cls, vocab: DataFrame, matrix: DataFrame, model: DataFrame | Transformer, dim: int = VECTOR_DIM, vocab_rows: int | None = None, **options: object
    ) -> RowScorer:
        words = rowlocal.StaticVocabulary.of(vocab, vocab_rows)
        return cls(words, matrix, rowlocal.StaticMatrix.of(matrix, dim, vocab_rows), model, dim=dim, **options)

    def score(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, rank, label_id, label_name, prob) of (key, text)."""
        tokens = tokenize(docs.select(key, "text"), lower=self.lower)
        encoded = rowlocal.encode_rows(tokens, self.words, self.max_len, (key,))
        if self.spec is not None:
            logits = recurrent.rnn_score(encoded, self.matrix, self.model, self.spec, key, self.dim)
        else:
            features = rowlocal.pool_rows(encoded, self.vectors, self.how, (key,))
            if isinstance(self.model, Transformer):
                out = self.model.transform(features.select(key, array_to_vector("features").alias("features")))
                return classify.ranked_probs(out.select(key, vector_to_array("probability").alias("probs")), key, list(self.names))
            logits = rowlocal.logit_rows(features, self.model)
        return classify.ranked_probs(classify.with_probabilities(logits), key, list(self.names))
