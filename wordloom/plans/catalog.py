"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import vectors as vx
from wordloom.operators import (
    classify,
    documents,
    embedding,
    encoding,
    metrics,
    recurrent,
    rowlocal,
    runs,
    splitting,
    vocabulary,
)
from wordloom.operators.recurrent import RecurrentSpec
from wordloom.plans import baseline, fit, score, skipgram, trials, views
from wordloom.plans.prepare import Prepared, prepare, split_tokens, train_vocab
from wordloom.session import shared_path, spread, written
from wordloom.settings import CSV_COLUMNS, LABEL_NAMES, PATIENCE
from wordloom.sources import batches, labelled
from wordloom.sources import runs as run_files
from wordloom.sources.vectors import model_vectors, read_vectors, write_vectors

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Ten classes occur in the embeddings table.
CLASS_IDS = list(range(10))
CLASS_NAMES = [f"class_{c}" for c in CLASS_IDS]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _prepared(spark: SparkSession, sf: str, **options) -> Prepared:
    return prepare(views.labelled_documents(spark, sf), **options)


def _tokenized(spark: SparkSession, sf: str) -> DataFrame:
    return split_tokens(views.labelled_documents(spark, sf))


def _all_tokens(spark: SparkSession, sf: str, lower: bool = True) -> DataFrame:
    docs = views.load(spark, sf, "documents").select("doc_id", "text")
    return documents.tokenize(spread(docs, "doc_id"), lower=lower)


def _round_cells(df: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """Long form (key, dim, value) of a vector column."""
    return df.select(key, F.posexplode(column).alias("dim", "x")).select(
        key, "dim", F.round(F.col("x").cast("double"), 6).alias(value)
    )


# --- projections -------------------------------------------------------------------


@query
def na_decode(spark: SparkSession, sf: str) -> DataFrame:
    return documents.decode_missing(views.raw_documents(spark, sf), ["title", "description"]).select(
        "doc_id", "title", "description"
    )


@query
def label_shift(spark: SparkSession, sf: str) -> DataFrame:
    return views.raw_derived(spark, sf).select("doc_id", "label")


@query
def text_concat(spark: SparkSession, sf: str) -> DataFrame:
    return views.raw_derived(spark, sf).select("doc_id", "text")


@query
def label_name(spark: SparkSession, sf: str) -> DataFrame:
    emb = views.load(spark, sf, "embeddings").select("vec_id", "label")
    return documents.label_names(emb)


@query
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return _token_lines(_all_tokens(spark, sf))


@query
def tokenize_cased(spark: SparkSession, sf: str) -> DataFrame:
    return _token_lines(_all_tokens(spark, sf, lower=False))


def _token_lines(tokenized: DataFrame) -> DataFrame:
    return tokenized.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


# --- split, vocabulary, encoding -----------------------------------------------------


@query
def split_quotas(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_quotas(views.labelled_documents(spark, sf))


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.stratified_split(views.labelled_documents(spark, sf)).select("doc_id", "label", "split")


@query
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _prepared(spark, sf).sizes()


@query
def token_freq(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.token_freq(_tokenized(spark, sf).where(F.col("split") == "train"))


@query
def vocab_build(spark: SparkSession, sf: str) -> DataFrame:
    return train_vocab(_tokenized(spark, sf))


@query
def vocab_build_capped(spark: SparkSession, sf: str) -> DataFrame:
    return train_vocab(_tokenized(spark, sf), max_vocab_size=1000, min_freq=5)


@query
def w2v_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.frequent_words(_all_tokens(spark, sf))


@query
def encode(spark: SparkSession, sf: str) -> DataFrame:
    return _prepared(spark, sf).encoded.select(
        "doc_id", "label", "split", "length", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids")
    )


@query
def encode_rows(spark: SparkSession, sf: str) -> DataFrame:
    """`encode` without a grouping: every row looked up where it is."""
    prepared = _prepared(spark, sf)
    words = rowlocal.StaticVocabulary.of(prepared.vocab, prepared.vocab_rows)
    encoded = rowlocal.encode_rows(prepared.tokenized, words, keep=("doc_id", "label", "split"))
    return encoded.select(
        "doc_id", "label", "split", "length", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids")
    )


@query
def unk_rate(spark: SparkSession, sf: str) -> DataFrame:
    prepared = _prepared(spark, sf)
    return encoding.unknown_rate(prepared.tokenized, prepared.vocab, vocab_rows=prepared.vocab_rows)


@query
def document_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded length of every document, and known and unknown tokens within that length (`unk_rate`
    counts all tokens)."""
    encoded = _prepared(spark, sf).encoded
    real = F.filter("input_ids", lambda i: i != 0)
    unknown = F.size(F.filter("input_ids", lambda i: i == 1))
    return encoded.select(
        "doc_id",
        "length",
        (F.size(real) - unknown).cast("bigint").alias("known_tokens"),
        unknown.cast("bigint").alias("unk_tokens"),
    )


@query
def pad_mask_stats(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.mask_stats(_prepared(spark, sf).encoded)


@query
def training_batches(spark: SparkSession, sf: str) -> DataFrame:
    split = splitting.stratified_split(views.labelled_documents(spark, sf))
    return splitting.training_batches(split.where(F.col("split") == "train"))


@query
def validation_batches(spark: SparkSession, sf: str) -> DataFrame:
    split = splitting.stratified_split(views.labelled_documents(spark, sf))
    return splitting.training_batches(split.where(F.col("split") == "val"), shuffle=False)


# --- vectors -------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> tuple[Prepared, DataFrame]:
    prepared = _prepared(spark, sf)
    return prepared, views.word_vectors(spark, sf, prepared.vocab)


def _matrix(spark: SparkSession, sf: str) -> tuple[Prepared, DataFrame]:
    prepared, vectors = _vectors(spark, sf)
    return prepared, embedding.embedding_matrix(prepared.vocab, vectors, views.DIM)


@query
def embedding_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """One row per word; the vector as a list of millionths."""
    _, matrix = _matrix(spark, sf)
    millionths = F.transform("vector", lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string"))
    return matrix.select("idx", "token", "found", F.array_join(millionths, " ").alias("vector"))


@query
def vocab_with_vector(spark: SparkSession, sf: str) -> DataFrame:
    prepared, vectors = _vectors(spark, sf)
    return embedding.known_words(prepared.vocab, vectors).select("idx", "token")


@query
def vocab_oov(spark: SparkSession, sf: str) -> DataFrame:
    prepared, vectors = _vectors(spark, sf)
    return embedding.oov_words(prepared.vocab, vectors).select("idx", "token")


@query
def embedding_coverage(spark: SparkSession, sf: str) -> DataFrame:
    prepared, vectors = _vectors(spark, sf)
    out = embedding.coverage(prepared.vocab, vectors)
    return out.withColumn("coverage", F.round("coverage", 6))


def _pooled(spark: SparkSession, sf: str, how: str) -> DataFrame:
    prepared, matrix = _matrix(spark, sf)
    return embedding.pool(prepared.encoded, matrix, how, dim=views.DIM, matrix_rows=prepared.vocab_rows)


@query
def pool_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _round_cells(_pooled(spark, sf, "mean"), "doc_id", "features", "x")


@query
def pool_max(spark: SparkSession, sf: str) -> DataFrame:
    return _round_cells(_pooled(spark, sf, "max"), "doc_id", "features", "x")


@query
def pool_meanmax(spark: SparkSession, sf: str) -> DataFrame:
    return _round_cells(_pooled(spark, sf, "meanmax"), "doc_id", "features", "x")


def _normed(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    emb = views.load(spark, sf, "embeddings").select("vec_id", "embedding")
    return _round_cells(embedding.normalise(emb, "embedding", kind), "vec_id", "embedding", "x")


@query
def rms_norm(spark: SparkSession, sf: str) -> DataFrame:
    return _normed(spark, sf, "rms")


@query
def layer_norm(spark: SparkSession, sf: str) -> DataFrame:
    return _normed(spark, sf, "layer")


@query
def most_similar(spark: SparkSession, sf: str) -> DataFrame:
    emb = views.load(spark, sf, "embeddings").select("vec_id", "embedding")
    near = embedding.most_similar(emb, 0, 5, "vec_id", "embedding")
    return near.select("rank", "vec_id", F.round("similarity", 6).alias("similarity"))


@query
def most_similar_batch(spark: SparkSession, sf: str) -> DataFrame:
    emb = views.load(spark, sf, "embeddings").select("vec_id", "embedding")
    near = embedding.most_similar_batch(emb, emb, 5, "vec_id", "embedding")
    return near.select("query", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


# --- class scores and metrics ----------------------------------------------------------


@query
def linear_logits(spark: SparkSession, sf: str) -> DataFrame:
    scored = views.centroid_scores(spark, sf)
    return scored.select("vec_id", F.posexplode("logits").alias("label_id", "logit"))


@query
def argmax_class(spark: SparkSession, sf: str) -> DataFrame:
    return views.predictions(spark, sf)


@query
def softmax_probs(spark: SparkSession, sf: str) -> DataFrame:
    probs = views.centroid_scores(spark, sf).select("vec_id", vx.softmax(F.col("logits")).alias("probs"))
    return probs.select("vec_id", F.posexplode("probs").alias("label_id", "p")).select(
        "vec_id", "label_id", F.round("p", 6).alias("prob")
    )


@query
def ranked_probs(spark: SparkSession, sf: str) -> DataFrame:
    scored = classify.with_probabilities(views.centroid_scores(spark, sf))
    ranked = classify.ranked_probs(scored, "vec_id", CLASS_NAMES)
    return ranked.withColumn("prob", F.round("prob", 6))


@query
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.accuracy(views.predictions(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.class_report(views.predictions(spark, sf)), "precision", "recall", "f1")


@query
def class_report_avgs(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.report_averages(views.predictions(spark, sf)), "precision", "recall", "f1")


@query
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.macro_f1(views.predictions(spark, sf)), "macro_f1")


@query
def confusion_long(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(views.predictions(spark, sf))


@query
def confusion_wide(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_wide(views.predictions(spark, sf), CLASS_IDS)


@query
def mean_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.mean_cross_entropy(views.centroid_scores(spark, sf)), "loss")


# --- run logs --------------------------------------------------------------------------


def _nullable_int(df: DataFrame, column: str = "best_epoch") -> DataFrame:
    """As DOUBLE: clients differ in how they hand out integers with gaps."""
    return df.withColumn(column, F.col(column).cast("double"))


@query
def run_best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    history = views.run_history(spark, sf)
    return _nullable_int(_rounded(runs.best_epoch(history), "train_val_macro_f1_gap"))


@query
def running_best(spark: SparkSession, sf: str) -> DataFrame:
    marked = runs.running_best(views.run_history(spark, sf))
    return marked.select("run_name", "epoch", "best_before", "improved")


@query
def early_stop(spark: SparkSession, sf: str) -> DataFrame:
    return _nullable_int(runs.early_stop(views.run_history(spark, sf), PATIENCE))


@query
def checkpoint_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return runs.checkpoint_epoch(views.run_history(spark, sf), PATIENCE)


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    best = runs.best_epoch(views.run_history(spark, sf))
    return best.select("run_name", "best_val_macro_f1", "best_epoch", F.round("train_val_macro_f1_gap", 6).alias("train_val_macro_f1_gap"))


@query
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return _nullable_int(runs.leaderboard(_summary(spark, sf), views.run_overrides(spark, sf)))


@query
def leaderboard_series(spark: SparkSession, sf: str) -> DataFrame:
    return runs.leaderboard_series(_summary(spark, sf))


@query
def union_runs(spark: SparkSession, sf: str) -> DataFrame:
    summary = _summary(spark, sf).drop("train_val_macro_f1_gap")
    return _nullable_int(runs.union_runs(summary, views.run_overrides(spark, sf)))


@query
def history_series(spark: SparkSession, sf: str) -> DataFrame:
    return runs.history_series(views.run_history(spark, sf))


# --- files: written from the tables, read back ------------------------------------------------


@query
def csv_source(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and texts of the documents after a trip through labelled CSV files."""
    raw = views.raw_documents(spark, sf)
    names = dict(zip(("class_index", "title", "description"), CSV_COLUMNS))
    path = shared_path(spark)
    labelled.write_raw_csv(spread(raw, "doc_id").withColumnsRenamed(names), path)
    return labelled.read_labelled_csv(spark, path).select("label", "text")


@query
def batch_files(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded training rows as written for the trainer, in batch order."""
    path = shared_path(spark)
    prepared = _prepared(spark, sf)
    batches.write_batches(prepared.train, path, keys=prepared.tokenized.where(F.col("split") == "train"))
    ids = F.array_join(F.col("input_ids").cast("array<string>"), " ")
    return batches.read_batches(spark, path).select("doc_id", "label", "length", ids.alias("input_ids"), "batch_id", "slot")


@query
def vector_files(spark: SparkSession, sf: str) -> DataFrame:
    """Word vectors after a trip through files, their width checked."""
    _, vectors = _vectors(spark, sf)
    path = shared_path(spark)
    write_vectors(vectors, path)
    return _round_cells(read_vectors(spark, path, views.DIM), "token", "vector", "x")


@query
def history_files(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch histories of all runs after a trip through CSV files."""
    path = shared_path(spark)
    history = views.run_history(spark, sf)
    run_files.write_histories(history, path)
    return run_files.read_history_table(spark, path).select(*history.columns)


# --- fits and scoring --------------------------------------------------------------------


@query
def train_word2vec(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a fitted vector model with the width of their vectors."""
    model = fit.fit_word2vec(written(_all_tokens(spark, sf)))
    return model_vectors(model).select("token", F.size("vector").alias("dims"))


@query
def train_word2vec_negative(spark: SparkSession, sf: str) -> DataFrame:
    """The same of vectors trained with negative samples, block by block."""
    vectors = skipgram.fit_skipgram(written(_all_tokens(spark, sf)), blocks=2)
    return vectors.select("token", F.size("vector").alias("dims"))


def _fit_facts(prepared: Prepared, histories: DataFrame, best: DataFrame) -> DataFrame:
    """(run_name, n_train, n_val, loss_fell, beats_majority, kept_first_best) per run: what any
    sound fit on this split must show."""
    labels = prepared.tokenized.groupBy("split", "label").agg(F.count("*").alias("n"))
    sizes = labels.groupBy().agg(
        F.sum(F.when(F.col("split") == "train", F.col("n"))).alias("n_train"),
        F.sum(F.when(F.col("split") == "val", F.col("n"))).alias("n_val"),
        F.max(F.when(F.col("split") == "val", F.col("n"))).alias("most"),
    )
    first_best = F.max_by("epoch", F.struct("val_macro_f1", -F.col("epoch"))).alias("first_best")
    shown = histories.groupBy("run_name").agg(
        (F.max_by("train_loss", "epoch") < F.min_by("train_loss", "epoch")).alias("loss_fell"),
        F.max("val_acc").alias("acc"),
        first_best,
    )
    sizes_row = sizes.first()  # three numbers
    return shown.join(best.select("run_name", "best_epoch"), "run_name").select(
        "run_name",
        F.lit(sizes_row["n_train"]).cast("bigint").alias("n_train"),
        F.lit(sizes_row["n_val"]).cast("bigint").alias("n_val"),
        "loss_fell",
        (F.col("acc") > sizes_row["most"] / sizes_row["n_val"]).alias("beats_majority"),
        (F.col("best_epoch") == F.col("first_best")).alias("kept_first_best"),
    )


@query
def fit_mlp(spark: SparkSession, sf: str) -> DataFrame:
    """A feed-forward classifier of the default size on pooled vectors: facts of its fit."""
    prepared, matrix = _matrix(spark, sf)
    run = fit.train_mlp(fit.mlp_features(prepared, matrix, dim=views.DIM), 2 * views.DIM)
    return _fit_facts(prepared, run.history, run.summary)


# Five variants over the network's width and the features' length and pooling.
VARIANTS = {
    "base": {},
    "narrow": {"hidden": [128]},
    "long": {"max_len": 128},
    "longer": {"max_len": 160},
    "mean": {"pooling": "mean"},
}


@query
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the fits of five variants, and whether the leaderboard is in order."""
    prepared, lazy_matrix = _matrix(spark, sf)
    build = fit.features_by(prepared, written(lazy_matrix), views.DIM)
    table, histories = fit.run_experiments(build, None, VARIANTS)
    table = written(table)
    facts = _fit_facts(prepared, histories, table)
    place = F.rank().over(Window.orderBy(F.desc("best_val_macro_f1")))  # five rows
    return facts.join(table.select("run_name", (F.col("rank") >= place).alias("ranked")), "run_name")


def _baseline_rows(spark: SparkSession, sf: str) -> DataFrame:
    prepared, lazy_matrix = _matrix(spark, sf)
    return written(fit.mlp_features(prepared, written(lazy_matrix), "mean", views.DIM))


def _accuracy(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(n, hits, most): rows, right ones, and rows of the largest class."""
    scored = classify.with_probabilities(classify.linear_logits(rows, weights))
    classes = scored.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("y_pred") == F.col("label")).alias("hits"))
    return classes.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max("n").alias("most"))


@query
def fit_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the linear baseline: rows of both splits, whether the slope is gone, whether it beats
    the largest class on the rows it was fitted on."""
    rows = _baseline_rows(spark, sf)
    train = rows.where("split = 'train'")
    fitted = baseline.fit_baseline(train)
    sizes = rows.agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    beats = _accuracy(train, fitted.weights).select((F.col("hits") > F.col("most")).alias("beats_majority")).scalar()
    return sizes.select(F.lit("baseline").alias("run_name"), "n_train", "n_val", F.lit(fitted.slope < 1e-6).alias("converged"), beats.alias("beats_majority"))


@query
def search_trials(spark: SparkSession, sf: str) -> DataFrame:
    """A search of 30 trials over the baseline's penalty: trials by rung and state, and whether one
    that went through reaches the share of the largest class."""
    rows = _baseline_rows(spark, sf)
    train, val = written(rows.where("split = 'train'")), written(rows.where("split = 'val'"))

    def run(options: trials.Options, budget: int) -> float:
        weights = baseline.fit_baseline(train, options["l2"], steps=budget, classes=len(LABEL_NAMES)).weights
        r = _accuracy(val, weights).first()
        return r["hits"] / r["n"]

    found = written(trials.search(spark, shared_path(spark), run, {"l2": (1e-5, 10.0)}, budgets=(1, 2, 4), parallelism=4))
    share = val.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    counts = found.groupBy("rung", "budget", "state").agg(F.count("*").alias("trials"), F.max("score").alias("best"))
    return counts.select("rung", "budget", "state", "trials", ((F.col("state") != "done") | (F.col("best") >= share)).alias("as_good"))


@query
def rnn_score_full(spark: SparkSession, sf: str) -> DataFrame:
    """Class scores by a two-way LSTM of 128 units with norms, its weights drawn by a rule."""
    spec = RecurrentSpec("lstm", 128, 1, True, "meanmax", use_layer_norm=True, dtype="float64")
    prepared, lazy_matrix = _matrix(spark, sf)
    weights = written(views.drawn_weights(spark, spec))
    scores = recurrent.rnn_score(prepared.encoded, written(lazy_matrix), weights, spec, dim=views.DIM, matrix_rows=prepared.vocab_rows)
    return scores.select("doc_id", F.posexplode("logits").alias("label_id", "logit")).withColumn("logit", F.round("logit", 6))


@query
def score_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents scored by linear class weights learnt from the training split."""
    prepared, lazy_matrix = _matrix(spark, sf)
    matrix = written(lazy_matrix)
    options = dict(dim=views.DIM, matrix_rows=prepared.vocab_rows)
    train = embedding.pool(prepared.train, matrix, "mean", keep=("label",), **options)
    model = written(classify.class_centroids(train))
    docs = views.load(spark, sf, "documents")
    ranked = score.score_documents(
        docs, prepared.vocab, matrix, model, how="mean", dim=views.DIM, vocab_rows=prepared.vocab_rows
    )
    return ranked.withColumn("prob", F.round("prob", 6))


@query
def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    """`score_documents` row by row, in the form that a stream uses."""
    prepared, lazy_matrix = _matrix(spark, sf)
    matrix = written(lazy_matrix)
    train = embedding.pool(prepared.train, matrix, "mean", keep=("label",), dim=views.DIM, matrix_rows=prepared.vocab_rows)
    model = classify.class_centroids(train)
    scorer = score.RowScorer.of(prepared.vocab, matrix, model, dim=views.DIM, vocab_rows=prepared.vocab_rows, how="mean")
    return scorer.score(views.load(spark, sf, "documents")).withColumn("prob", F.round("prob", 6))


@query
def rnn_score(spark: SparkSession, sf: str) -> DataFrame:
    """Class scores of all documents by a one-way GRU whose weights are embedding rows."""
    spec = RecurrentSpec("gru", views.RNN_HIDDEN, 1, False, "last", dtype="float64")
    return _rnn(spark, sf, spec)


@query
def rnn_score_bilstm(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a two-way, mean and max pooled LSTM."""
    spec = RecurrentSpec("lstm", views.RNN_HIDDEN, 1, True, "meanmax", dtype="float64")
    return _rnn(spark, sf, spec)


@query
def score_documents_rnn(spark: SparkSession, sf: str) -> DataFrame:
    """All documents scored from their texts by the one-way GRU: ranked classes."""
    prepared, matrix = _matrix(spark, sf)
    spec = RecurrentSpec("gru", views.RNN_HIDDEN, 1, False, "last", dtype="float64")
    ranked = score.score_documents_rnn(
        views.load(spark, sf, "documents"), prepared.vocab, matrix, views.rnn_weights(spark, sf, spec), spec,
        dim=views.DIM, vocab_rows=prepared.vocab_rows,
    )
    return ranked.withColumn("prob", F.round("prob", 4))


@query
def score_saved_run(spark: SparkSession, sf: str) -> DataFrame:
    """A trained run saved, loaded and applied to all texts: rows per document, and whether the
    classes agree with the run's own validation predictions."""
    prepared, lazy_matrix = _matrix(spark, sf)
    matrix = written(lazy_matrix)
    run = fit.train_mlp(fit.mlp_features(prepared, matrix, dim=views.DIM), 2 * views.DIM)
    folder = shared_path(spark)
    fit.save_run(run, folder, prepared=prepared, matrix=matrix)
    ranked = fit.load_run(spark, f"{folder}/{run.run_name}").score(views.load(spark, sf, "documents"))
    own = run.predictions.select("doc_id", "y_pred")
    per_doc = ranked.groupBy("doc_id").agg(F.count("*").alias("classes"), F.min_by("label_id", "rank").alias("top"))
    return per_doc.join(own, "doc_id", "left").select("doc_id", "classes", F.coalesce(F.col("top") == F.col("y_pred"), F.lit(True)).alias("agrees"))


def _rnn(spark: SparkSession, sf: str, spec: RecurrentSpec) -> DataFrame:
    prepared, matrix = _matrix(spark, sf)
    weights = views.rnn_weights(spark, sf, spec)
    scored = recurrent.rnn_score(
        prepared.encoded, matrix, weights, spec, dim=views.DIM, matrix_rows=prepared.vocab_rows
    )
    return scored.select("doc_id", F.posexplode("logits").alias("label_id", "x")).select(
        "doc_id", "label_id", F.round("x", 6).alias("logit")
    )
