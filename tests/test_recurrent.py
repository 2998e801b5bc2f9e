import numpy as np
import pytest

from wordloom.operators import recurrent
from wordloom.operators.recurrent import RecurrentSpec, rnn_score
from wordloom.plans.views import drawn_weights, layout_of
from wordloom.session import written

V, D, H, L, K = 20, 5, 4, 7, 3


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def make_weights(spec, rng):
    gates = {"lstm": 4, "gru": 3}[spec.model_type] * H
    ways = ["", "_reverse"] if spec.bidirectional else [""]
    weights, width = {}, D
    for layer in range(spec.num_layers):
        for way in ways:
            weights[f"rnn.weight_ih_l{layer}{way}"] = rng.normal(size=(gates, width))
            weights[f"rnn.weight_hh_l{layer}{way}"] = rng.normal(size=(gates, H))
            weights[f"rnn.bias_ih_l{layer}{way}"] = rng.normal(size=gates)
            weights[f"rnn.bias_hh_l{layer}{way}"] = rng.normal(size=gates)
        width = H * len(ways)
    features = width * (2 if spec.pooling == "meanmax" else 1)
    if spec.use_rms_norm or spec.use_layer_norm:
        for name, size in (("embedding_norm", D), ("feature_norm", features)):
            weights[f"{name}.weight"] = rng.normal(size=size)
            weights[f"{name}.bias"] = rng.normal(size=size)
    weights["classifier.weight"], weights["classifier.bias"] = rng.normal(size=(K, features)), rng.normal(size=K)
    return weights


def one_document(spec, w, matrix, ids):
    """A plain loop over the steps of one unpadded document."""

    def norm(name, x):
        if spec.use_rms_norm:
            return w[f"{name}.weight"] * x / np.sqrt((x * x).mean() + 1e-8)
        if spec.use_layer_norm:
            return w[f"{name}.weight"] * (x - x.mean()) / np.sqrt(x.var() + 1e-5) + w[f"{name}.bias"]
        return x

    def run(xs, s):
        h, c, out = np.zeros(spec.hidden_size), np.zeros(spec.hidden_size), []
        for x in xs:
            a = w[f"rnn.weight_ih_{s}"] @ x + w[f"rnn.bias_ih_{s}"]
            b = w[f"rnn.weight_hh_{s}"] @ h + w[f"rnn.bias_hh_{s}"]
            if spec.model_type == "lstm":
                i, f, g, o = np.split(a + b, 4)
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                h = sigmoid(o) * np.tanh(c)
            else:
                (ar, az, an), (br, bz, bn) = np.split(a, 3), np.split(b, 3)
                n = np.tanh(an + sigmoid(ar + br) * bn)
                z = sigmoid(az + bz)
                h = (1 - z) * n + z * h
            out.append(h)
        return out, h

    xs = [norm("embedding_norm", matrix[i]) for i in (ids or [0])]
    for layer in range(spec.num_layers):
        out, final = run(xs, f"l{layer}")
        if spec.bidirectional:
            back, last = run(xs[::-1], f"l{layer}_reverse")
            out, final = [np.concatenate(p) for p in zip(out, back[::-1])], np.concatenate([final, last])
        xs = out
    if spec.pooling == "meanmax":
        states = np.array(xs) if ids else np.zeros((1, len(xs[0])))
        final = np.concatenate([states.mean(0), states.max(0)])
    return w["classifier.weight"] @ norm("feature_norm", final) + w["classifier.bias"]


SPECS = [
    dict(model_type="lstm", bidirectional=True, pooling="last"),
    dict(model_type="gru", bidirectional=False, pooling="last", use_rms_norm=True),
    dict(model_type="lstm", bidirectional=True, pooling="meanmax", num_layers=2, use_layer_norm=True),
    dict(model_type="gru", bidirectional=True, pooling="meanmax"),
    dict(model_type="lstm", bidirectional=False, pooling="last", num_layers=2),
]


@pytest.mark.parametrize("options", SPECS, ids=lambda o: "-".join(map(str, o.values())))
@pytest.mark.parametrize("matrix_rows", [V, 10**9, None])
def test_scores_equal_step_loop(spark, options, matrix_rows):
    rng = np.random.default_rng(1)
    spec = RecurrentSpec(hidden_size=H, dtype="float64", **options)
    weights, table = make_weights(spec, rng), rng.normal(size=(V, D)).astype("float32").astype("float64")
    table[0] = 0.0
    docs = [[]] + [list(map(int, rng.integers(1, V, rng.integers(1, L + 1)))) for _ in range(25)]
    encoded = spark.createDataFrame(
        [(i, d + [0] * (L - len(d)), max(1, len(d))) for i, d in enumerate(docs)],
        "doc_id bigint, input_ids array<int>, length int",
    )
    matrix = spark.createDataFrame([(i, table[i].tolist()) for i in range(V)], "idx int, vector array<float>")
    params = spark.createDataFrame(
        [(k, list(v.shape), v.ravel().tolist()) for k, v in weights.items()],
        "name string, shape array<int>, values array<double>",
    )
    got = rnn_score(encoded, matrix, params, spec, dim=D, matrix_rows=matrix_rows).collect()
    assert len(got) == len(docs)
    for r in got:
        assert np.allclose(r["logits"], one_document(spec, weights, table, docs[r["doc_id"]]), atol=1e-9)


def test_full_size_equals_step_loop(spark):
    """The two-way LSTM of 128 units that is registered as a query, with its drawn weights."""
    rng = np.random.default_rng(4)
    spec = RecurrentSpec("lstm", 128, 1, True, "meanmax", use_layer_norm=True, dtype="float64")
    params = written(drawn_weights(spark, spec))
    weights = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in params.collect()}
    assert {k: list(v.shape) for k, v in weights.items()} == {
        name: [width] if rows == 1 else [rows, width] for name, rows, width in layout_of(spec)
    }
    assert all(abs(v.std() - 0.1) < 0.02 for v in weights.values() if v.size > 1000)
    table = rng.normal(size=(V, 64)).astype("float32").astype("float64")
    docs = [[], [3], list(map(int, rng.integers(1, V, 7))), list(map(int, rng.integers(1, V, 40)))]
    rows = [(i, d + [0] * (40 - len(d)), max(1, len(d))) for i, d in enumerate(docs)]
    table[0] = 0.0
    encoded = spark.createDataFrame(rows, "doc_id bigint, input_ids array<int>, length int")
    matrix = spark.createDataFrame([(i, table[i].tolist()) for i in range(V)], "idx int, vector array<float>")
    for r in rnn_score(encoded, matrix, params, spec, dim=64).collect():
        assert np.allclose(r["logits"], one_document(spec, weights, table, docs[r["doc_id"]]), atol=1e-9)


def test_matrix_larger_than_its_bound(spark):
    rng, spec = np.random.default_rng(2), RecurrentSpec(hidden_size=H)
    encoded = spark.createDataFrame([(0, [1, 0], 1)], "doc_id bigint, input_ids array<int>, length int")
    matrix = spark.createDataFrame([(i, [0.0] * D) for i in range(3)], "idx int, vector array<float>")
    params = spark.createDataFrame(
        [(k, list(v.shape), v.ravel().tolist()) for k, v in make_weights(spec, rng).items()],
        "name string, shape array<int>, values array<double>",
    )
    with pytest.raises(ValueError, match="more than 2 rows"):
        rnn_score(encoded, matrix, params, spec, dim=D, matrix_rows=2)


@pytest.mark.parametrize(
    "options", [dict(model_type="rnn"), dict(pooling="mean"), dict(use_rms_norm=True, use_layer_norm=True)]
)
def test_bad_options(options):
    with pytest.raises(ValueError):
        RecurrentSpec(**options)


def test_shared_vectors_meet_the_input_weights_once():
    """Positions that share a vector give the scores of positions with vectors of their own."""
    spec = recurrent.RecurrentSpec("lstm", 6, 1, True, "meanmax", use_layer_norm=True, dtype="float64")
    rng = np.random.default_rng(3)
    weights = {n: rng.standard_normal((r, w) if r > 1 else w) for n, r, w in layout_of(spec, 5)}
    table = rng.standard_normal((4, 5))
    lengths = np.array([6, 4, 1])
    ids = np.where(np.arange(6) < lengths[:, None], rng.integers(1, 4, (3, 6)), 0)
    shared = recurrent._logits(spec, weights, ids, table, ids, lengths)
    own = recurrent._logits(spec, weights, ids, table[ids].reshape(18, 5), np.arange(18).reshape(3, 6), lengths)
    assert np.allclose(shared, own, atol=1e-13)
    x = np.array([-800.0, -3.0, -1e-9, 0.0, 2.5, 800.0])
    assert np.allclose(recurrent._tanh(x.copy()), np.tanh(x), atol=1e-15)
