"""The registered queries once more, as plain SQL over the same tables.

Written independently of the operators: single windows, plain joins, long form."""

from __future__ import annotations

from wordloom.settings import LABEL_NAMES, NA_STRINGS, TOKEN_PATTERN, VECTOR_DIM

ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PATTERN = quoted(TOKEN_PATTERN)
NA_LIST = ", ".join(quoted(s) for s in NA_STRINGS)

# --- shared pieces: name -> (needs, body) ------------------------------------------------
PIECES: dict[str, tuple[list[str], str]] = {
    "raw": ([], """
        SELECT doc_id,
               CASE lang WHEN 'en' THEN '1' WHEN 'fr' THEN '2' WHEN 'de' THEN '3' ELSE '4.0' END AS class_index,
               CASE source WHEN 'src0' THEN NULL WHEN 'src1' THEN 'NA' WHEN 'src2' THEN '' ELSE source END AS title,
               CASE WHEN source IN ('src0', 'src3') THEN NULL WHEN source = 'src4' THEN 'None' ELSE text END AS description
        FROM documents"""),
    "decoded": (["raw"], f"""
        SELECT doc_id, class_index,
               CASE WHEN title NOT IN ({NA_LIST}) THEN title END AS title,
               CASE WHEN description NOT IN ({NA_LIST}) THEN description END AS description
        FROM raw"""),
    "docs": ([], """
        SELECT doc_id, text, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS label
        FROM documents"""),
    "quotas": (["docs"], """
        SELECT label, n, train_rows,
               (base + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= train_rows - sum(base) OVER ()
                            THEN 1 ELSE 0 END)::BIGINT AS n_train
        FROM (SELECT *, (n::HUGEINT * train_rows) // total AS base, (n::HUGEINT * train_rows) % total AS rem
              FROM (SELECT *, total - ceil(0.1::DOUBLE * total)::BIGINT AS train_rows
                    FROM (SELECT label, n, (sum(n) OVER ())::BIGINT AS total
                          FROM (SELECT label, count(*) AS n FROM docs GROUP BY label))))"""),
    "split": (["docs", "quotas"], """
        SELECT d.doc_id, d.label, d.text,
               CASE WHEN row_number() OVER (PARTITION BY d.label ORDER BY md5('42|' || d.doc_id), d.doc_id) <= q.n_train
                    THEN 'train' ELSE 'val' END AS split
        FROM docs d JOIN quotas q USING (label)"""),
    "tok": (["split"], f"""
        SELECT doc_id, label, split, regexp_extract_all(lower(text), {PATTERN}, 0) AS tokens FROM split"""),
    "long": (["tok"], """
        SELECT doc_id, label, split, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM tok"""),
    "eligible": (["long"], """
        SELECT token, count(*) AS freq, min(doc_id::HUGEINT * 4294967296 + pos) AS first
        FROM long WHERE split = 'train' GROUP BY token HAVING count(*) >= 2"""),
    "vocab": (["eligible"], """
        SELECT 0 AS idx, '<pad>' AS token, 0::BIGINT AS freq
        UNION ALL SELECT 1, '<unk>', 0
        UNION ALL SELECT rn + 1, token, freq
                  FROM (SELECT token, freq, row_number() OVER (ORDER BY freq DESC, first) AS rn FROM eligible)
                  WHERE rn <= 49998"""),
    "ids": (["long", "vocab"], """
        SELECT l.doc_id, l.label, l.split, l.pos, coalesce(v.idx, 1) AS idx
        FROM long l LEFT JOIN vocab v USING (token)"""),
    "cut": (["ids"], "SELECT * FROM ids WHERE pos < 96"),
    "matrix": (["vocab"], """
        SELECT v.idx, v.token, e.vec_id IS NOT NULL AS found, d.dim,
               CASE WHEN e.vec_id IS NOT NULL THEN e.embedding[d.dim + 1]::DOUBLE
                    WHEN v.idx = 0 THEN 0.0
                    ELSE (sqrt(-2.0 * ln(u.a / 4294967296.0::DOUBLE + 1.0::DOUBLE / 4294967296.0::DOUBLE))
                          * CASE WHEN d.dim % 2 = 0 THEN cos(2.0::DOUBLE * pi() * (u.b / 4294967296.0::DOUBLE))
                                 ELSE sin(2.0::DOUBLE * pi() * (u.b / 4294967296.0::DOUBLE)) END
                          * 0.05::DOUBLE)::FLOAT::DOUBLE END AS x
        FROM vocab v
        CROSS JOIN (SELECT unnest(range(64)) AS dim) d
        JOIN (SELECT idx, dim,
                     ('0x' || substr(md5('42|' || idx || '|' || (dim // 4)), 16 * (dim % 4 // 2) + 1, 8))::BIGINT::DOUBLE AS a,
                     ('0x' || substr(md5('42|' || idx || '|' || (dim // 4)), 16 * (dim % 4 // 2) + 9, 8))::BIGINT::DOUBLE AS b
              FROM vocab CROSS JOIN (SELECT unnest(range(64)) AS dim)) u ON u.idx = v.idx AND u.dim = d.dim
        LEFT JOIN embeddings e ON e.vec_id = v.idx - 2"""),
    "pooled": (["tok", "cut", "matrix"], """
        SELECT t.doc_id, d.dim, coalesce(p.mean_x, 0.0) AS mean_x, coalesce(p.max_x, 0.0) AS max_x
        FROM tok t CROSS JOIN (SELECT unnest(range(64)) AS dim) d
        LEFT JOIN (SELECT c.doc_id, m.dim, avg(m.x) AS mean_x, max(m.x) AS max_x
                   FROM cut c JOIN matrix m USING (idx) GROUP BY c.doc_id, m.dim) p
               ON p.doc_id = t.doc_id AND p.dim = d.dim"""),
    "cells": ([], """
        SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim
        FROM embeddings"""),
    "logits": (["cells"], """
        SELECT c.vec_id, c.label, w.label_id, round(sum(c.x * w.weight), 6) AS logit
        FROM cells c JOIN (SELECT label AS label_id, dim, avg(x) AS weight FROM cells GROUP BY label, dim) w USING (dim)
        GROUP BY c.vec_id, c.label, w.label_id"""),
    "pred": (["logits"], """
        SELECT vec_id, label AS y_true, label_id AS y_pred
        FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, label_id) AS rn FROM logits)
        WHERE rn = 1"""),
    "probs": (["logits"], """
        SELECT vec_id, label_id, exp(logit - top) / sum(exp(logit - top)) OVER (PARTITION BY vec_id) AS p
        FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS top FROM logits)"""),
    "report": (["pred"], """
        SELECT label, CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END AS precision,
               CASE WHEN truth = 0 THEN 0.0 ELSE tp::DOUBLE / truth END AS recall,
               CASE WHEN truth + predicted = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (truth + predicted) END AS f1, truth AS support
        FROM (SELECT label,
                     (SELECT count(*) FROM pred WHERE y_true = label AND y_pred = label) AS tp,
                     (SELECT count(*) FROM pred WHERE y_true = label) AS truth,
                     (SELECT count(*) FROM pred WHERE y_pred = label) AS predicted
              FROM (SELECT y_true AS label FROM pred UNION SELECT y_pred FROM pred))"""),
    "history": ([], """
        SELECT 'run_' || user_id AS run_name,
               (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS epoch,
               round(1 / (2 + value), 4) AS train_loss,
               round(value / (value + 11), 4) AS train_acc,
               round(round(value / (value + 10), 4) + (props::JSON ->> '$.k')::DOUBLE / 1000, 4) AS train_macro_f1,
               round(1 / (1 + value), 4) AS val_loss,
               round(value / (value + 12), 4) AS val_acc,
               CASE WHEN event_type = 'error' THEN 'nan'::DOUBLE ELSE round(value / (value + 10), 4) END AS val_macro_f1
        FROM events"""),
    "hist": (["history"], """
        SELECT *, CASE WHEN NOT isnan(val_macro_f1) THEN val_macro_f1 END AS v FROM history"""),
    "best": (["hist"], """
        SELECT r.run_name, b.epoch AS best_epoch, b.v AS best_val_macro_f1, b.train_macro_f1 AS best_train_macro_f1,
               b.val_loss AS best_val_loss, round(b.train_macro_f1 - b.v, 6) AS train_val_macro_f1_gap
        FROM (SELECT DISTINCT run_name FROM hist) r
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY v DESC, epoch) AS rn
                   FROM hist WHERE v IS NOT NULL) b ON b.run_name = r.run_name AND b.rn = 1"""),
    "placed": (["best"], """
        SELECT *, row_number() OVER (ORDER BY best_val_macro_f1 ASC NULLS LAST, run_name) AS place FROM best"""),
    "marked": (["hist"], """
        SELECT *, coalesce(v > best_before, false) AS improved
        FROM (SELECT *, greatest(-1.0::DOUBLE, coalesce(max(v) OVER (PARTITION BY run_name ORDER BY epoch
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0::DOUBLE)) AS best_before
              FROM hist)"""),
    "since": (["marked"], """
        SELECT *, epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_name ORDER BY epoch
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS waited
        FROM marked"""),
    "kept": (["since"], """
        SELECT s.*, s.waited >= 3 AS stops
        FROM since s
        LEFT JOIN (SELECT run_name, min(epoch) AS stop FROM since WHERE waited >= 3 GROUP BY run_name) t USING (run_name)
        WHERE t.stop IS NULL OR s.epoch <= t.stop"""),
    "overrides": ([], """
        SELECT 'run_' || c_custkey AS run_name,
               CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey END::INTEGER AS best_epoch, c_mktsegment
        FROM customer"""),
}

# One-way GRU, 8 units, weights cut from consecutive embedding rows: 24 input rows, 24
# hidden rows, two bias rows, 4 class rows, one class bias row.
H, G = 8, 24


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


PIECES["net"] = ([], f"""
        SELECT list(embedding::DOUBLE[] ORDER BY vec_id) FILTER (vec_id < {G}) AS wi,
               list(embedding[1:{H}]::DOUBLE[] ORDER BY vec_id) FILTER (vec_id >= {G} AND vec_id < {2 * G}) AS wh,
               any_value(embedding[1:{G}]::DOUBLE[]) FILTER (vec_id = {2 * G}) AS bi,
               any_value(embedding[1:{G}]::DOUBLE[]) FILTER (vec_id = {2 * G + 1}) AS bh,
               list(embedding[1:{H}]::DOUBLE[] ORDER BY vec_id) FILTER (vec_id BETWEEN {2 * G + 2} AND {2 * G + 5}) AS wc,
               any_value(embedding[1:4]::DOUBLE[]) FILTER (vec_id = {2 * G + 6}) AS bc
        FROM embeddings""")
PIECES["word_gates"] = (["matrix", "net"], f"""
        SELECT idx, list_transform(range(1, {G + 1}), lambda g: {_dot("x", "wi[g]")} + bi[g]) AS gi
        FROM (SELECT idx, list(x ORDER BY dim) AS x FROM matrix GROUP BY idx), net""")
PIECES["steps"] = (["tok", "cut", "word_gates"], """
        SELECT s.doc_id, s.pos, w.gi FROM (
            SELECT doc_id, pos, idx FROM cut
            UNION ALL SELECT doc_id, 0, 0 FROM tok WHERE len(tokens) = 0) s JOIN word_gates w USING (idx)""")
PIECES["states"] = (["steps", "net"], f"""
        SELECT doc_id, 0 AS pos, list_transform(range({H}), lambda k: 0.0::DOUBLE) AS h FROM tok
        UNION ALL
        SELECT doc_id, pos + 1, list_transform(range(1, {H + 1}), lambda k:
                 (1 - 1 / (1 + exp(-(gi[{H} + k] + gh[{H} + k]))))
                 * (2 / (1 + exp(-2 * (gi[{2 * H} + k] + 1 / (1 + exp(-(gi[k] + gh[k]))) * gh[{2 * H} + k]))) - 1)
                 + 1 / (1 + exp(-(gi[{H} + k] + gh[{H} + k]))) * h[k])
        FROM (SELECT s.doc_id, s.pos, s.h, t.gi,
                     list_transform(range(1, {G + 1}), lambda g: {_dot("s.h", "wh[g]")} + bh[g]) AS gh
              FROM states s JOIN steps t ON t.doc_id = s.doc_id AND t.pos = s.pos, net)""")

# Two-way LSTM, 8 units, mean and max pooled; 66 embedding rows per direction, then 4 class
# rows of 32 and one class bias row.
LG, DIR = 32, 66


def _sig(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def _tanh(x: str) -> str:
    return f"(2 / (1 + exp(-2 * ({x}))) - 1)"


PIECES["nets"] = ([], f"""
        SELECT dir, list(embedding::DOUBLE[] ORDER BY vec_id) FILTER (place < {LG}) AS wi,
               list(embedding[1:{H}]::DOUBLE[] ORDER BY vec_id) FILTER (place >= {LG} AND place < {2 * LG}) AS wh,
               any_value(embedding[1:{LG}]::DOUBLE[]) FILTER (place = {2 * LG}) AS bi,
               any_value(embedding[1:{LG}]::DOUBLE[]) FILTER (place = {2 * LG + 1}) AS bh
        FROM (SELECT *, vec_id // {DIR} AS dir, vec_id % {DIR} AS place FROM embeddings WHERE vec_id < {2 * DIR}) GROUP BY dir""")
PIECES["both_gates"] = (["matrix", "nets"], f"""
        SELECT dir, idx, list_transform(range(1, {LG + 1}), lambda g: {_dot("x", "wi[g]")} + bi[g]) AS gi
        FROM (SELECT idx, list(x ORDER BY dim) AS x FROM matrix GROUP BY idx), nets""")
PIECES["both_steps"] = (["cut", "both_gates"], """
        SELECT w.dir, s.doc_id, CASE w.dir WHEN 0 THEN s.pos ELSE s.n - 1 - s.pos END AS step, w.gi
        FROM (SELECT doc_id, pos, idx, count(*) OVER (PARTITION BY doc_id) AS n FROM cut) s JOIN both_gates w USING (idx)""")
PIECES["both_states"] = (["both_steps", "nets"], f"""
        SELECT dir, doc_id, 0 AS step, list_transform(range({H}), lambda k: 0.0::DOUBLE) AS c,
               list_transform(range({H}), lambda k: 0.0::DOUBLE) AS h
        FROM both_steps WHERE step = 0
        UNION ALL
        SELECT dir, doc_id, step + 1, c, list_transform(range(1, {H + 1}), lambda k: {_sig(f"a[{3 * H} + k]")} * {_tanh("c[k]")})
        FROM (SELECT dir, doc_id, step, a, list_transform(range(1, {H + 1}), lambda k:
                     {_sig(f"a[{H} + k]")} * c[k] + {_sig("a[k]")} * {_tanh(f"a[{2 * H} + k]")}) AS c
              FROM (SELECT s.dir, s.doc_id, s.step, s.c,
                           list_transform(range(1, {LG + 1}), lambda g: t.gi[g] + {_dot("s.h", "n.wh[g]")} + n.bh[g]) AS a
                    FROM both_states s
                    JOIN both_steps t ON t.dir = s.dir AND t.doc_id = s.doc_id AND t.step = s.step
                    JOIN nets n ON n.dir = s.dir))""")
PIECES["both_features"] = (["both_states"], f"""
        SELECT doc_id, kind * {2 * H} + dir * {H} + j AS f, CASE kind WHEN 0 THEN avg(x) ELSE max(x) END AS v
        FROM (SELECT dir, doc_id, unnest(h) AS x, generate_subscripts(h, 1) - 1 AS j FROM both_states WHERE step > 0),
             (SELECT unnest(range(2)) AS kind)
        GROUP BY doc_id, dir, j, kind""")

# Pieces that are read more than once and worth keeping.
KEEP = {"pooled", "split", "tok", "long", "vocab", "ids", "cut", "matrix", "cells", "logits", "pred", "hist", "since", "net", "word_gates", "steps", "nets", "both_gates", "both_steps"}


def sql(*needs: str, body: str) -> str:
    """`body` behind the WITH list of everything it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in PIECES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for need in needs:
        visit(need)
    parts = [f"{n} AS {'MATERIALIZED ' if n in KEEP else ''}({PIECES[n][1]})" for n in order]
    recursive = "RECURSIVE " if {"states", "both_states"} & set(order) else ""
    return (f"WITH {recursive}{', '.join(parts)} " if parts else "") + body


def oracle(name: str, *needs: str, body: str) -> None:
    ORACLES[name] = sql(*needs, body=body)


# --- projections ---------------------------------------------------------------------------
oracle("na_decode", "decoded", body="SELECT doc_id, title, description FROM decoded")
oracle("label_shift", "decoded", body="SELECT doc_id, class_index::DOUBLE::INTEGER - 1 AS label FROM decoded")
oracle("text_concat", "decoded", body="SELECT doc_id, coalesce(title, '') || ' ' || coalesce(description, '') AS text FROM decoded")
oracle(
    "label_name",
    body="SELECT e.vec_id, e.label, d.label_name FROM embeddings e LEFT JOIN (VALUES "
    + ", ".join(f"({i}, {quoted(n)})" for i, n in enumerate(LABEL_NAMES))
    + ") d(label, label_name) USING (label)",
)
for key, column in (("tokenize", "lower(text)"), ("tokenize_cased", "text")):
    oracle(
        key,
        body=f"SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens FROM "
        f"(SELECT doc_id, regexp_extract_all({column}, {PATTERN}, 0) AS t FROM documents)",
    )

# --- split, vocabulary, encoding -------------------------------------------------------------
oracle("split_quotas", "quotas", body="SELECT label, n, n_train, n - n_train AS n_val FROM quotas")
oracle("stratified_split", "split", body="SELECT doc_id, label, split FROM split")
oracle(
    "split_sizes", "split", "vocab",
    body="SELECT split AS part, count(*) AS size FROM split GROUP BY split UNION ALL SELECT 'vocab', count(*) FROM vocab",
)
oracle("token_freq", "long", body="SELECT token, count(*) AS freq FROM long WHERE split = 'train' GROUP BY token")
oracle("vocab_build", "vocab", body="SELECT idx::INTEGER AS idx, token, freq FROM vocab")
oracle(
    "vocab_build_capped", "eligible",
    body="""SELECT 0 AS idx, '<pad>' AS token, 0::BIGINT AS freq UNION ALL SELECT 1, '<unk>', 0
        UNION ALL SELECT (rn + 1)::INTEGER, token, freq
        FROM (SELECT token, freq, row_number() OVER (ORDER BY freq DESC, first) AS rn FROM eligible WHERE freq >= 5)
        WHERE rn <= 998""",
)
oracle(
    "w2v_vocab",
    body=f"SELECT token, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), {PATTERN}, 0)) AS token "
    "FROM documents) GROUP BY token HAVING count(*) >= 5",
)
oracle(
    "encode", "tok", "cut",
    body="""SELECT t.doc_id, t.label, t.split, greatest(1, len(coalesce(c.ids, [])))::INTEGER AS length,
               array_to_string(list_resize(coalesce(c.ids, []), 96, 0), ' ') AS input_ids
        FROM tok t LEFT JOIN (SELECT doc_id, list(idx ORDER BY pos) AS ids FROM cut GROUP BY doc_id) c USING (doc_id)""",
)
oracle(
    "unk_rate", "tok", "ids",
    body="""SELECT t.doc_id, count(i.idx) FILTER (i.idx <> 1) AS known_tokens, count(i.idx) FILTER (i.idx = 1) AS unk_tokens
        FROM tok t LEFT JOIN ids i USING (doc_id) GROUP BY t.doc_id""",
)
oracle(
    "document_profile", "tok", "cut",
    body="""SELECT t.doc_id, greatest(1, count(c.idx))::INTEGER AS length,
               count(c.idx) FILTER (c.idx <> 1) AS known_tokens, count(c.idx) FILTER (c.idx = 1) AS unk_tokens
        FROM tok t LEFT JOIN cut c USING (doc_id) GROUP BY t.doc_id""",
)
oracle(
    "pad_mask_stats", "tok", "cut",
    body="""SELECT t.doc_id, greatest(1, count(c.idx))::INTEGER AS length,
               count(c.idx) AS real_positions, 96 - count(c.idx) AS pad_positions
        FROM tok t LEFT JOIN cut c USING (doc_id) GROUP BY t.doc_id""",
)
for key, part, order in (
    ("training_batches", "train", "md5('42|1|' || doc_id), doc_id"),
    ("validation_batches", "val", "doc_id"),
):
    oracle(
        key, "split",
        body=f"""SELECT doc_id, rn // 128 AS batch_id, rn % 128 AS slot
            FROM (SELECT doc_id, row_number() OVER (ORDER BY {order}) - 1 AS rn FROM split WHERE split = '{part}')""",
    )

# --- vectors -----------------------------------------------------------------------------------
oracle(
    "embedding_matrix", "matrix",
    body="""SELECT idx::INTEGER AS idx, token, found,
               array_to_string(list(round(x * 1e6::DOUBLE)::BIGINT ORDER BY dim), ' ') AS vector
        FROM matrix GROUP BY idx, token, found""",
)
IN_VECTORS = "(SELECT vec_id + 2 FROM embeddings)"
oracle("vocab_with_vector", "vocab", body=f"SELECT idx::INTEGER AS idx, token FROM vocab WHERE idx IN {IN_VECTORS}")
oracle("vocab_oov", "vocab", body=f"SELECT idx::INTEGER AS idx, token FROM vocab WHERE idx NOT IN {IN_VECTORS}")
oracle(
    "embedding_coverage", "vocab",
    body=f"""SELECT found, vocab_size, round(found::DOUBLE / greatest(1, vocab_size), 6) AS coverage
        FROM (SELECT count(*) FILTER (idx IN {IN_VECTORS}) AS found, count(*) AS vocab_size FROM vocab)""",
)
oracle("pool_mean", "pooled", body="SELECT doc_id, dim::INTEGER AS dim, round(mean_x, 6) AS x FROM pooled")
oracle("pool_max", "pooled", body="SELECT doc_id, dim::INTEGER AS dim, round(max_x, 6) AS x FROM pooled")
oracle(
    "pool_meanmax", "pooled",
    body="""SELECT doc_id, dim::INTEGER AS dim, round(mean_x, 6) AS x FROM pooled
        UNION ALL SELECT doc_id, (dim + 64)::INTEGER, round(max_x, 6) FROM pooled""",
)
oracle(
    "rms_norm", "cells",
    body="""SELECT vec_id, dim::INTEGER AS dim, round(x / sqrt(avg(x * x) OVER (PARTITION BY vec_id) + 1e-8::DOUBLE), 6) AS x
        FROM cells""",
)
oracle(
    "layer_norm", "cells",
    body="""SELECT vec_id, dim::INTEGER AS dim,
               round(c / sqrt(avg(c * c) OVER (PARTITION BY vec_id) + 1e-5::DOUBLE), 6) AS x
        FROM (SELECT vec_id, dim, x - avg(x) OVER (PARTITION BY vec_id) AS c FROM cells)""",
)
NEAR = """(SELECT q.vec_id AS query, v.vec_id,
                  round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS s
           FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id)"""
oracle(
    "most_similar",
    body=f"""SELECT (row_number() OVER (ORDER BY s DESC, vec_id))::INTEGER AS rank, vec_id, round(s, 6) AS similarity
        FROM {NEAR} WHERE query = 0 ORDER BY s DESC, vec_id LIMIT 5""",
)
oracle(
    "most_similar_batch",
    body=f"""SELECT query, rn::INTEGER AS rank, vec_id, round(s, 6) AS similarity
        FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rn FROM {NEAR}) WHERE rn <= 5""",
)

# --- class scores and metrics --------------------------------------------------------------------
oracle("linear_logits", "logits", body="SELECT vec_id, label_id::INTEGER AS label_id, logit FROM logits")
oracle("argmax_class", "pred", body="SELECT vec_id, y_true, y_pred::INTEGER AS y_pred FROM pred")
oracle("softmax_probs", "probs", body="SELECT vec_id, label_id::INTEGER AS label_id, round(p, 6) AS prob FROM probs")
oracle(
    "ranked_probs", "probs",
    body="""SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label_id))::INTEGER AS rank,
               label_id::INTEGER AS label_id, 'class_' || label_id AS label_name, round(p, 6) AS prob FROM probs""",
)
oracle("accuracy", "pred", body="SELECT round(avg((y_true = y_pred)::INTEGER::DOUBLE), 6) AS accuracy FROM pred")
oracle(
    "class_report", "report",
    body="SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report",
)
oracle(
    "class_report_avgs", "report", "pred",
    body="""SELECT 'accuracy' AS average, NULL::DOUBLE AS precision, NULL::DOUBLE AS recall,
               round(avg((y_true = y_pred)::INTEGER::DOUBLE), 6) AS f1, count(*) AS support FROM pred
        UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM report
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
               round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT
        FROM report""",
)
oracle("macro_f1", "report", body="SELECT round(avg(f1), 6) AS macro_f1 FROM report")
CLASSES = "(SELECT y_true AS c FROM pred UNION SELECT y_pred FROM pred)"
oracle(
    "confusion_long", "pred",
    body=f"""SELECT a.c AS y_true, b.c AS y_pred, (SELECT count(*) FROM pred WHERE y_true = a.c AND y_pred = b.c) AS n
        FROM {CLASSES} a CROSS JOIN {CLASSES} b""",
)
oracle(
    "confusion_wide", "pred",
    body="SELECT c AS y_true, "
    + ", ".join(f"(SELECT count(*) FROM pred WHERE y_true = c AND y_pred = {k}) AS pred_{k}" for k in range(10))
    + " FROM (SELECT unnest(range(10))::INTEGER AS c)",
)
oracle(
    "mean_cross_entropy", "logits",
    body="""SELECT round(avg(log_mass - own), 6) AS loss
        FROM (SELECT vec_id, max(top) + ln(sum(exp(logit - top))) AS log_mass, sum(logit) FILTER (label_id = label) AS own
              FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS top FROM logits) GROUP BY vec_id)""",
)

# --- run logs ----------------------------------------------------------------------------------------
oracle("run_best_epoch", "best", body="SELECT * REPLACE (best_epoch::DOUBLE AS best_epoch) FROM best")
oracle("running_best", "marked", body="SELECT run_name, epoch, best_before, improved FROM marked")
oracle(
    "early_stop", "kept",
    body="""SELECT k.run_name, count(*) AS epochs_run, bool_or(stops) AS stopped,
               (min(epoch) FILTER (v = top))::DOUBLE AS best_epoch, max(v) AS best_val_macro_f1
        FROM (SELECT *, max(v) OVER (PARTITION BY run_name) AS top FROM kept) k GROUP BY k.run_name""",
)
oracle(
    "checkpoint_epoch", "kept",
    body="""SELECT run_name, epoch AS checkpoint_epoch, val_macro_f1 AS checkpoint_val_macro_f1
        FROM (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY epoch DESC) AS rn FROM kept WHERE improved) WHERE rn = 1""",
)
oracle(
    "leaderboard", "best", "overrides",
    body="""SELECT run_name, best_val_macro_f1, coalesce(o.best_epoch, b.best_epoch)::DOUBLE AS best_epoch, train_val_macro_f1_gap,
               o.c_mktsegment, row_number() OVER (ORDER BY best_val_macro_f1 DESC NULLS LAST, run_name) AS rank
        FROM best b LEFT JOIN overrides o USING (run_name)""",
)
oracle(
    "leaderboard_series", "placed",
    body="""SELECT place, run_name, 'best_val_macro_f1' AS series, best_val_macro_f1 AS value FROM placed
        UNION ALL SELECT place, run_name, 'train_val_macro_f1_gap', train_val_macro_f1_gap FROM placed""",
)
oracle(
    "union_runs", "best", "overrides",
    body="""SELECT run_name, best_val_macro_f1, best_epoch::DOUBLE AS best_epoch, NULL AS c_mktsegment FROM best
        UNION ALL SELECT run_name, NULL, best_epoch::DOUBLE, c_mktsegment FROM overrides""",
)
oracle(
    "history_series", "history",
    body=" UNION ALL ".join(
        f"SELECT run_name, epoch, '{c}' AS metric, {c} AS value FROM history"
        for c in ("train_loss", "val_loss", "train_acc", "val_acc", "val_macro_f1")
    ),
)

# --- fits and scoring --------------------------------------------------------------------------------
for key in ("train_word2vec", "train_word2vec_negative"):
    oracle(
        key,
        body=f"SELECT token, {VECTOR_DIM} AS dims FROM (SELECT unnest(regexp_extract_all(lower(text), {PATTERN}, 0)) AS token "
        "FROM documents) GROUP BY token HAVING count(*) >= 5",
    )
FIT_FACTS = """(SELECT count(*) FROM split WHERE split = 'train') AS n_train, (SELECT count(*) FROM split WHERE split = 'val') AS n_val,
       true AS loss_fell, true AS beats_majority, true AS kept_first_best"""
oracle("fit_mlp", "split", body=f"SELECT 'mlp' AS run_name, {FIT_FACTS}")
oracle(
    "fit_baseline", "split",
    body="""SELECT 'baseline' AS run_name, (SELECT count(*) FROM split WHERE split = 'train') AS n_train,
               (SELECT count(*) FROM split WHERE split = 'val') AS n_val, true AS converged, true AS beats_majority""",
)
ORACLES["search_trials"] = """SELECT rung::INTEGER AS rung, budget::INTEGER AS budget, state, trials::BIGINT AS trials, true AS as_good
FROM (VALUES (0, 1, 'kept', 10), (0, 1, 'pruned', 20), (1, 2, 'kept', 4), (1, 2, 'pruned', 6), (2, 4, 'done', 4)) v(rung, budget, state, trials)"""
oracle(
    "grid_search", "split",
    body=f"""SELECT run_name, {FIT_FACTS}, true AS ranked
             FROM (VALUES ('base'), ('narrow'), ('long'), ('longer'), ('mean')) v(run_name)""",
)
oracle(
    "score_documents", "tok", "pooled",
    body=f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label_id))::INTEGER AS rank, label_id,
               CASE label_id {' '.join(f"WHEN {i} THEN {quoted(n)}" for i, n in enumerate(LABEL_NAMES))} END AS label_name,
               round(p, 6) AS prob
        FROM (SELECT doc_id, label_id, exp(logit - top) / sum(exp(logit - top)) OVER (PARTITION BY doc_id) AS p
              FROM (SELECT *, max(logit) OVER (PARTITION BY doc_id) AS top
                    FROM (SELECT p.doc_id, w.label_id, sum(p.mean_x * w.weight) AS logit
                          FROM pooled p JOIN (SELECT t.label AS label_id, dim, avg(mean_x) AS weight
                                              FROM pooled JOIN tok t USING (doc_id) WHERE t.split = 'train'
                                              GROUP BY t.label, dim) w USING (dim)
                          GROUP BY p.doc_id, w.label_id)))""",
)
RNN_LOGITS = f"""SELECT f.doc_id, label_id::INTEGER AS label_id, {_dot("f.h", "wc[label_id + 1]")} + bc[label_id + 1] AS logit
        FROM (SELECT doc_id, arg_max(h, pos) AS h FROM states GROUP BY doc_id) f, net, (SELECT unnest(range(4)) AS label_id)"""
oracle("rnn_score", "tok", "cut", "states", body=f"SELECT doc_id, label_id, round(logit, 6) AS logit FROM ({RNN_LOGITS})")
# text to ranked classes: the soft-max of the recurrent scores
oracle(
    "score_documents_rnn", "tok", "cut", "states",
    body=f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label_id))::INTEGER AS rank, label_id,
               CASE label_id {' '.join(f"WHEN {i} THEN {quoted(n)}" for i, n in enumerate(LABEL_NAMES))} END AS label_name, round(p, 4) AS prob
        FROM (SELECT doc_id, label_id, exp(logit) / sum(exp(logit)) OVER (PARTITION BY doc_id) AS p FROM ({RNN_LOGITS}))""",
)

oracle(
    "rnn_score_bilstm", "tok", "both_features",
    body=f"""SELECT t.doc_id, w.label_id, round(coalesce(sum(f.v * w.x), 0.0) + any_value(w.b), 6) AS logit
        FROM tok t
        CROSS JOIN (SELECT (vec_id - {2 * DIR})::INTEGER AS label_id, unnest(embedding[1:{4 * H}])::DOUBLE AS x,
                           generate_subscripts(embedding[1:{4 * H}], 1) - 1 AS f,
                           (SELECT embedding FROM embeddings WHERE vec_id = {2 * DIR + 4})[vec_id - {2 * DIR} + 1]::DOUBLE AS b
                    FROM embeddings WHERE vec_id BETWEEN {2 * DIR} AND {2 * DIR + 3}) w
        LEFT JOIN both_features f ON f.doc_id = t.doc_id AND f.f = w.f
        GROUP BY t.doc_id, w.label_id""",
)

ORACLES["score_rows"], ORACLES["encode_rows"] = ORACLES["score_documents"], ORACLES["encode"]

# --- files ---------------------------------------------------------------------------------------------
oracle(
    "csv_source", "decoded",
    body="SELECT class_index::DOUBLE::INTEGER - 1 AS label, coalesce(title, '') || ' ' || coalesce(description, '') AS text FROM decoded",
)
oracle(
    "batch_files", "tok", "cut",
    body="""SELECT t.doc_id, t.label, greatest(1, len(coalesce(c.ids, [])))::INTEGER AS length,
               array_to_string(list_resize(coalesce(c.ids, []), 96, 0), ' ') AS input_ids,
               (row_number() OVER (ORDER BY md5('42|1|' || t.doc_id), t.doc_id) - 1) // 128 AS batch_id,
               (row_number() OVER (ORDER BY md5('42|1|' || t.doc_id), t.doc_id) - 1) % 128 AS slot
        FROM tok t LEFT JOIN (SELECT doc_id, list(idx ORDER BY pos) AS ids FROM cut GROUP BY doc_id) c USING (doc_id)
        WHERE t.split = 'train'""",
)
oracle(
    "vector_files", "matrix",
    body="SELECT token, dim::INTEGER AS dim, round(x, 6) AS x FROM matrix WHERE found",
)
oracle("history_files", "history", body="SELECT * FROM history")

ORACLES["score_saved_run"] = f"SELECT doc_id, {len(LABEL_NAMES)}::BIGINT AS classes, true AS agrees FROM documents"
