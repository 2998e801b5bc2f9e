"""Registered queries without a SQL twin against brute force, and the pipeline."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_texts import distance
from wordloom.llm.catalog import REGISTRY


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_bpe_query(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = REGISTRY["op4_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_neighbour_query(spark, sf_dir):
    data = table(spark, sf_dir, "embeddings").toPandas()
    ids, x = data["vec_id"].to_numpy(), np.array(data["embedding"].tolist(), float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = REGISTRY["op2_ann"](spark, sf_dir).toPandas()
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        score = x @ x[ids == q][0]
        score[ids == q] = -9
        best = set(ids[np.lexsort((ids, -score))[:5]])
        hits += len(best & set(got[got["query_id"] == q]["vec_id"]))
        total += 5
    assert hits >= 0.9 * total == 0.9 * len(got)


def test_severity_query(spark, sf_dir):
    got = {r["doc_id"]: r for r in REGISTRY["op5_toxicity"](spark, sf_dir).collect()}
    assert len(got) == table(spark, sf_dir, "documents").count()
    labels = table(spark, sf_dir, "labels").collect()
    right = Counter(bool(r["toxic"]) == got[r["doc_id"]]["toxic"] for r in labels)
    assert right[True] >= 0.85 * len(labels)


def test_mixing_query(spark, sf_dir):
    rows = REGISTRY["op7_mixing"](spark, sf_dir).toPandas()
    sources = table(spark, sf_dir, "documents").select("doc_id", "source").toPandas()
    sums = rows.merge(sources).groupby("source").agg(t=("target", "first"), took=("taken", "sum"))
    assert (abs(sums["took"] / sums["t"] - 1) < 0.05).all() and (rows["taken"] <= 3 * rows["size"]).all()


def test_page_query(spark, sf_dir):
    source = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    rows = REGISTRY["op10_pages"](spark, sf_dir).collect()
    assert len(rows) == len(source)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_line_query(spark, sf_dir):
    """Against all pairs of lines; those too far apart by length or by words are not measured."""
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    places = {}
    for d, text in sorted(docs.items()):
        for i, line in enumerate(text.split("\n")):
            words = tuple(regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).split())
            if words:
                places.setdefault(words, []).append((d, i))
    names = sorted(places, key=len)
    sets, root = [set(n) for n in names], list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b, long in enumerate(names):
        for a in range(b - 1, -1, -1):
            if 5 * (len(long) - len(names[a])) > len(long):
                break
            if 5 * max(len(sets[b] - sets[a]), len(sets[a] - sets[b])) <= len(long) and 5 * distance(names[a], long) <= len(long):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, n in enumerate(names):
        groups.setdefault(find(i), []).extend(places[n])
    gone = {p for g in groups.values() for p in g} - {min(g) for g in groups.values()}
    rows = REGISTRY["op9_lines"](spark, sf_dir).collect()
    assert len(rows) == len(docs) and gone
    for r in rows:
        lines = docs[r["doc_id"]].split("\n")
        kept = "\n".join(x for i, x in enumerate(lines) if (r["doc_id"], i) not in gone)
        assert r["n_lines"] == len(lines) and r["n_removed"] == sum((r["doc_id"], i) in gone for i in range(len(lines)))
        assert r["kept_chars"] == len(kept) and r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_ctw_query(spark, sf_dir):
    """Folds and counts by a plain loop; texts that were learned from need fewer bits than under the word model."""
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)) for d, t in docs.items()}
    held = {d for d in docs if zlib.crc32(str(d).encode()) % 7 == 2}
    counts = Counter(w for d in docs.keys() - held for w in [*words[d], None])
    total, kinds = sum(counts.values()), len(counts)
    rows = REGISTRY["op12_ctw"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows if r["held_out"]} == held and len(rows) == len(docs)
    for r in rows:
        own = [*words[r["doc_id"]], None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)) < 1e-6
    assert all(0.2 < r["bits_per_byte"] < 4 for r in rows if r["n_tokens"] > 30)
    seen = [r["bits_per_byte"] for r in rows if not r["held_out"] and r["n_tokens"] > 30]
    new = [r["bits_per_byte"] for r in rows if r["held_out"] and r["n_tokens"] > 30]
    assert np.mean(seen) < np.mean(new)


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in docs.select("n_chars", "text").collect())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] <= counts[2] and counts[5] == counts[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = Counter(r["text"] for r in spark.read.parquet(str(tmp_path / "3")).collect())
    want = Counter()
    for t, n in mixed.items():
        want[tuple(library.encode(t, add_special_tokens=False).ids)] += n
    assert Counter(tuple(r["ids"]) for r in docs.collect()) == want


def test_pipeline_of_nothing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
