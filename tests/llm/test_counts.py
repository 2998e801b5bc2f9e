"""Filter audit, context trees and collocations on small tables with edge rows, by brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from wordloom.llm import audit, collocations, ctw
from wordloom.llm.fields import Tally, bit_field, member
from wordloom.session import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, hash string, n string, key string, block string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = "The of and River stone quiet lamp over under green seven walk é ü".split()

    def prose(n):
        return "".join(rng.choice(vocab) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(n))

    texts = [prose(rng.randint(0, 160)) for _ in range(70)]
    texts += [None, "", " \n\t ", "#" * 40, "ABC " * 120, prose(6_000), "ß, é; " * 50, texts[2], texts[2], texts[9]]
    more = [(i, t, rng.choice(["en", "fr", "und", None]), "h", "x", "y", "z") for i, t in enumerate(texts)]
    return more + [more[2], more[4], (None, texts[2], "en", *"hxyz"), (7, texts[9], None, *"hxyz"), (500, texts[2], "fr", *"hxyz")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return written(spark.createDataFrame(rows, SCHEMA))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- audit


def failures(rows):
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, lang, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)}
        f |= {"D": bool(set("#$%&*|") & set(t)), "E": d is not None and d > least[t]}
        yield d, lang or "", {k for k, v in f.items() if v}


def audited(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    parts = defaultdict(list)
    for d, part, failed in failures(rows):
        parts[part].append((d, failed))
    out = {}
    for part, own in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            for k, c in enumerate(order):
                done = set(order[:k])
                gone = [d for d, f in own if c in f and not f & done]
                shapley[c] += len(gone)
                out[part, "".join(order), k + 1] = [
                    sum(not f & (done | {c}) for _, f in own),
                    len(gone),
                    sum(c in f and bool(f & done) for _, f in own),
                    sum(f == {c} for _, f in own),
                    sum(d in good for d in gone if d is not None),
                    sum(d in toxic for d in gone if d is not None),
                    c,
                ]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return out


def test_audit(spark, docs, rows, nothing, budget, monkeypatch):
    monkeypatch.setattr(audit, "SALT_ROWS", 2)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 80, 3)] + [(3, 1, 1), (None, 1, 1), (9, None, None)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit.audit(docs, table)
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got.collect()} == audited(rows, labels)
    assert audit.audit(nothing, table).count() == 0


def test_audit_of_many_copies(spark):
    rows = [(i, "one text " * 60 if i % 2 else f"text {i}", "en") for i in range(2_000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(16)
    got = audit.audit(table, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    first = got.where("filter_order = 'EABCD' and step = 1").first()
    assert first["removed"] == 999 and first["kept"] == 1_001


# --- context trees


def coded(text):
    return "".join(w + " " for w in WORD.findall((text or "").translate(LOWER))).encode() + b"\n"


def tree_scores(rows, depth):
    """log10 probability of every text under the tree, node by node."""
    learned = [coded(t) for d, t, *_ in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    path = [[((1 << j) | (b >> (8 - j)), b >> (7 - j) & 1) for j in range(8)] for b in range(256)]
    counts, longer = defaultdict(lambda: [0, 0]), defaultdict(set)

    def contexts(text, i):
        before = (b" " * depth + text[:i])[-depth:] if depth else b""
        return [before[len(before) - k :] for k in range(depth + 1)]

    for text in learned:
        for i, byte in enumerate(text):
            for decision, bit in path[byte]:
                for k, c in enumerate(contexts(text, i)):
                    counts[c, decision][bit] += 1
                    if k < depth:
                        longer[c, decision].add(contexts(text, i)[k + 1])

    def own(node):
        a, b = counts.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    known = {}

    def block(node):
        if node not in known:
            known[node] = own(node)
            if len(node[0]) < depth:
                rest = sum(block((c, node[1])) for c in longer.get(node, ()))
                top = max(known[node], rest)
                known[node] = top + math.log(math.exp(known[node] - top) + math.exp(rest - top)) - math.log(2)
        return known[node]

    def chance(node_path, decision):
        c = node_path[0]
        a, b = counts.get((c, decision), (0, 0))
        one = (b + 0.5) / (a + b + 1)
        if len(node_path) == 1:
            return one
        weight = math.exp(own((c, decision)) - math.log(2) - block((c, decision)))
        return weight * one + (1 - weight) * chance(node_path[1:], decision)

    def score(text):
        out = 0.0
        for i, byte in enumerate(text):
            for decision, bit in path[byte]:
                one = chance(contexts(text, i), decision)
                out += math.log10(one if bit else 1 - one)
        return out

    return [(d, t, score(coded(t))) for d, t, *_ in rows]


@pytest.mark.parametrize("depth", [2, 4])
def test_context_tree(spark, rows, depth, nothing, monkeypatch):
    some = [r for r in rows if r[1] is None or len(r[1]) < 800]
    table = spark.createDataFrame(some, SCHEMA)
    got = ctw.score(table, depth=max(depth, ctw.SHALLOW + 1)).collect()
    want = tree_scores(some, max(depth, ctw.SHALLOW + 1))
    key = lambda r: (str(r[0]), round(r[1], 6))
    found = sorted(((r["doc_id"], r["score"]) for r in got), key=key)
    assert len(found) == len(want)
    for (d, s), (e, x) in zip(found, sorted(((d, s) for d, _, s in want), key=key)):
        assert d == e and s == pytest.approx(x, abs=1e-6)
    empty = ctw.score(nothing)
    assert empty.columns == [*got[0].asDict()] and empty.count() == 0


def test_word_base(spark, docs, rows):
    tokens = Counter()
    for d, t, *_ in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            tokens.update([*WORD.findall((t or "").translate(LOWER)), None])
    total, kinds = sum(tokens.values()), len(tokens)
    want = Counter()
    for d, t, *_ in rows:
        own = [*WORD.findall((t or "").translate(LOWER)), None]
        base = sum(math.log10((tokens[w] + 1) / (total + kinds + 1)) for w in own)
        held = d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        want[d, held, len(own), sum(tokens[w] > 0 for w in own), total, round(base, 6)] += 1
    got = Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in ctw.score(docs).collect()
    )
    assert got == want


def test_blocks_and_parts_do_not_matter(spark, docs, monkeypatch):
    whole = sorted((str(r["doc_id"]), round(r["score"], 6)) for r in ctw.score(docs).collect())
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(ctw, "STREAM_ROWS", 50)
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in ctw.score(docs.repartition(5)).collect()) == whole


def test_nothing_learned(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = ctw.score(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).first()
    assert r["held_out"] and r["train_tokens"] == r["n_known"] == 0 and r["base_score"] == 0
    assert r["score"] < 0 and r["n_tokens"] == 3


def test_chances_sum_to_one():
    """Over all bytes after one context."""
    rng = np.random.default_rng(3)
    grams = np.sort(np.concatenate([(7 << 24) | np.arange(256), (7 << 24) | (1 << 16) | np.arange(256)]))
    tree = ctw.Tree(grams, rng.integers(0, 4, len(grams)), 3, 1)
    chance = 10 ** tree.log_chances(np.zeros(len(tree.top[0])), np.ones(len(tree.top[0])))
    assert np.allclose(chance.reshape(2, 256).sum(axis=1), 1)


def test_parts_keep_groups():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(1).integers(0, 40, 5_000))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 70])], ["key"]) for i in range(0, 5_000, 70)]
    old, ctw.STREAM_ROWS = ctw.STREAM_ROWS, 100
    try:
        parts = [p["key"] for p in ctw.parts_of(iter(batches), 2)]
    finally:
        ctw.STREAM_ROWS = old
    assert np.array_equal(np.concatenate(parts), keys) and len(parts) > 3
    seen = [set((p >> 2).tolist()) for p in parts]
    assert sum(map(len, seen)) == len(set().union(*seen))


# --- collocations


def phrase_table(rows):
    counts, totals = Counter(), Counter()
    for _, t, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return counts, totals


def best_phrases(rows, least, top):
    counts, totals = phrase_table(rows)
    cand = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 80 * cand[lang, p[i : i + k]]:
                    dropped.add((lang, p[i : i + k]))
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        if (lang, p) in dropped:
            continue
        cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    rows = []
    for lang, found in out.items():
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(rows)


@pytest.mark.parametrize("least, top", [(30, 2_000), (3, 50), (1, 10)])
def test_collocations(docs, rows, nothing, least, top):
    got = collocations.collocations(docs, least=least, top=top)
    assert got.columns == "lang rank phrase a l r n score".split()
    assert sorted(map(tuple, got.collect())) == best_phrases(rows, least, top)
    assert collocations.collocations(nothing).count() == 0


def test_full_fields_lose_nothing(docs, rows):
    """Counts go by text, so hashes that all look frequent change nothing."""
    counts, totals = phrase_table(rows)
    base = docs.selectExpr("coalesce(lang, 'und') as lang", "coalesce(text, '') as text")
    full = [docs.sparkSession.sparkContext.broadcast(np.full(16, 255, np.uint8))] * 4
    got = {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in collocations.phrase_counts(base, full).where("size > 0").collect()}
    assert got == dict(counts)


def test_scores_pass_64_bits(spark):
    big = 9_000_000_000_000_000
    rows = [("en", 1, "a", big + 7), ("en", 1, "b", big + 9), ("en", 2, "a b", big), ("en", 0, "", 3 * big)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, n bigint")).first()
    assert (got["l"], got["r"], got["score"]) == (big + 7, big + 9, 2_000_000 * big // (2 * big + 16))


def test_bit_field(spark):
    df = spark.range(0, 3_000).selectExpr("xxhash64(id) as h")
    field = bit_field(df, "h", 20)
    hashes = np.array([r["h"] for r in df.collect()], np.int64).view(np.uint64)
    assert member(field, hashes).all()
    assert member(field, np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.01


def test_tally(monkeypatch):
    monkeypatch.setattr(Tally, "LIMIT", 50)
    rng, tally, want, got = np.random.default_rng(2), Tally(), Counter(), Counter()
    batches = []
    for _ in range(40):
        keys = rng.integers(-30, 30, 17)
        want.update(keys.tolist())
        batches += tally.add(keys, np.ones(17, np.int64))
    for b in [*batches, *tally.rows()]:
        for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got[k] += n
    assert got == want
