"""Quality rules, BPE, severity, substring and line removal on small tables with edge rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm import bpe, lines, quality, substrings, toxicity
from wordloom.session import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string, ids string, spans string"


def words(rng, n):
    return [rng.choice("the of and river stone quiet lamp over under green seven walk".split()) for _ in range(n)]


def prose(rng, n):
    out = words(rng, n)
    return " ".join(w + ("\n" if rng.random() < 0.1 else "." if rng.random() < 0.1 else "") for w in out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 150)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5] + " one more", None, "", " \n\t ", "###" * 30, prose(rng, 9_000), "é ü\nß " * 40]
    rows = [(i, t, "en" if i % 3 else None, "s", "x", "y", "z") for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[3], "en", None, None, None, None), (7, texts[9], "en", "s", "x", "y", "z")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return written(spark.createDataFrame(rows, SCHEMA))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def base_counts(text):
    w = WORD.findall(text or "")
    seen, twins = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            twins += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, twins, len(covered)


def test_quality(docs, rows, nothing):
    got = quality.judge(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "ids", "spans", *quality.BASE, "class_distance", "word_distance", "kept"]
    found = Counter()
    for r in got.collect():
        counts = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert counts == base_counts(r["text"])
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r["kept"] and r["base_failed"])
        found[r["doc_id"], r["text"]] += 1
    assert found == Counter((r[0], r[1]) for r in rows)
    assert quality.judge(nothing).count() == 0


def test_quality_divergence(spark):
    rng = random.Random(1)
    clean = [" ".join(f"{w}{rng.choice('abcdefgh')}" if rng.random() < 0.6 else w for w in words(rng, 200)) for _ in range(60)]
    noise = [" ".join(w + "%%%" for w in t.split()) for t in clean[:3]]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + noise)], "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in quality.judge(df).where("kept or base_failed").collect()}
    assert kept == set(range(60))


def test_quality_limits_are_in_reach(spark):
    """Wrong languages, word lists and short junk go; clean short texts of each language stay."""
    rng = random.Random(5)
    common = {"en": "the of and to in a is it".split(), "de": "der die das und zu den von mit".split()}
    rare = {lang: [f"{s}{a}{b}" for a in "abcdefghijklm" for b in "nopqrstuvwxyz" for s in ss] for lang, ss in (("en", ["stone", "wal"]), ("de", ["berg", "licht"]))}

    def clean(lang, n):
        return " ".join(rng.choice(common[lang]) if rng.random() < 0.23 else rng.choice(rare[lang]) for _ in range(n))

    base = [(clean(lang, n), lang) for lang in common for n in [300] * 40 + [25, 40, 80] * 4]
    bad = [(clean("de", 200), "en"), (clean("en", 80), "de"), (" ".join(rng.choice(rare["en"]) for _ in range(150)), "en")]
    bad += [(" ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(120)), "de")]
    bad += [(" ".join(f"{w}###" if i % 2 else f"{rng.getrandbits(30)}$$$" for i, w in enumerate(clean("en", 20).split())), "en")]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(base + bad)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if r["kept"]} == set(range(len(base)))


def test_bpe_equals_library(docs, rows, nothing, spark):
    library = Tokenizer.from_file(TOKENIZER)
    odd = ["Don't 'RE x's", "<|endoftext|>a<|startoftext|>", "İΑΣ é ﬁ", "a\x1cb\x85c　d", "日本語🙂", "aaaaaaaaaaa", "２³½"]
    table = docs.select("doc_id", "text", "ids").union(spark.createDataFrame([(i, t, "") for i, t in enumerate(odd)], "a bigint, b string, c string"))
    got = bpe.encode(table, TOKENIZER)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    for r in got.collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(nothing, TOKENIZER).count() == 0 and bpe.digests(nothing, TOKENIZER).count() == 0


def test_bpe_merges_overlapping_pairs_from_the_left():
    vocab = bpe.Vocabulary(TOKENIZER)
    library = Tokenizer.from_file(TOKENIZER)
    for text in ("a" * n for n in range(1, 40)):
        ids, _ = bpe.encode_words(vocab, [text.encode()])
        assert ids.tolist() == library.encode(text).ids


def test_severity(spark, nothing):
    rng = random.Random(2)
    bad = ["vile", "nasty", "awful"]

    def text(n):
        out = words(rng, 60) + [rng.choice(bad) for _ in range(n)]
        rng.shuffle(out)
        return " ".join(out)

    counts = [rng.choice([0, 0, 0, 1, 3, 6]) for _ in range(800)]
    df = spark.createDataFrame([(i, text(n)) for i, n in enumerate(counts)] + [(900, None), (901, "")], "doc_id bigint, text string")
    seen = [(i, int(n > 0), 1) for i, n in enumerate(counts) if i < 600] + [(None, 1, 1), (1, None, 1), (5000, 1, 1)]
    labels = spark.createDataFrame(seen, "doc_id bigint, toxic int, quality int")
    model = toxicity.fit(df, labels)
    assert (model.thresholds[1:] > model.thresholds[:-1]).all()
    got = {r["doc_id"]: r for r in toxicity.severity(df, model).collect()}
    held_out = [(got[i]["toxic"], n > 0) for i, n in enumerate(counts) if i >= 600]
    assert sum(a == b for a, b in held_out) >= 0.97 * len(held_out)
    mean = {n: sum(got[i]["expected_severity"] for i, c in enumerate(counts) if c == n) / counts.count(n) for n in (0, 1, 3, 6)}
    assert mean[0] < mean[1] < mean[3] < mean[6]
    assert not got[900]["toxic"] and got[900]["expected_severity"] == got[901]["expected_severity"]
    none = toxicity.fit(df, labels.limit(0))
    assert not any(r["toxic"] for r in toxicity.severity(df, none).collect())
    assert toxicity.severity(nothing, model).count() == 0


def removed_bytes(rows, length):
    first = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            if d is not None:
                first[b[i : i + length]] = min(d, first.get(b[i : i + length], d))
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_substrings(docs, rows, nothing, spark, monkeypatch):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = Counter(tuple(r) for r in substrings.digests(docs).select(names).collect())
    assert got == removed_bytes(rows, substrings.LENGTH)
    assert substrings.digests(nothing).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # groups cross batches
    try:
        got = Counter(tuple(r) for r in substrings.digests(docs).select(names).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == removed_bytes(rows, substrings.LENGTH)


def test_substrings_by_seams_of_shards(monkeypatch):
    """Segments of one gram that arrive in several batches are solved together."""
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(len(data) - 9)
    doc = starts // 100
    mask = substrings.repeated_windows(data, starts, np.full(len(starts), len(data)), doc, 10)
    seen = defaultdict(set)
    for s in starts:
        seen[data[s : s + 10].tobytes()].add(doc[s])
    assert mask.tolist() == [min(seen[data[s : s + 10].tobytes()]) < doc[s] for s in starts]


def test_longest_previous_factors():
    """Against the longest common prefix with any start of a smaller document."""
    import numpy as np

    rng = np.random.default_rng(9)
    for letters, segments in ((2, 12), (3, 30), (26, 8)):
        sizes = rng.integers(6, 130, segments)
        data = rng.integers(97, 97 + letters, int(sizes.sum())).astype(np.uint8)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if segments == 8:
            data[bounds[5] : bounds[5] + 100] = data[:100]
        starts = np.concatenate([np.arange(a, b - 5) for a, b in zip(bounds, bounds[1:])])
        which = np.searchsorted(bounds, starts, side="right") - 1
        ends, doc = bounds[which + 1], rng.integers(0, segments // 2, segments)[which]

        def common(s, t, ends=ends, data=data, starts=starts):
            a = data[starts[s] : min(ends[s], starts[s] + 6 + substrings.TAIL)]
            b = data[starts[t] : min(ends[t], starts[t] + 6 + substrings.TAIL)]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            return differ[0] if len(differ) else n

        got = substrings.longest_previous(data, starts, ends, doc, 6)
        for s in range(0, len(starts), 7):
            want = max((common(s, t) for t in np.flatnonzero(doc < doc[s])), default=0)
            assert got[s] == want if want >= 6 else got[s] < 6


def test_substrings_of_a_hot_passage(spark, monkeypatch):
    """A passage in a third of all documents, in other surroundings each, with and without the split of
    crowded grams."""
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = []
    for i in range(240):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 120)))
        rows.append((i * 7 % 240, own + (passage if i % 3 == 0 else "") + own[::-1]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = removed_bytes(rows, substrings.LENGTH)
    for hot in (1 << 15, 40, 1):
        monkeypatch.setattr(substrings, "HOT_SEGMENTS", hot)
        assert Counter(tuple(r) for r in substrings.digests(df).select(names).collect()) == want


def test_merged_runs():
    import numpy as np

    start, end = np.array([0, 2, 3, 20, 0, 9, 5, 40]), np.array([9, 4, 12, 22, 9, 10, 6, 41])
    group = np.array([0, 0, 0, 0, 1, 1, 2, 2])
    first, last = substrings.merged(start, end, group)
    assert first.tolist() == [0, 3, 4, 6, 7] and last.tolist() == [12, 22, 10, 6, 41]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def kept_lines(rows, keys):
    """Texts without repeated lines, by comparing all pairs."""

    def norm(line):
        return tuple(regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ").split())

    places = defaultdict(set)
    for d, t, *_ in rows:
        for i, line in enumerate((t or "").split("\n")):
            if norm(line):
                places[norm(line)].add((-(2**63) if d is None else d, t, i))
    names = list(places)
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(names)), 2):
        longer = max(len(names[a]), len(names[b]))
        if 5 * abs(len(names[a]) - len(names[b])) <= longer and 5 * distance(names[a], names[b]) <= longer:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups = defaultdict(set)
    for i, n in enumerate(names):
        groups[find(i)] |= places[n]
    gone = set()
    for g in groups.values():
        least = min(g, key=lambda p: (p[0], keys[p[0], p[1]], p[2]))
        gone |= g - {least}
    out = []
    for d, t, *_ in rows:
        i = -(2**63) if d is None else d
        out.append((d, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, t, n) not in gone)))
    return Counter(out)


def test_lines(spark, docs, rows, nothing):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randint(0, 400)}" for _ in range(120))
    edited = long.split()
    edited[60] = "changed"
    more = [(100, f"first line stays\n{long}"), (101, " ".join(edited) + "\nshort one"), (102, long.upper() + " ..."), (103, None)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    data = [(r[0], r[1]) for r in table.collect()]
    keyed = lines.keyed(table, "doc_id", "text").collect()
    keys = {(r["_id"], r["text"]): r["_key"] for r in keyed}
    got = Counter((r["doc_id"], r["text"]) for r in lines.dedup(table).collect())
    assert got == kept_lines(data, keys)
    assert got[101, "short one"] == 1 and got[102, ""] == 1 and got[103, None] == 1
    assert lines.dedup(nothing).columns == nothing.columns and lines.dedup(nothing).count() == 0


def test_lines_finds_all_similar_pairs(spark):
    """Against edit similarity alone, at and around the limit and over common words."""
    rng = random.Random(21)
    vocab = [f"word{i}" for i in range(3_000)]
    texts = []
    for n in [5, 6, 8, 9, 10, 12, 14, 15, 19, 24, 40, 70, 100] * 6:
        line = [rng.choice(vocab[:12] if rng.random() < 0.4 else vocab) for _ in range(n)]
        texts.append(line)
        for edits in (n // 5, n // 5 + 1, (n + 1) // 5):
            other = list(line)
            for _ in range(edits):
                i = rng.randrange(len(other))
                kind = rng.randrange(3)
                other[i : i + (kind != 1)] = [] if kind == 2 else [rng.choice(vocab)]
            texts.append(other)
    texts = list(dict.fromkeys(" ".join(t) for t in texts if len(t) >= lines.MIN_WORDS))
    rng.shuffle(texts)
    split = [t.split() for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        longer = max(len(split[a]), len(split[b]))
        if 5 * abs(len(split[a]) - len(split[b])) <= longer and 5 * len(set(split[a]) - set(split[b])) <= longer:
            if 5 * distance(split[a], split[b]) <= longer:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {i for i in range(len(texts)) if find(i) == i}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in lines.dedup(df).where("text <> ''").collect()} == want


def test_lines_verifies_few_pairs(spark, monkeypatch):
    """Lines of the same common words elsewhere are no candidates; changed copies are found."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(20, 60))) for _ in range(300)]
    copies = [f"{t} z{i}" for i, t in enumerate(texts[:40])]
    verified, pairs = lines.verified, []
    monkeypatch.setattr(lines, "verified", lambda p, seqs: (pairs.append(p.count()), verified(p, seqs))[1])
    df = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in lines.dedup(df).where("text <> ''").collect()} == set(range(300))
    assert sum(pairs) < 15_000  # of 57,630


def test_short_lines(spark):
    """Very short lines are linked with equal ones only; lines without a word stay."""
    rows = [(i, f"Click here now\nbody of text number{i} alone\n\n***\nsubscribe, today!\nread {i}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in lines.dedup(df).collect()}
    assert got[0] == rows[0][1].split("\n")
    for i in range(1, 6):
        assert got[i] == ["", "***", f"read {i}"]  # one word of five differs in the second line


def test_lines_with_clashing_columns(spark):
    names = ["_id", "_key", "_gone", "_row", "k1", "pos", "keys", "norm", "hub"]
    rows = [(i, "one two three four five six" if i % 2 else f"line {i}", *[f"{c}{i}" for c in names]) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in names))
    got = sorted(map(tuple, lines.dedup(df).collect()))
    assert got == sorted((r[0], "" if r[0] % 2 and r[0] > 1 else r[1], *r[2:]) for r in rows)


@pytest.mark.parametrize("n", [1, 5, 63, 64, 300, 17_000])
def test_simhash_counters(spark, n):
    rng = random.Random(n)
    text = " ".join(f"t{rng.randint(0, 50)}" for _ in range(n))
    df = spark.createDataFrame([(text,)], "t string").withColumn("w", F.split("t", " "))
    row = df.select(lines.simhash(F.col("w")).alias("s"), F.transform("w", lambda w: F.xxhash64(w)).alias("h")).first()
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in row["h"]) > n)
    assert row["s"] & (2**64 - 1) == want


def test_lines_slice_by_slice(spark, monkeypatch):
    """The same lines go if keys are taken in slices; but for the lines to remove no table stays on disk."""
    rng = random.Random(17)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(60)]) for _ in range(rng.randrange(5, 30))) for _ in range(120)]
    texts += [f"{t} more" for t in texts[:50]] + texts[:10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = sorted(map(tuple, lines.dedup(df).collect()))
    assert sum(not t for _, t in want) >= 10
    slices, kept = [], set()
    shared_keys, written, forget = lines.shared_keys, lines.written, lines.forget

    def write(table, *folders):
        out = written(table, *folders)
        kept.add(out._wordloom_path)
        return out

    monkeypatch.setattr(lines, "SLICE_ROWS", 100)
    monkeypatch.setattr(lines, "shared_keys", lambda keys: (slices.append(1), shared_keys(keys))[1])
    monkeypatch.setattr(lines, "written", write)
    monkeypatch.setattr(lines, "forget", lambda *tables: (kept.difference_update(t._wordloom_path for t in tables), forget(*tables))[1])
    gone = lines.gone_lines(df, "doc_id", "text")
    assert len(slices) > 4 and gone._wordloom_path in kept and len(kept) < 10  # small tables of links and groups
    assert sorted(map(tuple, lines.dedup(df).collect())) == want
