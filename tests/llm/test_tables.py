"""Neighbours, chats, Jaccard join, mixing and page text on small tables with edge rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import ann, chat, dom, graph, jaccard, mixing, pages, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 12))
    x[600:] = x[600] + rng.normal(size=(100, 12)) * 1e-3  # a crowd
    rows = [(i, [float(np.float32(c)) for c in v], "extra") for i, v in enumerate(x)]
    rows += [(700, rows[0][1], ""), (701, rows[0][1], ""), (0, rows[0][1], "")]  # copies and a repeated row
    rows += [(800, None, ""), (801, [], ""), (802, [0.0] * 12, ""), (803, [1.0] * 11 + [None], ""), (804, [float("nan")] * 12, "")]
    rows += [(900, [1.0, 2.0], ""), (901, [2.0, 4.5], "")]  # another width, fewer candidates
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    got = defaultdict(list)
    asked = df.where("vec_id % 20 = 0")
    for r in ann.nearest(df, asked, 5, shard_rows=128).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    usable = {i: np.array(v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    hits = total = 0
    for q in sorted(i for i in usable if i % 20 == 0):
        score = {i: (v @ usable[q]) / np.sqrt((v @ v) * (usable[q] @ usable[q])) for i, v in usable.items() if i != q and len(v) == len(usable[q])}
        best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        mine = got.pop(q)
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in mine)
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(best))
        total += len(best)
    assert not got and hits >= 0.95 * total
    assert ann.nearest(df.limit(0), asked.limit(0)).count() == 0


def test_graph_rows_are_flat_and_bounded():
    x = np.random.default_rng(0).normal(size=(500, 8))
    g = ann.Graph(x / np.linalg.norm(x, axis=1)[:, None])
    assert g.links[0][1].shape == (500, 2 * ann.LINKS) and g.links[0][1].dtype == np.int32
    assert len(ann.Graph(np.ones((1, 3))).search(np.ones((2, 3)))) == 2


def test_fold_of_logs(spark):
    log = [
        (1, 0, "create", 0, "user", "Hi"),
        (1, 1, "create", 1, "assistant", None),
        (1, 2, "delta", 1, None, "Hel"),
        (1, 3, "delta", 1, None, "lo"),
        (1, 3, "delta", 1, None, "lo"),  # delivered twice
        (1, 4, "create", 2, "user", "More"),
        (1, 5, "edit", 0, None, "Hi!"),
        (1, 6, "regenerate", 1, None, None),  # also drops message 2
        (1, 7, "delta", 1, None, "Good day"),
        (1, 8, "create", 3, "user", "Thanks"),
        (1, 9, "seen", 3, "user", "?"),
        (None, 0, "create", 0, None, None),
        (2, 5, "delta", 0, "user", "b"),
        (2, 4, "delta", 0, "user", "a"),
    ]
    df = spark.createDataFrame(log, "conv_id bigint, seq bigint, kind string, msg bigint, role string, text string")
    got = {(r["conv_id"], r["msg"]): (r["role"], r["text"]) for r in chat.fold(df).collect()}
    assert got == {
        (1, 0): ("user", "Hi!"),
        (1, 1): ("assistant", "Good day"),
        (1, 3): ("user", "Thanks"),
        (None, 0): ("", ""),
        (2, 0): ("user", "ab"),
    }
    assert chat.fold(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["<|im_start|>", "<|im_end|>", "\\", "\n", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<<", "<", "|", "a", "é", "assistant", ""]
    turns = [
        (c, t, rng.choice(["user", "assistant", "a\nb", "\\", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) if rng.random() < 0.9 else None, 1)
        for c in (1, 2, None)
        for t in (0, 1, 1, None, 2)
    ]
    turns += [turns[0], (3, 0, "assistant", "x" * 5_000, 1)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, msg int")
    segments = chat.render(chat.fold(chat.turn_events(df)))
    back = defaultdict(list)
    for r in segments.orderBy("conv_id", "msg").collect():
        back[r["conv_id"]].append(chat.read_segment(r["segment"]))
    first = lambda v: (v is not None, v if v is not None else 0)  # noqa: E731  nulls first
    want = defaultdict(list)
    for c, t, role, text, _ in sorted(turns, key=lambda r: (first(r[0]), first(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))):
        want[c].append((role or "", text or ""))
    assert {c: sorted(m) for c, m in back.items()} == {c: sorted(m) for c, m in want.items()}
    rows = {r["conv_id"]: r for r in chat.digests(segments).collect()}
    whole = {r["conv_id"]: r["formatted"] for r in chat.formatted(segments).collect()}
    for c, messages in want.items():
        assert rows[c]["n_turns"] == len(messages) and rows[c]["formatted_chars"] == len(whole[c])
        assert rows[c]["loss_chars"] == sum(len(t) for r, t in messages if r == "assistant")
    with pytest.raises(ValueError):
        chat.read_segment("<|im_start|>user\nx<|im_end|>y<|im_end|>\n")


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components_of(rows, width, percent):
    sets, root = defaultdict(list), {i: i for i, _ in rows}
    for i, t in rows:
        sets[i].append(shingles(t, width))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, each in sets.items() for s in each if s]
    for n, (a, x) in enumerate(flat):
        for b, y in flat[:n]:
            k = len(x & y)
            if 100 * k >= percent * (len(x) + len(y) - k):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return Counter((i, len(shingles(t, width)), find(i)) for i, t in rows)


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (1, 70)])
def test_jaccard(spark, width, percent):
    rng = random.Random(width)
    names = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(60):
        base = [rng.choice(names) for _ in range(rng.choice([2, 5, 9, 12, 16, 17, 40, 90]))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(names)
            rows.append((len(rows), " ".join(copy) if rng.random() < 0.8 else " ".join(copy).upper()))
    rows += [(500, None), (501, ""), (502, " \n"), (3, rows[3][1]), (3, rows[9][1]), (503, "x y"), (504, "X\ty")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n int")
    got = jaccard.joined(df, width=width, percent=percent)
    assert Counter(tuple(r) for r in got.collect()) == components_of(rows, width, percent)
    kept = jaccard.first_of_groups(df, width=width, percent=percent)
    gone = {i for i, _, c in components_of(rows, width, percent) if c != i}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - gone and kept.columns == df.columns
    assert jaccard.joined(df.limit(0)).count() == 0


def test_jaccard_pairs_by_their_first_key(spark):
    """A common key so late that too little follows it makes no pair: a set that links shares an earlier one."""
    bits = ", ".join(f"0L {c}" for c in jaccard.BITS + jaccard.OTHER_BITS)
    rows = spark.sql(f"SELECT id, 100 n, 100 m, p pos, q qos, {bits} FROM VALUES (1, 8, 8), (2, 9, 0), (3, 0, 9), (4, 12, 12), (5, -1, 3) AS t(id, p, q)")
    assert [r["id"] for r in rows.where(jaccard.possible(85, 10)).orderBy("id").collect()] == [1, 5]



def test_subsets_of_small_sets_meet():
    """Any two small sets that link share a listed subset, by the sizes alone."""
    for percent in (70, 80, 85):
        for n in range(1, 13):
            for m in range(n, 13):
                c = jaccard.overlap(n, m, percent)
                if c <= n:
                    assert c in jaccard.subset_sizes(n, percent, 12) and c in jaccard.subset_sizes(m, percent, 12)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 100), (7, 7)]
    rng = random.Random(0)
    rng.shuffle(chain)
    df = spark.createDataFrame(chain, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in graph.components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(df.limit(0)).count() == 0


def water(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "é", "", None, "zz"]
    rows = [(i, "w\t" * rng.choice([0, 1, 30, 200]), rng.choice(sources[:-1]), 1) for i in range(400)] + [(900, "one two", "zz", 1), (901, None, "a", 1)]
    rows += [rows[5]] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = mixing.taken(mixing.sized(df)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _, _ in rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target, of = water(dict(sizes)), {i: s for i, _, s, _ in rows}
    took = Counter()
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        took[s] += r["taken"]
    for s in sizes:
        assert abs(took[s] - target[s]) <= 2 * mixing.BLOCK_WORDS + 0.01 * target[s]
    again = mixing.taken(mixing.sized(df.repartition(3))).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    texts = mixing.mixed_documents(df.where("doc_id <> 5"))
    assert texts.columns == df.columns
    mixed = Counter()
    for r in texts.collect():
        mixed[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert all(n <= 3 * len(WORD.findall(rows[i][1])) for i, n in mixed.items() if i < 400)
    assert mixing.taken(mixing.sized(df.limit(0))).count() == 0


def test_draws_and_permutations():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, (1, 2, 3)).tolist()) == list(range(n))
    totals = np.array([500, 0, 33, 1])
    parts = [mixing.shard_counts(totals, k, 50, 9) for k in range(11)]
    assert (sum(c for _, c in parts) == totals).all()
    assert all((sum(c for _, c in parts[:k]) == b).all() for k, (b, _) in enumerate(parts) if k)
    assert [int(c.sum()) for _, c in parts] == [50] * 10 + [34]


ARTICLE = (
    "<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li>Home<li>About</ul></nav><header>Top</header><div class='ad'>Buy</div><div id=cookie-notice>Cookies</div>"
    "<article><h1>Title &lt;{i}&gt;</h1><p><b>First&nbsp;one <i>i</i>talic.<br><p>Second\n  {i}<!-- no --><form>Mail<input></form>"
    "<aside>Side</aside><ul><li>point<li>other</ul><table><tr><td>a<td>b</table></article>"
    "<section class='comments'><article>Reader</article></section><footer>&copy; host</footer></body></html>"
)
PLAIN = (
    "<html><body><div class=menu>Menu</div><div class=top><span>Welcome to the site</span></div>"
    "<div class=text><p>Story number {i} of many words {w}</p><div>More {w}</div></div><div class=low>All rights</div></body></html>"
)


def test_pages(spark):
    rows = [(i, f"http://A.example/{i}", ARTICLE.format(i=i), 1) for i in range(5)]
    rows += [(10 + i, f"https://b.example/{i}?q", PLAIN.format(i=i, w=f"u{i} v{i} " * 30), 1) for i in range(6)]
    rows += [(20, None, "plain <b>text</b> only &#233;", 1), (21, "http://c.example", None, 1), (22, "http://c.example", "", 1), (0, "http://A.example/0", ARTICLE.format(i=0), 1)]
    rows += [(30, "http://d.example/", "<div>" * 300 + "deep" + "</div>" * 300, 1), (31, "http://d.example/x", "<article><p>cut <a href='x", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = {r["page_id"]: r for r in pages.extract(df).collect()}
    assert pages.extract(df).count() == len(rows)
    for i in range(5):
        assert got[i]["text"] == f"Title <{i}>\nFirst one italic.\nSecond {i}\npoint\nother\na\nb"
    for i in range(6):
        w = " ".join([f"u{i} v{i}"] * 30)
        assert got[10 + i]["text"] == f"Story number {i} of many words {w}\nMore {w}"
    assert got[20]["text"] == "plain text only é" and got[21]["text"] == "" == got[22]["text"]
    assert got[30]["text"] == "deep" and got[31]["text"].startswith("cut")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert pages.extract(df.limit(0)).count() == 0


LEAD = (
    "<html><body><div class=post><h1>Title {i}</h1><div class=intro>Lead {i} of it</div><div class=text>Long text {w}</div></div>"
    "<div class=more>Read on</div></body></html>"
)


def test_pages_keep_title_and_lead(spark):
    rows = [(i, f"http://e.example/{i}", LEAD.format(i=i, w=f"w{i} " * 80), 1) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()}
    for i in range(6):
        assert got[i] == f"Title {i}\nLead {i} of it\nLong text " + " ".join([f"w{i}"] * 80)


def test_copies_do_not_make_template(spark):
    """A host of equal pages keeps their text; copies of one page beside others leave those alone."""
    copy = LEAD.format(i=1, w="same " * 20)
    rows = [(i, f"http://f.example/{i}", copy, 1) for i in range(4)]
    rows += [(10 + i, f"http://g.example/{i}", LEAD.format(i=i if i > 3 else 0, w=f"g{i if i > 3 else 0} " * 20), 1) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()}
    for i in range(4):
        assert got[i] == "Title 1\nLead 1 of it\nLong text " + " ".join(["same"] * 20) + "\nRead on"
    for i in range(8):
        k = i if i > 3 else 0
        assert got[10 + i] == f"Title {k}\nLead {k} of it\nLong text " + " ".join([f"g{k}"] * 20)


@pytest.mark.parametrize("depth", [1, 70, 3_000])
def test_pages_at_any_depth(spark, depth):
    inner = "<nav><ul><li>MENU ITEM</ul></nav><aside>ADVERT</aside><p>real</p>"
    page = "<html><body>" + "<section>" * depth + inner + "</section>" * depth + "</body></html>"
    df = spark.createDataFrame([(1, "http://h.example/", page)], "page_id bigint, url string, html string")
    assert pages.extract(df).first()["text"] == "real"


def tree(text):
    """(keys, sizes) of a nested tuple."""
    keys, sizes = [text[0]], [1]
    for child in text[1]:
        k, s = tree(child)
        keys += k
        sizes += s
        sizes[0] += s[0]
    return tuple(keys), tuple(sizes)


def test_tree_matching():
    a = ("r", (("x", (("p", ()),)), ("y", ()), ("z", (("p", ()), ("q", ())))))
    b = ("r", (("x", ()), ("z", (("q", ()),)), ("y", ())))
    found = dom.match(tree(a), tree(b))  # places: r0 x1 p2 y3 z4 p5 q6 / r0 x1 z2 q3 y4
    assert found == {0: 0, 1: 1, 4: 2, 6: 3}
    assert dom.match(tree(a), tree(("other", ()))) == {}


def test_mix_keeps_null_ids_and_sources_apart(spark):
    def text(tag, n):
        return " ".join(f"{tag}{i}" for i in range(n))

    rows = [(i, text(f"x{i}w", 320), "a") for i in range(20)]
    rows += [(None, text("n1w", 640), "a"), (None, text("n2w", 640), None), (None, text("n3w", 640), "b")]
    rows += [(900, text("both", 640), "a"), (900, text("both", 640), "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    _, spans = mixing.mix(mixing.sized(df))
    want = spans.groupBy("source_no").agg(F.sum(F.col("last") - F.col("first")).alias("n")).collect()
    want = {("a", "b", None)[r["source_no"]]: r["n"] for r in want}
    got = dict.fromkeys(want, 0)
    for r in mixing.mixed_documents(df).collect():
        got[r["source"]] += len(r["text"].split())
    assert got == want


def test_clashing_columns(spark):
    """Columns of the input that bear names which the operators use inside come back as they were."""
    rng = random.Random(14)
    words = "the of and river stone quiet lamp over under green seven walk".split()
    names = "_t _lang _words _rest _word_share ref_words ref_longest ref_class_share _key _turn _hash _doc _turns source_no _gone _in _id _of _cut".split()
    rows = [(i, " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(120)), "en", "s", *[f"{c}{i}" for c in names]) for i in range(12)]
    rows += [(20, rows[3][1], *rows[3][2:])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in names))
    own = {r[0]: r[4:] for r in rows}
    for out in (quality.judge(df), jaccard.first_of_groups(df), mixing.mixed_documents(df)):
        got = out.collect()
        assert got and set(df.columns) <= set(out.columns)
        for r in got:
            assert tuple(r[c] for c in names) == own[r["doc_id"]]
    assert {r["doc_id"] for r in jaccard.first_of_groups(df).collect()} == {r[0] for r in rows} - {20}


def test_shares_of_large_mixes():
    """Above a group of shards the totals of the groups follow the sources' shares; all slots are dealt once."""
    totals = np.array([5_000_000, 3, 2_100_000, 0])
    n = -(-int(totals.sum()) // 50)
    parts = [mixing.shard_counts(totals, k, 50, 9) for k in (0, 1, 1023, 1024, 70_000, n - 1)]
    assert all(int(c.sum()) == 50 for _, c in parts[:-1]) and (parts[0][0] == 0).all()
    assert (parts[0][0] + parts[0][1] == parts[1][0]).all() and (parts[2][0] + parts[2][1] == parts[3][0]).all()
    assert (parts[-1][0] + parts[-1][1] == totals).all()
    middle = parts[4][0] / (70_000 * 50)
    assert abs(middle[0] - 5_000_000 / 7_100_003) < 0.001


def test_quality_rest_takes_one_pattern(spark):
    """White space goes without a pattern, so that a run of a-z is many words long."""
    texts = ["", " ", "ab cd\tEf\n\x0b\x0c\rg-1  \x1fé x", "\x08\x0e a"]
    out = quality.with_rest(spark.createDataFrame([(t,) for t in texts], "_t string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    for r in out.collect():
        white = [c for c in r["_t"] if c in " \t\n\x0b\x0c\r"]
        lower = [c for c in r["_t"] if "a" <= c <= "z"]
        rest = "".join(c for c in r["_t"] if c not in white and c not in lower)
        assert (r["_rest"], r["_lower"], r["_white"]) == (rest, len(lower), len(white))
