"""N-gram Jaccard join: documents whose shingle sets are similar, and their components.

Method: a size-aware heavy-light join.  Equal sets are one class.  Small sets (light) list
their subsets of the fixed sizes that a link to another small set needs; two small sets that
link share one.  Large sets (heavy) enter inverted lists by the first shingles of a global
order, as many as a linking pair must have one of in common.  Small sets within reach of large
ones enter the lists, too.  The boundary is the largest size up to which listing subsets costs
no more keys than scanning inverted lists, by the lengths of the lists of such sets.

The order puts shingles of crowded hash buckets last and, before them, those first whose words are
rare together: the sum of the words' log frequencies, counted by hash bucket.  So the first
shingles of a set are met in copies and hardly anywhere else, at any size of the corpus.  The
order only decides the work: any order gives the same links.

Keys that only one class has never meet anything.  A first count finds the others; a bit field of
bounded size lets only those be listed with what a list needs.

Lists are not expanded into pairs.  First every member of a list is compared with the list's
smallest member, and links are joined into components.  Then the pairs of a list that lie in
different components are compared as well, so that no link between components is lost.  Every
candidate is verified on whole texts by exact counts.

Null or empty text: an empty set, linked with nothing.  A text with fewer words than a shingle
is one shingle.  Equal rows are members of one class; rows that share a doc_id are one node.
Sets are compared by 64-bit hashes of their shingles."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm import batches as B
from wordloom.llm.fields import bit_field, field_bits, member
from wordloom.llm.graph import components, rooted
from wordloom.session import bounded_join, fits_broadcast, forget, fresh, written

WIDTH = 4
PERCENT = 85
ORDER_BUCKETS = 1 << 18
CROWDED = 0.99  # quantile of the bucket counts above which a bucket's shingles come last
BIT_WORDS = 4  # a prefix is sketched in 256 bits
BITS = [f"x{i}" for i in range(BIT_WORDS)]
OTHER_BITS = [f"y{i}" for i in range(BIT_WORDS)]
MOST_SUBSETS = 64  # no set above the size that needs more subsets is light


def overlap(a: int, b: int, percent: int) -> int:
    """Least intersection of linked sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def least_partner(n, percent: int):
    """Smallest size that a set of size n can link with."""
    return -(-percent * n // 100)


def subset_sizes(n: int, percent: int, boundary: int) -> list[int]:
    """Sizes of the subsets that a light set of size n lists."""
    sizes = {overlap(n, m, percent) for m in range(least_partner(n, percent), boundary + 1) if least_partner(m, percent) <= n}
    return sorted(c for c in sizes if c <= n)


def sets_of(part: pa.RecordBatch, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    return B.shingle_sets(B.words(part.column(text), fold=True), width)


def weighted_sets(part: pa.RecordBatch, text: str, width: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`sets_of` with the weight of each shingle: the sum over its words; 0 for a text that is one shingle."""
    found = B.words(part.column(text), fold=True)
    flat, bounds = B.shingle_sets(found, width)
    own = weights[(found.hashes % np.uint64(ORDER_BUCKETS)).astype(np.int64)]
    sums = np.zeros(len(own), np.float32)
    for i in range(width):
        sums[: len(own) - i] += own[i:]
    windows = B.windows_of(found, width)
    out = np.zeros(len(flat), np.float32)
    for i, (a, b) in enumerate(zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist())):
        if b - a >= width:
            at = np.searchsorted(flat[bounds[i] : bounds[i + 1]], windows[a : b - width + 1])
            out[bounds[i] + at] = sums[a : b - width + 1]
    return flat, bounds, out


def bucket_counts(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and words of all documents by hash bucket; a task hands on one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * ORDER_BUCKETS, np.int64)
        for batch in batches:
            for part in B.slices(batch, text):
                found = B.words(part.column(text), fold=True)
                for hashes, first in ((B.shingle_sets(found, width)[0], 0), (found.hashes, ORDER_BUCKETS)):
                    bucket = (hashes % np.uint64(ORDER_BUCKETS)).astype(np.int64) + first
                    counts += np.bincount(bucket, minlength=2 * ORDER_BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["bucket", "n"])

    summed = docs.select(text).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(2 * ORDER_BUCKETS, np.int64)
    got = summed.toArrow()  # at most 2 ORDER_BUCKETS rows
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out[:ORDER_BUCKETS], out[ORDER_BUCKETS:]


@dataclass(frozen=True)
class Order:
    """The order of shingles: (crowded buckets packed to bits, weights of words by bucket)."""

    parts: Broadcast

    @classmethod
    def of(cls, docs: DataFrame, text: str, width: int) -> Order:
        counts, words = bucket_counts(docs, text, width)
        crowded = counts > max(np.quantile(counts, CROWDED), 1)
        weights = np.log1p(words).astype(np.float32)
        return cls(docs.sparkSession.sparkContext.broadcast((np.packbits(crowded), weights)))

    def sets(self, part: pa.RecordBatch, text: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingles, bounds, order): `order` sorts the shingles of every text in their global order."""
        bits, weights = self.parts.value
        flat, bounds, weight = weighted_sets(part, text, width, weights)
        late = np.unpackbits(bits)[(flat % np.uint64(ORDER_BUCKETS)).astype(np.int64)]
        text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        return flat, bounds, np.lexsort((flat, weight, late, text_of))


def fingerprints(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for empty ones."""
    n = np.diff(bounds)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat, dtype=np.uint64)])
    twice = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mix(flat ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)])
    one = B.mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64))
    two = B.mix(twice[bounds[1:]] - twice[bounds[:-1]] + n.astype(np.uint64))
    return np.where(n > 0, B.mix(one + two * np.uint64(3)), 0).view(np.int64), two.view(np.int64)


def set_rows(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(doc_id, n, f, f2): size and hashes of each document's set; f names its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, text):
                flat, bounds = sets_of(part, text, width)
                f, f2 = fingerprints(flat, bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(f), pa.array(f2)], ["doc_id", "n", "f", "f2"]
                )

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id bigint, n bigint, f bigint, f2 bigint")


def prefix_length(n: int, percent: int) -> int:
    """Shingles of which any linked set holds one: n - least intersection + 1."""
    return n - least_partner(n, percent) + 1


def prefix_bits(tokens: np.ndarray) -> np.ndarray:
    """BIT_WORDS numbers in which every token sets one bit."""
    out = np.zeros(BIT_WORDS * 64, bool)
    out[(tokens % np.uint64(BIT_WORDS * 64)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.int64)


def postings(
    docs: DataFrame,
    text: str,
    width: int,
    percent: int,
    order: Order,
    boundary: int,
    only_small: bool = False,
    field: Broadcast | None = None,
) -> DataFrame:
    """(token, f, n, pos, bits): the keys of each class.  pos is the place in the order for shingles,
    -1 for subsets; `bits` are those of the class's prefix.  A task lists a class once; with a
    `field`, only keys that are in it.

    `only_small` lists the shingles of sets that could be light, whatever the boundary."""
    reach = least_partner(boundary + 1, percent)

    def keys_of(own: np.ndarray, ordered: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        n = len(own)
        tokens, places = [], []
        if n >= reach or only_small:
            take = prefix_length(n, percent)
            tokens.append(ordered[:take])
            places.append(np.arange(take))
        if n <= boundary and not only_small:
            for c in subset_sizes(n, percent, boundary):
                pick = own[np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)]
                tokens.append(B.mix(B.mix(pick ^ np.uint64(c * 7919)).sum(axis=1, dtype=np.uint64)))
                places.append(np.full(len(pick), -1))
        return tokens, places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for part in B.slices(batch, text):
                flat, bounds, ranks = order.sets(part, text, width)
                f, _ = fingerprints(flat, bounds)
                ordered = flat[ranks]
                tokens, places, sizes, names, marks = [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    name = int(f[i])
                    if a == b or name in known or (only_small and b - a > boundary):
                        continue
                    known.add(name)
                    t, p = keys_of(flat[a:b], ordered[a:b])
                    tokens += t
                    places += p
                    count = sum(map(len, t))
                    sizes.append(np.full(count, b - a))
                    names.append(np.full(count, name))
                    marks.append(np.broadcast_to(prefix_bits(ordered[a : a + prefix_length(b - a, percent)]), (count, BIT_WORDS)))
                if len(known) > 1_000_000:
                    known.clear()
                if tokens:
                    token = np.concatenate(tokens)
                    some = slice(None) if field is None else member(field.value, token)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(token.view(np.int64)[some]),
                            pa.array(np.concatenate(names)[some], pa.int64()),
                            pa.array(np.concatenate(sizes)[some], pa.int32()),
                            pa.array(np.concatenate(places)[some], pa.int32()),
                            *(pa.array(x) for x in np.ascontiguousarray(np.concatenate(marks)[some].T)),
                        ],
                        ["token", "f", "n", "pos", *BITS],
                    )

    return docs.select(text).mapInArrow(run, "token bigint, f bigint, n int, pos int, " + ", ".join(f"{c} bigint" for c in BITS))


def light_boundary(docs: DataFrame, rows: DataFrame, key: str, text: str, width: int, percent: int, order: Order) -> int:
    """Largest set size up to which subsets cost no more than scanning inverted lists.

    A set of size n costs as many keys as it has subsets, against its prefix shingles and the
    members of their lists.  The lists counted are those of all sets small enough to be light."""
    top = 1
    while sum(math.comb(top + 1, c) for c in subset_sizes(top + 1, percent, top + 1)) <= MOST_SUBSETS:
        top += 1
    # texts of larger sets are left out before they are taken apart, if the ids of the others may travel
    ids = rows.where(F.col("n").between(1, top)).select(F.col("doc_id").alias("_small")).distinct()
    if fits_broadcast(ids, None, 64):
        docs = docs.select(F.col(key).cast("bigint").alias("_key"), text)
        docs = docs.join(F.broadcast(ids), F.col("_key").eqNullSafe(F.col("_small")), "left_semi")
    small = postings(docs, text, width, percent, order, top, only_small=True)
    lists = small.groupBy("token").agg(F.count("*").alias("k"), F.sum("n").alias("ns"))
    # by the mean size of a list's members: lists, entries, and entries met when scanning
    by_size = lists.groupBy(F.round(F.col("ns") / F.col("k")).cast("int").alias("n")).agg(
        F.sum("k").alias("entries"), F.sum(F.col("k") * F.col("k")).alias("met")
    )
    met = {r["n"]: r["met"] / r["entries"] for r in by_size.collect()}  # at most `top` rows
    boundary = 0
    for n in range(1, top + 1):
        subsets = sum(math.comb(n, c) for c in subset_sizes(n, percent, n))
        if subsets <= prefix_length(n, percent) * (1 + met.get(n, 1.0)):
            boundary = n
    return boundary


def possible(percent: int, boundary: int) -> Column:
    """Filter on (n, pos, x.., m, qos, y..): may sets of these sizes link, if the common key at these
    places is the first that they share?  Nothing before it is common then.  Sets that link have such
    a key among their lists, so a pair needs no other.

    A bit that only one of two prefixes sets is a shingle of that prefix alone; what is left of
    the shorter count and what follows the prefixes must do.  That holds for sets with prefixes."""
    n, m, pos, qos = F.col("n"), F.col("m"), F.col("pos"), F.col("qos")
    sizes = (100 * F.least(n, m) >= percent * F.greatest(n, m))
    most = F.least(n - pos, m - qos)
    placed = (pos < 0) | (qos < 0) | ((100 + percent) * most >= percent * (n + m))

    def partner(n: Column) -> Column:
        return F.ceil(F.lit(percent) * n / 100)

    def alone(own: list[str], other: list[str]) -> Column:
        return sum((F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b)))) for a, b in zip(own, other)), F.lit(0))

    common = F.least(n - partner(n) + 1 - alone(BITS, OTHER_BITS), m - partner(m) + 1 - alone(OTHER_BITS, BITS))
    enough = (100 + percent) * (common + F.greatest(partner(n), partner(m)) - 1) >= percent * (n + m)
    return sizes & placed & ((F.least(n, m) <= boundary) | enough)


def likely(pairs: DataFrame, prefixes: DataFrame, percent: int, boundary: int) -> DataFrame:
    """The pairs (a, b, n, m) that may link by their common prefix shingles, as (a, b).

    All common shingles up to the earlier end of two prefixes lie in both, so the intersection is
    at most their number and what follows the prefix of that set.  Pairs with a light set stay:
    they may have met in a subset."""

    def behind(n: str) -> Column:
        return F.ceil(F.lit(percent) * F.col(n) / 100) - 1

    one = prefixes.select(F.col("f").alias("a"), F.col("tokens").alias("x"))
    two = prefixes.select(F.col("f").alias("b"), F.col("tokens").alias("y"))
    heavy = pairs.where(F.least("n", "m") > boundary).join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("x", "y"))
    most = common + F.greatest(behind("n"), behind("m"))
    enough = heavy.where((100 + percent) * most >= percent * (F.col("n") + F.col("m"))).select("a", "b")
    return enough.unionByName(pairs.where(F.least("n", "m") <= boundary).select("a", "b"))


def verified(pairs: DataFrame, texts: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """The links (a, b) among the pairs (a, b), by exact counts; texts: (f, text)."""
    one = texts.select(F.col("f").alias("a"), F.col(text).alias("text_a"))
    two = texts.select(F.col("f").alias("b"), F.col(text).alias("text_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def load(names: list[int], part: pa.RecordBatch, column: str) -> list[np.ndarray]:
            missing = [i for i, x in enumerate(names) if x not in recent]
            if missing:
                flat, bounds = sets_of(part.take(pa.array(missing)), column, width)
                for j, i in enumerate(missing):
                    recent[names[i]] = flat[bounds[j] : bounds[j + 1]]
            return [recent[x] for x in names]

        for batch in batches:
            for part in B.slices(batch, "text_a", 1 << 20):
                for start in range(0, part.num_rows, 256):
                    rows = part.slice(start, 256)
                    a, b = rows.column("a").to_pylist(), rows.column("b").to_pylist()
                    left, right = load(a, rows, "text_a"), load(b, rows, "text_b")
                    good = []
                    for x, y in zip(left, right):
                        short, long = (x, y) if len(x) <= len(y) else (y, x)
                        at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                        common = int((long[at] == short).sum())
                        good.append(100 * common >= percent * (len(x) + len(y) - common))
                    yield rows.select(["a", "b"]).filter(pa.array(good))
                    while len(recent) > 512:
                        recent.popitem(last=False)

    return both.mapInArrow(run, "a bigint, b bigint")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, links): `rows` of (doc_id, n, f) per document, f its class, 0 the empty set;
    `links` (a, b) between classes: they connect all classes that links connect, without all
    pairs of a component."""
    rows = written(set_rows(docs, key, text, width))
    order = Order.of(docs, text, width)
    boundary = light_boundary(docs, rows, key, text, width, percent, order)
    listed = postings(docs, text, width, percent, order, boundary).select("token", "f")
    # only lists of two classes or more matter; hot lists are minima per task, then one row
    hubs = listed.groupBy("token").agg(F.min("f").alias("hub"), F.max("f").alias("top"), (F.count("*") > 2).alias("many"))
    hubs = written(hubs.where("hub < top").drop("top"))
    field = docs.sparkSession.sparkContext.broadcast(bit_field(hubs, "token", field_bits(hubs.count())))
    again = postings(docs, text, width, percent, order, boundary, field=field)
    shared = written(again.hint("merge").join(hubs, "token").dropDuplicates(["token", "f"]))
    forget(hubs)
    prefixes = written(shared.where("pos >= 0").groupBy("f").agg(F.collect_list("token").alias("tokens")))
    heads = shared.where("f = hub").groupBy("token").agg(
        F.first("n").alias("m"), F.first("pos").alias("qos"), *[F.first(x).alias(y) for x, y in zip(BITS, OTHER_BITS)]
    )
    near = shared.where("f <> hub").hint("merge").join(heads, "token").where(possible(percent, boundary))
    first = written(near.select(F.col("f").alias("a"), F.col("hub").alias("b"), "n", "m").dropDuplicates(["a", "b"]))
    sources = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text))
    classes = rows.where("f <> 0").groupBy("f").agg(F.min("doc_id").alias("doc_id"))

    def texts_of(pairs: DataFrame) -> DataFrame:
        """(f, text) of the classes in `pairs`: the text of one document each."""
        named = pairs.select(F.col("a").alias("f")).union(pairs.select(F.col("b").alias("f"))).distinct()
        wanted = written(classes.join(named, "f").select("doc_id", F.col("f").alias("_f")))
        found = bounded_join(sources, wanted, "doc_id", wanted.count(), 64, how="inner").select("_f", text)
        return written(_of_class(found, text, width))

    close = written(likely(first, prefixes, percent, boundary))
    texts = texts_of(close)
    links = written(verified(close, texts, text, width, percent))
    forget(texts, close)
    roots = written(components(links))
    # what is left: pairs of a list between components; a list of two has no other pair
    of = rooted(shared.where("many"), roots, "f", "root")
    mixed = of.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    # a list meets itself by classes of sizes: sets that link lie in the same one or in neighbours
    size_class = F.floor(F.log(F.col("n")) / -math.log(percent / 100) + 1e-9).cast("int")
    members = written(of.join(mixed, "token", "left_semi").select("token", "f", "n", "pos", *BITS, "root", size_class.alias("size_class")))
    others = members.select("token", F.col("f").alias("g"), F.col("n").alias("m"), F.col("pos").alias("qos"), *[F.col(x).alias(y) for x, y in zip(BITS, OTHER_BITS)], F.col("root").alias("other"), "size_class")
    others = others.withColumn("size_class", F.explode(F.array(*[F.col("size_class") + i for i in (-1, 0, 1)])))
    apart = (F.col("f") < F.col("g")) & (F.col("root") != F.col("other")) & possible(percent, boundary)
    left, right = members.hint("merge").alias("l"), others.alias("r")
    same = (F.col("l.token") == F.col("r.token")) & (F.col("l.size_class") == F.col("r.size_class"))
    cross = left.join(right, same & apart)
    rest = cross.select(F.col("f").alias("a"), F.col("g").alias("b"), "n", "m").dropDuplicates(["a", "b"])
    rest = rest.join(first.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")), ["a", "b"], "left_anti")
    rest = written(likely(written(rest), prefixes, percent, boundary))
    more = written(verified(rest, texts_of(rest), text, width, percent)) if rest.head(1) else links.limit(0)
    return rows, links.unionByName(more)


def _of_class(found: DataFrame, text: str, width: int) -> DataFrame:
    """Rows (_f, text) whose text has the class _f: a doc_id may have rows of other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, text):
                f, _ = fingerprints(*sets_of(part, text, width))
                same = f == part.column("_f").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column("_f"), part.column(text)], ["f", text]).filter(pa.array(same))

    return found.select("_f", text).mapInArrow(run, f"f bigint, `{text}` string").dropDuplicates(["f"])


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of `docs`."""
    rows, links = link(docs, key, text, width, percent)
    classes = rows.where("f <> 0").groupBy("f").agg(F.min("doc_id").alias("least"))
    # rows of one doc_id are one node: their classes are linked
    twice = rows.where("f <> 0").groupBy("doc_id").agg(F.min("f").alias("a"), F.max("f").alias("b")).where("a < b")
    same = rows.where("f <> 0").join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("f").alias("b"))
    roots = components(links.unionByName(same)).select(F.col("node").alias("f"), "root")
    named = classes.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = written(named.join(least, "root").select("f", "component_id"))
    out = rows.join(of_class, "f", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """`docs` without the members of a component other than its smallest doc_id; of equal
    doc_ids all rows stay."""
    groups = joined(docs.select(key, text), key, text, width, percent)
    name = fresh(docs, "_gone")
    gone = written(groups.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, F.col(key) == F.col(name), "left_anti")
