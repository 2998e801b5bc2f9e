"""Context-tree weighting over bytes: how many bits a trained model needs for a text.

Method: a text is its words, each with a space behind it, and one end byte.  Every byte is eight
binary decisions; a decision sees the bytes before it as contexts of 0 to `DEPTH` bytes.  Each
(context, decision) is a node with Krichevsky-Trofimov estimates from its counts of zeros and
ones; the block probability of a node mixes its own estimate and the product over its longer
contexts half and half, and the weights that follow mix the estimates of all depths of a path.

A gram is a byte with its `DEPTH` bytes before, one integer, the nearest byte first.  The model is
a function of the grams, so no text is needed to build it:
1. tasks add up the grams of all texts (with the occurrences in training texts) and the words of
   the training texts; a shuffle sums them;
2. grams are dealt by their two nearest bytes and streamed in order.  A task holds the grams of one
   three-byte context at a time, climbs its tree, and hands on sums for the two-byte contexts;
   the shallow levels are plain aggregates;
3. a second stream takes the mixture of the shallow levels down to every gram: its log probability;
4. texts are dealt into blocks by a hash of the row; a block asks for its distinct grams and words,
   the answers come by a join, and a text's score is the sum over its bytes.
Everything grows with the distinct grams and words, nothing is broadcast, and no value depends on
how the rows were dealt (but for the last digits of sums).

Training rows: those whose crc32 of the id as text, mod 7, is not 2; a row without id trains.  Null
text: empty, so one end token.  Rows that are repeated train and are scored one by one.  An empty
table gives no rows; without training rows every decision is even.  Other columns are left aside.
Words are told apart by 63-bit hashes in the base score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import batches as B
from wordloom.llm.fields import Tally
from wordloom.session import bounded_join, written

DEPTH = 5  # bytes of context
SHALLOW = 2  # levels up to this one are Spark aggregates
FOLDS, HELD_OUT = 7, 2
END = 10  # the byte that ends a text; no word holds it
BLOCK_BYTES = 48 << 20
STREAM_ROWS = 1 << 17  # grams that a task climbs at once, and the rest of one three-byte context

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_BIT = np.uint64(1 << 63)  # keys of words are negative, grams are not
END_KEY = np.int64(-1)  # the end token among the words


# --- texts -> keys


class Coded:
    """The normalised bytes of a slice of texts, their grams, and their words."""

    def __init__(self, column: pa.Array, depth: int):
        data, offsets = B.text_bytes(column)
        first, last, bounds = B.word_spans(data, offsets)
        sizes = last - first
        texts = len(offsets) - 1
        text = np.repeat(np.arange(texts), np.diff(bounds))
        self.words = np.diff(bounds)
        # every text ends with one byte, after the spaces of its words
        ends = np.cumsum(sizes + 1)
        word_start = ends - sizes - 1 + text
        self.sizes = np.bincount(text, sizes + 1, texts).astype(np.int64) + 1
        self.stops = np.cumsum(self.sizes)
        coded = np.full(int(self.stops[-1]) if texts else 0, 32, np.uint8)
        place = np.arange(int(sizes.sum())) + np.repeat(word_start - (np.cumsum(sizes) - sizes), sizes)
        coded[place] = _LOWER[data[~B._SEPARATOR[data]]]
        coded[self.stops - 1] = END
        self.data, self.depth = coded, depth
        sums, down = B.prefix_hashes(coded), B.powers(len(coded) + 1)[1]
        stop = word_start + sizes
        hashes = B.mix((sums[stop] - sums[word_start]) * down[word_start] + sizes.astype(np.uint64))
        self.word_keys = (hashes | _WORD_BIT).view(np.int64)
        self.word_text = text

    def grams(self) -> np.ndarray:
        """One per byte; before a text there are spaces."""
        n, depth = len(self.data), self.depth
        out = self.data.astype(np.int64)
        start = np.repeat(self.stops - self.sizes, self.sizes)
        place = np.arange(n) - start
        for k in range(1, depth + 1):
            before = np.full(n, 32, np.int64)
            before[k:] = self.data[: max(0, n - k)]
            before[place < k] = 32
            out |= before << (8 * (depth + 1 - k))
        return out


def training(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) != HELD_OUT, F.lit(True))


def gathered(docs: DataFrame, depth: int) -> DataFrame:
    """(key, n): grams of all texts with their occurrences in training texts (0 or more), words and
    the end token of training texts with theirs.  `docs`: (train, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in B.slices(batch, "text"):
                train = part.column("train").to_numpy(zero_copy_only=False)
                for learn in (True, False):
                    own = part.filter(pa.array(train == learn))
                    if not own.num_rows:
                        continue
                    found = Coded(own.column("text"), depth)
                    keys, n = np.unique(found.grams(), return_counts=True)
                    yield from tally.add(keys, n if learn else np.zeros(len(n), np.int64))
                    if learn:
                        keys, n = np.unique(found.word_keys, return_counts=True)
                        yield from tally.add(np.append(keys, END_KEY), np.append(n, own.num_rows))
        yield from tally.rows()

    return docs.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


# --- the tree


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series, eight steps up."""
    shift = np.zeros(len(x))
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def estimates(zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log block probability, weight of the own estimate, estimate that the next bit is one) of
    nodes with these counts; `longer`: summed log block probabilities of their longer contexts."""
    zeros, ones = zeros.astype(float), ones.astype(float)
    own = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)
    chance = (ones + 0.5) / (zeros + ones + 1)
    if longer is None:
        return own, np.ones(len(own)), chance
    block = np.logaddexp(own, longer) - math.log(2)
    return block, np.exp(own - math.log(2) - block), chance


def decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(decision, bit), each eight rows of len(byte): the bits of a byte from the highest down.  A
    decision is named by the bits before it, behind a one."""
    bits = np.stack([byte >> (7 - j) & 1 for j in range(8)])
    return np.stack([(1 << j) | (byte >> (8 - j)) for j in range(8)]), bits


class Tree:
    """Nodes of complete contexts of `top` bytes, from their grams in order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, top: int):
        decision, bit = decisions(grams & 0xFF)
        keys, self.bit = ((grams >> 8 << 8) | decision).ravel(), bit.ravel()
        n = np.tile(counts, 8)
        zeros, ones, longer = np.where(self.bit == 0, n, 0), np.where(self.bit == 1, n, 0), None
        self.levels = []
        for level in range(depth, top - 1, -1):
            own, place = np.unique(keys, return_inverse=True)
            order = np.argsort(place, kind="stable")
            first = np.flatnonzero(np.diff(place[order], prepend=-1))
            zeros, ones = np.add.reduceat(zeros[order], first), np.add.reduceat(ones[order], first)
            longer = None if longer is None else np.add.reduceat(longer[order], first)
            block, weight, chance = estimates(zeros, ones, longer)
            self.levels.append((own, place, weight, chance))
            self.top = (own, zeros, ones, block)
            keys, longer = (own >> 16 << 8) | (own & 0xFF), block  # without the farthest byte

    def log_chances(self, mixed: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte, given the mixture so far and the weight still open at
        the parents of the top nodes."""
        place = None
        for own, inverse, weight, chance in reversed(self.levels):
            if place is not None:
                mixed, rest = mixed[place], rest[place]
            mixed, rest = mixed + rest * weight * chance, rest * (1 - weight)
            place = inverse
        one = mixed[place]
        return np.log10(np.where(self.bit == 1, one, 1 - one)).reshape(8, -1).sum(axis=0)


def parts_of(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by `key` in parts of about STREAM_ROWS that never divide a value of key >> shift."""
    held: list[dict[str, np.ndarray]] = []
    size = 0

    def joined() -> dict[str, np.ndarray]:
        return {k: np.concatenate([h[k] for h in held]) for k in held[0]}

    for batch in batches:
        held.append({name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names})
        size += batch.num_rows
        if size >= STREAM_ROWS:
            rows = joined()
            cut = int(np.searchsorted(rows["key"] >> shift, rows["key"][-1] >> shift))
            if cut:
                yield {k: v[:cut] for k, v in rows.items()}
            held = [{k: v[cut:] for k, v in rows.items()}]
            size -= cut
    if size:
        yield joined()


def shallow_nodes(grams: DataFrame, depth: int) -> DataFrame:
    """(context, decision, mixed, rest) of the nodes at level SHALLOW: the mixture of the levels up to
    there, and the weight that is left for the longer contexts.  `grams`: (near, key, n), sorted by key within
    partitions that hold whole values of near."""
    shift = 8 * (depth - SHALLOW)  # of a gram: down to the context of SHALLOW + 1 bytes

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts_of(batches, shift):
            tree = Tree(rows["key"], rows["n"], depth, SHALLOW + 1)
            own, zeros, ones, block = tree.top
            yield pa.RecordBatch.from_arrays(
                [pa.array(own >> 16), pa.array((own & 0xFF).astype(np.int32)), pa.array(zeros), pa.array(ones), pa.array(block)],
                ["context", "decision", "zeros", "ones", "longer"],
            )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("zeros", "ones", "longer")]
            added = [pa.array(x) for x in estimates(*columns)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("context", "decision", "zeros", "ones")), *added],
                ["context", "decision", "zeros", "ones", "block", "weight", "chance"],
            )

    shape = "context bigint, decision int, zeros bigint, ones bigint"
    rows = grams.select("key", "n").mapInArrow(climb, f"{shape}, longer double")
    levels = []
    for _ in range(SHALLOW + 1):
        sums = rows.groupBy("context", "decision").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "longer")])
        nodes = written(sums.mapInArrow(weigh, f"{shape}, block double, weight double, chance double"))
        levels.append(nodes.select("context", "decision", "weight", "chance"))
        rows = nodes.select(F.shiftright("context", 8).alias("context"), "decision", "zeros", "ones", F.col("block").alias("longer"))
    down = levels.pop().select("context", "decision", (F.col("weight") * F.col("chance")).alias("mixed"), (1 - F.col("weight")).alias("rest"))
    while levels:
        nodes = levels.pop().withColumn("shorter", F.shiftright("context", 8))
        down = nodes.join(down.withColumnRenamed("context", "shorter"), ["shorter", "decision"])
        down = down.select(
            "context",
            "decision",
            (F.col("mixed") + F.col("rest") * F.col("weight") * F.col("chance")).alias("mixed"),
            (F.col("rest") * (1 - F.col("weight"))).alias("rest"),
        )
    return down


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("near").sortWithinPartitions("near", "kind", "key")


def gram_values(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, value): log10 of the probability of each gram's last byte after its context."""
    shift = 8 * (depth - SHALLOW)
    near = F.shiftright("key", 8 * (depth + 1 - SHALLOW))
    grams = counts.where("key >= 0").select(near.alias("near"), F.lit(1).alias("kind"), "key", "n")
    down = shallow_nodes(dealt(grams), depth)
    nodes = down.select(
        F.col("context").alias("near"), F.lit(0).alias("kind"), F.col("decision").cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("n"), "mixed", "rest"
    )
    both = dealt(grams.withColumns({"mixed": F.lit(0.0), "rest": F.lit(0.0)}).unionByName(nodes))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column("near").to_numpy() * 2 + batch.column("kind").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        yield batch.slice(a, b - a)

        mixed, rest = np.zeros(256), np.zeros(256)
        rows = groups()
        head = next(rows, None)

        def own_grams(near: int) -> Iterator[pa.RecordBatch]:
            """The grams of one value of near; its nodes come before them."""
            nonlocal head
            while head is not None and head.column("near")[0].as_py() == near:
                if head.column("kind")[0].as_py() == 0:
                    place = head.column("key").to_numpy()
                    mixed[place] = head.column("mixed").to_numpy()
                    rest[place] = head.column("rest").to_numpy()
                else:
                    yield head.select(["key", "n"])
                head = next(rows, None)

        while head is not None:
            for part in parts_of(own_grams(head.column("near")[0].as_py()), shift):
                tree = Tree(part["key"], part["n"], depth, SHALLOW + 1)
                decision = tree.top[0] & 0xFF
                chance = tree.log_chances(mixed[decision], rest[decision])
                yield pa.RecordBatch.from_arrays([pa.array(part["key"]), pa.array(chance)], ["key", "value"])

    return both.mapInArrow(descend, "key bigint, value double")


# --- texts against the model


class Keys:
    """The distinct keys of a block; a block's text bounds them."""

    MERGE = 2 << 20  # keys that wait to be merged

    def __init__(self):
        self.known, self.more, self.waiting = np.zeros(0, np.int64), [], 0

    def add(self, *keys: np.ndarray) -> None:
        self.more += keys
        self.waiting += sum(map(len, keys))
        if self.waiting > self.MERGE:
            self.all()

    def all(self) -> np.ndarray:
        if self.more:
            self.known = np.unique(np.concatenate([self.known, *self.more]))
            self.more, self.waiting = [], 0
        return self.known


def even_names(spark: SparkSession, n: int) -> DataFrame:
    """(slot, block): for each of n partitions a number that Spark's hash puts there, so that blocks
    of that name come one to a partition."""
    names = spark.range(0, 16 * n + 64, 1, 1).select(F.col("id").cast("int").alias("block"))
    return names.groupBy(F.pmod(F.hash("block"), F.lit(n)).alias("slot")).agg(F.min("block").alias("block"))


def scored(docs: DataFrame, values: DataFrame, tokens: int, distinct: int, texts: int, depth: int) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, base_score, score, n_bytes) of `docs` (doc_id, train, like, text).

    `values`: (key, value), log10 chances of grams and counts of words; `tokens`: training tokens,
    `distinct`: how many differ, `texts`: how many are end tokens."""
    sizes = docs.groupBy("like").agg(F.sum(F.octet_length("text")).alias("size"))
    own = F.ceil(F.greatest("size", F.lit(1)) / F.lit(BLOCK_BYTES)).cast("int").alias("blocks")
    spans = written(sizes.select("like", own))
    total = spans.agg(F.sum("blocks")).first()[0] or 1
    # the blocks of a group follow a hash of its name; groups may share blocks
    first, turn = F.xxhash64("like"), F.pmod(F.xxhash64("doc_id", "text"), F.col("blocks"))
    slot = F.pmod(F.pmod(first, F.lit(total)) + turn, F.lit(total)).cast("int")
    rows = bounded_join(docs, spans, "like", spans.count(), 64, "inner")
    rows = rows.select("doc_id", "train", "text", slot.alias("slot"))
    rows = bounded_join(rows, even_names(docs.sparkSession, total), "slot", total, 64)
    rows = rows.select("doc_id", "train", "text", F.coalesce("block", "slot").alias("block")).repartition(total, "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[int, Keys] = {}
        for batch in batches:
            for part in B.slices(batch, "text"):
                of = part.column("block").to_numpy()
                for b in np.unique(of).tolist():
                    found = Coded(part.filter(pa.array(of == b)).column("text"), depth)
                    wanted.setdefault(b, Keys()).add(np.unique(found.grams()), np.unique(found.word_keys))
        for b in list(wanted):
            keys = wanted.pop(b).all()
            for i in range(0, len(keys), 1 << 16):
                own = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b, np.int32)), pa.array(own)], ["block", "key"])

    even = math.log10(tokens + distinct + 1)
    wanted = rows.mapInArrow(ask, "block int, key bigint")
    answers = wanted.join(values, "key", "left").select("block", "key", F.coalesce("value", F.lit(0.0)).alias("value"))

    def answer(table: pa.Table, known: pa.Table) -> pa.Table:
        keys = known.column("key").to_numpy()
        order = np.argsort(keys)
        keys, value = keys[order], known.column("value").to_numpy()[order]

        def lookup(wanted: np.ndarray) -> np.ndarray:
            own, place = np.unique(wanted, return_inverse=True)
            return value[np.searchsorted(keys, own)][place]

        out = []
        for batch in table.combine_chunks().to_batches():
            for part in B.slices(batch, "text"):
                found = Coded(part.column("text"), depth)
                bits = np.add.reduceat(lookup(found.grams()), found.stops - found.sizes)
                count = lookup(found.word_keys) if len(found.word_keys) else np.zeros(0)
                n = len(found.words)
                known_words = np.bincount(found.word_text, count > 0, n).astype(np.int64) + (texts > 0)
                base = np.bincount(found.word_text, np.log10(count + 1), n) + math.log10(texts + 1) - even * (found.words + 1)
                out.append(
                    pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"),
                            part.column("train"),
                            pa.array(found.words + 1),
                            pa.array(known_words),
                            pa.array(base),
                            pa.array(bits),
                            pa.array(found.sizes),
                        ],
                        schema=schema,
                    )
                )
        return pa.Table.from_batches(out, schema) if out else schema.empty_table()

    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("train", pa.bool_()),
            ("n_tokens", pa.int64()),
            ("n_known", pa.int64()),
            ("base_score", pa.float64()),
            ("score", pa.float64()),
            ("n_bytes", pa.int64()),
        ]
    )
    shape = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double, n_bytes bigint"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, shape)


def score(docs: DataFrame, text: str = "text", like: str | None = "lang", depth: int = DEPTH) -> DataFrame:
    """`like` names a column whose values share words: rows with one value meet in the same blocks, which
    then ask for less.  It changes no result.

    Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10 of a smoothed
    word model), score (log10 of this model), bits_per_byte (code length over the normalised bytes)."""
    group = F.coalesce(F.col(like).cast("string"), F.lit("")) if like in docs.columns else F.lit("")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), training(F.col("doc_id")).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"), group.alias("like"))
    counts = written(gathered(docs.select("train", "text"), depth))
    words = counts.where("key < 0")
    ends = F.sum(F.when(F.col("key") == int(END_KEY), F.col("n")))
    tokens, distinct, texts = words.agg(*[F.coalesce(c, F.lit(0)) for c in (F.sum("n"), F.count("*"), ends)]).first()
    values = written(gram_values(counts, depth).unionByName(words.select("key", F.col("n").cast("double").alias("value"))))
    rows = scored(docs, values, tokens, distinct, texts, depth)
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return rows.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
        bits.alias("bits_per_byte"),
    )
