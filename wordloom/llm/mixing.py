"""Mixing sources to target weights.

Method: the words of a source, in a fixed order of its documents, are packed into blocks of
fixed length.  The output has shards of a fixed number of slots.  Every shard draws how many
of its slots each source gets: a multinomial draw, conditioned on the totals that the targets
ask for, so that the whole mix meets them.  The slots of a source are numbered through; slot
j takes block p(j mod N) of its N blocks, p a pseudorandom permutation of its own for every
pass over the source.  Slots and blocks meet in a join on (source, block).

Every draw is a function of the seed and the place it stands for, so a lost task that is run
again draws the same.  Null or empty texts have size 0 and are never taken.  A null source is
a source of its own, the last one.  Equal rows are separate rows.  No task holds a source: a
source is dealt over `BUCKETS` groups, whose sums give each group its place in the stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import written

WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_SPACE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3  # no source is taken more often
BLOCK_WORDS = 32
SHARD_SLOTS = 8_192
GROUP_SHARDS = 1_024
BUCKETS = 4_096
SEED = 17


def sized(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, text_hash), written once."""
    return written(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64(F.col(text)).alias("text_hash"),
        )
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_no, source_size, target): one row per source.

    Sources in code point order, null last, get the weights in turn.  A target stops at `most`
    times the source's size; the excess goes to the others by weight.  That ends at
    min(most * size, level * weight): in order of size / weight, the sources before the first
    one that stays below its bound are at theirs."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = per_source.withColumn("source_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    bound = (most * F.col("source_size")).cast("double")
    rows = numbered.withColumn("weight", weight).withColumn("bound", bound)
    by_ratio = Window.orderBy(F.col("bound") / F.col("weight"), "source_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(onward)
    rows = rows.withColumn("level", level)
    # the first source whose own level keeps it within its bound sets the level of the rest
    fits = F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.col("level"))
    final = F.first(fits, ignorenulls=True).over(everything.orderBy(F.col("bound") / F.col("weight"), "source_no"))
    target = F.least(F.col("bound"), F.coalesce("final", F.lit(0.0)) * F.col("weight"))
    return rows.withColumn("final", final).select(
        "source", F.col("source_no").cast("int").alias("source_no"), "source_size", target.alias("target")
    )


def streams(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """`sizes` with source_no, source_size, target and `start`, the number of words of its
    source before the row (null for size 0)."""
    rows = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
    group = Window.partitionBy("source_no", "_bucket").orderBy("doc_id", "text_hash", "size")
    rows = rows.withColumn("_before", F.sum("size").over(group.rowsBetween(Window.unboundedPreceding, -1)))
    sums = rows.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    out = rows.join(sums, ["source_no", "_bucket"])
    start = F.when(F.col("size") > 0, F.col("_offset") + F.coalesce("_before", F.lit(0)))
    return out.withColumn("start", start).drop("_bucket", "_before", "_offset")


def block_pieces(rows: DataFrame, length: int = BLOCK_WORDS) -> DataFrame:
    """(source_no, block, doc_id, text_hash, start, first, last): words first..last-1 of a
    document that lie in a block of its source."""
    rows = rows.where("size > 0").select("source_no", "doc_id", "text_hash", "start", "size")
    last_block = F.floor((F.col("start") + F.col("size") - 1) / length)
    out = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / length), last_block)))
    first = F.greatest(F.col("block") * length - F.col("start"), F.lit(0))
    last = F.least((F.col("block") + 1) * length - F.col("start"), F.col("size"))
    return out.select("source_no", "block", "doc_id", "text_hash", "start", first.alias("first"), last.alias("last"))


def permuted(index: np.ndarray, n: int, seed: tuple[int, ...]) -> np.ndarray:
    """Places of `index` under a pseudorandom permutation of 0..n-1: a Feistel network over the
    next even number of bits, walked until the place lies below n."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(1, 2**63, 6, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (away := out >= n).any():
        out[away] = once(out[away])
    return out.astype(np.int64)


def shard_counts(totals: np.ndarray, shard: int, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, slots of each source in it).

    The shards are halved again and again, down to fixed groups of GROUP_SHARDS and then to single
    ones.  Groups get their share of every source, exact up to rounding; inside a group each
    halving deals the slots by a draw without replacement that both halves can repeat."""
    here, before = totals.astype(np.int64), np.zeros(len(totals), np.int64)
    low, high = 0, -(-int(here.sum()) // slots)
    while high - low > 1:
        groups = -(-(high - low) // GROUP_SHARDS)
        middle = low + groups // 2 * GROUP_SHARDS if groups > 1 else (low + high) // 2
        n_left = min((middle - low) * slots, int(here.sum()))
        if groups > 1:
            share = n_left / int(here.sum())
            left = np.floor(here * share).astype(np.int64)
            left[np.argsort(left - here * share, kind="stable")[: n_left - int(left.sum())]] += 1
        else:
            left = np.random.default_rng((seed, low, high)).multivariate_hypergeometric(here, n_left, method="marginals")
        if shard < middle:
            here, high = left, middle
        else:
            before, here, low = before + left, here - left, middle
    return before, here


def slots(sources: DataFrame, length: int = BLOCK_WORDS, per_shard: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, slot, source_no, block, pass): which block each slot of the output takes.

    The plan (one row per source: its number of blocks and slots) goes to every task; it is
    as small as the list of sources, and is all that the driver sees."""
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / length)
    wanted = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0)
    plan = sources.select("source_no", blocks.alias("blocks"), wanted.cast("bigint").alias("slots")).orderBy("source_no")
    rows = plan.collect()
    n_blocks = np.array([r["blocks"] for r in rows], np.int64)
    totals = np.array([r["slots"] for r in rows], np.int64)
    numbers = np.array([r["source_no"] for r in rows], np.int64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                before, counts = shard_counts(totals, shard, per_shard, seed)
                parts = []
                for s in np.flatnonzero(counts):
                    j = np.arange(before[s], before[s] + counts[s])
                    turn = j // n_blocks[s]
                    block = np.empty(len(j), np.int64)
                    for t in np.unique(turn):
                        block[turn == t] = permuted(j[turn == t] % n_blocks[s], int(n_blocks[s]), (seed, int(numbers[s]), int(t)))
                    parts.append(pd.DataFrame({"source_no": numbers[s], "block": block, "turn": turn}))
                if parts:
                    out = pd.concat(parts, ignore_index=True)
                    out["shard"] = shard
                    out["slot"] = np.random.default_rng((seed, 1, shard)).permutation(len(out))
                    yield out[["shard", "slot", "source_no", "block", "turn"]]

    n_shards = -(-int(totals.sum()) // per_shard)
    ids = spark.range(0, n_shards, 1, max(1, min(n_shards, 4_096)))
    return ids.mapInPandas(deal, "shard bigint, slot bigint, source_no int, block bigint, turn bigint")


def mix(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): `rows` as `streams` gives them; `spans` the mix itself, (shard, slot,
    turn, source_no, block, doc_id, text_hash, start, first, last), in slots of about
    `BLOCK_WORDS` words."""
    sources = written(targets(sizes))
    rows = written(streams(sizes, sources))
    # both sides grow with the input and Spark can't know the size of the slots: no broadcast
    return rows, slots(sources).hint("merge").join(block_pieces(rows), ["source_no", "block"])


def taken(sizes: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): words the mix takes of each row."""
    rows, spans = mix(sizes)
    words = spans.groupBy("source_no", "start").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    return rows.join(words.hint("merge"), ["source_no", "start"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )


def cut_text(text: Column, spans: Column) -> Column:
    """The words of `spans` (sorted array of first, last) with the space that follows each."""
    words = F.regexp_extract_all(text, F.lit(WORD_AND_SPACE), F.lit(0))
    pieces = F.transform(
        spans, lambda s: F.array_join(F.slice(words, s["first"] + 1, s["last"] - s["first"]), "")
    )
    return F.array_join(pieces, "")


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mix as documents: for every turn over its source a document comes once more, with
    the words taken in that turn.  The columns of `docs`; equal rows (id, text and source) share
    one choice.  A null id is an id like any other."""
    rows, spans = mix(sized(docs, text, source, key))
    pieces = spans.groupBy("doc_id", "text_hash", "source_no", "start", "turn").agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")
    )
    one = Window.partitionBy("doc_id", "text_hash", "source_no", "turn").orderBy("start")
    pieces = pieces.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    pieces = pieces.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "source_no").agg(
        F.collect_list(F.struct("turn", "spans")).alias("_turns")
    )
    names = rows.select("source_no", F.col("source").alias("_source")).distinct()  # one row per source
    pieces = pieces.join(names, "source_no")
    # the columns of `docs` travel in a struct, so that none meets a name of these
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"),
        F.col(key).alias("_id"),
        F.col(text).alias("_text"),
        F.col(source).alias("_of"),
        F.xxhash64(F.col(text)).alias("_key"),
    )
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_hash")) & F.col("_of").eqNullSafe(F.col("_source"))
    turns = marked.join(pieces.hint("merge"), same).withColumn("_turn", F.explode("_turns"))
    # slices want whole words only once per row, so the cut is one expression over the array
    spans = F.transform("_turn.spans", lambda s: F.struct(s["first"].cast("int").alias("first"), s["last"].cast("int").alias("last")))
    cut = turns.withColumn("_cut", cut_text(F.col("_text"), spans))
    return cut.select(*[F.col("_cut").alias(c) if c == text else F.col("_in").getField(c).alias(c) for c in docs.columns])
