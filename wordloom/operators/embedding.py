"""Word vectors: matrix, coverage, pooling, norms, nearest words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import hashing
from wordloom.functions import vectors as vx
from wordloom.session import fits_broadcast, ranked_join
from wordloom.settings import GENERATED_STD, PAD_IDX, SEED, VECTOR_DIM

POOLINGS = ("mean", "max", "meanmax")
POOLED_AT_ONCE = 256  # rows whose vectors are held together


def embedding_matrix(
    vocab: DataFrame,
    vectors: DataFrame,
    dim: int = VECTOR_DIM,
    seed: int = SEED,
    std: float = GENERATED_STD,
) -> DataFrame:
    """(idx, token, vector ARRAY<FLOAT>, found BOOLEAN): the trained vector of a word where
    there is one, zeros for the pad row, seeded normal values for the rest."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    drawn = F.when(F.col("idx") == PAD_IDX, zeros).otherwise(hashing.normal_vector(F.col("idx"), dim, seed, std))
    trained = vectors.select("token", F.col("vector").cast("array<float>").alias("trained"))
    # a ranked vocabulary leaves its top-k in one partition; drawing needs all slots
    slots = vocab.sparkSession.sparkContext.defaultParallelism
    return vocab.join(trained, "token", "left").repartition(slots, "idx").select(
        "idx", "token", F.coalesce("trained", drawn).alias("vector"), F.col("trained").isNotNull().alias("found")
    )


def known_words(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vocabulary rows that have a word vector."""
    return vocab.join(vectors.select("token"), "token", "left_semi")


def oov_words(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vocabulary rows without a word vector."""
    return vocab.join(vectors.select("token"), "token", "left_anti")


def coverage(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """(found, vocab_size, coverage): specials count as vocabulary."""
    marked = vocab.join(vectors.select("token", F.lit(1).alias("hit")), "token", "left")
    return marked.agg(F.count("hit").alias("found"), F.count("*").alias("vocab_size")).withColumn(
        "coverage", F.col("found") / F.greatest(F.lit(1), F.col("vocab_size"))
    )


def pool(
    encoded: DataFrame,
    matrix: DataFrame,
    how: str = "meanmax",
    key: str = "doc_id",
    keep: tuple[str, ...] = (),
    dim: int = VECTOR_DIM,
    matrix_rows: int | None = None,
) -> DataFrame:
    """(key, *keep, features ARRAY<DOUBLE>): mean, maximum, or mean followed by maximum of
    the vectors at the real positions; zeros for a document without any.

    Ids are ranks by frequency, so beyond the budget only rare words are shuffled.  Within it, an
    encoded table comes out of a grouping by `key`, which the grouping here keeps; the ids stay
    in their row and the vectors are pooled where they are, neither shuffled nor sorted."""
    if how not in POOLINGS:
        raise ValueError(f"how must be one of {', '.join(POOLINGS)}")
    real = F.filter("input_ids", lambda i: i != PAD_IDX)
    # a document without real tokens pools the all-zero pad row
    ids = F.when(F.size(real) == 0, F.array(F.lit(PAD_IDX))).otherwise(real)
    if fits_broadcast(matrix, matrix_rows, 8 * dim + 96):
        rows = encoded.select(key, *keep, ids.alias("_ids")).groupBy(key)
        whole = rows.agg(*[F.any_value(c).alias(c) for c in keep], F.flatten(F.collect_list("_ids")).alias("_ids"))
        return pool_lists(whole, matrix, how, (key, *keep), dim)
    long = encoded.select(key, *keep, F.explode_outer(ids).alias("idx"))
    rows = matrix.select("idx", array_to_vector("vector").alias("vector"))
    joined = ranked_join(long, rows, "idx", matrix_rows, 8 * dim + 96, how="inner")
    metrics = {"mean": ["mean"], "max": ["max"], "meanmax": ["mean", "max"]}[how]
    pooled = joined.groupBy(key).agg(
        *[F.any_value(c).alias(c) for c in keep], Summarizer.metrics(*metrics).summary(F.col("vector")).alias("s")
    )
    parts = [vector_to_array(F.col(f"s.{m}")) for m in metrics]
    return pooled.select(key, *keep, (F.concat(*parts) if len(parts) > 1 else parts[0]).alias("features"))


def pool_lists(lists: DataFrame, matrix: DataFrame, how: str, keep: tuple[str, ...], dim: int) -> DataFrame:
    """(*keep, features) of rows with a list `_ids`; the matrix travels to the tasks once.  An id counts as
    often as the matrix has it, and a row without any known id is left out, as in a join."""
    rows = matrix.select("idx", F.col("vector").cast("array<double>").alias("vector")).where("idx is not null").toArrow()
    idx = rows.column("idx").to_numpy()
    flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(idx), dim)
    size = int(idx.max()) + 1 if len(idx) else 1
    times = np.bincount(idx, minlength=size)
    sums, tops = np.zeros((size, dim)), np.full((size, dim), -np.inf)
    np.add.at(sums, idx, flat)
    np.maximum.at(tops, idx, flat)
    once = bool((times <= 1).all())  # then the two tables differ in unknown ids only, which are left out
    table = matrix.sparkSession.sparkContext.broadcast((times, sums, sums if once else tops))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, sums, tops = table.value
        for batch in batches:
            for at in range(0, batch.num_rows, POOLED_AT_ONCE):
                part = batch.slice(at, POOLED_AT_ONCE)
                ids = part.column("_ids").flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), part.column("_ids").value_lengths().to_numpy())
                known = (ids >= 0) & (ids < len(times))
                known[known] = times[ids[known]] > 0
                ids, row = ids[known], row[known]
                there, first = np.unique(row, return_index=True)
                parts = []
                if len(there) and how != "max":
                    parts.append(np.add.reduceat(sums[ids], first) / np.add.reduceat(times[ids], first)[:, None])
                if len(there) and how != "mean":
                    parts.append(np.maximum.reduceat(tops[ids], first))
                values = np.concatenate(parts, axis=1) if parts else np.zeros((0, dim))
                offsets = pa.array(np.arange(len(there) + 1, dtype=np.int32) * values.shape[1])
                features = pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(there)) for c in keep), features], [*keep, "features"])

    kept = "".join(f"`{c}` {lists.schema[c].dataType.simpleString()}, " for c in keep)
    return lists.select(*keep, "_ids").mapInArrow(run, kept + "features array<double>")


def normalise(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Replaces a vector column by its 'rms' or 'layer' normalised form."""
    if kind not in ("rms", "layer"):
        raise ValueError("kind must be 'rms' or 'layer'")
    values = F.col(column).cast("array<double>")
    return df.withColumn(column, vx.rms_norm(values) if kind == "rms" else vx.layer_norm(values))


def most_similar(vectors: DataFrame, word: object, n: int = 5, id_col: str = "token", vector: str = "vector") -> DataFrame:
    """(rank, id, similarity): the n rows nearest to the row `word` by cosine, itself
    excluded, ties by id.  Zero vectors have no similarity and are left out.  The query vector enters as a scalar subquery, so the table is
    read in place and every task keeps its own n best."""
    values = F.col(vector).cast("array<double>")
    query = vectors.where(F.col(id_col) == F.lit(word)).select(values.alias("q")).scalar()
    scored = (
        vectors.where(F.col(id_col) != F.lit(word))
        .withColumn("_query", query)
        .select(
            id_col,
            F.when(F.col("_query").isNull(), F.raise_error(F.lit(f"no vector for {word!r}")).cast("double"))
            .otherwise(F.round(vx.cosine(values, F.col("_query")), 9))
            .alias("similarity"),
        )
        .where(F.col("similarity").isNotNull())
        .orderBy(F.desc("similarity"), id_col)
        .limit(n)
    )
    place = F.row_number().over(Window.orderBy(F.desc("similarity"), id_col))  # n rows
    return scored.select(place.alias("rank"), id_col, "similarity")


# Rows of a block on either side, about: a pair of blocks is one call in one task.
QUERY_BLOCK = 4096
VECTOR_BLOCK = 8192
SCORES = 1 << 22  # scores held at once: 32 MB


def unit_rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled to length one, which of them have a direction) of a column of vectors."""
    rows = column.combine_chunks()
    values = rows.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(rows), -1)
    sizes = np.linalg.norm(values, axis=1)
    return values / np.where(sizes > 0, sizes, 1)[:, None], sizes > 0


def nearest_of_block(queries: pa.Table, vectors: pa.Table, n: int, id_col: str, vector: str) -> pa.Table:
    """(query, id, similarity): the n nearest rows of `vectors` to each row of `queries`, ties by id."""
    asked, names = queries.column(id_col).to_pylist(), vectors.column(id_col).to_pylist()
    taken: tuple[list, list, list] = ([], [], [])
    if asked and names:
        order = sorted(range(len(names)), key=names.__getitem__)
        q, some = unit_rows(queries.column(vector))
        v, able = unit_rows(vectors.column(vector))
        order = [i for i in order if able[i]]
        names, v = [names[i] for i in order], v[order]
        places: dict[object, list[int]] = {}
        for i, name in enumerate(names):
            places.setdefault(name, []).append(i)
        wanted = np.flatnonzero(some)
        step = max(1, SCORES // max(1, len(names)))
        for part in (wanted[i : i + step] for i in range(0, len(wanted) if names else 0, step)):
            scores = np.round(q[part] @ v.T, 9)
            for row, i in enumerate(part):
                scores[row, places.get(asked[i], [])] = -np.inf
            least = np.partition(scores, -min(n, len(names)), axis=1)[:, -min(n, len(names))]
            row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            best = np.lexsort((col, -scores[row, col], row))
            row, col = row[best], col[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[place < n], col[place < n]
            taken[0].extend(asked[i] for i in part[row])
            taken[1].extend(names[i] for i in col)
            taken[2].extend(scores[row, col].tolist())
    kind = queries.schema.field(id_col).type
    return pa.table([pa.array(taken[0], kind), pa.array(taken[1], kind), pa.array(taken[2], pa.float64())], ["query", id_col, "similarity"])


def most_similar_batch(
    vectors: DataFrame,
    queries: DataFrame,
    n: int = 5,
    id_col: str = "token",
    vector: str = "vector",
    query_block: int = QUERY_BLOCK,
    vector_block: int = VECTOR_BLOCK,
) -> DataFrame:
    """(query, rank, id, similarity) for many query rows at once; exact.

    Both sides are dealt into blocks by a hash of the id; every pair of a query block and a
    vector block meets once and hands on the n best of each query, and those meet.  So a task
    holds two blocks, whatever the number of rows; a row travels once per block of the other
    side, the plan is the same for any number of queries, and nothing goes through the driver.
    Smaller blocks are taken where that gives all slots a pair.  Null and zero vectors have no
    similarity and are left out on both sides; all others have one width."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    slots = vectors.sparkSession.sparkContext.defaultParallelism
    sides = [t.select(id_col, vector).where(F.col(vector).isNotNull()) for t in (queries, vectors)]
    asked, there = (max(1, t.count()) for t in sides)
    vector_blocks = -(-there // vector_block)
    least = min(-(-slots // vector_blocks), -(-asked // 64))  # no fewer than 64 queries for the sake of slots
    query_blocks = max(-(-asked // query_block), least)

    def dealt(side: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
        return side.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = dealt(sides[0], "_query_block", query_blocks, "_vector_block", vector_blocks)
    right = dealt(sides[1], "_vector_block", vector_blocks, "_query_block", query_blocks)
    pair = ["_query_block", "_vector_block"]

    def best(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        return nearest_of_block(queries, vectors, n, id_col, vector)

    found = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(best, f"query {id_type}, `{id_col}` {id_type}, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), id_col))
    return found.withColumn("rank", place).where(F.col("rank") <= n).select("query", "rank", id_col, "similarity")
