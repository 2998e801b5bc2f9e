"""Approximate nearest neighbours by cosine.

Method: the vectors are dealt over shards of bounded size.  A task builds the hierarchical
navigable small-world graph of its shard: a few layers, each a flat array of neighbours per
node.  Every query goes to every shard, in blocks; the best of all shards are merged.
Candidates found are scored exactly, in double precision, on the original vectors.

Equal vectors are one node of the graph that carries its smallest ids; as many are kept as a
query can ask for, and one more for the query itself, so nothing is lost.  Vectors that are
null, empty, zero, or hold a null or non-finite component take no part.  Vectors of other
widths are spaces of their own.  A query with fewer candidates than asked for gets them all;
a table without vectors gives no rows.  Repeated rows of an id and vector count once.
Building depends on the shard's rows alone, so a lost task builds the same graph again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import written

LINKS = 16  # neighbours that a new node looks for; twice as many fit on the lowest layer
BUILD_BEAM = 96
SEARCH_BEAM = 256
BATCH = 256  # nodes or queries that move through the graph together
SHARD_ROWS = 8_192


def diverse(dist: np.ndarray, between: np.ndarray, most: int) -> np.ndarray:
    """(rows, candidates) sorted by distance -> mask of at most `most` taken: those nearer to
    the row than to any one taken before, then the nearest of the others."""
    rows, n = dist.shape
    taken = np.zeros((rows, n), bool)
    nearest = np.full((rows, n), np.inf, np.float32)  # of each candidate to those taken
    count = np.zeros(rows, np.int64)
    for c in range(n):
        good = np.isfinite(dist[:, c]) & (dist[:, c] < nearest[:, c]) & (count < most)
        taken[good, c] = True
        count += good
        np.minimum(nearest, between[:, :, c], out=nearest, where=good[:, None])
    rest = np.isfinite(dist) & ~taken
    return taken | (rest & (np.cumsum(rest, axis=1) <= (most - count)[:, None]))


class Graph:
    """The graph of one shard, over rows of unit length."""

    def __init__(self, unit: np.ndarray, seed: int = 5):
        self.unit = np.ascontiguousarray(unit, np.float32)
        n = len(unit)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int), 8)
        order = np.argsort(-self.level, kind="stable")  # the first node reaches the top
        self.level[order[:1]] = self.level.max(initial=0) if n else 0
        self.top = int(self.level.max(initial=0))
        self.links = []  # per layer: row of each node (-1: not in it) and its neighbours
        for layer in range(self.top + 1):
            place = np.full(n, -1, np.int64)
            mine = np.flatnonzero(self.level >= layer)
            place[mine] = np.arange(len(mine))
            width = 2 * LINKS if layer == 0 else LINKS
            self.links.append((place, np.full((len(mine), width), -1, np.int32)))
        self.entry = int(order[0]) if n else -1
        rest = np.setdiff1d(np.arange(n), [self.entry])
        rest = np.random.default_rng(seed + 1).permutation(rest)
        at, step = 0, 1
        while at < len(rest):
            self._insert(rest[at : at + step])
            at += step
            step = min(BATCH, at + 1)

    def _insert(self, nodes: np.ndarray) -> None:
        entries = np.full((len(nodes), 1), self.entry, np.int64)
        for layer in range(self.top, -1, -1):
            found, dist = self._beam(self.unit[nodes], entries, layer, BUILD_BEAM if layer == 0 else BUILD_BEAM // 2)
            entries = found[:, :4]
            here = np.flatnonzero(self.level[nodes] >= layer)
            if len(here):
                self._link(nodes[here], found[here], dist[here], layer)

    def _link(self, nodes: np.ndarray, found: np.ndarray, dist: np.ndarray, layer: int) -> None:
        place, table = self.links[layer]
        # nodes of the same batch can't find each other in the graph yet
        own = 1 - self.unit[nodes] @ self.unit[nodes].T
        np.fill_diagonal(own, np.inf)
        near = np.argsort(own, axis=1)[:, :LINKS]
        found = np.concatenate([found, nodes[near]], axis=1)
        dist = np.concatenate([dist, np.take_along_axis(own, near, 1)], axis=1).astype(np.float32)
        picked = self._choose(found, dist, LINKS)
        table[place[nodes], :LINKS] = picked
        source, target = np.repeat(nodes, LINKS), picked.ravel().astype(np.int64)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, first, counts = np.unique(target, return_index=True, return_counts=True)
        width = table.shape[1]
        for low, high in ((0, 8), (8, 64), (64, 1 << 30)):  # hubs apart: rows of like width
            some = (counts > low) & (counts <= high)
            if not some.any():
                continue
            wide = np.full((some.sum(), width + counts[some].max()), -1, np.int64)
            wide[:, :width] = table[place[heads[some]]]
            row = np.repeat(np.arange(some.sum()), counts[some])
            at = np.concatenate([np.arange(f, f + c) for f, c in zip(first[some], counts[some])])
            wide[row, width + at - np.repeat(first[some], counts[some])] = source[at]
            for a in range(0, len(wide), 512):
                self._refresh(heads[some][a : a + 512], wide[a : a + 512], place, table)

    def _refresh(self, heads: np.ndarray, wide: np.ndarray, place: np.ndarray, table: np.ndarray) -> None:
        """New neighbour rows of `heads` out of the candidates `wide`."""
        width = table.shape[1]
        wide = np.sort(wide, axis=1)  # two nodes of a batch may have chosen each other
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        full = (wide >= 0).sum(axis=1) > width
        packed = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable"), 1)
        table[place[heads[~full]]] = packed[~full, :width]
        if full.any():
            some = packed[full]
            some = some[:, : (some >= 0).sum(axis=1).max()]
            d = 1 - np.einsum("rd,rcd->rc", self.unit[heads[full]], self.unit[some])
            d[some < 0] = np.inf
            table[place[heads[full]]] = self._choose(some, d, width)

    def _choose(self, found: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """(rows, most) ids taken from the candidates, -1 where there are too few."""
        order = np.argsort(np.where(found < 0, np.inf, dist), axis=1, kind="stable")[:, : 3 * most]
        found, dist = np.take_along_axis(found, order, 1), np.take_along_axis(dist, order, 1)
        dist = np.where(found < 0, np.inf, dist).astype(np.float32)
        rows = self.unit[found]
        mask = diverse(dist, 1 - rows @ rows.transpose(0, 2, 1), most)
        first = np.argsort(~mask, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(mask, first, 1), np.take_along_axis(found, first, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _beam(self, queries: np.ndarray, entries: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the best `beam` nodes found on a layer, nearest first."""
        place, table = self.links[layer]
        b, n = len(queries), len(self.unit)
        ids = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), np.inf, np.float32)
        done = np.zeros((b, beam), bool)
        seen = np.zeros((b, n), bool)
        d0 = 1 - np.einsum("bd,bed->be", queries, self.unit[entries])
        d0[entries < 0] = np.inf
        e = entries.shape[1]
        ids[:, :e], dist[:, :e] = np.where(entries < 0, -1, entries), d0
        np.put_along_axis(seen, np.maximum(entries, 0), True, 1)
        live = np.arange(b)
        while len(live):
            open_dist = np.where(done[live], np.inf, dist[live])
            pick = open_dist.argmin(axis=1)
            more = np.isfinite(open_dist[np.arange(len(live)), pick])
            live, pick = live[more], pick[more]
            if not len(live):
                break
            done[live, pick] = True
            next_ids = table[place[ids[live, pick]]].astype(np.int64)
            fresh = (next_ids >= 0) & ~seen[live[:, None], np.maximum(next_ids, 0)]
            r, c = np.nonzero(fresh)
            new = next_ids[r, c]
            seen[live[r], new] = True
            d = np.full(next_ids.shape, np.inf, np.float32)
            d[r, c] = 1 - np.einsum("xd,xd->x", queries[live[r]], self.unit[new])
            d[d >= dist[live].max(axis=1)[:, None]] = np.inf
            better = np.isfinite(d).any(axis=1)
            rows = live[better]
            if len(rows):
                all_d = np.concatenate([dist[rows], d[better]], axis=1)
                best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
                ids[rows] = np.take_along_axis(np.concatenate([ids[rows], next_ids[better]], axis=1), best, 1)
                flags = np.concatenate([done[rows], np.zeros((len(rows), next_ids.shape[1]), bool)], axis=1)
                done[rows] = np.take_along_axis(flags, best, 1)
                dist[rows] = np.take_along_axis(all_d, best, 1)
        ids[np.isinf(dist)] = -1
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def search(self, queries: np.ndarray, beam: int = SEARCH_BEAM) -> np.ndarray:
        """(queries, beam) node numbers, nearest first, -1 where there are no more."""
        parts = []
        for a in range(0, len(queries), BATCH):
            block = np.ascontiguousarray(queries[a : a + BATCH], np.float32)
            entries = np.full((len(block), 1), self.entry, np.int64)
            for layer in range(self.top, 0, -1):
                entries = self._beam(block, entries, layer, 16)[0][:, :4]
            parts.append(self._beam(block, entries, 0, min(beam, max(1, len(self.unit))))[0])
        return np.concatenate(parts) if parts else np.zeros((0, 1), np.int64)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>, dim): distinct rows that take part."""
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return rows.where(F.col("v").isNotNull() & finite & some).distinct().withColumn("dim", F.size("v"))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found of each query among all vectors
    with another id, ties to the smaller id."""
    base = usable(vectors, key, vector)
    smallest = Window.partitionBy("v").orderBy("id")
    few = base.withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= k + 1)
    nodes = written(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("dim").alias("dim")))
    shards = max(1, -(-nodes.count() // shard_rows))
    numbers = F.sequence(F.lit(0), F.lit(shards - 1))
    asked = usable(queries, key, vector).withColumn("shard", F.explode(numbers)).withColumn("ids", F.array("id"))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    rows = dealt.select("shard", "dim", F.lit(False).alias("asks"), "ids", "v").unionByName(
        asked.select("shard", "dim", F.lit(True).alias("asks"), "ids", "v")
    )
    # more partitions than shards, so that few shards share a task
    dealt = rows.repartition(4 * shards, "shard", "dim").sortWithinPartitions("shard", "dim", "asks")
    found = dealt.mapInArrow(_search(k, beam), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _search(k: int, beam: int):
    """Rows sorted by (shard, dim, asks): the nodes of a shard, then its queries in blocks."""

    def answer(graph: Graph, x: np.ndarray, ids: list, size: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
        q = _matrix(rows.column("v"))
        lengths = np.sqrt((q * q).sum(axis=1))
        hits = graph.search(q / np.abs(q).max(axis=1)[:, None] / (lengths / np.abs(q).max(axis=1))[:, None], beam)
        out_q, out_v, out_s = [], [], []
        for i, own in enumerate(rows.column("ids").to_pylist()):
            at = hits[i][hits[i] >= 0]
            score = (x[at] * q[i]).sum(axis=1) / (size[at] * lengths[i])
            pairs = [(-s, v) for s, a in zip(score.tolist(), at.tolist()) for v in ids[a] if v != own[0]]
            for s, v in sorted(pairs)[:k]:
                out_q.append(own[0])
                out_v.append(v)
                out_s.append(-s)
        return pa.RecordBatch.from_arrays(
            [pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())],
            ["query_id", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, graph = None, [], None
        x, ids, size = np.zeros((0, 0)), [], np.zeros(0)
        for batch in batches:
            spots = list(zip(batch.column("shard").to_pylist(), batch.column("dim").to_pylist(), batch.column("asks").to_pylist()))
            cuts = [0, *[i for i in range(1, len(spots)) if spots[i] != spots[i - 1]], len(spots)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                shard, dim, asks = spots[a]
                if (shard, dim) != current:
                    current, parts, graph = (shard, dim), [], None
                if not asks:
                    parts.append(batch.slice(a, b - a))
                    continue
                if graph is None and parts:
                    x = np.concatenate([_matrix(p.column("v")) for p in parts])
                    ids = [i for p in parts for i in p.column("ids").to_pylist()]
                    order = np.argsort([i[0] for i in ids], kind="stable")  # the same graph every time
                    x, ids = x[order], [ids[i] for i in order]
                    size = np.sqrt((x * x).sum(axis=1))
                    top = np.abs(x).max(axis=1)[:, None]
                    graph = Graph(x / top / (size[:, None] / top))
                if parts:
                    yield answer(graph, x, ids, size, batch.slice(a, b - a))

    return run
