"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import forget, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the links (a, b): root is the smallest node reachable.

    Every round hands each node's larger neighbours to its smallest one, then each node's
    smaller neighbours to the smallest of them, until all links lead to roots; the rounds grow
    with the logarithm of the longest path.  A hub is one minimum per task and a join that the
    adaptive planner can split; no group is collected.  Each round is written down, which cuts
    the lineage, and the one before is deleted."""
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, before = written(pairs), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        moved = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        forget(last)


def rooted(rows: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    """`rows` with the root of the node in column `node` as `name`; a node without links is its own."""
    of = roots.select(F.col("node").alias(node), F.col("root").alias(name))
    return rows.join(of, node, "left").withColumn(name, F.coalesce(name, node))
