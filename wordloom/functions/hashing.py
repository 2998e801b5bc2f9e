"""Repeatable pseudo-random numbers from md5.

Spark's rand/randn depend on the partitioning and would change when a task is recomputed;
these depend on the row's own key only, and any SQL engine can reproduce them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.vectors import bind


def order_hash(key: Column, *parts: object) -> Column:
    """Hex digest of 'part|...|key': sorting by it is a seeded shuffle."""
    return F.md5(F.concat_ws("|", *[F.lit(str(p)) for p in parts], key.cast("string")))


def _fraction(digest: Column, part: int) -> Column:
    """Part 0..3 of a digest (eight hex digits each) as a DOUBLE in [0, 1)."""
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("double") / float(2**32)


def normal_quad(digest: Column) -> Column:
    """Four standard normal deviates of one digest: two Box-Muller pairs."""

    def pair(part: int) -> list[Column]:
        radius = F.sqrt(F.lit(-2.0) * F.log(_fraction(digest, part) + 1.0 / 2**32))
        angle = F.lit(2.0 * math.pi) * _fraction(digest, part + 1)
        return [radius * F.cos(angle), radius * F.sin(angle)]

    return F.array(*pair(0), *pair(2))


def normal_vector(idx: Column, dim: int, seed: int, std: float) -> Column:
    """ARRAY<FLOAT> of `dim` deviates, a function of (seed, idx, position) alone.  One
    digest of 'seed|idx|block' serves a block of four positions."""
    quads = F.transform(
        F.sequence(F.lit(0), F.lit((dim - 1) // 4)),
        lambda block: bind(
            F.md5(F.concat_ws("|", F.lit(str(seed)), idx.cast("string"), block.cast("string"))), normal_quad
        ),
    )
    return F.transform(F.slice(F.flatten(quads), 1, dim), lambda x: (x * std).cast("float"))
